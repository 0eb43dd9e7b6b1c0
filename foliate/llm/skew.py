"""Joins that no hot key holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT = 10_000


def meet(rows: DataFrame, table: DataFrame, on: list[str], size: str, small: int = 0, how: str = "inner") -> DataFrame:
    """Join of rows with a table of unique keys ``on``, whose column ``size`` says how many rows have the key (it goes).

    The keys that hold more than one in HOT of all rows, so fewer than HOT of them, are broadcast; the others are joined by
    shuffle. A table of at most ``small`` rows is broadcast whole.
    """
    if small and table.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(table.drop(size)), on, how)
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * HOT > total
    many, few = F.broadcast(table.filter(hot).drop(size)), table.filter(~hot).drop(size)
    return rows.join(many, on, how).unionByName(rows.join(few, on, how))
