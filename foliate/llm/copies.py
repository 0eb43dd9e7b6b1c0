"""Copies of one row: told apart by numbers, without gathering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliate.functions.columns import fresh

COPIES = 10_000  # copies of one row that one task deals out


def whole_row(docs: DataFrame, seed: int) -> Column:
    """Hash of all columns; a map, which has no order, as its sorted entries, and a type without a hash as JSON."""

    def hashable(name: str, kind: str) -> Column:
        if kind.startswith("map<") and "map<" not in kind[4:]:
            return F.sort_array(F.map_entries(F.col(f"`{name}`")))
        return F.to_json(F.struct(F.col(f"`{name}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{name}`")

    # a null is skipped by the hash, so which columns are null goes into it too
    nulls = F.concat(*[F.when(F.col(f"`{n}`").isNull(), "0").otherwise("1") for n in docs.columns])
    return F.xxhash64(F.lit(seed), nulls, *[hashable(n, k) for n, k in docs.dtypes])


def dealt(groups: DataFrame, code: str, copies: str, copy: str) -> DataFrame:
    """One row per copy of the groups' rows, with its number: spread by runs of COPIES before they are written out."""
    run = fresh(groups.columns, "__run")[0]
    runs = groups.withColumn(run, F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {COPIES})"))).repartition(code, run)
    last = F.least(F.col(copies), (F.col(run) + 1) * COPIES) - 1
    return runs.withColumn(copy, F.explode(F.sequence(F.col(run) * COPIES, last))).drop(run, copies)
