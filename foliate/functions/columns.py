"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it, also inside lambdas.

    A column made in an earlier projection does not do: the optimiser may merge it into the lambda that uses it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores before them until none clashes with ``columns`` (names are case-blind)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
