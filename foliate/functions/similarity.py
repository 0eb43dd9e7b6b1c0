"""Indel similarity: 200 LCS(a, b) / (|a| + |b|), 100 for two empty strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is one integer, a bit per character of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = where.get(c)
        if match:
            hit = row & match
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    if not total or a == b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / total


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


# Not pure to the optimiser: else a filter on the score is pushed below the projection, and every pair is scored twice.
_ratio = _ratio.asNondeterministic()


def ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Native test that lengths allow a ratio of ``threshold``: the common part is the shorter string at most."""
    shorter, total = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return (total == 0) | (shorter * 200.0 >= total * threshold)


def nearest_of(tokens: list[str], words: list[str], least: float) -> list[tuple[int, float] | None]:
    """For each token the (index, ratio) of the most similar word, first of the list on ties; None below ``least``.

    Letters in common bound the common subsequence; words are tried from the highest bound down.
    """
    letters = {c: i for i, c in enumerate(sorted(set("".join(words))))}

    def bag(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(letters)), np.int16)
        for row, text in zip(out, texts):
            for c in text:
                if c in letters:
                    row[letters[c]] += 1
        return out

    own, sizes = bag(words), np.array([len(w) for w in words])
    found: list[tuple[int, float] | None] = []
    for at in range(0, len(tokens), 1024):
        part = tokens[at : at + 1024]
        common = np.minimum(bag(part)[:, None, :], own[None]).sum(2)
        bound = 200.0 * common / np.maximum(sizes[None] + np.array([len(t) for t in part])[:, None], 1)
        for token, row in zip(part, bound):
            best = None
            for i in np.lexsort((np.arange(len(words)), -row)).tolist():
                if row[i] < (best[1] if best else least):
                    break
                score = ratio_of(token, words[i])
                if score >= least and (best is None or (-score, i) < (-best[1], best[0])):
                    best = (i, score)
            found.append(best)
    return found


def nearest(words: list[str], least: float = 0.0):
    """token column -> struct<ord, score> of its most similar word of a bounded list (null below ``least``)."""

    @F.pandas_udf("ord int, score double")
    def run(tokens: pd.Series) -> pd.DataFrame:
        got = nearest_of(tokens.tolist(), words, least)
        return pd.DataFrame({"ord": pd.array([g and g[0] for g in got], "Int32"), "score": [g[1] if g else None for g in got]})

    return run
