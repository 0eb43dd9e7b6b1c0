"""Accuracy of extracted records against ground truth: scores per field, and totals that add up across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliate.config import REMOVED_FIELDS
from foliate.functions.similarity import ratio
from foliate.functions.text import strip
from foliate.sources.routing import evaluation_format


def truth_rows(truth: DataFrame) -> DataFrame:
    """filename, expected map -> filename, field, expected; removed fields go."""
    kept = F.map_filter("expected", lambda k, _: ~k.isin(*REMOVED_FIELDS))
    return truth.select("filename", F.explode(kept).alias("field", "expected"))


def score_fields(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """filename, field, format, similarity, correct. Expected fields drive; fields empty on both sides are left out.

    A case difference is no error: texts are compared in lower case.
    """
    pairs = expected.join(predicted, ["filename", "field"], "left")
    pairs = pairs.withColumn("a", strip(F.coalesce("expected", F.lit("")))).withColumn("b", strip(F.coalesce("predicted", F.lit(""))))
    pairs = pairs.filter("not (a = '' and b = '')").withColumn("a", F.lower("a")).withColumn("b", F.lower("b"))
    easy = pairs.filter("a = b or a = '' or b = ''").withColumn("similarity", F.when(F.col("a") == F.col("b"), 100.0).otherwise(0.0))
    hard = pairs.filter("not (a = b or a = '' or b = '')").withColumn("similarity", ratio(F.col("a"), F.col("b")))
    scored = easy.unionByName(hard)
    return scored.select(
        "filename", "field", evaluation_format(F.col("filename")).alias("format"), "similarity", (F.col("similarity") == 100).alias("correct")
    )


def totals(facts: DataFrame, *more: str) -> DataFrame:
    """Field-wise, format-wise and overall rows in one pass; ``more`` (as a run id) groups all of them."""
    sets = facts.groupingSets([[*map(F.col, more), F.col("field")], [*map(F.col, more), F.col("format")], [*map(F.col, more)]], *more, "field", "format")
    level = F.when(F.grouping("field") == 0, "field").when(F.grouping("format") == 0, "format").otherwise("overall")
    return sets.agg(
        level.alias("level"), F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"),
        F.round(F.sum(F.round("similarity", 6)) / F.count("*"), 4).alias("avg_similarity"),
        F.round(F.avg(F.col("correct").cast("double")) * 100, 4).alias("exact_pct"),
    )


def overall(facts: DataFrame) -> DataFrame:
    """One row even without facts: zeros."""
    got = facts.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("e"), F.avg("similarity").alias("s"))
    return got.select("n", F.coalesce(F.col("e") * 100, F.lit(0.0)).alias("exact_pct"), F.coalesce("s", F.lit(0.0)).alias("avg_similarity"))


def report(facts: DataFrame) -> DataFrame:
    """section, ord, line: the report's lines, fields by name."""
    t = totals(facts)
    line = F.when(F.col("level") == "field", F.format_string("%-30s: %.2f%%", "field", "avg_similarity"))
    line = line.when(
        F.col("level") == "format",
        F.format_string("%s: %d fields, exact %.2f%%, similarity %.2f%%", F.upper("format"), "n", "exact_pct", "avg_similarity"),
    ).otherwise(F.format_string("OVERALL: %d fields, exact %.2f%%, similarity %.2f%%", "n", "exact_pct", "avg_similarity"))
    return t.select(F.col("level").alias("section"), F.coalesce("field", "format", F.lit("")).alias("ord"), line.alias("line"))
