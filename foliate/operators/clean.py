"""Cleaning: normalise, snap to the domain's terms, drop noise, drop duplicates, order; and the garbage test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliate.config import CORRECTIONS, CleanConfig
from foliate.functions import text as X
from foliate.functions.similarity import may_reach, nearest, ratio
from foliate.operators.layout import PAGE, reading_order
from foliate.runtime import broadcast_if_small, materialise


SNAPPED = 200_000  # changed tokens are broadcast up to this count (about 10 MB), else joined by shuffle


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def typical_height(blocks: DataFrame) -> DataFrame:
    """Per page the upper median of positive box heights, 0 if there is none."""
    high = F.sort_array(F.collect_list(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))))
    page = blocks.groupBy(*PAGE).agg(high.alias("h"))
    return page.select(*PAGE, F.coalesce(F.get("h", F.expr("cast(size(h) div 2 as int)")), F.lit(0.0)).alias("typical_height"))


def signature_like(cfg: CleanConfig) -> Column:
    """Short, much taller than the page's lines and not read with confidence; wants ``typical_height``."""
    tall = (F.col("typical_height") > 0) & (F.col("y1") - F.col("y0") > F.col("typical_height") * 2.5)
    return (F.length(X.strip(F.col("text"))) <= 8) & tall & (F.col("confidence") < cfg.high_confidence)


def token_scores(tokens: DataFrame, words: list[str]) -> DataFrame:
    """token (distinct) -> score: best ratio against a bounded word list."""
    return tokens.select("token", nearest(words)(F.col("token"))["score"].alias("score"))


def word_likeness(blocks: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Adds word_score: mean best similarity of a block's words to real words; 100 for codes and wordless text."""
    words = F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1), lambda w: F.length(w) > 2)
    keyed = blocks.withColumn("__words", F.when(X.code_like(F.col("text")), F.array().cast("array<string>")).otherwise(F.transform(words, F.lower)))
    each = keyed.select(*PAGE, "block_idx", F.posexplode("__words").alias("at", "token"))
    best = token_scores(each.select("token").distinct(), cfg.real_words())
    mean = each.join(best, "token").groupBy(*PAGE, "block_idx").agg(F.avg("score").alias("__mean"))
    return keyed.join(mean, [*PAGE, "block_idx"], "left").withColumn("word_score", F.coalesce("__mean", F.lit(100.0))).drop("__mean", "__words")


def garbage(blocks: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Adds ``garbage``. Likeness is computed for rows of low confidence only: elsewhere it can't matter."""
    rows = blocks.join(typical_height(blocks), PAGE)
    low = word_likeness(rows.filter(F.col("confidence") < cfg.medium_confidence), cfg)
    rest = rows.filter(~(F.col("confidence") < cfg.medium_confidence) | F.col("confidence").isNull()).withColumn("word_score", F.lit(100.0))
    both = rest.unionByName(low)
    bad = signature_like(cfg) | X.symbol_only(F.col("text")) | ((F.col("word_score") < cfg.garbage_score) & (F.col("confidence") < cfg.medium_confidence))
    return both.withColumn("garbage", bad).drop("typical_height", "word_score")


def prefix_variant(a: Column, b: Column) -> Column:
    """One begins with the other, which has three letters at least: forms of one word, not a misreading."""
    return (F.least(F.length(a), F.length(b)) >= 3) & (F.startswith(a, b) | F.startswith(b, a))


def snap_table(tokens: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """token -> fixed, for distinct tokens that change: exact corrections, then the nearest term of the domain."""
    corrections, terms = lookup(CORRECTIONS), cfg.dictionary()
    bare = F.lower(F.regexp_replace("token", r"(?U)[^\w]", ""))
    lead = F.regexp_extract("token", r"(?U)^[^\w]*", 0)
    trail = F.regexp_extract("token", r"(?U)[^\w]*\z", 0)
    keyed = tokens.withColumns({"bare": bare, "whole": F.element_at(corrections, F.lower("token"))})
    keyed = keyed.withColumn("part", F.element_at(corrections, F.col("bare")))
    exact = keyed.filter(F.col("whole").isNotNull() | F.col("part").isNotNull())
    exact = exact.select("token", F.coalesce("whole", F.concat(lead, F.col("part"), trail)).alias("fixed"))
    fuzzy = keyed.filter(F.col("whole").isNull() & F.col("part").isNull() & F.col("bare").rlike(r"^\p{L}{3,}\z"))
    # written before it is used: a projection above would call the function again for each use
    near = materialise(fuzzy.select("bare").distinct().select("bare", nearest(list(terms), cfg.snap_similarity)(F.col("bare")).alias("near")))
    near = near.filter("near.ord is not null")
    listed = lambda values: F.get(F.array(*map(F.lit, values)), F.col("near.ord"))
    best = near.select("bare", listed(terms).alias("word"), listed(terms.values()).alias("own"))
    best = best.filter((F.col("word") != F.col("bare")) & ~prefix_variant(F.col("bare"), F.col("word")))
    return exact.unionByName(fuzzy.join(best, "bare").select("token", F.concat(lead, F.col("own"), trail).alias("fixed")))


def snap(rows: DataFrame, key: list[str], cfg: CleanConfig = CleanConfig(), text_col: str = "text") -> DataFrame:
    """Snaps the tokens of ``text_col``. Only changed tokens travel: they are joined by distinct token and put back by place."""
    tokens = F.split(text_col, " ", -1)
    each = rows.select(*key, F.posexplode(tokens).alias("at", "token")).filter(F.col("token") != "")
    # distinct tokens are read by every rule, so they are written once; those that change are few as a rule
    table = broadcast_if_small(materialise(snap_table(materialise(each.select("token").distinct()), cfg)), SNAPPED)
    fixes = each.join(table, "token").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("at", "fixed"))).alias("__fixes"))
    joined = rows.join(fixes, key, "left")
    fixed = F.array_join(F.transform(tokens, lambda t, i: F.coalesce(F.element_at("__fixes", i), t)), " ")
    return joined.withColumn(text_col, F.when(F.col("__fixes").isNull(), F.col(text_col)).otherwise(fixed)).drop("__fixes")


def normalise(blocks: DataFrame, cfg: CleanConfig = CleanConfig(), unicode: bool = True, snapped: bool = True) -> DataFrame:
    text = X.normalise_unicode(F.col("text")) if unicode else F.col("text")
    rows = blocks.withColumn("text", X.strip_edge_noise(X.collapse_whitespace(text)))
    rows = snap(rows, [*PAGE, "block_idx"], cfg) if snapped else rows
    return rows.withColumn("text", X.normalise_dates(F.col("text")))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of boxes of the aliased sides; 0 without an intersection."""
    c = lambda side, name: F.col(f"{side}.{name}")
    wide = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    high = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    inter = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
    area = lambda s: F.greatest(F.lit(0.0), c(s, "x1") - c(s, "x0")) * F.greatest(F.lit(0.0), c(s, "y1") - c(s, "y0"))
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def overlapping(blocks: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Pairs i < j of a page from different sources whose boxes overlap enough (native: a hash join on the page)."""
    a, b = blocks.alias("a"), blocks.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in PAGE]
    touch = (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    on = same[0] & same[1] & (F.col("a.block_idx") < F.col("b.block_idx")) & (F.col("a.source") != F.col("b.source")) & touch
    pairs = a.join(b, on).withColumn("iou", overlap("a", "b")).filter(F.col("iou") >= cfg.iou)
    first = F.when((F.col("a.source") == "embedded") & (F.col("b.source") != "embedded"), True)
    first = first.when((F.col("b.source") == "embedded") & (F.col("a.source") != "embedded"), False)
    first = first.otherwise(F.col("a.confidence") >= F.col("b.confidence"))
    return pairs.select(
        *[F.col(f"a.{c}").alias(c) for c in PAGE], F.col("a.block_idx").alias("i"), F.col("b.block_idx").alias("j"), "iou",
        F.lower("a.text").alias("text_i"), F.lower("b.text").alias("text_j"),
        F.when(first, F.col("b.block_idx")).otherwise(F.col("a.block_idx")).alias("loser"),
    )


def duplicate_pairs(blocks: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Overlapping pairs whose texts are similar; the UDF sees only pairs that boxes and lengths let through."""
    pairs = overlapping(blocks, cfg).filter(may_reach(F.col("text_i"), F.col("text_j"), cfg.text_similarity))
    return pairs.withColumn("similarity", ratio(F.col("text_i"), F.col("text_j"))).filter(F.col("similarity") >= cfg.text_similarity)


def drop_duplicates(blocks: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    losers = duplicate_pairs(blocks, cfg).select(*PAGE, F.col("loser").alias("block_idx")).distinct()
    return blocks.join(losers, [*PAGE, "block_idx"], "left_anti")


def clean(blocks: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """The whole cleaner in its order: [garbage], normalise, drop empty, drop duplicates, reading order."""
    rows = garbage(blocks, cfg).filter("not garbage").drop("garbage") if cfg.drop_garbage else blocks
    # read four times below: written once instead of normalised again each time
    rows = materialise(normalise(rows, cfg).filter(~X.symbol_only(F.col("text"))))
    return reading_order(drop_duplicates(rows, cfg), cfg.band_px)


def cleaning_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, total_blocks_before, total_blocks_after."""
    a = before.groupBy("doc_id").agg(F.count("*").alias("total_blocks_before"))
    b = after.groupBy("doc_id").agg(F.count("*").alias("total_blocks_after"))
    return a.join(b, "doc_id", "left").withColumn("total_blocks_after", F.coalesce("total_blocks_after", F.lit(0).cast("long")))
