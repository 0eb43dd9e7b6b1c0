"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised: a = 1 keeps the corpus as it is, a = 0 gives
every source the same weight. The exponent is found by repeated section of [0, 1] (33 points a round, one small
aggregate over the source table each) to meet a target: an entropy of the weights, or a limit on how often the
scarcest source may be repeated.

The weights are realised as budgeted block permutations. A source's documents fall into blocks by hash. Every epoch
puts the blocks into an order of its own (``block`` is a block's place in it) and the documents inside a block into an
order of their own (``place``); a source is read by (epoch, block, place). A quota of tokens takes whole epochs, then
whole blocks of the next epoch in its order, then documents of one last block as long as they fit. Running sums are over
blocks and inside that one block only, so a source that holds a third of all rows is never summed in one task. A source
gives at most its quota of tokens, and less than that by the size of one document at most.

The default budget covers: every document occurs at least once, scarce sources more often.

Defined cases: a null source is a source of its own; null or white-space text has 0 tokens and occurs with its
block, where that is taken whole; a text of any length is counted whole; repeated rows are documents of their own, told apart by a copy number
(equal ones are counted, then dealt out again, so a hot group of copies meets in no task); equal orders do not occur but
for equal 64-bit hashes; extra columns are carried along, whatever their names (n_tokens, weight, epoch, block and place
are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from foliate.functions.columns import fresh
from foliate.runtime import broadcast_if_small, materialise

from .copies import dealt, whole_row

POINTS, ROUNDS = 33, 7  # the exponent is known to 32 ** -7
BLOCK_ROWS = 2048
SOURCES, BLOCKS = 50_000, 200_000  # rows of the tables of sources and of blocks up to which they are broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def section(shares: DataFrame, met) -> float:
    """Smallest exponent in [0, 1] at which ``met(sum p^a, sum p^a ln p, p ratio, a)`` holds; 1 if none."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
        sums = shares.agg(
            *[F.sum(F.exp(F.col("ln_p") * a)).alias(f"z{i}") for i, a in enumerate(points)],
            *[F.sum(F.exp(F.col("ln_p") * a) * F.col("ln_p")).alias(f"y{i}") for i, a in enumerate(points)],
            (F.max("ln_p") - F.min("ln_p")).alias("spread"),
        ).first()
        ok = [i for i, a in enumerate(points) if sums[f"z{i}"] and met(sums[f"z{i}"], sums[f"y{i}"], sums["spread"], a)]
        first = ok[0] if ok else POINTS - 1
        high = points[first]
        low = points[max(first - 1, 0)]
    return high


def entropy_below(target: float):
    """Entropy of the weights falls as the exponent grows: the flattest mix of at most ``target`` nats."""
    return lambda z, y, spread, a: math.log(z) - a * y / z <= target + 1e-12


def repeats_within(limit: float):
    """Under the covering budget the scarcest source is repeated exp(spread * (1 - a)) times."""
    return lambda z, y, spread, a: spread * (1 - a) <= math.log(limit) + 1e-12


def source_weights(docs: DataFrame, source_col: str, tokens_col: str, target) -> DataFrame:
    """src, n_docs, tokens, share, weight, quota (covering budget), one row per source."""
    sources = materialise(docs.groupBy(F.col(source_col).alias("src")).agg(F.count("*").alias("n_docs"), F.sum(tokens_col).alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    some = sources.filter("tokens > 0").withColumn("ln_p", F.log(F.col("tokens") / F.lit(float(max(total, 1)))))
    a = section(some, target)
    z = some.agg(F.sum(F.exp(F.col("ln_p") * a)), F.max(F.exp(F.col("ln_p") * (1 - a)))).first()
    norm, cover = z[0] or 1.0, (z[1] or 1.0) * (z[0] or 1.0)  # tokens / weight is largest for the most common source
    weight = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / F.lit(float(max(total, 1)))) * a) / norm).otherwise(0.0)
    quota = F.greatest(F.col("tokens").cast("double"), F.round(weight * F.lit(cover * total)))
    return (
        sources.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
        .withColumn("weight", weight)
        .withColumn("quota", quota.cast("long"))
        .withColumn("exponent", F.lit(a))
    )


def schedule(weights: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """src, part, epoch, block, room: which blocks an epoch takes, in its order.

    ``room`` is null for a block that is taken whole, else the tokens that the quota leaves for the last block.
    """
    each = sizes.join(broadcast_if_small(weights.select(F.col("src").alias("w_src"), "whole", "quota", "tokens"), SOURCES), F.col("src").eqNullSafe(F.col("w_src")))
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "whole")))
    order = Window.partitionBy("src", "epoch").orderBy(F.xxhash64(F.lit(seed), "part", "epoch"), "part")
    each = each.withColumn("block", (F.row_number().over(order) - 1).cast("long"))
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("quota") - F.col("whole") * F.col("tokens") - F.coalesce(before, F.lit(0))
    each = each.withColumn("room", F.when(F.col("epoch") == F.col("whole"), room))
    each = each.filter("room is null or room > 0").withColumn("room", F.when(F.col("size") > F.col("room"), F.col("room")))
    return each.select("src", "part", "epoch", "block", "room")


def mix(docs: DataFrame, target, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per realised occurrence: the row's columns, n_tokens, weight, epoch, block, place.

    epoch, block, place order the mix within a source; a reader interleaves the sources by weight.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "weight", "epoch", "block", "place")])
    code, check, copy, copies, src, part, blocks, room, key, second = fresh(
        kept.columns, "__code", "__check", "__copy", "__copies", "__src", "__part", "__blocks", "__room", "__key", "__second"
    )
    coded = kept.withColumns({"n_tokens": word_count(F.col(text_col)), code: whole_row(kept, seed), check: whole_row(kept, seed + 1)})
    light = materialise(coded.select(F.col(source_col).alias("src"), "n_tokens", F.col(code).alias("code"), F.col(check).alias("check")))
    weights = source_weights(light, "src", "n_tokens", target)
    # block count of a source: a power of two, so that a block holds about BLOCK_ROWS rows
    weights = weights.withColumn("blocks", F.expr(f"cast(power(2, ceil(log2(greatest(1, n_docs / {BLOCK_ROWS})))) as long)"))
    weights = materialise(weights.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1)).cast("long")))

    # copies of one row get numbers
    repeated = materialise(light.groupBy("code", "check").agg(F.count("*").alias("copies"), F.first("src").alias("src"), F.first("n_tokens").alias("n_tokens")).filter("copies > 1"))
    light, coded = light.withColumn("copy", F.lit(0).cast("long")), coded.withColumn(copy, F.lit(0).cast("long"))
    if not repeated.isEmpty():
        again = broadcast_if_small(repeated.select(F.col("code").alias(key), F.col("check").alias(second)), BLOCKS)
        both = [F.col(code) == F.col(key), F.col(check) == F.col(second)]
        names = [c for c in coded.columns if c not in (code, check, copy)]
        groups = coded.join(again, both, "left_semi").groupBy(code, check).agg(
            F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("row"), F.count("*").alias(copies)
        )
        groups = groups.select(*[F.col(f"row.`{c}`").alias(c) for c in names], code, check, copies)
        coded = coded.join(again, both, "left_anti").unionByName(dealt(groups, code, copies, copy))
        light = light.join(again, [F.col("code") == F.col(key), F.col("check") == F.col(second)], "left_anti").unionByName(dealt(repeated, "code", "copies", "copy"))
        light = materialise(light.select("src", "n_tokens", "code", "copy"))

    def placed(rows: DataFrame, by: str, own: str, number: str, name: str) -> DataFrame:
        """Adds the weight of the row's source and the part of the source that the row belongs to."""
        known = weights.select(F.col("src").alias(src), "weight", F.col("blocks").alias(blocks))
        joined = rows.join(broadcast_if_small(known, SOURCES), F.col(by).eqNullSafe(F.col(src)))
        return joined.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), own, number), F.col(blocks))).drop(blocks, src)

    light = placed(light, "src", "code", "copy", "part")
    sizes = light.groupBy("src", "part").agg(F.sum("n_tokens").alias("size"))
    plan = materialise(schedule(weights, sizes, seed))
    place = lambda own, number, turn: F.xxhash64(F.lit(seed + 1), own, number, turn)
    # the one block of a source of which only a part fits: documents in the block's order, up to the first that does not fit
    edge = broadcast_if_small(plan.filter("room is not null").toDF("e_src", "e_part", "epoch", "block", "room"), SOURCES)
    inside = light.filter("n_tokens > 0").join(edge, F.col("src").eqNullSafe(F.col("e_src")) & (F.col("part") == F.col("e_part")))
    inside = inside.withColumn("place", place("code", "copy", "epoch"))
    within = Window.partitionBy("src").orderBy("place", "code", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("n_tokens").over(within)).filter("upto <= room")
    drawn = materialise(inside.select("code", "copy").distinct())

    out = placed(coded, source_col, code, copy, part)
    taken = broadcast_if_small(plan.toDF(src, key, "epoch", "block", room), BLOCKS)
    out = out.join(taken, F.col(source_col).eqNullSafe(F.col(src)) & (F.col(part) == F.col(key))).drop(src, key)
    chosen = broadcast_if_small(drawn.toDF(key, second), BLOCKS)
    out = out.join(chosen, (F.col(code) == F.col(key)) & (F.col(copy) == F.col(second)), "left")
    out = out.filter(F.col(room).isNull() | F.col(key).isNotNull()).withColumn("place", place(code, copy, "epoch"))
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], "n_tokens", "weight", "epoch", "block", "place")
