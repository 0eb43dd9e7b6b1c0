"""Sharding by extendible hashing.

The directory is indexed by leading bits of a key's MD5 hash. A bucket over the byte limit splits on its next bit;
others stay, so neighbouring shards have different depths. Sizes are summed by (depth, prefix) in one shuffle of
partial sums, a round of ``STEP`` bits at a time, and only rows of buckets that are still too large go on. A round's
cells (the codes' first bits) are mapped to their leaves, and a row meets the directory by one join on its cell. The
directory is a DataFrame (its length follows total bytes / limit); no row list reaches the driver.

A key's own bits end at 60. Rows of one key that are over the limit together (a hot key may hold a third of all rows)
go on to 60 bits of a hash of the whole row, and copies of one whole row are dealt by copy number, so every shard fits
unless it is a single row larger than the limit (``oversized``).

Defined cases: a null key is hashed as a marker, so rows without a key are rows of one key; null or empty text has 0
bytes; a long text is one row, in a shard of its own if it is over the limit; repeated rows are all kept; extra columns
are carried along, whatever their names (n_bytes, shard, shard_bytes and oversized are replaced); an empty table gives
an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foliate.runtime import broadcast_if_small, materialise

from .copies import dealt, whole_row
from .skew import meet

BITS = 60
STEP = 20  # depths that one round looks at
CELLS = 1 << 20  # rows of a table of leaves or cells up to which it is broadcast (about 40 MB)


def bits(digest: Column) -> Column:
    """The first 60 bits of an MD5 hex digest, as a long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def prefix(code: Column, depth: int) -> Column:
    return F.shiftright(code, BITS - depth)


def leaves(sized: DataFrame, limit: int, group: list[str]) -> list[tuple[int, DataFrame, int, DataFrame | None]]:
    """sized: group..., code, n -> rounds of (bits, cells, all bits, rest): group..., cell -> depth, prefix, bytes, rows.

    A round's cells are the codes' first ``bits`` bits, and ``rest`` those cells (of all bits of the round) whose bucket still
    doesn't fit (none in the last round). A cell's leaf is the smallest depth at which its bucket fits ``limit``, so only
    oversized buckets have split; what doesn't fit at all 60 bits comes out at depth 60 and is over the limit.
    """
    rounds, going, low = [], sized, 0
    while True:
        high = min(low + STEP, BITS)
        cells = materialise(going.groupBy(*group, prefix(F.col("code"), high).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
        levels = cells.select(*group, "n", "cell", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = materialise(levels.groupBy(*group, "depth", "prefix").agg(F.sum("n").alias("bytes")))
        # a leaf fits and its parent doesn't (the root of the first round has none)
        fits = sums.filter((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        over = sums.filter(F.col("bytes") > limit).select(*group, (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above_it"))
        leaf = fits.withColumn("above_it", F.expr("shiftright(prefix, 1)")).join(over, [*group, "depth", "above_it"], "left_semi").drop("above_it")
        leaf = materialise(leaf.unionByName(fits.filter("depth = 0")) if low == 0 else leaf)
        # cells are cut to the bits of the deepest leaf: hashed keys spread evenly, so there are few times as many as leaves
        deepest = leaf.agg(F.coalesce(F.max("depth"), F.lit(low))).first()[0]
        found = levels.drop("n").join(broadcast_if_small(leaf, CELLS), [*group, "depth", "prefix"])
        found = found.groupBy(*group, F.shiftright("cell", high - deepest).alias("cell"), "depth", "prefix", "bytes").agg(F.sum("rows").alias("rows"))
        found = materialise(found)
        large = sums.filter((F.col("depth") == high) & (F.col("bytes") > limit)).select(*group, F.col("prefix").alias("cell"))
        if high == BITS or large.isEmpty():
            return [*rounds, (deepest, found, high, None)]
        rest = materialise(cells.join(large, [*group, "cell"], "left_semi").select(*group, "cell", "rows"))
        rounds.append((deepest, found, high, rest))
        going = meet(going.withColumn("cell", prefix(F.col("code"), high)), rest, [*group, "cell"], "rows", CELLS).drop("cell")
        low = high


def place(rows: DataFrame, rounds: list, group: list[str]) -> DataFrame:
    """Adds depth, prefix and bytes of the leaf of ``code``: one join on a row's cell per round."""
    out = []
    for deepest, found, high, rest in rounds:
        out.append(meet(rows.withColumn("cell", prefix(F.col("code"), deepest)), found, [*group, "cell"], "rows", CELLS).drop("cell"))
        if rest is not None:
            rows = meet(rows.withColumn("cell", prefix(F.col("code"), high)), rest, [*group, "cell"], "rows", CELLS).drop("cell")
    return reduce(DataFrame.unionByName, out)


def label() -> Column:
    bits_ = F.expr("substring(lpad(bin(prefix), 60, '0'), 61 - depth, depth)")
    return F.concat(F.col("depth").cast("string"), F.lit("-"), bits_)


def assign_shards(docs: DataFrame, key_cols: list[str], limit: int, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, shard (label), shard_bytes and oversized."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no name clashes with those used here
    at = dict(zip(docs.columns, plain.columns))
    key = F.concat_ws("\n", *[F.coalesce(F.col(at[k]).cast("string"), F.lit("\x00")) for k in key_cols])
    sized = plain.withColumns({"code": bits(F.md5(key)), "n": F.coalesce(F.octet_length(at[text_col]), F.lit(0)).cast("long")})
    rounds = leaves(materialise(sized.select("code", "n")), limit, [])
    placed = place(sized, rounds, []).withColumn("shard", label())
    fine = placed.filter(F.col("bytes") <= limit)
    out = [*plain.columns, "n", "shard", "bytes"]
    parts = [fine.select(*out)]
    if not rounds[-1][1].filter(F.col("bytes") > limit).isEmpty():
        # rows of one key: split on bits of the whole row
        whole = whole_row(plain, 1)
        over = placed.filter(F.col("bytes") > limit).drop("code", "depth", "prefix", "bytes").withColumnRenamed("shard", "above")
        over = over.withColumns({"code": F.shiftrightunsigned(whole, 64 - BITS), "whole": whole, "check": whole_row(plain, 2)})
        second = leaves(materialise(over.select("above", "code", "n")), limit, ["above"])
        again = place(over, second, ["above"]).withColumn("shard", F.concat_ws("+", "above", label()))
        parts.append(again.filter(F.col("bytes") <= limit).select(*out))
        # copies of one whole row: counted, then dealt out by copy number
        same = again.filter(F.col("bytes") > limit).groupBy("whole", "check").agg(
            F.first(F.struct(*plain.columns, "n", "shard")).alias("row"), F.count("*").alias("copies")
        )
        same = same.select("whole", "check", "row.*", "copies", F.col("copies").alias("all"))
        same = dealt(same, "whole", "copies", "copy")
        per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n"), F.lit(1)))).cast("long")
        same = same.withColumn("per", per).withColumn("first", F.expr("copy div per"))
        same = same.withColumn("bytes", F.least("per", F.col("all") - F.col("first") * F.col("per")) * F.col("n"))
        parts.append(same.withColumn("shard", F.concat_ws("+", "shard", F.col("whole").cast("string"), F.col("first").cast("string"))).select(*out))
    done = reduce(DataFrame.unionByName, parts)
    added = {"n_bytes": F.col("n"), "shard": F.col("shard"), "shard_bytes": F.col("bytes"), "oversized": F.col("bytes") > limit}
    kept = [F.col(c).alias(name) for name, c in at.items() if name.lower() not in added]
    return done.select(*kept, *[v.alias(k) for k, v in added.items()])


def write_shards(docs: DataFrame, path: str, key_cols: list[str], limit: int, text_col: str = "text") -> None:
    """Writes ``docs`` as one folder of Parquet per shard, without the sizes."""
    shards = assign_shards(docs, key_cols, limit, text_col).drop("n_bytes", "shard_bytes", "oversized")
    shards.repartition("shard").write.partitionBy("shard").parquet(path)
