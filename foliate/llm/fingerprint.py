"""Document fingerprints by closed syncmers (native: SQL functions only).

The units are words: runs of at most LONG characters that are neither ASCII white space nor of a script written without
spaces. Characters of such scripts and of longer runs are units of their own. So a passage is cut alike in any text,
whatever surrounds it. A k-mer is K units in a row. It is chosen if its minimal inner substring, one word by its hash,
lies at an edge: first or last. The choice depends on the k-mer alone, so equal passages choose the same anchors wherever
they stand. A fingerprint is all anchors of the text, by position, so it grows with the text; a text of fewer than FEW
units also has the anchors of its characters. Two texts that both have those are compared by them, all others by words,
so both sides are always cut alike. A text of fewer than K units, or without a chosen k-mer, has one anchor, the whole
text. The SKETCH smallest distinct hashes go along as a short form that nothing is computed from.

Two fingerprints are matched by hash, the first positions of equal anchors with each other. Likeness is the share of the
common anchors among all distinct ones (Jaccard, 0 to 1); alignment is the same share for those common anchors that are
moved by the same distance, the most frequent one.

Defined cases: null text is empty; two empty fingerprints do not occur (an empty text has an anchor of its own); a text of
any length is cut whole; rows that repeat an id are ordered by text, and equal rows follow each other; a null id comes
first; extra columns are ignored, whatever their names; an empty table gives an empty table. All rows of one id are in
one range (ids are distinct as a rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from foliate.functions.columns import bind
from foliate.runtime import broadcast_if_small, materialise

K = 4
FEW = 24  # texts of fewer units have anchors of characters too
LONG = 32
SKETCH = 64
# South-East Asian scripts, and Han with the scripts used beside it (Hangul has spaces)
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
LETTER = rf"[^{UNSPACED}\x20\x09-\x0D]"
UNIT = rf"(?<!{LETTER}){LETTER}{{1,{LONG}}}+(?!{LETTER})|[^\x20\x09-\x0D]"
RANGE_ROWS, MAX_RANGES, HEADS = 2048, 4096, 1_000_000


def anchors(text: Column) -> Column:
    """array<struct<at, hash>>: the closed syncmers of a text by position (in units)."""
    return syncmers(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), text)


def fingerprint(text: Column) -> Column:
    """struct<words, chars>: the anchors of units and, for fewer than FEW of them, of characters (else null)."""

    def both(units: Column) -> Column:
        chars = F.when(F.size(units) < FEW, syncmers(F.split(text, ""), text))
        return F.struct(syncmers(units, text).alias("words"), chars.alias("chars"))

    return bind(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), both)


def syncmers(units: Column, text: Column) -> Column:
    def chosen(h: Column) -> Column:
        def at_edge(i: Column) -> Column:
            edge = F.least(F.get(h, i), F.get(h, i + (K - 1)))
            return edge <= F.least(*[F.get(h, i + j) for j in range(1, K - 1)])

        places = F.filter(F.sequence(F.lit(0), F.size(h) - K), at_edge)
        made = F.transform(
            places, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(h, i + j) for j in range(K)]).alias("hash"))
        )
        one = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(text).alias("hash")))
        return bind(F.when(F.size(h) >= K, made), lambda x: F.when(F.size(x) > 0, x).otherwise(one))

    return bind(F.transform(units, lambda w: F.xxhash64(w)), chosen)


def own_anchors(a: Column) -> Column:
    """The anchors of a fingerprint: of characters where it has those."""
    return F.coalesce(a["chars"], a["words"])


def as_text(a: Column) -> Column:
    """The anchors in order: the low 32 bits of their hashes in hexadecimal (positions follow from the text's units)."""
    return F.array_join(F.transform(own_anchors(a), lambda x: F.hex(x["hash"].bitwiseAND(0xFFFFFFFF))), " ")


def sketch(a: Column) -> Column:
    """The SKETCH smallest distinct hashes of a fingerprint, ascending: a short form that nothing is computed from."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(own_anchors(a), lambda x: x["hash"]))), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """struct<near, aligned> of two fingerprints: one sort brings equal anchors of both together."""
    short = a["chars"].isNotNull() & b["chars"].isNotNull()
    a, b = (F.when(short, x["chars"]).otherwise(x["words"]) for x in (a, b))

    def side(x: Column, n: int) -> Column:
        return F.transform(x, lambda v: F.struct(v["hash"].alias("hash"), F.lit(n).alias("side"), v["at"].alias("at")))

    def first(s: Column) -> Column:
        def new(v: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            return (i == 0) | (before["hash"] != v["hash"]) | (before["side"] != v["side"])

        return F.filter(s, new)

    def moves(s: Column) -> Column:
        def move(v: Column, i: Column) -> Column:
            after = F.get(s, i + 1)
            return F.when(after["hash"] == v["hash"], after["at"] - v["at"])

        return F.sort_array(F.filter(F.transform(s, move), lambda d: d.isNotNull()))

    def longest(sorted_: Column) -> Column:
        def step(acc: Column, d: Column) -> Column:
            run = F.when(acc["last"] == d, acc["run"] + 1).otherwise(1)
            return F.struct(d.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

        none = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
        return F.aggregate(sorted_, none, step, lambda acc: acc["most"])

    def shares(s: Column) -> Column:
        return bind(moves(s), lambda m: F.struct((F.size(m) / (F.size(s) - F.size(m))).alias("near"), (longest(m) / (F.size(s) - F.size(m))).alias("aligned")))

    return bind(bind(F.sort_array(F.concat(side(a, 0), side(b, 1))), first), shares)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, looked up in two steps of about the square root each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    upto = F.size(F.filter(coarse, lambda b: b <= key))
    part = F.slice(every, F.greatest(upto - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(upto == 0, 0).otherwise((upto - 1) * step + F.size(F.filter(part, lambda b: b <= key)))


def with_next(rows: DataFrame, id_col: str, tie: str, derive: dict[str, Column]) -> DataFrame:
    """Adds next_<tie> and, of the columns that ``derive`` computes, next_<c>: from the next row in ascending order, for the
    last row from the first.

    Rows are dealt to ranges of ids (quantiles, MAX_RANGES at most, cut into even steps so that about RANGE_ROWS rows fall
    into each), ``lead`` looks inside a range, and a range ends with a copy of the first row of the next one, of which
    there is one per range. So texts are shuffled once, and what is derived from a row is computed once.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keyed = rows.withColumn("__key", key)
    ranges = max(1, rows.count() // RANGE_ROWS)
    n = min(MAX_RANGES, ranges)
    bounds = keyed.approxQuantile("__key", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(b) for b in bounds})
    steps = -(-ranges // MAX_RANGES)
    bucket = bucket_of(F.col("__key"), bounds).cast("long")
    if steps > 1:
        edges = F.array(*[F.lit(b) for b in [-(1 << 63), *bounds, (1 << 63) - 1]])
        low, high = F.get(edges, bucket.cast("int")).cast("double"), F.get(edges, bucket.cast("int") + 1).cast("double")
        step = F.floor((F.col("__key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * steps)
        bucket = bucket * steps + F.greatest(F.lit(0), F.least(step, F.lit(steps - 1)))
    keyed = keyed.withColumn("__bucket", bucket).withColumn("__copy", F.lit(False))
    heads = materialise(keyed.groupBy("__bucket").agg(F.min("__key").alias("__key")))
    heads = keyed.join(broadcast_if_small(heads, HEADS), ["__bucket", "__key"]).groupBy("__bucket", "__key").agg(F.min(tie).alias(tie))
    heads = materialise(heads)
    order = Window.orderBy("__bucket")  # two numbers per range
    ring = heads.select(F.col("__bucket").alias("__at"), F.lag("__bucket").over(order).alias("__of"))
    last = F.lit(heads.agg(F.max("__bucket")).first()[0])
    ring = heads.join(ring, F.col("__bucket") == F.col("__at")).select(F.col(tie), F.coalesce("__of", last).alias("__bucket"))
    copies = ring.withColumns({"__key": F.lit((1 << 63) - 1), "__copy": F.lit(True)})

    inside = Window.partitionBy("__bucket").orderBy("__copy", "__key", tie)
    led = keyed.unionByName(copies, allowMissingColumns=True).withColumn(f"next_{tie}", F.lead(tie).over(inside))
    led = led.withColumns(derive)
    led = led.withColumns({f"next_{c}": F.lead(c).over(inside) for c in derive})
    return led.filter("not __copy").drop("__bucket", "__key", "__copy")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose second half gives way to the next document's first code points."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = with_next(rows, "id", "text", {"mine": fingerprint(F.col("text"))})
    half = F.expr("cast(length(text) div 2 as int)")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))"), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "mine", "next_mine", fingerprint(F.col("edited")).alias("other")
    )
    rows = rows.withColumns({"edited": likeness(F.col("mine"), F.col("other")), "next": likeness(F.col("mine"), F.col("next_mine"))})
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        as_text(F.col("mine")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        sketch(F.col("mine")).alias("sketch"), sketch(F.col("other")).alias("edited_sketch"),
        F.col("edited.near").alias("near_edited"), F.col("next.near").alias("near_next"),
        F.col("edited.aligned").alias("aligned_edited"), F.col("next.aligned").alias("aligned_next"),
    )
