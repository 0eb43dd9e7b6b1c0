"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents link if the Jaccard similarity of their sets of word n-grams is at least ``percent`` / 100. All steps are
exact; sets hold 64-bit hashes of n-grams.

1. Documents of equal sets (128-bit signature) are one class; only representatives go on.
2. Sure links: each representative is tested against the smallest id among those with which it shares at least two of
   four minimum hashes. Their components make most pairs inside groups of near copies superfluous later.
3. Columns of the product: in any fixed order of n-grams, documents that link share one among the first
   n - ceil(percent n) + 1 of each. The order puts frequent n-grams last (counted over all documents).
4. Overlap counts over these columns are accumulated for pairs of different components, and a pair is discarded if its
   count plus what its sizes leave beyond the columns can't reach the needed overlap. Columns of up to HOT documents
   are multiplied by an equi-join; longer columns in blocks of at most BLOCK x BLOCK documents, which hold one row per
   document and emit surviving pairs only. Where most pairs of a block survive (copies just below the threshold), the
   blocks' whole sets are multiplied, and one link per document leaves.
5. Survivors are tested on their whole sets; components of all links are merged.

Defined cases: null or white-space text has an empty set and links with nothing; fewer than ``words`` words make one
n-gram; a null id is linked with nothing and has a null component; rows that repeat an id are alike, and where
their texts differ each text is a node of its own and an id's texts are linked to each other; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foliate.runtime import broadcast_if_small, discard, materialise

from .components import components
from .skew import meet

KEYS = 4
MIX = np.uint64([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93])
FREQUENT, FREQUENT_KEPT = 64, 200_000  # n-grams that go last in the order: 1.6 MB at most
HOT, BLOCK, BLOCK_CELLS, COLUMNS = 64, 2048, 2 << 20, 4096
DENSE = 4  # surviving pairs per document from which a unit's whole sets are multiplied instead
HOT_PAIRS, SALTS = 1000, 64  # a document that more than one in HOT_PAIRS of all pairs point to is sent to SALTS tasks
IDS = 1_000_000  # ids are broadcast up to this count (8 MB)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of ``text``: ASCII lower case, split on ASCII white space."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, found)), np.uint64)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * MIX[0] + h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(32)
    out *= MIX[1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def head(n: int, percent: int) -> int:
    """How many n-grams of n a document contributes as columns."""
    return n - -(-percent * n // 100) + 1 if n else 0


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def sets(docs: DataFrame, words: int, percent: int, what: str, frequent=None) -> DataFrame:
    """id, n, sig, keys and, as ``grams``, the ``head`` columns (frequent ones last) or the whole ``set``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value if frequent is not None else None
        for batch in stream:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, sig, keys, grams = [], [], [], []
                for value in part.column(1):
                    x = shingles(value.as_py() or "", words)
                    n.append(len(x))
                    sig.append(xxhash.xxh3_128_digest(x.tobytes()))
                    if what == "head" and len(x):
                        mixed = x[None] * MIX[:, None]
                        mixed ^= mixed >> np.uint64(32)
                        keys.append((mixed * MIX[::-1, None]).min(1))
                        if last is not None and len(last):
                            place = np.minimum(np.searchsorted(last, x), len(last) - 1)
                            often = last[place] == x
                            x = np.concatenate([x[~often], x[often]])
                        x = x[: head(len(x), percent)]
                    else:
                        keys.append(np.empty(0, np.uint64))
                    grams.append(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists(keys), lists(grams)], ["id", "n", "sig", "keys", "grams"]
                )

    return docs.mapInArrow(run, "id long, n long, sig binary, keys array<long>, grams array<long>")


def needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap of sets of sizes a and b that makes a link: percent (a + b) / (100 + percent), rounded up."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(float(100 + percent)) - 1e-9)


def whole_sets(ids: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """id, n, grams (whole sets) of a materialised list of representatives."""
    asked = broadcast_if_small(ids, IDS)
    own = reps.join(asked, "id", "left_semi").select("id", "sig")
    whole = sets(docs.join(asked, "id", "left_semi"), words, percent, "set")
    return materialise(whole.join(own, ["id", "sig"], "left_semi").dropDuplicates(["id"]).select("id", "n", "grams"))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs u, v (distinct) whose whole sets link."""
    pairs = materialise(pairs)
    ids = materialise(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    whole = whole_sets(ids, docs, reps, words, percent)
    one = whole.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("grams").alias("g_u"))
    two = whole.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("grams").alias("g_v"))
    # many pairs may point to one v: its set goes to SALTS tasks, and the pairs by the hash of u
    hot = pairs.groupBy("v").count().filter(F.col("count") * HOT_PAIRS > pairs.count()).select(F.col("v").alias("hot"))
    hot = F.broadcast(hot)  # fewer than HOT_PAIRS ids
    salted = pairs.join(hot, F.col("v") == F.col("hot"), "left").withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))).drop("hot")
    two = two.join(hot, F.col("v") == F.col("hot"), "left").withColumn("salt", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1))))).drop("hot")
    both = salted.join(one, "u").join(two, ["v", "salt"]).withColumn("o", F.size(F.array_intersect("g_u", "g_v")))
    links = materialise(both.filter(F.col("o") * 100 >= percent * (F.col("n_u") + F.col("n_v") - F.col("o"))).select("u", "v"))
    for t in (pairs, ids, whole):
        discard(t)
    return links


def sure_pairs(reps: DataFrame, percent: int) -> DataFrame:
    keyed = reps.select("id", "n", F.posexplode("keys").alias("j", "key"))
    pivots = keyed.groupBy("j", "key").agg(F.min(F.struct("id", "n")).alias("p"), F.max("id").alias("top"), F.count("*").alias("size")).filter("p.id <> top")
    met = meet(keyed, pivots.select("j", "key", F.col("p.id").alias("v"), F.col("p.n").alias("m"), "size"), ["j", "key"], "size")
    met = met.filter((F.col("id") > F.col("v")) & sizes_fit(F.col("n"), F.col("m"), percent))
    return met.groupBy(F.col("id").alias("u"), "v").count().filter("count >= 2").select("u", "v")


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (a * percent <= b * 100) & (b * percent <= a * 100)


def overlaps(sides: list[list[np.ndarray]]) -> np.ndarray:
    """Overlap counts of two blocks of n-gram lists.

    Columns of more than HOT cells are multiplied densely, COLUMNS at a time; the others are added up cell by cell.
    """
    flat = [np.concatenate([*side, np.empty(0, np.int64)]).astype(np.int64) for side in sides]
    rows = [np.repeat(np.arange(len(side)), [len(g) for g in side]) for side in sides]
    grams, n = np.unique(np.concatenate(flat), return_counts=True)
    wide = grams[n > HOT]
    out = np.zeros([len(side) for side in sides], np.float32)
    dense, cells = [], []
    for g, r in zip(flat, rows):
        order = np.argsort(g, kind="stable")
        g, r = g[order], r[order]
        place = np.minimum(np.searchsorted(wide, g), max(len(wide) - 1, 0))
        inside = wide[place] == g if len(wide) else np.zeros(len(g), bool)
        dense.append((place[inside], r[inside]))  # sorted by column
        cells.append((g[~inside], r[~inside]))
    for at in range(0, len(wide), COLUMNS):
        slices = []
        for side, (place, r) in zip(sides, dense):
            low, high = np.searchsorted(place, [at, at + COLUMNS])
            matrix = np.zeros((len(side), min(COLUMNS, len(wide) - at)), np.float32)
            matrix[r[low:high], place[low:high] - at] = 1
            slices.append(matrix)
        out += slices[0] @ slices[1].T
    (g1, r1), (g2, r2) = cells
    low, high = np.searchsorted(g2, g1, "left"), np.searchsorted(g2, g1, "right")
    for at in range(0, len(g1), 1 << 16):  # every cell of one side with its column's cells of the other
        n = (high - low)[at : at + (1 << 16)]
        start = np.repeat(low[at : at + (1 << 16)] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        np.add.at(out, (np.repeat(r1[at : at + (1 << 16)], n), r2[start + np.arange(len(start))]), 1)
    return out


def two_blocks(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return group[group.own == group.low.iat[0]], group[group.own == group.high.iat[0]]


def may_link(first: pd.DataFrame, second: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both sides, and which pairs differ in component and have sizes that allow a link."""
    a, b = first.n.to_numpy()[:, None], second.n.to_numpy()[None]
    fit = first.component.to_numpy()[:, None] != second.component.to_numpy()[None]
    return a, b, fit & (a * percent <= b * 100) & (b * percent <= a * 100)


def block_pairs(units: DataFrame, percent: int) -> DataFrame:
    """Multiplies one block of documents with another (or itself); emits the pairs that survive the size bounds.

    A pair that meets in several hot columns is emitted by the unit of its first one only. A unit where more pairs
    survive than it has documents, several times over, emits itself instead (u and v null): its whole sets are multiplied.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        unit = {c: group[c].iat[0] for c in ("gram", "low", "high")}
        first, second = two_blocks(group)
        if not len(first) or not len(second):
            return pd.DataFrame({c: [] for c in ("u", "v", *unit)}, dtype="int64")
        counts = overlaps([list(first.grams), list(second.grams)])
        a, b, fit = may_link(first, second, percent)
        rest = [s.n.to_numpy() - s.columns_.to_numpy() for s in (first, second)]
        fit &= counts + np.maximum(rest[0][:, None], rest[1][None]) >= percent * (a + b) / (100 + percent) - 1e-3
        r, c = np.nonzero(fit)
        hot = np.unique(np.concatenate([*first.hot, *second.hot]))
        earlier = hot[hot < unit["gram"]]
        if len(r) and len(earlier):  # the pairs that share no earlier hot column
            sides = []
            for side in (first, second):
                cells, row = np.concatenate(side.hot.to_numpy()), np.repeat(np.arange(len(side)), [len(g) for g in side.hot])
                matrix = np.zeros((len(side), len(earlier)), bool)
                matrix[row[cells < unit["gram"]], np.searchsorted(earlier, cells[cells < unit["gram"]])] = True
                sides.append(np.packbits(matrix, axis=1))
            new = np.concatenate([~(sides[0][r[k : k + 65536]] & sides[1][c[k : k + 65536]]).any(1) for k in range(0, len(r), 65536)])
            r, c = r[new], c[new]
        if len(r) > DENSE * len(group):
            return pd.DataFrame({"u": pd.array([None], "Int64"), "v": pd.array([None], "Int64"), **{k: [x] for k, x in unit.items()}})
        x, y = first.id.to_numpy()[r], second.id.to_numpy()[c]
        return pd.DataFrame({"u": np.maximum(x, y), "v": np.minimum(x, y), **unit}).drop_duplicates()

    return units.groupBy("gram", "low", "high").applyInPandas(run, "u long, v long, gram long, low int, high int")


def block_links(units: DataFrame, percent: int) -> DataFrame:
    """Multiplies whole sets of two blocks, and emits u, v: each linked document with the smallest it is connected to."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, second = two_blocks(group)
        if not len(first) or not len(second):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        counts = overlaps([list(first.grams), list(second.grams)])
        a, b, fit = may_link(first, second, percent)
        r, c = np.nonzero(fit & (counts * 100 >= percent * (a + b - counts)))
        ids = np.unique(np.concatenate([first.id.to_numpy(), second.id.to_numpy()]))
        x, y = np.searchsorted(ids, first.id.to_numpy()[r]), np.searchsorted(ids, second.id.to_numpy()[c])
        label = np.arange(len(ids))
        while len(x):
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]})

    return units.groupBy("gram", "low", "high").applyInPandas(run, "u long, v long")


def candidate_pairs(columns: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """columns: id, n, component, grams -> pairs u > v of different components that may link, and dense units.

    A pair that shares a hot column is counted, over all columns, in a unit of blocks; any other pair shares cold columns
    only, and the join counts all of them.
    """
    cells = columns.select("id", "n", "component", F.explode("grams").alias("gram"))
    live = cells.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("size"), F.min("component").alias("a"), F.max("component").alias("b"))
    live = materialise(live.filter("a <> b").select("gram", "df", "size", F.col("df").alias("rows")))
    cells = materialise(meet(cells, live, ["gram"], "rows"))
    cold = cells.filter(F.col("df") <= HOT)
    one = cold.select("gram", F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("component").alias("c_u"))
    two = cold.select("gram", F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("component").alias("c_v"))
    met = one.join(two, "gram").filter("u > v and c_u <> c_v").filter(sizes_fit(F.col("n_u"), F.col("n_v"), percent))
    met = met.groupBy("u", "v", "n_u", "n_v").agg(F.count("*").alias("c"))
    beyond = F.greatest(*[F.expr(f"(({percent} * {n} + 99) div 100) - 1") for n in ("n_u", "n_v")])  # sizes less columns
    pairs = met.filter(F.col("c") + beyond >= needed(F.col("n_u"), F.col("n_v"), percent)).select("u", "v")
    # hot columns: their documents in blocks (by count and by total size), every two blocks of a column a unit
    # hot columns of the same documents (as of long copies) are one: the first stands for all
    alike = cells.filter(F.col("df") > HOT).groupBy("gram", "df").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    first = alike.groupBy("df", "x", "y").agg(F.min("gram").alias("column"))
    column = F.when(F.col("column").isNotNull(), F.struct("gram", "df", "size"))
    own = broadcast_if_small(materialise(first.select(F.col("column").alias("gram"), "column")), IDS)
    warm = cells.join(own, "gram", "left").groupBy("id", "n", "component").agg(F.collect_list(column).alias("cells"), F.collect_list("gram").alias("grams"))
    rows = warm.filter(F.size("cells") > 0).withColumn("hot", F.transform("cells", lambda x: x["gram"]))
    rows = rows.withColumn("columns_", F.expr(f"n - (({percent} * n + 99) div 100) + 1"))
    blocks = F.greatest(F.ceil(F.col("cell.df") / F.lit(BLOCK)), F.ceil(F.col("cell.size") / F.lit(BLOCK_CELLS))).cast("int")
    units = rows.withColumn("cell", F.explode("cells")).withColumn("blocks", blocks)
    units = units.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(
        F.col("cell.gram").alias("gram"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "id", "n", "component", "columns_", "hot", "grams",
    )
    found = materialise(block_pairs(units, percent))
    dense = broadcast_if_small(materialise(found.filter("u is null").select("gram", "low", "high")), IDS)
    dense = units.join(dense, ["gram", "low", "high"], "left_semi").select("gram", "low", "high", "own", "id", "n", "component")
    return pairs.unionByName(found.filter("u is not null").select("u", "v")).distinct(), dense


def dense_links(dense: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Links inside dense units, from whole sets."""
    dense = materialise(dense)
    if dense.isEmpty():
        return dense.select(F.col("id").alias("u"), F.col("id").alias("v"))
    whole = whole_sets(materialise(dense.select("id").distinct()), docs, reps, words, percent)
    return materialise(block_links(dense.join(whole.select("id", "grams"), "id"), percent))


def of_repeated_ids(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """id, component_id, where ids repeat with different texts: rows are the nodes, and the rows of one id are linked."""
    rows = materialise(texts.filter("id is not null").withColumn("node", F.monotonically_increasing_id()))
    groups = materialise(jaccard_components(rows.select("node", "text"), "node", "text", words, percent).filter("n_shingles > 0"))
    own = materialise(rows.select("id", "node").join(groups, "node").select("id", F.col("component_id").alias("part")).distinct())
    least = own.groupBy("id").agg(F.min("part").alias("v"))
    whole = materialise(components(own.join(least, "id").select(F.col("part").alias("u"), "v")))
    named = own.join(whole, F.col("part") == F.col("node"), "left").select("id", F.coalesce("component", "part").alias("whole")).distinct()
    named = materialise(named)
    return named.join(named.groupBy("whole").agg(F.min("id").alias("component_id")), "whole").select("id", "component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable by links, itself included; one row per input row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = materialise(sets(texts, words, percent, "head"))
    often = full.filter("id is not null").select(F.explode("grams").alias("gram")).groupBy("gram").count().filter(F.col("count") > FREQUENT)
    often = often.orderBy(F.desc("count"), "gram").limit(FREQUENT_KEPT).select("gram").collect()  # an order, not a filter
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)))
    base = materialise(full.drop("grams"))
    discard(full)
    known = base.filter("id is not null and n > 0")
    if not known.groupBy("id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).filter("a <> b").isEmpty():
        return named(base, of_repeated_ids(texts, words, percent), id_col)
    unique = materialise(known.groupBy("id").agg(F.min(F.struct("sig", "n", "keys")).alias("x")).select("id", "x.*"))
    classes = materialise(unique.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("rows")))
    reps = materialise(unique.join(classes, [unique.sig == classes.sig, unique.id == classes.rep], "left_semi"))
    real = texts.filter("id is not null")

    links = verified(sure_pairs(reps, percent), real, reps, words, percent)
    first = materialise(components(links))

    columns = sets(real, words, percent, "head", frequent).select("id", "sig", "n", "grams")
    columns = columns.join(reps.select("id", "sig"), ["id", "sig"], "left_semi").join(first, F.col("id") == F.col("node"), "left")
    columns = materialise(columns.withColumn("component", F.coalesce("component", "id")).select("id", "n", "component", "grams"))
    pairs, dense = candidate_pairs(columns, percent)
    more = verified(pairs, real, reps, words, percent).unionByName(dense_links(dense, real, reps, words, percent))
    discard(columns)

    stars = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = materialise(components(more.unionByName(stars)))
    # a class's smallest id is its representative, so a component's smallest id is a representative's
    known = classes.join(final, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("component_id"), "rows")
    return named(base, meet(unique.select("id", "sig"), materialise(known), ["sig"], "rows").drop("sig"), id_col)


def named(base: DataFrame, member: DataFrame, id_col: str) -> DataFrame:
    """The result's rows. Null ids, which may be many, are no join key."""
    out = base.filter("id is not null").join(member, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionByName(base.filter("id is null").select("id", "n", F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
