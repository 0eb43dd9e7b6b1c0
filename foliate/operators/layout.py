"""Layout: word merge, label/value pairing, wrapped lines, reading order, document text.

The three greedy merges depend on the order of their own results and run page by page over Arrow batches (a page's blocks
are bounded by what fits on a page); everything else is native.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window
from pyspark.sql.pandas.types import to_arrow_schema

PAGE = ["doc_id", "page_number"]
BATCH_ROWS = 10_000
# Fixed value: what counts as a label before a value.
LABEL_PREFIX = re.compile(r"^\s*(?::?\s*[A-Za-z\s\-]+:\s*)")
MERGED = "doc_id {kind}, page_number int, block_idx int, source string, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def polygon_boxes(words: DataFrame) -> DataFrame:
    """Words with a polygon ``vertices array<struct<x,y>>`` of two corners at least, with their boxes (x0, y0, x1, y1)."""
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    sides = {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
    return words.filter(F.size("vertices") >= 2).withColumns({k: v.cast("double") for k, v in sides.items()})


def by_page(rows: DataFrame, merge: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType) -> DataFrame:
    """Runs ``merge`` on the columns (as lists) of each page's rows in list order; it gives the columns of ``schema``.

    Pages are dealt by their key and streamed in sorted order, so a batch holds many pages and only one page is kept whole.
    """
    names = rows.columns

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        out: dict[str, list] = {f.name: [] for f in schema}

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)
            for values in out.values():
                values.clear()
            return batch

        def close(page: dict[str, list]) -> None:
            for name, values in merge(page).items():
                out[name] += values

        page, key = {n: [] for n in names}, None
        for batch in stream:
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*(columns[names.index(c)] for c in PAGE)))
            start = 0
            for end in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]:
                if end > start:
                    if key != keys[start] and page[names[0]]:
                        close(page)
                        page = {n: [] for n in names}
                    key = keys[start]
                    for name, values in zip(names, columns):
                        page[name] += values[start:end]
                    start = end
            if len(out["text"]) >= BATCH_ROWS:
                yield emit()
        if page[names[0]]:
            close(page)
        yield emit()

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "block_idx").mapInArrow(run, schema)


def assign_lines(centre: list[float], height: list[float]) -> list[list[int]]:
    """Lines of words, taken by y-centre: a word joins the first line whose mean centre is near enough, else opens one.

    Words come in ascending order, so a line that is too far above once is never near again and is looked at no more.
    """
    lines: list[list[int]] = []
    open_: list[list] = []  # sum of centres, of heights, words
    for i in sorted(range(len(centre)), key=centre.__getitem__):
        c = centre[i]
        open_ = [x for x in open_ if abs(c - x[0] / len(x[2])) <= max(6.0, x[1] / len(x[2]) * 0.45)]
        if open_:
            line = open_[0]
        else:
            line = [0.0, 0.0, []]
            open_.append(line)
            lines.append(line[2])
        line[0] += c
        line[1] += height[i]
        line[2].append(i)
    return lines


def merge_page(page: dict[str, list]) -> dict[str, list]:
    """Words of a page in list order -> runs of words."""
    x0, y0, x1, y1, texts, sure = (page[c] for c in ("x0", "y0", "x1", "y1", "text", "confidence"))
    centre = [(a + b) / 2 for a, b in zip(y0, y1)]
    runs = []
    for line in assign_lines(centre, [b - a for a, b in zip(y0, y1)]):
        box = None
        for i in sorted(line, key=lambda i: (x0[i], centre[i])):
            if box is not None and x0[i] - box[2] <= 2.5 * ((y1[i] - y0[i]) + (box[3] - box[1])) / 2:
                box[:] = min(box[0], x0[i]), min(box[1], y0[i]), max(box[2], x1[i]), max(box[3], y1[i])
                inside.append(i)
            else:
                box, inside = [x0[i], y0[i], x1[i], y1[i]], [i]
                runs.append((box, inside))
    rows = [([float(int(v)) for v in box], inside) for box, inside in runs]
    rows.sort(key=lambda r: ((r[0][1] + r[0][3]) / 2, r[0][0]))
    n = len(rows)
    return {
        "doc_id": page["doc_id"][:1] * n, "page_number": page["page_number"][:1] * n, "block_idx": list(range(n)), "source": ["ocr"] * n,
        "text": [" ".join(texts[i] for i in inside) for _, inside in rows], **{c: [box[k] for box, _ in rows] for k, c in enumerate(("x0", "y0", "x1", "y1"))},
        "confidence": [sum(sure[i] for i in inside) / len(inside) for _, inside in rows],
    }


def merge_words(words: DataFrame) -> DataFrame:
    """OCR words with boxes -> horizontal runs, by y-centre and x0. Gaps of up to 2.5 mean heights are bridged."""
    kind = words.schema["doc_id"].dataType.simpleString()
    columns = words.select(*PAGE, "block_idx", "text", "x0", "y0", "x1", "y1", "confidence")
    return by_page(columns, merge_page, T.StructType.fromDDL(MERGED.format(kind=kind)))


def pair_page(x0, y0, x1, y1, texts: list[str], tolerance: float) -> tuple[list[str], np.ndarray]:
    """Texts after pairing, and which blocks are left. Labels act in list order, also those already taken as values."""
    mid = (np.asarray(y0) + np.asarray(y1)) / 2
    x0, x1, texts = np.asarray(x0), np.asarray(x1), list(texts)
    taken = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        label = text.rstrip()
        if label.endswith(":"):
            fits = ~taken & (np.abs(mid - mid[i]) <= tolerance) & (x0 >= x1[i])
            fits[i] = False
            values = np.flatnonzero(fits)
            if len(values):
                values = values[np.argsort(x0[values], kind="stable")]
                texts[i] = " ".join([label, *(texts[j] for j in values)]).strip()
                taken[values] = True
    return texts, ~taken


def pair_labels(blocks: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Attaches to each block that ends with a colon all free blocks to its right on the same row."""

    def pair(page: dict[str, list]) -> dict[str, list]:
        texts, left = pair_page(page["x0"], page["y0"], page["x1"], page["y1"], page["text"], tolerance)
        return {c: list(compress(v, left)) for c, v in (page | {"text": texts}).items()}

    return by_page(blocks, pair, blocks.schema)


def wrap_groups(x0, y0, x1, y1, texts: list[str]) -> np.ndarray:
    """Group of each block in y0, x0 order of blocks: wrapped lines of one paragraph or value share a group."""
    x0, y0, x1, y1 = (np.asarray(v, float) for v in (x0, y0, x1, y1))
    lettered = [any(c.isalpha() for c in t) for t in texts]
    edge = (x0[lettered].min() if any(lettered) else 0.0) + 50.0
    labels = np.sort(y0[x0 < edge])
    cuts = [len(m[0]) if (m := LABEL_PREFIX.match(t)) else 0 for t in texts]
    content = np.array([a + (b - a) * (c / len(t)) if c else a for a, b, c, t in zip(x0, x1, cuts, texts)])
    letters = ["".join(filter(str.isalpha, t)) for t in texts]
    tails = ["".join(filter(str.isalpha, t[c:])) for t, c in zip(texts, cuts)]
    case = np.array([w.isupper() if len(w) >= 3 else -1 for w in letters], int)  # -1: too short to tell
    tail_case = np.array([w.isupper() if len(w) >= 3 else -1 for w in tails], int)
    group = np.full(len(texts), -1)
    last = np.zeros(0, int)  # last block of each group
    for i in np.lexsort((x0, y0)):
        gap = y0[i] - y1[last]
        fits = (gap >= -5) & (gap < 25) & ((np.abs(x0[i] - content[last]) < 20) | (np.abs(x0[i] - x0[last]) < 20)) & (x0[last] >= edge)
        fits &= (tail_case[last] < 0) | (case[i] < 0) | (tail_case[last] == case[i])
        # a label that starts after the previous line and 8 px or more before this one
        fits &= np.searchsorted(labels, y0[i] - 8, "right") <= np.searchsorted(labels, y0[last], "right")
        if x0[i] < edge or texts[i].lstrip().startswith(":"):
            fits[:] = False
        found = np.flatnonzero(fits)
        if len(found):
            g = found[np.argmin(gap[found])]
            last[g] = i
        else:
            g = len(last)
            last = np.append(last, i)
        group[i] = g
    return group


def merge_wrapped(blocks: DataFrame) -> DataFrame:
    """Merges wrapped lines: joined text, mean confidence, box of the first; differing sources become ``mixed``."""

    def number(page: dict[str, list]) -> dict[str, list]:
        return page | {"group": wrap_groups(page["x0"], page["y0"], page["x1"], page["y1"], page["text"]).tolist()}

    return reduce_groups(by_page(blocks, number, T.StructType([*blocks.schema.fields, T.StructField("group", T.IntegerType())])))


def reduce_groups(numbered: DataFrame) -> DataFrame:
    """Blocks with ``group`` -> one block per group; block_idx becomes the group's number."""
    first = F.min_by(F.struct("x0", "y0", "x1", "y1"), F.struct("y0", "x0", "block_idx")).alias("first")
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "block_idx", "text", "confidence")))
    merged = numbered.groupBy(*PAGE, "group").agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("text"),
        F.when(F.count_distinct("source") == 1, F.min("source")).otherwise("mixed").alias("source"),
        # summed in reading order, so that the mean does not depend on how rows arrive
        (F.aggregate(F.transform(ordered, lambda b: b["confidence"]), F.lit(0.0), lambda a, c: a + c) / F.count("*")).alias("confidence"),
        first,
    )
    return merged.select(*PAGE, F.col("group").alias("block_idx"), "source", "text", "first.*", "confidence")


def reading_order(blocks: DataFrame, band_px: float = 5.0) -> DataFrame:
    """Adds ``band`` and ``position``: bands are anchored at their first block's y0; inside a band by x0."""
    in_y = F.array_sort(F.collect_set(F.col("y0")))
    page = blocks.groupBy(*PAGE).agg(in_y.alias("heights"))
    none = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("anchors"))

    def step(acc, y):  # copies the anchors so far where a band opens only
        opens = acc["anchor"].isNull() | (y - acc["anchor"] > band_px)
        return F.when(opens, F.struct(y.alias("anchor"), F.concat(acc["anchors"], F.array(y)).alias("anchors"))).otherwise(acc)

    bands = page.select(*PAGE, F.posexplode(F.aggregate("heights", none, step, lambda acc: acc["anchors"])).alias("band", "anchor"))
    # a block's band is that of the last anchor at its height or above: anchors join the blocks' order as rows of their own
    marks = bands.select(*PAGE, F.col("anchor").alias("y0"), F.col("band").alias("__band"))
    merged = blocks.unionByName(marks, allowMissingColumns=True)
    above = Window.partitionBy(*PAGE).orderBy("y0", F.col("__band").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = merged.withColumn("band", F.max("__band").over(above)).filter("__band is null").drop("__band")
    inside = Window.partitionBy(*PAGE).orderBy("band", "x0", "y0", "block_idx")
    return placed.withColumn("position", F.row_number().over(inside) - 1)


def document_text(ordered: DataFrame) -> DataFrame:
    """doc_id, document_text: blocks by position, one per line, under a header per page."""
    page = ordered.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    page = page.select(*PAGE, F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), body).alias("body"))
    whole = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "body"))).alias("pages"))
    return whole.select("doc_id", F.array_join(F.transform("pages", lambda p: p["body"]), "\n\n").alias("document_text"))
