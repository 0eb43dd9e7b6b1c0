"""Pages of PDFs and images from what a provider read of them: text tuples, image regions, recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from foliate.functions.text import strip
from foliate.operators.layout import PAGE, merge_wrapped, pair_labels, polygon_boxes
from foliate.sources.documents import MIN_CHARS, to_page

BOX = ["x0", "y0", "x1", "y1"]
BLOCK = [*PAGE, "block_idx", "source", "text", *BOX, "confidence"]


def embedded_blocks(tuples: DataFrame) -> DataFrame:
    """doc_id, page_number, idx, fields, kind, text, box -> embedded blocks, numbered as in the page's list.

    A tuple of seven fields or more of kind 0 (text) is admitted, and so is any of five or more; empty texts go.
    """
    admitted = ((F.col("fields") >= 7) & (F.col("kind") == 0)) | (F.col("fields") >= 5)
    rows = tuples.filter(admitted).withColumn("text", strip(F.col("text"))).filter("text <> ''")
    rows = rows.withColumns({"block_idx": F.col("idx"), "source": F.lit("embedded"), "confidence": F.lit(1.0)})
    return rows.select(*BLOCK)


def real_regions(regions: DataFrame) -> DataFrame:
    """Image regions that have a box with an area."""
    return regions.filter("x0 is not null and y0 is not null and x1 > x0 and y1 > y0")


def regions_to_read(regions: DataFrame, embedded: DataFrame, force: bool = False) -> DataFrame:
    """The regions of pages with little embedded text (also of pages without any), or all of them."""
    if force:
        return real_regions(regions)
    full = embedded.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("chars")).filter(F.col("chars") >= MIN_CHARS)
    return real_regions(regions).join(full, PAGE, "left_anti")


def region_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words recognised in regions (doc_id, page_number, region, word_idx, text, vertices, confidence) as blocks of the page."""
    place = regions.select(*PAGE, "region", F.col("x0").alias("left"), F.col("y0").alias("top"))
    found = polygon_boxes(words).join(place, [*PAGE, "region"])
    across, down = ({c: to_page(F.col(o), F.col(c)) for c in cs} for o, cs in (("left", ("x0", "x1")), ("top", ("y0", "y1"))))
    return found.withColumns({**across, **down, "text": strip(F.col("text")), "source": F.lit("ocr")}).select(*PAGE, "region", "word_idx", "source", "text", *BOX, "confidence")


def embedded_and_recognised(embedded: DataFrame, recognised: DataFrame) -> DataFrame:
    """Both kinds of blocks of a page in one list, embedded ones first."""
    one = embedded.select(*PAGE, F.struct(F.lit(0).alias("branch"), F.lit(0).alias("region"), F.col("block_idx").alias("at")).alias("place"), "source", "text", *BOX, "confidence")
    two = recognised.select(*PAGE, F.struct(F.lit(1).alias("branch"), F.col("region"), F.col("word_idx").alias("at")).alias("place"), "source", "text", *BOX, "confidence")
    order = Window.partitionBy(*PAGE).orderBy("place")
    return one.unionByName(two).withColumn("block_idx", (F.row_number().over(order) - 1).cast("int")).select(*BLOCK)


def pdf_blocks(tuples: DataFrame, regions: DataFrame, read, force: bool = False) -> DataFrame:
    """A PDF's blocks: embedded text, recognition where there is little of it, labels paired, wrapped lines merged.

    ``read``: regions -> words (a provider call).
    """
    embedded = embedded_blocks(tuples)
    asked = regions_to_read(regions, embedded, force)
    return merge_wrapped(pair_labels(embedded_and_recognised(embedded, region_words(read(asked), asked))))


def image_blocks(words: DataFrame) -> DataFrame:
    """An image's blocks: its recognised words (doc_id, word_idx, text, vertices, confidence), wrapped lines merged."""
    found = polygon_boxes(words.withColumn("page_number", F.lit(1)))
    found = found.withColumns({"block_idx": F.col("word_idx").cast("int"), "source": F.lit("ocr"), "text": strip(F.col("text"))})
    return merge_wrapped(found.select(*BLOCK))
