"""Result store, saved documents and event frames."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliate.config import META_FIELD
from foliate.operators.clean import cleaning_counts


def result_rows(records: DataFrame) -> DataFrame:
    """filename, doc_type, status, extracted map, created_at -> rows of the store; meta members apart; id by content."""
    data = F.map_filter("extracted", lambda k, _: k != META_FIELD)
    meta = F.coalesce(F.element_at("extracted", META_FIELD), F.lit("{}"))
    return records.select(
        F.xxhash64("filename", "created_at").alias("id"), "filename", "doc_type", "status",
        F.to_json(F.coalesce(data, F.create_map().cast("map<string,string>"))).alias("extracted_data"), meta.alias("meta_data"), "created_at",
    )


def save_results(records: DataFrame, path: str) -> None:
    """Appends to the store, one folder per document type (the type is what lookups filter by); data as a variant."""
    rows = result_rows(records)
    rows.withColumns({c: F.try_parse_json(c) for c in ("extracted_data", "meta_data")}).write.mode("append").partitionBy("doc_type").parquet(path)


def try_save(save, *args) -> str | None:
    """Calls a sink whose failure is not fatal: it is logged and returned, and the job goes on."""
    try:
        save(*args)
    except Exception as error:  # whatever the store says
        logging.getLogger(__name__).warning("results were not saved: %s", error)
        return str(error)
    return None


def latest(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    return latest_of(spark.read.parquet(path), n)


def latest_of(results: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` results (the feature is this limit)."""
    return results.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def source_flags(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(
        F.bool_or(F.col("source") == "embedded").alias("has_embedded"), F.bool_or(F.col("source") == "ocr").alias("has_ocr")
    )


def output_files(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number, suffix, block_idx, source, text: which saved file a block goes to.

    PDFs with both embedded and recognised text make two files, whose pages are all kept, also empty ones; others one.
    """
    flags = source_flags(blocks).join(pages.select("doc_id", "document_type").distinct(), "doc_id", "right")
    both = (F.col("document_type") == "pdf") & F.coalesce("has_embedded", F.lit(False)) & F.coalesce("has_ocr", F.lit(False))
    files = flags.select("doc_id", F.explode(F.when(both, F.array(F.lit("embedded"), F.lit("ocr"))).otherwise(F.array(F.lit("merged")))).alias("suffix"))
    shells = files.join(pages.select("doc_id", "page_number"), "doc_id")
    rows = shells.join(blocks.select("doc_id", "page_number", "block_idx", "source", "text"), ["doc_id", "page_number"], "left")
    mine = (F.col("suffix") == "merged") | (F.col("source") == F.col("suffix"))
    kept = rows.withColumn("mine", F.coalesce(mine, F.lit(False)))
    empty = shells.join(kept.filter("mine").select("doc_id", "page_number", "suffix").distinct(), ["doc_id", "page_number", "suffix"], "left_anti")
    return kept.filter("mine").drop("mine").unionByName(empty, allowMissingColumns=True)


def save_documents(files: DataFrame, path: str) -> None:
    """One JSON line per page of a saved file, in folders by suffix."""
    page = files.groupBy("doc_id", "suffix", "page_number").agg(
        F.array_sort(F.collect_list(F.when(F.col("block_idx").isNotNull(), F.struct("block_idx", "source", "text")))).alias("text_sources")
    )
    page.write.mode("overwrite").partitionBy("suffix").json(path)


def cleaned_documents(before: DataFrame, after: DataFrame, cleaning_ms: float | None = None) -> DataFrame:
    """doc_id, pages, cleaning_metadata: cleaned blocks in reading order as nested documents; cleaned pages may be empty."""
    pages = before.select("doc_id", "page_number").distinct()
    block = F.struct(
        "position", "source", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "confidence",
        F.struct(F.array("x0", "y0", "x1", "y1").alias("bbox")).alias("metadata"),
    )
    page = after.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(block)).alias("text_sources"))
    page = pages.join(page, ["doc_id", "page_number"], "left")
    bare = F.transform("text_sources", lambda b: b.dropFields("position"))
    page = page.select("doc_id", F.struct("page_number", F.coalesce(bare, F.array()).alias("text_sources")).alias("page"))
    counts = cleaning_counts(before, after).select(
        "doc_id", F.struct("total_blocks_before", "total_blocks_after", F.lit(cleaning_ms).cast("double").alias("cleaning_duration_ms")).alias("cleaning_metadata")
    )
    return page.groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("pages")).join(counts, "doc_id")


def page_summary(blocks: DataFrame) -> DataFrame:
    kinds = ("embedded", "ocr", "audio", "mixed")
    return blocks.groupBy("doc_id", "page_number").agg(F.count("*").alias("blocks"), *[F.count_if(F.col("source") == k).alias(k) for k in kinds])


def event_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def append_facts(facts: DataFrame, path: str, run: str) -> None:
    """Adds the scored facts of a run. Totals add up over runs; the same run twice counts twice."""
    facts.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clear_facts(spark: SparkSession, path: str, facts_schema) -> None:
    spark.createDataFrame([], facts_schema).write.mode("overwrite").parquet(path)
