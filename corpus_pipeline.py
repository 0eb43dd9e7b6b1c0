"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``. No SQL can express the learned and iterative stages, so
``ORACLE_SQL`` is None; tests hold the run against a brute-force version.

The stages' order is given: line dedup comes before the n-gram join, so near copies that share whole lines have lost
those lines by then, and the join sees what is left of them.

Defined cases, of every stage: null or empty text is a document that is kept (without lines, links and tokens); texts of
any length are read whole; rows that tie or repeat are told apart as the operators say, and equal rows are one group of
near copies, of which one row stays; extra columns are carried along up to the last stage, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliate.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from foliate.llm.queries import REPEATS, tokenizer_path
from foliate.runtime import broadcast_if_small, ensure_worker_imports, materialise

IDS = 1_000_000  # ids are broadcast up to this count (8 MB), else joined by shuffle


def named(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator uses: each replaces columns of its results' names, and ``docs`` may have such."""
    return docs.toDF(*[f"c_{c}" for c in docs.columns])


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    ensure_worker_imports(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return back(toxicity.score(named(docs), model, "c_text").filter("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them; documents stay, with the rest of their lines."""
    kept = line_dedup.dedup_lines(named(docs), "c_doc_id", "c_text").withColumn("c_n_chars", F.length("c_text").cast("long"))
    return back(kept, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays, once; documents without links stay.

    Where ids repeat, rows are the nodes: of rows that link, or are equal in their n-grams, the first by id and content
    stays, whatever the other rows of its id hold.
    """
    ensure_worker_imports(spark)
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        groups = ngram_join.jaccard_components(docs.select("doc_id", "text"))
        gone = materialise(groups.filter("component_id <> doc_id").select("doc_id"))
        return docs.join(broadcast_if_small(gone, IDS), "doc_id", "left_anti").select(docs.columns)
    # null ids link with nothing, so they need no node
    rows = materialise(docs.withColumn("__node", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    groups = ngram_join.jaccard_components(rows.select("__node", "text"), id_col="__node")
    groups = materialise(groups.filter("__node is not null and n_shingles > 0").select("__node", "component_id"))
    order = F.struct("doc_id", F.sha2(F.to_json(F.struct(*docs.columns)), 256), "__node")  # equal rows only are left to the node
    met = materialise(rows.select("__node", order.alias("place")).join(groups, "__node"))
    first = met.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = materialise(met.join(first, "component_id").filter("place <> first").select("__node"))
    return rows.join(broadcast_if_small(gone, IDS), "__node", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scarce sources are repeated towards equal weights, ``REPEATS`` times at most; every document occurs."""
    mixed = mixing.mix(named(docs), mixing.repeats_within(REPEATS), "c_doc_id", "c_source", "c_text")
    return back(mixed, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them, of every occurrence."""
    ensure_worker_imports(spark)
    done = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path(), decoded="decoded")
    return done.select("doc_id", "source", "n_tokens", "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
