"""The extraction job: classify, ask the model, parse, validate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from foliate.operators import extract
from foliate.runtime import materialise
from foliate.sources import providers


def extracted(texts: DataFrame, make: Callable[[], providers.LanguageModel]) -> DataFrame:
    """doc_id, text -> filename, doc_type, status, extracted map, created_at, error, one row per document.

    Types come from keywords, else from the model. A type without a prompt, a failed call and a reply that is no JSON
    object are rows of status ``failed``.
    """
    typed = materialise(providers.classify_documents(texts, "doc_id", make))
    asked = extract.with_prompts(typed)
    replies = providers.ask(asked.filter("prompt is not null").select(F.col("doc_id").alias("key"), "prompt"), make, extract.SYSTEM_PROMPT)
    replies = materialise(replies).withColumnRenamed("key", "doc_id")  # calls are not repeated
    rows = typed.select("doc_id", "doc_type").join(replies, "doc_id", "left")
    done = extract.validate_mixed(rows.withColumn("record", extract.parse_reply(F.col("reply"))))
    empty = F.create_map().cast("map<string,string>")
    return done.select(
        F.col("doc_id").cast("string").alias("filename"), "doc_type", "status", F.coalesce("extracted", empty).alias("extracted"),
        F.current_timestamp().alias("created_at"), F.coalesce("error", F.when(F.col("reply").isNull(), "no prompt for this type")).alias("error"),
    )
