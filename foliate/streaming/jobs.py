"""Streaming: a landing folder that is processed as files arrive, the frame gate with state, running totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliate.operators.video import CHANGED, GATED, SAME, keep_steps
from foliate.sinks.results import event_frame, result_rows, try_save


def landing(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def process_into(stream: DataFrame, process, path: str, checkpoint: str, events: str | None = None):
    """Runs ``process`` (DataFrame -> result records) on each micro-batch and appends to the store.

    A batch that is repeated after a failure replaces its own folder, so results are stored once. A store that fails is not
    fatal: the batch goes by with an error event. ``events``: folder for progress, complete and error events of batches.
    """

    def save(batch: DataFrame, number: int) -> None:
        result_rows(process(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    def each(batch: DataFrame, number: int) -> None:
        say(number, "progress", "started")
        error = try_save(save, batch, number)
        say(number, "error" if error else "complete", error or f"{path}/batch={number}")

    def say(number: int, event: str, data: str) -> None:
        if events:
            frame = stream.sparkSession.range(1).select(event_frame(F.lit(event), F.to_json(F.struct(F.lit(number).alias("batch"), F.lit(data).alias("message")))).alias("value"))
            try_save(lambda: frame.coalesce(1).write.mode("append").text(events))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate_stream(frames: DataFrame) -> DataFrame:
    """video_id, t, ssim, text as they arrive (in order per video) -> the frames with zone and kept.

    State per video: whether a frame was seen, and the last kept text.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (False, "")
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        zones = []
        for ssim in rows.ssim:
            zones.append("first" if not seen else "skip" if ssim > SAME else "change" if ssim < CHANGED else "fuzzy")
            seen = True
        kept, last = keep_steps(zones, [None if pd.isna(x) else x for x in rows.text], last)
        state.update((seen, last))
        yield rows.assign(zone=zones, kept=kept)[["video_id", "t", "ssim", "text", "zone", "kept"]]

    keyed = frames.select("video_id", "t", "ssim", "text").groupBy("video_id")
    return keyed.applyInPandasWithState(run, GATED, "seen boolean, last string", "append", GroupStateTimeout.NoTimeout)


def running_totals(facts: DataFrame) -> DataFrame:
    """Totals by field over a stream of scored facts, for output mode ``complete``; equal to the batch totals."""
    return facts.groupBy("field").agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), F.sum("similarity").alias("similarity")
    )


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: event counts and values per window and type under a watermark."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")

