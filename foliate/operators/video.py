"""Video and audio: frame sampling, the similarity gates, and one time line of frames and speech."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from foliate.functions.frames import resize, successive
from foliate.functions.similarity import ratio_of
from foliate.functions.text import strip

STRIDE_S, SAME, CHANGED, TEXT_SAME, TIME_PX = 2, 0.90, 0.85, 95.0, 10_000.0
FRAME_SIDE = 256
GATED = "video_id long, t long, ssim double, text string, zone string, kept boolean"


def frame_similarity(frames: DataFrame) -> DataFrame:
    """video_id, t, height, width, pixels (grey bytes) -> video_id, t, ssim to the previous sample (null for the first).

    Frames of more pixels than a square of FRAME_SIDE are scaled to it before they travel, smaller ones when they are compared,
    so a row is 64 KB at most whatever the film's size. A film is streamed in order, each frame once. Cropping to the slide's
    edges needs a decoder's library and belongs to the provider.
    """

    def shrink(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            shapes = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            if any(h * w > FRAME_SIDE**2 for h, w in shapes):
                small = []
                for i, (h, w) in enumerate(shapes):
                    pixels = batch.column(4)[i].as_py()
                    if h * w > FRAME_SIDE**2:
                        shapes[i], pixels = (FRAME_SIDE, FRAME_SIDE), resize(np.frombuffer(pixels, np.uint8).reshape(h, w), FRAME_SIDE).tobytes()
                    small.append(pixels)
                sides = [pa.array(side, pa.int32()) for side in zip(*shapes)]
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides, pa.array(small, pa.binary())], batch.schema.names)
            yield batch

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        film, step = (), successive(FRAME_SIDE)
        for batch in stream:
            scores = []
            for v, *frame in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                scores.append(step(*frame, v != film))
                film = v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["video_id", "t", "ssim"])

    typed = frames.select("video_id", "t", F.col("height").cast("int"), F.col("width").cast("int"), "pixels")
    small = typed.mapInArrow(shrink, "video_id long, t long, height int, width int, pixels binary")
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as counted: pictures pack well, so few bytes may be much work
    return small.repartition(parts, "video_id").sortWithinPartitions("video_id", "t").mapInArrow(compare, "video_id long, t long, ssim double")


def sample_times(videos: DataFrame) -> DataFrame:
    """video_id, fps, total_frames -> video_id, t, frame_idx: every second second, as long as there is a frame."""
    good = videos.filter("fps > 0 and total_frames > 0")
    end = F.floor(F.col("total_frames") / F.col("fps")).cast("long")
    each = good.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), end, F.lit(STRIDE_S).cast("long"))))
    each = each.withColumn("frame_idx", F.bround(F.col("t") * F.col("fps")).cast("long"))
    return each.filter("frame_idx < total_frames").select("video_id", "t", "frame_idx")


def zone(ssim: Column, first: Column) -> Column:
    """What the similarity to the previous sample asks for: nothing, text recognition, or recognition and a text test."""
    return F.when(first, "first").when(ssim > SAME, "skip").when(ssim < CHANGED, "change").otherwise("fuzzy")


def gate_frames(frames: DataFrame) -> DataFrame:
    """video_id, t, ssim (to the previous readable sample), readable -> adds previous_t and zone."""
    readable = frames.filter("readable") if "readable" in frames.columns else frames
    over = Window.partitionBy("video_id").orderBy("t")
    before = F.lag("t").over(over)
    return readable.withColumn("previous_t", before).withColumn("zone", zone(F.col("ssim"), F.col("previous_t").isNull()))


def keep_steps(zones, texts, last: str = "") -> tuple[list[bool], str]:
    """Which frames are kept, and the last kept text. A null text is a failed recognition: dropped, state unchanged."""
    kept = []
    for kind, text in zip(zones, texts):
        keep = text is not None and kind != "skip"
        if keep and kind == "fuzzy":
            keep = ratio_of(text.lower(), last.lower()) <= TEXT_SAME
        if keep:
            last = text
        kept.append(keep)
    return kept, last


def keep_frames(gated: DataFrame) -> DataFrame:
    """Adds ``kept``: frames of the fuzzy zone go if their text is that of the last *kept* frame. One pass per video."""

    def run(video: pd.DataFrame) -> pd.DataFrame:
        video = video.sort_values("t", kind="stable")
        kept, _ = keep_steps(video.zone, [None if pd.isna(x) else x for x in video.text])
        return video.assign(kept=kept)[["video_id", "t", "ssim", "text", "zone", "kept"]]

    return gated.groupBy("video_id").applyInPandas(run, GATED)


def speech_confidence(avg_logprob: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(avg_logprob))), F.lit(1.0))


def speech_blocks(segments: DataFrame) -> DataFrame:
    """doc_id, idx, text, start, end, avg_logprob -> audio blocks; empty segments go."""
    text = strip(F.col("text"))
    return segments.filter(text != "").select(
        "doc_id", F.lit(1).alias("page_number"), F.col("idx").alias("block_idx"), F.lit("audio").alias("source"), text.alias("text"),
        F.col("start").alias("x0"), F.lit(0.0).alias("y0"), F.col("end").alias("x1"), F.lit(0.0).alias("y1"),
        speech_confidence(F.col("avg_logprob")).alias("confidence"), F.col("start").alias("start_time"), F.col("end").alias("end_time"),
    )


def on_time_line(blocks: DataFrame, seconds: Column) -> DataFrame:
    """Shifts boxes down by 10,000 per second, so that reading order is time order."""
    return blocks.withColumns({"y0": F.col("y0") + seconds * TIME_PX, "y1": F.col("y1") + seconds * TIME_PX})


def merge_branches(frames: DataFrame | None, speech: DataFrame | None, mode: str = "both") -> DataFrame:
    """Frames and speech in one order by y0; frames first on ties. A branch that failed may be None (see ``branch_errors``)."""
    if mode not in ("frames", "audio", "both"):
        raise ValueError(f"unknown extraction mode {mode!r}")
    parts = [(0, frames if mode != "audio" else None), (1, speech if mode != "frames" else None)]
    parts = [df.withColumn("branch", F.lit(n)) for n, df in parts if df is not None]
    if not parts:
        raise ValueError("no branch to merge")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    over = Window.partitionBy("doc_id").orderBy("y0", "branch", "block_idx")
    return both.withColumn("position", F.row_number().over(over) - 1)


def branch_errors(frames_error: str | None, speech_error: str | None, mode: str = "both") -> dict[str, str]:
    """What went wrong by branch. One failed branch leaves partial output; if all that were asked for failed, it raises."""
    asked = {"frames": frames_error, "audio": speech_error}
    asked = {k: v for k, v in asked.items() if mode in (k, "both")}
    failed = {k: v for k, v in asked.items() if v}
    if asked and len(failed) == len(asked):
        raise RuntimeError("; ".join(f"{k}: {v}" for k, v in failed.items()))
    return failed
