"""The block table and the nested document schema."""

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
METADATA = T.StructType(
    [T.StructField("bbox", BBOX)] + [T.StructField(c, T.DoubleType()) for c in ("start_time", "end_time", "timestamp")]
)
#: One row per text block. ``block_idx`` is the list position: order is semantic, and every sort ends with it.
BLOCK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("block_idx", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        *BBOX.fields,
        T.StructField("confidence", T.DoubleType()),
        T.StructField("metadata", METADATA),
    ]
)
TEXT_SOURCE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField(
            "metadata",
            T.StructType(
                [T.StructField("bbox", T.ArrayType(T.DoubleType()))]
                + [T.StructField(c, T.DoubleType()) for c in ("start_time", "end_time", "timestamp")]
            ),
        ),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("text_sources", T.ArrayType(TEXT_SOURCE)),
        *[T.StructField(c, T.DoubleType()) for c in ("ocr_duration_ms", "transcription_duration_ms", "video_duration_ms")],
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("document_name", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("total_pages", T.IntegerType()),
        T.StructField("processing_time_ms", T.DoubleType()),
        T.StructField("pages", T.ArrayType(PAGE)),
    ]
)
