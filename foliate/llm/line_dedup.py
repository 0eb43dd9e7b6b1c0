"""Line dedup: explode normalised lines, hash, count documents per hash, drop repeats, reassemble by position.

A line's key is the line stripped of ASCII white space and ASCII-lower-cased. A key of at least ``min_chars`` code
points that occurs in at least ``min_docs`` documents loses its lines everywhere but in the document of smallest id.
Lines are exploded and hashed once, into a table of 16-byte hashes and positions; the count and the join read that.
Hot keys are joined by broadcast, all others by shuffle (``skew.meet``), so no task gathers the lines of a hot key. Texts are shuffled once, when drop lists meet their documents.

Defined cases: null or empty text is one empty line; a text of any length is read whole; rows of the same doc_id are one
document (equal lines of its rows all stay or all go); a row with a null doc_id is counted for nothing and kept whole;
extra columns are carried along, whatever their names (n_lines and n_dropped are replaced); an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliate.functions.columns import bind, fresh
from foliate.runtime import materialise

from .skew import meet

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "\t\n\x0b\x0c\r "


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def lowered(line: Column) -> Column:
    """A-Z lower-cased; ``lower`` does the same for ASCII lines, several times as fast."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, same (hash of the text), at, key of the lines that are long enough."""
    # stripped inside the array: a filter on a projected column would strip every line twice
    lines = F.transform(F.split(text_col, "\n", -1), stripped)
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.posexplode(lines).alias("at", "line"))
    return rows.filter(F.length("line") >= min_chars).select("id", "same", "at", F.unhex(F.md5(lowered(F.col("line")))).alias("key"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """key, keeper (smallest id), n (lines) of the keys that enough documents hold."""
    if min_docs == 2:  # the same as two ids that differ: no distinct count
        counted = lines.groupBy("key").agg(F.min("id").alias("keeper"), F.max("id").alias("other"), F.count("*").alias("n"))
        return counted.filter("keeper <> other").drop("other")
    each = lines.groupBy("key", "id").agg(F.count("*").alias("n"))  # a key's documents are summed by task, then by key
    counted = each.groupBy("key").agg(F.min("id").alias("keeper"), F.count("*").alias("docs"), F.sum("n").alias("n"))
    return counted.filter(F.col("docs") >= min_docs).drop("docs")


def drop_lists(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """id, same -> sorted positions of the lines that the document loses."""
    lines = materialise(line_keys(docs, id_col, text_col, min_chars))
    keys = materialise(repeated_keys(lines, min_docs))
    lost = meet(lines, keys, ["key"], "n").filter("id <> keeper")
    return lost.groupBy("id", "same").agg(F.collect_set("at").alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` reassembled; adds n_lines (before dropping) and n_dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    own, same, gone, digest = fresh(docs.columns, "__id", "__same", "__lost", "__digest")
    lost = drop_lists(docs, id_col, text_col, min_chars, min_docs).toDF(own, same, gone)
    docs = docs.withColumn(digest, F.xxhash64(text_col))
    joined = docs.join(lost, (F.col(id_col) == F.col(own)) & (F.col(digest) == F.col(same)), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    joined = joined.withColumn("n_lines", F.size(lines).cast("long"))
    joined = joined.withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))

    def rest(bound):  # array_except hashes, so a document of many lines takes linear time
        kept = F.array_except(F.sequence(F.lit(0), F.size(bound) - 1), F.col(gone))
        return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda i: F.get(bound, i)), "\n")).otherwise("")

    text = F.when(F.col(gone).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(bind(lines, rest))
    return joined.withColumn(text_col, text).drop(own, same, gone, digest)
