"""Stand-in inputs derived from the driver's tables, as DataFrames and as SQL (one formula each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from foliate.runtime import table

LINES = """lines as (
    select doc_id, unnest(string_split(text, chr(10))) as line,
           (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as line_idx from documents)"""
EMBEDDED = """embedded as (
    select doc_id, (1 + line_idx // 40)::int as page_number, 2 * line_idx as block_idx, 'embedded' as source, line as text, line_idx,
           (40 + 180 * (line_idx % 3))::double as x0, (50 + {pitch} * (line_idx // 3) + 2 * (line_idx % 3))::double as y0,
           (40 + 180 * (line_idx % 3) + 6 * least(length(line), 25))::double as x1,
           (60 + {pitch} * (line_idx // 3) + 2 * (line_idx % 3))::double as y1, 1.0::double as confidence
    from lines where line <> '')"""
BLOCKS = f"""{LINES}, {EMBEDDED.format(pitch=14)}, blocks as (
    select doc_id, page_number, block_idx, source, text, x0, y0, x1, y1, confidence from embedded
    union all
    select doc_id, page_number, block_idx + 1, 'ocr', replace(text, 'e', 'c'), x0 + 1, y0 + 1, x1 + 1, y1 + 1,
           0.5 + ((7 * doc_id + 13 * line_idx) % 50) / 100.0
    from embedded where (doc_id + line_idx) % 5 = 0)"""
DENSE = f"""{LINES}, {EMBEDDED.format(pitch=4)}, blocks as (
    select doc_id, page_number, block_idx, source, text, x0, y0, x1, y1, confidence from embedded)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "line"))


def embedded(spark: SparkSession, sf: str, pitch: int) -> DataFrame:
    n = F.col("line_idx")
    row, col = F.floor(n / 3), n % 3
    y = row * pitch + col * 2
    return lines(spark, sf).filter("line <> ''").select(
        "doc_id", (F.floor(n / 40) + 1).cast("int").alias("page_number"), (n * 2).cast("int").alias("block_idx"), F.lit("embedded").alias("source"),
        F.col("line").alias("text"), "line_idx", (col * 180 + 40).cast("double").alias("x0"), (y + 50).cast("double").alias("y0"),
        (col * 180 + 40 + F.least(F.length("line"), F.lit(25)) * 6).cast("double").alias("x1"), (y + 60).cast("double").alias("y1"),
        F.lit(1.0).alias("confidence"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as blocks of three columns, with a misread twin from another source for every fifth."""
    own = embedded(spark, sf, 14)
    twin = own.filter((F.col("doc_id") + F.col("line_idx")) % 5 == 0).select(
        "doc_id", "page_number", (F.col("block_idx") + 1).alias("block_idx"), F.lit("ocr").alias("source"),
        F.replace("text", F.lit("e"), F.lit("c")).alias("text"), *[(F.col(c) + 1).alias(c) for c in ("x0", "y0", "x1", "y1")],
        (F.lit(0.5) + (F.col("doc_id") * 7 + F.col("line_idx") * 13) % 50 / 100.0).alias("confidence"),
    )
    return own.drop("line_idx").unionByName(twin)


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Rows so close that reading bands span them."""
    return embedded(spark, sf, 4).drop("line_idx")


SEGMENTS = """segments as (
    select conv_id as doc_id, turn::int as idx, text, (5 * turn)::double as start, (5 * turn + 4)::double as "end",
           -((3 * conv_id + turn) % 40) / 20.0 as avg_logprob from conversations)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), "text", (F.col("turn") * 5).cast("double").alias("start"),
        (F.col("turn") * 5 + 4).cast("double").alias("end"), (-((F.col("conv_id") * 3 + F.col("turn")) % 40) / 20.0).alias("avg_logprob"),
    )


FRAMES = """frames as (
    select user_id as video_id, 2 * (row_number() over (partition by user_id order by ts, event_id) - 1) as t,
           round(0.80 + ((7 * event_id) % 16) / 100.0, 2)::double as ssim, event_type as text from events)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), ((F.row_number().over(order) - 1) * 2).cast("long").alias("t"),
        F.round(F.lit(0.80) + (F.col("event_id") * 7) % 16 / 100.0, 2).alias("ssim"), F.col("event_type").alias("text"),
    )


EXTENSIONS = ("pdf", "PNG", "jpg", "jpeg", "tiff", "bmp", "webp", "docx", "doc", "mp3", "wav", "m4a", "aac", "flac", "mp4", "avi", "mov", "mkv", "webm", "xyz")
FILES = f"""files as (
    select o_orderkey as key, 'Doc_' || o_orderkey || '.' || list_extract({list(EXTENSIONS)!r}, (o_orderkey % {len(EXTENSIONS)} + 1)::int) as filename from orders)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("o_orderkey") % len(EXTENSIONS)).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("Doc_"), F.col("o_orderkey").cast("string"), F.lit("."), pick).alias("filename"))


# expected and predicted fields of customers: equal, lower case, an edit, blank, absent by key
TRUTH = """truth as (
    select 'doc_' || c_custkey || case c_custkey % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.png' else '.webm' end as filename,
           unnest(['name', 'segment', 'balance', 'note']) as field,
           unnest([c_name, c_mktsegment, printf('%.2f', c_acctbal), '']) as expected, c_custkey as k from customer),
predictions as (
    select filename, field, case when (k + length(field)) % 5 = 0 then lower(expected) when (k + length(field)) % 5 = 1 then expected || 'x'
           when (k + length(field)) % 5 = 2 then replace(expected, '0', 'O') when (k + length(field)) % 5 = 3 then ' ' || expected || ' ' else '' end as predicted
    from truth where (k * 3 + length(field)) % 7 <> 0)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    ext = F.when(k % 4 == 0, ".pdf").when(k % 4 == 1, ".docx").when(k % 4 == 2, ".png").otherwise(".webm")
    pairs = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": F.format_string("%.2f", "c_acctbal"), "note": F.lit("")}
    expected = F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)])
    return table(spark, sf, "customer").select(F.concat(F.lit("doc_"), k.cast("string"), ext).alias("filename"), expected.alias("expected"), k.alias("k"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    each = truth(spark, sf).select("filename", "k", F.explode("expected").alias("field", "expected"))
    turn = (F.col("k") + F.length("field")) % 5
    value = F.when(turn == 0, F.lower("expected")).when(turn == 1, F.concat("expected", F.lit("x"))).when(turn == 2, F.replace("expected", F.lit("0"), F.lit("O")))
    value = value.when(turn == 3, F.concat(F.lit(" "), F.col("expected"), F.lit(" "))).otherwise("")
    return each.filter((F.col("k") * 3 + F.length("field")) % 7 != 0).select("filename", "field", value.alias("predicted"))


REPLIES = """replies as (
    select o_orderkey as key,
           case when o_orderkey % 17 = 0 then '{' when o_orderkey % 13 = 0 then '[1, 2]'
                when o_orderkey % 11 = 0 then '```json' || chr(10) || body || chr(10) || '```' else ' ' || body end as reply
    from (select o_orderkey, '{"insurer_name": "' || case when o_orderkey % 7 = 0 then '' else c_name end
              || '", "intermediary_name": "Agent ' || o_orderkey % 9
              || '", "date_of_birth": "' || list_extract(['01/02/2024', '1-Feb-2024', '31/02/2020', '5/1/75', '', 'March 3rd, 2021', '2/3/21 10:30'], (o_orderkey % 7 + 1)::int)
              || '", "cell_phone": "' || list_extract(['+27 82 123 456', '12-34', '0123456789', '123456789012'], (o_orderkey % 4 + 1)::int)
              || '", "email": "' || list_extract(['a@b.c', 'nobody', '.', ''], (o_orderkey % 4 + 1)::int)
              || '", "total_premium": ' || case when o_orderkey % 3 = 0 then o_orderkey::varchar else '"R ' || o_orderkey || '"' end
              || ', "policy_type": "x", "junk": null}' as body
          from orders join customer on o_custkey = c_custkey))"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    body = F.concat(
        F.lit('{"insurer_name": "'), F.when(k % 7 == 0, "").otherwise(F.col("c_name")), F.lit('", "intermediary_name": "Agent '), (k % 9).cast("string"),
        F.lit('", "date_of_birth": "'), pick(["01/02/2024", "1-Feb-2024", "31/02/2020", "5/1/75", "", "March 3rd, 2021", "2/3/21 10:30"]),
        F.lit('", "cell_phone": "'), pick(["+27 82 123 456", "12-34", "0123456789", "123456789012"]),
        F.lit('", "email": "'), pick(["a@b.c", "nobody", ".", ""]),
        F.lit('", "total_premium": '), F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat(F.lit('"R '), k.cast("string"), F.lit('"'))),
        F.lit(', "policy_type": "x", "junk": null}'),
    )
    reply = F.when(k % 17 == 0, "{").when(k % 13 == 0, "[1, 2]").when(k % 11 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit(" "), body))
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(k.alias("key"), reply.alias("reply"))


PHRASES = (
    "PNR Number 12 and Train  Name", "registration number; engine number", "Star Health scheme description", "MultiSure and SASRIA cover",
    "Period of Insurance: one year", "train name only", "",
)
CLASSED = f"""classed as (
    select doc_id, case when doc_id % 14 >= 7 then text || chr(10) else '' end || list_extract({list(PHRASES)!r}, (doc_id % 7 + 1)::int) || chr(10) || text as text
    from documents)"""


def classed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a phrase before their text, or after it (past the classified characters in long ones)."""
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 7).cast("int"))
    first = F.when(F.col("doc_id") % 14 >= 7, F.concat("text", F.lit("\n"))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.concat(first, phrase, F.lit("\n"), F.col("text")).alias("text"))


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of lines as recognised words with jittered polygons."""
    each = lines(spark, sf).select("doc_id", "line_idx", F.posexplode(F.split("line", " ", -1)).alias("w", "text")).filter("text <> ''")
    x = F.col("w") * 48 + F.when(F.col("w") % 7 == 6, 60).otherwise(0)
    y = F.col("line_idx") * 14 + (F.col("w") * 5 + F.col("line_idx")) % 4
    corner = lambda dx, dy: F.struct((x + dx).cast("int").alias("x"), (y + dy).cast("int").alias("y"))
    full = F.array(corner(0, 0), corner(40, 0), corner(40, 10), corner(0, 10))
    return each.select(
        "doc_id", (F.floor(F.col("line_idx") / 40) + 1).cast("int").alias("page_number"), (F.col("line_idx") * 10_000 + F.col("w")).cast("int").alias("block_idx"),
        "text", F.when((F.col("w") + F.col("line_idx")) % 29 == 0, F.slice(full, 1, 1)).otherwise(full).alias("vertices"),
        (F.lit(0.6) + F.col("w") % 5 / 20.0).alias("confidence"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as a label column and a value column: labels, values on the same row, wrapped values."""
    n = F.col("line_idx")
    kind = n % 3
    text = F.when(kind == 0, F.concat(F.substring("line", 1, 12), F.lit(":"))).otherwise(F.col("line"))
    x0 = F.when(kind == 0, 40.0).otherwise(200.0) + n % 2
    y0 = F.floor(n / 3) * 30 + F.when(kind == 2, 14.0).otherwise(0.0) + n % 3 * 0.5
    return lines(spark, sf).filter("line <> ''").select(
        "doc_id", (F.floor(n / 60) + 1).cast("int").alias("page_number"), n.cast("int").alias("block_idx"),
        F.when(n % 4 == 0, "ocr").otherwise("embedded").alias("source"), text.alias("text"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.least(F.length("line"), F.lit(20)) * 5).alias("x1"), (y0 + 10).alias("y1"), (F.lit(0.8) + n % 5 / 50.0).alias("confidence"),
    )


def misread(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a misread term of the domain before them."""
    words = ["Mutral", "Insurer", "month", "numbar,", "P57", "Premiun", "(Polcy)", "Adress:", "the"]
    pick = F.get(F.array(*map(F.lit, words)), ((F.col("doc_id") + F.col("block_idx")) % len(words)).cast("int"))
    return dense(spark, sf).withColumn("text", F.concat(pick, F.lit(" "), F.col("text")))
