"""Every query of the engine by name, with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliate.config import CLASS_RULES, CLASSIFY_CHARS, FORMATS, KINDS, UPLOADS, CleanConfig, DOMAIN_TERMS, GENERAL_WORDS
from foliate.functions import formats, text as X
from foliate.operators import classify, clean, evaluate, extract, layout, video
from foliate.plans import fixtures as fx
from foliate.runtime import table
from foliate.sinks import results
from foliate.sources import documents, routing
from foliate.streaming import jobs

FLAGSHIP = "t6_document_text"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def sql_map(pairs: dict[str, str], key: str) -> str:
    return "case " + " ".join(f"when {key} = '{a}' then '{b}'" for a, b in pairs.items()) + " end"


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)



# sources ---------------------------------------------------------------------------------------------------------

EXT = "lower(regexp_extract(filename, '[^/.][^/]*\\.([^./]*)$', 1))"


@query(f"with {fx.FILES} select key, filename, {sql_map(KINDS, EXT)} as kind, coalesce({sql_map(FORMATS, EXT)}, 'unknown') as format, {EXT} in {UPLOADS} as uploadable from files")
def src1_route_files(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("filename")
    return fx.files(spark, sf).select(
        "key", "filename", routing.document_kind(name).alias("kind"), routing.evaluation_format(name).alias("format"), routing.uploadable(name).alias("uploadable")
    )


@query(
    f"with {fx.FILES} select coalesce({sql_map(FORMATS, EXT)}, 'unknown') as format, count(*) as n from files group by 1"
)
def src2_evaluation_formats(spark: SparkSession, sf: str) -> DataFrame:
    return fx.files(spark, sf).groupBy(routing.evaluation_format(F.col("filename")).alias("format")).agg(F.count("*").alias("n"))


@query(
    f"""with {fx.BLOCKS} select doc_id, page_number, sum(case when source = 'embedded' then length(text) else 0 end)::bigint as chars,
        sum(case when source = 'embedded' then length(text) else 0 end) < 50 as needs_ocr from blocks group by all"""
)
def src5_ocr_gate(spark: SparkSession, sf: str) -> DataFrame:
    return documents.needs_ocr(fx.blocks(spark, sf))


@query(
    f"""with {fx.BLOCKS} select doc_id, page_number, block_idx, round(30 + x0 * 72 / 150, 6) as px0, round(20 + y0 * 72 / 150, 6) as py0
        from blocks where source = 'ocr'"""
)
def src6_crop_to_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.blocks(spark, sf).filter("source = 'ocr'")
    place = lambda o, c: F.round(documents.to_page(F.lit(o), F.col(c)), 6)
    return rows.select("doc_id", "page_number", "block_idx", place(30.0, "x0").alias("px0"), place(20.0, "y0").alias("py0"))


@query(
    f"""with {fx.SEGMENTS} select doc_id, 1 as page_number, idx as block_idx, 'audio' as source, trim(text) as text, start as x0, 0.0::double as y0,
        "end" as x1, 0.0::double as y1, round(least(1.0, greatest(0.0, exp(avg_logprob))), 6) as confidence, start as start_time, "end" as end_time
        from segments where trim(text) <> ''"""
)
def src10_speech_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return video.speech_blocks(fx.segments(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""with {fx.FRAMES}, {fx.SEGMENTS}, both_ as (
        select video_id as doc_id, (t // 2)::int as block_idx, text, t * 10000.0 as y0, 0 as branch from frames
        union all select doc_id, idx, trim(text), start * 10000.0, 1 from segments where trim(text) <> '')
        select doc_id, block_idx, text, y0::double as y0, branch,
               (row_number() over (partition by doc_id order by y0, branch, block_idx) - 1)::int as position from both_"""
)
def src11_video_time_line(spark: SparkSession, sf: str) -> DataFrame:
    shots = fx.frames(spark, sf).select(
        F.col("video_id").alias("doc_id"), F.floor(F.col("t") / 2).cast("int").alias("block_idx"), "text", F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"), "t"
    )
    speech = video.speech_blocks(fx.segments(spark, sf)).select("doc_id", "block_idx", "text", "y0", "y1", "start_time")
    merged = video.merge_branches(video.on_time_line(shots, F.col("t")).drop("t"), video.on_time_line(speech, F.col("start_time")).drop("start_time"))
    return merged.select("doc_id", "block_idx", "text", "y0", "branch", "position")


@query(
    f"""with {fx.LINES} select doc_id, (row_number() over (partition by doc_id order by line_idx, at_) - 1)::int as word_idx, word as text, 1 as n_vertices, 1.0::double as confidence
        from (select doc_id, line_idx, unnest(string_split(line, ' ')) as word, generate_subscripts(string_split(line, ' '), 1) as at_ from lines)"""
)
def src13_flatten_ocr(spark: SparkSession, sf: str) -> DataFrame:
    symbol = lambda c: F.struct(c.alias("text"))
    word = lambda w: F.struct(
        F.transform(F.split(w, ""), symbol).alias("symbols"),
        F.array(F.struct(F.lit(None).cast("int").alias("x"), F.lit(3).alias("y"))).alias("vertices"), F.lit(None).cast("double").alias("confidence"),
    )
    paragraph = lambda line: F.struct(F.transform(F.split(line, " ", -1), word).alias("words"))
    pages = F.array(F.struct(F.array(F.struct(F.transform(F.split("text", "\n", -1), paragraph).alias("paragraphs"))).alias("blocks")))
    flat = documents.flatten_words(table(spark, sf, "documents").select("doc_id", pages.alias("pages")))
    return flat.select("doc_id", "word_idx", "text", F.size("vertices").alias("n_vertices"), "confidence")


@query(f"with {fx.TRUTH} select filename, field, expected from truth")
def src16_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    more = F.map_concat("expected", F.create_map(F.lit("policy_type"), F.lit("gone")))
    return evaluate.truth_rows(fx.truth(spark, sf).select("filename", more.alias("expected")))


@query(
    f"""with {fx.FILES}, listed as (select case when key % 3 = 0 then filename else upper(replace(filename, '_', ' ')) end as actual, key as ord from files where key % 5 <> 0),
        plain as (select actual, ord, translate(lower(actual), '_+ ', '') as k from listed),
        pairs as (select f.filename, p.actual, row_number() over (partition by f.filename order by (p.actual <> f.filename)::int, p.ord) as n
                  from files f join plain p on translate(lower(f.filename), '_+ ', '') = p.k)
        select filename, actual from pairs where n = 1"""
)
def src17_match_files(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.files(spark, sf)
    other = F.when(F.col("key") % 3 == 0, F.col("filename")).otherwise(F.upper(F.replace("filename", F.lit("_"), F.lit(" "))))
    listed = files.filter("key % 5 <> 0").select(other.alias("actual"), F.col("key").alias("ord"))
    return routing.match_files(files.select("filename"), listed)


# text functions --------------------------------------------------------------------------------------------------


@query(
    r"with " + fx.LINES + r""", spaced as (select doc_id, line_idx, chr(9) || line || chr(160) || '  ' || line || ' ' as line from lines)
    select doc_id, line_idx, trim(regexp_replace(line, '[\s\x1c-\x1f\pZ]+', ' ', 'g')) as text from spaced"""
)
def x2_collapse_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.concat(F.lit("\t"), "line", F.lit("\xa0  "), "line", F.lit(" "))
    return fx.lines(spark, sf).select("doc_id", "line_idx", X.collapse_whitespace(spaced).alias("text"))


@query()
def x3_unicode_repair(spark: SparkSession, sf: str) -> DataFrame:
    return fx.lines(spark, sf).select("doc_id", "line_idx", X.normalise_unicode(F.concat("line", F.lit(" ﬁ &amp; Ã©"))).alias("text"))


@query(
    r"with " + fx.LINES + r""", noisy as (select doc_id, line_idx, ': -• ' || line || '..' as line from lines)
    select doc_id, line_idx, trim(regexp_replace(regexp_replace(line, '^[:\-\s•·●▪]+', ''), '(\.)\.+$|(,),+$|(;);+$|(:):+$|(!)!+$|(\?)\?+$', '\1\2\3\4\5\6')) as text from noisy"""
)
def x4_edge_noise(spark: SparkSession, sf: str) -> DataFrame:
    noisy = F.concat(F.lit(": -• "), "line", F.lit(".."))
    return fx.lines(spark, sf).select("doc_id", "line_idx", X.strip_edge_noise(noisy).alias("text"))


@query()
def x5_domain_snap(spark: SparkSession, sf: str) -> DataFrame:
    return clean.snap(fx.misread(spark, sf), ["doc_id", "page_number", "block_idx"]).select("doc_id", "page_number", "block_idx", "text")


@query(
    f"""with {fx.LINES}, dated as (select doc_id, line_idx, line || ' on 3-' || (line_idx % 14) || '.20' || (doc_id % 90 + 10) as line from lines)
    select doc_id, line_idx, regexp_replace(line, '\\b(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{2,4}})\\b', '\\1/\\2/\\3', 'g') as text from dated"""
)
def x7_date_separators(spark: SparkSession, sf: str) -> DataFrame:
    dated = F.concat("line", F.lit(" on 3-"), (F.col("line_idx") % 14).cast("string"), F.lit(".20"), (F.col("doc_id") % 90 + 10).cast("string"))
    return fx.lines(spark, sf).select("doc_id", "line_idx", X.normalise_dates(dated).alias("text"))


SQL_DATE_IN = """list_extract([strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%-d/%-m/%y'), strftime(o_orderdate, '%d-%b-%Y'), strftime(o_orderdate, '%d-%b-%y'),
    strftime(o_orderdate, '%-d-%-m-%Y'), strftime(o_orderdate, '%B %d, %Y'), strftime(o_orderdate, '%b %-dst, %Y'), '31/02/2020', '5/1/75', '', 'tomorrow', strftime(o_orderdate, '%d/%m/%Y 10:45')],
    (o_orderkey % 12 + 1)::int)"""


@query(
    f"""with d as (select o_orderkey as key, o_orderdate, {SQL_DATE_IN} as value from orders)
    select key, value, case key % 12 when 7 then '' when 8 then '05/01/1975' when 9 then '' when 10 then '' else strftime(o_orderdate, '%d/%m/%Y') end as checked from d"""
)
def x8_check_date(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    patterns = ("dd/MM/yyyy", "d/M/yy", "dd-MMM-yyyy", "dd-MMM-yy", "d-M-yyyy", "MMMM dd, yyyy")
    values = [F.date_format(d, p) for p in patterns] + [F.concat(F.date_format(d, "MMM d"), F.lit("st, "), F.date_format(d, "yyyy"))]
    values += [F.lit(v) for v in ("31/02/2020", "5/1/75", "", "tomorrow")] + [F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 10:45"))]
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.get(F.array(*values), (F.col("o_orderkey") % 12).cast("int")).alias("value"))
    return rows.withColumn("checked", formats.checked(F.col("value"), "date"))


@query(
    """with v as (select c_custkey as key, list_extract(['+' || c_custkey || ' 082-1234', c_name, 'a.' || c_custkey, '', printf('%.2f', c_acctbal) || '%', '-' || c_custkey, '1e3 %%', '٣'], (c_custkey % 8 + 1)::int) as value from customer)
    select key, value, case when value = '' then '' when length(regexp_replace(value, '[^0-9٣]', '', 'g')) between 9 and 11 then regexp_replace(value, '[^0-9٣]', '', 'g') else '' end as phone,
           case when contains(value, '.') and regexp_matches(value, '[\\pL\\pN]') then value else '' end as email,
           case when regexp_matches(value, '\\pN') then value else '' end as currency,
           case when regexp_full_match(value, '-?[0-9]+|٣') then value else '' end as integer,
           case when key % 8 in (4, 5, 6) then value else '' end as percent from v"""
)
def x9_check_formats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    values = [F.concat(F.lit("+"), k, F.lit(" 082-1234")), F.col("c_name"), F.concat(F.lit("a."), k), F.lit(""), F.concat(F.format_string("%.2f", "c_acctbal"), F.lit("%")), F.concat(F.lit("-"), k), F.lit("1e3 %%"), F.lit("٣")]
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.get(F.array(*values), (F.col("c_custkey") % 8).cast("int")).alias("value"))
    return rows.select("key", "value", *[formats.checked(F.col("value"), f).alias(f) for f in ("phone", "email", "currency", "integer", "percent")])


SQL_BODY = r"case when starts_with(trim(reply), '```') then regexp_extract(trim(reply), '^```[^\n]*\n(.*)\n```$', 1, 's') else trim(reply) end"


@query(
    f"""with {fx.REPLIES}, bare as (select key, {SQL_BODY} as body from replies),
    parsed as (select key, case when json_valid(body) and json_type(try_cast(body as json)) = 'OBJECT' then try_cast(body as json) end as j from bare)
    select key, j is not null as parsed, json_extract_string(j, '$.insurer_name') as insurer_name,
           case when j is null then null when json_type(j, '$.total_premium') = 'VARCHAR' then json_extract_string(j, '$.total_premium') else '' end as total_premium,
           case when j is not null then '' end as junk, len(json_keys(j))::int as n_keys from parsed"""
)
def x15_parse_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.replies(spark, sf).withColumn("m", extract.parse_reply(F.col("reply")))
    return rows.select("key", F.col("m").isNotNull().alias("parsed"), *[F.element_at("m", c).alias(c) for c in ("insurer_name", "total_premium", "junk")], F.size(F.map_keys("m")).alias("n_keys"))


SQL_KEYWORDS = " ".join(
    f"when {' + '.join(f'regexp_matches(low, $${p}$$)::int' for p in patterns)} >= {needed} then '{kind}'" for kind, needed, patterns in CLASS_RULES
)


@query(f"with {fx.CLASSED}, lowered as (select doc_id, lower(left(text, {CLASSIFY_CHARS})) as low from classed) select doc_id, case {SQL_KEYWORDS} else '' end as doc_type from lowered")
def x19_keyword_class(spark: SparkSession, sf: str) -> DataFrame:
    return fx.classed(spark, sf).select("doc_id", classify.keyword_type(F.col("text")).alias("doc_type"))


@query(
    """with replies as (select doc_id, list_extract(['{"doc_type": " Car "}', '```json' || chr(10) || '{"doc_type": "health"}' || chr(10) || '```', 'It is a travel or life policy', '{"doc_type": "boat"}', ''], (doc_id % 5 + 1)::int) as reply from documents)
    select doc_id, list_extract(['car', 'health', 'travel', 'life', 'life'], (doc_id % 5 + 1)::int) as doc_type from replies"""
)
def x18_reply_class(spark: SparkSession, sf: str) -> DataFrame:
    replies = ['{"doc_type": " Car "}', '```json\n{"doc_type": "health"}\n```', "It is a travel or life policy", '{"doc_type": "boat"}', ""]
    reply = F.get(F.array(*map(F.lit, replies)), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", classify.reply_type(reply, F.col("text")).alias("doc_type"))


@query("select doc_id, 'Read {this}: ' || text || ' end' as prompt from documents")
def x20_fill_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", extract.fill_prompt("Read {{this}}: {document_text} end", F.col("text")).alias("prompt"))


@query("select o_orderkey as key, replace('org/model-' || o_orderkey, '/', '_') as tag, case when o_totalprice % 100 >= 80 then 'high' when o_totalprice % 100 >= 55 then 'mid' else 'low' end as bar, left(o_orderpriority, 4) as head from orders")
def x24_names_and_bands(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice") % 100
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), routing.safe_model_name(F.concat(F.lit("org/model-"), F.col("o_orderkey").cast("string"))).alias("tag"),
        X.colour_band(p).alias("bar"), F.substring("o_orderpriority", 1, 4).alias("head"),
    )


# filters and aggregates over blocks ------------------------------------------------------------------------------


@query(
    f"""with {fx.LINES}, w as (
        select doc_id, (1 + line_idx // 40)::int as page_number, unnest(string_split(line, ' ')) as text, generate_subscripts(string_split(line, ' '), 1) - 1 as w, line_idx from lines)
    select doc_id, page_number, (line_idx * 10000 + w)::int as block_idx, text, (w * 48 + case when w % 7 = 6 then 60 else 0 end)::double as x0,
           (line_idx * 14 + (w * 5 + line_idx) % 4)::double as y0, (w * 48 + case when w % 7 = 6 then 60 else 0 end + 40)::double as x1,
           (line_idx * 14 + (w * 5 + line_idx) % 4 + 10)::double as y1 from w where text <> '' and (w + line_idx) % 29 <> 0"""
)
def f1_polygon_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return layout.polygon_boxes(fx.words(spark, sf)).select("doc_id", "page_number", "block_idx", "text", "x0", "y0", "x1", "y1")


@query(f"with {fx.BLOCKS} select case when confidence >= 0.9 then 'high' when confidence >= 0.7 then 'medium' else 'low' end as tier, count(*) as n from blocks group by 1")
def f5_confidence_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return fx.blocks(spark, sf).groupBy(X.confidence_tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query(
    f"""with {fx.LINES}, cut as (select doc_id, line_idx, list_extract(['--', 'é', ' a ', '7', '***', '', '€ ', left(line, 2)], ((doc_id + line_idx) % 8 + 1)::int) as text from lines)
    select doc_id, line_idx, text, trim(text) = '' or regexp_full_match(trim(text), '[^A-Za-z0-9]{{1,2}}') as symbol_only from cut"""
)
def f6_symbol_only(spark: SparkSession, sf: str) -> DataFrame:
    values = [F.lit(v) for v in ("--", "é", " a ", "7", "***", "", "€ ")] + [F.substring("line", 1, 2)]
    text = F.get(F.array(*values), ((F.col("doc_id") + F.col("line_idx")) % 8).cast("int"))
    return fx.lines(spark, sf).select("doc_id", "line_idx", text.alias("text")).withColumn("symbol_only", X.symbol_only(F.col("text")))


@query()
def f8_garbage(spark: SparkSession, sf: str) -> DataFrame:
    return clean.garbage(fx.blocks(spark, sf)).select("doc_id", "page_number", "block_idx", "garbage")


@query()
def f13_word_likeness(spark: SparkSession, sf: str) -> DataFrame:
    return clean.word_likeness(fx.blocks(spark, sf)).select("doc_id", "page_number", "block_idx", r("word_score"))


@query(
    f"""with {fx.BLOCKS}, heights as (select doc_id, page_number, list_sort(list(case when y1 > y0 then y1 - y0 end) filter (where y1 > y0)) as h from blocks group by all),
    typical as (select doc_id, page_number, coalesce(h[len(h) // 2 + 1], 0.0) as typical_height from heights)
    select b.doc_id, b.page_number, count(*) as n, any_value(typical_height)::double as typical_height,
           count(*) filter (where length(trim(text)) <= 8 and typical_height > 0 and y1 - y0 > 2.5 * typical_height and confidence < 0.9) as signatures
    from blocks b join typical t on b.doc_id = t.doc_id and b.page_number = t.page_number group by all"""
)
def a1_typical_height(spark: SparkSession, sf: str) -> DataFrame:
    blocks = fx.blocks(spark, sf)
    rows = blocks.join(clean.typical_height(blocks), layout.PAGE)
    return rows.groupBy(*layout.PAGE).agg(
        F.count("*").alias("n"), F.first("typical_height").alias("typical_height"), F.count_if(clean.signature_like(CleanConfig())).alias("signatures")
    )


@query(
    f"""with {fx.BLOCKS} select doc_id, count(*) as total_blocks_before, count(*) filter (where not (trim(text) = '' or regexp_full_match(trim(text), '[^A-Za-z0-9]{{1,2}}'))) as total_blocks_after
    from blocks group by 1"""
)
def a3_cleaning_counts(spark: SparkSession, sf: str) -> DataFrame:
    blocks = fx.blocks(spark, sf)
    return clean.cleaning_counts(blocks, blocks.filter(~X.symbol_only(F.col("text"))))


@query(f"with {fx.BLOCKS} select doc_id, bool_or(source = 'embedded') as has_embedded, bool_or(source = 'ocr') as has_ocr from blocks group by 1")
def a4_source_flags(spark: SparkSession, sf: str) -> DataFrame:
    return results.source_flags(fx.blocks(spark, sf))


@query(
    f"""with {fx.BLOCKS} select doc_id, page_number, count(*) as blocks, count(*) filter (where source = 'embedded') as embedded, count(*) filter (where source = 'ocr') as ocr,
    count(*) filter (where source = 'audio') as audio, count(*) filter (where source = 'mixed') as mixed from blocks group by all"""
)
def a5_page_summary(spark: SparkSession, sf: str) -> DataFrame:
    return results.page_summary(fx.blocks(spark, sf))


@query(f"select unnest({sorted({*GENERAL_WORDS, *(t.lower() for t in DOMAIN_TERMS)})!r}) as word")
def u4_real_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = lambda words: spark.createDataFrame([(w.lower(),) for w in words], "word string")
    return rows(GENERAL_WORDS).union(rows(DOMAIN_TERMS)).distinct()


# layout ----------------------------------------------------------------------------------------------------------

PAGE_COLUMNS = ["doc_id", "page_number", "block_idx"]


@query()
def t1_merge_words(spark: SparkSession, sf: str) -> DataFrame:
    return layout.merge_words(layout.polygon_boxes(fx.words(spark, sf)).drop("vertices")).select(*PAGE_COLUMNS, "text", "x0", "y0", "x1", "y1", r("confidence"))


@query()
def t2_pair_labels(spark: SparkSession, sf: str) -> DataFrame:
    return layout.pair_labels(fx.labelled(spark, sf)).select(*PAGE_COLUMNS, "source", "text")


@query()
def t3_merge_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    merged = layout.merge_wrapped(fx.labelled(spark, sf))
    return merged.select(*PAGE_COLUMNS, "source", "text", "x0", "y0", r("confidence"))


@query(
    f"""with {fx.BLOCKS}, numbered as (select *, (block_idx // 6)::int as g from blocks)
    select doc_id, page_number, g as block_idx, case when count(distinct source) = 1 then min(source) else 'mixed' end as source,
           string_agg(text, ' ' order by y0, x0, block_idx) as text, round(avg(confidence), 6) as confidence,
           arg_min(x0, (y0, x0, block_idx)) as x0, min(y0) as y0 from numbered group by doc_id, page_number, g"""
)
def t4_reduce_groups(spark: SparkSession, sf: str) -> DataFrame:
    numbered = fx.blocks(spark, sf).withColumn("group", F.floor(F.col("block_idx") / 6).cast("int"))
    return layout.reduce_groups(numbered).select(*PAGE_COLUMNS, "source", "text", r("confidence"), "x0", "y0")


BANDS = """ranked as (select *, row_number() over (partition by doc_id, page_number order by y0, block_idx) as k from blocks),
    walk as (
        select doc_id, page_number, k, block_idx, x0, y0, text, y0 as anchor, 0 as band from ranked where k = 1
        union all
        select r.doc_id, r.page_number, r.k, r.block_idx, r.x0, r.y0, r.text, case when r.y0 - w.anchor > 5 then r.y0 else w.anchor end,
               w.band + case when r.y0 - w.anchor > 5 then 1 else 0 end
        from walk w join ranked r on r.doc_id = w.doc_id and r.page_number = w.page_number and r.k = w.k + 1),
    placed as (select *, (row_number() over (partition by doc_id, page_number order by band, x0, k) - 1)::int as position from walk)"""


@query(f"with recursive {fx.DENSE}, {BANDS} select doc_id, page_number, block_idx, band, position from placed")
def t5_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(fx.dense(spark, sf)).select(*PAGE_COLUMNS, "band", "position")


@query(
    f"""with recursive {fx.DENSE}, {BANDS},
    bodies as (select doc_id, page_number, '--- PAGE ' || page_number || ' ---' || chr(10) || string_agg(text, chr(10) order by position) as body from placed group by doc_id, page_number)
    select doc_id, string_agg(body, chr(10) || chr(10) order by page_number) as document_text from bodies group by 1"""
)
def t6_document_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.document_text(layout.reading_order(fx.dense(spark, sf)))


# joins -----------------------------------------------------------------------------------------------------------

IOU = """greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as inter,
    (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as areas"""


@query(
    f"""with {fx.BLOCKS}, pairs as (
        select a.doc_id, a.page_number, a.block_idx as i, b.block_idx as j, {IOU},
               case when a.source = 'embedded' and b.source <> 'embedded' then b.block_idx when b.source = 'embedded' and a.source <> 'embedded' then a.block_idx
                    when a.confidence >= b.confidence then b.block_idx else a.block_idx end as loser
        from blocks a join blocks b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.block_idx < b.block_idx and a.source <> b.source)
    select doc_id, page_number, i, j, round(inter / (areas - inter), 6) as iou, loser from pairs where inter > 0 and inter / (areas - inter) >= 0.5"""
)
def j2_overlapping_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return clean.overlapping(fx.blocks(spark, sf)).select("doc_id", "page_number", "i", "j", r("iou"), "loser")


@query()
def j1_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_pairs(fx.blocks(spark, sf)).select("doc_id", "page_number", "i", "j", r("similarity"), "loser")


@query()
def j4_drop_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_duplicates(fx.blocks(spark, sf)).select(*PAGE_COLUMNS, "source")


@query()
def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaner, classification included."""
    text = layout.document_text(clean.clean(fx.blocks(spark, sf)))
    return text.withColumn("doc_type", classify.keyword_type(F.col("document_text")))


SQL_RATIO = """distinct_ as (select distinct a, b from hard),
    walk as (
        select a, b, 0 as i, list_transform(range(0, length(b) + 1), lambda x: 0) as best from distinct_
        union all
        select a, b, i + 1, list_transform(range(1, length(b) + 2), lambda k: list_max(list_transform(range(1, k + 1),
               lambda m: case when m = 1 then 0 else greatest(best[m], best[m - 1] + case when a[i + 1] = b[m - 1] then 1 else 0 end) end)))
        from walk where i < length(a)),
    lcs as (select a, b, list_max(best) as n from walk where i = length(a))"""
SCORED = f"""{fx.TRUTH}, pairs as (
        select t.filename, t.field, lower(trim(t.expected)) as a, lower(trim(coalesce(p.predicted, ''))) as b
        from truth t left join predictions p on t.filename = p.filename and t.field = p.field),
    hard as (select * from pairs where a <> b and a <> '' and b <> ''), {SQL_RATIO},
    facts as (
        select p.filename, p.field, {sql_map(FORMATS, EXT.replace('filename', 'p.filename'))} as known,
               case when p.a = p.b then 100.0 when p.a = '' or p.b = '' then 0.0 else 200.0 * l.n / (length(p.a) + length(p.b)) end as similarity
        from pairs p left join lcs l on p.a = l.a and p.b = l.b where not (p.a = '' and p.b = '')),
    scored as (select filename, field, coalesce(known, 'unknown') as format, similarity, similarity = 100 as correct from facts)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score_fields(evaluate.truth_rows(fx.truth(spark, sf)), fx.predictions(spark, sf))


@query(f"with recursive {SCORED} select filename, field, format, round(similarity, 6) as similarity, correct from scored")
def j7_score_fields(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).withColumn("similarity", F.round("similarity", 6))


TOTALS = """case when grouping(field) = 0 then 'field' when grouping(format) = 0 then 'format' else 'overall' end as level, count(*) as n,
    sum(correct::int)::bigint as n_correct, round(sum(round(similarity, 6)) / count(*), 4) as avg_similarity, round(avg(correct::int) * 100, 4) as exact_pct"""


@query(f"with recursive {SCORED} select field, format, {TOTALS} from scored group by grouping sets ((field), (format), ())")
def a7_accuracy_totals(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.totals(scored(spark, sf))


@query(f"with recursive {SCORED} select run, field, format, {TOTALS} from scored, (select unnest([1, 2, 2]) as run) group by grouping sets ((run, field), (run, format), (run))")
def a11_totals_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of three appended runs, the second of them twice: totals add up."""
    facts = scored(spark, sf)
    runs = spark.sql("select explode(array(1, 2, 2)) as run")
    return evaluate.totals(facts.crossJoin(F.broadcast(runs)), "run")


@query(
    f"""with recursive {SCORED}, t as (select field, format, {TOTALS} from scored group by grouping sets ((field), (format), ()))
    select level as section, coalesce(field, format, '') as ord, case level when 'field' then printf('%-30s: %.2f%%', field, avg_similarity)
           when 'format' then printf('%s: %d fields, exact %.2f%%, similarity %.2f%%', upper(format), n, exact_pct, avg_similarity)
           else printf('OVERALL: %d fields, exact %.2f%%, similarity %.2f%%', n, exact_pct, avg_similarity) end as line from t"""
)
def snk8_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report(scored(spark, sf))


# validation ------------------------------------------------------------------------------------------------------


@query(
    f"""with {fx.REPLIES}, bare as (select key, {SQL_BODY} as body from replies),
    parsed as (select key, case when json_valid(body) and json_type(try_cast(body as json)) = 'OBJECT' then try_cast(body as json) end as j from bare)
    select key, case when j is null then 'failed' else 'success' end as status,
           case when j is null then null when json_extract_string(j, '$.insurer_name') = '' then 'Unknown' else json_extract_string(j, '$.insurer_name') end as insurer_name,
           case when j is not null then list_extract(['01/02/2024', '01/02/2024', '', '05/01/1975', '', '03/03/2021', '02/03/2021'], (key % 7 + 1)::int) end as date_of_birth,
           case when j is not null then list_extract(['2782123456', '', '0123456789', ''], (key % 4 + 1)::int) end as cell_phone,
           case when j is not null then list_extract(['a@b.c', '', '', ''], (key % 4 + 1)::int) end as email,
           case when j is null then null when key % 3 = 0 then '' else 'R ' || key end as total_premium,
           case when j is null then null when json_extract_string(j, '$.insurer_name') = '' then 'insurer_name' else '' end as missing from parsed"""
)
def v1_validate_life(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.replies(spark, sf).withColumn("record", extract.parse_reply(F.col("reply")))
    checked = extract.validate(rows, "life")
    return checked.select("key", "status", "insurer_name", "date_of_birth", "cell_phone", "email", "total_premium", F.array_join("errors", ",").alias("missing"))


@query(
    "select * from (values " + ", ".join(
        f"('{kind}', {i}, '{f.name}', '{f.format}', {str(f.required).lower()})" for kind, fields in extract.FIELDS.items() for i, f in enumerate(fields)
    ) + ") as t(doc_type, ordinal, name, format, required)"
)
def v5_field_specs(spark: SparkSession, sf: str) -> DataFrame:
    return extract.field_specs(spark)


# video -----------------------------------------------------------------------------------------------------------


@query(
    """with v as (select o_orderkey as video_id, 23.5 + o_orderkey % 4 * 0.5 as fps, floor(o_totalprice / 100)::bigint as total_frames from orders),
    s as (select video_id, fps, total_frames, unnest(range(0, floor(total_frames / fps)::bigint + 1, 2)) as t from v where total_frames > 0)
    select video_id, t, round_even(t * fps, 0)::bigint as frame_idx from s where round_even(t * fps, 0) < total_frames"""
)
def st1_sample_times(spark: SparkSession, sf: str) -> DataFrame:
    videos = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"), (F.lit(23.5) + F.col("o_orderkey") % 4 * 0.5).alias("fps"), F.floor(F.col("o_totalprice") / 100).alias("total_frames")
    )
    return video.sample_times(videos)


ZONES = """zones as (select video_id, t, ssim, text, lag(t) over (partition by video_id order by t) as previous_t,
    case when lag(t) over (partition by video_id order by t) is null then 'first' when ssim > 0.90 then 'skip' when ssim < 0.85 then 'change' else 'fuzzy' end as zone from frames)"""


@query(f"with {fx.FRAMES}, {ZONES} select video_id, t, ssim, previous_t, zone from zones")
def st2_gate_frames(spark: SparkSession, sf: str) -> DataFrame:
    return video.gate_frames(fx.frames(spark, sf)).select("video_id", "t", "ssim", "previous_t", "zone")


@query(
    f"""with recursive {fx.FRAMES}, {ZONES}, numbered as (select *, row_number() over (partition by video_id order by t) as k from zones),
    walk as (
        select video_id, t, k, zone, text, true as kept, text as last from numbered where k = 1
        union all
        select n.video_id, n.t, n.k, n.zone, n.text, n.zone <> 'skip' and not (n.zone = 'fuzzy' and n.text = w.last),
               case when n.zone <> 'skip' and not (n.zone = 'fuzzy' and n.text = w.last) then n.text else w.last end
        from walk w join numbered n on n.video_id = w.video_id and n.k = w.k + 1)
    select video_id, t, zone, kept from walk"""
)
def w2_keep_frames(spark: SparkSession, sf: str) -> DataFrame:
    return video.keep_frames(video.gate_frames(fx.frames(spark, sf)).drop("previous_t")).select("video_id", "t", "zone", "kept")


# sinks and streams -----------------------------------------------------------------------------------------------


@query(
    """select o_orderkey as key, 'doc_' || o_orderkey || '.pdf' as filename, case o_orderkey % 3 when 0 then 'life' when 1 then 'car' else 'travel' end as doc_type,
    strftime(o_orderdate, '%Y-%m-%d') as created from orders order by o_orderdate desc, o_orderkey desc limit 100"""
)
def o5_latest_results(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("id"), F.concat(F.lit("doc_"), k.cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(k % 3 == 0, "life").when(k % 3 == 1, "car").otherwise("travel").alias("doc_type"), F.col("o_orderdate").alias("created_at"),
    )
    return results.latest_of(rows).select(F.col("id").alias("key"), "filename", "doc_type", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(
    """select 'doc_' || c_custkey as filename, 'car' as doc_type, 'success' as status, '{"name":"' || c_name || '"}' as extracted_data,
    case when c_custkey % 2 = 0 then '{"m":1}' else '{}' end as meta_data from customer"""
)
def snk1_result_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    meta = F.when(k % 2 == 0, F.create_map(F.lit("_extraction_meta"), F.lit('{"m":1}'))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("doc_"), k.cast("string")).alias("filename"), F.lit("car").alias("doc_type"), F.lit("success").alias("status"),
        F.map_concat(F.create_map(F.lit("name"), F.col("c_name")), meta).alias("extracted"), F.timestamp_seconds(k).alias("created_at"),
    )
    return results.result_rows(rows).drop("id", "created_at")


@query(
    f"""with {fx.BLOCKS}, pages as (select distinct doc_id, page_number, case when doc_id % 2 = 0 then 'pdf' else 'image' end as document_type from blocks),
    flags as (select doc_id, bool_or(source = 'embedded') and bool_or(source = 'ocr') as both_ from blocks group by 1),
    files as (select p.doc_id, p.page_number, unnest(case when p.document_type = 'pdf' and f.both_ then ['embedded', 'ocr'] else ['merged'] end) as suffix from pages p join flags f on p.doc_id = f.doc_id)
    select f.doc_id, f.page_number, f.suffix, b.block_idx, b.source, b.text from files f
    left join blocks b on b.doc_id = f.doc_id and b.page_number = f.page_number and (f.suffix = 'merged' or f.suffix = b.source)"""
)
def snk4_output_files(spark: SparkSession, sf: str) -> DataFrame:
    blocks = fx.blocks(spark, sf)
    pages = blocks.select("doc_id", "page_number").distinct().withColumn("document_type", F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("image"))
    return results.output_files(blocks, pages)


@query("select event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) as frame from events")
def snk6_event_frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", results.event_frame(F.col("event_type"), F.col("props")).alias("frame"))


@query(
    f"with recursive {SCORED} select field, count(*) as n, sum(correct::int)::bigint as n_correct, round(sum(similarity), 3) as similarity from scored group by 1"
)
def st7_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.running_totals(scored(spark, sf)).withColumn("similarity", F.round("similarity", 3))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: tumbling windows (the batch plan of the streaming job)."""
    rows = jobs.event_windows(table(spark, sf, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


LISTED = f"""{fx.FILES}, listed as (select distinct translate(lower(filename), '_+ ', '') as k from files where key % 5 <> 0),
    marked as (select f.key, f.filename, l.k is not null as matched from files f left join listed l on translate(lower(f.filename), '_+ ', '') = l.k)"""


@query(f"with {LISTED} select key, filename from marked where not matched")
def j8_unmatched_files(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.files(spark, sf)
    return routing.with_prediction(files, files.filter("key % 5 <> 0"), wanted=False).select("key", "filename")


@query(f"with {LISTED} select key, filename from marked where matched order by filename limit 50")
def o6_first_matched_files(spark: SparkSession, sf: str) -> DataFrame:
    """Unmatched files don't count."""
    files = fx.files(spark, sf)
    return routing.first_files(routing.with_prediction(files, files.filter("key % 5 <> 0"))).select("key", "filename")


@query(
    f"""with {fx.REPLIES}, bare as (select key, list_extract(['life', 'car', 'boat', 'property'], (key % 4 + 1)::int) as doc_type, {SQL_BODY} as body from replies),
    parsed as (select *, json_valid(body) and json_type(try_cast(body as json)) = 'OBJECT' as ok from bare)
    select doc_type, case when ok and doc_type <> 'boat' then 'success' else 'failed' end as status, count(*) as n,
           sum(case when not ok or doc_type = 'boat' then 0 else case doc_type when 'life' then 18 when 'car' then 25 else 22 end end)::bigint as n_fields from parsed group by all"""
)
def v6_status_by_type(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["life", "car", "boat", "property"])), (F.col("key") % 4).cast("int"))
    rows = fx.replies(spark, sf).select(kind.alias("doc_type"), extract.parse_reply(F.col("reply")).alias("record"))
    done = extract.validate_mixed(rows)
    return done.groupBy("doc_type", "status").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size(F.map_keys("extracted")), F.lit(0)).cast("long")).alias("n_fields"))


@query(
    """with t as (select p_partkey as key, lower(p_name) as a, lower(case p_partkey % 3 when 0 then left(p_name, 5) when 1 then p_name || 's' else p_brand end) as b from part)
    select key, least(length(a), length(b)) >= 3 and (starts_with(a, b) or starts_with(b, a)) as variant from t"""
)
def x6_prefix_variants(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    b = F.when(k % 3 == 0, F.substring("p_name", 1, 5)).when(k % 3 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_brand"))
    rows = table(spark, sf, "part").select(k.alias("key"), F.lower("p_name").alias("a"), F.lower(b).alias("b"))
    return rows.select("key", clean.prefix_variant(F.col("a"), F.col("b")).alias("variant"))


from foliate.plans import short  # noqa: E402, F401  (registers its queries)
