"""Queries on short texts, where SQL can compute similarities on whole tables, and those of page assembly and prompts.

The similarity's common subsequence is computed in SQL a character of ``b`` at a time, with a bit per character of ``a``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliate.config import CLASSIFY_CHARS, CLASSIFY_LLM_CHARS, CORRECTIONS, FIELDS, CleanConfig
from foliate.functions import text as X
from foliate.operators import classify, clean, extract, layout, video
from foliate.plans import fixtures as fx
from foliate.plans.registry import PAGE_COLUMNS, SQL_KEYWORDS, query, r
from foliate.runtime import table
from foliate.sinks import results
from foliate.sources import pages, providers

CFG = CleanConfig()
STRIP = r"regexp_replace({}, '^[\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ]+$', '', 'g')"

# names: short blocks of orders, some of them misread, with twins from another source -----------------------------

HEADS = ("Policy Number", "Mutral Insure", "(Premiun) Amount", "registraton numbar,", "qwzx kjvb", "x9-77/b", "Insurer Adress:", "Payment Metod", "--", "é", "month Monthly", "P57 Lad")
NAMES = f"""names as (
    select (o_orderkey // 40)::bigint as doc_id, 1 as page_number, (2 * (o_orderkey % 40))::int as block_idx, 'embedded' as source,
           list_extract({list(HEADS)!r}, (o_orderkey % 12 + 1)::int) || case when o_orderkey % 12 in (5, 8, 9) then '' else ' ' || o_orderpriority end as text,
           (40 + 150 * (o_orderkey % 4))::double as x0, (50 + 20 * (o_orderkey % 40 // 4))::double as y0, (150 + 150 * (o_orderkey % 4))::double as x1,
           (60 + 20 * (o_orderkey % 40 // 4) + case when o_orderkey % 11 = 0 then 40 else 0 end)::double as y1, 0.5 + (7 * o_orderkey % 50) / 100.0 as confidence, o_orderkey as k from orders),
blocks as (
    select doc_id, page_number, block_idx, source, text, x0, y0, x1, y1, confidence from names
    union all
    select doc_id, page_number, block_idx + 1, 'ocr', case when k % 3 = 0 then replace(text, 'e', 'c') when k % 3 = 1 then upper(text) else left(text, 6) || ' other words' end,
           x0 + k % 5 * 9, y0 + 1, x1 + k % 5 * 9, y1 + 1, 0.4 + (13 * k % 60) / 100.0 from names where k % 2 = 0)"""


def names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    head = F.get(F.array(*map(F.lit, HEADS)), (k % 12).cast("int"))
    row, column = F.floor(k % 40 / 4), k % 4
    own = table(spark, sf, "orders").select(
        F.floor(k / 40).alias("doc_id"), F.lit(1).alias("page_number"), (k % 40 * 2).cast("int").alias("block_idx"), F.lit("embedded").alias("source"),
        F.concat(head, F.when((k % 12).isin(5, 8, 9), "").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))).alias("text"),
        (column * 150 + 40).cast("double").alias("x0"), (row * 20 + 50).cast("double").alias("y0"), (column * 150 + 150).cast("double").alias("x1"),
        (row * 20 + 60 + F.when(k % 11 == 0, 40).otherwise(0)).cast("double").alias("y1"), (F.lit(0.5) + k * 7 % 50 / 100.0).alias("confidence"), k.alias("k"),
    )
    k = F.col("k")
    misread = F.when(k % 3 == 0, F.replace("text", F.lit("e"), F.lit("c"))).when(k % 3 == 1, F.upper("text")).otherwise(F.concat(F.substring("text", 1, 6), F.lit(" other words")))
    twin = own.filter("k % 2 = 0").select(
        "doc_id", "page_number", (F.col("block_idx") + 1).alias("block_idx"), F.lit("ocr").alias("source"), misread.alias("text"),
        (F.col("x0") + k % 5 * 9).alias("x0"), (F.col("y0") + 1).alias("y0"), (F.col("x1") + k % 5 * 9).alias("x1"), (F.col("y1") + 1).alias("y1"),
        (F.lit(0.4) + k * 13 % 60 / 100.0).alias("confidence"),
    )
    return own.drop("k").unionByName(twin)


def sql_similarity(todo: str) -> str:
    """CTEs that give ``ratios`` (a, b, similarity) of the distinct pairs ``todo`` (a, b), a of 126 characters at most."""
    return f"""
    asked as (select distinct a, b from ({todo}) where a <> '' and b <> ''),
    marks as (select a, substr(a, i, 1) as c, sum(1::hugeint << (i - 1)::int)::hugeint as m
              from (select a, unnest(range(1, length(a) + 1)) as i from (select distinct a from asked)) group by all),
    steps as (
        select a, b, 0 as i, (1::hugeint << length(a)::int) - 1 as v from asked
        union all
        select s.a, s.b, s.i + 1, case when m.m is null then s.v else ((s.v + (s.v & m.m)) | (s.v - (s.v & m.m))) & ((1::hugeint << length(s.a)::int) - 1) end
        from steps s left join marks m on m.a = s.a and m.c = substr(s.b, s.i + 1, 1) where s.i < length(s.b)),
    ratios as (select a, b, 200.0::double * (length(a) - bit_count(v)) / (length(a) + length(b)) as similarity from steps where i = length(b))"""


IOU = """greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as inter,
    (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as areas"""
DUPLICATES = f"""{NAMES}, met as (
        select a.doc_id, a.page_number, a.block_idx as i, b.block_idx as j, lower(a.text) as a, lower(b.text) as b, {IOU},
               case when a.source = 'embedded' and b.source <> 'embedded' then b.block_idx when b.source = 'embedded' and a.source <> 'embedded' then a.block_idx
                    when a.confidence >= b.confidence then b.block_idx else a.block_idx end as loser
        from blocks a join blocks b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.block_idx < b.block_idx and a.source <> b.source),
    near as (select * from met where inter > 0 and inter / (areas - inter) >= 0.5), {sql_similarity('select a, b from near')},
    same as (select n.doc_id, n.page_number, i, j, similarity, loser from near n join ratios using (a, b) where similarity >= 80)"""


@query(f"with recursive {DUPLICATES} select doc_id, page_number, i, j, round(similarity, 6) as similarity, loser from same")
def j1_duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_pairs(names(spark, sf)).select("doc_id", "page_number", "i", "j", r("similarity"), "loser")


@query(
    f"""with recursive {DUPLICATES} select b.doc_id, b.page_number, b.block_idx, b.source from blocks b
    where not exists (select 1 from same s where s.doc_id = b.doc_id and s.page_number = b.page_number and s.loser = b.block_idx)"""
)
def j4_drop_duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_duplicates(names(spark, sf)).select(*PAGE_COLUMNS, "source")


CODE = r"regexp_full_match({0}, '[A-Za-z0-9]+([\-/.][A-Za-z0-9]+)*') and regexp_matches({0}, '[A-Za-z]') and regexp_matches({0}, '[0-9]')"
WORD_SCORES = f"""{NAMES}, real_words as (select unnest({CFG.real_words()!r}) as word),
    tokens as (select doc_id, page_number, block_idx, unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) > 2)) as token
               from blocks where not ({CODE.format('trim(text)')})),
    {sql_similarity('select word as a, token as b from real_words, (select distinct lower(token) as token from tokens)')},
    best as (select b as token, max(similarity) as best from ratios group by 1),
    scores as (select doc_id, page_number, block_idx, avg(best) as score from tokens join best on lower(tokens.token) = best.token group by all),
    scored as (select b.*, coalesce(s.score, 100.0) as word_score from blocks b left join scores s using (doc_id, page_number, block_idx))"""


@query(f"with recursive {WORD_SCORES} select doc_id, page_number, block_idx, round(word_score, 6) as word_score from scored")
def f13_word_likeness_of_names(spark: SparkSession, sf: str) -> DataFrame:
    return clean.word_likeness(names(spark, sf)).select(*PAGE_COLUMNS, r("word_score"))


@query(
    f"""with recursive {WORD_SCORES}, heights as (select doc_id, page_number, list_sort(list(y1 - y0) filter (where y1 > y0)) as h from blocks group by all),
    typical as (select doc_id, page_number, coalesce(h[len(h) // 2 + 1], 0.0) as usual from heights)
    select doc_id, page_number, block_idx, (length(trim(text)) <= 8 and usual > 0 and y1 - y0 > 2.5 * usual and confidence < 0.9)
        or trim(text) = '' or regexp_full_match(trim(text), '[^A-Za-z0-9]{{1,2}}') or (word_score < 60 and confidence < 0.7) as garbage
    from scored join typical using (doc_id, page_number)"""
)
def f8_garbage_names(spark: SparkSession, sf: str) -> DataFrame:
    return clean.garbage(names(spark, sf)).select(*PAGE_COLUMNS, "garbage")


TERMS = ", ".join(f"({i}, '{low}', '{own}')" for i, (low, own) in enumerate(CFG.dictionary().items()))


@query(
    f"""with recursive {NAMES}, fixes(misread, fixed) as (values {', '.join(f"('{a}', '{b}')" for a, b in CORRECTIONS.items())}),
    terms(ord, word, own) as (values {TERMS}),
    tokens as (select doc_id, page_number, block_idx, unnest(string_split(text, ' ')) as token, generate_subscripts(string_split(text, ' '), 1) as at_ from blocks),
    parts as (select distinct token, lower(regexp_replace(token, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) as bare, regexp_extract(token, '^[^\\p{{L}}\\p{{N}}_]*', 0) as lead,
                     regexp_extract(token, '[^\\p{{L}}\\p{{N}}_]*$', 0) as trail from tokens),
    {sql_similarity("select word as a, bare as b from terms, parts where regexp_full_match(bare, '[[:alpha:]é]{3,}')")},
    nearest as (select b as bare, arg_min((word, own), (-similarity, ord)) as t, max(similarity) as s from ratios join terms on a = word group by 1),
    mended as (
        select p.token, coalesce(w.fixed, p.lead || f.fixed || p.trail, case when n.s >= 75 and n.t[1] <> p.bare
                   and not (starts_with(n.t[1], p.bare) or starts_with(p.bare, n.t[1])) then p.lead || n.t[2] || p.trail end, p.token) as done
        from parts p left join fixes w on w.misread = lower(p.token) left join fixes f on f.misread = p.bare left join nearest n on n.bare = p.bare)
    select doc_id, page_number, block_idx, string_agg(done, ' ' order by at_) as text from tokens join mended using (token) group by all"""
)
def x5_snap_names(spark: SparkSession, sf: str) -> DataFrame:
    return clean.snap(names(spark, sf), PAGE_COLUMNS).select(*PAGE_COLUMNS, "text")


# rows of a label and its values: each value is in reach of one label
ROWS = """rows_ as (
    select (o_orderkey // 80)::bigint as doc_id, 1 as page_number, (o_orderkey % 80)::int as block_idx, case when o_orderkey % 3 = 0 then 'ocr' else 'embedded' end as source,
           case o_orderkey % 4 when 0 then 'Label ' || o_orderkey || ': ' else o_orderpriority || o_orderkey end as text,
           (case o_orderkey % 4 when 0 then 40 when 1 then 320 else 200 end)::double as x0,
           (30 * (o_orderkey % 80 // 4) + case when o_orderkey % 4 = 3 then 15 else 0 end + 0.7 * (o_orderkey % 3))::double as y0,
           (case o_orderkey % 4 when 0 then 120 when 1 then 400 else 300 end)::double as x1 from orders)"""


@query(
    f"""with {ROWS}, met as (
        select l.doc_id, l.block_idx as label, v.block_idx as value, v.text, v.x0 from rows_ l join rows_ v on l.doc_id = v.doc_id and l.block_idx <> v.block_idx
            and l.block_idx % 4 = 0 and abs(l.y0 - v.y0) <= 3 and v.x0 >= l.x1),
    said as (select doc_id, label, string_agg(text, ' ' order by x0) as text from met group by all)
    select r.doc_id, r.page_number, r.block_idx, r.source, case when s.text is null then r.text else rtrim(r.text) || ' ' || s.text end as text
    from rows_ r left join said s on s.doc_id = r.doc_id and s.label = r.block_idx
    where not exists (select 1 from met m where m.doc_id = r.doc_id and m.value = r.block_idx)"""
)
def t2_pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = k % 4
    rows = table(spark, sf, "orders").select(
        F.floor(k / 80).alias("doc_id"), F.lit(1).alias("page_number"), (k % 80).cast("int").alias("block_idx"), F.when(k % 3 == 0, "ocr").otherwise("embedded").alias("source"),
        F.when(kind == 0, F.concat(F.lit("Label "), k.cast("string"), F.lit(": "))).otherwise(F.concat("o_orderpriority", k.cast("string"))).alias("text"),
        F.when(kind == 0, 40.0).when(kind == 1, 320.0).otherwise(200.0).alias("x0"),
        (F.floor(k % 80 / 4) * 30 + F.when(kind == 3, 15).otherwise(0) + k % 3 * 0.7).alias("y0"), F.when(kind == 0, 120.0).when(kind == 1, 400.0).otherwise(300.0).alias("x1"),
    )
    return layout.pair_labels(rows.withColumn("y1", F.col("y0") + 10).withColumn("confidence", F.lit(1.0))).select(*PAGE_COLUMNS, "source", "text")


# page assembly ---------------------------------------------------------------------------------------------------

TUPLES = """tuples as (
    select o_orderkey // 30 as doc_id, (1 + o_orderkey % 30 // 10)::int as page_number, (o_orderkey % 10)::int as idx, (3 + o_orderkey % 6)::int as fields, (o_orderkey % 3)::int as kind,
           case o_orderkey % 5 when 0 then chr(160) || ' ' when 1 then chr(9) || o_orderpriority || chr(10) else o_orderpriority || ' ' || o_clerkless end as text,
           (o_orderkey % 7 * 30)::double as x0 from (select *, o_orderstatus as o_clerkless from orders))"""
ADMITTED = f"admitted as (select doc_id, page_number, idx, {STRIP.format('text')} as text, x0 from tuples where fields >= 5 and {STRIP.format('text')} <> '')"
REGIONS = """regions as (
    select o_orderkey // 30 as doc_id, (1 + o_orderkey % 30 // 10)::int as page_number, (o_orderkey % 10)::int as region,
           case when o_orderkey % 6 = 3 then null else o_orderkey % 50 end::double as x0, 10.0::double as y0, (o_orderkey % 50 + (o_orderkey % 6 - 1) * 20)::double as x1,
           case when o_orderkey % 6 = 4 then 10.0 else 60.0 end::double as y1 from orders)"""


def tuples(spark: SparkSession, sf: str) -> DataFrame:
    k, pri = F.col("o_orderkey"), F.col("o_orderpriority")
    text = F.when(k % 5 == 0, "\xa0 ").when(k % 5 == 1, F.concat(F.lit("\t"), pri, F.lit("\n"))).otherwise(F.concat(pri, F.lit(" "), F.col("o_orderstatus")))
    return table(spark, sf, "orders").select(
        F.floor(k / 30).alias("doc_id"), (F.floor(k % 30 / 10) + 1).cast("int").alias("page_number"), (k % 10).cast("int").alias("idx"), (k % 6 + 3).cast("int").alias("fields"),
        (k % 3).cast("int").alias("kind"), text.alias("text"), (k % 7 * 30).cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(9.0).alias("y1"),
    )


def image_regions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    n, q = k % 6, (k % 50).cast("double")
    return table(spark, sf, "orders").select(
        F.floor(k / 30).alias("doc_id"), (F.floor(k % 30 / 10) + 1).cast("int").alias("page_number"), (k % 10).cast("int").alias("region"),
        F.when(n != 3, q).alias("x0"), F.lit(10.0).alias("y0"), (q + (n - 1) * 20).alias("x1"), F.when(n == 4, 10.0).otherwise(60.0).alias("y1"),
    )


@query(f"with {TUPLES}, {ADMITTED} select doc_id, page_number, idx as block_idx, 'embedded' as source, text, x0, 1.0::double as confidence from admitted")
def src4_pdf_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.embedded_blocks(tuples(spark, sf)).select(*PAGE_COLUMNS, "source", "text", "x0", "confidence")


@query(f"with {REGIONS} select doc_id, page_number, region, x0 from regions where x0 is not null and x1 > x0 and y1 > y0")
def f3_image_regions(spark: SparkSession, sf: str) -> DataFrame:
    return pages.real_regions(image_regions(spark, sf)).select("doc_id", "page_number", "region", "x0")


@query(
    f"""with {TUPLES}, {ADMITTED}, {REGIONS}, chars as (select doc_id, page_number, sum(length(text)) as chars from admitted group by all),
    read_ as (select r.doc_id, r.page_number, region, x0 from regions r left join chars c using (doc_id, page_number) where x0 is not null and x1 > x0 and y1 > y0 and coalesce(chars, 0) < 50),
    both_ as (select doc_id, page_number, 0 as branch, idx as at_, 'embedded' as source, text, x0 from admitted
              union all select doc_id, page_number, 1, region, 'ocr', 'r' || region, x0 + 5 * 72 / 150.0 from read_)
    select doc_id, page_number, (row_number() over (partition by doc_id, page_number order by branch, at_) - 1)::int as block_idx, source, text, round(x0, 6) as x0 from both_"""
)
def u1_embedded_and_recognised(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with little embedded text have their image regions read; embedded blocks come first."""
    embedded = pages.embedded_blocks(tuples(spark, sf))
    asked = pages.regions_to_read(image_regions(spark, sf), embedded)
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    words = asked.select(
        "doc_id", "page_number", "region", F.lit(0).alias("word_idx"), F.concat(F.lit(" r"), F.col("region").cast("string")).alias("text"),
        F.array(corner(5, 1), corner(25, 9)).alias("vertices"), F.lit(0.9).alias("confidence"),
    )
    both = pages.embedded_and_recognised(embedded, pages.region_words(words, asked))
    return both.select(*PAGE_COLUMNS, "source", "text", r("x0"))


# prompts, classification, dispatch -------------------------------------------------------------------------------


@query(
    """with asked as (select o_orderkey as key, list_extract(['life', 'car', 'property', 'boat', 'health', 'travel'], (o_orderkey % 6 + 1)::int) as doc_type from orders)
    select key, doc_type, doc_type in ('life', 'car', 'travel', 'health') as has_prompt, case when doc_type in ('life', 'car', 'travel', 'health') then 'ready' else 'failed' end as status,
           case when doc_type in ('life', 'car', 'travel', 'health') then 'text ' || key end as tail from asked"""
)
def j9_prompts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("life", "car", "property", "boat", "health", "travel"))), (k % 6).cast("int"))
    rows = table(spark, sf, "orders").select(k.alias("key"), kind.alias("doc_type"), F.concat(F.lit("text "), k.cast("string")).alias("text"))
    asked = extract.with_prompts(rows)
    tail = F.element_at(F.split("prompt", "\n"), -1)
    return asked.select("key", "doc_type", F.col("prompt").isNotNull().alias("has_prompt"), "status", tail.alias("tail"))


@query(
    "select * from (values " + ", ".join(f"('{kind}', {len(FIELDS[kind])})" for kind in extract.PROMPTED) + ") as t(doc_type, n_fields)"
)
def src18_prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    """One prompt per type, naming all of the type's fields."""
    rows = extract.prompt_table(spark)
    named = F.size(F.regexp_extract_all("template", F.lit(r'(?m)^  "([a-z_]+)": ""'), F.lit(1)))
    return rows.select("doc_type", named.alias("n_fields"))


@query(
    f"""with {fx.CLASSED}, lowered as (select doc_id, lower(left(text, {CLASSIFY_CHARS})) as low, length(left(text, {CLASSIFY_LLM_CHARS})) as n from classed),
    ruled as (select doc_id, n, case {SQL_KEYWORDS} else '' end as ruled from lowered)
    select doc_id, case when ruled <> '' then ruled when n % 3 = 0 then 'life' when n % 3 = 1 then 'health' else 'car' end as doc_type, ruled = '' as asked from ruled"""
)
def e10_model_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a keyword class go to the model (here a stand-in that fails for some lengths)."""

    def make():
        def post(payload):
            n = len(payload["messages"][-1]["content"])
            return (500, {}) if n % 3 == 0 else (200, {"choices": [{"message": {"content": '{"doc_type": "health"}' if n % 3 == 1 else "a car, I think"}}]})

        return providers.LanguageModel(post, "stand-in")

    return providers.classify_documents(fx.classed(spark, sf), "doc_id", make).select("doc_id", "doc_type", "asked")


@query(
    """with f as (select o_orderkey as key, list_extract(['pdf', 'png', 'mp4', 'doc', 'xyz'], (o_orderkey % 5 + 1)::int) as ext from orders)
    select key, case when ext in ('doc', 'xyz') then 'failed' else 'success' end as status, case when ext = 'xyz' then null when ext = 'mp4' then 'video' when ext = 'png' then 'image' else ext end as document_type,
           case when ext = 'pdf' then 2 when ext in ('png', 'mp4') then 1 else 0 end as total_pages, case ext when 'pdf' then 'True' when 'mp4' then 'frames' end as said from f"""
)
def src3_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Files by kind to stand-in readers, which see the options; kinds without a reader fail by row."""
    k = F.col("o_orderkey").cast("string")
    ext = F.get(F.array(*map(F.lit, ("pdf", "png", "mp4", "doc", "xyz"))), (F.col("o_orderkey") % 5).cast("int"))
    files = table(spark, sf, "orders").select(F.concat(F.lit("/in/"), k, F.lit("."), ext).alias("path"), F.lit(b"").alias("content"))
    readers = {kind: providers.stand_in(n) for kind, n in (("pdf", 2), ("image", 1), ("video", 1))}
    blocks = providers.process_files(files, readers, force_ocr=True, extraction_mode="frames")
    said = blocks.filter("page_number = 1").select(F.element_at(F.split("path", "/"), -1).alias("document_name"), "text")
    done = providers.document_rows(files, blocks).join(said, "document_name", "left")
    name = F.regexp_extract("document_name", r"(\d+)\.", 1).cast("long")
    text = F.when(F.col("document_type") == "pdf", F.split_part("text", F.lit("|"), F.lit(1))).when(F.col("document_type") == "video", F.split_part("text", F.lit("|"), F.lit(2)))
    return done.select(name.alias("key"), "status", "document_type", "total_pages", text.alias("said"))


@query(
    f"""with {NAMES}, kept as (select * from blocks where not (trim(text) = '' or regexp_full_match(trim(text), '[^A-Za-z0-9]{{1,2}}')))
    select doc_id, count(*)::bigint as total_blocks_before, (select count(*) from kept k where k.doc_id = b.doc_id)::bigint as total_blocks_after,
           (select string_agg(text, '|' order by block_idx) from kept k where k.doc_id = b.doc_id) as texts from blocks b group by doc_id"""
)
def snk5_cleaned_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks back to nested documents, with what cleaning did."""
    before = names(spark, sf)
    after = before.filter(~X.symbol_only(F.col("text"))).withColumn("position", F.col("block_idx"))
    done = results.cleaned_documents(before, after)
    texts = F.array_join(F.flatten(F.transform("pages", lambda p: F.transform(p["text_sources"], lambda b: b["text"]))), "|")
    return done.select("doc_id", "cleaning_metadata.total_blocks_before", "cleaning_metadata.total_blocks_after", F.when(texts != "", texts).alias("texts"))


@query(
    f"""with recursive s as (select conv_id as doc_id, turn::int as idx, chr(160) || chr(9) || case when turn % 4 = 3 then '' else text end || chr(10) as text from conversations)
    select doc_id, idx as block_idx, {STRIP.format('text')} as text from s where {STRIP.format('text')} <> ''"""
)
def f4_empty_segments(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.when(F.col("idx") % 4 == 3, "").otherwise(F.col("text"))
    segments = fx.segments(spark, sf).withColumn("text", F.concat(F.lit("\xa0\t"), blank, F.lit("\n")))
    return video.speech_blocks(segments).select("doc_id", "block_idx", "text")


@query()
def x23_frame_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of successive samples of grey frames, made from events (brute force in the tests)."""
    cycle = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.chr(F.pmod(i * (F.col("event_id") % 5 + 3) + F.col("event_id") % 7 * 9, F.lit(120)).cast("long")))
    pixels = F.left(F.repeat(F.array_join(cycle, ""), F.lit(7)), F.lit(24 * 32))
    frames = table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("t"), F.lit(24).alias("height"), F.lit(32).alias("width"), F.encode(pixels, "ISO-8859-1").alias("pixels"))
    return video.frame_similarity(frames).select("video_id", "t", r("ssim"))


