"""The query of each operator, and its SQL where SQL can express it. Each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliate.runtime import ensure_worker_imports, table

SHARD_LIMIT = 2 << 20
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
REPEATS = 2.0
CONTROL = r"\### Assistant: </turn> ok"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    shards = assign_shards(table(spark, sf_dir, "documents"), ["doc_id"], SHARD_LIMIT)
    return shards.select("doc_id", "n_bytes", "shard", "shard_bytes", "oversized")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs.withColumn("held_out", held_out("doc_id")), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    rules = spark.sql(f"select * from values {', '.join(map(str, RULES))} as rules(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest

    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, i, role, CONTROL) for i, role in enumerate(("user", "assistant"))], rows.schema)
    return read_back(format_conversations(rows.unionByName(more), tokenizer_path()), tokenizer_path(), in_order=True)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, repeats_within

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, repeats_within(REPEATS)).drop("text")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_url_filters, op4_ngram_jaccard, op5_bpe, op6_chat_formatting, op7_fingerprints, op8_line_dedup, op9_nearest, op10_mixing)}

SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
ORACLES = {
    "op1_sharding": f"""
        with rows as (
            select doc_id, coalesce(strlen(text), 0) as n, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 15))::bigint as code from documents),
        cells as (select d.depth, r.code >> (60 - d.depth)::int as prefix, sum(r.n) as bytes
                  from rows r, (select unnest(range(0, 61)) as depth) d group by all),
        leaf as (select r.doc_id, r.n, r.code, min(c.depth) as depth
                 from rows r join cells c on c.prefix = r.code >> (60 - c.depth)::int and c.bytes <= {SHARD_LIMIT} group by all)
        select l.doc_id, l.n::bigint as n_bytes,
               l.depth || '-' || case when l.depth = 0 then '' else substr(lpad(bin(l.code), 60, '0'), 1, l.depth::int) end as shard,
               c.bytes::bigint as shard_bytes, false as oversized
        from leaf l join cells c on c.depth = l.depth and c.prefix = l.code >> (60 - l.depth)::int""",
    "op3_url_filters": """
        with parsed as (
            select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        split as (
            select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parsed),
        rules(rhost, rpath, rverdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        hits as (
            select s.page_id, rhost || rpath as rule, rverdict,
                   row_number() over (partition by s.page_id order by length(rhost || rpath) desc) as k
            from split s join rules on (s.host = rhost or ends_with(s.host, '.' || rhost)) and starts_with(s.path, rpath))
        select s.page_id, s.host, s.path, h.rule, coalesce(h.rverdict, 'allow') as verdict
        from split s left join hits h on h.page_id = s.page_id and h.k = 1""",
    "op8_line_dedup": f"""
        with lines as (
            select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos,
                   unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
        keyed as (select *, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
        dup as (select key, min(doc_id) as keeper from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
        marked as (select k.*, d.key is not null and k.doc_id <> d.keeper as lost from keyed k left join dup d on k.key = d.key)
        select doc_id, count(*)::bigint as n_lines, (count(*) filter (where lost))::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
        from marked group by doc_id""",
}
