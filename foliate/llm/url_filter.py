"""URL rule lists by hashed expressions (native: SQL functions only).

Each URL is expanded into host-suffix + path-prefix expressions, the expressions are equi-joined with the
rules on a short prefix of their SHA-256 digests, and the hits are confirmed on the full digest before the
longest rule decides. A host suffix goes on only if some rule has it for its host, and then with the path prefixes
of the lengths that this host's rules have, so a URL yields no more expressions than its hosts have rules of different
lengths, however many rules or shapes of rules there are in all.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; a URL of any length is
parsed whole; repeated rows are judged alike and all returned; extra columns are carried along, whatever their names
(host, path, rule and verdict are replaced); an empty table gives an empty table, and without rules all get the default;
a null rule host or path is ignored; of equal rules (ties) a block wins over an allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliate.functions.columns import fresh
from foliate.runtime import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_BYTES = 8 << 20  # a rule table is broadcast below this size, counted before
HOT_KEYS, SALTS = 1000, 64  # a key that holds more than one in HOT_KEYS of all rows is dealt to SALTS tasks


def parse(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(rules: DataFrame) -> DataFrame:
    """host, path, verdict -> one row per expression, with its digest, short hash and precedence."""
    return (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .withColumn("rule", F.concat("host", "path"))
        .groupBy("host", "path", "rule")
        .agg(F.max("verdict").alias("rule_verdict"))  # block > allow
        .withColumn("path_len", F.length("path"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )


def hot_keys(heads: DataFrame, key: Column, total: int) -> DataFrame:
    """__hot: hashes of the keys that hold more than one in HOT_KEYS of all ``total`` rows, so fewer than HOT_KEYS."""
    return F.broadcast(heads.filter(F.col("n") * HOT_KEYS > total).select(key.alias("__hot")).distinct())


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``urls``; longest fitting rule wins, else ``default``."""
    table = materialise(rule_table(rules))
    size, reach = table.agg(F.coalesce(F.sum(F.octet_length("rule") + 96), F.lit(0)), F.coalesce(F.max("path_len"), F.lit(0))).first()
    small = F.broadcast if size <= RULES_BYTES else lambda df: df
    urls = urls.drop(*[c for c in urls.columns if c.lower() in ("host", "path", "rule", "verdict")])  # these are replaced
    head, key, salt, flag, of_host, of_head, of_salt = fresh(urls.columns, "__head", "__key", "__salt", "__flag", "__of_host", "__of_head", "__of_salt")
    host, path = parse(F.col(url_col))
    judged = urls.withColumn("host", host).withColumn("path", path).withColumn(head, F.substring("path", 1, reach))

    # One row for each distinct host and path head: a hot host or a repeated URL is expanded and joined once.
    heads = materialise(judged.filter(F.col("host") != "").groupBy("host", F.col(head).alias("head")).agg(F.count("*").alias("n")))
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    ends = heads.select("host", "head", F.explode(suffixes).alias("suffix"))
    lengths = table.groupBy(F.col("host").alias("suffix")).agg(F.collect_set("path_len").alias("lengths"))
    ends = ends.join(small(lengths), "suffix")
    sent = ends.withColumn("length", F.explode("lengths")).filter(F.length("head") >= F.col("length"))
    sent = sent.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", F.expr("substring(head, 1, length)")), 256))
    sent = sent.select("host", "head", "digest", F.substring("digest", 1, 8).alias("short"))
    known = table.select("short", F.col("digest").alias("full"), "rule", "rule_verdict", F.length("host").alias("host_len"))
    hits = sent.join(small(known), "short").filter(F.col("digest") == F.col("full"))
    won = hits.groupBy("host", "head").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule_verdict", "rule")).alias("won")
    )
    # rows of a hot key go to SALTS tasks by the task they come from, and its verdict to each of them
    hot = hot_keys(heads, F.xxhash64("host", "head"), total)
    won = won.withColumn("key", F.xxhash64("host", "head")).join(hot, F.col("key") == F.col("__hot"), "left")
    won = won.withColumn("salt", F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    won = won.select(
        F.col("host").alias(of_host), F.col("head").alias(of_head), F.col("salt").alias(of_salt), F.col("won.rule").alias("rule"), F.col("won.rule_verdict").alias("verdict")
    )
    judged = judged.withColumn(key, F.xxhash64("host", head)).join(hot.withColumnRenamed("__hot", flag), F.col(key) == F.col(flag), "left")
    judged = judged.withColumn(salt, F.when(F.col(flag).isNull(), 0).otherwise(F.pmod(F.spark_partition_id(), F.lit(SALTS))))
    same = (F.col("host") == F.col(of_host)) & (F.col(head) == F.col(of_head)) & (F.col(salt) == F.col(of_salt))
    out = judged.join(won, same, "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.drop(head, key, salt, flag, of_host, of_head, of_salt)
