"""Every query that has SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliate.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    left = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    right = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert left == right


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id", "document_text"]


def test_every_query_without_sql_is_listed():
    without = {q for q in registry.QUERIES if q not in registry.ORACLES}
    assert without == {
        "x3_unicode_repair", "x5_domain_snap", "f8_garbage", "f13_word_likeness", "t1_merge_words", "t2_pair_labels", "t3_merge_wrapped",
        "j1_duplicate_pairs", "j4_drop_duplicates", "clean_documents", "x23_frame_similarity",
    }


def test_word_likeness_scores_every_block(spark):
    from foliate.plans import fixtures as fx

    key = ("doc_id", "page_number", "block_idx")
    want = sorted(tuple(r) for r in fx.blocks(spark, SF).select(*key).collect())
    got = registry.QUERIES["f13_word_likeness"](spark, SF).collect()
    assert sorted(tuple(r[c] for c in key) for r in got) == want
    assert all(0 <= r.word_score <= 100 for r in got)
