"""Line dedup, n-gram join, sharding, mixing, fingerprints, URL rules: brute force on small tables, and odd inputs."""

import hashlib
import math
import os
import random
import re
import struct
from collections import Counter, defaultdict, namedtuple

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from foliate.llm import copies, fingerprint, line_dedup, mixing, ngram_join, queries, sharding, url_filter
from foliate.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, TEXT2 string, n_lines int"
WORDS = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("the of É AND zu Ort x9 sea hill moon".split()) + str(rnd.randrange(40)) for _ in range(rnd.randrange(3, 60))) for _ in range(12)]
    shared = ["  A line that MANY share ", "another shared line here", "short", "ümlaut line shared"]
    rows = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(["edit", "Edit2", "\t"])
        lines = [" ".join(words)] + rnd.sample(shared, rnd.randrange(0, 4))
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), rnd.choice(["a", "a", "a", "b", None]), None, 5))
    rows += [(100, None, "b", "x", 1), (101, "", "c", None, None), (102, " \n\t ", None, None, 1), (None, base[0], "a", None, 1), (7, rows[7][1], rows[7][2], None, 5)]
    rows += [(103, "word " * 40_000, "long", None, 1), (104, "one two three", "b", None, 1), (105, "One  two\nthree", "b", None, 1)]
    return rows


def test_line_dedup_by_brute_force(spark):
    rows = corpus()
    owners = defaultdict(set)
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(ASCII_LOWER)
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    owners[key(line)].add(i)
    want = Counter()
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == want
    assert set(out.columns) == {"doc_id", "text", "source", "TEXT2", "n_lines", "n_dropped"}
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_with_more_documents(spark):
    rows = [(i, "a line shared by some" if i < 3 else "a line shared by two only") for i in range(5)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["a line shared by some", "", "", "a line shared by two only", "a line shared by two only"]


def grams(text, k=5):
    w = WORDS.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked_components(sets, percent=80):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [None, 2, 3, 4])
def test_ngram_join_by_brute_force(spark, monkeypatch, hot):
    if hot:  # long columns and several blocks on a small table
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "FREQUENT", 3)
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
        monkeypatch.setattr(ngram_join, "DENSE", hot - 3)
    rows = corpus(2, 80)
    want = linked_components({i: grams(t) for i, t, *_ in rows if i is not None})
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id]
    sizes = {i: len(grams(t)) for i, t, *_ in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    assert len(set(want.values())) < len(want) - 3


def test_ngram_join_of_ids_with_several_texts(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(10, text("a")), (10, text("b")), (10, text("c")), (3, text("a")), (20, text("b") + " x"), (30, text("c")), (30, text("d")), (25, text("d")), (40, text("e")), (41, ""), (10, ""), (None, text("a"))]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((i, 3 if i in (3, 10, 20, 25, 30) else i) for i, _ in rows)
    assert Counter(r.n_shingles for r in out) == Counter(len(grams(t)) for _, t in rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200 and 300 not in got


@pytest.mark.parametrize("limit", [50, 600, 10_000_000])
def test_shards_fit(spark, limit):
    rows = [(i, "x" * (i % 37)) for i in range(200)] + [(1000, "y" * 40)] * 30 + [(1001, f"row {i}") for i in range(90)] + [(1002, None), (None, "n"), (1003, "z" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.assign_shards(df, ["doc_id"], limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((i, len(t or "")) for i, t in rows)
    size = Counter()
    for r in out:
        size[r.shard] += r.n_bytes
    for r in out:
        assert r.shard_bytes == size[r.shard] and r.oversized == (size[r.shard] > limit)
        assert not r.oversized or r.n_bytes > limit or size[r.shard] == r.n_bytes
    if limit == 10_000_000:
        assert len(size) == 1
    elif limit == 600:  # only buckets over the limit are split: siblings do not fit together
        plain = {s: b for s, b in size.items() if "+" not in s}
        for s, b in plain.items():
            depth, _, bits = s.partition("-")
            sibling = f"{depth}-{bits[:-1]}{1 - int(bits[-1])}" if bits else None
            if sibling in plain:
                assert b + plain[sibling] > limit
    assert sharding.assign_shards(df.limit(0), ["doc_id"], limit).count() == 0


@pytest.mark.parametrize("step", [3, 20])
def test_shards_by_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(sharding, "STEP", step)
    monkeypatch.setattr(sharding, "CELLS", 4 if step == 3 else 1 << 20)
    rows = [(i, "x" * (i * 7 % 53), i, "s", 1) for i in range(300)] + [(0, None, 1, "t", 2)]
    df = spark.createDataFrame(rows, "code long, text string, n int, bytes string, depth int").withColumn("Shard", F.lit("old"))
    code = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(300)}
    sizes = Counter()
    for i, text, *_ in rows:
        for depth in range(61):
            sizes[depth, code[i] >> (60 - depth)] += len(text or "")
    out = sharding.assign_shards(df, ["code"], 400)
    assert out.columns == ["code", "text", "n", "bytes", "depth", "n_bytes", "shard", "shard_bytes", "oversized"]
    want = Counter()
    for i, text, n, b, d in rows:
        depth = next(d for d in range(61) if sizes[d, code[i] >> (60 - d)] <= 400)
        want[i, text, n, b, d, len(text or ""), f"{depth}-{f'{code[i]:060b}'[:depth]}", sizes[depth, code[i] >> (60 - depth)], False] += 1
    assert Counter(map(tuple, out.collect())) == want


def test_shards_are_written(spark, tmp_path):
    rows = [(i, "x" * 40, "k") for i in range(50)] + [(None, "y" * 40, "k")] * 30 + [(7, "z" * 40, f"{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    sharding.write_shards(df, str(tmp_path / "s"), ["doc_id"], 400)
    assert Counter((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == Counter((i, x) for i, x, _ in rows) and len(list((tmp_path / "s").glob("shard=*"))) >= 5


def test_mix_meets_its_quota(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(1, 9))), s) for i, s in enumerate(["a"] * 6000 + ["b"] * 900 + ["c"] * 300 + [None] * 40)]
    rows += [(99_999, " ", "a"), (99_998, None, "d"), (0, rows[0][1], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit("clash"))
    out = mixing.mix(df, mixing.repeats_within(4.0)).select("doc_id", "source", "n_tokens", "weight", "epoch", "block").collect()
    tokens, seen, copies = Counter(), Counter(), Counter()
    for i, t, s in rows:
        tokens[s] += len((t or "").split())
    weight = {r.source: r.weight for r in out}
    for r in out:
        seen[r.source] += r.n_tokens
        copies[r.doc_id, r.source] += 1
    assert {(i, s) for i, _, s in rows} == set(copies)  # every document occurs
    assert sum(weight.values()) == pytest.approx(1)
    shares = {s: t / sum(tokens.values()) for s, t in tokens.items() if t}
    exponent = 1 - math.log(4) / math.log(max(shares.values()) / min(shares.values()))
    total = sum(p**exponent for p in shares.values())
    cover = max(tokens[s] / (p**exponent / total) for s, p in shares.items())
    for s, p in shares.items():
        assert weight[s] == pytest.approx(p**exponent / total, rel=1e-6)
        quota = max(tokens[s], cover * weight[s])
        assert quota - 12 <= seen[s] <= quota + 12
        assert max(c for (_, src), c in copies.items() if src == s) <= 4 * (2 if s == "a" else 1)
    assert mixing.mix(df.limit(0), mixing.repeats_within(4.0)).count() == 0


def spark_hash(*values):
    """xxhash64 of the engine: each value's hash is the next one's seed; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Int) else "<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


Anchor = namedtuple("Anchor", "at hash")


class Int(int):
    """A 32-bit integer column's value."""


def test_mix_draws_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(copies, "COPIES", 7)
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.randrange(0, 9), s) for i, s in enumerate(["a"] * 150 + ["b"] * 60 + [None] * 9)] + [(900, "one two three", "c")] * 40 + [(901, "x " * 3000, "d"), (902, None, "e")]
    clash = {"tokens": "long", "quota": "long", "blocks": "long", "whole": "string", "share": "double", "n_docs": "long", "edge": "long", "code": "string", "copy": "long", "__code": "long", "room": "long"}
    extra = (5, None, 3, None, 0.5, 2, 3, "c", 4, 6, 9)
    df = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} {t}" for n, t in clash.items()))
    got = mixing.mix(df.repartition(3), mixing.repeats_within(2.5)).collect()
    assert all(tuple(r[c] for c in clash) == extra for r in got)
    quotas = {r.src: (r.quota, r.tokens) for r in mixing.source_weights(df.select("source", mixing.word_count(F.col("text")).alias("n")), "source", "n", mixing.repeats_within(2.5)).collect()}
    seed, nulls = 17, "".join("1" if x is not None else "0" for x in extra)
    want, copy = Counter(), Counter()
    by = defaultdict(list)
    for i, text, s in rows:
        flags = "1" + str(int(text is not None)) + str(int(s is not None)) + nulls
        fields = [struct.unpack("<q", struct.pack("<d", x))[0] if isinstance(x, float) else x for x in extra]
        code = spark_hash(Int(seed), flags, i, text, s, *fields)
        by[s].append((i, len((text or "").split()), code, copy[i]))
        copy[i] += 1
    for s, docs in by.items():
        blocks = 1 << max(0, math.ceil(math.log2(max(1, len(docs) / 16))))
        parts = defaultdict(list)
        for d in docs:
            parts[spark_hash(Int(seed), d[2], d[3]) % blocks].append(d)
        quota, tokens = quotas[s]
        whole = quota // tokens if tokens else 1
        left, drawn = quota - whole * tokens, 0
        for epoch in range(whole + 1):
            order = sorted(parts, key=lambda p: (spark_hash(Int(seed), p, epoch), p))
            for k, p in enumerate(order):
                inside = sorted(parts[p], key=lambda d: spark_hash(Int(seed + 1), d[2], d[3], epoch))
                size = sum(d[1] for d in inside)
                if epoch == whole and size > left - drawn:
                    if left > drawn:
                        used = 0
                        for d in inside:
                            if d[1]:
                                used += d[1]
                                if used > left - drawn:
                                    break
                                want[d[0], epoch, k, spark_hash(Int(seed + 1), d[2], d[3], epoch)] += 1
                    break
                if epoch == whole:
                    if left <= drawn:
                        break
                    drawn += size
                for d in inside:
                    want[d[0], epoch, k, spark_hash(Int(seed + 1), d[2], d[3], epoch)] += 1
    assert Counter((r.doc_id, r.epoch, r.block, r.place) for r in got) == want
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
    for s, (quota, tokens) in quotas.items():
        assert quota - max(d[1] for d in by[s]) <= used[s] <= max(quota, tokens)
    orders = defaultdict(dict)  # blocks of different epochs come in different orders
    for r in got:
        if r.source == "a":
            orders[r.epoch].setdefault(r.block, set()).add(r.doc_id)
    assert [orders[0][k] for k in sorted(orders[0])] != [orders[1].get(k) for k in sorted(orders[0])]


def test_mix_of_many_copies_keeps_its_quota(spark):
    df = spark.createDataFrame([(1, "w w w", "a")] * 1000 + [(2, "w " * 4000, "b")], "doc_id long, text string, source string")
    used = {r.source: r.n for r in mixing.mix(df, mixing.repeats_within(1.2)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    quota = {r.src: r.quota for r in mixing.source_weights(df.select("source", mixing.word_count(F.col("text")).alias("n")), "source", "n", mixing.repeats_within(1.2)).collect()}
    assert quota["a"] > 3000 and quota["a"] - 3 <= used["a"] <= quota["a"]


def test_mix_by_entropy(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "s string, n long")
    for target in (0.5, 0.9, 1.09):
        got = mixing.source_weights(df, "s", "n", mixing.entropy_below(target)).collect()
        assert -sum(r.weight * math.log(r.weight) for r in got) == pytest.approx(target, abs=1e-6)


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text.strip("\t\n\x0b\x0c\r "))]


def test_fingerprints_of_edits(spark):
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 120))) for _ in range(40)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "日本語の文章です。" * 9), (503, texts[0]), (504, "a"), (None, "no id here at all")]
    out = {r.doc_id: r for r in fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), sha(edited))
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
        assert (out[i].fingerprint == out[i].edited_fingerprint) or text != edited
    assert out[0].fingerprint == out[503].fingerprint and out[500].fingerprint == out[501].fingerprint
    long = [out[i * 3] for i, t in enumerate(texts) if len(t.split()) > 60]
    assert sum(r.near_edited for r in long) / len(long) > 0.2 > sum(r.near_next for r in long) / len(long)
    assert fingerprint.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{i * 7919 % 101}" for i in range(200))
    rows = spark.createDataFrame([(text,)], "t string").select(
        fingerprint.anchors(F.col("t")).alias("a"), F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h")
    ).first()
    h, k = rows.h, fingerprint.K
    want = [i for i in range(len(h) - k + 1) if min(h[i], h[i + k - 1]) <= min(h[i + 1 : i + k - 1])]
    assert [a.at for a in rows.a] == want


def likeness_of(a, b):
    first = [{}, {}]
    for side, found in zip(first, (a, b)):
        for x in found:
            side[x.hash] = min(x.at, side.get(x.hash, x.at))
    common = first[0].keys() & first[1].keys()
    moved = Counter(first[1][h] - first[0][h] for h in common)
    n = len(first[0].keys() | first[1].keys())
    return len(common) / n, max(moved.values(), default=0) / n


def test_fingerprints_find_a_passage_in_long_texts(spark):
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage, rows = words(60), []
    for pair in range(8):
        for at in (1000, 3000):
            text = words(5000)
            text[at : at + 60] = passage
            rows.append((2 * pair + (at == 3000), " ".join(text)))
    rows += [(100, "ab ba " * 500), (101, "ab ba ab " * 90)]  # repeated anchors
    out = {r.doc_id: r for r in fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(out)
    for i, after in zip(order, order[1:] + order[:1]):
        if after < 16 and i < 16:
            assert len(out[i].fingerprint.split(" ")) > 2000 and 0 < out[i].aligned_next <= out[i].near_next
            assert out[i].aligned_edited > 0.2


def plain_anchors(text, units):
    h = [spark_hash(u) for u in units]
    k = fingerprint.K
    found = [(i, spark_hash(*h[i : i + k])) for i in range(len(h) - k + 1) if min(h[i], h[i + k - 1]) <= min(h[i + 1 : i + k - 1])]
    return found or [(0, spark_hash(text))]


def plain_fingerprint(text):
    wide = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF"
    units = []
    for run in re.findall(f"[{wide}]|[^{wide}\x20\x09-\x0D]+", text):
        units += [run] if len(run) <= fingerprint.LONG else list(run)
    return plain_anchors(text, units), plain_anchors(text, list(text)) if len(units) < fingerprint.FEW else None


def test_fingerprints_by_brute_force(spark):
    rnd = random.Random(12)
    pool = ["alpha", "be", "c", "\u65e5\u672c", "\u0e01\u0e02", "x" * 33, "y" * 32, "\U0001F642", "d\u00e9", "\n", "\t", "z9"]
    texts = [" ".join(rnd.choice(pool) + rnd.choice(["", str(rnd.randrange(30))]) for _ in range(rnd.choice([0, 1, 3, 5, 15, 23, 24, 25, 40, 200]))) for _ in range(60)]
    rows = list(enumerate(texts + ["", "a", " ", texts[3], "long " * 30_000]))
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, id int, mine string")
    out = {r.doc_id: r for r in fingerprint.fingerprint_edits(df).collect()}
    as_text = lambda f: " ".join(format(h & 0xFFFFFFFF, "X") for _, h in f[1] or f[0])
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine, other, following = map(plain_fingerprint, (text, edited, after))
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (as_text(mine), as_text(other))
        assert out[i].sketch == sorted({h for _, h in mine[1] or mine[0]})[: fingerprint.SKETCH]
        for b, got in ((other, (out[i].near_edited, out[i].aligned_edited)), (following, (out[i].near_next, out[i].aligned_next))):
            kind = 1 if mine[1] and b[1] else 0
            assert got == pytest.approx(likeness_of([Anchor(*x) for x in mine[kind]], [Anchor(*x) for x in b[kind]]))


def test_fingerprints_of_any_length_are_cut_alike(spark):
    rnd = random.Random(6)
    text = [f"w{rnd.randrange(10**6)}" for _ in range(27)]
    plain = " ".join(f"v{i}" for i in range(400))
    pairs = [
        (text[:24], text[:11] + text[12:24]), (text, text[:14] + text[20:27]), (text[:23], text[:24]), (text[:6], text[:5] + ["other"]),
        (["".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(300))], None), (["".join(rnd.choice("ABCDEFGHIJ") for _ in range(300))], None),
    ]
    rows = [(" ".join(a), " ".join(b) if b else a[0][:150] + " " + plain[:150]) for a, b in pairs]
    near = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    near = near.select("i", fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    out = {r.i: r.x.near for r in near.select("i", fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    assert out[0] > 0.5 and out[1] > 0.25 and out[2] > 0.8 and out[3] > 0.4 and out[4] > 0.2 and out[5] > 0.2


@pytest.mark.parametrize("most", [1, 2, 4096])
def test_next_row_across_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    ids = [5, 1, 9, 200, 7, 1_000_000, 3, 3, 40, 41, 42, 43]
    monkeypatch.setattr(fingerprint, "MAX_RANGES", most)
    df = spark.createDataFrame([(i, f"t{n:02}") for n, i in enumerate(ids)], "id long, text string")
    led = fingerprint.with_next(df, "id", "text", {"twice": F.concat("text", "text")})
    got = {(r.id, r.text): (r.next_text, r.next_twice) for r in led.collect()}
    order = sorted((i, f"t{n:02}") for n, i in enumerate(ids))
    assert got == {a: (b[1], b[1] * 2) for a, b in zip(order, order[1:] + order[:1])}


URLS = [
    "http://a.example.org/es/1", "https://example.org/en/1?x", "HTTP://EXAMPLE.ORG/en/12#t", "http://example.org/en/2", "http://b.com/fr/x", "http://b.com/de/x",
    "http://com/de/", "http://example.organ/es/", "http://notexample.org/es/", "http://example.org", "http://example.org?/es/", "no scheme", "", None,
    "http:///es/", "x://é.ORG/", "http://a..org/", "http://" + "a." * 5000 + "org/" + "p" * 5000, "http://u:p@example.org:80/es/",
]


def test_urls_by_brute_force(spark):
    rules = spark.createDataFrame(queries.RULES + [(None, "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    rows = [(i, u, "old") for i, u in enumerate(URLS)] + [(0, URLS[0], "old")]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, Verdict string"), rules)
    assert out.count() == len(rows)
    for r in out.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(ASCII_LOWER)
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want), r.url
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules.limit(0)).first().verdict == "allow"


def test_urls_of_many_shapes_and_hot_keys(spark):
    rules = [("h.org", "/" + "p" * n, "block" if n % 2 else "allow") for n in range(5000)] + [(".".join(["d"] * n), "/", "block") for n in range(1, 60)]
    rows = [(i, "http://x.h.org/" + "p" * (i % 6000) + "/z") for i in range(0, 6000, 90)] + [(9000, f"http://{'.'.join(['d'] * n)}/q") for n in range(1, 90)]
    rows += [(10_000, "HTTP://A.H.ORG/ppp?x")] * 1500 + [(10_001, None), (10_002, "http://" + "q" * 50_000 + "/")]
    clash = spark.createDataFrame(rows, "page_id long, url string").withColumns({"__key": F.lit(1), "__of_host": F.lit("x"), "n": F.lit(2), "salt": F.lit(3), "digest": F.lit("d")})
    out = url_filter.judge(clash.repartition(4), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(rows) and {(r["__key"], r["__of_host"], r.n, r.salt, r.digest) for r in out} == {(1, "x", 2, 3, "d")}
    for r in out:
        if r.page_id < 6000:
            n = min(r.page_id, 4999)
            assert (r.rule, r.verdict) == ("h.org/" + "p" * n, "block" if n % 2 else "allow")
        elif r.page_id == 9000:
            assert (r.rule, r.verdict) == (".".join(["d"] * min(59, len(r.host.split(".")))) + "/", "block")
        else:
            assert (r.rule, r.verdict) == (("h.org/ppp", "block") if r.page_id == 10_000 else (None, "allow"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(str, want.fetchall()))
