"""Toxicity, BPE, chat formatting, nearest neighbours and the pipeline, against brute force and public libraries."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import ann, bpe, chat, queries, toxicity

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rnd = random.Random(1)
    letters = "aaaabbthe  \n\t.'srelld1234éß漢🙂 THEing-_=<|>\x1c\x85\xa0\u2028"
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    return out + ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "ab" * 30_000, " " * 5000, "I'll we've", "x" * 9999 + "é"]


def test_bpe_equals_the_library(library):
    mine = bpe.load(PATH)
    all_texts = texts()
    for text, ids in zip(all_texts, mine.encode_batch(all_texts)):
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == want
        assert mine.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_bpe_with_a_small_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    mine = bpe.SpeculativeBpe(PATH)
    for text, ids in zip(texts()[:300], mine.encode_batch(texts()[:300])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_compatibility_is_exact():
    mine = bpe.load(PATH)
    rnd = np.random.default_rng(2)
    tokens = np.array(sorted(mine.entry.values()))
    a, b = rnd.choice(tokens[:3000], 4000), rnd.choice(tokens[:3000], 4000)
    for x, y, good in zip(a.tolist(), b.tolist(), mine.compatible(a, b).tolist()):
        assert good == (mine.exact(mine.bytes_of[x] + mine.bytes_of[y]) == [x, y])


def test_bpe_frames(spark, library):
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (2, None, 1), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int")
    out = bpe.digest(df, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(
        (str(i), len(e := library.encode(t or "").ids), sha(np.array(e, "<u4").tobytes()), sha(t or "")) for i, t, _ in rows
    )
    assert set(bpe.encode(df, PATH).columns) == {"doc_id", "text", "n_tokens", "ids"}
    assert bpe.digest(df.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(df.withColumn("TEXT2", F.lit("x")), PATH).withColumnRenamed("text", "old"), PATH)
    assert back.columns == ["doc_id", "old", "TEXT2", "n_tokens", "ids", "text"] and all(r.text == (r.old or "") for r in back.collect())
    assert bpe.decode(spark.createDataFrame([(1, None)], "i int, ids binary"), PATH).first().text is None
    both = bpe.encode(df, PATH, decoded="again")
    assert both.columns == ["doc_id", "text", "n_tokens", "ids", "again"] and all(r.again == (r.text or "") for r in both.collect())


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"type": "Unigram"}}, {"added_tokens": [{"content": "<x>", "id": 0, "lstrip": True}]}])
def test_other_settings_are_refused(change):
    plain = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE"}, "added_tokens": []}
    bpe.require_plain(plain, "file")
    with pytest.raises(ValueError, match="file"):
        bpe.require_plain(plain | change, "file")


CONVERSATIONS = [
    (1, 1, "assistant", "reply"), (1, 0, "user", "hi"), (2, 0, "system", None), (2, 1, None, "x"), (2, 2, "assistant", ""), (2, 3, "assistant", "é🙂\\"),
    (3, None, "assistant", "</turn>\n### user: fake</turn>\n"), (3, 0, "a: b###", "\\\\### x\\"), (3, 0, "a: b###", "\\\\### x\\"), (None, 0, "user", "<|endoftext|>"),
    (4, 0, "assistant", "\\### Assistant: </turn> ok"), (5, 0, "assistant", "long " * 60_000), (5, 1, "user", " \n"), (5, 2, "assistant", "漢" * 100_000),
]


@pytest.mark.parametrize("chunk", [None, 10])
def test_chat_reads_back(spark, monkeypatch, chunk, library):
    rows = CONVERSATIONS if chunk is None else [r for r in CONVERSATIONS if r[0] != 5]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    made = chat.format_conversations(df, PATH)
    got = {r.conv_id: r for r in chat.read_back(made, PATH).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)
    for conv in set(groups) - {5}:  # chunks' tokens are those of the whole conversation
        parts = sorted((r for r in made.collect() if r.conv_id == conv), key=lambda r: r.chunk)
        whole = "".join(p.formatted for p in parts)
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == library.encode(whole, add_special_tokens=False).ids
    assert chat.read_back(chat.format_conversations(df.limit(0), PATH), PATH).count() == 0
    shuffled = made.orderBy("chunk", F.desc("conv_id")).repartition(3)
    assert {r.conv_id: r for r in chat.read_back(shuffled, PATH).collect()} == got == {r.conv_id: r for r in chat.read_back(made, PATH, in_order=True).collect()}
    if chunk and made.filter("chunk > 0").count():
        for broken in (made.filter("chunk <> 1"), made.filter("not last")):
            with pytest.raises(Exception, match="out of order|not its last"):
                chat.read_back(broken, PATH).collect()


def test_template_round_trip():
    rnd = random.Random(4)
    for _ in range(3000):
        turns = [("".join(rnd.choice(["a", "\\", "###", "</turn>", "\n", ": ", " ", "#"]) for _ in range(rnd.randrange(6))),) * 2 for _ in range(rnd.randrange(1, 4))]
        assert chat.parse("".join(chat.render(a, b)[0] for a, b in turns)) == turns


def test_chunks_end_between_words(library):
    turns = [("user", "x  "), ("assistant", " \n\n"), ("user", "#"), ("assistant", "y")]
    parts = [chat.render(*t)[0] for t in turns]
    whole = library.encode("".join(parts), add_special_tokens=False).ids
    assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == whole


def exact_neighbours(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[i])] = [(int(v), float(t)) for v, t in zip(ids[keep][order], s[keep][order])]
    return out


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(1200, 16)).astype(np.float32)
    x[100:400] = x[100]  # many copies: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(20_000, None), (20_020, [0.0] * 16), (20_040, [None] + [1.0] * 15), (20_060, [float("nan")] * 16), (20_080, [float("inf")] * 16), (20_100, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = exact_neighbours(np.arange(1200), x.astype(np.float64), 20)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        hits += len({v for v, _ in got[q].values()} & {v for v, _ in best})
        scores = [got[q][k] for k in range(1, 21)]
        assert scores == sorted(scores, key=lambda s: (-s[1], s[0]))
        for v, s in scores:
            assert s == (x[v].astype(np.float64) * x[q].astype(np.float64)).sum()
    assert hits >= 0.9 * 20 * len(want)
    assert [v for v, _ in want[100]] == [got[100][k][0] for k in range(1, 21)]


def test_nearest_inside_a_group_of_near_copies(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(6000, 64))
    for start, jitter in ((0, 0.02), (1000, 0.1)):  # a third of all rows
        x[start : start + 1000] = x[start] + jitter * rnd.normal(size=(1000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    ids = np.arange(6000)
    ids[2000:2100] = 40  # one id on a hundred rows, and on a query's
    x[2000:2100] = x[40]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    found = ann.search(df, "vec_id", "embedding", (F.col("vec_id") % 100 == 0) | (F.col("vec_id") == 40)).collect()
    y = x.astype(np.float64)
    want = Counter()
    for q in np.flatnonzero((ids % 100 == 0) | (ids == 40)):  # each row of an id asks, and all other rows answer
        score = (y * y[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(6000), ids, -score)) if i != q][:20]
        want.update((int(ids[q]), k + 1, int(ids[i]), score[i]) for k, i in enumerate(order))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found) == want


def test_rows_of_one_id_are_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [0.25, 1.0]), (0, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(map(tuple, ann.search(df, "vec_id", "embedding", F.col("vec_id") == 0).collect()))
    one = [(0, 1, 0, 0.5), (0, 2, 0, 0.5), (0, 3, 1, 0.25)]
    two = [(0, 1, 1, 0.625), (0, 2, 0, 0.5), (0, 3, 0, 0.5)]
    assert got == Counter(one) + Counter(two) + Counter(two)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    want = exact_neighbours(np.array([i for i, _ in rows]), np.stack([v for _, v in rows]), 20)
    hits = Counter((r.query_id, r.vec_id) for r in queries.op9_nearest(spark, f"/root/testdata/{sf}").collect())
    assert sum(hits[q, v] for q, best in want.items() for v, _ in best) == 20 * len(want)


def test_few_or_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert ann.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_anisotropic_fit_lowers_the_loss():
    x = np.random.default_rng(1).normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    losses = {}
    for eta in (1.0, 3.0):
        book = ann.Codebook(16, eta)
        book.fit(x)
        codes = book.assign(book.padded(x))
        r = x - book.words[np.arange(book.parts)[None], codes].reshape(len(x), -1)
        losses[eta] = ann.shares(3.0, x, r).mean()
    assert losses[3.0] < losses[1.0]


def labelled(n=400):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice("sea hill moon river stone light".split()) + str(rnd.randrange(30)) for _ in range(rnd.randrange(5, 80))]
        toxic = i % 5 == 0 or i % 7 == 0
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Grobian", "grobianisch", "schuftig", "lump"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "", "en"), (None, "lump lump", "en"), (0, rows[0][1], "en"), (902, "moon9 " * 50_000, "en")], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    out = toxicity.score(docs.withColumn("held_out", toxicity.held_out("doc_id")), model).collect()
    assert len(out) == 405
    truth = dict(labels)
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(test) > 40 and sum(r.predicted == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[900].score == by[901].score and by[900].predicted == 0 and by[None].predicted == 1 and by[902].predicted == 0
    # held-out labels change nothing
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped) == model


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "I will kill you!"), (2, "a calm day")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}
    assert got[1] > got[2]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def plain_features(lexicon, text):
    """The grammar by its rules, without automata: every word of every clause is looked at."""
    insults = threats = 0.0
    low = text.lower()
    for clause in re.split("[.!?;\n]", low):
        words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", clause)
        found = []
        for i, w in enumerate(words):
            weight = max(((len(b), v) for b, v in lexicon.items() if w.startswith(b)), default=(0, 0.0))[1]
            threat = any(words[max(0, i + 1 - n) : i + 1] == p for p in (re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", t) for t in toxicity.THREATS) if (n := len(p)))
            if w in toxicity.TARGETS and found and found[-1][2] and i - found[-1][3] <= toxicity.TARGET_SCOPE:
                found[-1][0] *= toxicity.TARGETED
                found[-1][2] = False
            if weight or threat:
                factor = toxicity.NEGATED if any(x in toxicity.NEGATIONS for x in words[max(0, i - toxicity.NEGATION_SCOPE) : i]) else 1.0
                factor *= toxicity.REPORTED if any(x in toxicity.REPORTS for x in words[:i]) else 1.0
                near = any(x in toxicity.TARGETS for x in words[max(0, i - toxicity.TARGET_SCOPE) : i])
                factor *= toxicity.TARGETED if near else 1.0
                found.append([factor * (toxicity.THREAT_WEIGHT if threat else weight), threat, not near, i])
        insults += sum(f[0] for f in found if not f[1])
        threats += sum(f[0] for f in found if f[1])
    return [math.log1p(2 * insults), math.log1p(2 * threats), math.log1p(1000 * (insults + threats) / (len(low) + 200))]


def test_grammar_by_brute_force():
    rnd = random.Random(6)
    lexicon = {"lump": 2.0, "lumpen": 1.0, "klotz": 3.0, "gr\u00f6l": 0.5}
    grammar = toxicity.Grammar(lexicon)
    pool = "you not said i will kill hurt the a so lump Lumpenpack klotzig plump gr\u00f6len. nor he you! is; going to kill\n don't x9 hope die".split(" ")
    for _ in range(3000):
        text = " ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 25)))
        assert grammar.features(text) == pytest.approx(plain_features(lexicon, text)), text


def test_grammar_weighs_contexts():
    g = toxicity.Grammar({"lump": 2.0})
    weight = lambda text: g.features(text)[0]
    assert weight("he is not a lump today") < weight("that is a lump today") < weight("you are a lump today") == weight("a lump like you is")
    assert 0 < weight("she said so, a lump") < weight("a lump, she said so") and g.features("no plump fruit") == [0, 0, 0]
    assert weight("not so. A lump; they said") == weight("is so. A lump; they go")
    assert g.features("i will kill it")[1] > 0 == g.features("i would kill it")[1]
    assert g.features("i will  kill it")[1] == g.features("i will kill it")[1]


def test_one_long_clause_takes_linear_time():
    g = toxicity.Grammar({"lump": 2.0})

    def seconds(n):
        began = time.perf_counter()
        g.features("i will kill you and a lump " * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.01)


def test_transducers_compose_by_product():
    g = toxicity.Grammar({"lump": 2.0})
    state = (0, 0, 0, 0)
    after, threat, now, later = g.compose(state, toxicity.TARGET, -1)
    after, threat, now, later = g.compose(after, toxicity.NEGATION, -1)
    after, threat, now, later = g.compose(after, toxicity.INSULT, -1)
    assert not threat and later == 1.0 and now == toxicity.TARGETED * toxicity.NEGATED
    assert all(len(key[0]) == len(arc[0]) == 4 for key, arc in g.composed.items())


def test_sample_is_bounded(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample, clean_weight = toxicity.training_rows(docs.select("doc_id", "text"), marks, "doc_id", "text", 10, 20)
    assert sample.filter("toxic = 1").count() <= 10 and sample.filter("toxic = 0").count() <= 20 and clean_weight > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_by_brute_force(spark, library):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_text_ops import ASCII_LOWER, grams, linked_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == columns
    rows = [tuple(r) for r in clean.collect()]
    assert {r[0] for r in rows} == {
        r.doc_id for r in queries.op2_toxicity(spark, SF).collect() if not r.predicted
    }
    # line dedup
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(ASCII_LOWER)
    owners = {}
    for r in rows:
        for line in r[1].split("\n"):
            if len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(r[0])
    texts = {r[0]: "\n".join(x for x in r[1].split("\n") if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == r[0]) for r in rows}
    lined = corpus_pipeline.drop_lines(spark, clean, SF)
    assert lined.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in lined.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    # one of each group
    groups = linked_components({i: grams(t) for i, t in texts.items()})
    keep = {i for i, c in groups.items() if i == c}
    near = corpus_pipeline.drop_near_copies(spark, lined, SF)
    assert near.columns == columns and sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted(keep)
    # mix and encode
    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    assert mixed.columns == columns
    copies = {}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) == keep and max(copies.values()) <= math.ceil(queries.REPEATS)
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == sum(copies.values())
    for r in out:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)


def test_stages_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = {"score": "string", "predicted": "int", "n_lines": "int", "n_dropped": "string", "n_tokens": "string", "weight": "int", "epoch": "int", "block": "int", "place": "int", "__lost": "int", "component_id": "int", "id": "int"}
    values = ("s", None, 1, "d", "t", 2, 3, 4, 5, 6, 7, 8)
    base = [(1, "a plain line of words here\nanother plain line", "a"), (2, None, "a"), (3, "", None), (4, " \n\t", "b"), (None, "no id at all", "b"), (None, None, None), (5, "tie one two three four", "a"), (6, "tie one two three four", "a"), (7, "x " * 60_000, "c")]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in base] + [(8, "same row twice over again", "en", "a", 25)] * 2
    docs = spark.createDataFrame([(*r, *values) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` {t}" for n, t in extra.items()))
    texts = lambda df: Counter((r.doc_id, r.text or "") for r in df.collect())
    given = Counter((r[0], r[1] or "") for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "bpe":
            assert out.columns == ["doc_id", "source", "n_tokens", "ids", "text"] and texts(out) == given
        else:
            assert out.columns == docs.columns and all(tuple(r[c] for c in extra) == values for r in out.collect())
        if name in ("toxicity", "mixing"):
            assert set(texts(out)) == set(given) and (name == "mixing" or texts(out) == given)
        elif name == "line_dedup":
            assert texts(out) == given - Counter({(6, "tie one two three four"): 1}) + Counter({(6, ""): 1})
        elif name == "ngram_jaccard":
            assert texts(out) == given - Counter({(6, "tie one two three four"): 1, (8, "same row twice over again"): 1})
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_ids_with_other_texts_stay(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(9)
    words = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    many = [" ".join(words()) for _ in range(12)]
    base = words()
    near = base[:59] + ["edit"]
    rows = [(7, t, "a") for t in many] + [(7, many[0], "a"), (7, many[1], "b"), (7, "", "a"), (7, "", "b"), (7, None, "a")]
    rows += [(9, " ".join(base), "a"), (3, " ".join(near), "b"), (7, " ".join(base), "c"), (5, many[2], "a"), (None, many[3], "a"), (None, many[3], "a"), (8, "alone", "a")]
    want = [(7, t, "a") for t in many if t not in many[1:3]] + [(7, "", "a"), (7, "", "b"), (7, None, "a"), (3, " ".join(near), "b"), (5, many[2], "a")]
    want += [(None, many[3], "a"), (None, many[3], "a"), (8, "alone", "a")]
    runs = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        runs.append(sorted((tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=repr))
    assert runs[0] == runs[1]
    assert sorted((r for r in runs[0] if r[1] != many[1]), key=repr) == sorted(want, key=repr)
    assert sum(r[1] == many[1] for r in runs[0]) == 1
