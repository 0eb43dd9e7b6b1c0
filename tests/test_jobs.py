"""Providers, frame similarity, dispatch, saved state and the command line."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliate import config, runtime
from foliate.__main__ import main
from foliate.functions import frames as pictures
from foliate.functions.frames import blur, ssim
from foliate.operators import video
from foliate.sinks import results
from foliate.sources import providers


def test_model_policy():
    asked = []

    def post(payload):
        asked.append(payload["model"])
        return (429, {}) if payload["model"].endswith(":free") else (200, {"choices": [{"message": {"content": "{}"}}]})

    assert providers.LanguageModel(post, "org/m:free").reply("s", "p") == "{}" and asked == ["org/m:free", "org/m"]
    for status, body in ((402, {"error": {"message": "no credit"}}), (200, {"choices": []}), (500, {})):
        with pytest.raises(providers.ModelError):
            providers.LanguageModel(lambda _, s=status, b=body: (s, b), "m").reply("", "")


def test_failed_calls_are_rows(spark):
    def make():
        def post(payload):
            return (200, {"choices": [{"message": {"content": "ok"}}]}) if "good" in payload["messages"][1]["content"] else (500, {})

        return providers.LanguageModel(post, "m")

    got = {r.key: (r.reply, r.error is None) for r in providers.ask(spark.createDataFrame([(1, "good"), (2, "bad")], "key long, prompt string"), make).collect()}
    assert got == {1: ("ok", True), 2: (None, False)}


def test_files_are_dispatched_by_kind(spark):
    def make(force_ocr, extraction_mode):
        def read(batch):
            if batch.path.str.contains("bad").any():
                raise ValueError("unreadable")
            n = len(batch)
            return pd.DataFrame({"path": batch.path, "page_number": 1, "block_idx": 0, "source": "ocr", "text": ["t"] * n, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "confidence": 1.0, "error": None})

        return read

    files = spark.createDataFrame([("/a/x.png", bytearray(b"1")), ("/a/y.pdf", bytearray(b"2")), ("/a/z.xyz", bytearray(b"3")), ("/a/bad.png", bytearray(b"4"))], "path string, content binary")
    blocks = providers.process_files(files, {"image": make})
    assert {(r.path, r.text, r.error) for r in blocks.collect()} == {("/a/x.png", "t", None), ("/a/y.pdf", None, "no reader for pdf"), ("/a/z.xyz", None, "no reader for this extension"), ("/a/bad.png", None, "unreadable")}
    rows = {r.document_name: (r.document_type, r.total_pages, r.status) for r in providers.document_rows(files, blocks).collect()}
    assert rows == {"x.png": ("image", 1, "success"), "y.pdf": ("pdf", 0, "failed"), "z.xyz": (None, 0, "failed"), "bad.png": ("image", 0, "failed")}
    assert all(r.elapsed_ms >= 0 for r in blocks.collect())
    with pytest.raises(ValueError):
        providers.process_files(files, {}, extraction_mode="all")


def test_frame_similarity():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 256, (40, 50))
    assert ssim(a, a) == pytest.approx(1.0) and ssim(a, rnd.integers(0, 256, (40, 50))) < 0.3
    assert ssim(a, np.clip(a + rnd.integers(-5, 6, a.shape), 0, 255)) > 0.95
    k = np.exp(-(np.arange(-5, 6) ** 2) / 4.5)
    k /= k.sum()
    padded = np.pad(a.astype(float), 5, mode="reflect")
    assert blur(a.astype(float))[7, 9] == pytest.approx((padded[7:18, 9:20] * np.outer(k, k)).sum())


def test_facts_add_up(spark, tmp_path):
    facts = spark.createDataFrame([("a.pdf", "x", "pdf", 100.0, True)], "filename string, field string, format string, similarity double, correct boolean")
    path = str(tmp_path / "facts")
    results.append_facts(facts, path, "one")
    results.append_facts(facts, path, "one")
    loaded = results.load_facts(spark, path)
    assert loaded.count() == 2
    results.clear_facts(spark, path, loaded.schema)
    assert results.load_facts(spark, path).count() == 0


def test_command_line(spark, tmp_path):
    block = lambda source, text, y: {"source": source, "text": text, "bbox": [0.0, y, 50.0, y + 10], "confidence": 1.0}
    doc = {"document_id": "d", "document_name": "d.pdf", "document_type": "pdf", "total_pages": 1, "pages": [{"page_number": 1, "text_sources": [block("embedded", "second", 40.0), block("embedded", ": first", 0.0), block("ocr", "first", 1.0)]}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    main(["clean", str(tmp_path / "doc.json"), "--output-json", str(tmp_path / "out")])
    assert [r.document_text for r in spark.read.json(str(tmp_path / "out_text")).collect()] == ["--- PAGE 1 ---\nfirst\nsecond"]
    cleaned = spark.read.json(str(tmp_path / "out")).first()
    assert [b.text for b in cleaned.pages[0].text_sources] == ["first", "second"] and cleaned.cleaning_metadata.total_blocks_before == 3
    assert cleaned.cleaning_metadata.total_blocks_after == 2
    (tmp_path / "gt.json").write_text(json.dumps({"a.pdf": {"expected": {"x": "1", "policy_type": "t"}}}))
    spark.createDataFrame([("a.pdf", "x", "1")], "filename string, field string, predicted string").write.parquet(str(tmp_path / "pred"))
    main(["evaluate", "--gt", str(tmp_path / "gt.json"), "--predictions", str(tmp_path / "pred"), "--output", str(tmp_path / "eval")])
    assert spark.read.text(str(tmp_path / "eval" / "report")).count() == 3


def test_scratch_wants_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.scratch_dir(Session())
    assert [runtime.one_machine(m) for m in ("local", "local[8]", "local[*]", "local-cluster[2,1,1024]", "yarn")] == [True, True, True, False, False]


def model_for_tests():
    """Says life at temperature 0, and gives a life record otherwise; fails for one text."""

    def post(payload):
        text = payload["messages"][-1]["content"]
        if "broken" in text:
            return 500, {}
        if payload["temperature"] == 0:
            assert payload["timeout"] == 30 and len(text) <= 4000
            return 200, {"choices": [{"message": {"content": '{"doc_type": "life"}'}}]}
        return 200, {"choices": [{"message": {"content": '{"insured_name": "A", "insurer_name": "", "cell_phone": "0123456789"}'}}]}

    return providers.LanguageModel(post, "m")


def test_extraction_job(spark, tmp_path):
    texts = [("1", "nothing known " * 500), ("2", "Star Health scheme description"), ("3", "broken"), ("4", "multisure and SASRIA")]
    folder = str(tmp_path / "texts")
    spark.createDataFrame(texts, "doc_id string, document_text string").write.json(folder)
    main(["extract", folder, "--output", str(tmp_path / "store"), "--model", "tests.test_jobs:model_for_tests"])
    got = {r.filename: r for r in spark.read.parquet(str(tmp_path / "store")).selectExpr("filename", "doc_type", "status", "to_json(extracted_data) as data").collect()}
    assert {k: (r.doc_type, r.status) for k, r in got.items()} == {"1": ("life", "success"), "2": ("health", "success"), "3": ("life", "failed"), "4": ("property", "failed")}
    assert json.loads(got["1"].data)["insurer_name"] == "Unknown" and json.loads(got["1"].data)["cell_phone"] == "0123456789"


def test_scan_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.doc").write_bytes(b"y")
    main(["scan", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--reader", "pdf=tests.test_jobs:two_pages", "--force-ocr"])
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out" / "blocks")).collect()} == {"True|both", None}
    rows = {r.document_name: (r.status, r.total_pages) for r in spark.read.json(str(tmp_path / "out" / "documents")).collect()}
    assert rows == {"a.pdf": ("success", 2), "b.doc": ("failed", 0)}


two_pages = providers.stand_in(2)


def test_a_failing_store_is_not_fatal(spark, tmp_path):
    def broken():
        raise OSError("no space")

    assert results.try_save(broken) == "no space" and results.try_save(lambda: None) is None
    name = "n" * 300
    row = spark.createDataFrame([(name, "car", "success", {"a": "b"})], "filename string, doc_type string, status string, extracted map<string,string>").withColumn("created_at", F.timestamp_seconds(F.lit(1)))
    results.save_results(row, str(tmp_path / "s"))
    assert results.latest(spark, str(tmp_path / "s")).first().filename == name


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport A = 'x y'\nB=2=3\n\nbad line\n")
    env = {"A": "old"}
    assert config.load_env((str(tmp_path / "none"), str(tmp_path / ".env")), env).endswith(".env") and env == {"A": "x y", "B": "2=3"}
    assert config.load_env((str(tmp_path / "none"),), env) is None


def test_similarity_of_samples(spark):
    rnd = np.random.default_rng(1)
    films = {1: [(60, 80), (60, 80), (120, 160)], 2: [(300, 200)]}
    rows, want = [], {}
    for film, shapes in films.items():
        before = None
        for t, shape in enumerate(shapes):
            image = rnd.integers(0, 256, shape).astype(np.uint8)
            small = np.array([[image[y, x] for x in range(shape[1])] for y in range(shape[0])])
            at = [np.clip((np.arange(256) + 0.5) * n / 256 - 0.5, 0, n - 1) for n in shape]
            low = [np.minimum(a.astype(int), n - 2) for a, n in zip(at, shape)]
            y, x = np.meshgrid(*low, indexing="ij")
            v, u = np.meshgrid(*[a - b for a, b in zip(at, low)], indexing="ij")
            small = small.astype(float)
            whole = (small[y, x] * (1 - v) + small[y + 1, x] * v) * (1 - u) + (small[y, x + 1] * (1 - v) + small[y + 1, x + 1] * v) * u
            whole = np.rint(whole).astype(np.uint8)
            want[film, t] = None if before is None else ssim(before, whole)
            before = whole
            rows.append((film, t, *shape, bytearray(image.tobytes())))
    df = spark.createDataFrame(rows, "video_id long, t long, height int, width int, pixels binary")
    got = {(r.video_id, r.t): r.ssim for r in video.frame_similarity(df).collect()}
    assert set(got) == set(want) and all(w is None and got[k] is None or got[k] == pytest.approx(w, abs=1e-3) for k, w in want.items())


def test_branches_fail_alone():
    assert video.branch_errors("no frames", None) == {"frames": "no frames"} and video.branch_errors(None, "x", "frames") == {}
    with pytest.raises(RuntimeError, match="no frames"):
        video.branch_errors("no frames", None, "frames")


def shuffled_bytes(df):
    """What the shuffles of a collected DataFrame took."""
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_frames_travel_as_they_are_and_repeat(spark):
    rnd = np.random.default_rng(2)
    shown = [rnd.integers(0, 256, shape).astype(np.uint8) for shape in ((24, 32), (24, 32), (32, 24), (300, 310), (24, 32))]
    shown.append(shown[0].reshape(32, 24))  # the bytes of another, in another shape
    order = {1: [0, 1, 0, 0, 2, 5, 0, 5] * 25, 2: [3, 3, 1, 3, 4], None: [4, 2]}
    rows = [(film, t, *shown[k].shape, bytearray(shown[k].tobytes())) for film, ks in order.items() for t, k in enumerate(ks)]
    rnd.shuffle(rows)
    df = video.frame_similarity(spark.createDataFrame(rows, "video_id long, t long, height int, width int, pixels binary"))
    got = {(r.video_id, r.t): r.ssim for r in df.collect()}
    scaled = [pictures.resize(x, video.FRAME_SIDE) for x in shown]
    pair = {(i, j): ssim(scaled[i], scaled[j]) for i in range(6) for j in range(6)}
    want = {(film, t): pair[ks[t - 1], k] if t else None for film, ks in order.items() for t, k in enumerate(ks)}
    assert got == {k: w if w is None else pytest.approx(w, abs=1e-12) for k, w in want.items()}
    assert 0 < shuffled_bytes(df) < 204 * 1200 + 3 * 70_000


def test_pairs_of_frames_are_computed_once(monkeypatch):
    calls = []
    for name in ("moments", "ssim_of"):
        monkeypatch.setattr(pictures, name, lambda *a, of=getattr(pictures, name), name=name: calls.append(name) or of(*a))
    for name in ("_moments", "_scores"):
        monkeypatch.setattr(pictures, name, {})
    rnd = np.random.default_rng(3)
    a, b, c = (rnd.integers(0, 256, (20, 30)).astype(np.uint8).tobytes() for _ in range(3))
    step = pictures.successive(64)
    got = [step(20, 30, p, first) for p, first in ((a, True), (b, False), (a, False), (a, False), (c, False), (b, True), (a, False))]
    assert got[0] is None and got[5] is None and got[3] == 1.0 and got[1] == got[2] == got[6] != got[4]
    assert (calls.count("moments"), calls.count("ssim_of")) == (3, 2)
    for name, fresh in (("MOST_MOMENTS", 2), ("MOST_SCORES", 2), ("_moments", {}), ("_scores", {})):
        monkeypatch.setattr(pictures, name, fresh)
    films = [pictures.resize(rnd.integers(0, 256, (20, 30)), 64) for _ in range(9)]
    step = pictures.successive(64)
    scores = [step(64, 64, p.tobytes(), i == 0) for i, p in enumerate(films + films[::-1])]
    assert scores[1:] == [pytest.approx(1.0 if x is y else ssim(x, y), abs=1e-12) for x, y in zip((films + films[::-1])[:-1], (films + films[::-1])[1:])]
    assert len(pictures._scores) <= 2 and len(pictures._moments) <= 2
    with pytest.raises(ValueError, match="7 bytes"):
        step(2, 3, b"1234567", True)
