"""Operators against independent row-at-a-time versions on small random pages, and hand-derived cases."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foliate.config import FIELDS, CleanConfig
from foliate.functions import formats, similarity, text as X
from foliate.operators import classify, clean, evaluate, extract, layout, video
from foliate.sources import documents, pages, routing
from foliate.streaming import jobs

BLOCK = "doc_id long, page_number int, block_idx int, source string, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def page_rows(seed, n, labels=False):
    rnd = random.Random(seed)
    words = ["alpha", "BETA LINE", "x1", "name:", "total due:", ":value", "éa bc", "--", "Mutral cover", "12.50"]
    rows = []
    for i in range(n):
        x0 = rnd.choice([40.0, 45.0, 120.0, 200.0, 210.0, 300.0]) + rnd.random()
        y0 = rnd.randrange(0, 20) * 7.0 + rnd.choice([0, 0.5, 2.5, 4])
        rows.append((seed, 1, i, rnd.choice(["embedded", "ocr"]), rnd.choice(words), float(x0), float(y0), x0 + rnd.randrange(5, 80), y0 + rnd.choice([0, 8, 10, 12]), rnd.choice([0.4, 0.75, 0.9, 1.0])))
    return rows


def test_ratio_is_the_indel_similarity():
    rnd = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(12))) for _ in range(2))
        want = 100.0 if not a + b else 200.0 * lcs(a, b) / (len(a) + len(b))
        assert similarity.ratio_of(a, b) == pytest.approx(want)
        assert similarity.ratio_of(b, a) == pytest.approx(want)
    assert round(similarity.ratio_of("mutral", "mutual"), 1) == 83.3


def test_nearest_equals_exhaustive_search():
    rnd = random.Random(4)
    words = [w.lower() for w in CleanConfig().dictionary()]
    tokens = [w[: rnd.randrange(2, 9)] + rnd.choice("abct") for w in words] + ["", "zzz"]
    for least in (0.0, 75.0):
        for token, got in zip(tokens, similarity.nearest_of(tokens, words, least)):
            scores = [similarity.ratio_of(token, w) for w in words]
            best = max(scores)
            assert got == ((scores.index(best), best) if best >= least else None)


@pytest.mark.parametrize("seed", range(4))
def test_pairing_follows_list_order(seed):
    rows = page_rows(seed, 40)
    texts, taken = [r[4] for r in rows], set()
    for i, r in enumerate(rows):
        mid = (r[6] + r[8]) / 2
        if texts[i].rstrip().endswith(":"):
            near = [j for j, c in enumerate(rows) if j != i and j not in taken and abs((c[6] + c[8]) / 2 - mid) <= 3 and c[5] >= r[7]]
            near.sort(key=lambda j: rows[j][5])
            if near:
                texts[i] = (texts[i].rstrip() + " " + " ".join(texts[j] for j in near)).strip()
                taken.update(near)
    got, left = layout.pair_page([r[5] for r in rows], [r[6] for r in rows], [r[7] for r in rows], [r[8] for r in rows], [r[4] for r in rows], 3.0)
    assert got == texts and [i for i, x in enumerate(left) if not x] == sorted(taken)


@pytest.mark.parametrize("seed", range(6))
def test_wrapped_lines_against_a_plain_search(seed):
    rows = page_rows(seed + 50, 45)
    x0, y0, x1, y1, texts = ([r[k] for r in rows] for k in (5, 6, 7, 8, 4))
    lettered = [x for x, t in zip(x0, texts) if any(c.isalpha() for c in t)]
    edge = (min(lettered) if lettered else 0.0) + 50
    groups = []
    for i in sorted(range(len(rows)), key=lambda k: (y0[k], x0[k])):
        best, least = None, 9999
        for g, members in enumerate(groups):
            p = members[-1]
            gap = y0[i] - y1[p]
            m = layout.LABEL_PREFIX.match(texts[p])
            content = x0[p] + (x1[p] - x0[p]) * len(m[0]) / len(texts[p]) if m else x0[p]
            a = [c for c in (texts[p][len(m[0]):] if m else texts[p]) if c.isalpha()]
            b = [c for c in texts[i] if c.isalpha()]
            case = len(a) < 3 or len(b) < 3 or "".join(a).isupper() == "".join(b).isupper()
            between = any(x < edge and y0[p] < y <= y0[i] and abs(y - y0[i]) >= 8 for x, y in zip(x0, y0))
            near = abs(x0[i] - content) < 20 or abs(x0[i] - x0[p]) < 20
            if -5 <= gap < 25 and near and x0[p] >= edge and x0[i] >= edge and not texts[i].lstrip().startswith(":") and case and not between and gap < least:
                best, least = g, gap
        groups[best].append(i) if best is not None else groups.append([i])
    want = [0] * len(rows)
    for g, members in enumerate(groups):
        for i in members:
            want[i] = g
    assert layout.wrap_groups(x0, y0, x1, y1, texts).tolist() == want


def test_reading_order_is_anchored(spark):
    rows = [r for s in range(3) for r in page_rows(s, 30)]
    got = {(r.doc_id, r.block_idx): r.position for r in layout.reading_order(spark.createDataFrame(rows, BLOCK)).collect()}
    for s in range(3):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[6], r[2]))
        out, band, anchor = [], [], None
        for r in mine:
            if anchor is None or r[6] - anchor > 5:
                out += sorted(band, key=lambda b: b[5])
                band, anchor = [], r[6]
            band.append(r)
        out += sorted(band, key=lambda b: b[5])
        assert [got[s, r[2]] for r in out] == list(range(30))


def test_dedup_and_clean(spark):
    rows = [r for s in range(3) for r in page_rows(s, 30)]
    df = spark.createDataFrame(rows, BLOCK)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] < b[2] and a[3] != b[3]:
                w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
                inter = max(w, 0) * max(h, 0)
                union = (a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - inter
                if inter > 0 and inter / union >= 0.5 and 200 * lcs(a[4].lower(), b[4].lower()) / max(len(a[4] + b[4]), 1) >= 80:
                    want.add((a[0], b[2] if a[3] == "embedded" else a[2]))
    got = {(r.doc_id, r.block_idx) for r in df.select("doc_id", "block_idx").exceptAll(clean.drop_duplicates(df).select("doc_id", "block_idx")).collect()}
    assert got == want
    done = clean.clean(df)
    assert done.count() > 0 and done.filter(F.col("text").contains("Mutral")).count() == 0


def test_snap_cases(spark):
    tokens = ["Mutral", "month", "Insurer", "P57", "(numbar),", "E-mal", "the", "zebra", "Premiun.", "cel"]
    df = spark.createDataFrame([(0, " ".join(tokens))], "k int, text string")
    assert clean.snap(df, ["k"]).first().text.split(" ") == ["Mutual", "month", "Insurer", "FSP", "(Number),", "E-mail", "the", "zebra", "Premium.", "Cell"]


def test_words_merge_into_runs(spark):
    rows = [(1, 1, i, t, x, y, x + 30, y + 10.0, 0.8) for i, (t, x, y) in enumerate([("a", 0.0, 0.0), ("b", 40.0, 1.0), ("c", 200.0, 0.0), ("d", 0.0, 40.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    # the run's box is 11 high, so its centre lies below that of the single word
    assert [r.text for r in layout.merge_words(df).orderBy("block_idx").collect()] == ["c", "a b", "d"]


def plain_runs(words):
    """Words (text, x0, y0, x1, y1, confidence) of a page in list order -> runs, as the rule says it."""
    lines = []
    for w in sorted(words, key=lambda w: (w[2] + w[4]) / 2):
        centre = (w[2] + w[4]) / 2
        for line in lines:
            if abs(centre - sum((v[2] + v[4]) / 2 for v in line) / len(line)) <= max(6.0, 0.45 * sum(v[4] - v[2] for v in line) / len(line)):
                line.append(w)
                break
        else:
            lines.append([w])
    runs = []
    for line in lines:
        now = None
        for w in sorted(line, key=lambda w: (w[1], (w[2] + w[4]) / 2)):
            if now and w[1] - now["x1"] <= 2.5 * (w[4] - w[2] + now["y1"] - now["y0"]) / 2:
                now["words"].append(w)
            else:
                now = {"words": [w]}
                runs.append(now)
            now.update(x0=min(v[1] for v in now["words"]), y0=min(v[2] for v in now["words"]), x1=max(v[3] for v in now["words"]), y1=max(v[4] for v in now["words"]))
    out = [(" ".join(v[0] for v in r["words"]), *(float(int(r[c])) for c in ("x0", "y0", "x1", "y1")), round(sum(v[5] for v in r["words"]) / len(r["words"]), 9)) for r in runs]
    return sorted(out, key=lambda r: ((r[2] + r[4]) / 2, r[1]))


def test_merged_words_by_brute_force(spark):
    rnd = random.Random(9)
    rows, pages = [], {}
    for doc in range(25):
        words = []
        for i in range(rnd.choice([1, 5, 60, 150])):
            x0, y0 = rnd.choice([0.0, 30.5, 80.0, 200.0]) + rnd.random() * 40, rnd.randrange(0, 12) * 9.0 + rnd.random() * 8
            words.append((f"w{i}", x0, y0, x0 + rnd.randrange(5, 40), y0 + rnd.choice([6.0, 10.0, 30.0]), rnd.random()))
        pages[doc] = words
        rows += [(doc, 1, i, *w) for i, w in enumerate(words)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, page_number int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = {}
    for r in layout.merge_words(df).orderBy("doc_id", "block_idx").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.x0, r.y0, r.x1, r.y1, round(r.confidence, 9)))
    assert got == {doc: plain_runs(words) for doc, words in pages.items()}


def test_text_functions(spark):
    rows = [("\xa0 a \t b\n", "a b"), ("", ""), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(X.collapse_whitespace(F.col("t"))).collect()] == [b for _, b in rows]
    df = spark.createDataFrame([(t,) for t in (":4150…", "value..", "•- x", "--", "é", "7", "a\n-")], "t string")
    assert [r[0] for r in df.select(X.strip_edge_noise(F.col("t"))).collect()][:3] == ["4150…", "value.", "x"]
    assert [r[0] for r in df.select(X.symbol_only(F.col("t"))).collect()] == [False, False, False, True, True, False, False]
    assert X.mend("cafÃ© &amp; ﬁn") == "café & fin"


def test_formats(spark):
    cases = {
        "date": [("1st March 2020", ""), ("3-feb-99", "03/02/1999"), ("31/12/1968", "31/12/1968"), ("1/1/69", "01/01/1969"), ("1/1/68", "01/01/2068"), ("March 3rd, 2021", "03/03/2021"), ("", "")],
        "phone": [("082 123 4567", "0821234567"), ("12345678", ""), ("123456789012", "")],
        "email": [("a.b", "a.b"), ("..", ""), ("ab", "")],
        "percent": [("20 %", "20 %"), ("x%", ""), ("1_000", "1_000")],
        "integer": [(" -5 ", " -5 "), ("5.0", "")],
        "currency": [("R 5", "R 5"), ("five", "")],
        "free_text": [("any", "any")],
    }
    for kind, pairs in cases.items():
        df = spark.createDataFrame(pairs, "v string, want string")
        for r in df.withColumn("got", formats.checked(F.col("v"), kind)).collect():
            assert r.got == r.want, (kind, r)


def test_replies_and_validation(spark):
    replies = ['{"a": 1, "b": "x", "c": null, "d": {"e": "f"}}', '```json\n{"b": "y"}\n```', "[1]", "3", "{", "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in replies], "r string").select(extract.parse_reply(F.col("r"))).collect()]
    assert got == [{"a": "", "b": "x", "c": "", "d": ""}, {"b": "y"}, None, None, None, None, None]
    df = spark.createDataFrame([({"insurer_name": "", "cell_phone": "1", "junk": "z"},), (None,)], "record map<string,string>")
    a, b = extract.validate(df, "life").collect()
    assert (a.insurer_name, a.intermediary_name, a.cell_phone, a.status, a.errors) == ("Unknown", "Unknown", "", "success", ["insurer_name", "intermediary_name"])
    assert b.status == "failed" and b.insurer_name is None
    mixed = spark.createDataFrame([("car", {"vehicle_make": "V", "x": "y"}), ("boat", {"a": "b"})], "doc_type string, record map<string,string>")
    car, boat = extract.validate_mixed(mixed).collect()
    assert car.extracted["vehicle_make"] == "V" and len(car.extracted) == len(FIELDS["car"]) and boat.status == "failed"
    with pytest.raises(KeyError):
        extract.validate(df, "boat")


def test_classification(spark):
    texts = [("PNR Number\nTrain Name", "travel"), ("pnr number only", ""), ("x" * 6000 + "period of insurance", ""), ("Intermediary :", "life"), ("", "")]
    for r in spark.createDataFrame(texts, "t string, want string").withColumn("got", classify.keyword_type(F.col("t"))).collect():
        assert r.got == r.want


def test_scores(spark):
    truth = spark.createDataFrame([("a.pdf", {"x": " Ab ", "y": "", "z": "q", "policy_type": "t", "w": ""})], "filename string, expected map<string,string>")
    pred = spark.createDataFrame([("a.pdf", "x", "aB"), ("a.pdf", "w", "v")], "filename string, field string, predicted string")
    got = {r.field: (r.similarity, r.correct, r.format) for r in evaluate.score_fields(evaluate.truth_rows(truth), pred).collect()}
    assert got == {"x": (100.0, True, "pdf"), "z": (0.0, False, "pdf"), "w": (0.0, False, "pdf")}
    assert evaluate.overall(evaluate.score_fields(evaluate.truth_rows(truth), pred).filter("false")).first() == (0, 0.0, 0.0)


def test_frames_with_state_match_the_batch(spark, tmp_path):
    rows = [(v, t * 2, 0.8 + ((t * 7 + v) % 16) / 100, ["a b", "c d", None][(t // 3 + v) % 3]) for v in range(3) for t in range(30)]
    df = spark.createDataFrame(rows, "video_id long, t long, ssim double, text string")
    batch = video.keep_frames(video.gate_frames(df).drop("previous_t"))
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = jobs.gate_stream(stream).writeStream.format("memory").queryName("gated").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    key = lambda r: (r.video_id, r.t, r.zone, r.kept)
    assert sorted(map(key, spark.table("gated").collect())) == sorted(map(key, batch.collect()))


def test_landing_to_store(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a.pdf", "car", '{"vehicle_make": "V"}'), ("b.pdf", "life", "{")], "filename string, doc_type string, reply string")
    rows.write.parquet(src)

    def process(batch):
        done = extract.validate_mixed(batch.withColumn("record", extract.parse_reply(F.col("reply"))))
        return done.withColumn("created_at", F.timestamp_seconds(F.lit(5)))

    jobs.process_into(jobs.landing(spark, src, rows.schema), process, out, str(tmp_path / "c")).awaitTermination(120)
    got = {r.filename: r.status for r in spark.read.parquet(f"{out}/*").collect()}
    assert got == {"a.pdf": "success", "b.pdf": "failed"}


def test_word_files_and_routing(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert documents.read_word_images(spark, str(tmp_path)).count() == 0
    rows = documents.read_word(spark, str(tmp_path)).orderBy("path", "block_idx").collect()
    assert [(r.part, r.text) for r in rows][:3] == [("header", "Head"), ("body", "Hello"), ("body", "Cell")] and rows[3].part == "failed"
    assert {r.kind for r in routing.list_files(spark, str(tmp_path)).collect()} == {"docx"}


def test_word_parts_in_order(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:m="urn:mc"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    box = f"<w:p><w:r><w:t>body </w:t></w:r><m:AlternateContent><m:Choice><w:r><w:txbxContent>{p('BOX')}</w:txbxContent></w:r></m:Choice><m:Fallback><w:r><w:txbxContent>{p('BOX')}</w:txbxContent></w:r></m:Fallback></m:AlternateContent></w:p>"
    refs = "".join(f'<w:headerReference w:type="{kind}" r:id="rId{n}"/>' for kind, n in (("default", 2), ("first", 10), ("even", 7)))
    kinds = {2: "default", 10: "first", 7: "even", 3: "unused"}
    for name, title in (("on", "<w:titlePg/>"), ("off", "")):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", f"<w:document {w}><w:body>{box}<w:sectPr>{refs}<w:footerReference w:type='default' r:id='rId20'/>{title}</w:sectPr></w:body></w:document>")
            z.writestr("word/_rels/document.xml.rels", "<R>" + "".join(f'<x Id="rId{n}" Target="header{n}.xml"/>' for n in kinds) + '<x Id="rId20" Target="footer1.xml"/></R>')
            for n, kind in kinds.items():
                z.writestr(f"word/header{n}.xml", f"<w:hdr {w}>{p(kind)}</w:hdr>")
            z.writestr("word/footer1.xml", f"<w:ftr {w}>{p('foot')}</w:ftr>")
            for n in range(3):
                z.writestr(f"word/media/image{n}.png", b"same" if n < 2 else b"other")
    texts = documents.read_word(spark, str(tmp_path))
    got = {}
    for r in texts.orderBy("path", "block_idx").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.text)
    assert got == {"on.docx": ["first", "even", "default", "body", "BOX", "foot"], "off.docx": ["even", "default", "body", "BOX", "foot"]}
    images = documents.read_word_images(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.image, bytes(r.content)) for r in images.collect()) == [(f"{n}.docx", i, c) for n in ("off", "on") for i, c in ((0, b"same"), (1, b"other"))]
    read = images.select("path", "image", F.lit(0).alias("word_idx"), F.lit("seen").alias("text"), F.lit(0.5).alias("confidence"))
    blocks = documents.word_blocks(texts, read).filter("path like '%/off.docx'").orderBy("block_idx").collect()
    assert [(r.source, r.text) for r in blocks] == [("embedded", t) for t in got["off.docx"]] + [("ocr", "seen")] * 2 and blocks[0].width == 612
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body/></w:document>")
        for n in range(1, 12):
            z.writestr(f"word/header{n}.xml", f"<w:hdr {w}>{p(n)}</w:hdr>")
    assert [t for _, t in documents.word_paragraphs(many.getvalue())] == [str(n) for n in range(1, 12)]


def test_pages_from_what_was_read(spark):
    tuples = spark.createDataFrame([(1, 1, 0, 7, 0, " Name: ", 0.0, 0.0, 40.0, 10.0), (1, 1, 1, 4, 0, "no", 0.0, 0.0, 1.0, 1.0), (1, 1, 2, 6, 1, "Ann", 60.0, 1.0, 90.0, 11.0), (1, 1, 3, 7, 0, "\xa0", 0.0, 0.0, 1.0, 1.0)], "doc_id long, page_number int, idx int, fields int, kind int, text string, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 1, 0, 100.0, 200.0, 300.0, 400.0), (1, 1, 1, 5.0, 5.0, 5.0, 9.0), (1, 1, 2, None, 5.0, 5.0, 9.0), (2, 1, 0, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_number int, region int, x0 double, y0 double, x1 double, y1 double")
    corner = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(150).alias("x"), F.lit(75).alias("y"))
    read = lambda asked: asked.select("doc_id", "page_number", "region", F.lit(0).alias("word_idx"), F.lit(" word ").alias("text"), F.array(*corner).alias("vertices"), F.lit(0.8).alias("confidence"))
    got = sorted((r.doc_id, r.text, r.source, r.x0, r.y0, r.x1, r.y1) for r in pages.pdf_blocks(tuples, regions, read).collect())
    assert got == [(1, "Name: Ann", "embedded", 0.0, 0.0, 40.0, 10.0), (1, "word", "ocr", 100.0, 200.0, 172.0, 236.0), (2, "word", "ocr", 0.0, 0.0, 72.0, 36.0)]
    long = tuples.withColumn("text", F.repeat("text", F.lit(20)))
    assert {r.region for r in pages.regions_to_read(regions.filter("doc_id = 1"), pages.embedded_blocks(long)).collect()} == set()
    assert pages.regions_to_read(regions, pages.embedded_blocks(long), force=True).count() == 2
    words = spark.createDataFrame([(1, 0, "a", [(0, 0), (9, 9)], 1.0), (1, 1, "b", [(0, 0)], 1.0)], "doc_id long, word_idx int, text string, vertices array<struct<x:int,y:int>>, confidence double")
    assert [(r.text, r.source) for r in pages.image_blocks(words).collect()] == [("a", "ocr")]


def test_the_library_does_not_need_the_training_data_operators():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "foliate"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(".llm" in n for n in names), p


def test_scratch_tables_are_cleared(spark):
    from pathlib import Path

    from foliate.runtime import clear_scratch, materialise, scratch_dir

    kept = materialise(spark.range(3))
    assert kept.count() == 3 and kept._foliate_path.startswith(scratch_dir(spark))
    clear_scratch(spark)
    assert not Path(kept._foliate_path.removeprefix("file://").removeprefix("file:")).exists()
