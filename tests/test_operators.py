from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark import session
from quillmark.operators import chunking, dense, evaluate, fuse, golden, loop, models, references, retrieve, scoring
from quillmark.sources import catalogues, json_files, manifest, readers
from quillmark.sources.pdf import page_texts as pdf_texts
from quillmark.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_windows(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 5, 114, 120)], "n int, text string")
    got = rows(chunking.word_windows(docs, "n", "text", 120, 20, 15, True), "n", "chunk_no", "n_words")
    assert got == [(5, 0, 5), (114, 0, 114), (120, 0, 120), (120, 1, 20)]
    docs = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (19, 20, 179, 180)], "n int, text string")
    got = rows(chunking.word_windows(docs, "n", "text", 200, 40, 20, False), "n", "chunk_no")
    assert got == [(20, 0), (179, 0), (180, 0), (180, 1)]


def test_tokens(spark):
    df = spark.createDataFrame([("BART.",), ("bart",), ("bm25 é!",), ("",)], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["bart"], ["bart"], ["bm25"], []]
    q = spark.createDataFrame([("what was X revenue",)], "q string").select(F.array_join(T.content_terms(F.col("q")), " | ")).first()[0]
    assert q == "x | revenue"


def test_numbered_sections(spark):
    body = "x" * 60
    text = f"front {body}\n3 Approach\n{body}\n3 Note that we fine-tune,\n2 Later text of lower number\n3.1 Details\n{body}\nReferences\n9 Hidden\n{body}"
    df = spark.createDataFrame([(1, text), (2, "References\nx"), (3, "")], "d int, text string")
    got = rows(chunking.numbered_sections(df, "d", "text"), "d", "section_idx", "title")
    assert got == [(1, 0, "(front matter)"), (1, 1, "3 Approach"), (1, 2, "3.1 Details")]


def test_merge_stubs(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((10, 100, 5, 90))] + [(2, 0, "y" * 5)], "g int, o int, t string")
    got = rows(chunking.merge_stubs(df, "g", "o", "t", 50), "g", "fragment", "n", "char_len")
    assert got == [(1, 1, 3, 117), (1, 2, 1, 90), (2, 1, 1, 5)]


def test_recursive_pieces():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(k)) for k in (50, 400, 3))
    parts = chunking.recursive_pieces(text, 450, 80)
    assert all(len(p) <= 450 for p in parts) and all(w in " ".join(parts).split() for w in text.split())
    assert chunking.recursive_pieces("", 10, 2) == [] and chunking.recursive_pieces("a" * 25, 10, 0) == ["a" * 10, "a" * 10, "a" * 5]


def test_items():
    filing = "c" * 500 + "\nITEM 1. Business\nx\nItem 1A. Risk\ny\nITEM 2. Other\nz"
    assert [t for t, _ in chunking.item_units(filing, "html")] == ["Front Matter", "ITEM 1. Business", "Item 1A. Risk", "ITEM 2. Other"]
    assert len(chunking.item_units(filing[500:], "html")) == 3 and chunking.item_units(filing, "pdf") == [(None, filing)]


@pytest.mark.parametrize(("source", "path", "lane"), [("sec", "sec/x.htm", "html"), ("archive", "archive/x.pdf", "scanned"), ("arxiv", "arxiv/readme.md", "md"), ("other", "other/a.pdf", "pdf"), ("sec", "sec/x", "html")])
def test_lane(spark, source, path, lane):
    assert spark.range(1).select(chunking.lane_of(F.lit(source), F.lit(path))).first()[0] == lane


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", k, 1.0 / r, r) for r, k in enumerate("abcd", 1)], "qid string, key string, score double, rank bigint")
    qs = spark.createDataFrame([("q", "x"), ("n", "x")], "qid string, kind string")
    for gold, k, recall, mrr in ((["b"], 3, 1.0, 0.5), (["b", "d"], 3, 0.5, 0.5), (["x"], 5, 0.0, 0.0), (["a"], 1, 1.0, 1.0)):
        g = spark.createDataFrame([("q", x) for x in gold], "qid string, key string")
        r = {(x.qid, x.k): x for x in evaluate.evaluate(ranking, g, qs, "qid", "key").collect()}
        assert r["q", k].recall == recall and r["q", k].mrr == pytest.approx(mrr) and r["q", k].hit == float(recall > 0)
        assert r["n", k].recall is None and r["n", k].mrr is None


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, key string, rank bigint")
    b = spark.createDataFrame([("q", "y", 1), ("q", "x", 2)], "qid string, key string, rank bigint")
    got = fuse.reciprocal(a, b, "qid", "key", fill=True).collect()
    assert {r.score for r in got} == {round(1 / 61 + 1 / 62, 10)}
    order = spark.createDataFrame([("q", k, r) for r, k in enumerate("abcde", 1)], "qid string, key string, rank bigint")
    head = spark.createDataFrame([("q", "d", 0.9), ("q", "b", 0.1)], "qid string, key string, score double")
    assert [r.key for r in fuse.head_tail(order, head, "qid", "key").orderBy("rank").collect()] == list("dbace")


def test_zero_fill(spark):
    s = spark.createDataFrame([("q", 3, 1.0)], "qid string, key int, score double")
    q = spark.createDataFrame([("q",), ("none",)], "qid string")
    got = rows(retrieve.zero_filled(s, "qid", "key", q, spark.createDataFrame([(k,) for k in (1, 2, 3)], "key int")), "qid", "key", "rank")
    assert got == [("none", 1, 1), ("none", 2, 2), ("none", 3, 3), ("q", 1, 2), ("q", 2, 3), ("q", 3, 1)]


def test_slices(spark):
    kinds = ["factual"] * 102 + ["negative"] * 39 + ["paraphrase"] * 19
    q = spark.createDataFrame([(f"q{i}", k) for i, k in enumerate(kinds)], "id string, type string")
    n = {r["type"]: r["count"] for r in golden.balanced(q, "type", "id", 30, "s").groupBy("type").count().collect()}
    assert n == {"factual": 19, "negative": 7, "paraphrase": 4}
    u = spark.createDataFrame([(f"p{i}",) for i in range(100)], "k string")
    got = golden.anchored_sample(u, u.limit(7).union(spark.createDataFrame([("gone",)], "k string")), "k", 0.4, "s").collect()
    assert len(got) == 40 and sum(r.gold for r in got) == 7
    assert [r.rn for r in golden.every_nth(u, "k", 10).orderBy("rn").collect()] == list(range(1, 101, 10))


def test_references(spark):
    qa = spark.createDataFrame([("1", ["s#1 ", None, "s#1", "\ns#2\n", "s#3", "s#9", "S#1"], None, "2024-01-01"), ("1", ["s#1"], ["s#1"], "2024-01-02"), ("2", None, ["s#3"], "2024-06-01")], "id string, a array<string>, b array<string>, at string").withColumn("at", F.to_timestamp("at"))
    sec = spark.createDataFrame([("s", "1", "2023-01-01", None), ("s", "2", "2023-01-01", None), ("s", "2", "2023-02-01", "2023-02-01"), ("s", "3", "2024-03-01", None), ("s", "3", "2024-04-01", None)], "source string, idx string, i string, d string")
    sec = sec.select("source", "idx", F.to_timestamp("i").alias("i"), F.to_timestamp("d").alias("d"))
    p = references.intervals(sec, F.concat_ws("#", "source", "idx"), "i", "d")
    got = rows(references.orphans(references.references(qa, "id", ["a", "b"], "at"), p), "id", "field", "parent_id", "state")
    assert got == [("1", "a", "S#1", "missing"), ("1", "a", "s#2", "deleted"), ("1", "a", "s#3", "late"), ("1", "a", "s#9", "missing")]
    r = rows(references.orphan_report(references.orphans(references.references(qa, "id", ["a", "b"], "at"), p)))
    assert ("a", "2024-01", "missing", 2, 1) in r
    none = references.orphans(references.references(qa, "id", ["a", "b"], "at"), p.limit(0))
    assert {x.state for x in none.collect()} == {"missing"}
    assert references.orphans(references.references(qa.limit(0), "id", ["a", "b"], "at"), p).count() == 0


def test_manifest(spark):
    m = spark.createDataFrame([("s", "1", "done", 5), ("s", "2", "done", 0), ("s", "3", "failed", None), ("t", "1", "done", 7)], "source string, id string, status string, bytes bigint")
    c = spark.createDataFrame([("s", k) for k in "1234"], "source string, id string")
    assert rows(manifest.to_pull(c, m, ["source", "id"])) == [("s", "2"), ("s", "4")]
    assert rows(manifest.to_pull(c, m, ["source", "id"], again=True)) == [("s", "2"), ("s", "3"), ("s", "4")]
    assert ("TOTAL", 3, 1, 12) in rows(manifest.status(m))
    new = spark.createDataFrame([("s", "3", "done", 9)], m.schema)
    assert manifest.upsert(m, new, ["source", "id"]).count() == 4


def test_download(tmp_path):
    import hashlib

    class Busy(Exception):
        status = 503

    waits, calls, now = [], [], [0.0]

    def stream(url):
        calls.append(url)
        yield b"da"
        if len(calls) < 3:
            raise Busy
        yield b"ta"

    def sleep(s):
        waits.append(s)
        now[0] += s

    throttle = catalogues.Throttle(lambda: now[0], sleep)
    target = str(tmp_path / "x" / "f.pdf")
    got = catalogues.download(stream, "http://a.example/f", target, wait=0.5, throttle=throttle, sleep=sleep)
    assert got == (4, hashlib.sha256(b"data").hexdigest()) and (tmp_path / "x" / "f.pdf").read_bytes() == b"data"
    assert waits == [1.0, 2.0] and not (tmp_path / "x" / "f.pdf.part").exists()
    throttle.before("http://a.example/g", 0.5)
    throttle.before("http://b.example/g", 0.5)
    assert waits == [1.0, 2.0, 0.5]
    with pytest.raises(KeyError):
        catalogues.again(lambda: {}["no"], sleep=sleep)


ANSWERS = {
    "arxiv": ("cs.CL", b"<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/1.2v3</id><title>A\n b</title></entry><entry><id>http://arxiv.org/abs/4.5v1</id></entry></feed>", [("1.2v3", "https://arxiv.org/pdf/1.2v3.pdf", "pdf", "A b"), ("4.5v1", "https://arxiv.org/pdf/4.5v1.pdf", "pdf", "")]),
    "sec": ("12", b'{"filings": {"recent": {"form": ["8-K", "10-K", "10-K"], "accessionNumber": ["1-1", "2-2", "3-3"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}}}', [("2-2", "https://www.sec.gov/Archives/edgar/data/12/22/b.htm", "htm", "12")]),
    "wikipedia": ("Law", b'{"query": {"categorymembers": [{"title": "A b/c"}]}}', [("A_b/c", "https://en.wikipedia.org/api/rest_v1/page/pdf/A_b%2Fc", "pdf", "A b/c")]),
    "archive": ("it", b'{"files": [{"name": "a.PDF", "size": "9"}, {"name": "b c.pdf", "size": "7"}, {"name": "d.txt"}]}', [("it", "https://archive.org/download/it/b%20c.pdf", "pdf", "b c.pdf")]),
    "datagov": ("0", b'{"result": {"results": [{"name": "p", "id": "q", "resources": [{"format": "csv", "url": "u"}, {"format": "pdf", "url": "v"}]}, {"resources": []}]}}', [("q", "v", "pdf", "p")]),
    "rtd": ("proj", b"", [("proj", "https://proj.readthedocs.io/_/downloads/en/latest/pdf/", "pdf", "proj")]),
}


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_catalogues(spark, tmp_path, name):
    """Every catalogue from saved answers, as a data source with a partition a page."""
    import hashlib

    page, answer, want = ANSWERS[name]
    if url := catalogues.CATALOGUES[name].request(page, 5):
        (tmp_path / hashlib.sha256(url.encode()).hexdigest()).write_bytes(answer)
    got = catalogues.entries(spark, name, [page], 5, str(tmp_path))
    assert [(r.id, r.url, r.format, r.title) for r in got.collect()] == want and {r.source for r in got.collect()} == {name}


def test_files_and_parsers(spark, tmp_path):
    (tmp_path / "sec").mkdir()
    (tmp_path / "rtd").mkdir()
    (tmp_path / "sec" / "f.htm").write_text("<nav>menu</nav><p>Hi &amp; bye</p><p>there</p>")
    (tmp_path / "sec" / ".hidden.md").write_text("x")
    (tmp_path / "sec" / "x.bin").write_text("x")
    (tmp_path / "rtd" / "b.md").write_text("two")
    (tmp_path / "rtd" / "a.md").write_text("öne")
    files = readers.files(spark, str(tmp_path))
    ok, bad = readers.parsed(files.unionByName(files.withColumn("lane", F.lit("none"))), readers.PARSERS)
    assert rows(ok, "doc_id", "text") == [("rtd/a", "öne"), ("rtd/b", "two"), ("sec/f", "Hi & bye\nthere")] and bad.count() == 3
    assert [r.doc_id for r in readers.files(spark, str(tmp_path), only="rtd").orderBy("path").collect()] == ["rtd/a", "rtd/b"]
    assert [r.doc_id for r in readers.files(spark, str(tmp_path), limit=2).orderBy("path").collect()] == ["rtd/a", "rtd/b"]
    assert [(r.file_no, r.text) for r in readers.markdown(spark, str(tmp_path / "rtd")).orderBy("file_no").collect()] == [(1, "öne"), (2, "two")]
    assert ok.where("doc_id = 'sec/f'").select(readers.plain_html(F.lit("<p>Hi &amp; bye</p>"))).first()[0] == "Hi & bye"


def test_pdf_pages():
    import zlib

    one = zlib.compress(b"BT /F1 12 Tf 72 700 Td (First \\(line\\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET")
    two = b"BT (caf\\351) Tj T* <414243> Tj ET"
    pdf = b"%PDF-1.4\n" + b"".join([
        b"1 0 obj << /Type /Pages /Kids [2 0 R 3 0 R] /Count 2 >> endobj\n", b"2 0 obj << /Type /Page /Contents 4 0 R >> endobj\n", b"3 0 obj << /Type /Page /Contents [5 0 R] >> endobj\n",
        b"4 0 obj << /Length %d /Filter /FlateDecode >> stream\n" % len(one) + one + b"\nendstream endobj\n", b"5 0 obj << /Length %d >> stream\n" % len(two) + two + b"\nendstream endobj\n",
    ])
    assert pdf_texts(pdf) == ["First (line)\nsecond line", "caf\u00e9\nABC"]
    with pytest.raises(ValueError):
        pdf_texts(b"no pdf")


def test_json_files(spark, tmp_path):
    import json

    (tmp_path / "qa.json").write_text('[{"id": "a", "n": 1},\n {"id": "b", "x": 2}]')
    assert rows(json_files.scan(spark, str(tmp_path / "qa.json"), "id string, n int", lines=False)) == [("a", 1), ("b", None)]
    d = spark.createDataFrame([("s", "1", None), ("s", "2#A", "t\n")], "source string, section_idx string, text string")
    json_files.write(d, str(tmp_path / "out"))
    back = json_files.parents(json_files.scan(spark, str(tmp_path / "out"), d.schema))
    assert rows(back, "parent_id", "text") == [("s#1", None), ("s#2#A", "t\n")]
    name = json_files.write_result(d, str(tmp_path), "bm25", {"k": 5}, "now")
    saved = json.loads(open(name).read())
    assert name.endswith("bm25_now.json") and saved["k"] == 5 and len(saved["rows"]) == 2
    with pytest.raises(ValueError):
        json_files.write_result(d, str(tmp_path), "bm25", {}, "now", most=1)
    (tmp_path / ".env").write_text("# c\nexport A='b=c'\nB = 2\n")
    assert json_files.settings(str(tmp_path / ".env")) == {"A": "b=c", "B": "2"}


def test_models(spark):
    """Forms with one more asking, models that fail, caches, and the writer's refusal."""

    class Failing:
        name = "failing"

        def answer(self, prompts):
            raise OSError("down")

    class Stubborn:
        name = "stubborn"

        def answer(self, prompts):
            return ["{\"verdict\": \"maybe\"}" for _ in prompts]

    p = spark.createDataFrame([(i, f"QUESTION: red bridge {'x' * i}\nANSWER: the red bridge") for i in range(6)] + [(9, None)], "k bigint, p string")
    check = models.enum_field("verdict", models.VERDICTS)
    got = models.ask(p, "k", "p", models.OverlapJudge, check, size=2, workers=2).collect()
    assert {r.answer for r in got} <= set(models.VERDICTS) and {r.calls for r in got} == {1, 2} and len(got) == 7
    assert {(r.answer, r.reason) for r in models.ask(p, "k", "p", Failing).collect()} == {(None, "OSError: down")}
    assert {(r.answer, r.calls, r.reason) for r in models.ask(p, "k", "p", Stubborn, check).collect()} == {(None, 2, "answer does not fit the form")}
    assert models.json_object('so: ```{"a": {"b": 1}} {') == {"a": {"b": 1}} and models.json_object("[1]") is None and models.json_object(None) is None
    cache = spark.createDataFrame([], "fp string, answer string")
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k bigint, p string")
    got, new = models.ask_cached(q, "k", "p", "m", models.FirstPassage, cache)
    assert new.count() == 2 and got.where("hit").count() == 0
    got, newer = models.ask_cached(q, "k", "p", "m", models.FirstPassage, new)
    assert newer.count() == 0 and got.where("hit").count() == 3
    w = models.FirstPassage(0.5)
    assert w.answer(["Context:\n[1] T\nthe red bridge\n\n[2] U\nx\n\nQuestion: red bridge?\nAnswer:", "Context:\n\n\nQuestion: red?\nAnswer:"]) == ["the red bridge", loop.REFUSAL]
    e = {r.k: r.embedding for r in models.embedded(q, "k", "p", lambda: models.HashedWords(8)).collect()}
    assert e[1] == e[2] != e[3] and sum(x * x for x in e[1]) == pytest.approx(1)


def test_scoring_ways(spark, monkeypatch):
    """Blocks of questions and joined norms give what one block and broadcast norms give; texts without terms and empty tables have no rows."""
    texts = [(f"d{i}#{j}", f"d{i}", " ".join("red blue bridge river stone old new".split()[k % 7] for k in range(i + j, i + 2 * j + 3))) for i in range(6) for j in range(4)] + [("e#0", "e", ""), ("n#0", "n", None)]
    d = spark.createDataFrame(texts, "k string, p string, t string")
    q = spark.createDataFrame([(i, w, 1 + i % 2) for i in range(5) for w in ("red", "bridge", "nothing", "old")[i % 3 :]], "qid bigint, term string, qtf bigint")
    for mode in ("bm25", "okapi", "tfidf", "any", "all", "share"):
        one = rows(scoring.Index.build(d.where("t is not null"), "k", "p", "t").scores(q, mode))
        monkeypatch.setattr(scoring, "BLOCK", 2)
        monkeypatch.setattr(scoring, "MOST_TERMS", 1)
        assert rows(scoring.Index.build(d.where("t is not null"), "k", "p", "t").scores(q, mode)) == one
        monkeypatch.undo()
        best = {}
        for qid, k, s in one:
            best[qid, k.split("#")[0]] = max(s, best.get((qid, k.split("#")[0]), s))
        assert {(a, b): s for a, b, s in rows(scoring.Index.build(d.where("t is not null"), "k", "p", "t").scores(q, mode, "parent"))} == best
    top = scoring.Index.build(d.where("t is not null"), "k", "p", "t").scores(q, "bm25", most=2)
    assert {(r.qid, r.key) for r in retrieve.ranked(top, "qid", [F.desc("score"), F.col("key")], most=2).collect()} <= {(r.qid, r.key) for r in top.collect()}
    empty = scoring.Index.build(d.limit(0), "k", "p", "t")
    assert empty.scores(q, "bm25").count() == 0 and scoring.Index.build(d.where("t is not null"), "k", "p", "t").scores(q.limit(0), "bm25").count() == 0


def test_dense_store(spark):
    v = spark.createDataFrame([("a#1", "a", [1.0, 0.0]), ("a#2", "a", [0.0, 2.0]), ("b#1", "b", [3.0, 3.0]), ("n", "n", None), ("z", "z", [0.0, 0.0]), ("x", "x", [1.0, None]), ("l", "l", [1.0, 1.0, 1.0]), ("i", "i", [float("nan"), 1.0])], "k string, p string, e array<double>")
    store = dense.DenseStore(v, "k", "p", "e")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0])], "qid bigint, vector array<double>")
    assert rows(store.retrieve(q, 2), "qid", "key", "score") == [(1, "a#1", 1.0), (1, "b#1", 0.707107), (2, "a#1", 0.707107), (2, "b#1", 1.0)]
    assert rows(store.parents(q), "qid", "parent", "rank") == [(1, "a", 1), (1, "b", 2), (2, "a", 2), (2, "b", 1)]
    with pytest.raises(ValueError):
        dense.DenseStore(v, "k", "p", "e", most_queries=1).scores(q)


def test_numbered_and_samples(spark):
    d = spark.createDataFrame([(f"section-{i:05d}",) for i in range(2000)], "k string")
    assert rows(golden.numbered(d, "k"), "k", "rn") == [(f"section-{i:05d}", i + 1) for i in range(2000)]
    hashed = d.withColumn("h", golden.hash_order("s", "k"))
    for n in (0, 1, 777, 2000, 5000):
        rest = spark.createDataFrame([(n,)], "rest bigint")
        want = sorted((r.h, r.k) for r in hashed.collect())[:n]
        for digits in (1, 4):
            assert sorted((r.h, r.k) for r in golden.first_by_hash(hashed, "h", rest, digits).collect()) == want
    got = {r.k: r.f for r in golden.following(d.limit(40).withColumn("g", F.substring("k", 13, 1)), "g", "k", "k", 3, "f").collect()}
    assert got["section-00000"] == ["section-00000", "section-00010", "section-00020"] and got["section-00030"] == ["section-00030"]


def test_shared_folder():
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")


def test_only_touched_buckets_are_written(spark, tmp_path):
    target = str(tmp_path / "t")
    b = spark.createDataFrame([(f"k{i}", "x", 1, None) for i in range(50)], "k string, text string, at int, gone string")
    ingest.apply_batch(target, b, "k", "text", "at", "gone", keep=2, buckets=8)
    one = ingest.version(spark, target)
    ingest.apply_batch(target, spark.createDataFrame([("k1", "y", 2, None), ("k1", "old", 0, None)], b.schema), "k", "text", "at", "gone", keep=2)
    two = ingest.version(spark, target)
    assert (two.number, two.buckets, len(one.folders)) == (1, 8, 8) and sum(one.folders[k] != f for k, f in two.folders.items()) == 1
    ingest.apply_batch(target, spark.createDataFrame([(f"k{i}", None, 3, "z") for i in range(50)], b.schema), "k", "text", "at", "gone", keep=2)
    assert ingest.current(spark, target).count() == 0 and ingest.versions(spark, target) == ["v-0000000001", "v-0000000002"]
    assert spark.read.schema(two.schema).parquet(*(f"{target}/{f}" for f in two.folders.values())).where("text = 'y'").count() == 1
    ingest.apply_batch(target, spark.createDataFrame([("n", "new", 4, None)], b.schema), "k", "text", "at", "gone", keep=2)
    assert rows(ingest.current(spark, target), "k", "text") == [("n", "new")]


def test_unreadable_table_raises(spark, tmp_path):
    """A table that cannot be read is not an empty one."""
    target = str(tmp_path / "t")
    assert ingest.current(spark, target) is None
    b = spark.createDataFrame([("a", "x", 1, None)], "k string, text string, at int, gone string")
    ingest.apply_batch(target, b, "k", "text", "at", "gone")
    assert ingest.current(spark, target).count() == 1
    for f in (tmp_path / "t").rglob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        ingest.apply_batch(target, spark.createDataFrame([("a", "y", 2, None)], b.schema), "k", "text", "at", "gone")
    for f in (tmp_path / "t" / "v-0000000000").glob("part-*"):
        f.write_text("broken")
    with pytest.raises(Exception):  # noqa: B017
        ingest.apply_batch(target, spark.createDataFrame([("b", "y", 2, None)], b.schema), "k", "text", "at", "gone")


def test_spend(spark):
    prices = spark.createDataFrame([("m", 1.0, 5.0), ("mm", 10.0, 50.0)], "prefix string, price_in double, price_out double")
    calls = spark.createDataFrame([(1, "m-1", 1_000_000, 0, False), (2, "m-1", 1_000_000, 0, True), (3, "mm-2", 1_000_000, 0, False), (4, "zzz", 1_000_000, 0, False)], "n int, model string, i bigint, o bigint, hit boolean")
    p = loop.priced(calls, prices, "model", "i", "o", F.col("hit"))
    assert {r.n: r.usd for r in p.collect()} == {1: 1.0, 2: 0.0, 3: 10.0, 4: 10.0}
    one = spark.createDataFrame([(k, 1.0) for k in range(5)], "n int, usd double").withColumn("g", F.lit("a"))
    assert [r.allowed for r in loop.within_budget(one, "n", 2.5, "g").orderBy("n").collect()] == [True, True, True, False, False]


def test_loop(spark):
    q = spark.createDataFrame([("a",), ("b",)], "qid string")
    hit = spark.createDataFrame([("a", "p", "ambiguous"), ("b", "p", "incorrect")], "qid string, key string, verdict string")
    got = {r.qid: r for r in loop.run_loop(q, lambda s: hit, "qid", 2).collect()}
    assert got["a"].trace == "retrieve>grade>generate" and not got["a"].refused
    assert got["b"].trace == "retrieve>grade>refine>retrieve>grade>refine>retrieve>grade>refuse"
    assert loop.run_loop(q, lambda s: hit.limit(0), "qid", 0).where("refused").count() == 2


def test_incremental_ingest(spark, tmp_path):
    target = str(tmp_path / "t")

    def batch(*r):
        return spark.createDataFrame(list(r), "k string, text string, at int, gone string")

    def now():
        return rows(ingest.current(spark, target), "k", "text", "at")

    ingest.apply_batch(target, batch(("a", "1", 1, None), ("b", "1", 1, None), ("b", "2", 2, None)), "k", "text", "at", "gone")
    assert now() == [("a", "1", 1), ("b", "2", 2)]
    change = batch(("a", "1", 3, None), ("b", "3", 3, None), ("c", "1", 3, None))
    ingest.apply_batch(target, change, "k", "text", "at", "gone")
    assert now() == [("a", "1", 1), ("b", "3", 3), ("c", "1", 3)]
    ingest.apply_batch(target, change, "k", "text", "at", "gone")
    assert now() == [("a", "1", 1), ("b", "3", 3), ("c", "1", 3)]
    ingest.apply_batch(target, batch(("c", None, 4, "x"), ("b", "old", 1, None)), "k", "text", "at", "gone")
    assert now() == [("a", "1", 1), ("b", "3", 3)]


def test_plan(spark, sf):
    from quillmark.plans import retrieval

    plan = retrieval.Corpus(spark, sf).children._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = retrieval.QUERIES["bm25_parent_rank"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<key:string,parent:bigint,dl:bigint,terms:array<bigint>,tf:array<int>>" in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_resize(spark):
    body = "x" * 2600
    giant = f"intro\n{body}\nA. Retrieval Source\n{body}\nA. Again lower\nB. Indexing\n{body}\nC. Trailing comma,"
    df = spark.createDataFrame([(1, 0, "1 One", giant), (1, 1, "2 Runt", "tiny"), (1, 2, "3 Three", "y" * 600)], "d int, section_idx bigint, title string, text string")
    got = rows(chunking.resize_sections(df, "d"), "d", "section_idx", "title")
    assert got == [(1, "0", "1 One"), (1, "0#A", "A. Retrieval Source"), (1, "0#B", "B. Indexing"), (1, "2", "3 Three")]
    assert chunking.resize_sections(df, "d").where("section_idx = '0#B'").first().text.endswith("C. Trailing comma,\ntiny")
    assert chunking.resize_sections(df.limit(0), "d").count() == 0


def test_markdown(spark):
    df = spark.createDataFrame([(1, "top\n## Table of Contents\na\n## Real part\nbody")], "d int, t string")
    got = {r.grp: (r.heading, r.body) for r in chunking.markdown_sections(df, "d", "t").collect()}
    assert got == {0: (None, "top"), 2: ("Real part", "## Real part\nbody")}


def test_tables(spark):
    from quillmark.plans import tables

    tables.create_database(spark, "quillmark_test", reset=True)
    try:
        tables.build(spark, "quillmark_test", "postings", spark.range(100).selectExpr("id % 7 AS term", "id"), "term", 4)
        tables.build(spark, "quillmark_test", "postings", spark.range(1).selectExpr("id AS term", "id"), "term", 4)
        tables.analyze(spark, "quillmark_test", "postings")
        t = spark.table("quillmark_test.postings")
        assert t.count() == 100 and "Bucketed: true" in tables.plan_of(t.groupBy("term").count())
    finally:
        spark.sql("DROP DATABASE IF EXISTS quillmark_test CASCADE")
    assert [r.ok for r in tables.checks(spark, [("a", 1, 1, "=="), ("b", 2, 3, ">=")]).collect()] == [True, False]
    assert tables.collection_name("lab", "BGE-M3.v1") == "lab__bge_m3_v1" and tables.candidates(200, 50) == 200
