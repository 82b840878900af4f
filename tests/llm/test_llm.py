from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import same  # noqa: E402

from quillmark.llm import leaks, neardup, packing, pairs, pii, quality, queries, scans, shingles, splitting, vectors  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]


def tok(t):
    return re.findall("[a-z0-9]+", t.lower())


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


# ---- shingles
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 ,éİK\n☃ß", max_size=30)), max_size=12))
def test_tokens_by_numpy(texts):
    r, h, _ = shingles.token_hashes(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) if t for w in tok(t)]
    assert [int(x) for x in r] == [i for i, _ in want]
    names: dict = {}
    for (_, w), x in zip(want, h):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


# ---- 1 splitting
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\né", max_size=400), st.integers(20, 60))
def test_split_round_trip(text, limit):
    parts = splitting.cut(text, limit, 8)
    assert "".join(text[o:e] for _, o, e in parts) == text
    assert all(e - s <= limit for s, _, e in parts) and all(s <= o for s, o, _ in parts)


def test_split_at_topic_change():
    a = " ".join("The river flooded the valley and the river bank." for _ in range(6))
    b = " ".join("Interest rates moved the bond market and bond prices." for _ in range(6))
    text = a + " " + b
    parts = splitting.cut(text, len(a) + 120, 40)
    assert abs(parts[0][2] - len(a)) <= 2


def test_depths_in_linear_time():
    """Against the plain definition; and a listing of 100,000 equal lines, every gap of which lies on one plateau."""
    import time
    from collections import Counter

    rng = np.random.default_rng(8)
    text = " ".join(". ".join(" ".join(rng.choice(["river", "bridge", "ledger", "harbour", "signal"], 6)) for _ in range(3)) + "." for _ in range(40))
    at, _ = splitting.gaps(text)
    edges = [0, *at.tolist(), len(text)]
    bags = [Counter(w[:5] for w in text[a:z].replace(".", " ").split()) for a, z in zip(edges, edges[1:])]
    sim = []
    for i in range(len(at)):
        x, y = sum(bags[max(0, i - 2) : i + 1], Counter()), sum(bags[i + 1 : i + 4], Counter())
        sim.append(sum(c * y[w] for w, c in x.items()) / (sum(c * c for c in x.values()) * sum(c * c for c in y.values())) ** 0.5)
    want = []
    for i in range(len(sim)):
        j = k = i
        while j and sim[j - 1] >= sim[j]:
            j -= 1
        while k + 1 < len(sim) and sim[k + 1] >= sim[k]:
            k += 1
        want.append((sim[j] + sim[k]) / 2 - sim[i])
    assert np.allclose(splitting.depths(text, at), want)
    text = "same words again\n" * 100_000
    began = time.time()
    splitting.depths(text, splitting.gaps(text)[0])
    assert time.time() - began < 5


def test_split_edges(spark):
    d = spark.createDataFrame([("n", None, "z"), ("e", "", "z"), ("s", "ab", "z"), ("s", "ab", "z"), ("l", "x" * 5000, "z"), (None, "y " * 900, "z")], "k string, t string, piece string")
    got = splitting.pieces(d, "k", "t", 450, 80)
    assert {r.k for r in got.collect()} == {"e", "s", "l", None} and got.where("length(piece) > 450").count() == 0
    assert rows(splitting.oversized(got, "k")) == [("l",)]
    assert splitting.pieces(d.limit(0), "k", "t", 450, 80).count() == 0


# ---- 2 statistics
@pytest.mark.parametrize(("text", "kind"), [
    ("The board of the company approved a change in the reserve, and the member was moved.", "prose"),
    ("Der Kanal von Halle und der Bezirk sind in den Tabellen nicht enthalten, aber es gibt einen Abschnitt.", "prose"),
    ("* default middleware\n- optional exception\n• nested module\n* quiet handler", "list"),
    ("1. fiscal lender (Alpha)\n2. latent token (Beta)\n3. convex query (Gamma)", "list"),
    ("Sparse Chunking ........ 13\nLinear Calibration ..... 15\nConvex Query ..... 19", "list"),
    ("Alpha, 29, 125\nBeta, 69, 159\nGamma, 32, 358", "list"),
    ("Name\t2025\t2023\nAlpha row\t0.81\t1,322,193\nBeta row\t18.8%\t(524)", "table"),
    ("Name | 2025 | 2023\n---|---|---\nAlpha | 0.81 | 1,322\nBeta | 18.8% | —", "table"),
    ("Name,2025,2023\nAlpha row,0.81,1322\nBeta row,18.8%,—", "table"),
    ("(cid:12) (cid:99) (cid:3) (cid:77)", "junk"), ("}{>:~ #;/|_ ^*.<; =`'", "junk"), ("zK20zjxBMzWdWqUWRHaXwt7N5pgeZ9CE7ig1CSVMjr0Eq31V0VotofAirDH", "junk"), (" \n\t ", "junk"), ("", "junk"),
])
def test_kinds(text, kind):
    assert quality.text_kind(text, quality.Classes())[0] == kind


@pytest.mark.parametrize(("title", "kind"), [("ITEM 10B. Diluted Underwriter of Oslo", "prose"), ("buffer_transaction()", "prose"), ("III. Estimator in O(n log n)", "prose"), ("Changed in 9.4", "prose"), ("2019 2013 2003 % chg", "table"), ("Total\t2,329\t12.2%", "table"), ("Halle | 6,950 | 1,251", "table"), ("11.2 9,702 (52) —", "table"), ("...... 241", "junk"), ("499b13d403b144f8f79f42886581cec3", "junk"), ("kqw88q8pvh1gqng", "junk"), ("(cid:85)(cid:70)", "junk"), ("Ã¢â‚¬Â§Ã", "junk")])
def test_titles(title, kind):
    assert quality.title_kind(title, quality.Classes()) == kind


def test_statistics_edges(spark):
    d = spark.createDataFrame([("a", None, None, 1), ("b", "", "A title", 1), ("c", "The end of the day is near.", None, 1), ("c", "The end of the day is near.", None, 1), (None, "The end.", "T", 1)], "key string, text string, title string, kind int")
    got = quality.text_statistics(d, "key", "text", "title")
    assert got.count() == 4 and rows(quality.not_prose(d, "key", "text", "title")) == [("b", "text", "junk")]
    assert quality.text_statistics(d.limit(0), "key", "text", "title").count() == 0


def test_divergence():
    assert quality.divergence({"a": 1}, {"a": 7}) == pytest.approx(0) and quality.divergence({"a": 1}, {"b": 1}) == pytest.approx(1) and quality.divergence({}, {"a": 1}) == 1


@pytest.mark.parametrize(("text", "language"), [("A Marta canta bem.", "pt"), ("Kot i pies.", "pl")])
def test_language_third_by_words(text, language):
    assert quality.statistics(text, None, quality.Classes())["language"] == language  # two languages before it have as many of the words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(sorted(quality.FUNCTION)), min_size=1, max_size=12))
def test_language_nearest_of_all(words):
    def entropy(x):
        return -(x[x > 0] * np.log2(x[x > 0])).sum()

    vocabulary = sorted(quality.FUNCTION)
    p = np.array([words.count(w) for w in vocabulary], float) / len(words)
    far = {}
    for k, v in quality.PROFILES_LANG.items():
        q = np.array([v.get(w, 0) for w in vocabulary])
        q /= q.sum()
        far[k] = entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2
    got = quality.statistics(" ".join(words), None, quality.Classes())
    assert got["language_divergence"] == pytest.approx(min(far.values())) and far[got["language"]] == pytest.approx(min(far.values()))


# ---- 3 scans
PAGE = "The pleas-\nant column was seen by thé river, and the wide-\n[ 12 ]\nTHE VALLEY OF HALLE\nranging framéwork stood near the old column of stone there.\n\nIV.\n\nThe colurnn was old and the river was very wide there too."
FILL = "\n".join(["The pleasant column was seen by the river, and the wide-ranging framework stood near the old column of stone."] * 30)


def test_scans(spark):
    d = spark.createDataFrame([("s", "p", PAGE, 0), ("s", "f", FILL, 0), ("s", "n", None, 0), ("s", "e", "", 0)], "tbl string, item_id string, text string, first int")
    rep = scans.repairs(d)
    got = [(n, k) for i, n, k in rows(rep.where("item_id = 'p'"), "item_id", "noise", "line_no")]
    assert sorted(got) == [("hyphenation", 1), ("misread", 2), ("misread", 5), ("misread", 9), ("page_number", 3), ("running_header", 4)]
    assert rep.where("item_id != 'p'").count() == 0
    text = {r.item_id: r.text for r in scans.paragraphs(d, rep).collect()}
    assert text["p"] == "The pleasant column was seen by the river, and the wide-ranging framework stood near the old column of stone there.\n\nIV.\n\nThe column was old and the river was very wide there too."
    assert scans.repairs(d.limit(0)).count() == 0


def test_scans_of_many_copies(spark):
    data = [("s", "f", FILL, 0)] + [("s", f"c{i}", PAGE, 0) for i in range(20)] + [("q", f"m{i}", f"error {i}\n{PAGE}", 1) for i in range(20)] + [("s", f"v{i}", f"{PAGE} The stone {i % 7} was there.", 0) for i in range(20)]
    rep = scans.repairs(spark.createDataFrame(data, "tbl string, item_id string, text string, first int")).where("noise = 'misread'")
    got = rows(rep.groupBy("tbl", "item_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines")), "item_id", "lines")
    assert len(got) == 60 and all(lines == ([3, 6, 10] if i[0] == "m" else [2, 5, 9]) for i, lines in got)


def test_repairs_stay_on_their_line(spark):
    pages = spark.createDataFrame([("s", "a#1", "the modem was here\nand the modem was there\nat last", 0)], "tbl string, item_id string, text string, first int")
    fixes = spark.createDataFrame([("s", "a#1", "misread", 1, "modem", "modern")], "tbl string, item_id string, noise string, line_no bigint, w string, meant string")
    assert scans.paragraphs(pages, fixes).first().text == "the modern was here and the modem was there at last"


def test_heads_have_to_recur(spark):
    """A line in capitals inside a sentence is text, where its source has other pages without it; a repeated one is a head, also misread."""
    body = "the old bridge stood near the harbour and the river ran below it"
    lone = f"{body}\nwhile the members of the council met\nROYAL GEOGRAPHICAL SOCIETY\nof London had agreed to see it\n{body}"
    again = [f"{body}\n{body}\n{h}\n{body} {k}\n{body}" for k, h in enumerate(["THE HOUSEHOLD OF MARN", "THE H0USEHOLD OF MARN"])]
    pages = spark.createDataFrame([("s", f"a#{k}", t, 0, "a") for k, t in enumerate([lone, *again])], "tbl string, item_id string, text string, first int, source string")
    got = {(r.item_id, r.line_no) for r in scans.found(scans.repairs(pages)).where("noise = 'running_header'").collect()}
    assert got == {("a#1", 3), ("a#2", 3)}
    assert "met ROYAL GEOGRAPHICAL SOCIETY of London" in {r.item_id: r.text for r in scans.paragraphs(pages, scans.repairs(pages)).collect()}["a#0"]


def test_long_words_meet():
    w = "".join(chr(97 + (7 * k * k + 3 * k) % 26) for k in range(60))
    for other in (w[:20] + w[22:], w[:5] + "q" + w[5:], "zz" + w, w[:-2], w[:29] + "#" + w[30:59], w[1:30] + w[31:]):
        assert set(scans.thirds(w)) & set(scans.thirds_met(other)) and set(scans.thirds(other)) & set(scans.thirds_met(w))


def test_weighted_distance():
    assert scans.weighted_distance("rnargin", "margin")[0] < 0.5 < scans.weighted_distance("bargin", "margin")[0]
    assert scans.weighted_distance("viUage", "village")[0] < 0.5 and scans.weighted_distance("abc", "abc") == (0.0, -1)


# ---- 4 near-duplicates
def brute(texts, width, least, t):
    sets = {k: frozenset(zip(*[tok(x)[i:] for i in range(width)])) for k, x in texts.items() if x and len(tok(x)) >= least}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


@pytest.mark.parametrize("limit", [None, 0, 9, 40])
def test_near_duplicates(spark, monkeypatch, limit):
    if limit is not None:  # both kinds of sets, whatever the cost model says
        monkeypatch.setattr(neardup, "boundary", lambda *a, **k: limit)
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(60):
        base = list(rng.choice(WORDS[:80], rng.integers(3, 230)))
        texts[f"d{i}"] = " ".join(base)
        for j in range(rng.integers(0, 3)):
            w = base.copy()
            for _ in range(rng.integers(0, max(1, len(w) // 8))):
                w[rng.integers(0, len(w))] = str(rng.choice(WORDS))
            texts[f"d{i}.{j}"] = " ".join(w)
    texts |= {"null": None, "empty": "", "short": "a b", "twin1": texts["d0"], "twin2": texts["d0"].upper(), "same": "a " * 40}
    d = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [("d0", texts["d0"], 1)], "id string, text string, h int")
    classes, found = neardup.near_duplicates(d, "id", "text", 0.6, 3, 4)
    got = {tuple(r) for r in neardup.linked_keys(classes, found).collect()}
    assert got == brute(texts, 3, 4, 0.6)
    star = {tuple(r) for r in neardup.linked_keys(classes, found, whole=1).collect()}
    assert ("d0", "twin1") in star and ("twin1", "twin2") not in star
    g = {r.key: r.group_id for r in neardup.groups(classes, found).collect()}
    assert all(g[a] == g[b] for a, b in got) and len(set(g.values())) > 10


@pytest.mark.parametrize("limit", [0, 30])
def test_divided_lists(spark, monkeypatch, limit):
    """Texts of one template share lists longer than HOT, which are divided; the pairs are those of brute force, each list pair met once."""
    monkeypatch.setattr(neardup, "HOT", 16)
    monkeypatch.setattr(neardup, "LONG", 10)
    monkeypatch.setattr(neardup, "boundary", lambda *a, **k: limit)
    rng = np.random.default_rng(6)
    base = [str(x) for x in rng.choice(WORDS, 40)]
    texts = {}
    for i in range(220):
        w = list(base)
        for k in rng.integers(0, 40, int(rng.integers(0, 9))):
            w[k] = str(rng.choice(WORDS))
        texts[i] = " ".join(w[: 40 - int(rng.integers(0, 12))])
    sets = {k: set(zip(*[tok(v)[j:] for j in range(3)])) for k, v in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    d = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    classes, found = neardup.near_duplicates(d, "id", "text", 0.6, 3, 4)
    assert {tuple(r) for r in neardup.linked_keys(classes, found).collect()} == want and len(want) > 1000
    levels = np.full(4, int(8 * np.log2(1 + 100)), np.uint8)
    assert (neardup.divisions(levels, 1.0, 16) == 3).all() and not neardup.divisions(levels, 90.0, 16).any()


def test_long_list_in_time():
    """One list of 24,000 different sets of alike sizes, compared block against block; the same pairs as by distance."""
    import time

    rng = np.random.default_rng(7)
    n = 24_000
    wide = np.zeros((n, 8), np.uint64)
    wide[:, :2] = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    wide[100:200] = wide[:100]
    p = neardup.Postings(np.zeros(n, np.int64), np.sort(rng.integers(40, 44, n)).astype(np.int32), rng.permutation(n).astype(np.int64), np.full(n, 2), wide)
    began = time.time()
    pairs_ = sum(len(z) for z, _ in neardup._close(p, np.ones(n, bool), 0.6))
    assert time.time() - began < 5 and pairs_ >= 100
    few = p.take(np.arange(400))
    one = {(int(a), int(b)) for z, y in neardup._close(few, np.ones(400, bool), 0.6) for a, b in zip(z, y)}
    old = neardup.LONG
    neardup.LONG = 1000
    try:
        assert one == {(int(a), int(b)) for z, y in neardup._close(few, np.ones(400, bool), 0.6) for a, b in zip(z, y)}
    finally:
        neardup.LONG = old


def test_large_classes_give_all_pairs(spark):
    base = " ".join(WORDS[:30])
    texts = {f"k{i:03}": base.upper() if i % 2 else base for i in range(70)} | {f"n{i}": base + f" x{i // 2}" for i in range(4)}
    d = spark.createDataFrame(list(texts.items()) + [("k000", base + " x0")], "id string, text string")
    classes, found = neardup.near_duplicates(d, "id", "text", 0.6, 3, 12)
    want = {(a, b) for a in texts for b in texts if a < b}
    for block in (256, 9):
        got = [tuple(r) for r in neardup.linked_keys(classes, found, block=block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_groups_end_when_nothing_changes(spark):
    classes = spark.createDataFrame([(f"k{i}", i) for i in range(12)], "key string, h bigint")
    chain = spark.createDataFrame([(i, i + 1) for i in range(11)], "a bigint, b bigint")
    assert {r.group_id for r in neardup.groups(classes, chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        neardup.groups(classes, chain, rounds=1)


def test_near_duplicates_empty(spark):
    d = spark.createDataFrame([("a", None), ("b", "")], "id string, text string")
    classes, found = neardup.near_duplicates(d, "id", "text")
    assert classes.count() == found.count() == 0


# ---- 5 vectors
def test_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, 16))
    x = (centre[rng.integers(0, 12, 1500)] + 0.5 * rng.standard_normal((1500, 16))).astype(np.float32)
    data = [(f"v{i}", "g", v.tolist(), "e") for i, v in enumerate(x)] + [(f"c{i}", "g", x[0].tolist(), "e") for i in range(14)]
    data += [("v0", "g", x[0].tolist(), "e"), ("null", "g", None, "e"), ("empty", "g", [], "e"), ("zero", "g", [0.0] * 16, "e"), ("nan", "g", [float("nan")] + [1.0] * 15, "e"), ("inf", "g", [float("inf")] + [1.0] * 15, "e"), ("long", "g", [1.0] * 17, "e"), ("part", "g", [None] + [1.0] * 15, "e"), (None, "g", [1.0] * 16, "e"), ("only", "h", [1.0, 2.0], "e")]
    d = spark.createDataFrame(data, "id string, grp string, v array<float>, cosine string")
    links = vectors.nearest(d, "id", "grp", "v", 10, list_size=100, probes=8)
    got: dict = {}
    for r in links.collect():
        got.setdefault(r.id, {})[r.neighbour] = r.cosine
    ids = [f"v{i}" for i in range(1500)] + [f"c{i}" for i in range(14)]
    assert set(got) == set(ids) and all(len(v) == 10 for v in got.values())
    u = np.concatenate([x, np.repeat(x[:1], 14, 0)]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -2)
    hit = sum(len(got[ids[i]].keys() & {ids[j] for j in np.argsort(-g[i])[:10]}) for i in range(15, 1500))
    assert hit / (10 * 1485) > 0.9
    assert set(got["c3"]) == set(sorted(["v0", *[f"c{i}" for i in range(14) if i != 3]])[:10])
    near = {tuple(r) for r in vectors.mutual(vectors.nearest(d, "id", "grp", "v", 10, min_cosine=0.9, list_size=100, probes=15)).collect()}
    top = {ids[i]: {ids[j] for j in np.argsort(-g[i])[:10] if g[i, j] >= 0.9} for i in range(15, 1500)}
    want = {(a, b) for a in top for b in top[a] if a < b and b in top and a in top[b]}
    assert len({p for p in near if p[0] in top and p[1] in top} ^ want) <= 0.03 * len(want)
    assert vectors.nearest(d.limit(0), "id", "grp", "v").count() == 0


@pytest.mark.parametrize("settings", [{"list_size": 25}, {"list_size": 25, "most_first": 30}, {"list_size": 60, "block_rows": 300, "slice_rows": 200}], ids=["many lists", "two levels", "divided blocks"])
def test_recall_on_project_vectors(spark, sf, settings):
    """Against brute force over the project's own vectors, with far more lists than are asked."""
    base = spark.read.parquet(f"{sf}/../sf0.01/langchain_pg_embedding.parquet")
    rows = {(r.collection_id, r.id): np.array(r.embedding, np.float64) for r in base.where("size(embedding) = 64").collect() if np.isfinite(r.embedding).all() and np.any(r.embedding)}
    grp = max({g for g, _ in rows}, key=lambda g: sum(x == g for x, _ in rows))
    names = [i for g, i in rows if g == grp]
    x = np.stack([rows[grp, i] for i in names])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 5)
    np.fill_diagonal(s, -2)
    got = {}
    for r in vectors.nearest(base, "id", "collection_id", "embedding", 10, groups=[grp], **settings).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    at = {i: k for k, i in enumerate(names)}
    hits = sum(sum(s[k, at[n]] >= np.sort(s[k])[-10] - 1e-4 for n in got.get(i, [])) for i, k in at.items())
    assert len(got) == len(names) and hits / (10 * len(names)) >= 0.95


def test_lists_on_two_levels():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vectors.Lists.fit(x, 60, 8)
    assert len(index.first) == 8 and index.n >= 60
    near = index.near(x, 60)
    centres = np.stack([index.centre(k) for k in range(index.n)])
    far = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert np.allclose(np.take_along_axis(far, near, 1), np.sort(far, axis=1)[:, :60], atol=1e-4)
    blocks = vectors.balanced_blocks(index.first, np.bincount(index.home(x) // len(index.second), minlength=8), 300)
    assert blocks.max() >= 2


def test_one_bit_bounds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    one = vectors.OneBitList(x, x.mean(axis=0), vectors.rotation(64))
    real = x @ x.T
    assert (one.upper(x) >= real - 1e-4).mean() > 0.93 and abs((one.estimates(x) - real).mean()) < 0.01


# ---- 6 pairs
Q = "What was the annual reserve of Halle in 1993?"


@pytest.mark.parametrize(("kind", "query", "answer", "want"), [
    ("factual", Q, None, ["empty"]), ("paraphrase", Q, None, []), ("negative", Q, None, []), ("negative", Q, "", []), ("paraphrase", Q, " \xa0", ["empty"]), ("factual", Q, "N/A", ["empty"]), ("factual", Q, "[no answer]", ["empty"]),
    ("factual", Q, "I'm sorry, but I cannot answer this. The reserve moved in 1990.", ["refusal"]), ("negative", Q, "I cannot answer.", []), ("factual", Q, "Sorry Bay is the criterion that Salholt recorded in 1992.", []), ("factual", Q, "The registrant is unable to hedge the account; it moved.", []), ("factual", Q, "Leider kann ich das nicht beantworten.", ["refusal"]),
    ("factual", Q, f"  {Q.upper()}\n", ["copy"]), ("factual", Q, f"Question: {Q}", ["copy"]), ("factual", Q, Q[:-1] + "...", ["copy"]), ("factual", Q, f"{Q[:-1]}: The reserve fell to $5 million in 1993.", []),
    ("factual", Q, "The reserve fell (see the", ["truncated"]), ("factual", Q, "The reserve of the member is a…", ["truncated"]), ("factual", Q, "$45 million", []), ("factual", Q, "Halle & Co.", []), ("factual", Q, "module, cursor, session", []),
    ("factual", Q, "Der Rückgang zeigt, dass der Umfang mit dem Bestand größer ist.", ["other_language"]), ("factual", Q, "The title is “Quel était le bilan de la ville ?” in the outage of Halle.", []), (None, None, "Fine words end here.", []),
])
def test_judge(kind, query, answer, want):
    assert pairs.judge(kind, query, answer)[0] == want


@pytest.mark.parametrize(("query", "answer", "want"), [
    (Q, "Il margine del comune è stato ridotto nel 1990 e la riserva non era più alta.", ["other_language"]), (Q, "De reserve van de stad is in 1993 niet gestegen, maar het bedrag werd lager.", ["other_language"]),
    (Q, "Резерв города в тысяча девятьсот девяносто третьем году снизился.", ["other_language"]), (Q, "No puedo responder a esta pregunta porque el texto no dice nada de la", ["other_language", "refusal", "truncated"]),
    (Q, "I cannot predict the weather for you.", ["refusal"]), (Q, "Non posso rispondere, non è nel testo che ho.", ["other_language", "refusal"]), ("Quale era la riserva di Halle nel 1993?", "La riserva di Halle nel 1993 era di 45 milioni.", []),
    (Q, "The reserve fell in 1990. It rose again in the summer", ["truncated"]), (Q, "1. Reserve of Halle\n2. Income of the town", []),
])
def test_every_defect_that_holds(query, answer, want):
    assert sorted(pairs.judge("factual", query, answer)[0]) == want


def test_defects(spark):
    done = "The board of Halle approved a change of 5 percent."
    d = spark.createDataFrame([("1", "factual", Q, done, 0), ("2", "factual", Q, "The board of Berne approved a loss of 7 percent.", 0), ("3", "factual", Q, "The board of Rome approved a gain of 9 percent", 0), ("4", "factual", Q, "The board of Rome approved a", 0), ("4", "factual", Q, "The board of Rome approved a", 0), (None, "factual", Q, None, 0)], "id string, type string, query string, _answer string, defect int")
    assert rows(pairs.defects(d)) == [("4", "truncated")]
    assert pairs.defects(d.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 2, 8])
def test_unfinished_whatever_the_size(spark, times):
    names = ["Halle", "Berne", "Rome", "Fens", "Quens", "Oslo", "Turin", "Basel"]
    data = [("cut", "The board of Essen approved"), ("cut2", "The board of Essen approved a loss and the"), ("done", "In 1990 the reserve fell")]
    for k, x in enumerate(names[:times]):
        data += [(f"a{k}", f"The board of {x} agreed."), *((f"{b}{k}", f"The board of {x} approved a loss of {n} percent.") for n, b in enumerate("bcde"))]
        data.append((f"f{k}", f"In 199{k} the account moved."))
    d = spark.createDataFrame([(i, "factual", Q, a) for i, a in data], "id string, type string, query string, _answer string")
    assert rows(pairs.defects(d)) == [("cut", "truncated"), ("cut2", "truncated")]


# ---- 8 packing
def test_packing(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 120, 800)] + [7] * 600 + [250, 1000, 100]
    d = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)] + [(5000, None, 0), (None, 3, 0)], "k bigint, n bigint, tokens int")
    got = packing.pack(d, "k", "n", 100, 8)
    per = got.groupBy("container_id").agg(F.sum("tokens").alias("t")).collect()
    assert max(r.t for r in per) <= 100 and got.select("k").distinct().count() == len(sizes) + 2
    assert got.agg(F.sum("tokens")).first()[0] == sum(sizes) + 3
    assert got.groupBy("k").agg(F.count("*").alias("c"), F.sum("tokens").alias("t")).where("c > 1 and t <= 100").count() == 0
    assert packing.waste(got, 100).first().fill > 0.98
    assert packing.pack(d.limit(0), "k", "n").count() == 0


def test_batches_inside_buckets(spark):
    """Containers with a bucket hold its lengths alone; a hot length is numbered in parts; oversized items say where their parts begin."""
    rng = np.random.default_rng(5)
    sizes = [int(min(100, 1 + x)) for x in rng.lognormal(2.2, 0.8, 3000)] + [230]
    d = spark.createDataFrame(list(enumerate(sizes)), "k bigint, n bigint")
    bounds = [0, *packing.optimal_bounds(dict(zip(*(x.tolist() for x in np.unique([x for x in sizes if x <= 100] + [30, 100, 100], return_counts=True)))), 100, 8)]
    got = packing.pack(d, "k", "n", 100, 8).collect()
    of = {b: a for a, b in zip(bounds, bounds[1:])}
    assert all(of[r.bucket] < r.tokens <= r.bucket for r in got if r.bucket is not None)
    assert sum(r.bucket is not None for r in got) > 0.5 * len(got)
    assert [(r.part, r.first_token, r.tokens) for r in sorted(got) if r.k == 3000] == [(0, 0, 100), (1, 100, 100), (2, 200, 30)]


def test_numbering_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 50)
    got = packing.pack(spark.range(1000).selectExpr("id as k", "7L as n"), "k", "n", 100, 8)
    per = got.groupBy("container_id").agg(F.count("*").alias("c")).collect()
    assert len(per) == 72 and max(r.c for r in per) == 14


def test_optimal_bounds():
    import itertools

    hist, cap = {3: 5, 9: 4, 14: 7, 30: 2, 55: 3}, 60
    shares = sorted({cap // k for k in range(1, cap + 1)})
    cost = lambda bs: sum(n * (cap / (cap // min(b for b in bs if b >= x)) - x) for x, n in hist.items())
    best = min(cost([*c, cap]) for c in itertools.combinations(shares[:-1], 2))
    assert cost(packing.optimal_bounds(hist, cap, 3)) == pytest.approx(best)


# ---- 9 leaks
@pytest.mark.parametrize("edits", [0, 2])
def test_leaks(spark, edits):
    rng = np.random.default_rng(4)
    items = {i: " ".join(rng.choice(WORDS, rng.integers(5, 40))) for i in range(12)}
    docs = {}
    for i in range(60):
        w = list(rng.choice(WORDS, rng.integers(0, 150)))
        t = tok(items[i % 12])
        n = int(rng.integers(8, 20))
        if len(t) > n:
            a = rng.integers(0, len(t) - n)
            w[len(w) // 2 : len(w) // 2] = t[a : a + n]
        docs[i] = ", ".join(w).upper() if i % 2 else " ".join(w)
    grams = lambda t: set(zip(*[tok(t)[k:] for k in range(12)]))
    want = {(i, d) for i, x in items.items() for d, y in docs.items() if grams(x) & grams(y)}
    long = " ".join(rng.choice(WORDS, 30_000)) + " " + items[11 if len(tok(items[11])) >= 12 else 0]
    dd = spark.createDataFrame([(k, v, 9) for k, v in docs.items()] + [(0, docs[0], 9), (100, None, 9), (101, "", 9), (102, long, 9), (None, "x", 9)], "doc_id bigint, text string, item_id int")
    ii = spark.createDataFrame([(k, v) for k, v in items.items()] + [(0, items[0]), (50, None), (51, "few words")], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in leaks.leaks(dd, ii, tokens=12, edits=edits).collect()}
    if edits:
        assert want <= got
    else:
        assert {p for p in got if p[1] < 100} == want and any(p[1] == 102 for p in got)
        assert {(r.item_id, r.doc_id) for r in leaks.leaks(dd, ii, tokens=12, most_bytes=400).collect()} == got
    assert leaks.leaks(dd.limit(0), ii).count() == 0 and leaks.leaks(dd, ii.limit(0)).count() == 0


def test_edited_passage(spark):
    passage = "the quick brown fox jumps over thirteen lazy dogs near the river bank today"
    d = spark.createDataFrame([(1, "some text " + passage.replace("thirteen", "thirtean") + " and more words"), (2, "no such words are here at all in this other text of the day you see")], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    assert rows(leaks.leaks(d, i, tokens=12, edits=2), "item_id", "doc_id") == [(7, 1)] and leaks.leaks(d, i, tokens=12).count() == 0


def test_edits_against_brute_force(spark):
    """Documents within the budget of a passage, by plain dynamic programming over every passage and document; also with an index of many groups."""
    rng = np.random.default_rng(9)
    items = {i: " ".join(rng.choice(WORDS, 14)) for i in range(8)}
    docs = {}
    for d in range(40):
        w = tok(items[d % 8])[1:]
        text = list(" ".join(w))
        for _ in range(d % 6):
            k = int(rng.integers(1, len(text) - 1))
            text[k : k + int(rng.integers(0, 2))] = rng.choice(list("abcdef"), int(rng.integers(0, 2)))
        docs[d] = " ".join([*rng.choice(WORDS, d % 9), "".join(text), *rng.choice(WORDS, 5)])

    def fewest(p: str, t: str) -> int:
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            now = [i]
            for j, x in enumerate(t, 1):
                now.append(min(row[j - 1] + (c != x), row[j] + 1, now[-1] + 1))
            row = now
        return min(row)

    want = {}
    for i, x in items.items():
        w = tok(x)
        for d, y in docs.items():
            n = min(fewest(f" {' '.join(w[k : k + 12])} ", f" {' '.join(tok(y))} ") for k in range(len(w) - 11))
            if n <= 3:
                want[i, d] = n
    dd = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    ii = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    for most in (4 << 20, 200):
        assert {(r.item_id, r.doc_id): r.edits for r in leaks.leaks(dd, ii, tokens=12, edits=3, most_bytes=most).collect()} == want
    assert len(set(want.values())) == 4


# ---- 10 personal information
NAMES = pii.Names([("Tadran", "given"), ("Malia", "given"), ("Haskvitz", "family"), ("Branwen", "family"), ("Dunholm", "family")])


@pytest.mark.parametrize(("text", "want"), [
    ("Reply to a.b+c@dept.mail.example today.", [("email", "a.b+c@dept.mail.example")]), ("write x_9 [at] example [dot] org.", [("email", "x_9 [at] example [dot] org")]), ("see m(at)records.invalid)", [("email", "m(at)records.invalid")]), ("The ratio @ 64.9 and @handle_x", []),
    ("Call (617) 555-0101 now", [("phone", "(617) 555-0101")]), ("He left +16175550157 as", [("phone", "+16175550157")]), ("(+33 1 99 00 45 28)", [("phone", "+33 1 99 00 45 28")]), ("Order 763-1854-763 lists", []), ("ISBN 979-0-6438-6438-0", []), ("Grid point (596) 596 by 6598", []),
    ("His SSN is 123-45-6789.", [("id_number", "123-45-6789")]), ("His social security number is 123-45-6789.", [("id_number", "123-45-6789")]), ("(123-45-6789)", [("id_number", "123-45-6789")]), ("code 666-45-6789 and 123-00-6789", []),
    ("Pay to DE89 3704 0044 0532 0130 00 now", [("account", "DE89 3704 0044 0532 0130 00")]), ("GB82WEST12345698765432", [("account", "GB82WEST12345698765432")]), ("DE88 3704 0044 0532 0130 00", []),
    ("card 4111 1111 1111 1111, ok", [("card", "4111 1111 1111 1111")]), ("visa: 4111111111111111", [("card", "4111111111111111")]), ("4111 1111 1111 1112", []), ("serial 4111111111111111", []),
    ("SSN 943-86-2292 was", [("id_number", "943-86-2292")]), ("(QQ 25 17 67 C)", [("id_number", "QQ 25 17 67 C")]), ("CPF 529.982.247-25.", [("id_number", "529.982.247-25")]), ("Part no. X284 fits", []), ("accession 099987155-26-859087", []),
    ("to 8966 W. Halle Drive, Apt 27B, Fens.", [("address", "8966 W. Halle Drive, Apt 27B, Fens")]), ("P.O. Box 3687, Borlund A", [("address", "P.O. Box 3687, Borlund")]), ("au 151 rue de Halle, 00084 Quens.", [("address", "151 rue de Halle, 00084 Quens")]), ("In 1879 Street lighting replaced it. Figure 87 Avenue of it", []),
    ("Dr. Tadran Q. Haskvitz reviewed", [("name", "Tadran Q. Haskvitz")]), ("Haskvitz, Malia kept", [("name", "Haskvitz, Malia")]), ("by M. Branwen-Dunholm.", [("name", "M. Branwen-Dunholm")]), ("The Haskvitz & Sons Ltd, Lake Branwen, Dunholm County", []), ("TADRAN DUNHOLM", [("name", "TADRAN DUNHOLM")]),
])
def test_pii(text, want):
    got = [(k, text[a:z]) for a, z, k in pii.find(text, NAMES)]
    assert got == want
    assert pii.redact(text, pii.find(text, NAMES)).count("[") == text.count("[") + len(want) - sum(x.count("[") for _, x in want)


@pytest.mark.parametrize("text", ["12 rue\nde Halle", "12\tavenue de Halle", "12 place de Halle", "Lindenweg\n12", "Lindenstr.\t12", "Allee 12, 01234 Halle", "POSTFACH 123", "apartado 45", "casilla 6", "8966 Halle\tDrive"])
def test_addresses_in_any_white_space_and_case(text):
    assert [(k, a, z) for a, z, k in pii.find(f"see {text} now", NAMES)] == [("address", 4, 4 + len(text))]


@pytest.mark.parametrize("text", ["a.b{at }mail.example", "a.b<at >mail.example", "a.b at mail\ndot\nexample"])
def test_disguised_emails(text):
    assert [(k, a, z) for a, z, k in pii.find(f"see {text} now", NAMES)] == [("email", 4, 4 + len(text))]


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33") and pii.cpf("52998224725")


def test_many_spans():
    text = "mail a@b.example, " * 20_000
    began = __import__("time").time()
    assert len(pii.find(text, NAMES)) == 20_000 and __import__("time").time() - began < 10


def test_pii_tables(spark):
    names = spark.createDataFrame([("Tadran", "given"), ("Haskvitz", "family"), (None, "family")], "word string, word_kind string")
    d = spark.createDataFrame([(1, "é Tadran Haskvitz", "k"), (1, "é Tadran Haskvitz", "k"), (2, None, "k"), (3, "", "k"), (4, "x " * 60_000 + "a@b.example", "k"), (None, "a@b.example", "k")], "doc_id bigint, text string, kind string")
    assert rows(pii.spans(d, names), "doc_id", "kind", "start_pos") == [(1, "name", 3), (4, "email", 120_001)]
    out = {r.doc_id: r.text for r in pii.redacted(d, names).collect()}
    assert out[1] == "é [NAME]" and out[2] is None and out[3] == ""
    assert pii.spans(d, names.limit(0)).count() == 1 and pii.spans(d.limit(0), names).count() == 0
