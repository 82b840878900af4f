"""Noise in text from scanned pages: words divided by line breaks, misread characters, running headers and page numbers; and its repair into paragraphs.

1. Layout rules mark page numbers and running headers by line. A head without a page number on or beside it, that is not the first or last line of its page,
   has to recur on another page of its source (signs that are misread for each other count as one), or it is text; where a source has a single page, its
   shape decides. What remains are text lines, whose words are read in order, a word divided by a line break as one (over page breaks too).
2. A lexicon counts the words of all pages, lines that stand on several pages once.
3. Words and their deletions of up to two characters (of words over `DELETED` characters, a third of them, which two edits leave whole somewhere) meet in a
   symmetric-delete join with those of more frequent words; a weighted edit distance, in which
   misreadings known from print (rn for m, 1 for l, ...) are cheap, keeps candidates, which have to be `RATIO` times as frequent.
4. Divided words are joined, or keep their hyphen as compounds, by which form the lexicon knows better.
5. Where a word has several candidates, the counts of its bigrams with its neighbours choose.

The lexicon, candidates and bigrams are tables that are joined, never broadcast; occurrences of words without a candidate are dropped in the scan by a filter
sized by their number (exact after the join).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.filters import Filter, bloom
from quillmark.llm.quality import FUNCTION, RANKED
from quillmark.session import written

RATIO, MOST_COST, LEAST_COUNT = 12, 0.8, 4
DELETED = 40
DIVIDED = "\1"  # before a word divided by a line break
SALTS = 16  # of the shortest deletions, which many words share
# How print is misread (what stands there: what was meant), with costs.
CONFUSED = {
    ("0", "o"): 0.2, ("1", "l"): 0.2, ("1", "i"): 0.2, ("5", "s"): 0.2, ("8", "b"): 0.2, ("6", "b"): 0.3, ("3", "e"): 0.3, ("9", "g"): 0.3, ("@", "a"): 0.2, ("†", "t"): 0.2, ("ſ", "s"): 0.2,
    ("$", "s"): 0.2, ("|", "l"): 0.2, ("!", "l"): 0.2, ("!", "i"): 0.2, ("¢", "c"): 0.2, ("€", "e"): 0.2, ("c", "e"): 0.35, ("e", "c"): 0.35, ("h", "b"): 0.35, ("b", "h"): 0.35, ("y", "v"): 0.35,
    ("v", "y"): 0.35, ("u", "n"): 0.35, ("n", "u"): 0.35, ("i", "l"): 0.35, ("l", "i"): 0.35, ("t", "f"): 0.4, ("f", "t"): 0.4, ("l", "t"): 0.4, ("t", "l"): 0.4, ("i", "j"): 0.4, ("j", "i"): 0.4, ("f", "s"): 0.35,
    ("o", "c"): 0.4, ("c", "o"): 0.4, ("o", "e"): 0.4, ("e", "o"): 0.4, ("a", "o"): 0.45, ("o", "a"): 0.45, ("g", "q"): 0.4, ("q", "g"): 0.4, ("w", "v"): 0.45, ("r", "t"): 0.45,
    ("rn", "m"): 0.3, ("m", "rn"): 0.3, ("ii", "n"): 0.3, ("n", "ii"): 0.3, ("ii", "u"): 0.3, ("ni", "m"): 0.35, ("in", "m"): 0.35, ("nn", "m"): 0.4, ("cl", "d"): 0.3, ("d", "cl"): 0.3, ("li", "h"): 0.3, ("h", "li"): 0.3,
    ("tl", "d"): 0.4, ("vv", "w"): 0.3, ("w", "vv"): 0.3, ("u", "ll"): 0.35, ("ll", "u"): 0.35, ("ﬁ", "fi"): 0.15, ("ﬂ", "fl"): 0.15, ("ﬀ", "ff"): 0.15, ("iii", "m"): 0.35, ("m", "in"): 0.35, ("m", "ni"): 0.35, ("h", "lt"): 0.4, ("k", "lc"): 0.35, ("lc", "k"): 0.35, ("ri", "n"): 0.35, ("n", "ri"): 0.35, ("ci", "a"): 0.35, ("j", ";"): 0.4, ("ti", "n"): 0.4, ("lj", "b"): 0.4, ("tb", "th"): 0.3,
}
PLAIN = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")
HYPHENS = r"\-=¬\u00ad‐‑~"
PAGE = re.compile(r"\s*(?:[\[({\-–—~•*.\s]*(?:\d{1,4}|[ivxlc]{1,8})[\])}\-–—~•*.\s]*|[Pp](?:age|\.)?\s*[\dlIOo]{1,4}(?:\s*(?:of|/)\s*[\dlIOo]{1,4})?|(?:Seite|página|S\.)\s*\d{1,4})\s*")
NUMERAL = re.compile(r"\s*[\d]{1,4}\s*|\s*[ivxlc]{1,7}\s*")
CHUNK = re.compile(r"[^\s.,;:?\"“”„«»()\[\]{}—…]+")
BREAK = re.compile(rf"([^\s.,;:?\"“”()\[\]{{}}—…{HYPHENS}][^\s.,;:?\"“”()\[\]{{}}—…]*?)\s?[{HYPHENS}]\s*\Z")
ODD = re.compile(r"[ﬀ-ﬆ]|[A-Za-z][@†ſ|¢$€!][A-Za-z]|^[@†ſ|¢$€][A-Za-z]{2}|[A-Za-z]{2}[@†ſ|¢$€]$|[A-Za-z][0-9]+[A-Za-z]|^[0-9][A-Za-z]{3,}|[A-Za-z]{2,}[0-9]$")
INNER_CAPITAL, LETTER, ROMAN, CAPITAL_PREFIX = re.compile(r"[a-zà-ÿ][A-Z]"), re.compile(r"[^\W\d_]"), re.compile(r"[IVXLC]+"), re.compile(r"(?:Mc|Mac|De|La|Le|O['’])")
ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|d|mo|vo|to|s)\Z")


def capital(line: str) -> bool:
    letters = re.findall(r"[^\W\d_]", line)
    return len(letters) >= 5 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)


HEAD = re.compile(r"\s*(?:\d{1,4}[.\s]+)?([A-ZÀ-Þ][\w'’@†ſ|!$¢€\-]*(?:\s+[\w'’@†ſ|!$¢€\-]+){0,6})(?:\.?\s+\d{1,4})?\s*")
SHOULDER = re.compile(r"\s*(?:\d{1,4}\s+)?[\[(]\s*[A-ZÀ-Þ][\w'’]*\.?(?:\s+[\w'’@†ſ|!$¢€]+\.?){0,3}[\])]?(?:\s+\d{1,4})?\s*")  # a short head in brackets, often only opened
ALIKE = str.maketrans("015@†ſ|!$¢€l8", "oisatsiisceib")


def head_key(line: str) -> str:
    """A head without numbers and signs, characters that are misread for each other as one."""
    return re.sub(r"[\W_]+", " ", re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", " ", line).casefold().translate(ALIKE)).strip()


def line_kinds(lines: list[str], first: int = 0, no_heads: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """Of each line: text, blank, page_number, running_header or skip (before `first`). A heading or numeral that is a paragraph of its own is text, and so are
    heads whose key is among `no_heads`, unless their place proves them.

    A head in mixed case shows by its place: a short line without an end mark that follows a page number, or stands inside a paragraph although the next
    word would have fitted on it."""
    kinds: list[str] = []
    for i, line in enumerate(lines):
        s = line.strip()
        if i < first:
            kinds.append("skip")
            continue
        if not s:
            kinds.append("blank")
            continue
        alone = (i <= first or not lines[i - 1].strip()) and (i + 1 >= len(lines) or not lines[i + 1].strip())
        kind = "text"
        if PAGE.fullmatch(s) and not re.fullmatch(r"\d{4}\.", s):
            marked = not NUMERAL.fullmatch(s.rstrip("."))
            kind = "page_number" if marked or not alone else "text"
            if not marked and not s[0].isdigit() and not re.fullmatch(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\.?", s):
                kind = "text"
        elif SHOULDER.fullmatch(s) and len(s) <= 32:
            kind = "running_header"
        elif capital(re.sub(r"[\d]+", "", s)) and len(s) < 80 and not alone and not re.match(r"(?i)\W*(?:chapter|book|part|canto|section|letter|act)\s+[ivxlc\d]+\b", s):
            kind = "running_header"
        kinds.append(kind)
    width = max((len(lines[i]) for i, k in enumerate(kinds) if k == "text"), default=0)
    for i, s in enumerate(lines):
        if kinds[i] == "page_number" and s.strip().isdigit() and i + 1 < len(lines) and i and kinds[i - 1] == "text" and re.search(r"\b(?:in|of|year|about|some|to|and|the)\s*\Z", lines[i - 1]) and kinds[i + 1] == "blank" and len(s.strip()) == 4:
            kinds[i] = "text"  # the end of a sentence
        elif kinds[i] == "text" and len(s) <= 0.72 * width and width >= 30 and HEAD.fullmatch(s):
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            after_page = i > 0 and kinds[i - 1] == "page_number"
            inside = i > 0 and kinds[i - 1] in ("text", "page_number") and bool(nxt.strip()) and len(s.rstrip()) + 1 + len((nxt.split() or [""])[0]) <= width - 6
            near = [len(lines[j]) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(lines) and kinds[j] == "text"]
            if (inside or after_page) and near and (max(near) >= 0.75 * width or after_page) and not (nxt.strip() == "" and not after_page):
                kinds[i] = "running_header"
    if no_heads:
        kinds = ["text" if k == "running_header" and not proven(lines, kinds, i) and head_key(lines[i]) in no_heads else k for i, k in enumerate(kinds)]
    return kinds


def proven(lines: list[str], kinds: list[str], i: int) -> bool:
    """Whether a head has a page number, on it or beside it, or is the first or last line of its page."""
    beside = [next((kinds[j] for j in js if kinds[j] != "blank"), "skip") for js in (range(i - 1, -1, -1), range(i + 1, len(kinds)))]
    return bool(re.search(r"(?<![^\W\d_])\d", lines[i])) or "page_number" in beside or "skip" in beside


class Word:
    __slots__ = ("text", "line", "line2", "cut", "hyphen", "start")

    def __init__(self, text: str, line: int, line2: int = -1, cut: int = 0, hyphen: str = "", start: int = 0):
        self.text, self.line, self.line2, self.cut, self.hyphen, self.start = text, line, line2, cut, hyphen, start


@lru_cache(maxsize=300_000)
def key_of(w: str) -> str:
    """Lower case, but for capitals inside a word, which no one writes."""
    w = w.strip("'‘’-=¬­‐‑*_~`<>^/\\+#&%")
    return w if INNER_CAPITAL.search(w) else w.lower()


@lru_cache(maxsize=300_000)
def counted_key(w: str) -> str:
    """The key of a word that counts: neither a Roman numeral in capitals nor without letters (then empty)."""
    k = key_of(w)
    return k if LETTER.search(k) and not ROMAN.fullmatch(w) else ""


@lru_cache(maxsize=300_000)
def looks_misread(w: str) -> tuple[bool, bool]:
    """Whether a word holds signs that no word has, and whether it has accents."""
    odd = bool(ODD.search(w)) and not ORDINAL.fullmatch(w) or bool(INNER_CAPITAL.search(w)) and not CAPITAL_PREFIX.match(w)
    return odd, w.translate(PLAIN) != w


def read_words(lines: list[str], kinds: list[str]) -> list[Word]:
    """The words of the text lines in order; a word divided by a line break is one, with the cut after its first `cut` characters."""
    out: list[Word] = []
    text = [i for i, k in enumerate(kinds) if k == "text"]
    pending: Word | None = None
    for n, i in enumerate(text):
        line = lines[i]
        found = list(CHUNK.finditer(line))
        if pending is not None and found:
            piece = found[0].group()
            m = re.match(r"[^\W\d_][\w'’@†|ſ!$¢€\-]*", piece)
            if m and (piece[:1].islower() or not piece[:1].isupper()):
                pending.text, pending.line2 = pending.text + key_of(piece) if pending.text == pending.text.lower() else pending.text + piece, i
                out.append(pending)
                found = found[1:]
            else:
                out.append(Word(key_of(pending.text), pending.line))
        elif pending is not None:
            out.append(Word(key_of(pending.text), pending.line))
        pending = None
        m = BREAK.search(line.rstrip())
        if m and n + 1 < len(text) and re.search(r"[^\W\d_]", m.group(1)):
            first = m.group(1)
            pending = Word(key_of(first), i, cut=len(key_of(first)), hyphen="-")
            found = [x for x in found if x.start() < m.start(1)]
        out += [Word(k, i) for x in found if (k := counted_key(x.group()))]
    if pending is not None:
        out.append(Word(key_of(pending.text), pending.line))
    return [w for w in out if LETTER.search(w.text)]


def deletions(w: str, most: int = 2) -> dict[str, int]:
    """What is left of a word without up to `most` characters, and how many are missing; the empty word is left out."""
    out = {w: 0}
    level = {w}
    for k in range(1, most + 1):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))} - {""}
        for x in level:
            out.setdefault(x, k)
    return out


def thirds(w: str) -> list[str]:
    """The three parts of a long word, each with the word's length and its own number: one of them is whole in any word within two edits."""
    n = len(w) // 3
    return [f"\0{len(w)} {k} {x}" for k, x in enumerate((w[:n], w[n : 2 * n], w[-n:]))]


def thirds_met(w: str) -> list[str]:
    """The parts of words of about its length that a long word may have."""
    out = []
    for m in range(len(w) - 2, len(w) + 3):
        n = m // 3
        out += [f"\0{m} 0 {w[:n]}", f"\0{m} 2 {w[-n:]}", *(f"\0{m} 1 {w[n + k : 2 * n + k]}" for k in range(-2, 3))]
    return out


def weighted_distance(seen: str, meant: str, most: float = 2.0) -> tuple[float, int]:
    """Cost of reading `meant` as `seen`, and where in `seen` the first misreading is."""
    n, m = len(seen), len(meant)
    far = [[math.inf] * (m + 1) for _ in range(n + 1)]
    at = [[-1] * (m + 1) for _ in range(n + 1)]
    far[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            d = far[i][j]
            if d > most:
                continue
            moves = []
            if i < n and j < m:
                a, b = seen[i], meant[j]
                cost = 0.0 if a == b else 0.15 if a.translate(PLAIN) == b else CONFUSED.get((a, b), CONFUSED.get((a.lower(), b), 1.0))
                moves.append((i + 1, j + 1, cost))
            for x in (1, 2, 3):
                for y in (1, 2):
                    if (x > 1 or y > 1) and i + x <= n and j + y <= m and (c := CONFUSED.get((seen[i : i + x].lower(), meant[j : j + y]))) is not None:
                        moves.append((i + x, j + y, c))
            if i < n:
                moves.append((i + 1, j, 1.0))
            if j < m:
                moves.append((i, j + 1, 1.0))
            for p, q, c in moves:
                if d + c < far[p][q]:
                    far[p][q] = d + c
                    at[p][q] = at[i][j] if at[i][j] >= 0 or not c else i
    return far[n][m], at[n][m]


def english(words: list[Word]) -> bool:
    n = Counter(w.text for w in words)
    count = {k: sum(n[x] for x in v) for k, v in RANKED.items()}
    return count["en"] >= max(2, max(c for k, c in count.items() if k != "en"))


def _first_pass(pages: DataFrame) -> DataFrame:
    """Of every page (tbl, item_id, source, text, first) as a written table: its lines of the shape of a head (head, proven), and its text lines (line: a hash, says:
    the word before the line and its words, those divided by a line break marked). A line that stands on several pages has one hash for the n-th time that a page
    has it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        for b in batches:
            out = []
            for tbl, i, source, text, first in zip(b["tbl"], b["item_id"], b["source"], b["text"], b["first"]):
                lines = text.split("\n")
                kinds = line_kinds(lines, first)
                heads = {(head_key(lines[k]), proven(lines, kinds, k)) for k, kind in enumerate(kinds) if kind == "running_header"}
                out += [(tbl, i, source, head, sure, None, None) for head, sure in heads]
                said: dict[int, list[str]] = {}
                before = ""
                for w in read_words(lines, kinds):
                    if w.line not in said:
                        said[w.line] = [before]
                    said[w.line].append(w.text if w.line2 < 0 else DIVIDED + w.text)
                    before = w.text
                times: Counter = Counter()
                for words in said.values():
                    says = " ".join(words)
                    times[says] += 1
                    line = hashlib.blake2b(b"%d " % times[says] + says.encode(), digest_size=16).digest()
                    if line not in sent:
                        sent.add(line)
                        out.append((None, None, None, None, None, line, says))
            if len(sent) > 400_000:
                sent.clear()
            yield pd.DataFrame(out, columns=["tbl", "item_id", "source", "head", "proven", "line", "says"])

    return written(pages.mapInPandas(read, "tbl string, item_id string, source string, head string, proven boolean, line binary, says string"))


def _with_heads(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds `no_heads`: the keys of lines that have the shape of a head, on a page of a source with several pages, none other of which has them."""
    heads = seen.where("head is not null").select("tbl", "item_id", "source", "head", "proven")
    spread = F.min("item_id") != F.max("item_id")
    lone = heads.groupBy("source", "head").agg(spread.alias("again")).where("not again").select("source", "head")
    several = pages.groupBy("source").agg(spread.alias("several")).where("several").select("source")
    no = heads.where("not proven").join(lone, ["source", "head"], "left_semi").join(several, "source", "left_semi")
    no = no.groupBy("tbl", "item_id").agg(F.collect_set("head").alias("no_heads"))  # as many as a page has such lines
    return pages.join(no, ["tbl", "item_id"], "left").select("tbl", "item_id", "text", "first", "no_heads")


def _lexicon(seen: DataFrame) -> DataFrame:
    """(w, n) of all words of lines that do not look like heads, and ('a b', n) of all pairs of neighbours; words divided by line breaks count 0.

    A line that stands on several pages counts as often as on the page that has it most: the misreadings of a page that was delivered under many keys,
    changed here and there or not, are as rare as those of a page delivered once."""
    words = F.split("says", " ")
    lines = seen.where("line is not null").select("line", "says").dropDuplicates(["line"]).select(words.alias("x"))
    bare = lambda w: F.ltrim(w, F.lit(DIVIDED))
    n = F.size("x") - 1
    single = F.transform(F.slice("x", 2, n), lambda w: F.struct(bare(w).alias("w"), (~w.startswith(DIVIDED)).cast("bigint").alias("n")))
    pairs = F.zip_with(F.slice("x", 1, n), F.slice("x", 2, n), lambda a, b: F.struct(F.concat_ws(" ", bare(a), bare(b)).alias("w"), F.lit(1).cast("bigint").alias("n")))
    said = lines.select(F.explode(F.concat(single, F.filter(pairs, lambda p: ~p["w"].startswith(" ")))).alias("x"))
    return said.groupBy("x.w").agg(F.sum("x.n").alias("n"))


def _candidates(words: DataFrame) -> DataFrame:
    """(w, meant, cost, at): by symmetric deletion, then weighted distance."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, n in zip(b["w"], b["n"]):
                if len(w) <= DELETED:
                    out += [(w, n, d, k, 0) for d, k in deletions(w).items()]
                else:
                    out += [(w, n, d, 0, role) for role, ds in ((1, thirds(w)), (2, thirds_met(w))) for d in ds]
            yield pd.DataFrame(out, columns=["w", "n", "d", "k", "role"])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, meant, n in zip(b["w"], b["meant"], b["n"]):
                cost, at = weighted_distance(w, meant)
                if cost <= MOST_COST:
                    out.append((w, meant, cost, at, n))
            yield pd.DataFrame(out, columns=["w", "meant", "cost", "at", "n"])

    cuts = words.mapInPandas(cut, "w string, n bigint, d string, k int, role int")
    # the shortest deletions are shared by many words: known ones stand in every part of them, seen ones in one
    short = F.length("d") <= 2
    # short words would meet everywhere without two of their letters
    known = cuts.where((F.col("role") < 2) & (F.col("n") >= LEAST_COUNT) & ((F.length("w") > 3) | (F.col("k") <= 1)))
    known = known.select("d", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.col("w").alias("meant"), F.col("n").alias("nm"))
    seen = cuts.where("role != 1").select("d", F.when(short, F.pmod(F.xxhash64("w"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"), "w", F.col("n").alias("nw"))
    met = seen.join(known, ["d", "salt"]).where("w != meant").where(F.col("nm") >= RATIO * F.greatest(F.col("nw"), F.lit(1)) - (RATIO - LEAST_COUNT) * (F.col("nw") == 0).cast("int") - (RATIO - LEAST_COUNT) * (F.col("w").rlike(r"[0-9@†ſ|¢$€!áàâäéèêëíìîïóòôöúùûü]|[a-z][A-Z]")).cast("int"))
    met = met.select("w", "meant", F.col("nm").alias("n")).distinct()
    return met.mapInPandas(weigh, "w string, meant string, cost double, at int, n bigint")


def repairs(pages: DataFrame) -> DataFrame:
    """pages (tbl, item_id, text, first) -> (tbl, item_id, noise, line_no, w, meant): every noise with its line (from 1), for words what was meant: a divided
    word joined or with its hyphen, a misread one corrected.

    Null texts have no rows; `first` is how many lines at the beginning are no page text; repeated pages count once in the result."""
    source = F.col("source") if "source" in pages.columns else F.col("item_id")
    pages = pages.where("text is not null").select("tbl", "item_id", "text", "first", F.coalesce(source, F.lit("")).alias("source"))
    pages = written(pages)
    seen = _first_pass(pages)
    pages = _with_heads(pages, seen)
    lex = written(_lexicon(seen))
    words = lex.where(~F.col("w").contains(" "))
    function = list(FUNCTION)
    cand = written(_candidates(words.where(~F.col("w").isin(function) | (F.col("n") >= LEAST_COUNT))).where(~F.col("w").isin(function)))
    doubted = cand.select(F.xxhash64("w").alias("h")).distinct()
    near = bloom(doubted, doubted.count())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = Filter(near.value)
        seen: dict[str, bool] = {}

        def maybe(w: str) -> bool:
            if w not in seen:
                if len(seen) > 300_000:
                    seen.clear()
                seen[w] = bool(known.maybe(np.array([xxhash.xxh64_intdigest(w.encode(), 42)], np.uint64))[0])
            return seen[w]

        for b in batches:
            out = []
            for tbl, i, text, first, not_heads in zip(b["tbl"], b["item_id"], b["text"], b["first"], b["no_heads"]):
                lines = text.split("\n")
                kinds = line_kinds(lines, first, set(not_heads) if not_heads is not None else ())
                out += [(tbl, i, k, n + 1, -1, 0, None, None, None, None) for n, k in enumerate(kinds) if k in ("page_number", "running_header")]
                ws = read_words(lines, kinds)
                plain = english(ws)
                for k, w in enumerate(ws):
                    before, after = ws[k - 1].text if k else "", ws[k + 1].text if k + 1 < len(ws) else ""
                    if w.line2 >= 0:
                        out.append((tbl, i, "break", w.line + 1, w.line2 + 1, w.cut, w.text, before, after, None))
                    sign, accent = looks_misread(w.text)
                    odd = sign or plain and accent
                    if odd or maybe(w.text):
                        out.append((tbl, i, "word", w.line + 1, w.line2 + 1 if w.line2 >= 0 else -1, w.cut, w.text, before, after, "odd" if odd else None))
            yield pd.DataFrame(out, columns=["tbl", "item_id", "what", "line_no", "line2", "cut", "w", "before", "after", "odd"])

    scanned = written(pages.select("tbl", "item_id", "text", "first", "no_heads").mapInPandas(scan, "tbl string, item_id string, what string, line_no bigint, line2 bigint, cut int, w string, before string, after string, odd string").distinct())
    layout = scanned.where("what in ('page_number', 'running_header')").select("tbl", "item_id", F.col("what").alias("noise"), "line_no", F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("meant"))

    # words
    occurs = scanned.where("what = 'word'").select("tbl", "item_id", "line_no", "line2", "cut", "w", "before", "after", "odd")
    many = occurs.join(cand, "w", "left").where("meant is not null or odd is not null")
    grams = lex.where(F.col("w").contains(" ")).select(F.col("w").alias("g"), F.col("n").alias("gn"))
    many = many.join(grams.select(F.col("g").alias("g1"), F.col("gn").alias("n1")), F.concat_ws(" ", "before", "meant") == F.col("g1"), "left").join(grams.select(F.col("g").alias("g2"), F.col("gn").alias("n2")), F.concat_ws(" ", "meant", "after") == F.col("g2"), "left")
    score = F.coalesce("cost", F.lit(9.0)) - 0.08 * F.log2(1 + F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))) - 0.02 * F.log2(1 + F.coalesce("n", F.lit(0)))
    best = many.withColumn("score", score).withColumn("rn", F.row_number().over(Window.partitionBy("tbl", "item_id", "line_no", "w", "before", "after").orderBy("score", "meant"))).where("rn = 1")
    line = F.when((F.col("line2") > 0) & (F.coalesce("at", F.lit(0)) >= F.col("cut")), F.col("line2")).otherwise(F.col("line_no"))

    # divided words: which form does the lexicon know?
    breaks = scanned.where("what = 'break'").select("tbl", "item_id", "line_no", "cut", "w")
    forms = breaks.select("w", "cut").distinct().withColumn("hyphened", F.concat(F.expr("substring(w, 1, cut)"), F.lit("-"), F.expr("substring(w, cut + 1)")))
    n_of = lambda c: words.select(F.col("w").alias(c), F.col("n").alias(f"n_{c}"))
    forms = forms.withColumn("left", F.expr("substring(w, 1, cut)")).withColumn("right", F.expr("substring(w, cut + 1)"))
    forms = forms.join(n_of("w"), "w", "left").join(n_of("hyphened"), "hyphened", "left").join(n_of("left"), "left", "left").join(n_of("right"), "right", "left").na.fill(0)
    forms = forms.join(cand.groupBy("w").agg(F.count("*").alias("like_known")), "w", "left").join(cand.groupBy(F.col("w").alias("hyphened")).agg(F.count("*").alias("like_compound")), "hyphened", "left")
    compound = (F.col("n_hyphened") > F.col("n_w")) | ((F.col("n_hyphened") + F.col("n_w") == 0) & F.col("like_known").isNull() & (F.col("n_left") >= LEAST_COUNT) & (F.col("n_right") >= LEAST_COUNT))
    forms = forms.select("w", "cut", "hyphened", compound.alias("compound"))
    kept = breaks.join(forms, ["w", "cut"])
    divided = kept.where("not compound").select("tbl", "item_id", F.lit("hyphenation").alias("noise"), "line_no", "w", F.col("w").alias("meant"))
    # a compound that the break only joined is no misreading
    compounds = kept.where("compound").select("tbl", "item_id", "line_no", "w").distinct()
    best = best.join(compounds, ["tbl", "item_id", "line_no", "w"], "left_anti")
    misread = best.select("tbl", "item_id", F.lit("misread").alias("noise"), line.alias("line_no"), "w", "meant")
    return layout.unionByName(divided).unionByName(misread).distinct()


def found(repaired: DataFrame) -> DataFrame:
    return repaired.select("tbl", "item_id", "noise", "line_no").distinct()


def paragraphs(pages: DataFrame, repaired: DataFrame) -> DataFrame:
    """(tbl, item_id, text): every page as continuous paragraphs: page numbers and running headers left out, divided words joined, misread words corrected,
    the lines of a paragraph joined by spaces, paragraphs apart by an empty line. A page that loses every line is an empty text; null texts have no row."""
    fixes = repaired.groupBy("tbl", "item_id").agg(F.collect_list(F.struct("noise", "line_no", "w", "meant")).alias("fixes"))  # as many as a page has noises
    both = pages.where("text is not null").join(fixes, ["tbl", "item_id"], "left").select("tbl", "item_id", "text", "first", "fixes")

    def mend(text: str, first: int, fixes: list | None) -> str:
        lines = text.split("\n")
        drop, words, whole = set(), {}, set()
        for f in fixes if fixes is not None else []:
            n = f["line_no"] - 1
            if f["noise"] in ("page_number", "running_header"):
                drop.add(n)
            elif f["noise"] == "hyphenation":
                whole.add(n)
            elif f["meant"]:
                words[n, f["w"]] = f["meant"]
        out: list[tuple[list[str], list[tuple[int, int]]]] = [([], [])]  # of each paragraph its parts, and where in it which line begins
        size, joined = 0, False
        for i, line in enumerate(lines):
            if i < first or i in drop:
                continue
            s = line.strip()
            if not s:
                if out[-1][0] and not joined:
                    out.append(([], []))
                    size = 0
                continue
            cut = BREAK.search(line.rstrip())
            if cut:
                s = re.sub(rf"\s?[{HYPHENS}]\s*\Z", "" if i in whole else "-", s)
            if out[-1][0] and not joined:
                s = " " + s
            out[-1][1].append((size, i))
            out[-1][0].append(s)
            size, joined = size + len(s), bool(cut)

        def mended(parts: list[str], marks: list[tuple[int, int]]) -> str:
            def fix(m: re.Match) -> str:
                w = m.group()
                a = max(0, bisect_right(marks, (m.start(), len(lines))) - 1)
                z = bisect_right(marks, (m.end() - 1, len(lines)))
                meant = next((x for _, i in marks[a:z] if (x := words.get((i, key_of(w)))) is not None), None)
                return w if meant is None else w.replace(w.strip("'‘’"), meant[:1].upper() + meant[1:] if w[:1].isupper() else meant, 1)

            return CHUNK.sub(fix, "".join(parts))

        return "\n\n".join(mended(*p) for p in out if p[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tbl": b["tbl"], "item_id": b["item_id"], "text": [mend(t, f, x) for t, f, x in zip(b["text"], b["first"], b["fixes"])]})

    return both.mapInPandas(run, "tbl string, item_id string, text string")
