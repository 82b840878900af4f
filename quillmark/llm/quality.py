"""Text statistics of documents, and what a text mainly is: prose, list, table or junk.

Beside basic counts, two distributions are compared by Jensen-Shannon divergence: a text's function words with the profile of each language (words by
rank, weights falling as 1 / rank), and its token classes (function words, words, names, numbers, cell separators, dot leaders, line markers, noise) with
structural profiles of prose, lists, tables and junk. The nearest structural profile names the kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.languages import FUNCTION, RANKED
from quillmark.session import spread

PROFILES_LANG = {k: {w: 1 / (i + 2) for i, w in enumerate(v)} for k, v in RANKED.items()}
CLASSES = ("function", "word", "name", "number", "cell", "leader", "marker", "noise")
# Shares of the classes (in the order of CLASSES) in typical texts of each kind.
PROFILES = {
    ("prose", "running"): (0.36, 0.42, 0.13, 0.07, 0.0, 0.0, 0.01, 0.01),
    ("prose", "figures"): (0.30, 0.36, 0.15, 0.17, 0.0, 0.0, 0.01, 0.01),
    ("prose", "unknown tongue"): (0.06, 0.70, 0.16, 0.06, 0.0, 0.0, 0.01, 0.01),
    ("prose", "other script"): (0.0, 0.86, 0.06, 0.06, 0.0, 0.0, 0.01, 0.01),
    ("prose", "scanned"): (0.33, 0.42, 0.12, 0.05, 0.0, 0.0, 0.01, 0.07),
    ("prose", "with a listing"): (0.24, 0.38, 0.18, 0.06, 0.02, 0.02, 0.09, 0.01),
    ("list", "points"): (0.01, 0.46, 0.16, 0.01, 0.0, 0.0, 0.34, 0.02),
    ("list", "numbered"): (0.01, 0.30, 0.40, 0.02, 0.0, 0.0, 0.26, 0.01),
    ("list", "names"): (0.02, 0.12, 0.80, 0.04, 0.0, 0.0, 0.01, 0.01),
    ("list", "contents"): (0.02, 0.08, 0.42, 0.24, 0.0, 0.24, 0.0, 0.0),
    ("list", "contents of words"): (0.08, 0.36, 0.12, 0.22, 0.0, 0.20, 0.02, 0.0),
    ("list", "index"): (0.01, 0.04, 0.32, 0.63, 0.0, 0.0, 0.0, 0.0),
    ("list", "index of words"): (0.02, 0.34, 0.06, 0.56, 0.0, 0.0, 0.02, 0.0),
    ("table", "cells"): (0.01, 0.08, 0.11, 0.40, 0.40, 0.0, 0.0, 0.0),
    ("table", "wide cells"): (0.01, 0.05, 0.06, 0.48, 0.40, 0.0, 0.0, 0.0),
    ("table", "cells of words"): (0.02, 0.28, 0.22, 0.13, 0.35, 0.0, 0.0, 0.0),
    ("junk", "noise"): (0.0, 0.01, 0.01, 0.02, 0.01, 0.0, 0.0, 0.95),
    ("junk", "broken words"): (0.02, 0.16, 0.06, 0.10, 0.04, 0.0, 0.02, 0.60),
    ("junk", "navigation"): (0.01, 0.03, 0.36, 0.0, 0.10, 0.0, 0.0, 0.50),
    ("junk", "leaders"): (0.0, 0.0, 0.0, 0.45, 0.0, 0.55, 0.0, 0.0),
}
# The same for titles, which have a few tokens.
TITLE_PROFILES = {
    ("prose", "words"): (0.26, 0.50, 0.20, 0.02, 0.0, 0.0, 0.01, 0.01),
    ("prose", "names"): (0.08, 0.06, 0.80, 0.04, 0.0, 0.0, 0.01, 0.01),
    ("prose", "numbered"): (0.10, 0.18, 0.40, 0.22, 0.0, 0.0, 0.10, 0.0),
    ("prose", "misread"): (0.20, 0.28, 0.25, 0.02, 0.0, 0.0, 0.0, 0.25),
    ("table", "figures"): (0.0, 0.04, 0.06, 0.88, 0.02, 0.0, 0.0, 0.0),
    ("table", "cells"): (0.0, 0.08, 0.10, 0.42, 0.40, 0.0, 0.0, 0.0),
    ("table", "named cells"): (0.02, 0.20, 0.16, 0.34, 0.28, 0.0, 0.0, 0.0),
    ("junk", "noise"): (0.0, 0.02, 0.02, 0.02, 0.0, 0.0, 0.02, 0.92),
    ("junk", "noise with words"): (0.03, 0.14, 0.16, 0.06, 0.01, 0.0, 0.0, 0.60),
    ("junk", "leaders"): (0.0, 0.0, 0.0, 0.15, 0.0, 0.75, 0.10, 0.0),
    ("junk", "separators"): (0.0, 0.02, 0.0, 0.0, 0.82, 0.0, 0.16, 0.0),
}
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
NUMBER = re.compile(r"[(\[+\-–−$€£]*\d[\d.,:/\-–]*(?:[%‰°]|bn|m|k|st|nd|rd|th)?[)\],.;:]*|[—–\-](?=$)|%")
MARKER = re.compile(r"\s*(?:[-*•·‣▪◦○●–]\s+|\(?(?:\d{1,3}|[a-z]|[ivxlc]{1,5}|[A-Z])[.)]\s+)")
GAPS = re.compile(r"(?<=\S) {2,}(?=\S)")
MOJIBAKE = re.compile(r"[ÃÂÐÑâï¿½€™œ¤§¦¬�]")
ALNUM = re.compile(r"[^\W_]+")
BARE = "()[]{}\"'“”‘’«»„.,;:!?*_`。，、；：！？「」『』（）《》・"
OTHER_SCRIPT = re.compile(r"[\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f\u0530-\u058f\u0590-\u06ff\u0750-\u077f\u0900-\u0dff\u0e00-\u0eff\u10a0-\u10ff\u1100-\u11ff\u1200-\u137f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
UNSPACED = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")  # scripts that do not part words


def token_class(t: str) -> str:
    if re.fullmatch(r"\|+|:?-{2,}:?(?:\|:?-{2,}:?)*|=+\|?=*", t):
        return "cell"
    if re.fullmatch(r"[.…·_]{3,}|(?:\. ?){3,}", t):
        return "leader"
    if NUMBER.fullmatch(t):
        return "number"
    w = t.strip(BARE)
    if not w:
        return "noise" if len(t) > 1 or t not in BARE else "marker"
    low = w.lower()
    if low in FUNCTION:
        return "function"
    letters = sum(c.isalpha() for c in w)
    if letters and len(OTHER_SCRIPT.findall(w)) >= 0.6 * len(w):
        return "name" if w[0].isupper() else "word"
    if MOJIBAKE.search(w) and len(MOJIBAKE.findall(w)) * 2 >= min(len(w), 6):
        return "noise"
    if re.match(r"cid:\d", w) or re.search(r"[←-⇿─-➿›»«‹¶§]", t):
        return "noise"
    if len(w) > 24 and not re.match(r"https?:|www\.", w) and any(len(x) > 20 or re.search(r"[a-z][A-Z].*[a-z][A-Z]|\d[A-Za-z]+\d", x) for x in re.split(r"[-/_.+=]", w)):
        return "noise"
    if WORD.fullmatch(w):
        if letters >= 4 and not re.search(r"[aeiouyàâäáéèêëíïîóôöúüûœæãõåøı]", low) and not (w.isupper() and letters <= 6):
            return "noise"
        if letters == 1 and low not in "aàeéoyi":
            return "noise" if not w.isupper() else "name"
        return "name" if w[0].isupper() and not (letters > 3 and w.isupper()) else "word"
    if sum(c.isalnum() for c in w) < 0.6 * len(w) and not re.fullmatch(r"\w+\(\w*\)?|[\d.,:/\-–%$€£()]+", w):
        return "noise"
    if any(c.isdigit() for c in w):
        if re.fullmatch(r"[\d.,:/\-–%$€£]+", w) or re.fullmatch(r"[A-Za-z]{0,3}[\-.]?\d+(?:[.\-:/]\d+)*[A-Za-z]{0,2}", w) and len(w) < 7:
            return "number"
        if re.search(r"\d[A-Za-z]+\d|[A-Za-z]\d+[A-Za-z]|[|]", w) and len(w) >= 2 and not re.search(r"[aeiou][a-z]*[aeiou]", low):
            return "noise"
        if len(w) > 4 and w.isalnum() and not re.search(r"[aeiouy]", low):
            return "noise"
        return "noise" if len(w) > 7 and re.fullmatch(r"[0-9a-f]+", w) else "word"
    return "word" if letters >= 0.7 * len(w) and re.search(r"[aeiouy]", low) else "noise"


class Classes(dict):
    """Classes of tokens seen, bounded."""

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[t] = c = token_class(t)
        return c


def class_counts(text: str, known: Classes) -> Counter:
    n: Counter = Counter()
    tokens: list[str] = []
    for line in text.split("\n"):
        if m := MARKER.match(line):
            n["marker"] += 1
            line = line[m.end() :]
        if "\t" in line:
            n["cell"] += line.count("\t")
        elif "  " in line:
            n["cell"] += len(GAPS.findall(line))
        elif (commas := line.count(",")) >= 2 and line.count(" ") <= commas and ", " not in line:
            n["cell"] += commas
            line = line.replace(",", " ")
        tokens += line.split()
    n.update(map(known.__getitem__, tokens))
    if unspaced := UNSPACED.findall(text):
        n["word"] += len(unspaced) // 2
    return n


def divergence(p: dict, q: dict) -> float:
    """Jensen-Shannon, base 2: 0 for equal distributions, 1 for disjoint ones. Weights need not be normalised. Only keys of both are visited: what one side
    alone has adds half its share, and the shares add up to 1."""
    sp, sq = sum(p.values()), sum(q.values())
    if not sp or not sq:
        return 1.0
    total = 0.0
    for k in p:
        if k in q:
            a, b = p[k] / sp, q[k] / sq
            total += (a * math.log2(a / (a + b)) if a else 0) + (b * math.log2(b / (a + b)) if b else 0)
    return max(0.0, 1 + total / 2)


class Profiles:
    """Structural profiles as a matrix of shares."""

    def __init__(self, profiles: dict[tuple[str, str], tuple[float, ...]]):
        self.kinds = [k for k, _ in profiles]
        self.shares = np.array(list(profiles.values()))
        self.shares /= self.shares.sum(axis=1, keepdims=True)
        # profiles that function words of a known language are part of
        self.spoken = np.array([k == "prose" and v[0] > 0.2 for (k, _), v in profiles.items()])

    def nearest(self, n: Counter, language_far: float = 0.0) -> tuple[str, float]:
        """The kind of the nearest profile, and the divergence from it. How far the text's function words are from every known language counts against the
        profiles of prose in such a language."""
        p = np.array([n[c] for c in CLASSES], float)
        p /= p.sum()
        m = (self.shares + p) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (np.nansum(p * np.log2(p / m), axis=1) + np.nansum(self.shares * np.log2(self.shares / m), axis=1)) / 2
        i = int(np.argmin(far + LANGUAGE_WEIGHT * language_far * self.spoken))
        return self.kinds[i], float(far[i])


LANGUAGE_WEIGHT = 0.05
TEXTS, TITLES = Profiles(PROFILES), Profiles(TITLE_PROFILES)


def text_kind(text: str, known: Classes, language_far: float = 0.0) -> tuple[str, float]:
    if not text.strip():
        return "junk", 0.0  # without content
    return TEXTS.nearest(class_counts(text, known), language_far)


def title_kind(title: str, known: Classes) -> str:
    """prose (a title), table (a row of cells) or junk."""
    n = class_counts(title, known)
    return TITLES.nearest(n)[0] if sum(n.values()) else "junk"


def statistics(text: str | None, title: str | None, known: Classes) -> dict:
    t = text or ""
    lines = [x for x in t.split("\n") if x.strip()]
    words = [w.lower() for w in WORD.findall(t)]
    common = Counter(w for w in words if w in FUNCTION)
    far_of = {k: divergence(common, v) for k, v in PROFILES_LANG.items()} if common else {}
    lang = min(far_of, key=far_of.get) if far_of else None
    kind, far = text_kind(t, known, far_of[lang] if lang else 1.0) if text is not None else (None, None)
    visible = sum(map(len, t.split()))
    return {
        "n_chars": len(t), "n_words": len(words), "mean_word_len": sum(map(len, words)) / len(words) if words else None,
        "symbol_ratio": (visible - sum(map(len, ALNUM.findall(t)))) / visible if visible else None,
        "ended_lines": sum(x.rstrip()[-1] in ".!?:;”\"'»)" for x in lines) / len(lines) if lines else None,
        "common_words": sum(common.values()) / len(words) if words else None,
        "language": lang, "language_divergence": far_of.get(lang),
        "kind": kind, "kind_divergence": far, "title_kind": title_kind(title, known) if title is not None else None,
    }


SCHEMA = "n_chars bigint, n_words bigint, mean_word_len double, symbol_ratio double, ended_lines double, common_words double, language string, language_divergence double, kind string, kind_divergence double, title_kind string"


def text_statistics(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, statistics...): one row for each distinct (key, text, title), in one pass; rows delivered more than once count once.

    A null text has counts of 0 and no kind; an empty or blank one is junk (without content); a null title has no title_kind. Null keys stay null keys; an
    empty table gives no rows; extra columns are ignored; texts of any length are read whole."""
    d = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(title) if title else F.lit(None)).cast("string").alias("title")))
    kind = d.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Classes()
        for b in batches:
            out = pd.DataFrame([statistics(t, h, known) for t, h in zip(b["text"], b["title"])], columns=[x.split()[0] for x in SCHEMA.split(", ")])
            out.insert(0, "key", b["key"].to_numpy())
            yield out

    return d.mapInPandas(run, f"key {kind}, {SCHEMA}").distinct().withColumnRenamed("key", key)


def not_prose(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, field, kind): texts that are a list, a table or junk, and titles that are a table row or junk."""
    s = text_statistics(df, key, text, title)
    both = F.array(F.struct(F.lit("text").alias("field"), F.col("kind").alias("kind")), F.struct(F.lit("title").alias("field"), F.col("title_kind").alias("kind")))
    return s.select(key, F.explode(both).alias("x")).select(key, "x.field", "x.kind").where("kind is not null and kind != 'prose'").distinct()
