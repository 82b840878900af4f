"""Personal information in free text: patterns propose spans, checksums confirm them, nearby words adjust the score; accepted spans become placeholders.

Every proposal starts with a score for how specific its pattern is. Checksums (Luhn for cards and plain numbers, mod 97 for bank accounts and French numbers,
mod 11 for Brazilian ones, the letters of Spanish ones, the ranges of American ones) add to it or take away, words in the 40 characters before it add or take
away, and spans of `ACCEPT` and more stay. Overlaps go to the earlier kind of: email, account, card, phone, id_number, address, name. Names come from a
given-and-family list that need not be complete: a word outside it counts as likely when its beginning and its ending both occur in list words of that kind,
and a span needs a listed word or a personal context.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import spread

ACCEPT = 0.5
S = r"[\s.\-‑–/]"
AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|AT|arroba|@)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s))"
DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|punto|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9_](?:[\w.+%-]*\w)?{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,}}(?![\w@])")
EMAIL_HINTS = ("@", "at)", "at]", "at}", "at>", "AT)", "AT]", "AT}", "arroba", " dot ", " DOT ", *(f"{a} {z}" for a in ("at", "AT") for z in ")]}>"))

PHONE = re.compile(
    r"(?<![\w+$€£.,\-/])(?:"
    rf"(?:(?:\+|00)1|\b1){S}?\(?\d{{3}}\)?{S}?\d{{3}}{S}?\d{{4}}"
    rf"|(?:\+|00)33{S}?(?:\(0\){S}?)?\d(?:{S}?\d\d){{4}}"
    rf"|(?:\+|00)44{S}?(?:\(0\){S}?)?(?:\d{{4}}{S}?\d{{3}}{S}?\d{{3}}|\d{{2,3}}{S}\d{{3,4}}{S}\d{{4}})"
    rf"|(?:\+|00)49{S}?(?:\(0\){S}?)?\d{{2,4}}{S}?\d{{5}}{S}?\d{{2,4}}"
    rf"|\+\d{{1,3}}(?:{S}?\(?\d{{2,4}}\)?){{3,4}}"
    rf"|\(\d{{3}}\){S}?\d{{3}}{S}\d{{4}}"
    rf"|\d{{3}}{S}\d{{3}}{S}\d{{4}}"
    rf"|\(0\){S}?\d{{2,4}}{S}?\d{{3,5}}{S}?\d{{2,5}}"
    rf"|0\d{{4}}{S}\d{{3}}{S}\d{{3}}|0\d{{4}}{S}\d{{6}}|0\d(?:{S}\d\d){{4}}|0\d{{2,4}}{S}\d{{5}}{S}\d{{2,4}}"
    r")(?![\w]|[.,\-]\d)"
)
ID = re.compile(
    r"(?<![\w+$€£.,\-/])(?:"
    r"(?P<ssn>\d{3}[-\s]\d\d[-\s]\d{4})|(?P<cpf>\d{3}\.\d{3}\.\d{3}-\d\d)|(?P<reg>\d{8}-\d{3}[A-Z])"
    r"|(?P<nino>[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D])|(?P<nie>[XYZ]\d{7}[A-Z])|(?P<pass>[A-Z]\d{8}|[A-Z]{2}\d{7})|(?P<dni>\d{8}[A-Z])"
    r"|(?P<insee>[12]\s?\d\d\s?(?:0[1-9]|1[0-2])\s?\d[\dAB]\s?\d{3}\s?\d{3}(?:\s?\d\d)?)|(?P<long>\d{9,12})"
    r")(?![\w]|[-]\d|[.,]\d)"
)
ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d\d(?:\s?[A-Z\d]{4}){2,7}(?:\s?[A-Z\d]{1,3})?(?![\w-])")
CARD = re.compile(r"(?<![\w+$€£.,\-/])(?:[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|3\d{3}([ -]?)\d{6}\2\d{5})(?![\w]|[-]\d|[.,]\d)")
ID_SCORE = {"ssn": 0.4, "cpf": 0.6, "reg": 0.6, "nino": 0.6, "nie": 0.5, "pass": 0.5, "dni": 0.3, "insee": 0.2, "long": 0.05}
ID_GOOD = re.compile(r"(?i)(?:ssn|social security|passport|taxpayer|tax id|tin|national (?:id|insurance)|identity|id (?:no|number|card)|ausweis\w*|steuer\w*|personal\w*nummer|identité|insee|sécurité sociale|documento|dni|nie|cpf|pasaporte)\W*(?:no|nr|n°|number|nummer|num)?(?:\W{1,3}[a-zà-ÿ]{1,9}){0,2}\W{0,3}\Z")
CARD_GOOD = re.compile(r"(?i)(?:card|credit|debit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta)\b\W*(?:no|nr|n°|number|nummer|num)?(?:\W{1,3}\w{1,9}){0,2}\W{0,3}\Z")
PHONE_GOOD = re.compile(r"(?i)(?:call|phone|fax|tel\w*|mobile|mobil|desk|number|anruf\w*|nummer|répond|appel\w*|atiende|llam\w*|ext|rufen|on|au|en el|unter)\W{0,3}(?:[\w ]{0,12}\W{0,3})?\Z")
BAD = re.compile(r"(?i)(?:\border|invoice|part no|isbn|issn|doi|accession|grid point|version|figure|table|serial|sku|model|catalogue no|case no|ref)\s*(?:no\.?|number|n[º°.])?\s*[:#.]?[\w.\-/:]{0,14}\s?\Z")

STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Close|Crescent|Court|Ct\.?|Terrace|Place|Pl\.?|Way|Square|Sq\.?|Row|Parkway|Pkwy\.?|Highway|Hwy\.?|Circle|Mews|Gardens|Hill|Walk|Grove)"
CAP = r"[A-ZÀ-Þ][\w'’-]*"
ADDRESS = re.compile(
    rf"(?:(?<!\w)(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\w+,\s+)?\d{{1,5}}[A-Za-z]?,?\s+(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?\s+)?(?:{CAP}\s+){{1,3}}{STREET}(?![\w])(?:,?\s+(?:Apt|Flat|Suite|Unit|Ste|#)\.?\s?\w+)?(?:,\s+{CAP}(?:\s[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}})?)?"
    rf"|(?i:(?<!\w)(?:P\.?\s?O\.?\s?Box|Post Office Box|Postfach|Apartado(?: de correos)?|Boîte postale|B\.P\.|Casilla)\s+\d+)(?:,\s+{CAP})?"
    rf"|(?<!\w){CAP}(?:straße|strasse|str\.|weg|platz|allee|gasse)\s+\d+[a-z]?(?:,\s+\d{{5}}\s+{CAP})?|(?<!\w)(?:{CAP}\s)?(?:Straße|Strasse|Weg|Platz|Allee)\s+\d+[a-z]?,\s+\d{{5}}\s+{CAP}"
    rf"|(?<!\w)\d{{1,4}}(?:\s(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route)\s+(?:(?:de|du|des|la|le|les|d['’]|l['’])\s*)*{CAP}(?:,\s+\d{{5}}\s+{CAP})?"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|C/)\s+(?:(?:de|del|la|las|los|el)\s+)*{CAP}(?:\s{CAP})?,?\s+(?:n[.º°]*\s?)?\d{{1,4}}(?:,\s+\d{{5}}\s+{CAP})?)"
)
# A place where an address may be has one of these (any white space as a space), or a box in any case.
ANCHORS = [" Street", " St.", " St,", " Road", " Rd", " Avenue", " Ave", " Boulevard", " Blvd", " Lane", " Ln", " Drive", " Dr.", " Dr,", " Close", " Crescent", " Court", " Ct", " Terrace", " Place", " Pl.", " Way", " Square", " Sq", " Row", " Parkway", " Pkwy", " Highway", " Hwy", " Circle", " Mews", " Gardens", " Hill", " Walk", " Grove"]
ANCHORS += ["straße", "strasse", "Straße", "Strasse", "str. ", "weg ", "platz ", "allee ", "gasse ", "Weg ", "Platz ", "Allee ", " rue ", " place ", " avenue ", " boulevard ", " chemin ", " allée ", " impasse ", " quai ", " route ", "Calle", "Avenida", "Plaza", "Paseo", "Camino", "Carrera", "C/"]
BOXES = ("box", "postfach", "apartado", "casilla", "boîte postale", "b.p.")
BOX = re.compile("(?i)" + "|".join(map(re.escape, BOXES)))
SPACE = re.compile(r"[^\S ]")
NUMBERS = re.compile(r"[\d(+][\d\s().\-/–‑]{5,}")
NAME = re.compile(rf"(?<![\w&'’-])(?:([A-ZÀ-Þ][a-zà-ÿ]+|[A-ZÀ-Þ]{{3,}})((?:\s+[A-ZÀ-Þ]\.){{0,2}})\s+([A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)?)|([A-ZÀ-Þ]\.)((?:\s?[A-ZÀ-Þ]\.){{0,1}})\s+([A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)?)|([A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)?),\s+([A-ZÀ-Þ][a-zà-ÿ]+|[A-ZÀ-Þ]{{3,}}|[A-ZÀ-Þ]\.)((?:\s?[A-ZÀ-Þ]\.){{0,2}}))(?![\w@])")
GAP = re.compile(r"[\s,]+")
NAME_GOOD = re.compile(r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Mme|Mlle)\.?|Frau|Herrn?|[Ss]eñora?|Madame|Monsieur|Author:|signed by|Thanks to|Yesterday|[Cc]ontact:?|Maintainer|Attn:?|Sincerely,?|firmado por|signé par|gezeichnet von|Autor(?:in)?:|Auteur:?)\s+\Z")
AFTER_COMPANY = re.compile(r"\s+(?:&|Inc|Ltd|LLC|Co\b|Corp|GmbH|SA\b|County|transform|theorem|Street|Lake|Bay|River|test|method|University|Institute|Foundation|Prize|Bridge|and Sons)")
BEFORE_PLACE = re.compile(r"(?:Lake|Mount|Port|Fort|Cape|The|River|Bay|San|Saint)\s+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Bank account numbers: the first four characters behind the rest, letters as numbers, remainder 1."""
    s = re.sub(r"\s", "", text).upper()
    return len(s) > 14 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def cpf(digits: str) -> bool:
    d = [int(c) for c in digits]
    check = lambda n: sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10
    return check(9) == d[9] and check(10) == d[10]


def confirmed(kind: str, text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    if kind == "ssn":  # social security and taxpayer numbers: no part is all zeros, and 666 is no area
        return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "account":
        return mod97(text)
    if kind == "card":
        return luhn(digits)
    if kind == "cpf":
        return cpf(digits)
    if kind in ("dni", "nie"):
        n = text[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] == text[-1]
    if kind == "insee" and len(digits) == 15:
        return 97 - int(digits[:13]) % 97 == int(digits[13:])
    return kind == "long" and luhn(digits)


class Names:
    """The list, and what words outside it look like."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.listed = {k: {w.casefold() for w, x in rows if x == k and w} for k in ("given", "family")}
        self.begin = {k: {w[:3] for w in v if len(w) > 4} for k, v in self.listed.items()}
        self.short = {w[:2] for w in self.listed["given"]}
        self.end = {k: {w[-3:] for w in v if len(w) > 4} for k, v in self.listed.items()}
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        marks: dict[str, str] = {}
        for kind, words in (("address", ANCHORS), ("email", EMAIL_HINTS), ("name", [f(w) for w in self.begin["family"] | self.listed["given"] | {x for x in self.listed["family"] if len(x) <= 4} for f in (str.title, str.upper)])):
            for w in words:
                marks[w] = marks.get(w, "") + " " + kind
        for w, kinds in marks.items():
            self.anchors.add_word(w, (len(w), kinds.split()))
        self.anchors.make_automaton()

    def kind(self, word: str, k: str) -> float:
        w = word.casefold()
        if k == "family" and "-" in w:
            return max(self.kind(p, k) for p in w.split("-"))
        if w in self.listed[k]:
            return 1.0
        if len(w) < 4 or w[-3:] not in self.end[k]:
            return 0.0
        return 0.6 if w[:3] in self.begin[k] or (k == "given" and w[:2] in self.short and len(w) < 8) else 0.0

    def score(self, given: str, family: str, before: str, after: str) -> float:
        f = self.kind(family, "family")
        if AFTER_COMPANY.match(after) or BEFORE_PLACE.search(before):
            return 0.0
        personal = 0.3 if NAME_GOOD.search(before) else 0.0
        if len(given.rstrip(".")) == 1:
            return 0.5 + personal if f else 0.0
        g = self.kind(given, "given")
        if f and g:
            return (f + g) / 2.4 + personal
        if f:  # an unknown given name
            return 0.1 + 0.1 * (f == 1) + personal
        return 0.2 + personal if g == 1 and personal else 0.0


def windows(text: str, at: list[int], before: int, after: int) -> list[tuple[int, int]]:
    """The surroundings of places in a text, from the beginning of a word, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for i in at:
        a, z = max(0, i - before), min(len(text), i + after)
        while a and text[a - 1].isalnum():
            a -= 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and without overlaps; positions from 0 in code points."""
    taken: list[tuple[int, int, str]] = []  # in order, without overlaps

    def add(a: int, z: int, kind: str) -> None:
        k = bisect_left(taken, (a,))
        if (k == len(taken) or taken[k][0] >= z) and (not k or taken[k - 1][1] <= a):
            insort(taken, (a, z, kind))

    at: dict[str, list[int]] = {"email": [], "address": [], "name": []}
    for end, (n, kinds) in names.anchors.iter(SPACE.sub(" ", text)):
        for k in kinds:
            i = end - n + 1
            if k != "name" or not i or not text[i - 1].isalnum():
                at[k].append(i)
    low = text.lower()
    if any(w in low for w in BOXES):  # few texts have one
        at["address"] += [m.start() for m in BOX.finditer(text)]
    for k in at.values():
        k.sort()
    for a, z in windows(text, at["email"], 120, 120):
        for m in EMAIL.finditer(text, a, z):
            add(m.start(), m.end(), "email")
    numbers = [(m.start(), m.end()) for m in NUMBERS.finditer(text)]
    runs = [(max(0, a - 4), min(len(text), z + 8)) for a, z in numbers]
    for a, z in windows(text, [a for a, z in numbers if sum(map(str.isdigit, text[a:z])) >= 6], 30, 60):  # an account number holds six digits in a row at least
        for m in ACCOUNT.finditer(text, a, z):
            if confirmed("account", m.group()):
                add(m.start(), m.end(), "account")
    for a, z in runs:
        for m in CARD.finditer(text, a, z):
            before = text[max(0, m.start() - 40) : m.start()]
            parted = bool(m.group(1) or m.group(2))
            if 0.1 + 0.2 * parted + 0.3 * confirmed("card", m.group()) + 0.3 * bool(CARD_GOOD.search(before)) - 0.5 * bool(BAD.search(before)) >= ACCEPT:
                add(m.start(), m.end(), "card")
    for a, z in runs:
        for m in PHONE.finditer(text, a, z):
            before = text[max(0, m.start() - 40) : m.start()]
            score = 0.6 + 0.3 * bool(PHONE_GOOD.search(before)) - 0.5 * bool(BAD.search(before))
            if score >= ACCEPT:
                add(m.start(), m.end(), "phone")
    for a, z in runs:
        for m in ID.finditer(text, a, z):
            kind = m.lastgroup
            before = text[max(0, m.start() - 40) : m.start()]
            good = bool(ID_GOOD.search(before))
            score = ID_SCORE[kind] + 0.4 * good - 0.5 * bool(BAD.search(before)) + 0.3 * confirmed(kind, m.group())
            if score >= ACCEPT and (good or kind != "long"):
                add(m.start(), m.end(), "id_number")
    for a, z in windows(text, at["address"], 80, 70):
        for m in ADDRESS.finditer(text, a, z):
            add(m.start(), m.end(), "address")
    for a, z in windows(text, at["name"], 60, 60):
        while m := NAME.search(text, a, z):
            a = m.start() + 1
            if m.group(1):
                given, family, swapped = m.group(1), m.group(3), False
            elif m.group(4):
                given, family, swapped = m.group(4), m.group(6), False
            else:
                given, family, swapped = m.group(8), m.group(7), True
            before = text[max(0, m.start() - 24) : m.start()]
            score = names.score(given, family, before, text[m.end() : m.end() + 16])
            if swapped and len(given.rstrip(".")) > 1 and not names.kind(given, "given") and not NAME_GOOD.search(before):
                score = 0.0
            if score >= ACCEPT:
                add(m.start(), m.end(), "name")
                a = m.end()
            else:  # the next capital word may begin a name
                a = GAP.search(text, m.start(), m.end()).end()
    return taken


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, z, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join([*out, text[at:]])


def _list(names: DataFrame, word: str, kind: str) -> list[tuple[str, str]]:
    """The name list, which is fixed and small; its size is checked."""
    n = names.count()
    if n > 1_000_000:
        raise ValueError(f"a name list of {n} words is no longer small")
    return [(r[0], r[1]) for r in names.select(word, kind).where(F.col(word).isNotNull()).distinct().collect()]


def spans(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word", kind: str = "word_kind") -> DataFrame:
    """Of the kinds email, account, card, phone, id_number, address and name: (key, kind, start_pos, end_pos, placeholder text): one row a span; positions from 1 in code points, the end inclusive.

    Null keys and null and empty texts have no rows; repeated rows count once; an empty name list leaves the other kinds; extra columns are ignored. Texts of
    any length are read whole. No shuffle but for repeated rows."""
    rows = _list(names, word, kind)
    shared = documents.sparkSession.sparkContext.broadcast(rows)
    d = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and length(text) > 0"))
    key_type = d.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names(shared.value)
        for b in batches:
            out = [(k, kind, a + 1, z, t[a:z]) for k, t in zip(b["key"], b["text"]) for a, z, kind in find(t, known)]
            yield pd.DataFrame(out, columns=["key", "kind", "start_pos", "end_pos", "found"])

    return d.mapInPandas(run, f"key {key_type}, kind string, start_pos bigint, end_pos bigint, found string").distinct().withColumnRenamed("key", key)


def redacted(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word", kind: str = "word_kind") -> DataFrame:
    """(key, text, spans): every row of documents, its text with typed placeholders, and how many there are; null texts stay null."""
    shared = documents.sparkSession.sparkContext.broadcast(_list(names, word, kind))
    d = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    key_type = d.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names(shared.value)
        for b in batches:
            found = [find(t, known) if t else [] for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "text": [redact(t, s) if t else t for t, s in zip(b["text"], found)], "spans": [len(s) for s in found]})

    return d.mapInPandas(run, f"key {key_type}, text string, spans int").withColumnRenamed("key", key)
