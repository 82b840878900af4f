"""Broken prompt and response pairs: ordered rules, every defect that holds is given.

Order: `empty` (nothing, or only filler; nothing else can be said of it), `refusal` (a multilingual refusal phrase opens the answer, whatever follows), `copy`
(the answer is the question again, whole or a cut prefix of it, with or without a label, quotes or an ellipsis), `truncated` (unclosed delimiter, ellipsis, or an
ending that is no sentence end; a refusal or copy also by the word it breaks off at) and `other_language` (script mismatch, or the function words of another
language). An expected answer to a `negative` (empty or refusing) has no defect at all.

Whether an answer without closing mark stops inside its sentence is decided by its last word (an article, conjunction or preposition leaves it open), by its
other sentences (where they have their marks, the last one lost its own), and for a single sentence from the corpus: of the finished sentences of all answers
that begin with the sentence's frame (function words kept, other words, names and numbers blanked), more have to end with it than go on. The share does not move
with the number of rows; a frame that no finished sentence begins with is unfinished. Numbers, names and lists are complete. Answers are judged in one pass,
whose findings are a written table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.languages import RANKED, script, word_weights
from quillmark.session import written

# Fillers, refusal phrases and function words.
FILLER = re.compile(r"(?i)[\W_]*(?:n\s*/?\s*a|none|null|nil|nan|tbd|todo|tba|unknown|undefined|empty|no answer|no response|not available|not applicable|keine antwort|k\.?\s*a|sans réponse|sin respuesta|lorem ipsum)?[\W_]*\Z")
OPENING = r"(?:i'?m (?:very |so |really )?sorry|i am (?:very |so |really )?sorry|sorry|i(?:'m| am) afraid|apologies|my apologies|i apologi[sz]e|unfortunately|regrettably|as an? (?:ai|artificial intelligence|assistant|language model|ai assistant|ai language model))[,;:.]?\s*(?:but\s+|that\s+)?"
CORE = (
    r"(?:i(?:'m| am) (?:not able|unable|not allowed|not in a position)|i (?:cannot|can ?not|can'?t|could not|couldn'?t|won'?t|will not|do not|don'?t|must decline|have to decline|decline)\b"
    r"|(?:this|that|it) (?:cannot|can ?not|can'?t) be (?:answered|determined|given)|no answer can be|there (?:is|was)(?: not|n'?t) enough|there is no (?:information|answer)|(?:that|this) is outside what i"
    r"|the (?:passage|context|text|document|documents|information|provided \w+) (?:does|do)(?: not|n'?t) (?:contain|say|state|mention|provide|answer|give)|not in the corpus|not enough (?:context|information))"
)
REFUSAL = re.compile(
    r"(?i)[\s\"'“”«»*>-]*(?:" + OPENING + r")?" + CORE
    + r"|(?i:[\s\"'“”«»*>-]*(?:sorry,|i'?m sorry[,.]|i am sorry[,.]|my apologies[,.]|apologies, (?:but|i|that|this|there|no)))"
    + r"|(?i:[\s\"'“”«»*>-]*(?:(?:leider|entschuldigung|es tut mir leid|tut mir leid)[, ]|ich (?:kann|konnte|weiß|darf|bin nicht in der lage)\b[^.]{0,60}\b(?:nicht|keine|nicht beantworten)|(?:das|dies|diese frage) (?:kann|lässt sich)[^.]{0,40} nicht|als (?:ki|sprachmodell|assistent)\b|der (?:text|abschnitt|kontext) enthält (?:die antwort nicht|keine)))"
    + r"|(?i:[\s\"'“”«»*>-]*(?:(?:désolée?|malheureusement|je regrette|je suis désolée?|je m'excuse)[, ]|je (?:ne (?:peux|puis|sais|suis)|n'ai)\b|en tant qu[e'’]|(?:le (?:passage|texte|contexte)|ce passage) ne (?:contient|dit|donne|permet)|il n'y a pas assez|aucune réponse ne))"
    + r"|(?i:[\s\"'“”«»*>-]*(?:(?:lo siento|lamentablemente|desafortunadamente|lo lamento|disculpe|disculpas)[, ]|no (?:puedo|sé|tengo|me es posible|es posible responder|hay suficiente)\b|como (?:asistente|modelo)\b|(?:el (?:pasaje|texto|contexto)) no (?:contiene|dice|menciona)))"
    + r"|(?i:[\s\"'“”«»*>-]*(?:(?:mi dispiace|purtroppo|sono spiacente)[, ]|non (?:posso|so|sono in grado|è possibile|ho abbastanza)\b|in quanto (?:assistente|modello)\b|il (?:testo|contesto) non (?:contiene|dice)))"
    + r"|(?i:[\s\"'“”«»*>-]*(?:(?:helaas|het spijt me)[, ]|ik (?:kan|weet|mag|ben niet in staat)\b[^.]{0,60}\b(?:niet|geen)|de (?:tekst|context) bevat (?:het antwoord niet|geen)))"
    + r"|(?i:[\s\"'“”«»*>-]*(?:(?:lamento|infelizmente|desculpe)[, ]|não (?:posso|sei|consigo|é possível|tenho informaç)|o (?:texto|contexto) não (?:contém|diz)))"
)
WORDS = {
    "en": "the of and to is was by that with as at this which be not from it for its are were has had in on an or into each no if when under who did does what why how name report",
    "de": "der die das den dem des und ist war von mit für zu nicht ein eine einen einem einer eines sich auf im wird wurde aus nach als bei weil wer wie welchen warum zwischen seit es gibt keinen hat auch kein",
    "fr": "le la les du et est dans pour par sur une que qui il au aux se ne pas ce cette quel quelle pourquoi depuis des l'on n'y sans entre plus été sont reste selon",
    "es": "el la los las del y es en para por con una que se al lo su según sin desde qué cuál cómo fue entre hay más no está son por",
}
#: Weights of the words that tell languages apart: those above and the frequent ones of more languages.
LANG = word_weights({k: [*dict.fromkeys([*WORDS.get(k, "").split(), *RANKED[k]])] for k in RANKED})
FUNCTION = frozenset(" ".join(WORDS.values()).split()) | frozenset("a near more than after before during until while some all none so such only rather but then over up out there stood he she they we you my our his her their these those most be can must may should could have been".split())
#: Words after which a sentence goes on.
LEFT_OPEN = frozenset("the a an of and or from for with into its each if than und ein eine einen einem einer eines dem des für von mit zu le la les du et une pour dans par sur aux el los las del y en para por una al".split())
LABEL = re.compile(r"(?i)^\s*(?:the question is|question|q|frage|pregunta|la question est|la pregunta es|query|prompt)\s*[:\-–]\s*")
QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
ENDED = re.compile(r"(?:[.!?。！？]|[.!?][\"'”»’)\]]+|[.!?]\s*\[\d+\])\s*\Z")
OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}


def squeeze(s: str) -> str:
    return re.sub(r"[\W_]+", " ", s.casefold()).strip()


def is_copy(query: str, answer: str) -> bool:
    q, a = squeeze(query), squeeze(LABEL.sub("", answer))
    if not q or not a:
        return False
    return a == q or (len(a) >= 0.6 * len(q) and len(a.split()) > 2 and q.startswith(a)) or a == f"{q} {q}"


def unclosed(text: str) -> bool:
    stack: list[str] = []
    for i, c in enumerate(text):
        if c == "„":
            stack.append("“")
        elif stack and c == stack[-1] or stack and stack[-1] == "“" and c == "”":
            stack.pop()
        elif c in OPEN:
            stack.append(OPEN[c])
    return bool(stack) or text.count("```") % 2 == 1


def sentences(answer: str) -> list[str]:
    return re.split(r"(?<=[.!?])[\"'”»)]*\s+(?=[\"'“«(„¿¡]?[A-ZÀ-Þ0-9$])", answer.strip())


def frame(sentence: str) -> str:
    out = []
    for i, w in enumerate(re.findall(r"[^\W_]+(?:[-'’.,][^\W_]+)*|[$%€]", sentence)):
        low = w.lower()
        if re.search(r"\d", w):
            out.append("9")
        elif low in FUNCTION:
            out.append(low)
        elif w[:1].isupper() and i:
            out.append("X")
        elif w not in "$%€":
            out.append("*")
    return " ".join(out)


def listing(answer: str) -> bool:
    """Numbers, names and lists: short items between commas, semicolons or lines, or up to four words of which the function words are only joining ones."""
    parts = [p.strip() for p in re.split(r"[,;\n•|]|\band\b|\bund\b|\bet\b|\by\b", answer) if p.strip()]
    words = WORD.findall(answer)
    lower = [w for w in words if not w[:1].isupper()]
    inner = [w for w in words if w.lower() in FUNCTION - {"and", "und", "et", "y", "of", "de", "von", "del", "or", "the"}]
    if not lower or len(words) <= 1:
        return True
    if answer.rstrip()[-1:] in ",;:" or words[-1].lower() in FUNCTION:
        return False
    lines = [x for x in answer.split("\n") if x.strip()]
    if len(lines) > 1 and all(re.match(r"\s*(?:[-*•·–]|\(?(?:\d{1,3}|[a-z])[.)])\s", x) for x in lines):
        return True
    return len(parts) >= 2 and all(len(p.split()) <= 3 for p in parts) and not inner or len(words) <= 4 and not inner


def language(text: str) -> dict[str, float]:
    words = [w.lower() for w in WORD.findall(QUOTED.sub(" ", text))]
    return {k: sum(v.get(w, 0.0) for w in words) for k, v in LANG.items()}


def other_language(query: str, answer: str) -> bool:
    sq, sa = script(query), script(QUOTED.sub(" ", answer))
    if sq and sa and sq != sa:
        return True
    q, a = language(query), language(answer)
    lq = max(q, key=lambda k: q[k])
    la = max(a, key=lambda k: a[k])
    return q[lq] > 0 and la != lq and a[la] >= 2 and a[la] >= 2 * a[lq] + 1


def judge(kind: str | None, query: str | None, answer: str | None) -> tuple[list[str], str | None]:
    """The defects, and the frame of a single sentence that may be unfinished."""
    query = query or ""
    if answer is None or FILLER.match(answer):
        return ([] if kind == "negative" or (answer is None and kind == "paraphrase") else ["empty"]), None
    out, open_frame = [], None
    if REFUSAL.match(answer):
        if kind == "negative":
            return [], None
        out.append("refusal")
    if is_copy(query, answer):
        out.append("copy")
    text = answer.strip().rstrip("​⁠﻿")
    if unclosed(text) or re.search(r"(?:\.\.\.|…)[\"'”»)]*\Z", text) and "copy" not in out:
        out.append("truncated")
    elif re.search(r"[^\W\d_]\Z", text) and WORD.findall(text)[-1].lower() in LEFT_OPEN and not listing(text):
        out.append("truncated")
    elif not out and not ENDED.search(text) and not listing(text):
        *earlier, last = sentences(text)
        if any(ENDED.search(x) and len(WORD.findall(x)) > 2 for x in earlier):
            out.append("truncated")
        else:
            open_frame = frame(last)
    if other_language(query, answer):
        out.append("other_language")
    return out, open_frame


def defects(df: DataFrame, id_col: str = "id", type_col: str = "type", query_col: str = "query", answer_col: str = "_answer") -> DataFrame:
    """(id, defect): every defect of every pair, once an id and defect.

    Null queries have no language and no copies; null ids have no rows; repeated rows count once; an empty table gives no rows; extra columns are ignored.
    """
    d = df.select(F.col(id_col).cast("string").alias("id"), F.col(type_col).alias("kind"), F.col(query_col).alias("q"), F.col(answer_col).alias("a")).where("id is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            ends: Counter = Counter()
            goes_on: Counter = Counter()
            for i, k, q, a in zip(b["id"], b["kind"], b["q"], b["a"]):
                found, open_frame = judge(k, q, a)
                out += [(i, x, None, None, None) for x in found]
                if open_frame is not None:
                    out.append((i, None, open_frame, None, None))
                if a:  # frames of the finished sentences
                    for f in {frame(x) for x in sentences(a) if ENDED.search(x)}:
                        ends[f] += 1
                        goes_on.update(f[: m.start()] for m in re.finditer(" ", f))
            out += [(None, None, f, ends[f], goes_on[f]) for f in ends.keys() | goes_on.keys()]
            yield pd.DataFrame(out, columns=["id", "defect", "open", "ends", "goes_on"], dtype=object)

    ran = written(d.mapInPandas(run, "id string, defect string, open string, ends bigint, goes_on bigint"))
    frames = ran.where("ends is not null").groupBy("open").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")).where("ends > goes_on").select("open")
    cut = ran.where("id is not null and open is not null").join(frames, "open", "left_anti").select("id", F.lit("truncated").alias("defect"))
    return ran.where("defect is not null").select("id", "defect").unionByName(cut).distinct()
