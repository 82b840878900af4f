"""Calls of text models and embedders inside the tasks: protocols, offline stand-ins, answers checked against a form with one more asking, a cache by fingerprint,
and degrading to a reason where a model fails."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import STOP_WORDS, fingerprint
from quillmark.operators.loop import REFUSAL

AGAIN = "\nReply with the JSON object only."


class TextModel(Protocol):
    """Answers prompts, in order; None where it has none."""

    name: str

    def answer(self, prompts: list[str]) -> list[str | None]: ...


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def content_words(text: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall("[a-z0-9]+", text.lower())) if w not in STOP_WORDS]


def share(part: str, whole: str) -> float:
    """Share of part's content words that whole has."""
    words = content_words(part)
    known = set(re.findall("[a-z0-9]+", whole.lower()))
    return sum(w in known for w in words) / len(words) if words else 0.0


class FirstPassage:
    """Stand-in of a writer: the beginning of the first passage of the context, or the refusal where there is none or it has less than `least` of the question."""

    def __init__(self, least: float = 0.0, most: int = 300):
        self.name, self.least, self.most = f"first-passage-{least}-{most}", least, most

    def answer(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            context, _, question = p.removeprefix("Context:\n").rpartition("\n\nQuestion: ")
            first = re.split(r"\n\n\[2\] ", context, maxsplit=1)[0].partition("\n")[2]
            good = bool(first) and share(question.removesuffix("\nAnswer:"), first) >= self.least
            out.append(first[: self.most] if good else REFUSAL)
        return out


class OverlapJudge:
    """Stand-in of a judge: how much of the question the answer holds. It forgets the form at its first answer to a long prompt, as models do."""

    name = "overlap-judge"

    def __init__(self, good: float = 0.5, fair: float = 0.2):
        self.good, self.fair = good, fair

    def answer(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            question, _, answer = p.removesuffix(AGAIN).partition("\nANSWER: ")
            s = share(question.removeprefix("QUESTION: "), answer)
            verdict = "correct" if s >= self.good else "partial" if s >= self.fair else "wrong"
            out.append(json.dumps({"verdict": verdict}) if p.endswith(AGAIN) or len(p) % 3 else f"I would say {verdict}.")
        return out


class HashedWords:
    """Stand-in of an embedder: counts of words in `dim` buckets by the first four digits of their SHA-256, of length 1."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hashed-words-{dim}", dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for k, t in enumerate(texts):
            for w in re.findall("[a-z0-9]+", (t or "").lower()):
                out[k, int(hashlib.sha256(w.encode()).hexdigest()[:4], 16) % self.dim] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


TEXT_MODELS: dict[str, Callable[[], TextModel]] = {"first-passage": FirstPassage, "overlap-judge": OverlapJudge}
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed-words": HashedWords}


def json_object(text: str | None) -> dict | None:
    """The first JSON object in a text, also between other words or in a fence; None without one."""
    for m in re.finditer(r"\{", text or ""):
        try:
            got, _ = json.JSONDecoder().raw_decode(text, m.start())
        except ValueError:
            continue
        return got if isinstance(got, dict) else None
    return None


def enum_field(field: str, values: tuple[str, ...]) -> Callable[[str | None], str | None]:
    """A form: a JSON object whose `field` is one of `values`; gives that value."""

    def check(text: str | None) -> str | None:
        got = (json_object(text) or {}).get(field)
        return got if isinstance(got, str) and got in values else None

    return check


def ask(prompts: DataFrame, key: str, prompt: str, model: Callable[[], TextModel], form: Callable[[str | None], str | None] | None = None, size: int = 32, workers: int | None = None) -> DataFrame:
    """(key, prompt, answer, calls, reason): what the model says to every prompt, `size` at a time. With a form, an answer that does not fit is asked for once more,
    and is then null with the reason; so is one that the model fails on. `workers` tasks ask at once (by default as many as the prompts have partitions)."""
    d = prompts.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"))
    d = d if workers is None else d.repartition(workers)
    kind = d.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = model()

        def answers(texts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                return [(a, None if a is not None else "no answer") for a in one.answer(texts)]
            except Exception as e:  # noqa: BLE001  a model that fails costs its answers, not the job
                return [(None, f"{type(e).__name__}: {e}"[:200])] * len(texts)

        for b in batches:
            for z in range(0, len(b), size):
                c = b.iloc[z : z + size]
                asked = [p or "" for p in c["prompt"]]
                got = answers(asked)
                calls = [1] * len(got)
                if form is not None:
                    fits = [form(a) for a, _ in got]
                    poor = [k for k, (x, (a, why)) in enumerate(zip(fits, got)) if x is None and why is None]
                    for k, (a, why) in zip(poor, answers([asked[k] + AGAIN for k in poor]) if poor else []):
                        fits[k], calls[k] = form(a), 2
                        got[k] = (a, why or (None if fits[k] is not None else "answer does not fit the form"))
                    got = [(x, why) for x, (_, why) in zip(fits, got)]
                yield pd.DataFrame({"key": c["key"], "prompt": c["prompt"], "answer": [a for a, _ in got], "calls": calls, "reason": [w for _, w in got]})

    return d.mapInPandas(run, f"key {kind}, prompt string, answer string, calls int, reason string").withColumnRenamed("key", key)


def ask_cached(prompts: DataFrame, key: str, prompt: str, name: str, model: Callable[[], TextModel], cache: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(answers, new): answers (key, prompt, fp, answer, hit) with those of the cache (fp, answer) reused; each different prompt is asked once; new (fp, answer)
    are the rows to append to the cache, so that a rerun asks only for what is missing."""
    d = prompts.select(key, prompt, fingerprint(F.lit(name), F.col(prompt)).alias("fp"))
    known = cache.select("fp", "answer").dropDuplicates(["fp"])
    missing = d.dropDuplicates(["fp"]).join(known, "fp", "left_anti")
    new = ask(missing, "fp", prompt, model, **how).where("answer is not null").select("fp", "answer")
    both = known.withColumn("hit", F.lit(True)).unionByName(new.withColumn("hit", F.lit(False)))
    return d.join(both, "fp", "left").select(key, prompt, "fp", "answer", F.coalesce("hit", F.lit(False)).alias("hit")), new


def embedded(df: DataFrame, key: str, text: str, embedder: Callable[[], Embedder], size: int = 256, number: str = "float") -> DataFrame:
    """(key, embedding) of whole texts, as arrays of float or double; null and empty texts have vectors of zeros."""
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = embedder()
        for b in batches:
            for z in range(0, len(b), size):
                c = b.iloc[z : z + size]
                yield pd.DataFrame({"key": c["key"], "embedding": list(one.embed([t or "" for t in c["text"]]).astype(np.float32 if number == "float" else np.float64))})

    return d.mapInPandas(run, f"key {kind}, embedding array<{number}>").withColumnRenamed("key", key)


def judge_prompt(question: F.Column, answer: F.Column) -> F.Column:
    return F.concat(F.lit("QUESTION: "), question, F.lit("\nANSWER: "), F.coalesce(answer, F.lit("")))


VERDICTS = ("correct", "partial", "wrong")


def judged(answers: DataFrame, key: str, question: str, answer: str, judge: Callable[[], TextModel] = OverlapJudge) -> DataFrame:
    """(key, verdict, calls): by a judge whose answer has to be one of VERDICTS in a JSON object; what it cannot say after the second asking is `wrong`."""
    p = answers.select(key, judge_prompt(F.col(question), F.col(answer)).alias("prompt"))
    got = ask(p, key, "prompt", judge, enum_field("verdict", VERDICTS))
    return got.select(key, F.coalesce("answer", F.lit("wrong")).alias("verdict"), "calls")


def attribution(rows: DataFrame) -> DataFrame:
    """Adds `loss` to rows (positive, retrieved, refused, verdict): where a wrong end came from. Questions without a gold label have to be refused."""
    loss = (
        F.when(~F.col("positive"), F.when(F.col("refused"), "none").otherwise("answered a negative"))
        .when(F.col("verdict") == "correct", "none")
        .when(~F.col("retrieved"), "retrieval")
        .when(F.col("refused"), "false refusal")
        .otherwise("generation")
    )
    return rows.withColumn("loss", loss)


def percent(part: F.Column, whole: F.Column) -> F.Column:
    """One decimal; null where there is nothing to count."""
    return F.round(100.0 * F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0)), 1)


def gate(rows: DataFrame) -> DataFrame:
    """One row over rows (positive, retrieved, refused, verdict, loss): the end-to-end report."""
    pos, ref, ok = F.col("positive"), F.col("refused"), F.col("verdict") == "correct"
    lost = lambda x: F.count_if(F.col("loss") == x)
    return rows.agg(
        F.count("*").alias("questions"), F.count_if(pos).alias("positives"), percent(pos & ok & ~ref, pos).alias("correct_pct"), percent(pos & F.col("retrieved"), pos).alias("retrieved_pct"),
        percent(~pos & ref, ~pos).alias("correct_refusal_pct"), percent(pos & ref, pos).alias("false_refusal_pct"), lost("retrieval").alias("lost_in_retrieval"),
        lost("false refusal").alias("lost_in_refusal"), lost("generation").alias("lost_in_generation"), lost("answered a negative").alias("answered_negatives"),
    )
