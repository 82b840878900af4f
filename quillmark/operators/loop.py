"""A bounded loop of retrieving, grading, rewriting and refusing, as one lazy plan; models are columns or protocols given by the caller."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import small

#: An answer is a refusal only if it is exactly this.
REFUSAL = "I cannot answer this from the provided context."


def verdicts(score: Column, good: float = 0.6, fair: float = 0.3) -> Column:
    """The stand-in grader: by the share of the question's content terms in the text."""
    return F.when(score >= good, "correct").when(score >= fair, "ambiguous").otherwise("incorrect")


def set_verdicts(graded: DataFrame, qid: str, good: float = 0.8) -> DataFrame:
    """Grading of whole sets: all texts of a question are correct if any has at least `good` of it, else none is. graded: (qid, ..., overlap)."""
    any_ = F.max("overlap").over(Window.partitionBy(qid)) >= good
    return graded.withColumn("verdict", F.when(any_, "correct").otherwise("incorrect"))


def run_loop(questions: DataFrame, retrieve: Callable[[int], DataFrame], qid: str, max_steps: int = 2, answers: Callable[[int, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, steps, kept, refused, trace). `retrieve(step)` gives (qid, key, verdict) for every question as rewritten `step` times. Correct and ambiguous texts
    are kept; without any, the question is rewritten, at most max_steps times, then refused. A question with nothing retrieved goes the same way.

    With `answers`, a refused answer is retried too: `answers(step, kept)` gives (qid, answer) for the questions with kept texts, and one that equals REFUSAL sends its
    question on to be rewritten; after the last step it stays refused."""
    out = questions.select(qid)
    for step in range(max_steps + 1):
        texts = retrieve(step).where(F.col("verdict").isin("correct", "ambiguous"))
        kept = texts.groupBy(qid).agg(F.count("*").alias(f"kept{step}"))
        out = out.join(kept, qid, "left")
        if answers is not None:
            said = answers(step, texts).select(qid, (F.col("answer") == REFUSAL).alias(f"no{step}"))
            out = out.join(said, qid, "left")
    has = [F.col(f"kept{s}").isNotNull() for s in range(max_steps + 1)]
    no = [F.coalesce(f"no{s}", F.lit(False)) if answers is not None else F.lit(False) for s in range(max_steps + 1)]
    won = F.coalesce(*[F.when(has[s] & ~no[s], F.lit(s)) for s in range(max_steps + 1)])
    out = out.withColumn("won", won)
    steps = F.coalesce("won", F.lit(max_steps))
    kept = F.coalesce(*[F.when(F.col("won") == s, F.col(f"kept{s}")) for s in range(max_steps + 1)], F.lit(0))
    passes = [F.when(steps >= s, F.concat(F.lit(">refine>" if s else ""), F.lit("retrieve>grade"), F.when(has[s] & no[s], ">generate").otherwise(""))).otherwise("") for s in range(max_steps + 1)]
    return out.select(qid, steps.cast("bigint").alias("steps"), kept.cast("bigint").alias("kept"), F.col("won").isNull().alias("refused"), F.concat(*passes, F.when(F.col("won").isNull(), ">refuse").otherwise(">generate")).alias("trace"))


def priced(calls: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str, hit: Column) -> DataFrame:
    """Adds `usd`: the price with the longest prefix of the model's name (prefix, price_in, price_out a million tokens), the dearest for unknown models;
    cache hits are free. Models are matched once each, not once a call."""
    names = calls.select(model).distinct()
    dear = prices.agg(F.max(F.struct("price_in", "price_out")).alias("d"))
    match = names.join(small(prices, 10_000), F.col(model).startswith(F.col("prefix")), "left")
    best = match.groupBy(model).agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("p")).crossJoin(F.broadcast(dear))
    best = best.select(model, F.coalesce("p.price_in", "d.price_in").alias("pin"), F.coalesce("p.price_out", "d.price_out").alias("pout"))
    usd = F.when(hit, 0.0).otherwise((F.col(tokens_in) * F.col("pin") + F.col(tokens_out) * F.col("pout")) / 1e6)
    return calls.join(best, model).withColumn("usd", usd).drop("pin", "pout")


def within_budget(calls: DataFrame, order: str, cap: float, group: str) -> DataFrame:
    """Adds `allowed`: a call is made while what was spent before it in its group is under the cap."""
    before = F.coalesce(F.sum("usd").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return calls.withColumn("spent_before", F.round(before, 9)).withColumn("allowed", F.col("spent_before") < cap)


def work_left(prompts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct prompts without an answer in the cache: a rerun resumes."""
    return prompts.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
