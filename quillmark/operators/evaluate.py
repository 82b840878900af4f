"""Scoring rankings against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import written

KS = (1, 3, 5, 20, 50)


def evaluate(ranking: DataFrame, gold: DataFrame, questions: DataFrame, qid: str, key: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """(qid, kind, top1_score, mrr, k, recall, hit), long form. gold: (qid, key); questions: (qid, kind). Questions without gold have null metrics; those
    without a ranking have metrics of 0 and no score."""
    # of the rankings only the labelled rows and the first ones are needed: one pass
    marked = ranking.select(qid, key, "rank", "score").join(gold.select(qid, key, F.lit(True).alias("labelled")), [qid, key], "left")
    ranking = written(marked.where("labelled or rank = 1"))
    got = gold.join(ranking.select(qid, key, "rank"), [qid, key], "left")
    kset = F.array(*[F.lit(k) for k in sorted(set(ks) | {20, 50})])
    per = got.groupBy(qid).agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.collect_list("rank").alias("ranks"))
    top = ranking.where("rank = 1").select(qid, F.col("score").alias("top1_score"))
    rows = questions.join(per, qid, "left").join(top, qid, "left").withColumn("k", F.explode(kset))
    hits = F.size(F.filter("ranks", lambda r: r <= F.col("k")))
    has = F.col("n").isNotNull()
    return rows.select(
        qid, "kind", "top1_score", F.when(has, F.coalesce(F.round(1.0 / F.col("first"), 10), F.lit(0.0))).alias("mrr"), F.col("k").cast("bigint").alias("k"),
        F.when(has, F.round(hits / F.col("n"), 10)).alias("recall"), F.when(has, (hits > 0).cast("double")).alias("hit"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """(grp, k, n, recall, hit, mrr): means over questions with gold, of all and of each kind."""
    pos = rows.where("recall is not null")
    agg = [F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr")]
    return pos.groupingSets([["k"], ["kind", "k"]], "kind", "k").agg(*agg).select(F.coalesce("kind", F.lit("ALL_POSITIVE")).alias("grp"), "k", *["n", "recall", "hit", "mrr"])


def negative_gap(rows: DataFrame) -> DataFrame:
    """One row: mean top score of questions with and without gold, and their distance."""
    r = rows.where("k = 1")
    pos, neg = F.avg(F.when(F.col("recall").isNotNull(), F.col("top1_score"))), F.avg(F.when(F.col("recall").isNull(), F.col("top1_score")))
    return r.agg(F.round(pos, 6).alias("positive"), F.round(neg, 6).alias("negative"), F.round(pos - neg, 6).alias("gap"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two summaries side by side."""
    x = a.select("grp", "k", F.col("recall").alias("control"), F.col("mrr").alias("control_mrr"))
    y = b.select("grp", "k", F.col("recall").alias("treatment"), F.col("mrr").alias("treatment_mrr"))
    return x.join(y, ["grp", "k"], "full_outer").withColumn("recall_change", F.round(F.col("treatment") - F.col("control"), 6)).withColumn("mrr_change", F.round(F.col("treatment_mrr") - F.col("control_mrr"), 6))
