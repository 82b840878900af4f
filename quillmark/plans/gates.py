"""Queries of models, judging and gates, subsets and their checks, expansion of golden sets, and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import golden, loop, models
from quillmark.plans import project as P
from quillmark.plans import retrieval as R
from quillmark.session import drop_at_exit, shared_dir, table, written
from quillmark.sources import json_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


sql, tok, content = R.sql, P.tok, P.content


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/f-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


# ---- models
def share_sql(part: str, whole: str) -> str:
    """Share of part's content words that whole has, 0 without any."""
    return f"(CASE WHEN len({content(part)}) > 0 THEN len(list_intersect({content(part)}, {tok(whole)})) / len({content(part)})::DOUBLE ELSE 0 END)"


def _prompts(c: R.Corpus, spark: SparkSession, sf: str, top: DataFrame) -> DataFrame:
    """(qid, query, prompt) of the three best documents of each question."""
    j = top.join(table(spark, sf, "documents").select("doc_id", "title", "text"), "doc_id").join(c.questions, "qid")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("text", 1, 4000))
    g = j.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("ctx"), F.first("query").alias("query"))
    return g.select("qid", "query", F.concat(F.lit("Context:\n"), "ctx", F.lit("\n\nQuestion: "), "query", F.lit("\nAnswer:")).alias("prompt"))


_ANSWERED = R.WINDOWS + R.BM25 + R.parent_rank("pb", "bm") + f"""
an AS (SELECT q.qid, q.query, CASE WHEN length(d.text) > 0 AND {share_sql("q.query", "left(d.text, 4000)")} >= 0.6 THEN left(left(d.text, 4000), 300) ELSE '{loop.REFUSAL}' END AS answer FROM pb JOIN documents d USING (doc_id) JOIN questions q ON q.qid = pb.qid WHERE pb.rank = 1),
"""


def _writer() -> models.FirstPassage:
    return models.FirstPassage(least=0.6)


def _answered(c: R.Corpus, spark: SparkSession, sf: str) -> DataFrame:
    """(qid, query, answer): retrieve, build the prompt, let the model write; the model is the offline stand-in."""
    p = _prompts(c, spark, sf, c.parents_by("bm25").where("rank <= 3"))
    return models.ask(p, "qid", "prompt", _writer).select("qid", "answer").join(c.questions, "qid")


@query(sql(_ANSWERED, f"SELECT qid, sha256(answer) AS answer_hash, length(answer) AS n, answer = '{loop.REFUSAL}' AS refused FROM an"))
def answer_generate(spark, sf):
    """Answers of every question by the writer; an answer is a refusal only if it is exactly the refusal string."""
    a = _answered(R.Corpus(spark, sf), spark, sf)
    return a.select("qid", F.sha2("answer", 256).alias("answer_hash"), F.length("answer").cast("bigint").alias("n"), (F.col("answer") == loop.REFUSAL).alias("refused"))


_VERDICT = lambda q, a, good="0.5", fair="0.2": f"CASE WHEN {share_sql(q, a)} >= {good} THEN 'correct' WHEN {share_sql(q, a)} >= {fair} THEN 'partial' ELSE 'wrong' END"
_JUDGED = _ANSWERED + R.GOLD + f"""
ju AS (SELECT qid, answer = '{loop.REFUSAL}' AS refused, {_VERDICT("query", "answer")} AS verdict, CASE WHEN length('QUESTION: ' || query || chr(10) || 'ANSWER: ' || answer) % 3 = 0 THEN 2 ELSE 1 END AS calls FROM an),
hi AS (SELECT DISTINCT g.qid FROM gold g JOIN pb ON pb.qid = g.qid AND pb.doc_id = g.doc_id WHERE pb.rank <= 5),
en AS (SELECT j.*, p.qid IS NOT NULL AS positive, h.qid IS NOT NULL AS retrieved FROM ju j LEFT JOIN (SELECT DISTINCT qid FROM gold) p ON p.qid = j.qid LEFT JOIN hi h ON h.qid = j.qid),
lo AS (SELECT *, CASE WHEN NOT positive THEN CASE WHEN refused THEN 'none' ELSE 'answered a negative' END WHEN verdict = 'correct' THEN 'none' WHEN NOT retrieved THEN 'retrieval' WHEN refused THEN 'false refusal' ELSE 'generation' END AS loss FROM en),
"""
_PCT = lambda a, b: f"round(100.0::DOUBLE * count(*) FILTER (WHERE {a}) / nullif(count(*) FILTER (WHERE {b}), 0), 1)"
_GATE = f"""SELECT count(*) AS questions, count(*) FILTER (WHERE positive) AS positives, {_PCT("positive AND verdict = 'correct' AND NOT refused", "positive")} AS correct_pct, {_PCT("positive AND retrieved", "positive")} AS retrieved_pct,
  {_PCT("NOT positive AND refused", "NOT positive")} AS correct_refusal_pct, {_PCT("positive AND refused", "positive")} AS false_refusal_pct, count(*) FILTER (WHERE loss = 'retrieval') AS lost_in_retrieval,
  count(*) FILTER (WHERE loss = 'false refusal') AS lost_in_refusal, count(*) FILTER (WHERE loss = 'generation') AS lost_in_generation, count(*) FILTER (WHERE loss = 'answered a negative') AS answered_negatives FROM lo"""


def _ended(c: R.Corpus, answers: DataFrame, top: DataFrame) -> DataFrame:
    """(qid, refused, verdict, calls, positive, retrieved, loss) of answers (qid, query, answer)."""
    gold = written(c.gold())
    hit = top.join(gold, ["qid", "doc_id"], "left_semi").select("qid").distinct()
    j = models.judged(answers, "qid", "query", "answer").join(answers.select("qid", (F.col("answer") == loop.REFUSAL).alias("refused")), "qid")
    j = j.join(gold.select("qid", F.lit(True).alias("positive")).distinct(), "qid", "left").join(hit.withColumn("retrieved", F.lit(True)), "qid", "left").na.fill(False)
    return models.attribution(j)


@query(sql(_JUDGED, "SELECT qid, verdict, calls::INTEGER AS calls, refused, positive, retrieved, loss FROM lo"))
def judge_rows(spark, sf):
    c = R.Corpus(spark, sf)
    top = written(c.parents_by("bm25").where("rank <= 5"))
    return _ended(c, written(_answered(c, spark, sf)), top).select("qid", "verdict", "calls", "refused", "positive", "retrieved", "loss")


@query(sql(_JUDGED, _GATE))
def judge_summary(spark, sf):
    """The end-to-end gate: quality, refusals and where questions were lost."""
    c = R.Corpus(spark, sf)
    top = written(c.parents_by("bm25").where("rank <= 5"))
    return models.gate(_ended(c, written(_answered(c, spark, sf)), top))


@query(sql(_JUDGED, f"SELECT l.verdict AS before, {_VERDICT('a.query', 'a.answer', '0.8', '0.4')} AS after, count(*) AS n FROM lo l JOIN an a USING (qid) GROUP BY 1, 2"))
def rejudge(spark, sf):
    """A saved run, read back from its files and joined with the questions, judged again by a stricter judge; answers are not written again."""
    c = R.Corpus(spark, sf)
    path = scratch(spark)
    a = written(_answered(c, spark, sf))
    json_files.write(models.judged(a, "qid", "query", "answer").join(a.select("qid", "answer"), "qid"), path)
    run = json_files.scan(spark, path, "qid bigint, verdict string, answer string").withColumnRenamed("verdict", "before")
    both = run.join(c.questions, "qid")
    again = models.judged(both, "qid", "query", "answer", lambda: models.OverlapJudge(0.8, 0.4)).select("qid", F.col("verdict").alias("after"))
    return both.select("qid", "before").join(again, "qid").groupBy("before", "after").agg(F.count("*").alias("n"))


@query(sql(_JUDGED, "SELECT qid, why FROM (SELECT qid, CASE WHEN positive AND loss != 'none' THEN 'cause' WHEN NOT positive THEN 'negative' WHEN row_number() OVER (PARTITION BY positive, loss = 'none' ORDER BY sha256('b0|' || qid)) <= 10 THEN 'control' END AS why FROM lo) WHERE why IS NOT NULL"))
def slice_losses(spark, sf):
    """A slice from a baseline run: the questions it lost, all negatives, and ten others as controls."""
    c = R.Corpus(spark, sf)
    top = written(c.parents_by("bm25").where("rank <= 5"))
    base = _ended(c, written(_answered(c, spark, sf)), top).select("qid", "positive", "loss")
    j = c.questions.select("qid").join(base, "qid", "left")
    rn = F.row_number().over(Window.partitionBy("positive", F.col("loss") == "none").orderBy(golden.hash_order("b0", "qid")))
    why = F.when(F.col("positive") & (F.col("loss") != "none"), "cause").when(~F.col("positive"), "negative").when(rn <= 10, "control")
    return j.withColumn("why", why).where("why is not null").select("qid", "why")


@query("SELECT doc_id, b AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 5) AS weight FROM (SELECT doc_id, ('0x' || left(sha256(w), 4))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(" + tok("text") + ") AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2)")
def embed_documents(spark, sf):
    """Vectors by the offline embedder, as (doc_id, bucket, weight)."""
    e = models.embedded(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", models.HashedWords, number="double")
    v = e.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0")
    return v.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 5).alias("weight"))


@query("SELECT count(*) AS asked, count(DISTINCT query) AS different, count(*) FILTER (WHERE cached) AS hits, count(DISTINCT query) FILTER (WHERE NOT cached) AS new_rows FROM (SELECT qa.query, s.q IS NOT NULL AS cached FROM qa LEFT JOIN (SELECT DISTINCT query AS q FROM qa_slice_bm25) s ON s.q = qa.query WHERE qa.query IS NOT NULL)")
def cached_answers(spark, sf):
    """Prompts against a cache table: what it has is reused, each different rest is asked once."""
    name, c = "first-passage", table(spark, sf, "qa_slice_bm25").where("query is not null")
    cache = c.select(T.fingerprint(F.lit(name), F.col("query")).alias("fp"), F.lit("kept").alias("answer")).distinct()
    got, new = models.ask_cached(table(spark, sf, "qa").where("query is not null").select("id", "query"), "id", "query", name, models.FirstPassage, cache)
    counts = got.agg(F.count("*").alias("asked"), F.count_distinct("query").alias("different"), F.count_if("hit").alias("hits"))
    return counts.crossJoin(new.agg(F.count("*").alias("new_rows")))  # single rows


_TEMPLATES = {
    "factual": "Write one question that the passage answers.\nTitle: {title}\nPassage:\n{text}\nReply as JSON with question and answer.",
    "near_miss": "Write one question on the matter of the passage that the passage does not answer.\nTitle: {title}\nPassage:\n{text}\nReply as JSON with question.",
    "blurb": "Say in one sentence what the passage is about and where it is from.\nSource: {source}\nTitle: {title}\nPassage:\n{text}",
}
_BUDGET = {"factual": 3000, "near_miss": 3500, "blurb": 3500}


def _filled(template: str, most: int) -> F.Column:
    parts = {"title": F.coalesce("title", F.lit("")), "source": F.coalesce("source", F.lit("")), "text": F.substring("text", 1, most)}
    out = F.lit(template)
    for k in ("title", "source", "text"):
        out = F.replace(out, F.lit("{%s}" % k), parts[k])
    return out


def _filled_sql(name: str) -> str:
    t = "'" + _TEMPLATES[name].replace("\n", "' || chr(10) || '") + "'"
    for k, v in (("title", "coalesce(title, '')"), ("source", "coalesce(source, '')"), ("text", f"left(text, {_BUDGET[name]})")):
        t = f"replace({t}, '{{{k}}}', {v})"
    return t


@query(sql(P.SECTIONS, " UNION ALL ".join(f"SELECT parent_id, '{k}' AS template, sha256({_filled_sql(k)}) AS prompt_hash FROM sec WHERE text IS NOT NULL" for k in _TEMPLATES)))
def prompt_templates(spark, sf):
    s = P.sections(spark, sf).where("text is not null")
    out = None
    for name, t in _TEMPLATES.items():
        one = s.select("parent_id", F.lit(name).alias("template"), F.sha2(_filled(t, _BUDGET[name]), 256).alias("prompt_hash"))
        out = one if out is None else out.unionByName(one)
    return out


_REWORD, _NEGATIVE = "Say the question in other words and keep its meaning.\nQuestion: ", "Write one question that none of these sections answers.\nTitles: "
_LINE = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"


@query(sql(P.QA, f"SELECT id, sha256({_LINE(_REWORD)} || query) AS prompt_hash FROM q WHERE type = 'factual' AND query IS NOT NULL"))
def prompt_paraphrases(spark, sf):
    """The prompts that reword the factual questions."""
    return P.questions(spark, sf).where("type = 'factual' and query is not null").select("id", F.sha2(F.concat(F.lit(_REWORD), "query"), 256).alias("prompt_hash"))


@query(f"SELECT parent_id, sha256({_LINE(_NEGATIVE)} || titles) AS prompt_hash FROM ({P.SQL['title_window']})")
def prompt_negatives(spark, sf):
    """The prompts for negatives: a section's title and the eleven after it."""
    return P.QUERIES["title_window"](spark, sf).select("parent_id", F.sha2(F.concat(F.lit(_NEGATIVE), "titles"), 256).alias("prompt_hash"))


# ---- loop: sets, retries, hits in any pass
_SETS = P._loop_sql() + "ss AS (SELECT qid, max(o) >= 0.8 AS good, count(*) AS n FROM gr0 GROUP BY 1),"


@query(sql(_SETS, "SELECT qid, CASE WHEN good THEN n ELSE 0 END AS kept FROM ss"))
def loop_set_grade(spark, sf):
    """Grading of whole sets, all or nothing."""
    g = loop.set_verdicts(P._graded(R.Corpus(spark, sf), 0), "qid")
    return g.groupBy("qid").agg(F.count_if(F.col("verdict") == "correct").alias("kept"))


def _retry_sql() -> str:
    """A question goes on while its kept texts have less than 0.7 of it, which the writer refuses."""
    steps = range(P.STEPS + 1)
    out = P._loop_sql()
    for s in steps:
        out += f"kr{s} AS (SELECT qid, count(*) AS kept, max(o) >= 0.7 AS said FROM gr{s} WHERE o >= 0.5 GROUP BY 1),"
    won = "CASE " + " ".join(f"WHEN coalesce(k{s}.said, false) THEN {s}" for s in steps) + " END"
    kept = "CASE " + " ".join(f"WHEN coalesce(k{s}.said, false) THEN k{s}.kept" for s in steps) + " ELSE 0 END"
    marks = ", ".join(f"k{s}.qid IS NOT NULL AND NOT k{s}.said AS no{s}" for s in steps)
    trace = " || ".join(f"CASE WHEN coalesce(won, {P.STEPS}) >= {s} THEN '{'>refine>' if s else ''}retrieve>grade' || CASE WHEN no{s} THEN '>generate' ELSE '' END ELSE '' END" for s in steps)
    joins = " ".join(f"LEFT JOIN kr{s} k{s} ON k{s}.qid = q.qid" for s in steps)
    out += f"rw AS (SELECT q.qid, {won} AS won, {kept} AS kept, {marks} FROM questions q {joins}),"
    return out + f"rt AS (SELECT qid, coalesce(won, {P.STEPS})::BIGINT AS steps, kept::BIGINT AS kept, won IS NULL AS refused, {trace} || CASE WHEN won IS NULL THEN '>refuse' ELSE '>generate' END AS trace FROM rw),"


@query(sql(_retry_sql(), "SELECT * FROM rt"))
def loop_retry(spark, sf):
    """The loop with retry on refusal: kept texts the writer refuses send the question on to be rewritten."""
    c = R.Corpus(spark, sf)

    def answers(step: int, kept: DataFrame) -> DataFrame:
        return kept.groupBy("qid").agg(F.when(F.max("overlap") >= 0.7, "answer").otherwise(loop.REFUSAL).alias("answer"))

    return loop.run_loop(c.questions, lambda s: written(P._graded(c, s)), "qid", P.STEPS, answers)


_ANY = P._loop_sql() + R.GOLD + "hp AS (" + " UNION ALL ".join(f"SELECT qid, doc_id, {s} AS step FROM lp{s} WHERE rank <= 5" for s in range(P.STEPS + 1)) + "),"


@query(sql(_ANY, "SELECT g.qid, count(h.step) > 0 AS hit, min(h.step)::INTEGER AS first_step FROM gold g LEFT JOIN hp h ON h.qid = g.qid AND h.doc_id = g.doc_id GROUP BY 1"))
def hit_any_pass(spark, sf):
    """Whether a labelled document was among the first five of any pass, and of which first."""
    c = R.Corpus(spark, sf)
    passes = None
    for s in range(P.STEPS + 1):
        one = P._graded(c, s).select("qid", "doc_id", F.lit(s).alias("step"))
        passes = one if passes is None else passes.unionByName(one)
    j = c.gold().join(passes, ["qid", "doc_id"], "left")
    return j.groupBy("qid").agg((F.count("step") > 0).alias("hit"), F.min("step").alias("first_step"))


# ---- rankers by name
RANKERS = {
    "bm25": lambda c: c.parents_by("bm25"),
    "tfidf": lambda c: c.parents_by("tfidf"),
    "okapi": lambda c: c.parents_by("okapi"),
    "hybrid": lambda c: c.hybrid(),
}
_RANKERS_SQL = R.WINDOWS + R.BM25 + R.TFIDF + R.OKAPI + R.GOLD + R.HYBRID + R.parent_rank("po", "ok")


@query(sql(_RANKERS_SQL, "SELECT name, count(*) AS labels, count(*) FILTER (WHERE rank <= 5) AS in_five, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mean_reciprocal FROM gold g JOIN (" + " UNION ALL ".join(f"SELECT '{n}' AS name, g.qid, g.doc_id, r.rank FROM gold g LEFT JOIN {t} r ON r.qid = g.qid AND r.doc_id = g.doc_id" for n, t in (("bm25", "pb"), ("tfidf", "pt"), ("okapi", "po"), ("hybrid", "hy"))) + ") x ON x.qid = g.qid AND x.doc_id = g.doc_id GROUP BY 1"))
def ranker_report(spark, sf):
    """Every registered ranker on the same labels."""
    c = R.Corpus(spark, sf)
    gold = written(c.gold())
    out = None
    for name, rank in RANKERS.items():
        one = gold.join(rank(c).select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left").withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name").agg(F.count("*").alias("labels"), F.count_if(F.col("rank") <= 5).alias("in_five"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mean_reciprocal"))


@query(R.SQL["rerank_head_tail"].replace("WHERE rank <= 50", "WHERE rank <= 3"))
def rerank_cut(spark, sf):
    """What is served: the three best parents after reranking."""
    return R.QUERIES["rerank_head_tail"](spark, sf).where("rank <= 3")
