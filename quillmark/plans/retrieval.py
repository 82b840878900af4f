"""Retrieval over documents: windows as children, documents as parents, the held-out passages as questions; a document that shares a run of twelve tokens
with a passage is relevant to it, and passages without such a document are the negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking, evaluate, fuse, index, retrieve
from quillmark.operators.scoring import Index, hashed
from quillmark.session import spread, table, written

RUN = 12


class Corpus:
    """The tables that the queries of this module share; the forward index of the windows is built once, when first asked for."""

    def __init__(self, spark: SparkSession, sf: str):
        docs = spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"))
        self.parents = docs
        self.children = chunking.word_windows(docs, "doc_id", "text", 120, 20, 15, True).withColumn("child_id", F.concat_ws("#", "doc_id", "chunk_no"))
        self.questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")).distinct()
        self.terms_of = index.query_terms(self.questions, "qid", "query")
        self._built: Index | None = None

    @property
    def forward(self) -> Index:
        if self._built is None:
            self._built = Index.build(self.children, "child_id", "doc_id", "chunk")
        return self._built

    def content_terms(self) -> DataFrame:
        """(qid, term, qtf): the questions' distinct content terms."""
        return self.questions.select("qid", F.explode(T.content_terms(F.col("query"))).alias("term"), F.lit(1).alias("qtf"))

    def children_by(self, mode: str, most: int | None = None, terms: DataFrame | None = None) -> DataFrame:
        return self.forward.scores(self.terms_of if terms is None else terms, mode, "key", most).withColumnRenamed("key", "child_id")

    def parents_by(self, mode: str, terms: DataFrame | None = None, ix: Index | None = None) -> DataFrame:
        """The whole ranking of parents, each by its best child."""
        s = (ix or self.forward).scores(self.terms_of if terms is None else terms, mode, "parent").withColumnRenamed("parent", "doc_id")
        return retrieve.ranked(s, "qid", [F.desc("score"), F.col("doc_id")])

    def index(self, text: str = "chunk", df: DataFrame | None = None, key: str = "child_id"):
        d = self.children if df is None else df
        post = index.postings(d, key, text)
        return post, index.term_stats(post), index.corpus_stats(d, text)

    def gold(self) -> DataFrame:
        def runs(df: DataFrame, key: str, text: str) -> DataFrame:
            t = df.select(key, T.tokens(F.col(text)).alias("w")).where(F.size("w") >= RUN)
            hashes = F.transform(F.sequence(F.lit(1), F.size("w") - RUN + 1), lambda i: F.xxhash64(F.slice("w", i, RUN)))
            return t.select(key, F.explode(F.array_distinct(hashes)).alias("g")).distinct()

        q = runs(self.questions, "qid", "query")
        return runs(self.parents, "doc_id", "text").join(q, "g").select("qid", "doc_id").distinct()

    def kinds(self) -> DataFrame:
        return self.questions.select("qid", F.when(F.length("query") < 200, "short").otherwise("long").alias("kind"))

    def hybrid(self) -> DataFrame:
        return self.fused(self.forward)

    def fused(self, ix: Index) -> DataFrame:
        """Both rankings of the parents from one pass over an index, fused by rank."""
        s = ix.scores(self.terms_of, ("tfidf", "bm25"), "parent").withColumnRenamed("parent", "doc_id")
        both = fuse.reciprocal_columns(s, "qid", "doc_id", "tfidf", "bm25", fill=True)
        return retrieve.ranked(both, "qid", [F.desc("score"), F.col("doc_id")])


def child_order(scores: DataFrame, most: int | None = None) -> DataFrame:
    return retrieve.ranked(scores, "qid", [F.desc("score"), F.col("child_id")], most=most)


# SQL of the same steps
WINDOWS = f"""
src AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{T.WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS st FROM src WHERE len(w) > 0),
children AS (SELECT doc_id, st // 100 AS chunk_no, doc_id || '#' || (st // 100) AS child_id, array_to_string(w[st + 1 : st + 120], ' ') AS chunk
  FROM win WHERE st = 0 OR len(w[st + 1 : st + 120]) >= 15),
questions AS (SELECT DISTINCT item_id AS qid, text AS query FROM benchmark),
tok AS (SELECT child_id, doc_id, regexp_extract_all(lower(chunk), '[a-z0-9]+') AS t FROM children),
post AS (SELECT child_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT child_id, unnest(t) AS term, len(t) AS dl FROM tok) GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM questions) GROUP BY 1, 2),
"""
BM25 = """
bm AS (SELECT qid, child_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term), stats GROUP BY 1, 2),
"""
TFIDF = """
idf AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM terms, stats),
wt AS (SELECT child_id, term, tf / dl::DOUBLE * idf AS w FROM post JOIN idf USING (term)),
nm AS (SELECT child_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1),
qw AS (SELECT qid, term, qtf * idf AS qw FROM qt JOIN idf USING (term)),
qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
ti AS (SELECT qid, child_id, round(sum(w * qw) / (any_value(norm) * any_value(qnorm)), 6) AS score FROM wt JOIN qw USING (term) JOIN nm USING (child_id) JOIN qn USING (qid) GROUP BY 1, 2),
"""


def parent_rank(name: str, source: str) -> str:
    return f"""
{name} AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qid, CAST(split_part(child_id, '#', 1) AS BIGINT) AS doc_id, max(score) AS score FROM {source} GROUP BY 1, 2)),
"""


GOLD = """
gq AS (SELECT DISTINCT qid, list_slice(w, i, i + 11) AS g FROM (SELECT qid, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT qid, regexp_extract_all(lower(query), '[a-z0-9]+') AS w FROM questions) WHERE len(w) >= 12)),
gd AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 11) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 12)),
gold AS (SELECT DISTINCT qid, doc_id FROM gq JOIN gd USING (g)),
"""
HYBRID = parent_rank("pt", "ti") + parent_rank("pb", "bm") + """
mt AS (SELECT qid, max(rank) AS nt FROM pt GROUP BY 1), mb AS (SELECT qid, max(rank) AS nb FROM pb GROUP BY 1),
hy0 AS (SELECT coalesce(pt.qid, pb.qid) AS qid, coalesce(pt.doc_id, pb.doc_id) AS doc_id, pt.rank AS rt, pb.rank AS rb FROM pt FULL JOIN pb ON pt.qid = pb.qid AND pt.doc_id = pb.doc_id),
hy1 AS (SELECT qid, doc_id, round(1.0::DOUBLE / (60 + coalesce(rt, coalesce(nt, 0) + 1)) + 1.0::DOUBLE / (60 + coalesce(rb, coalesce(nb, 0) + 1)), 10) AS score FROM hy0 LEFT JOIN mt USING (qid) LEFT JOIN mb USING (qid)),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hy1),
"""


def evaluated(name: str, ranking: str) -> str:
    return f"""
{name}_per AS (SELECT qid, min(rank) AS first, count(*) AS n, list(rank) AS ranks FROM gold LEFT JOIN {ranking} USING (qid, doc_id) GROUP BY 1),
{name} AS (SELECT q.qid, CASE WHEN length(query) < 200 THEN 'short' ELSE 'long' END AS kind, t.score AS top1_score,
  CASE WHEN n IS NOT NULL THEN coalesce(round(1.0::DOUBLE / first, 10), 0) END AS mrr, k,
  CASE WHEN n IS NOT NULL THEN round(len(list_filter(ranks, lambda r: r <= k)) / n::DOUBLE, 10) END AS recall,
  CASE WHEN n IS NOT NULL THEN CAST(len(list_filter(ranks, lambda r: r <= k)) > 0 AS DOUBLE) END AS hit
  FROM questions q CROSS JOIN (SELECT unnest([1, 3, 5, 20, 50])::BIGINT AS k) LEFT JOIN {name}_per p ON p.qid = q.qid LEFT JOIN {ranking} t ON t.qid = q.qid AND t.rank = 1),
"""


def summarised(name: str, rows: str) -> str:
    return f"""
{name} AS (SELECT coalesce(kind, 'ALL_POSITIVE') AS grp, k, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr
  FROM {rows} WHERE recall IS NOT NULL GROUP BY GROUPING SETS ((k), (kind, k))),
"""


def sql(ctes: str, last: str) -> str:
    return "WITH " + ctes.strip().rstrip(",") + "\n" + last


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


@query(f"SELECT doc_id, st // 160 AS chunk_no, len(w[st + 1 : st + 200]) AS n_words, array_to_string(w[st + 1 : st + 200], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 160)) AS st FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{T.WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0) WHERE len(w[st + 1 : st + 200]) >= 20")
def chunk_words_200_40(spark, sf):
    return chunking.word_windows(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", 200, 40, 20, False)


@query(sql(WINDOWS, f"SELECT doc_id, chunk_no, len(list_filter(regexp_split_to_array(chunk, '{T.WS}+'), lambda x: x <> '')) AS n_words, chunk FROM children"))
def chunk_words_120_20(spark, sf):
    return Corpus(spark, sf).children.select("doc_id", "chunk_no", "n_words", "chunk")


@query(sql(WINDOWS, "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS parents, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT doc_id, len(string_split(chunk, ' ')) AS n FROM children)"))
def chunk_report(spark, sf):
    c = Corpus(spark, sf).children
    return c.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("parents"), F.min("n_words").alias("least"), F.max("n_words").alias("most"), F.round(F.avg("n_words"), 6).alias("mean"))


@query(sql(WINDOWS, "SELECT least(n // 30 * 30, 120)::BIGINT AS bin, count(*) AS chunks FROM (SELECT len(string_split(chunk, ' ')) AS n FROM children) GROUP BY 1"))
def chunk_histogram(spark, sf):
    return Corpus(spark, sf).children.groupBy(F.least(F.floor(F.col("n_words") / 30) * 30, F.lit(120)).cast("bigint").alias("bin")).agg(F.count("*").alias("chunks"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS n_terms FROM documents WHERE text IS NOT NULL")
def tokenize_terms(spark, sf):
    t = table(spark, sf, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"))


@query(sql(WINDOWS, "SELECT child_id, term, tf, dl::BIGINT AS dl FROM post"))
def term_freq(spark, sf):
    return Corpus(spark, sf).index()[0]


@query(sql(WINDOWS, "SELECT term, df FROM terms"))
def doc_freq(spark, sf):
    return Corpus(spark, sf).index()[1]


@query(sql(WINDOWS, "SELECT n, round(avgdl, 6) AS avgdl FROM stats"))
def corpus_stats(spark, sf):
    return Corpus(spark, sf).index()[2].select("n", F.round("avgdl", 6).alias("avgdl"))


@query(sql(WINDOWS, "SELECT term, row_number() OVER (ORDER BY term) AS term_no FROM terms"))
def vocab(spark, sf):
    """Terms numbered in order: range-partitioned and numbered within, with the ranges' offsets added, so that no task holds all of them."""
    terms = Corpus(spark, sf).index()[1].select("term", F.substring("term", 1, 2).alias("head"))
    from pyspark.sql import Window

    inside = terms.withColumn("i", F.row_number().over(Window.partitionBy("head").orderBy("term")))
    heads = terms.groupBy("head").agg(F.count("*").alias("n"))  # at most 36 + 36^2 rows
    offs = heads.withColumn("off", F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(F.broadcast(offs), "head").select("term", (F.col("i") + F.coalesce("off", F.lit(0))).alias("term_no"))


@query(sql(WINDOWS + TFIDF, "SELECT qid, child_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM ti) WHERE rank <= 3"))
def tfidf_topk(spark, sf):
    return child_order(Corpus(spark, sf).children_by("tfidf", 3), 3)


@query(sql(WINDOWS + BM25, "SELECT qid, child_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM bm) WHERE rank <= 50"))
def bm25_child_topk(spark, sf):
    return child_order(Corpus(spark, sf).children_by("bm25", 50), 50)


@query(sql(WINDOWS + BM25 + parent_rank("pb", "bm"), "SELECT qid, doc_id, score, rank FROM pb WHERE rank <= 50"))
def bm25_parent_rank(spark, sf):
    return Corpus(spark, sf).parents_by("bm25").where("rank <= 50")


OKAPI = """
raw AS (SELECT term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM terms, stats),
oi AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
ok AS (SELECT qid, child_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN oi USING (term) JOIN post USING (term), stats GROUP BY 1, 2),
"""


@query(sql(WINDOWS + OKAPI, "SELECT qid, child_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM ok) WHERE rank <= 50"))
def bm25_okapi_variant(spark, sf):
    return child_order(Corpus(spark, sf).children_by("okapi", 50), 50)


@query(sql(WINDOWS + BM25 + parent_rank("pb", "bm"), "SELECT q.qid, d.doc_id, coalesce(pb.score, 0) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(pb.score, 0) DESC, d.doc_id) AS rank FROM questions q CROSS JOIN (SELECT DISTINCT doc_id FROM children) d LEFT JOIN pb ON pb.qid = q.qid AND pb.doc_id = d.doc_id"))
def bm25_zero_fill_full_rank(spark, sf):
    c = Corpus(spark, sf)
    return retrieve.zero_filled(c.parents_by("bm25").drop("rank"), "qid", "doc_id", c.questions, c.forward.rows.select(F.col("parent").alias("doc_id")).distinct())


@query(sql(WINDOWS, "SELECT qid, child_id FROM (SELECT qid, child_id, count(*) AS met FROM qt JOIN post USING (term) GROUP BY 1, 2) JOIN (SELECT qid, count(*) AS need FROM qt GROUP BY 1) USING (qid) WHERE met = need"))
def fts_plain_and(spark, sf):
    c = Corpus(spark, sf)
    return c.children_by("all").select("qid", "child_id")


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
FTS = f"""
ct AS (SELECT qid, unnest(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: NOT list_contains({STOP}, x)))) AS term FROM questions),
ft AS (SELECT qid, child_id, round(sum(tf) * 0.1::DOUBLE, 6) AS score FROM ct JOIN post USING (term) GROUP BY 1, 2),
"""


@query(sql(WINDOWS + FTS, "SELECT qid, child_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM ft) WHERE rank <= 20"))
def fts_or_rank(spark, sf):
    c = Corpus(spark, sf)
    return child_order(c.children_by("any", 20, c.content_terms()), 20)


@query("SELECT item_id AS qid, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' | ') AS or_query FROM (SELECT DISTINCT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains(" + STOP + ", x)) AS x FROM benchmark)")
def or_query_text(spark, sf):
    return Corpus(spark, sf).questions.select("qid", F.array_join(T.content_terms(F.col("query")), " | ").alias("or_query"))


@query(sql(WINDOWS + BM25 + TFIDF + HYBRID, "SELECT qid, doc_id, score, rank FROM hy WHERE rank <= 50"))
def rrf_parent(spark, sf):
    return Corpus(spark, sf).hybrid().where("rank <= 50")


CHILD_RRF = """
ct1 AS (SELECT qid, child_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM ti),
cb1 AS (SELECT qid, child_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM bm),
cr AS (SELECT qid, child_id, round(sum(s), 10) AS score FROM (SELECT qid, child_id, 1.0::DOUBLE / (60 + rank) AS s FROM ct1 UNION ALL SELECT qid, child_id, 1.0::DOUBLE / (60 + rank) FROM cb1) GROUP BY 1, 2),
"""


def _child_rrf(c: Corpus) -> DataFrame:
    s = c.forward.scores(c.terms_of, ("tfidf", "bm25")).withColumnRenamed("key", "child_id")
    return fuse.reciprocal_columns(s, "qid", "child_id", "tfidf", "bm25")


@query(sql(WINDOWS + BM25 + TFIDF + CHILD_RRF, "SELECT qid, child_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM cr) WHERE rank <= 20"))
def rrf_child(spark, sf):
    return child_order(_child_rrf(Corpus(spark, sf)), 20)


WEIGHTED = """
wc AS (SELECT qid, child_id, round(sum(s), 10) AS score FROM (SELECT qid, child_id, 0.7::DOUBLE / (60 + rank) AS s FROM ct1 WHERE rank <= 200 UNION ALL SELECT qid, child_id, 0.3::DOUBLE / (60 + rank) FROM cb1 WHERE rank <= 200) GROUP BY 1, 2),
wr AS (SELECT qid, child_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM wc),
"""


def _weighted(c: Corpus) -> DataFrame:
    both = fuse.reciprocal(child_order(c.children_by("tfidf", 200), 200), child_order(c.children_by("bm25", 200), 200), "qid", "child_id", wa=0.7, wb=0.3)
    first = fuse.first_seen(child_order(both), "qid", F.substring_index("child_id", "#", 1).cast("bigint"), "doc_id")
    return retrieve.ranked(first, "qid", [F.col("best_rank"), F.col("doc_id")]).select("qid", "doc_id", "best_rank", "score", "rank")


@query(sql(WINDOWS + BM25 + TFIDF + CHILD_RRF + WEIGHTED, "SELECT qid, doc_id, best_rank, round(1.0::DOUBLE / best_rank, 10) AS score, row_number() OVER (PARTITION BY qid ORDER BY best_rank, doc_id) AS rank FROM (SELECT qid, CAST(split_part(child_id, '#', 1) AS BIGINT) AS doc_id, min(rank) AS best_rank FROM wr GROUP BY 1, 2)"))
def rrf_weighted_70_30(spark, sf):
    return _weighted(Corpus(spark, sf))


# reranking with the overlap of content terms as the scorer
RERANK = """
h AS (SELECT qid, child_id FROM ct1 WHERE rank <= 20),
hs AS (SELECT h.qid, CAST(split_part(h.child_id, '#', 1) AS BIGINT) AS doc_id, max(round(coalesce(m.met, 0) / greatest(1, nq)::DOUBLE, 6)) AS score
  FROM h LEFT JOIN (SELECT qid, child_id, count(*) AS met FROM ct JOIN post USING (term) GROUP BY 1, 2) m ON m.qid = h.qid AND m.child_id = h.child_id
  LEFT JOIN (SELECT qid, count(*) AS nq FROM ct GROUP BY 1) n ON n.qid = h.qid GROUP BY 1, 2),
"""


def _tail(order: str) -> str:
    return f"""
ht0 AS (SELECT qid, doc_id, score, 0 AS seg, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS pos FROM hs
  UNION ALL SELECT o.qid, o.doc_id, 0, 1, o.rank FROM {order} o ANTI JOIN hs ON hs.qid = o.qid AND hs.doc_id = o.doc_id),
ht AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY seg, pos) AS rank FROM ht0),
"""


def _rescored(c: Corpus, head: DataFrame) -> DataFrame:
    """Parents of the head's children by the share of the question's content terms that the child holds."""
    wanted = c.questions.select("qid", hashed(T.content_terms(F.col("query"))).alias("q"))
    s = head.select("qid", "child_id").join(wanted, "qid").join(c.forward.rows.select(F.col("key").alias("child_id"), "terms"), "child_id")
    s = s.withColumn("score", F.round(F.size(F.array_intersect("q", "terms")) / F.greatest(F.lit(1), F.size("q")), 6))
    return written(retrieve.best_child(s, "qid", F.substring_index("child_id", "#", 1).cast("bigint"), "doc_id"))  # a head is short


@query(sql(WINDOWS + TFIDF + FTS + parent_rank("pt", "ti") + "ct1 AS (SELECT qid, child_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM ti)," + RERANK + _tail("pt"), "SELECT qid, doc_id, score, rank FROM ht WHERE rank <= 50"))
def rerank_head_tail(spark, sf):
    c = Corpus(spark, sf)
    return fuse.head_tail(c.parents_by("tfidf"), _rescored(c, child_order(c.children_by("tfidf", 20), 20)), "qid", "doc_id").where("rank <= 50")


@query(sql(WINDOWS + BM25 + TFIDF + FTS + HYBRID + CHILD_RRF.replace("ct1", "cx1") + "ct1 AS (SELECT qid, child_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM cr)," + RERANK + _tail("hy"), "SELECT qid, doc_id, score, rank FROM ht WHERE rank <= 50"))
def hybrid_rerank(spark, sf):
    c = Corpus(spark, sf)
    return fuse.head_tail(c.hybrid(), _rescored(c, child_order(_child_rrf(c), 20)), "qid", "doc_id").where("rank <= 50")


@query(sql(WINDOWS + TFIDF + FTS + GOLD + parent_rank("pt", "ti") + "ct1 AS (SELECT qid, child_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM ti)," + RERANK + _tail("pt"), "SELECT g.qid, g.doc_id, coalesce(pt.rank, -1) AS before, coalesce(ht.rank, -1) AS after FROM gold g LEFT JOIN pt ON pt.qid = g.qid AND pt.doc_id = g.doc_id LEFT JOIN ht ON ht.qid = g.qid AND ht.doc_id = g.doc_id"))
def rerank_demotions(spark, sf):
    c = Corpus(spark, sf)
    old = written(c.parents_by("tfidf"))
    new = fuse.head_tail(old, _rescored(c, child_order(c.children_by("tfidf", 20), 20)), "qid", "doc_id")
    g = c.gold().join(old.select("qid", "doc_id", F.col("rank").alias("before")), ["qid", "doc_id"], "left").join(new.select("qid", "doc_id", F.col("rank").alias("after")), ["qid", "doc_id"], "left")
    return g.na.fill({"before": -1, "after": -1})


@query(sql(WINDOWS + TFIDF, "SELECT qid, doc_id, best_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_rank) AS rank FROM (SELECT qid, CAST(split_part(child_id, '#', 1) AS BIGINT) AS doc_id, min(rank) AS best_rank FROM (SELECT qid, child_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM ti) WHERE rank <= 8 GROUP BY 1, 2)) WHERE rank <= 3"))
def top8_children_top3_parents(spark, sf):
    first = fuse.first_seen(child_order(Corpus(spark, sf).children_by("tfidf", 8), 8), "qid", F.substring_index("child_id", "#", 1).cast("bigint"), "doc_id").drop("score")
    return retrieve.ranked(first, "qid", [F.col("best_rank")], most=3)


BLURB = f"""
titled AS (SELECT c.child_id, c.doc_id, c.chunk, 'This passage is from ' || coalesce(d.source, '') || ', section ''' || trim(regexp_replace(coalesce(d.title, ''), '{T.WS}+', ' ', 'g'), ' ') || ''', about: ' || array_to_string(string_split(c.chunk, ' ')[1:8], ' ') || '.' AS blurb
  FROM children c JOIN documents d USING (doc_id)),
"""


def _blurbed(spark: SparkSession, sf: str, c: Corpus) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "title")
    first = F.array_join(F.slice(F.split("chunk", " "), 1, 8), " ")
    blurb = F.concat(F.lit("This passage is from "), F.coalesce("source", F.lit("")), F.lit(", section '"), T.squeezed(F.coalesce("title", F.lit(""))), F.lit("', about: "), first, F.lit("."))
    return c.children.join(d, "doc_id").select("child_id", "doc_id", F.col("chunk").alias("raw_text"), blurb.alias("blurb")).withColumn("text", F.concat_ws("\n", "blurb", "raw_text"))


@query(sql(WINDOWS + BLURB, "SELECT child_id, blurb, chunk AS raw_text, blurb || chr(10) || chunk AS text FROM titled"))
def blurb_assemble(spark, sf):
    return _blurbed(spark, sf, Corpus(spark, sf)).select("child_id", "blurb", "raw_text", "text")


def _blurb_sql(lexical: str) -> str:
    base = WINDOWS.replace("tok AS (SELECT child_id, doc_id, regexp_extract_all(lower(chunk), '[a-z0-9]+') AS t FROM children)", BLURB.strip().rstrip(",") + ", tok AS (SELECT child_id, doc_id, regexp_extract_all(lower(blurb || chr(10) || chunk), '[a-z0-9]+') AS t FROM titled)")
    if lexical == "blurbed":
        return base + BM25 + TFIDF + HYBRID
    raw = """
rtok AS (SELECT child_id, regexp_extract_all(lower(chunk), '[a-z0-9]+') AS t FROM children),
rpost AS (SELECT child_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT child_id, unnest(t) AS term, len(t) AS dl FROM rtok) GROUP BY 1, 2),
rterms AS (SELECT term, count(*) AS df FROM rpost GROUP BY 1), rstats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM rtok),
"""
    bm = BM25.replace("terms USING", "rterms USING").replace("JOIN post", "JOIN rpost").replace(", stats", ", rstats")
    return base + raw + bm + TFIDF + HYBRID


def _rrf_blurb(spark, sf, lexical: str) -> DataFrame:
    c = Corpus(spark, sf)
    b = _blurbed(spark, sf, c)
    blurbed = Index.build(b, "child_id", "doc_id", "text")
    if lexical == "blurbed":
        return c.fused(blurbed).where("rank <= 50")
    both = fuse.reciprocal(c.parents_by("tfidf", ix=blurbed), c.parents_by("bm25"), "qid", "doc_id", fill=True)
    return retrieve.ranked(both, "qid", [F.desc("score"), F.col("doc_id")], most=50)


@query(sql(_blurb_sql("blurbed"), "SELECT qid, doc_id, score, rank FROM hy WHERE rank <= 50"))
def rrf_blurbed(spark, sf):
    return _rrf_blurb(spark, sf, "blurbed")


@query(sql(_blurb_sql("raw"), "SELECT qid, doc_id, score, rank FROM hy WHERE rank <= 50"))
def rrf_blurb_raw_lexical(spark, sf):
    return _rrf_blurb(spark, sf, "raw")


FULL = WINDOWS + BM25 + TFIDF + GOLD + HYBRID + evaluated("er", "hy")


def _rows(c: Corpus, ranking: DataFrame) -> DataFrame:
    return evaluate.evaluate(ranking, written(c.gold()), c.kinds(), "qid", "doc_id")


@query(sql(FULL, "SELECT * FROM er"))
def eval_rows(spark, sf):
    c = Corpus(spark, sf)
    return _rows(c, c.hybrid())


@query(sql(FULL + summarised("su", "er"), "SELECT * FROM su"))
def eval_summary(spark, sf):
    c = Corpus(spark, sf)
    return evaluate.summary(_rows(c, c.hybrid()))


@query(sql(FULL, "SELECT round(avg(CASE WHEN recall IS NOT NULL THEN top1_score END), 6) AS positive, round(avg(CASE WHEN recall IS NULL THEN top1_score END), 6) AS negative, round(avg(CASE WHEN recall IS NOT NULL THEN top1_score END) - avg(CASE WHEN recall IS NULL THEN top1_score END), 6) AS gap FROM er WHERE k = 1"))
def negative_gap(spark, sf):
    c = Corpus(spark, sf)
    return evaluate.negative_gap(_rows(c, c.hybrid()))


@query(sql(FULL + summarised("su", "er") + evaluated("eb", "pb") + summarised("sb", "eb"), "SELECT grp, k, c.recall AS control, c.mrr AS control_mrr, t.recall AS treatment, t.mrr AS treatment_mrr, round(t.recall - c.recall, 6) AS recall_change, round(t.mrr - c.mrr, 6) AS mrr_change FROM sb c FULL JOIN su t USING (grp, k)"))
def ab_diff(spark, sf):
    c = Corpus(spark, sf)
    return evaluate.difference(evaluate.summary(_rows(c, c.parents_by("bm25"))), evaluate.summary(_rows(c, c.hybrid())))


@query(sql(WINDOWS + GOLD, "SELECT qid, doc_id FROM gold"))
def gold_labels(spark, sf):
    return Corpus(spark, sf).gold()


@query(sql(WINDOWS + BM25 + TFIDF + GOLD + HYBRID, """SELECT qid, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS suggested FROM (
  SELECT h.qid, h.doc_id, h.rank, row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) AS n FROM hy h ANTI JOIN gold g ON g.qid = h.qid AND g.doc_id = h.doc_id
  WHERE h.rank <= 5 AND h.qid IN (SELECT qid FROM gold) AND h.qid NOT IN (SELECT h2.qid FROM hy h2 JOIN gold g2 ON g2.qid = h2.qid AND g2.doc_id = h2.doc_id WHERE h2.rank = 1)) WHERE n <= 3 GROUP BY 1"""))
def multilabel_suggest(spark, sf):
    c = Corpus(spark, sf)
    gold, top = written(c.gold()), written(c.hybrid().where("rank <= 5"))
    first = top.where("rank = 1").join(gold, ["qid", "doc_id"], "left_semi").select("qid")
    other = top.join(gold.select("qid").distinct(), "qid", "left_semi").join(first, "qid", "left_anti").join(gold, ["qid", "doc_id"], "left_anti")
    three = retrieve.ranked(other.withColumnRenamed("rank", "r"), "qid", [F.col("r")], "n", 3)
    return three.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("suggested"))


ANSWER = "'Context:' || chr(10) || string_agg('[' || p.rank || '] ' || coalesce(d.title, '') || chr(10) || left(d.text, 4000), chr(10) || chr(10) ORDER BY p.rank) || chr(10) || chr(10) || 'Question: ' || any_value(q.query) || chr(10) || 'Answer:'"


@query(sql(WINDOWS + BM25 + parent_rank("pb", "bm"), f"SELECT p.qid, sha256({ANSWER}) AS prompt_hash, length({ANSWER}) AS n FROM pb p JOIN documents d USING (doc_id) JOIN questions q ON q.qid = p.qid WHERE p.rank <= 3 GROUP BY 1"))
def answer_prompts(spark, sf):
    """The grounded prompt of every question: its three best documents, each cut to the grader's budget, best first; a model's answer would stand beside it, and
    without a model the prompt's context is what is given."""
    c = Corpus(spark, sf)
    top = c.parents_by("bm25").where("rank <= 3")
    j = top.join(table(spark, sf, "documents").select("doc_id", "title", "text"), "doc_id").join(c.questions, "qid")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("text", 1, 4000))
    g = j.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("ctx"), F.first("query").alias("query"))
    prompt = F.concat(F.lit("Context:\n"), "ctx", F.lit("\n\nQuestion: "), "query", F.lit("\nAnswer:"))
    return g.select("qid", F.sha2(prompt, 256).alias("prompt_hash"), F.length(prompt).cast("bigint").alias("n"))
