"""Queries of subsets and their checks, sources and sinks, sections with pages, and the growth of golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking, golden, retrieve
from quillmark.operators.dense import DenseStore, approximate
from quillmark.operators.scoring import Index
from quillmark.plans import project as P
from quillmark.plans import retrieval as R
from quillmark.plans import tables
from quillmark.plans.gates import scratch
from quillmark.session import table, written
from quillmark.sources import json_files
from quillmark.sources import manifest as M

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
FRACTION, SEED = 0.8, "s9"
_SUB = P._SUB.replace("0.4::DOUBLE", f"{FRACTION}::DOUBLE").replace("'s7|'", f"'{SEED}|'")
_PARENT = "json_extract_string(e.cmetadata, '$.parent_id')"


def _subset(spark: SparkSession, sf: str) -> DataFrame:
    """(parent_id, gold): every labelled section and others in hash order up to the fraction."""
    return golden.anchored_sample(P.sections(spark, sf), P.labels(spark, sf), "parent_id", FRACTION, SEED)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "langchain_pg_embedding").withColumn("parent_id", F.get_json_object("cmetadata", "$.parent_id"))


@query(sql(P.SECTIONS + P.QA + P._GOLD + _SUB, "SELECT parent_id, gold FROM sub"))
def subset_filled(spark, sf):
    """A subset larger than the labels: the labelled sections and a fill in hash order."""
    return _subset(spark, sf)


@query(sql(P.SECTIONS + P.QA + P._GOLD + _SUB, f"SELECT e.collection_id, count(*) AS vectors, count(DISTINCT e.id) AS ids, count(DISTINCT {_PARENT}) AS parents FROM langchain_pg_embedding e WHERE {_PARENT} IN (SELECT parent_id FROM sub) GROUP BY 1"))
def subset_copy(spark, sf):
    """The vectors of the subset's sections, copied as they are into a table of their own and counted there."""
    kept = _vectors(spark, sf).join(_subset(spark, sf).select("parent_id"), "parent_id", "left_semi")
    return written(kept).groupBy("collection_id").agg(F.count("*").alias("vectors"), F.count_distinct("id").alias("ids"), F.count_distinct("parent_id").alias("parents"))


@query(sql(P.SECTIONS + P.QA + P._GOLD + _SUB, "SELECT 'sections' AS file, count(*) AS n FROM sec WHERE parent_id IN (SELECT parent_id FROM sub) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE parent_id IN (SELECT parent_id FROM sub)"))
def subset_files(spark, sf):
    """The subset's sections and chunks written as JSON lines; the counts are those of the files read back."""
    keep, root = written(_subset(spark, sf).select("parent_id")), scratch(spark)
    out = None
    for name, df in (("sections", P.sections(spark, sf)), ("chunks", table(spark, sf, "chunks"))):
        part = df.join(keep, "parent_id", "left_semi")
        json_files.write(part, f"{root}/{name}")
        one = json_files.scan(spark, f"{root}/{name}", part.schema).agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_USABLE = "u AS (SELECT DISTINCT id, embedding AS e FROM langchain_pg_embedding WHERE collection_id LIKE '%b3e2' AND len(embedding) = 64 AND list_count(embedding) = 64 AND isfinite(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),"
_SAMPLE = "sm AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sha256('s3|' || id), list_aggregate(e, 'sum')) AS rn FROM u) WHERE rn <= 20),"
_NEAREST = "ds AS (SELECT s.id AS qid, s.e AS qe, u.id, list_sum(list_transform(list_zip(s.e, u.e), lambda z: z[1]::DOUBLE * z[2])) / sqrt(list_sum(list_transform(s.e, lambda x: x::DOUBLE * x)) * list_sum(list_transform(u.e, lambda x: x::DOUBLE * x))) AS c FROM sm s, u), nr AS (SELECT qid, bool_or(id = qid AND c >= 1 - 1e-6) AS found FROM ds GROUP BY 1, qe),"


def _usable(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).where(F.col("collection_id").endswith("b3e2") & (F.size("embedding") == 64)).select("id", F.col("embedding").alias("e")).distinct()
    norm = retrieve.dot(F.col("e"), F.col("e"))
    return v.where(~F.exists("e", lambda x: x.isNull()) & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm)).withColumn("norm", norm)


def _self_found(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, found) of 20 sampled vectors against all of their collection: each has to find itself."""
    u = _usable(spark, sf)
    order = [golden.hash_order("s3", "id"), F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double"))]
    s = u.orderBy(*order).limit(20).select(F.col("id").alias("qid"), F.col("e").alias("qe"), F.col("norm").alias("qn"))
    c = u.crossJoin(F.broadcast(s)).withColumn("c", retrieve.dot(F.col("e"), F.col("qe")) / F.sqrt(F.col("norm") * F.col("qn")))  # 20 queries against all rows
    return c.groupBy("qid", "qe").agg(F.bool_or((F.col("id") == F.col("qid")) & (F.col("c") >= 1 - 1e-6)).alias("found")).select("qid", "found")


@query(sql(_USABLE + _SAMPLE + _NEAREST, "SELECT count(*) AS asked, count(*) FILTER (WHERE found) AS found FROM nr"))
def dense_self_recall(spark, sf):
    return _self_found(spark, sf).agg(F.count("*").alias("asked"), F.count_if("found").alias("found"))


_CHECKS = sql(P.SECTIONS + P.QA + P._GOLD + _SUB + _USABLE + _SAMPLE + _NEAREST + f"""
kc AS (SELECT DISTINCT c.id, c.parent_id FROM chunks c WHERE c.parent_id IN (SELECT parent_id FROM sub)),
se AS (SELECT DISTINCT e.id, {_PARENT} AS parent_id FROM langchain_pg_embedding e WHERE {_PARENT} IN (SELECT parent_id FROM sub)),
ck AS (SELECT 'sections' AS name, (SELECT count(*) FROM sub) AS got, (SELECT target FROM nn) AS want UNION ALL SELECT 'gold', (SELECT count(*) FROM sub WHERE gold), (SELECT count(*) FROM g)
  UNION ALL SELECT 'chunks', (SELECT count(*) FROM kc), (SELECT count(DISTINCT id) FROM chunks WHERE parent_id IN (SELECT parent_id FROM sub))
  UNION ALL SELECT 'vectors of kept sections', (SELECT count(*) FROM se), (SELECT count(*) FROM se) UNION ALL SELECT 'scan is filtered', 1, 1
  UNION ALL SELECT 'self recall', (SELECT count(*) FROM nr WHERE found), (SELECT count(*) FROM nr)
  UNION ALL SELECT 'full text', (SELECT count(*) FROM (SELECT DISTINCT parent_id FROM sec WHERE list_contains({tok("text")}, 'the') AND parent_id IN (SELECT parent_id FROM sub))), 1),
""", "SELECT name, got::BIGINT AS got, want::BIGINT AS want, got >= want AS ok FROM ck")


@query(_CHECKS)
def subset_verification(spark, sf):
    """Seven checks of a subset: sections, labels, chunks, vectors, that the scan of the vectors is filtered before it is joined, self recall and full text."""
    s, lab = P.sections(spark, sf), P.labels(spark, sf)
    sub = written(_subset(spark, sf))
    keep = sub.select("parent_id")
    count = lambda df: df.agg(F.count("*")).first()[0]
    chunks = table(spark, sf, "chunks").select("id", "parent_id").distinct()
    kept_chunks, want_chunks = chunks.join(keep, "parent_id", "left_semi"), chunks.join(keep, "parent_id").select("id").distinct()
    vectors = _vectors(spark, sf).where("collection_id is not null").join(keep, "parent_id", "left_semi").select("id", "parent_id").distinct()
    pushed = int("PushedFilters: [IsNotNull(collection_id)" in tables.plan_of(vectors))
    found = _self_found(spark, sf).agg(F.count_if("found").alias("f"), F.count("*").alias("n")).first()
    text = s.join(keep, "parent_id", "left_semi").where(F.array_contains(T.tokens(F.col("text")), "the")).select("parent_id").distinct()
    n = count(s)
    return tables.checks(spark, [
        ("sections", count(sub), int(n * FRACTION + 0.5), ">="), ("gold", count(sub.where("gold")), count(s.join(lab.select("parent_id").distinct(), "parent_id", "left_semi")), ">="),
        ("chunks", count(kept_chunks), count(want_chunks), ">="), ("vectors of kept sections", count(vectors), count(vectors), ">="), ("scan is filtered", pushed, 1, ">="),
        ("self recall", found.f, found.n, ">="), ("full text", count(text), 1, ">="),
    ])


# ---- sources and sinks
@query("SELECT split_part(source, '/', 1) AS source, count(*) AS n, count(DISTINCT source || '#' || section_idx) AS parents, sum(length(coalesce(text, '')))::BIGINT AS chars, count(deleted_at) AS deleted, max(epoch_us(ingested_at)) AS latest FROM sections GROUP BY 1")
def json_round_trip(spark, sf):
    """Sections written as JSON lines and scanned again with their schema: nothing is lost, also no null and no microsecond."""
    s, path = table(spark, sf, "sections"), scratch(spark)
    json_files.write(s, path)
    got = json_files.parents(json_files.scan(spark, path, s.schema))
    return got.groupBy(F.split("source", "/").getItem(0).alias("source")).agg(F.count("*").alias("n"), F.count_distinct("parent_id").alias("parents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("deleted_at").alias("deleted"), F.max(F.unix_micros("ingested_at")).alias("latest"))


_OLD, _NEW = "pulled_at < TIMESTAMP '2026-04-01'", "pulled_at >= TIMESTAMP '2026-04-01'"
_TIE = "ORDER BY pulled_at DESC NULLS LAST, status DESC NULLS LAST, bytes DESC NULLS LAST, path DESC NULLS LAST, sha256 DESC NULLS LAST"


@query(f"WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, id {_TIE}) AS rn FROM manifest WHERE {_OLD}) WHERE rn = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, id {_TIE}) AS rn FROM manifest WHERE {_NEW}) WHERE rn = 1) SELECT source, id, status, sha256 FROM n UNION ALL SELECT o.source, o.id, o.status, o.sha256 FROM o ANTI JOIN n ON n.source = o.source AND n.id = o.id")
def manifest_upsert(spark, sf):
    """A later delivery over an earlier one: rows of the same file are replaced, the others stay."""
    m, at = table(spark, sf, "manifest"), F.to_timestamp(F.lit("2026-04-01 00:00:00"))
    last = lambda df: M.latest(df, ["source", "id"], "pulled_at", "status", "bytes", "path", "sha256")
    return M.upsert(last(m.where(F.col("pulled_at") < at)), last(m.where(F.col("pulled_at") >= at)), ["source", "id"]).select("source", "id", "status", "sha256")


TARGETS = {"arxiv": 20, "wikipedia": 15, "sec": 15, "datagov": 10, "rtd": 10, "archive": 50}


@query(sql(P._MAN, "SELECT t.source, t.target::INTEGER AS target, count(*) FILTER (WHERE m.status = 'done') AS done, greatest(0, any_value(t.target) - count(*) FILTER (WHERE m.status = 'done')) AS missing FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in TARGETS.items()) + ") t(source, target) LEFT JOIN m ON m.source = t.source GROUP BY 1, 2"))
def manifest_targets(spark, sf):
    """What is done of what was asked for, by source."""
    t = spark.createDataFrame(list(TARGETS.items()), "source string, target int")
    j = F.broadcast(t).join(P._manifest(spark, sf).select("source", "status"), "source", "left")
    done = F.count_if(F.col("status") == "done")
    return j.groupBy("source", "target").agg(done.alias("done"), F.greatest(F.lit(0), F.col("target") - done).alias("missing"))


# ---- sections
@query(sql(P._NUM, "SELECT doc_id, count(*) AS sections, count(*) FILTER (WHERE char_len < 40) AS slivers, count(*) FILTER (WHERE char_len >= 40) AS kept FROM nn GROUP BY 1"))
def section_sliver_filter(spark, sf):
    """Sections numbered first, slivers dropped after."""
    s = chunking.numbered_sections(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", least=1)
    return s.groupBy("doc_id").agg(F.count("*").alias("sections"), F.count_if(F.col("char_len") < 40).alias("slivers"), F.count_if(F.col("char_len") >= 40).alias("kept"))


@query("SELECT doc_id, CASE WHEN place = 0 THEN text ELSE left(text, place - 1) END AS body FROM (SELECT doc_id, text, instr(lower(text), 'table') AS place FROM documents WHERE text IS NOT NULL)")
def bibliography_truncate(spark, sf):
    """Texts up to the first mark of their end; on these tables the word `table` stands for the mark."""
    d = table(spark, sf, "documents").where("text is not null")
    return chunking.truncated(d, "doc_id", "text", "(?i)table").select("doc_id", "body")


_PAGED = """
pg AS (SELECT source, title, section_idx, text, page_start, page_end, CASE WHEN regexp_full_match(section_idx, '[0-9]+') THEN section_idx::BIGINT END AS i FROM sec),
pl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS line_no, (i - 1) % 3 = 0 AS heading FROM pg WHERE i IS NOT NULL),
pr AS (SELECT *, sum(heading::BIGINT) OVER (PARTITION BY source ORDER BY line_no) AS grp FROM pl),
pe AS (SELECT source, grp, CASE WHEN grp = 0 THEN '(front matter)' ELSE min_by(coalesce(title, ''), line_no) END AS title, min(page_start) AS page_start, max(coalesce(page_end, page_start)) AS last, count(*) AS lines FROM pr GROUP BY 1, 2),
"""


@query(sql(P.SECTIONS + _PAGED, "SELECT source, grp, title, page_start, coalesce(lead(page_start) OVER (PARTITION BY source ORDER BY grp), last) AS page_end, lines FROM pe"))
def paged_sections(spark, sf):
    """Islands with pages: a section begins on its first page and ends on the page of the next heading, the last one on its last page. Sections stand for lines
    here, every third one for a heading."""
    s = P.sections(spark, sf).withColumn("i", F.when(F.col("section_idx").rlike("^[0-9]+$"), F.col("section_idx").try_cast("bigint"))).where("i is not null")
    lines = s.withColumn("line_no", F.row_number().over(Window.partitionBy("source").orderBy("i"))).withColumn("heading", (F.col("i") - 1) % 3 == 0)
    return chunking.paged_islands(lines, "source", "title", "page_start", "page_end")


# ---- growth of golden sets
def _jaccard_sql(a: str, b: str) -> str:
    return f"len(list_intersect({content(a)}, {content(b)})) / greatest(1, len(list_distinct(list_concat({content(a)}, {content(b)}))))::DOUBLE"


@query(f"SELECT DISTINCT id, query FROM qa_slice_bm25 WHERE type = 'paraphrase' AND query IS NOT NULL AND NOT {_jaccard_sql('query', '_answer')} > 0.6")
def paraphrase_reject(spark, sf):
    """Paraphrases that share more than 0.6 of their content words with what they paraphrase are rejected; the query and its answer stand for the two."""
    p = table(spark, sf, "qa_slice_bm25").where("type = 'paraphrase' and query is not null")
    return p.where(~(T.jaccard(T.content_terms(F.col("query")), T.content_terms(F.col("_answer"))) > 0.6)).select("id", "query").distinct()


_EXPAND = """
mix AS (SELECT type, count(*) AS c FROM q WHERE coalesce(_gen, '') != 'expand' GROUP BY 1), al AS (SELECT sum(c) AS al FROM mix),
qu AS (SELECT type, floor(40 * c / al::DOUBLE + 0.5)::BIGINT AS want, ceil(1.7::DOUBLE * floor(40 * c / al::DOUBLE + 0.5))::BIGINT AS over FROM mix, al),
dr AS (SELECT id, q.type, query, _answer, row_number() OVER (PARTITION BY q.type ORDER BY sha256('x1|' || id)) AS rn FROM q WHERE _gen = 'expand'),
"""


@query(sql(P.QA + _EXPAND, f"SELECT id, type FROM (SELECT d.id, d.type, want, row_number() OVER (PARTITION BY d.type ORDER BY rn) AS n FROM dr d JOIN qu USING (type) WHERE rn <= over AND length(d.query) < 300 AND NOT coalesce({_jaccard_sql('d.query', 'd._answer')}, 0) > 0.6) WHERE n <= want"))
def expand_stratified(spark, sf):
    """Growth in the mix of the base set: of each type 1.7 times what is wanted is drawn in hash order, filtered, and cut to what is wanted."""
    return golden.expanded(P.questions(spark, sf), "type", "id", F.coalesce("_gen", F.lit("")) == "expand", (F.length("query") < 300) & ~F.coalesce(T.jaccard(T.content_terms(F.col("query")), T.content_terms(F.col("_answer"))) > 0.6, F.lit(False)), 40, 1.7, "x1")


_VERIFIED = P.SECTIONS + P.QA + f"""
nm AS (SELECT id, query, _near_miss_of AS near FROM q WHERE type = 'negative' AND _near_miss_of IS NOT NULL AND query IS NOT NULL),
nw AS (SELECT id, near, {content("query")} AS t FROM nm),
ov AS (SELECT id, near, parent_id, round(len(list_intersect(t, {tok("text")})) / len(t)::DOUBLE, 6) AS o FROM nw, sec WHERE len(t) > 0),
tf AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC, parent_id) AS rank FROM ov WHERE o > 0),
"""


@query(sql(_VERIFIED, "SELECT id, max(o) AS best, coalesce(max(o) >= 0.8, false) AS answerable, coalesce(bool_or(parent_id = near), false) AS near_in_five FROM tf WHERE rank <= 5 GROUP BY 1"))
def near_miss_verified(spark, sf):
    """Near-miss negatives against their five best sections: one that a section answers is no negative."""
    q = P.questions(spark, sf).where("type = 'negative' and _near_miss_of is not null and query is not null")
    terms = q.select(F.col("id").alias("qid"), F.explode(T.content_terms(F.col("query"))).alias("term"), F.lit(1).alias("qtf"))
    s = Index.build(P.sections(spark, sf), "parent_id", "parent_id", "text").scores(terms, "share", most=5).withColumnRenamed("key", "parent_id")
    top = retrieve.ranked(s.where("score > 0"), "qid", [F.desc("score"), F.col("parent_id")], most=5).withColumnRenamed("qid", "id").join(q.select("id", F.col("_near_miss_of").alias("near")), "id")
    return top.groupBy("id").agg(F.max("score").alias("best"), F.coalesce(F.max("score") >= 0.8, F.lit(False)).alias("answerable"), F.bool_or(F.col("parent_id") == F.col("near")).alias("near_in_five"))


@query(sql(P.QA, "SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(relevant_parent_ids, []), lambda x: x IS NOT NULL), CASE WHEN list_contains(coalesce(_validate, []), 'multi-label') THEN list_filter(coalesce(relevant_parent_ids_s3, []), lambda x: x IS NOT NULL) ELSE [] END))), ' | ') AS labels FROM q WHERE relevant_parent_ids IS NOT NULL"))
def label_add(spark, sf):
    """Labels after review: questions noted as having several get those of the second set beside their own."""
    q = P.questions(spark, sf).where("relevant_parent_ids is not null")
    empty = F.array().cast("array<string>")
    solid = lambda c: F.filter(F.coalesce(c, empty), lambda x: x.isNotNull())
    more = F.when(F.array_contains(F.coalesce("_validate", empty), "multi-label"), solid("relevant_parent_ids_s3")).otherwise(empty)
    return q.select("id", F.array_join(F.array_sort(F.array_union(solid("relevant_parent_ids"), more)), " | ").alias("labels"))


@query(sql(P.SECTIONS + P.QA, f"SELECT q.id, s.parent_id FROM q JOIN sec s ON regexp_replace(s.parent_id, '#[^#]*$', '') = regexp_replace(q.relevant_parent_ids[1], '#[^#]*$', '') AND s.parent_id != q.relevant_parent_ids[1] WHERE list_contains(coalesce(_validate, []), 'multi-label') AND len({content('_answer')}) > 0 AND len(list_intersect({content('_answer')}, {tok('s.text')})) / len({content('_answer')})::DOUBLE >= 0.5"))
def triage_siblings(spark, sf):
    """Sections of the same document that hold at least half of the answer, for questions noted as having several labels."""
    q = P.questions(spark, sf).where(F.array_contains("_validate", "multi-label")).select("id", F.col("relevant_parent_ids").getItem(0).alias("gold"), T.content_terms(F.col("_answer")).alias("a")).withColumn("doc", T.document_key(F.col("gold")))
    s = P.sections(spark, sf).select("parent_id", "text").withColumn("doc", T.document_key(F.col("parent_id")))
    j = q.where("size(a) > 0").join(s, "doc").where("parent_id != gold")
    return j.where(T.overlap(F.col("a"), T.tokens(F.col("text"))) >= 0.5).select("id", "parent_id")


@query(sql(P.SECTIONS + P.QA, "SELECT id, min_by(pos, place) AS answer_pos FROM (SELECT q.id, x.place, CASE WHEN instr(lower(s.text), lower(trim(q._answer, ' '))) > 0 THEN instr(lower(s.text), lower(trim(q._answer, ' '))) - 1 END AS pos FROM q JOIN (SELECT id, unnest(relevant_parent_ids) AS p, unnest(range(len(relevant_parent_ids))) AS place FROM q) x ON x.id = q.id JOIN sec s ON s.parent_id = x.p WHERE length(trim(q._answer, ' ')) > 0) WHERE pos IS NOT NULL GROUP BY 1"))
def answer_place(spark, sf):
    """Where the answer stands verbatim, in the first labelled section that has it."""
    q = P.questions(spark, sf).where("length(trim(_answer)) > 0").select("id", "_answer", F.posexplode("relevant_parent_ids").alias("place", "parent_id"))
    j = q.join(P.sections(spark, sf).select("parent_id", "text"), "parent_id")
    pos = F.instr(F.lower("text"), F.lower(F.trim("_answer")))
    return j.where(pos > 0).groupBy("id").agg(F.min_by(pos - 1, "place").cast("bigint").alias("answer_pos"))


@query("SELECT id, collection_id, replace(max_by(coalesce(document, ''), (coalesce(cmetadata, ''), coalesce(document, ''))), chr(0), '') AS document FROM langchain_pg_embedding GROUP BY 1, 2")
def vector_latest(spark, sf):
    """One document a key: the last by its metadata, ties by its text; characters that a store refuses are left out."""
    e = table(spark, sf, "langchain_pg_embedding")
    return e.groupBy("id", "collection_id").agg(F.replace(F.max_by(F.coalesce("document", F.lit("")), F.struct(F.coalesce("cmetadata", F.lit("")), F.coalesce("document", F.lit("")))), F.lit("\0"), F.lit("")).alias("document"))


@query(sql(R.WINDOWS, "SELECT qid, child_id, met FROM (SELECT qid, child_id, count(*) AS met FROM (SELECT DISTINCT qid, term FROM qt) t JOIN post USING (term) GROUP BY 1, 2) JOIN (SELECT qid, count(*) AS need FROM (SELECT DISTINCT qid, term FROM qt) GROUP BY 1) USING (qid) WHERE met = need"))
def fulltext_cover(spark, sf):
    """Windows that have all of a question's terms, and how many those are."""
    c = R.Corpus(spark, sf)
    need = c.terms_of.groupBy("qid").agg(F.count("*").alias("met"))
    return c.children_by("all").select("qid", "child_id").join(need, "qid").select("qid", "child_id", "met")


_DENSE_PARENTS = _USABLE.replace("SELECT DISTINCT id, embedding AS e FROM langchain_pg_embedding WHERE", f"SELECT DISTINCT e.id, {_PARENT} AS parent, e.embedding AS e FROM langchain_pg_embedding e WHERE") + """
sm AS (SELECT * FROM (SELECT id, e, row_number() OVER (ORDER BY sha256('s3|' || id), list_aggregate(e, 'sum')) AS rn FROM (SELECT DISTINCT id, e FROM u)) WHERE rn <= 20),
dp AS (SELECT s.rn AS qid, u.parent, max(round(list_sum(list_transform(list_zip(s.e, u.e), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(s.e, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(u.e, lambda x: x::DOUBLE * x)))), 6)) AS score FROM sm s, u GROUP BY 1, 2),
"""


@query(sql(_DENSE_PARENTS, "SELECT qid, parent, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent) AS rank FROM dp) WHERE rank <= 50"))
def dense_parents(spark, sf):
    """Sections ranked by their best vector, for 20 sampled vectors of a collection as queries."""
    v = _vectors(spark, sf).where(F.col("collection_id").endswith("b3e2") & (F.size("embedding") == 64)).select("id", "parent_id", "embedding").distinct()
    order = [golden.hash_order("s3", "id"), F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double"))]
    q = _usable(spark, sf).select("id", "e").distinct().orderBy(*order).limit(20)
    q = q.withColumn("qid", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("bigint")).select("qid", F.col("e").alias("vector"))  # 20 rows
    return DenseStore(v, "id", "parent_id", "embedding").parents(written(q)).where("rank <= 50")


@query()
def ann_lsh_recall(spark, sf):
    """How many of the ten nearest the approximate search finds, for every vector whose id is divisible by 20 against all."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = P.QUERIES["dense_topk"](spark, sf).select("qid", F.col("vec_id").alias("key"))
    got = approximate(e, q, "vec_id", "embedding").select("qid", "key", F.lit(1).alias("found"))
    return exact.join(got, ["qid", "key"], "left").agg(F.count("*").alias("nearest"), F.count("found").alias("found"), F.round(F.count("found") / F.count("*"), 4).alias("recall"))
