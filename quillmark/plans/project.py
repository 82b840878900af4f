"""Queries over the project's tables: acquisition, sections, vectors, golden sets, the corrective loop, spend and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking, golden, loop, retrieve
from quillmark.operators.scoring import Index
from quillmark.plans import retrieval as R
from quillmark.session import table
from quillmark.sources import manifest as M
from quillmark.sources.readers import plain_html
from quillmark.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
STOP = R.STOP


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of every section that is not deleted."""
    s = M.latest(table(spark, sf, "sections").withColumn("parent_id", F.concat_ws("#", "source", "section_idx")), ["parent_id"], "ingested_at", "deleted_at", "char_len", "title", "page_start", "page_end")
    return s.where("deleted_at is null")


SECTIONS = """
sec AS (SELECT * FROM (SELECT *, source || '#' || section_idx AS parent_id, row_number() OVER (PARTITION BY source || '#' || section_idx
  ORDER BY ingested_at DESC NULLS LAST, deleted_at DESC NULLS LAST, char_len DESC NULLS LAST, title DESC NULLS LAST, page_start DESC NULLS LAST, page_end DESC NULLS LAST) AS rn FROM sections) WHERE rn = 1 AND deleted_at IS NULL),
"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest(table(spark, sf, "qa"), ["id"], "added_at", "query", "_answer", "_gen")


QA = """
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC NULLS LAST, query DESC NULLS LAST, _answer DESC NULLS LAST, _gen DESC NULLS LAST) AS rn FROM qa) WHERE rn = 1),
"""


def tok(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def content(c: str) -> str:
    return f"list_distinct(list_filter({tok(f'coalesce({c}, {chr(39) * 2})')}, lambda x: NOT list_contains({STOP}, x)))"


def sql(ctes: str, last: str) -> str:
    return R.sql(ctes, last)


# ---- acquisition
_MAN = """
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY pulled_at DESC NULLS LAST, status DESC NULLS LAST, bytes DESC NULLS LAST, path DESC NULLS LAST, sha256 DESC NULLS LAST) AS rn FROM manifest) WHERE rn = 1),
"""


def _manifest(spark, sf) -> DataFrame:
    return M.latest(table(spark, sf, "manifest"), ["source", "id"], "pulled_at", "status", "bytes", "path", "sha256")


@query(sql(_MAN, "SELECT source, id, path, format, url, status, bytes, sha256, err FROM m"))
def upsert_latest(spark, sf):
    return _manifest(spark, sf).select("source", "id", "path", "format", "url", "status", "bytes", "sha256", "err")


@query(sql(_MAN, "SELECT DISTINCT c.source, c.id FROM manifest c ANTI JOIN (SELECT source, id FROM m WHERE (status = 'done' AND coalesce(bytes, 0) > 0) OR status = 'failed') d ON d.source = c.source AND d.id = c.id WHERE c.source IS NOT NULL AND c.id IS NOT NULL"))
def manifest_resume(spark, sf):
    return M.to_pull(table(spark, sf, "manifest").where("source is not null and id is not null").select("source", "id").distinct(), _manifest(spark, sf), ["source", "id"])


@query(sql(_MAN, "SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(sum(bytes) FILTER (WHERE status = 'done'), 0)::BIGINT AS bytes FROM m GROUP BY GROUPING SETS ((source), ())"))
def manifest_status_rollup(spark, sf):
    return M.status(_manifest(spark, sf))


@query("SELECT DISTINCT source, path, CASE WHEN e IN ('.htm', '.html') THEN 'html' WHEN e IN ('.md', '.txt') THEN 'md' WHEN source = 'sec' THEN 'html' WHEN source = 'archive' THEN 'scanned' ELSE 'pdf' END AS lane FROM (SELECT source, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS e FROM manifest WHERE path IS NOT NULL)")
def route_lane(spark, sf):
    return table(spark, sf, "manifest").where("path is not null").select("source", "path", chunking.lane_of(F.coalesce("source", F.lit("")), F.col("path")).alias("lane")).distinct()


_H = "regexp_replace(regexp_replace('<html><style>x</style><p>' || text || '</p></html>', '<(script|style|nav)\\b[^>]*>.*?</(script|style|nav)>|<!--.*?-->', ' ', 'gis'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT doc_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace({_H}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'), ' ')) AS n FROM documents WHERE lane = 'html' AND text IS NOT NULL")
def html_to_text(spark, sf):
    d = table(spark, sf, "documents").where("lane = 'html' and text is not null")
    return d.select("doc_id", F.length(plain_html(F.concat(F.lit("<html><style>x</style><p>"), "text", F.lit("</p></html>")))).cast("bigint").alias("n"))


@query("SELECT doc_id, length(text) AS n, length(text) < 200 AS short FROM documents WHERE text IS NOT NULL")
def short_document_guard(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"), (F.length("text") < 200).alias("short"))


@query("SELECT doc_id, sha256('m1' || chr(0) || coalesce(text, '')) AS fp FROM documents")
def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fingerprint(F.lit("m1"), F.coalesce("text", F.lit(""))).alias("fp"))


@query("SELECT sha256(text) AS h, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedupe_exact(spark, sf):
    return table(spark, sf, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, min(reason) AS reason, count(*) AS deliveries FROM parse_failures GROUP BY 1")
def dead_letters(spark, sf):
    return table(spark, sf, "parse_failures").groupBy("doc_id").agg(F.min("reason").alias("reason"), F.count("*").alias("deliveries"))


# ---- sections and children
@query("SELECT doc_id, grp, first, n FROM (SELECT doc_id, grp, min_by(line, line_no) AS first, count(*) AS n FROM (SELECT doc_id, line_no, line, sum(CAST(regexp_matches(line, '^\\s*([-*•]|\\(?[0-9a-z]{1,2}[.)])\\s') AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM (SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))) GROUP BY 1, 2)")
def section_islands(spark, sf):
    lines = chunking.lines_of(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")
    g = chunking.islands(lines, "doc_id", F.col("line").rlike(r"^\s*([-*•]|\(?[0-9a-z]{1,2}[.)])\s"))
    return g.groupBy("doc_id", "grp").agg(F.min_by("line", "line_no").alias("first"), F.count("*").alias("n"))


_NUM = r"""
ln AS (SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
st AS (SELECT doc_id, min(line_no) AS stop FROM ln WHERE regexp_matches(line, '(?i)^\s*(references|bibliography)\s*$') GROUP BY 1),
ln2 AS (SELECT ln.* FROM ln LEFT JOIN st USING (doc_id) WHERE stop IS NULL OR line_no < stop),
hd AS (SELECT *, regexp_matches(line, '^\s*(\d+(?:\.\d+)*|[IVXL]+)\.?\s+([A-Z][A-Za-z][^\n]{0,60})$') AND NOT regexp_matches(trim(regexp_extract(line, '^\s*(\d+(?:\.\d+)*|[IVXL]+)\.?\s+([A-Z][A-Za-z][^\n]{0,60})$', 2)), '[,;:]$') AS ok,
  regexp_extract(line, '^\s*(\d+(?:\.\d+)*|[IVXL]+)\.?\s+([A-Z][A-Za-z][^\n]{0,60})$', 1) AS num FROM ln2),
hb AS (SELECT *, CASE WHEN ok AND regexp_matches(num, '^\d+$') THEN TRY_CAST(num AS BIGINT) END AS bare FROM hd),
hh AS (SELECT *, ok AND (bare IS NULL OR bef IS NULL OR bare > bef) AS heading FROM (SELECT *, max(bare) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM hb)),
gg AS (SELECT *, sum(heading::BIGINT) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM hh),
pp AS (SELECT doc_id, grp, trim(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g'), ' ') AS body, min_by(line, line_no) AS top, max(heading) AS headed FROM gg GROUP BY 1, 2),
nn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS section_idx, CASE WHEN headed THEN trim(top, ' ') ELSE '(front matter)' END AS title, body AS text, length(body) AS char_len FROM pp WHERE length(body) > 0),
"""


@query(sql(_NUM, "SELECT doc_id, section_idx, title, text, char_len FROM nn WHERE char_len >= 40"))
def numbered_sections(spark, sf):
    return chunking.numbered_sections(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")


_FR = "fr AS (SELECT doc_id, line_no AS o, line AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM (SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE length(line) > 0),"
_MERGE = _FR + """
i1 AS (SELECT *, sum(CAST(rn = 1 OR length(t) >= 80 AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY o) AS isle FROM fr),
i2 AS (SELECT doc_id, isle, string_agg(t, chr(10) ORDER BY o) AS t, count(*) AS n FROM i1 GROUP BY 1, 2),
i3 AS (SELECT *, CASE WHEN max(CASE WHEN isle = 1 THEN length(t) < 80 END) OVER (PARTITION BY doc_id) AND isle <= 2 THEN 1 ELSE isle END AS place FROM i2),
"""


@query(sql(_MERGE, "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS fragment, n, text, length(text) AS char_len FROM (SELECT doc_id, place, string_agg(t, chr(10) ORDER BY isle) AS text, sum(n)::BIGINT AS n FROM i3 GROUP BY 1, 2)"))
def stub_merge(spark, sf):
    lines = chunking.lines_of(table(spark, sf, "documents").where("text is not null"), "doc_id", "text").where("length(line) > 0")
    return chunking.merge_stubs(lines, "doc_id", "line_no", "line", 80)


@query()
def recursive_split(spark, sf):
    return chunking.chunk_documents(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", "lane")


@query("SELECT parent_id, min_by(blurb, n) AS blurb FROM (SELECT parent_id, blurb, TRY_CAST(regexp_extract(id, '#([0-9]+)$', 1) AS BIGINT) AS n FROM chunks WHERE blurb IS NOT NULL) WHERE n IS NOT NULL GROUP BY 1")
def blurb_first_per_parent(spark, sf):
    c = table(spark, sf, "chunks").where("blurb is not null").withColumn("n", F.regexp_extract("id", "#([0-9]+)$", 1).try_cast("bigint")).where("n is not null")
    return c.groupBy("parent_id").agg(F.min_by("blurb", "n").alias("blurb"))


@query("SELECT DISTINCT id, coalesce(raw_text, text) AS text FROM chunks")
def raw_view(spark, sf):
    return table(spark, sf, "chunks").select("id", F.coalesce("raw_text", "text").alias("text")).distinct()


@query(sql(SECTIONS, "SELECT c.source, count(DISTINCT c.id) AS children, count(DISTINCT c.id) FILTER (WHERE sec.parent_id IS NULL) AS without_parent FROM chunks c LEFT JOIN sec ON sec.parent_id = c.parent_id GROUP BY 1"))
def parent_lookup(spark, sf):
    c = table(spark, sf, "chunks").select("id", "parent_id", "source").join(sections(spark, sf).select("parent_id", F.lit(True).alias("there")), "parent_id", "left")
    return c.groupBy("source").agg(F.count_distinct("id").alias("children"), F.count_distinct(F.when(F.col("there").isNull(), F.col("id"))).alias("without_parent"))


_GOLD = """
lab AS (SELECT DISTINCT id, trim(x, ' ') AS parent_id FROM (SELECT id, unnest(coalesce(relevant_parent_ids_s3, relevant_parent_ids)) AS x FROM q) WHERE x IS NOT NULL),
"""


def labels(spark, sf) -> DataFrame:
    q = questions(spark, sf).select("id", F.explode(F.coalesce("relevant_parent_ids_s3", "relevant_parent_ids")).alias("x")).where("x is not null")
    return q.select("id", F.trim("x").alias("parent_id")).distinct()


@query(sql(SECTIONS + QA + _GOLD, "SELECT id, string_agg('[' || parent_id || '] ' || coalesce(title, '') || chr(10) || text, chr(10) || chr(10) ORDER BY parent_id) AS context FROM lab JOIN sec USING (parent_id) GROUP BY 1"))
def prompt_context(spark, sf):
    j = labels(spark, sf).join(sections(spark, sf).select("parent_id", "title", "text"), "parent_id")
    block = F.concat(F.lit("["), "parent_id", F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), "text")
    return j.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parent_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


# ---- filters
@query(sql(SECTIONS, "SELECT parent_id FROM sec WHERE length(text) >= 400 AND NOT regexp_matches(coalesce(title, ''), '(?i)" + T.TITLE_REJECT + "') AND (length(text) - length(replace(text, ' ', ''))) / length(text)::DOUBLE >= 0.02"))
def qa_candidate_parents(spark, sf):
    s = sections(spark, sf)
    return s.where((F.length("text") >= 400) & ~F.coalesce("title", F.lit("")).rlike(f"(?i){T.TITLE_REJECT}") & (T.space_ratio(F.col("text")) >= 0.02)).select("parent_id")


@query("SELECT doc_id, NOT regexp_matches(text, '\\p{Cf}') AND length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / greatest(1, length(text))::DOUBLE <= 0.2 AS clean FROM documents WHERE text IS NOT NULL")
def clean_text_gate(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.is_clean(F.col("text")).alias("clean"))


@query(sql(QA, "SELECT id, length(query) > 0 AND length(query) < 300 AND NOT regexp_matches(query, '\\p{Cf}') AND length(regexp_replace(query, '[\\x00-\\x7F]', '', 'g')) / greatest(1, length(query))::DOUBLE <= 0.2 AND NOT regexp_matches(lower(query), '" + T.QUESTION_REJECT.replace("'", "''") + "') AS good FROM q"))
def question_gate(spark, sf):
    return questions(spark, sf).select("id", T.is_good_question(F.col("query")).alias("good"))


@query("SELECT DISTINCT id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b))))::DOUBLE, 6) AS jaccard FROM (SELECT id, " + content("query") + " AS a, " + content("_answer") + " AS b FROM qa_slice_bm25)")
def paraphrase_jaccard(spark, sf):
    return table(spark, sf, "qa_slice_bm25").select("id", F.round(T.jaccard(T.content_terms(F.col("query")), T.content_terms(F.col("_answer"))), 6).alias("jaccard")).distinct()


@query(sql(QA, "SELECT id, query FROM (SELECT id, query, row_number() OVER (PARTITION BY lower(query) ORDER BY id) AS rn FROM q WHERE type = 'negative') WHERE rn = 1"))
def negatives_without_repeats(spark, sf):
    n = questions(spark, sf).where("type = 'negative'").withColumn("rn", F.row_number().over(Window.partitionBy(F.lower("query")).orderBy("id")))
    return n.where("rn = 1").select("id", "query")


# ---- golden sets
@query(sql(SECTIONS + QA + _GOLD, "SELECT id, parent_id, round(len(list_intersect(a, t)) / len(a)::DOUBLE, 6) AS grounded FROM (SELECT q.id, lab.parent_id, " + content("_answer") + " AS a, " + content("sec.text") + " AS t FROM q JOIN lab ON lab.id = q.id JOIN sec ON sec.parent_id = lab.parent_id) WHERE len(a) > 0"))
def ground_check(spark, sf):
    j = labels(spark, sf).join(questions(spark, sf).select("id", "_answer"), "id").join(sections(spark, sf).select("parent_id", "text"), "parent_id")
    g = j.select("id", "parent_id", F.round(T.overlap(T.content_terms(F.col("_answer")), T.content_terms(F.col("text"))), 6).alias("grounded"))
    return g.where("grounded is not null")


_NEG = """
nt AS (SELECT id, unnest(t) AS term, len(t) AS n FROM (SELECT id, """ + content("query") + """ AS t FROM q WHERE type = 'negative')),
pt AS (SELECT parent_id, unnest(""" + content("text") + """) AS term FROM sec),
"""


@query(sql(SECTIONS + QA + _NEG, "SELECT id, max(o) AS best_overlap, max(o) > 0.6 AS answerable FROM (SELECT id, parent_id, round(count(*) / any_value(n)::DOUBLE, 6) AS o FROM nt JOIN pt USING (term) GROUP BY 1, 2) GROUP BY 1"))
def negative_answerable(spark, sf):
    t = questions(spark, sf).where("type = 'negative'").select(F.col("id").alias("qid"), F.explode(T.content_terms(F.col("query"))).alias("term"), F.lit(1).alias("qtf"))
    o = Index.build(sections(spark, sf), "parent_id", "parent_id", "text").scores(t, "share", most=1)
    return o.groupBy(F.col("qid").alias("id")).agg(F.max("score").alias("best_overlap"), (F.max("score") > 0.6).alias("answerable"))


@query(sql(SECTIONS + QA + _GOLD, "SELECT lab.id, lab.parent_id FROM lab ANTI JOIN sec ON sec.parent_id = lab.parent_id"))
def label_check(spark, sf):
    return labels(spark, sf).join(sections(spark, sf).select("parent_id"), "parent_id", "left_anti").select("id", "parent_id")


@query(sql(QA + _GOLD, "SELECT id, parent_id FROM lab"))
def label_override(spark, sf):
    return labels(spark, sf)


_TRIAGE = "SELECT id, CASE WHEN bool_or(n LIKE '%ungrounded%') THEN 'DROPPED' WHEN bool_or(n LIKE '%answerable%') THEN 'REVIEW_NEGATIVE' WHEN bool_or(n LIKE '%multi-label%') THEN 'GRAY' ELSE 'OTHER' END AS bucket, count(*) AS notes FROM (SELECT id, unnest(_validate) AS n FROM q) WHERE n IS NOT NULL GROUP BY 1"


@query(sql(QA, _TRIAGE))
def triage_buckets(spark, sf):
    n = questions(spark, sf).select("id", F.explode("_validate").alias("n")).where("n is not null")
    has = lambda s: F.bool_or(F.col("n").contains(s))
    bucket = F.when(has("ungrounded"), "DROPPED").when(has("answerable"), "REVIEW_NEGATIVE").when(has("multi-label"), "GRAY").otherwise("OTHER")
    return n.groupBy("id").agg(bucket.alias("bucket"), F.count("*").alias("notes"))


_BAL = """
sz AS (SELECT type, count(*) AS c FROM q GROUP BY 1), tt AS (SELECT sum(c) AS al FROM sz),
qo AS (SELECT type, floor(least(30, al) * c / al::DOUBLE)::BIGINT AS base, round(least(30, al) * c / al::DOUBLE - floor(least(30, al) * c / al::DOUBLE), 9) AS frac, al FROM sz, tt),
qp AS (SELECT type, base + CAST(row_number() OVER (ORDER BY frac DESC, type) <= least(30, al) - sum(base) OVER () AS BIGINT) AS quota FROM qo),
"""


@query(sql(QA + _BAL, "SELECT id, type FROM (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY sha256('s0|' || id)) AS rn FROM q) JOIN qp USING (type) WHERE rn <= quota"))
def slice_balanced(spark, sf):
    return golden.balanced(questions(spark, sf).select("id", "type"), "type", "id", 30, "s0")


@query(sql(QA, "SELECT id, type, why FROM (SELECT id, type, CASE WHEN _validate IS NOT NULL AND len(_validate) > 0 THEN 'cause' WHEN type = 'negative' THEN 'negative' WHEN row_number() OVER (PARTITION BY (_validate IS NOT NULL AND len(_validate) > 0), type = 'negative' ORDER BY sha256('s0|' || id)) <= 10 THEN 'control' END AS why FROM q) WHERE why IS NOT NULL"))
def slice_cause(spark, sf):
    q = questions(spark, sf).select("id", "type", (F.coalesce(F.size("_validate"), F.lit(0)) > 0).alias("cause"))
    rn = F.row_number().over(Window.partitionBy("cause", F.col("type") == "negative").orderBy(golden.hash_order("s0", "id")))
    why = F.when(F.col("cause"), "cause").when(F.col("type") == "negative", "negative").when(rn <= 10, "control")
    return q.withColumn("why", why).where("why is not null").select("id", "type", "why")


_SUB = """
g AS (SELECT DISTINCT parent_id FROM lab JOIN sec USING (parent_id)), nn AS (SELECT floor(count(*) * 0.4::DOUBLE + 0.5)::BIGINT AS target FROM sec),
sub AS (SELECT parent_id, true AS gold FROM g UNION ALL SELECT parent_id, false FROM (SELECT parent_id, row_number() OVER (ORDER BY sha256('s7|' || parent_id)) AS rn FROM sec ANTI JOIN g USING (parent_id)), nn WHERE rn <= greatest(0, target - (SELECT count(*) FROM g))),
"""


@query(sql(SECTIONS + QA + _GOLD + _SUB, "SELECT parent_id, gold FROM sub"))
def subset_gold_anchored(spark, sf):
    return golden.anchored_sample(sections(spark, sf), labels(spark, sf), "parent_id", 0.4, "s7")


@query(sql(SECTIONS + QA + _GOLD + _SUB, "SELECT split_part(sec.source, '/', 1) AS source, count(*) AS total, count(sub.parent_id) AS kept FROM sec LEFT JOIN sub USING (parent_id) GROUP BY 1"))
def source_mix(spark, sf):
    s = sections(spark, sf)
    kept = golden.anchored_sample(s, labels(spark, sf), "parent_id", 0.4, "s7").select("parent_id", F.lit(1).alias("in"))
    return s.join(kept, "parent_id", "left").groupBy(F.split("source", "/").getItem(0).alias("source")).agg(F.count("*").alias("total"), F.count("in").alias("kept"))


@query(sql(SECTIONS, "SELECT parent_id, rn FROM (SELECT parent_id, row_number() OVER (ORDER BY parent_id) AS rn, count(*) OVER () AS al FROM sec) WHERE (rn - 1) % greatest(1, al // 50) = 0 AND (rn - 1) / greatest(1, al // 50)::DOUBLE < 50"))
def every_nth_parent(spark, sf):
    return golden.every_nth(sections(spark, sf).select("parent_id"), "parent_id", 50).select("parent_id", "rn")


@query(sql(SECTIONS, "SELECT parent_id, list_aggregate(list(coalesce(title, '')) OVER (PARTITION BY source ORDER BY parent_id ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), 'string_agg', '; ') AS titles FROM sec"))
def title_window(spark, sf):
    s = sections(spark, sf).select("parent_id", "source", F.coalesce("title", F.lit("")).alias("title"))
    return golden.following(s, "source", "parent_id", "title", 12, "t").select("parent_id", F.array_join("t", "; ").alias("titles"))


@query("SELECT DISTINCT source, left(regexp_replace(regexp_replace(lower(trim(string_split(source, ' - ')[1], ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 24) AS slug FROM sections")
def source_slug(spark, sf):
    return table(spark, sf, "sections").select("source", T.slug(F.col("source")).alias("slug")).distinct()


@query(sql(QA, "SELECT version, count(*) FILTER (WHERE type = 'factual') AS factual, count(*) FILTER (WHERE type = 'paraphrase') AS paraphrase, count(*) FILTER (WHERE type = 'negative') AS negative FROM q GROUP BY 1"))
def type_counts(spark, sf):
    n = lambda k: F.count_if(F.col("type") == k).alias(k)
    return questions(spark, sf).groupBy("version").agg(n("factual"), n("paraphrase"), n("negative"))


@query(sql(SECTIONS + QA + _GOLD, "SELECT q.id, max(CASE WHEN instr(lower(sec.text), lower(trim(_answer, ' '))) > 0 THEN instr(lower(sec.text), lower(trim(_answer, ' '))) - 1 ELSE -1 END)::BIGINT AS answer_pos FROM q JOIN lab ON lab.id = q.id JOIN sec ON sec.parent_id = lab.parent_id WHERE length(trim(_answer, ' ')) > 0 GROUP BY 1"))
def answer_offset(spark, sf):
    j = labels(spark, sf).join(questions(spark, sf).where("length(trim(_answer)) > 0").select("id", "_answer"), "id").join(sections(spark, sf).select("parent_id", "text"), "parent_id")
    return j.groupBy("id").agg(F.max(F.instr(F.lower("text"), F.lower(F.trim("_answer"))) - 1).cast("bigint").alias("answer_pos"))


# ---- vectors
_DENSE = """
dq AS (SELECT vec_id AS qid, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
ds AS (SELECT qid, ql, vec_id, label, round(list_sum(list_transform(list_zip(e.embedding, dq.qe), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM embeddings e, dq WHERE vec_id != qid),
"""


def _dense(spark, sf) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows; blocks of queries meet the vectors in one pass. The queries' share of the table is
    fixed, so this is the exact reference for small collections; larger ones search by lists."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"), F.col("label").alias("ql"))
    return e.join(q, F.col("vec_id") != F.col("qid")).select("qid", "ql", "vec_id", "label", F.round(retrieve.dot(F.col("embedding"), F.col("qe")), 6).alias("score"))


@query(sql(_DENSE, "SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ds) WHERE rank <= 10"))
def dense_topk(spark, sf):
    return retrieve.ranked(_dense(spark, sf), "qid", [F.desc("score"), F.col("vec_id")], most=10).select("qid", "vec_id", "score", "rank")


@query(sql(_DENSE, "SELECT qid, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS rank FROM (SELECT qid, label, max(score) AS score FROM ds GROUP BY 1, 2)"))
def dense_parent_rank(spark, sf):
    s = _dense(spark, sf).groupBy("qid", "label").agg(F.max("score").alias("score"))
    return retrieve.ranked(s, "qid", [F.desc("score"), F.col("label")])


@query(sql(_DENSE, "SELECT round(avg(CAST(label = ql AS DOUBLE)), 6) AS precision_at_10, count(DISTINCT qid) AS queries FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ds) WHERE rank <= 10"))
def dense_label_precision(spark, sf):
    top = retrieve.ranked(_dense(spark, sf), "qid", [F.desc("score"), F.col("vec_id")], most=10)
    return top.agg(F.round(F.avg((F.col("label") == F.col("ql")).cast("double")), 6).alias("precision_at_10"), F.count_distinct("qid").alias("queries"))


@query("SELECT c.name, e.id IS NOT NULL AS there, len(e.embedding)::BIGINT AS dim, count(*) AS vectors, count(DISTINCT e.id) AS ids, count(DISTINCT json_extract_string(cmetadata, '$.parent_id')) AS parents FROM langchain_pg_collection c LEFT JOIN langchain_pg_embedding e ON e.collection_id = c.uuid GROUP BY 1, 2, 3")
def vector_integrity(spark, sf):
    j = table(spark, sf, "langchain_pg_collection").join(table(spark, sf, "langchain_pg_embedding"), F.col("collection_id") == F.col("uuid"), "left")
    agg = j.groupBy("name", F.col("id").isNotNull().alias("there"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dim"))
    return agg.agg(F.count("*").alias("vectors"), F.count_distinct("id").alias("ids"), F.count_distinct(F.get_json_object("cmetadata", "$.parent_id")).alias("parents"))


@query("SELECT DISTINCT e.id, json_extract_string(cmetadata, '$.source') AS source FROM langchain_pg_embedding e JOIN langchain_pg_collection c ON e.collection_id = c.uuid WHERE c.name = 'rag_lab__mini_l6' AND json_extract_string(cmetadata, '$.source') LIKE 'sec/%'")
def metadata_filter(spark, sf):
    c = table(spark, sf, "langchain_pg_collection").where("name = 'rag_lab__mini_l6'")
    e = table(spark, sf, "langchain_pg_embedding").withColumn("source", F.get_json_object("cmetadata", "$.source")).where(F.col("source").startswith("sec/"))
    return e.join(c, F.col("collection_id") == F.col("uuid")).select("id", "source").distinct()


@query("SELECT collection_id, id, replace(max(coalesce(document, '')), chr(0), '') AS document, count(*) AS deliveries FROM langchain_pg_embedding GROUP BY 1, 2")
def vector_upsert(spark, sf):
    return table(spark, sf, "langchain_pg_embedding").groupBy("collection_id", "id").agg(F.regexp_replace(F.max(F.coalesce("document", F.lit(""))), "\\x00", "").alias("document"), F.count("*").alias("deliveries"))


@query(sql(SECTIONS + QA + _GOLD + _SUB, "SELECT 'sections' AS name, (SELECT count(*) FROM sub) AS got, (SELECT target FROM nn) AS want, (SELECT count(*) FROM sub) >= (SELECT target FROM nn) AS ok UNION ALL SELECT 'gold', (SELECT count(*) FROM sub WHERE gold), (SELECT count(*) FROM g), (SELECT count(*) FROM sub WHERE gold) >= (SELECT count(*) FROM g)"))
def subset_checks(spark, sf):
    s, lab = sections(spark, sf), labels(spark, sf)
    sub = golden.anchored_sample(s, lab, "parent_id", 0.4, "s7")
    a = sub.agg(F.count("*").alias("got")).crossJoin(s.agg(F.floor(F.count("*") * 0.4 + 0.5).cast("bigint").alias("want"))).select(F.lit("sections").alias("name"), "got", "want")  # single rows
    b = sub.where("gold").agg(F.count("*").alias("got")).crossJoin(s.join(lab.select("parent_id").distinct(), "parent_id", "left_semi").agg(F.count("*").alias("want"))).select(F.lit("gold").alias("name"), "got", "want")
    return a.unionByName(b).withColumn("ok", F.col("got") >= F.col("want"))


# ---- loop
STEPS = 2


def step_terms(step: int) -> str:
    c = f"list_distinct(list_filter({tok('query')}, lambda x: NOT list_contains({STOP}, x)))"
    return (f"qt{step} AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('query')}) AS term FROM questions) GROUP BY 1, 2)," if step == 0 else f"qt{step} AS (SELECT qid, unnest({c if step == 1 else f'list_filter({c}, lambda x: length(x) > 6)'}) AS term, 1 AS qtf FROM questions),")


def _loop_sql() -> str:
    out = R.WINDOWS + "qc AS (SELECT qid, unnest(" + content("query") + ") AS term FROM questions), qn AS (SELECT qid, count(*) AS nq FROM qc GROUP BY 1), dt AS (SELECT doc_id, unnest(list_distinct(" + tok("text") + ")) AS term FROM documents WHERE text IS NOT NULL),"
    for s in range(STEPS + 1):
        out += step_terms(s) + R.BM25.replace("bm AS", f"bm{s} AS").replace("qt JOIN", f"qt{s} JOIN") + R.parent_rank(f"lp{s}", f"bm{s}")
        out += f"""
gr{s} AS (SELECT lp{s}.qid, lp{s}.doc_id, round(coalesce(any_value(met), 0) / any_value(nq)::DOUBLE, 6) AS o FROM lp{s} JOIN qn USING (qid) LEFT JOIN (SELECT qid, doc_id, count(*) AS met FROM qc JOIN dt USING (term) GROUP BY 1, 2) m ON m.qid = lp{s}.qid AND m.doc_id = lp{s}.doc_id WHERE lp{s}.rank <= 5 GROUP BY 1, 2),
kp{s} AS (SELECT qid, count(*) AS kept FROM gr{s} WHERE o >= 0.5 GROUP BY 1),"""
    won = "CASE " + " ".join(f"WHEN k{s}.kept IS NOT NULL THEN {s}" for s in range(STEPS + 1)) + " END"
    kept = "coalesce(" + ", ".join(f"k{s}.kept" for s in range(STEPS + 1)) + ", 0)"
    joins = " ".join(f"LEFT JOIN kp{s} k{s} ON k{s}.qid = q.qid" for s in range(STEPS + 1))
    return out + f"lw AS (SELECT q.qid, {won} AS won, {kept} AS kept FROM questions q {joins}), lo AS (SELECT qid, coalesce(won, {STEPS})::BIGINT AS steps, kept, won IS NULL AS refused, repeat('retrieve>grade>refine>', coalesce(won, {STEPS})) || 'retrieve>grade' || CASE WHEN won IS NULL THEN '>refuse' ELSE '>generate' END AS trace FROM lw),"


def _graded(c: R.Corpus, step: int) -> DataFrame:
    t = T.content_terms(F.col("query"))
    terms = c.terms_of if step == 0 else c.questions.select("qid", F.explode(t if step == 1 else F.filter(t, lambda x: F.length(x) > 6)).alias("term")).withColumn("qtf", F.lit(1))
    top = c.parents_by("bm25", terms).where("rank <= 5")
    j = top.join(c.questions.select("qid", t.alias("a")), "qid").join(c.parents, "doc_id")
    o = F.round(T.overlap(F.col("a"), T.tokens(F.col("text"))), 6)
    return j.select("qid", "doc_id", "rank", o.alias("overlap"), loop.verdicts(o, 0.8, 0.5).alias("verdict")).where("overlap is not null")


_LOOP = _loop_sql()


@query(sql(_LOOP, "SELECT qid, doc_id, o AS overlap, CASE WHEN o >= 0.8 THEN 'correct' WHEN o >= 0.5 THEN 'ambiguous' ELSE 'incorrect' END AS verdict FROM gr0"))
def loop_grade(spark, sf):
    return _graded(R.Corpus(spark, sf), 0).drop("rank")


@query(sql(_LOOP, "SELECT * FROM lo"))
def loop_trace(spark, sf):
    c = R.Corpus(spark, sf)
    return loop.run_loop(c.questions, lambda s: _graded(c, s), "qid", STEPS)


_GATE = "SELECT count(*) AS questions, count(*) FILTER (WHERE refused) AS refused, round(100.0::DOUBLE * count(*) FILTER (WHERE refused AND g.qid IS NULL) / nullif(count(*) FILTER (WHERE g.qid IS NULL), 0), 1) AS correct_refusal_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE refused AND g.qid IS NOT NULL) / nullif(count(*) FILTER (WHERE g.qid IS NOT NULL), 0), 1) AS false_refusal_pct FROM lo LEFT JOIN (SELECT DISTINCT qid FROM gold) g USING (qid)"


@query(sql(_LOOP + R.GOLD, _GATE))
def loop_gate_summary(spark, sf):
    c = R.Corpus(spark, sf)
    lo = loop.run_loop(c.questions, lambda s: _graded(c, s), "qid", STEPS).join(c.gold().select("qid", F.lit(True).alias("pos")).distinct(), "qid", "left")
    pos, ref = F.col("pos").isNotNull(), F.col("refused")
    pct = lambda a, b: F.round(100.0 * F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 1)
    return lo.agg(F.count("*").alias("questions"), F.count_if(ref).alias("refused"), pct(ref & ~pos, ~pos).alias("correct_refusal_pct"), pct(ref & pos, pos).alias("false_refusal_pct"))


# ---- spend: events as a ledger of calls, their type as the model
_CALLS = "calls AS (SELECT event_id, event_type AS model, CAST(user_id % 1000 AS BIGINT) AS tin, CAST(event_id % 100 AS BIGINT) AS tout, event_id % 7 = 0 AS hit, user_id FROM events), pr AS (SELECT * FROM (VALUES ('c', 1.0::DOUBLE, 5.0::DOUBLE), ('cl', 2.0::DOUBLE, 10.0::DOUBLE), ('v', 4.0::DOUBLE, 20.0::DOUBLE)) t(prefix, pin, pout)), pm AS (SELECT model, coalesce(max_by(pin, length(prefix)), 4.0) AS pin, coalesce(max_by(pout, length(prefix)), 20.0) AS pout FROM (SELECT DISTINCT model FROM calls) LEFT JOIN pr ON starts_with(model, prefix) GROUP BY 1), cost AS (SELECT calls.*, CASE WHEN hit THEN 0.0 ELSE (tin * pin + tout * pout) / 1e6 END AS usd FROM calls JOIN pm USING (model)),"


def _calls(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 1000).alias("tin"), (F.col("event_id") % 100).alias("tout"), (F.col("event_id") % 7 == 0).alias("hit"), "user_id")
    prices = spark.createDataFrame([("c", 1.0, 5.0), ("cl", 2.0, 10.0), ("v", 4.0, 20.0)], "prefix string, price_in double, price_out double")
    return loop.priced(e, prices, "model", "tin", "tout", F.col("hit"))


@query(sql(_CALLS, "SELECT coalesce(model, 'TOTAL') AS model, count(*) FILTER (WHERE NOT hit) AS calls, count(*) FILTER (WHERE hit) AS cache_hits, coalesce(sum(tin) FILTER (WHERE NOT hit), 0)::BIGINT AS tokens_in, coalesce(sum(tout) FILTER (WHERE NOT hit), 0)::BIGINT AS tokens_out, round(sum(usd), 6) AS usd FROM cost GROUP BY ROLLUP (model)"))
def spend_ledger(spark, sf):
    c, paid = _calls(spark, sf), ~F.col("hit")
    s = lambda k: F.coalesce(F.sum(F.when(paid, F.col(k))), F.lit(0))
    out = c.rollup("model").agg(F.count_if(paid).alias("calls"), F.count_if(~paid).alias("cache_hits"), s("tin").alias("tokens_in"), s("tout").alias("tokens_out"), F.round(F.sum("usd"), 6).alias("usd"))
    return out.withColumn("model", F.coalesce("model", F.lit("TOTAL")))


@query(sql(_CALLS, "SELECT user_id, count(*) AS calls, round(sum(usd), 6) AS spent, count(*) FILTER (WHERE round(bef, 9) < 0.02) AS allowed FROM (SELECT *, coalesce(sum(usd) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM cost) GROUP BY 1"))
def spend_cap(spark, sf):
    c = loop.within_budget(_calls(spark, sf), "event_id", 0.02, "user_id")
    return c.groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("usd"), 6).alias("spent"), F.count_if("allowed").alias("allowed"))


@query(sql(_CALLS, "SELECT user_id, round(sum(usd) FILTER (WHERE rn <= 10) / least(10, count(*)) * count(*), 6) AS projected, round(sum(usd), 6) AS spent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM cost) GROUP BY 1"))
def spend_projection(spark, sf):
    c = _calls(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return c.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("rn") <= 10, F.col("usd"))) / F.least(F.lit(10), F.count("*")) * F.count("*"), 6).alias("projected"), F.round(F.sum("usd"), 6).alias("spent"))


@query("SELECT DISTINCT sha256('m1' || chr(0) || query) AS fp FROM qa ANTI JOIN (SELECT DISTINCT query AS cached FROM qa_slice_bm25) s ON s.cached = qa.query WHERE query IS NOT NULL")
def cache_replay(spark, sf):
    fp = T.fingerprint(F.lit("m1"), F.col("query")).alias("fp")
    return loop.work_left(table(spark, sf, "qa").where("query is not null").select(fp), table(spark, sf, "qa_slice_bm25").where("query is not null").select(fp).distinct(), "fp")


# ---- streams
@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf):
    return ingest.run_to_table(ingest.hourly(ingest.event_stream(spark, sf)), ["hour", "event_type"])


# ---- more sections, samples and fingerprints
@query("SELECT doc_id, grp, heading, CASE WHEN heading IS NOT NULL AND NOT starts_with(b, '## ' || heading) THEN '## ' || heading || chr(10) || chr(10) || b ELSE b END AS body FROM (SELECT doc_id, grp, trim(string_agg(line, chr(10) ORDER BY line_no), ' ') AS b, CASE WHEN starts_with(min_by(line, line_no), '## ') THEN trim(substr(min_by(line, line_no), 4, 10000), ' ') END AS heading FROM (SELECT doc_id, line_no, line, sum(CAST(starts_with(line, '## ') AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM (SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))) GROUP BY 1, 2) WHERE (heading IS NULL OR NOT contains(lower(heading), 'table of contents')) AND length(b) > 0")
def markdown_sections(spark, sf):
    return chunking.markdown_sections(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")


_SUBHEAD = r"^\s*([A-Z])\.?\s+([A-Z][A-Za-z][^\n]{0,50})$"
_RESIZED = _NUM + f"""
bl AS (SELECT doc_id, section_idx, title, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM nn WHERE length(text) > 5000)),
bt AS (SELECT *, CASE WHEN regexp_matches(line, '{_SUBHEAD}') AND NOT regexp_matches(trim(line, ' '), '[,;:]$') THEN regexp_extract(line, '{_SUBHEAD}', 1) END AS letter FROM bl),
bh AS (SELECT *, letter IS NOT NULL AND (bef IS NULL OR letter > bef) AS head FROM (SELECT *, max(letter) OVER (PARTITION BY doc_id, section_idx ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM bt)),
bg AS (SELECT *, sum(head::BIGINT) OVER (PARTITION BY doc_id, section_idx ORDER BY line_no) AS frag FROM bh),
rf AS (SELECT doc_id, section_idx AS s, 0 AS frag, title, text AS t FROM nn WHERE length(text) <= 5000 UNION ALL
  SELECT * FROM (SELECT doc_id, section_idx, frag, min_by(CASE WHEN head THEN trim(line, ' ') ELSE title END, line_no) AS title, string_agg(line, chr(10) ORDER BY line_no) AS t FROM bg GROUP BY 1, 2, 3) WHERE length(trim(t, ' ')) > 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY frag) AS rn FROM rf),
r2 AS (SELECT *, sum(CAST(rn = 1 OR length(t) >= 500 AS BIGINT)) OVER (PARTITION BY doc_id, s ORDER BY frag) AS isle FROM r1),
r3 AS (SELECT doc_id, s, isle, string_agg(t, chr(10) ORDER BY frag) AS t, count(*) AS n FROM r2 GROUP BY 1, 2, 3),
r4 AS (SELECT *, CASE WHEN max(CASE WHEN isle = 1 THEN length(t) < 500 END) OVER (PARTITION BY doc_id, s) AND isle <= 2 THEN 1 ELSE isle END AS place FROM r3),
r5 AS (SELECT doc_id, s, place, string_agg(t, chr(10) ORDER BY isle) AS t, sum(n) AS n FROM r4 GROUP BY 1, 2, 3),
r6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY place) AS fragment, coalesce(sum(n) OVER (PARTITION BY doc_id, s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start, count(*) OVER (PARTITION BY doc_id, s) AS parts FROM r5),
r7 AS (SELECT r6.*, r1.title FROM r6 JOIN r1 ON r1.doc_id = r6.doc_id AND r1.s = r6.s AND r1.rn = r6.start),
r8 AS (SELECT *, parts = 1 AND length(t) < 500 AND row_number() OVER (PARTITION BY doc_id ORDER BY s, fragment) > 1 AS runt FROM r7),
r9 AS (SELECT *, sum((NOT runt)::BIGINT) OVER (PARTITION BY doc_id ORDER BY s, fragment) AS land FROM r8),
ra AS (SELECT doc_id, land, string_agg(t, chr(10) ORDER BY s, fragment) AS text, min_by(title, s * 10000 + fragment) AS title, min_by(fragment, s * 10000 + fragment) AS fragment, min(s) AS s FROM r9 GROUP BY 1, 2),
rs AS (SELECT doc_id, CASE WHEN j > 0 THEN s || '#' || chr((64 + j)::INTEGER) ELSE s::VARCHAR END AS section_idx, title, text, length(text) AS char_len FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY fragment) - 1 AS j FROM ra)),
"""


@query(sql(_RESIZED, "SELECT doc_id, section_idx, title, text, char_len FROM rs WHERE char_len >= 40"))
def resized_sections(spark, sf):
    """Numbered sections resized; slivers are folded into their neighbours first, and dropped only where they are still slivers after that."""
    s = chunking.numbered_sections(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", least=1)
    return chunking.resize_sections(s, "doc_id").where("char_len >= 40")


@query(sql(_RESIZED, "SELECT doc_id, count(*) FILTER (WHERE runt) AS runts, count(DISTINCT land) AS sections FROM r9 GROUP BY 1"))
def runt_merge(spark, sf):
    """How many sections were left with one short fragment and folded into the one before."""
    s = chunking.numbered_sections(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", least=1)
    per = chunking.fragments(s, "doc_id").groupBy("doc_id")
    return per.agg(F.count_if("runt").alias("runts"), F.count_distinct("isle").alias("sections"))


@query(sql(SECTIONS, "SELECT parent_id FROM sec ORDER BY sha256('s1|' || parent_id) LIMIT 20"))
def random_sample(spark, sf):
    return sections(spark, sf).select("parent_id").orderBy(golden.hash_order("s1", "parent_id")).limit(20)


@query("SELECT source, count(*) AS n, sum(('0x' || left(sha256(doc_id::VARCHAR || chr(0) || coalesce(text, '')), 8))::BIGINT)::BIGINT AS fingerprint FROM documents GROUP BY 1")
def corpus_fingerprint(spark, sf):
    """A fingerprint of every source's texts that needs no order: the sum of the rows' hashes, partially added up in each task."""
    h = F.conv(F.substring(T.fingerprint(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 1, 8), 16, 10).cast("bigint")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(h).alias("fingerprint"))


@query(sql(QA, "SELECT id, fp, keep FROM (SELECT id, sha256(type || chr(0) || query) AS fp, _gen IS NOT NULL AS keep FROM q WHERE query IS NOT NULL AND type IS NOT NULL)"))
def generation_fingerprints(spark, sf):
    """Of every kind of question: what it was made of, and whether what was made is kept."""
    q = questions(spark, sf).where("query is not null and type is not null")
    return q.select("id", T.fingerprint(F.col("type"), F.col("query")).alias("fp"), F.col("_gen").isNotNull().alias("keep"))


@query(sql(QA, "SELECT n.id AS negative_id, n._near_miss_of AS parent_id, count(o.id) AS answerable_by FROM q n LEFT JOIN q o ON o.type != 'negative' AND list_contains(o.relevant_parent_ids, n._near_miss_of) WHERE n.type = 'negative' AND n._near_miss_of IS NOT NULL GROUP BY 1, 2"))
def near_miss_negatives(spark, sf):
    q = questions(spark, sf)
    n = q.where("type = 'negative' and _near_miss_of is not null").select(F.col("id").alias("negative_id"), F.col("_near_miss_of").alias("parent_id"))
    o = q.where("type != 'negative'").select("id", F.explode(F.array_distinct("relevant_parent_ids")).alias("parent_id"))
    return n.join(o, "parent_id", "left").groupBy("negative_id", "parent_id").agg(F.count("id").alias("answerable_by"))
