"""The queries pN_... of the training-data operators; SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import leaks, neardup, packing, pairs, pii, quality, scans, splitting, vectors
from quillmark.session import table


def section_key() -> F.Column:
    return F.concat_ws("#", "source", "section_idx")


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sections").withColumn("parent_id", section_key())


def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    a = splitting.pieces(sections(spark, sf), "parent_id", "text", 2000, 200)
    b = splitting.pieces(table(spark, sf, "chunks"), "id", "raw_text", 450, 80)
    return a.select(F.lit("sections").alias("tbl"), F.col("parent_id").alias("item_id"), *a.columns[1:]).unionByName(b.select(F.lit("chunks").alias("tbl"), F.col("id").alias("item_id"), *b.columns[1:]))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(spark, sf).where("piece_no = 1").select("tbl", "item_id").where("item_id is not null").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(spark, sf)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.not_prose(sections(spark, sf), "parent_id", "text", "title")


def p2_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_statistics(sections(spark, sf), "parent_id", "text", "title")


def scanned_pages(spark: SparkSession, sf: str) -> DataFrame:
    a = sections(spark, sf).where(F.col("source").startswith("archive/")).select(F.lit("sections").alias("tbl"), F.col("parent_id").alias("item_id"), "text", F.lit(0).alias("first"), "source")
    b = table(spark, sf, "parse_failures").select(F.lit("parse_failures").alias("tbl"), F.col("doc_id").alias("item_id"), F.col("reason").alias("text"), F.lit(1).alias("first"), F.col("doc_id").alias("source"))
    return a.unionByName(b).distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.found(scans.repairs(scanned_pages(spark, sf)))


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    pages = scanned_pages(spark, sf)
    return scans.paragraphs(pages, scans.repairs(pages))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, df in (("sections", sections(spark, sf).select(F.col("parent_id").alias("id"), "text")), ("chunks", table(spark, sf, "chunks").select("id", "text"))):
        classes, pairs = neardup.near_duplicates(df, "id", "text", threshold=0.6, width=3, least_tokens=12)
        one = neardup.linked_keys(classes, pairs).select(F.lit(name).alias("tbl"), "key_a", "key_b")
        out = one if out is None else out.unionByName(one)
    return out


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with the group of its near-duplicates (five words, 0.8) and how many different texts it is linked with."""
    out = None
    for name, df in (("sections", sections(spark, sf).select(F.col("parent_id").alias("id"), "text")), ("chunks", table(spark, sf, "chunks").select("id", "text"))):
        one = neardup.groups(*neardup.near_duplicates(df, "id", "text")).select(F.lit(name).alias("tbl"), F.col("key").alias("item_id"), "group_id", "links")
        out = one if out is None else out.unionByName(one)
    return out


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, and into how many documents of how many sources."""
    d = table(spark, sf, "documents")
    found = leaks.leaks(d, table(spark, sf, "benchmark"), tokens=12, edits=0)
    return found.join(d.select("doc_id", "source"), "doc_id").groupBy("item_id").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.mutual(vectors.nearest(table(spark, sf, "langchain_pg_embedding"), "id", "collection_id", "embedding", k=10, min_cosine=0.9))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors.nearest(table(spark, sf, "langchain_pg_embedding"), "id", "collection_id", "embedding", k=10)
    return found.select(F.col("grp").alias("collection_id"), "id", "neighbour", F.round("cosine", 3).alias("cosine"), "rank")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "tokens", 2048)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.waste(p8_containers(spark, sf), 2048)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), tokens=12, edits=0).select("item_id", "doc_id")


def p9_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of twelve tokens of an item with at most three character edits, and how many."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), tokens=12, edits=3)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(table(spark, sf, "qa_slice_bm25"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Of the kinds asked for; bank accounts and cards are placeholders of p10_redacted alone."""
    found = pii.spans(table(spark, sf, "documents"), table(spark, sf, "name_list")).select("doc_id", "kind", "start_pos")
    return found.where(F.col("kind").isin("email", "phone", "id_number", "address", "name"))


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(table(spark, sf, "documents"), table(spark, sf, "name_list"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p8_containers": p8_containers, "p8_fill": p8_fill, "p3_found": p3_found, "p3_repaired": p3_repaired, "p2_found": p2_found, "p2_statistics": p2_statistics, "p10_found": p10_found, "p10_redacted": p10_redacted, "p6_found": p6_found, "p9_found": p9_found, "p4_found": p4_found, "p4_groups": p4_groups, "p9_report": p9_report, "p9_edited": p9_edited, "p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL: dict[str, str] = {
    "p1_found": """
SELECT DISTINCT 'sections' AS tbl, source || '#' || section_idx AS item_id FROM sections WHERE length(text) > 2000 AND source || '#' || section_idx IS NOT NULL
UNION ALL SELECT DISTINCT 'chunks', id FROM chunks WHERE length(raw_text) > 450 AND id IS NOT NULL""",
    "p9_found": """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, list_slice(w, k, k + 11) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
h AS (SELECT doc_id, list_slice(w, k, k + 11) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
SELECT DISTINCT item_id, doc_id FROM g JOIN h USING (g)""",
    "p4_found": """
WITH t AS (SELECT DISTINCT 'sections' AS tbl, source || '#' || section_idx AS k, text FROM sections UNION ALL SELECT DISTINCT 'chunks', id, text FROM chunks),
w AS (SELECT tbl, k, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t WHERE text IS NOT NULL AND k IS NOT NULL),
s AS (SELECT DISTINCT tbl, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT tbl, k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 12)),
f AS (SELECT tbl, g, count(*) AS df FROM s GROUP BY 1, 2),
n AS (SELECT tbl, k, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT s.tbl, s.k, s.g, n.n, row_number() OVER (PARTITION BY s.tbl, s.k ORDER BY f.df, s.g) AS rn FROM s JOIN f USING (tbl, g) JOIN n USING (tbl, k)),
p AS (SELECT tbl, k, g, n FROM r WHERE rn <= n - ceil(0.6 * n) + 1),
c AS (SELECT DISTINCT a.tbl, a.k AS key_a, b.k AS key_b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.tbl = b.tbl AND a.g = b.g AND a.k < b.k WHERE a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n)
SELECT c.tbl, key_a, key_b FROM c JOIN s x ON x.tbl = c.tbl AND x.k = key_a JOIN s y ON y.tbl = c.tbl AND y.k = key_b AND y.g = x.g
GROUP BY c.tbl, key_a, key_b, na, nb HAVING count(*) >= 0.6 * (na + nb - count(*)) - 1e-9""",
}
