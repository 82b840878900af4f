"""Readers of raw files; parsers are given by the caller, those of plain text, HTML and simple PDF files are here."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.chunking import lane_of
from quillmark.sources.pdf import page_texts

SUFFIXES = ("pdf", "htm", "html", "md", "txt")


def files(spark: SparkSession, root: str, only: str | None = None, limit: int | None = None) -> DataFrame:
    """(doc_id, source, path, lane, content) of all files below root/source/ with a known suffix, hidden ones left out; doc_id is source/stem. `only` names one
    source, whose folder alone is listed; `limit` keeps the first files in the order of their paths."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{only}" if only else root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    source = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    d = d.where(~name.startswith(".") & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    if limit is not None:
        d = d.select("path").orderBy("path").limit(limit).join(d, "path")  # contents do not travel to be ordered
    return d.select(F.concat_ws("/", source, F.regexp_replace(name, r"\.[^.]+$", "")).alias("doc_id"), source.alias("source"), "path", lane_of(source, F.col("path")).alias("lane"), "content")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_no, text) of the Markdown files in a folder, numbered from 1 in the order of their paths; whole files, decoded as UTF-8."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(root).select("path", F.decode("content", "UTF-8").alias("text"))
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("path"))
    return d.select("path").select("path", number.alias("file_no")).join(d, "path")  # paths alone are numbered in one task


def plain_text(content: bytes) -> list[str]:
    return [content.decode("utf-8", "replace")]


def html_text(content: bytes) -> list[str]:
    """A page's text: scripts, styles, navigation and comments gone, blocks on lines of their own, entities decoded."""
    t = re.sub(r"(?is)<(script|style|nav)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", content.decode("utf-8", "replace"))
    t = re.sub(r"(?i)<(?:br|/?(?:p|div|li|tr|h[1-6]|table|ul|ol|section|article|blockquote|pre))\b[^>]*>", "\n", t)
    t = html.unescape(re.sub(r"<[^>]+>", " ", t))
    return ["\n".join(x for line in t.split("\n") if (x := " ".join(line.split())))]


PARSERS = {"md": plain_text, "html": html_text, "pdf": page_texts}  # scanned pages need a parser of the caller's


def plain_html(c: F.Column) -> F.Column:
    """Text of HTML: scripts, styles and comments gone, tags to spaces, common entities decoded, white space collapsed."""
    t = F.regexp_replace(c, r"(?is)<(script|style|nav)\b[^>]*>.*?</(script|style|nav)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def parsed(raw: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(documents, failures): pages of each file by its lane's parser, joined by line breaks; files whose parser fails or is missing go to the failures with
    the reason, and never stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, lane, content in zip(b["doc_id"], b["lane"], b["content"]):
                try:
                    out.append((i, lane, "\n".join(parsers[lane](bytes(content))), None))
                except Exception as e:  # noqa: BLE001
                    out.append((i, lane, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["doc_id", "lane", "text", "reason"])

    ran = raw.select("doc_id", "lane", "content").mapInPandas(run, "doc_id string, lane string, text string, reason string")
    return ran.where("reason is null").drop("reason"), ran.where("reason is not null").select("doc_id", "reason")
