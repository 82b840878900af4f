"""Documents into sections and overlapping windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import words

# What headings, item lines and the end of a text look like.
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*|[IVXL]+)\.?\s+([A-Z][A-Za-z][^\n]{0,60})$"
END_OF_CONTENT = r"(?i)^\s*(references|bibliography)\s*$"
ITEM_LINE = r"(?im)^[ \t]*(item[ \t]+\d+[a-z]?\.?)\s+([A-Z][^\n]{0,80})"
LEAST_ITEMS, LONGEST_DROPPED_FRONT = 3, 400


def word_windows(df: DataFrame, key: str, text: str, size: int, overlap: int, least: int, keep_first: bool) -> DataFrame:
    """(key, chunk_no, n_words, chunk): windows of `size` words every size - overlap; shorter than `least` are dropped, the first one too unless `keep_first`.
    A last window wholly inside its predecessor is kept. Texts without words have none."""
    step = size - overlap
    w = df.select(F.col(key), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    # the slices are made in the row and exploded, not the row's words repeated for every position
    cut = w.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda start: F.slice("w", start + 1, size))).alias("chunk_no", "p"))
    long_enough = F.size("p") >= least
    kept = cut.where(long_enough | (F.col("chunk_no") == 0) if keep_first else long_enough)
    return kept.select(key, F.col("chunk_no").cast("bigint").alias("chunk_no"), F.size("p").cast("bigint").alias("n_words"), F.array_join("p", " ").alias("chunk"))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), from 0."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def islands(lines: DataFrame, key: str, starts: Column) -> DataFrame:
    """Adds `grp`: 0 before the first line for which `starts` holds, then counting up."""
    return lines.withColumn("grp", F.sum(starts.cast("bigint")).over(Window.partitionBy(key).orderBy("line_no")))


def joined_lines(grouped: DataFrame, keys: list[str], sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), sep)


def heading_lines(lines: DataFrame, key: str) -> DataFrame:
    """Adds `heading`: numbered heading lines. A bare number has to exceed every bare number accepted before, which equals exceeding every candidate's."""
    num, title = F.regexp_extract("line", NUMBERED_HEADING, 1), F.trim(F.regexp_extract("line", NUMBERED_HEADING, 2))
    ok = F.col("line").rlike(NUMBERED_HEADING) & ~title.rlike("[,;:]$")
    bare = F.when(ok & num.rlike(r"^\d+$"), num.try_cast("bigint"))
    before = F.max(bare).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("heading", ok & (bare.isNull() | before.isNull() | (bare > before)))


def numbered_sections(df: DataFrame, key: str, text: str, least: int = 40) -> DataFrame:
    """(key, section_idx, title, text, char_len): sections at numbered headings; text before the first is the front matter; everything from a line that says
    references or bibliography on is dropped; numbers are given before sections shorter than `least` are dropped, so they have gaps."""
    lines = lines_of(df, key, text)
    w = Window.partitionBy(key)
    stop = F.min(F.when(F.col("line").rlike(END_OF_CONTENT), F.col("line_no"))).over(w)
    lines = lines.withColumn("stop", stop).where("stop is null or line_no < stop").drop("stop")
    parts = islands(heading_lines(lines, key), key, F.col("heading")).groupBy(key, "grp").agg(joined_lines(lines, [key]).alias("body"), F.min_by("line", "line_no").alias("top"), F.max("heading").alias("headed"))
    body = F.trim(F.regexp_replace("body", r"^\s+|\s+$", ""))
    named = parts.where(F.length(body) > 0).withColumn("section_idx", F.row_number().over(Window.partitionBy(key).orderBy("grp")) - 1)
    out = named.select(key, F.col("section_idx").cast("bigint").alias("section_idx"), F.when(F.col("headed"), F.trim("top")).otherwise("(front matter)").alias("title"), body.alias("text"))
    return out.withColumn("char_len", F.length("text").cast("bigint")).where(F.col("char_len") >= least)


def truncated(df: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """(key, body): texts up to the first match of `mark`; whole without one."""
    return df.select(key, F.regexp_replace(text, f"(?s){mark}.*$", "").alias("body"))


def paged_islands(lines: DataFrame, key: str, title: str, first_page: str, last_page: str) -> DataFrame:
    """(key, grp, title, page_start, page_end, lines) of lines (key, line_no, heading, title and pages): what stands before the first heading is the front matter;
    a section ends on the page where the next one begins, the last on its own last page."""
    g = islands(lines, key, F.col("heading")).groupBy(key, "grp")
    s = g.agg(F.min_by(F.coalesce(title, F.lit("")), "line_no").alias("top"), F.min(first_page).alias("page_start"), F.max(F.coalesce(last_page, first_page)).alias("last"), F.count("*").alias("lines"))
    nxt = F.lead("page_start").over(Window.partitionBy(key).orderBy("grp"))
    return s.select(key, "grp", F.when(F.col("grp") == 0, "(front matter)").otherwise(F.col("top")).alias("title"), "page_start", F.coalesce(nxt, "last").alias("page_end"), "lines")


def merge_stubs(fragments: DataFrame, group: str, order: str, text: str, least: int) -> DataFrame:
    """(group, fragment, n, text, char_len): fragments shorter than `least` fold into the one before, by their own length; a short first one takes the next."""
    f = fragments.select(group, F.col(order).alias("o"), F.col(text).alias("t")).withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("o")))
    keep = (F.col("rn") == 1) | (F.length("t") >= least)
    f = f.withColumn("isle", F.sum(keep.cast("bigint")).over(Window.partitionBy(group).orderBy("o")))
    parts = f.groupBy(group, "isle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("t"), F.count("*").alias("n"))
    first = F.max(F.when(F.col("isle") == 1, F.length("t") < least)).over(Window.partitionBy(group))
    parts = parts.withColumn("place", F.when(first & (F.col("isle") <= 2), 1).otherwise(F.col("isle")))
    merged = parts.groupBy(group, "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("isle", "t"))), lambda x: x["t"]), "\n").alias("text"), F.sum("n").alias("n"))
    out = merged.withColumn("fragment", F.row_number().over(Window.partitionBy(group).orderBy("place")).cast("bigint"))
    return out.select(group, "fragment", "n", "text", F.length("text").cast("bigint").alias("char_len"))


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters: split at the coarsest separator that occurs, finer ones inside parts that are too large, then merged with overlap."""
    sep = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if not sep else [p for p in text.split(sep) if p]
    out: list[str] = []
    run: list[str] = []
    total = 0

    def flush() -> None:
        nonlocal run, total
        if run:
            piece = sep.join(run).strip()
            if piece:
                out.append(piece)

    for p in parts:
        if len(p) > size and finer:
            flush()
            run, total = [], 0
            out += recursive_pieces(p, size, overlap, finer)
            continue
        extra = len(p) + (len(sep) if run else 0)
        if run and total + extra > size:
            flush()
            while run and (total > overlap or total + len(p) + len(sep) > size):
                total -= len(run[0]) + (len(sep) if len(run) > 1 else 0)
                run = run[1:]
        total += len(p) + (len(sep) if run else 0)
        run.append(p)
    flush()
    return out


def item_units(text: str, lane: str | None) -> list[tuple[str | None, str]]:
    """(title, body): filings are divided at their ITEM lines where there are at least three; what stands before the first is kept only if it is longer than
    400 characters. Other lanes are one unit."""
    if lane == "html":
        hits = list(re.finditer(ITEM_LINE, text))
        if len(hits) >= LEAST_ITEMS:
            ends = [h.start() for h in hits[1:]] + [len(text)]
            units: list[tuple[str | None, str]] = [("Front Matter", text[: hits[0].start()])] if hits[0].start() > LONGEST_DROPPED_FRONT else []
            return units + [(re.sub(r"\s+", " ", h.group()).strip()[:80], text[h.start() : e]) for h, e in zip(hits, ends)]
    return [(None, text)]


def chunk_documents(df: DataFrame, key: str, text: str, lane: str, parent: tuple[int, int] = (2000, 200), child: tuple[int, int] = (450, 80), least: int = 200) -> DataFrame:
    """(key, parent_no, title, parent_chars, child_no, child): units, parents and children of every document of at least `least` characters."""
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lane).alias("l")).where(F.length("t") >= least)
    kind = d.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, lane_ in zip(b["k"], b["t"], b["l"]):
                n = 0
                for title, body in item_units(t, lane_):
                    for p in recursive_pieces(body, *parent):
                        out += [(k, n, title, len(p), i, c) for i, c in enumerate(recursive_pieces(p, *child))]
                        n += 1
            yield pd.DataFrame(out, columns=[key, "parent_no", "title", "parent_chars", "child_no", "child"])

    return d.mapInPandas(run, f"{key} {kind}, parent_no bigint, title string, parent_chars bigint, child_no bigint, child string")


def lane_of(source: Column, path: Column) -> Column:
    """The parser of a file: its extension first, then its source."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    by_source = F.when(source == "sec", "html").when(source == "archive", "scanned").otherwise("pdf")
    return F.when(ext.isin(".htm", ".html"), "html").when(ext.isin(".md", ".txt"), "md").otherwise(by_source)


SUBHEAD = r"^\s*([A-Z])\.?\s+([A-Z][A-Za-z][^\n]{0,50})$"  # fixed value: a lettered heading of the second tier


def split_giants(sections: DataFrame, key: str, giant: int = 5000) -> DataFrame:
    """(key, section_idx, frag, title, text): sections longer than `giant` divided at lettered subheads whose letters climb; the part before the first keeps the
    section's title. Shorter sections are one fragment."""
    small = sections.where(F.length("text") <= giant).select(key, "section_idx", F.lit(0).cast("bigint").alias("frag"), "title", "text")
    big = sections.where(F.length("text") > giant).select(key, "section_idx", "title", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    letter = F.when(F.col("line").rlike(SUBHEAD) & ~F.trim("line").rlike("[,;:]$"), F.regexp_extract("line", SUBHEAD, 1))
    w = Window.partitionBy(key, "section_idx").orderBy("line_no")
    big = big.withColumn("letter", letter).withColumn("before", F.max("letter").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    big = big.withColumn("head", F.col("letter").isNotNull() & (F.col("before").isNull() | (F.col("letter") > F.col("before"))))
    big = big.withColumn("frag", F.sum(F.col("head").cast("bigint")).over(w))
    parts = big.groupBy(key, "section_idx", "frag").agg(joined_lines(big, [key]).alias("text"), F.min_by(F.when(F.col("head"), F.trim("line")).otherwise(F.col("title")), "line_no").alias("title"))
    return small.unionByName(parts.where(F.length(F.trim("text")) > 0).select(key, "section_idx", "frag", "title", "text"))


def fragments(sections: DataFrame, key: str, giant: int = 5000, stub: int = 500) -> DataFrame:
    """(key, s, fragment, title, text, parts, runt, isle): giants divided and stubs folded backward inside their section (a short first one takes the next and keeps
    its title); runt: the only fragment of its section, and short; isle numbers what runts are folded into."""
    frags = split_giants(sections, key, giant).withColumn("g", F.struct(key, "section_idx"))
    titles = frags.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("frag", "title"))).alias("titles"))
    merged = merge_stubs(frags, "g", "frag", "text", stub)
    firsts = frags.select("g", "frag", F.row_number().over(Window.partitionBy("g").orderBy("frag")).alias("rn"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    merged = merged.withColumn("start", start).join(firsts.select("g", F.col("rn").alias("start"), "frag"), ["g", "start"]).join(titles, "g")
    merged = merged.select("g", "fragment", F.element_at("titles", F.col("frag")).alias("title"), "text")
    per = merged.withColumn("parts", F.count("*").over(Window.partitionBy("g"))).select(F.col(f"g.{key}").alias(key), F.col("g.section_idx").alias("s"), "fragment", "title", "text", "parts")
    w = Window.partitionBy(key).orderBy("s", "fragment")
    runt = (F.col("parts") == 1) & (F.length("text") < stub) & (F.row_number().over(w) > 1)
    return per.withColumn("runt", runt).withColumn("isle", F.sum((~F.col("runt")).cast("bigint")).over(w))


def resize_sections(sections: DataFrame, key: str, giant: int = 5000, stub: int = 500) -> DataFrame:
    """(key, section_idx, title, text, char_len): the fragments, runts folded into the section before; ids g, g#A, g#B, ..."""
    per = fragments(sections, key, giant, stub)
    out = per.groupBy(key, "isle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "fragment", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min_by("title", F.struct("s", "fragment")).alias("title"), F.min("s").alias("s"), F.min_by("fragment", F.struct("s", "fragment")).alias("fragment"))
    ids = Window.partitionBy(key, "s").orderBy("fragment")
    j = F.row_number().over(ids) - 1
    name = F.concat(F.col("s").cast("string"), F.when(j > 0, F.concat(F.lit("#"), F.chr(64 + j))).otherwise(""))
    return out.select(key, name.alias("section_idx"), "title", "text", F.length("text").cast("bigint").alias("char_len"))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, grp, heading, body): divided at lines that begin with '## '; tables of contents are left out, and a body begins with its heading."""
    lines = islands(lines_of(df, key, text), key, F.col("line").startswith("## "))
    parts = lines.groupBy(key, "grp").agg(joined_lines(lines, [key]).alias("body"), F.min_by("line", "line_no").alias("top"))
    head = F.when(F.col("top").startswith("## "), F.trim(F.substring("top", 4, 10_000)))
    parts = parts.withColumn("heading", head).where(F.col("heading").isNull() | ~F.lower("heading").contains("table of contents"))
    body = F.trim("body")
    prefix = F.concat(F.lit("## "), "heading")
    return parts.select(key, "grp", "heading", F.when(F.col("heading").isNotNull() & ~body.startswith(prefix), F.concat(prefix, F.lit("\n\n"), body)).otherwise(body).alias("body")).where(F.length("body") > 0)
