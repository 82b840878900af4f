"""Column functions over text: tokens, words, overlap and the predicates on questions and passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the language of the pipelines splits on it, Unicode spaces included.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Words a query may drop, and patterns of titles and questions to reject.
STOP_WORDS = (
    "the a an of to in for on and or is are was were be been being this that these those with as by at from it its their his her what which who whom how why when where "
    "does do did can could would should will may might has have had not no than then into about over under between"
).split()
TITLE_REJECT = "content|reference|bibliograph|acknowledg|appendix"
QUESTION_REJECT = r"\b(the|this) (passage|document|filing|exhibit|text|section|sec filing|company)\b|accession|\bcik\b|sec/\d|arxiv/\d|original:|reword|rewrite|^\s*\{"


def words(c: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; accents divide words."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct tokens without stop words, in order of appearance."""
    return F.array_except(tokens(F.coalesce(c, F.lit(""))), F.array(*[F.lit(w) for w in stop]))


def overlap(part: Column, whole: Column) -> Column:
    """Share of part's terms that whole has; null where part has none."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def space_ratio(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / F.greatest(F.lit(1), F.length(c))


def is_clean(c: Column, most: float = 0.2) -> Column:
    """No invisible formatting characters, and at most a share of characters outside ASCII."""
    foreign = F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) / F.greatest(F.lit(1), F.length(c))
    return ~c.rlike(r"\p{Cf}") & (foreign <= most)


def is_good_question(c: Column) -> Column:
    return (F.length(c) > 0) & (F.length(c) < 300) & is_clean(c) & ~F.lower(c).rlike(QUESTION_REJECT)


def squeezed(c: Column) -> Column:
    """One line: white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def short_name(c: Column) -> Column:
    return F.trim(F.split(c, " - ").getItem(0))


def slug(c: Column, most: int = 24) -> Column:
    s = F.regexp_replace(F.lower(short_name(c)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def document_key(parent_id: Column) -> Column:
    """A parent's document: all before the last '#'."""
    return F.regexp_replace(parent_id, "#[^#]*$", "")
