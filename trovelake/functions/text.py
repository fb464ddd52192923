"""Text scalars as Catalyst column expressions (no Python workers involved)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trovelake import fixed_values as fv

# Java's Unicode-aware \s plus the four separators Python's str.strip() also drops.
_WS = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)\A{_WS}+|{_WS}+\z"
_TOKENS = f"(?iu){fv.TOKEN_PATTERN}"
# Replacements that clean a text, in order; the column and the SQL function both follow them.
_CLEANING = (
    (fv.CONTROL_CHARS, ""),
    (r"\r\n?", "\n"),
    (r"[ \t]+", " "),
    (r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n"),
    (r"\n{3,}", "\n\n"),
    (_EDGES, ""),
)
# Found in every text that cleaning changes: a control character, tab or carriage return, blank
# space at an end, or next to other blank space unless that makes one or two line ends.
_UNCLEAN = r"(?U)[\x00-\x09\x0b-\x1f\x7f]|\A\s|\s(?:\z|[\s&&[^\n]]|(?<=[^\n])\n|(?<=\n)\n\n)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    Inside a lambda of ``use`` a plain expression would be evaluated per element; a
    lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; only a text that has some there is searched for it."""

    def stripped(t: Column) -> Column:
        ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
        return F.when(F.rlike(ends, F.lit(f"(?U){_WS}")), F.regexp_replace(t, _EDGES, "")).otherwise(t)

    return let(text, stripped)


def clean_text(text: Column) -> Column:
    """Drop control characters, unify line ends, squeeze blanks, trim lines and text; a clean text is read once."""

    def cleaned(t: Column) -> Column:
        clean = t
        for pattern, replacement in _CLEANING:
            clean = F.regexp_replace(clean, pattern, replacement)
        return F.when(F.rlike(t, F.lit(_UNCLEAN)), clean).otherwise(t)

    return let(text, cleaned)


def tokenize(text: Column) -> Column:
    """All Latin/Cyrillic/digit/percent runs, lower-cased, ё folded into е; order and repeats kept."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)),
        lambda t: F.replace(F.lower(t), F.lit("ё"), F.lit("е")),
    )


def _non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def split_sentences(text: Column) -> Column:
    """Sentences ending in . ! or ? (punctuation kept), as used when answering."""
    flat = F.translate(text, "\n", " ")
    return _non_empty(F.split(flat, rf"(?U)(?<=[.!?]){_WS}+"))


def split_on_period(text: Column) -> Column:
    """Sentences cut at the literal '. ' (delimiter dropped), as used when compressing."""
    flat = F.translate(text, "\n", " ")
    return _non_empty(F.split(flat, r"\. "))


def overlap_count(left: Column, right: Column) -> Column:
    """Number of distinct tokens two token arrays share."""
    return F.size(F.array_intersect(left, right))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Shared distinct tokens over the distinct tokens of ``left``; 0 when ``left`` is empty."""
    shared = overlap_count(left, right).cast("double")
    return F.when(F.size(left) > 0, shared / F.size(F.array_distinct(left))).otherwise(F.lit(0.0))


def citation(source: Column, doc_id: Column, chunk_id: Column, section: Column) -> Column:
    """``source / section`` with doc_id, then chunk_id, standing in for a missing source."""
    return F.concat(F.coalesce(source, doc_id, chunk_id), F.lit(" / "), F.coalesce(section, F.lit("")))


def extract_citations(answer: Column) -> Column:
    """Bodies of all [...] groups of an answer."""
    return F.regexp_extract_all(answer, F.lit(fv.CITATION_PATTERN), F.lit(1))


def register_sql_functions(spark: SparkSession) -> None:
    """Expose clean_text, tokenize, token_overlap and vector_cosine to SQL users.

    They are SQL expression functions, so Catalyst inlines them into the plan.
    """
    clean = "text"
    for pattern, replacement in _CLEANING:
        newline = replacement.replace("\n", "\\n")
        clean = f"regexp_replace({clean}, r'{pattern}', '{newline}')"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION clean_text(text STRING) RETURNS STRING RETURN {clean}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tokenize(text STRING) RETURNS ARRAY<STRING> RETURN "
        f"transform(regexp_extract_all(text, r'{_TOKENS}', 0), t -> replace(lower(t), 'ё', 'е'))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_overlap(a ARRAY<STRING>, b ARRAY<STRING>) "
        "RETURNS DOUBLE RETURN CASE WHEN size(a) > 0 THEN "
        "size(array_intersect(a, b)) / CAST(size(array_distinct(a)) AS DOUBLE) ELSE 0D END"
    )
    norm = "sqrt(aggregate({v}, 0D, (s, x) -> s + x * x))"
    dot = "aggregate(zip_with(a, b, (x, y) -> coalesce(x * y, 0D)), 0D, (s, x) -> s + x)"
    na, nb = norm.format(v="a"), norm.format(v="b")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) "
        f"RETURNS DOUBLE RETURN CASE WHEN {na} > 0 AND {nb} > 0 THEN {dot} / ({na} * {nb}) ELSE 0D END"
    )
