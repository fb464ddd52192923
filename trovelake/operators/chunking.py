"""Chunking: each section becomes overlapping character windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import clean_text, strip
from trovelake.runtime import unnest


def sliding_windows(text: Column, size: int, overlap: int) -> Column:
    """Stripped, non-empty windows of ``size`` characters that advance by ``size - overlap``.

    One pass of a regular expression: the lookahead captures a window while the match
    itself advances by the step.  Cost is linear in the text, where slicing by position
    would rescan the UTF-8 text from its start for every window.  A later window exists
    only if the one before it has not reached the end of the text.
    """
    step = max(size - overlap, 1)
    ahead = size - step + 1
    pattern = rf"(?s)(?:\A|(?=.{{{ahead}}}))(?=(.{{1,{size}}})).{{1,{step}}}"
    windows = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(F.transform(windows, strip), lambda w: w != "")


def split_text(
    text: Column, strategy: str, size: int, overlap: int, splitter: str = "window"
) -> Column:
    """Pieces of a text under a strategy: ARRAY<STRING> in reading order."""
    if strategy not in fv.CHUNK_STRATEGIES:
        raise ValueError(f"Unknown chunking strategy: {strategy}")
    if splitter == "separators":
        from trovelake.operators.separator_split import separator_pieces

        pieces = separator_pieces(text, fv.SPLIT_SEPARATORS[strategy], size, overlap)
        return F.transform(pieces, clean_text)
    if splitter != "window":
        raise ValueError(f"Unknown splitter: {splitter}")
    if strategy == "sentence":
        text = F.regexp_replace(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+", " ")
    return sliding_windows(text, size, overlap)


def section_texts(documents: DataFrame) -> DataFrame:
    """One row per section with the text that is cut: title, heading and body."""
    fields = ("doc_pos", "doc_id", "title", "product_type", "updated_at", "source")
    return unnest(documents, F.col("sections"), "section_pos", "s", keep=fields).select(
        "*",
        F.col("s.heading").alias("section"),
        clean_text(F.concat_ws("\n", "title", "s.heading", "s.text")).alias("section_text"),
    )


def pieces_by_strategy(
    documents: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP
) -> DataFrame:
    """``chunk_strategy`` and ``pieces`` of every section under all strategies, from one cleaned text."""
    ways = F.array(
        *(
            F.struct(
                F.lit(s).alias("chunk_strategy"),
                split_text(F.col("section_text"), s, size, overlap).alias("pieces"),
            )
            for s in fv.CHUNK_STRATEGIES
        )
    )
    rows = unnest(section_texts(documents), ways, "way", keep=("doc_pos", "section_pos"))
    return rows.select("doc_pos", "section_pos", "way.chunk_strategy", "way.pieces")


def chunk_documents(
    documents: DataFrame,
    strategy: str = "recursive",
    chunk_size: int = fv.CHUNK_SIZE,
    chunk_overlap: int = fv.CHUNK_OVERLAP,
    splitter: str = "window",
) -> DataFrame:
    """Documents to chunks: a narrow plan (two explodes, no shuffle).

    ``(doc_pos, piece)`` identifies a chunk and orders chunks as the documents list
    them; ``piece`` packs the section position and the chunk index.  Windows cut from
    cleaned text and stripped are already clean, so they are not cleaned again.
    """
    sections = section_texts(documents)
    pieces = split_text(F.col("section_text"), strategy, chunk_size, chunk_overlap, splitter)
    chunk_id = F.concat_ws(":", "doc_id", "section", F.lit(strategy), F.col("chunk_index"))
    return unnest(sections, pieces, "chunk_index", "text").select(
        "doc_pos",
        (F.col("section_pos").cast("bigint") * F.lit(1 << 32) + F.col("chunk_index")).alias("piece"),
        chunk_id.alias("chunk_id"),
        "text",
        "doc_id",
        "title",
        "product_type",
        "updated_at",
        "source",
        "section",
        F.lit(strategy).alias("chunk_strategy"),
        F.col("chunk_index").cast("string").alias("chunk_index"),
    )


def matches(filters: dict[str, str] | None, columns: list[str]) -> Column | None:
    """AND of equalities; an unknown key matches nothing; no filters is None."""
    if not filters:
        return None
    condition = F.lit(True)
    for key, value in filters.items():
        condition = condition & (F.col(key) == F.lit(value) if key in columns else F.lit(False))
    return condition


def apply_filters(df: DataFrame, filters: dict[str, str] | None) -> DataFrame:
    """Metadata filter as a plain predicate, so it reaches the Parquet scan."""
    condition = matches(filters, df.columns)
    return df if condition is None else df.where(condition)


def metadata_map(df: DataFrame) -> Column:
    """The metadata columns as MAP<STRING, STRING>."""
    entries = [x for c in fv.METADATA_COLUMNS if c in df.columns for x in (F.lit(c), F.col(c))]
    return F.create_map(*entries)
