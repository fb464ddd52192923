"""Retrieval of contexts for a batch of questions, as one plan per query block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import citation, tokenize
from trovelake.operators.block_search import with_rows
from trovelake.operators.bm25 import bm25_topk
from trovelake.operators.fusion import compress_text, hybrid_fusion, merge_variants, rerank
from trovelake.operators.query import effective_product, explode_variants
from trovelake.operators.vector_search import mmr_topk, vector_topk
from trovelake.plans.index import CorpusIndex
from trovelake.runtime import MAX_BLOCK_HITS, MAX_BLOCK_QUERIES, MAX_BLOCK_TERMS, per_block

CONTEXT_COLUMNS = ("chunk_id", "text", *fv.METADATA_COLUMNS)


def attach_chunks(index: CorpusIndex, hits: DataFrame) -> DataFrame:
    """Chunk text and metadata for the ranked hits of a counted block.

    The result is partitioned by question.  Every later group and window key contains
    qid, so fusion, merge and rerank all run without another shuffle.
    """
    found = with_rows(index.chunks, hits, *CONTEXT_COLUMNS)
    columns = [c for c in hits.columns if c not in ("doc_pos", "piece")]
    return found.select(*columns, *CONTEXT_COLUMNS).repartition("qid")


def search_variants(
    index: CorpusIndex,
    variants: DataFrame,
    k: int = fv.TOP_K,
    mode: str = "hybrid",
    filters: dict[str, str] | None = None,
    query_filter: str | None = None,
) -> DataFrame:
    """One search per (qid, variant) of one query block: qid, variant, chunk columns, score, rank.

    ``variants``: qid, variant, text, tokens and the ``query_filter`` column.
    """
    if mode not in fv.SEARCH_MODES:
        raise ValueError(f"Unknown retrieval mode: {mode}")
    embedding = index.embedder.queries(F.col("text"), F.col("tokens"))
    embedded = variants.withColumn("embedding", embedding)
    common = dict(filters=filters, query_filter=query_filter, one_block=True)
    if mode == "similarity":
        return attach_chunks(index, vector_topk(index.chunks, embedded, k, **common))
    if mode == "mmr":
        return attach_chunks(index, mmr_topk(index.chunks, embedded, k, **common))
    near = vector_topk(index.chunks, embedded, k * 2, **common)
    words = bm25_topk(index.chunks, index.terms, index.stats, variants, k * 2, **common)
    sides = [hits.withColumn("side", F.lit(side)) for side, hits in enumerate((near, words))]
    return hybrid_fusion(attach_chunks(index, sides[0].unionByName(sides[1])), k)


def retrieve(
    index: CorpusIndex,
    questions: DataFrame,
    k: int = fv.TOP_K,
    mode: str = "hybrid",
    filters: dict[str, str] | None = None,
    use_self_query: bool = True,
    use_multi_query: bool = True,
    compress: bool = True,
    lexicon: dict[str, list[str]] | None = None,
    rules: list | None = None,
) -> DataFrame:
    """Contexts of every question: qid, rank, chunk columns, score, retrieval_mode, citation.

    ``questions``: qid, query, and optionally product_type (null: infer, if
    ``use_self_query``; empty: no filter).  Non-empty ``filters`` apply to all questions
    and switch inference off.
    """
    if mode not in fv.SEARCH_MODES:
        raise ValueError(f"Unknown retrieval mode: {mode}")
    rules = fv.EXPANSION_RULES if rules is None else rules
    n_variants = 1 + len(rules) if use_multi_query else 1
    given = F.col("product_type") if "product_type" in questions.columns else F.lit(None).cast("string")
    tokens = tokenize(F.col("query"))
    if filters:
        wanted = F.lit(None).cast("string")
    elif use_self_query:
        wanted = effective_product(given, tokens, lexicon)
    else:
        wanted = F.when(given != "", given)
    analysed = questions.select(
        F.col("qid").cast("bigint").alias("qid"),
        "query",
        tokens.alias("query_tokens"),
        wanted.alias("product_type"),
    )

    def run(block: DataFrame) -> DataFrame:
        variants = explode_variants(block.drop("query_tokens"), rules, use_multi_query)
        query_filter = None if filters else "product_type"
        found = search_variants(index, variants, k, mode, filters, query_filter)
        asked = F.broadcast(block.select("qid", "query_tokens"))
        merged = merge_variants(found).join(asked, "qid")
        if compress:
            merged = merged.withColumn("text", compress_text(F.col("text"), F.col("query_tokens")))
        best = rerank(merged, k)
        cited = citation(F.col("source"), F.col("doc_id"), F.col("chunk_id"), F.col("section"))
        return best.select(
            "qid",
            "rank",
            *CONTEXT_COLUMNS,
            "score",
            F.lit(mode).alias("retrieval_mode"),
            cited.alias("citation"),
        )

    rows = min(MAX_BLOCK_QUERIES, MAX_BLOCK_HITS // (4 * k)) // n_variants
    return per_block(
        analysed,
        run,
        weight="query_tokens",
        max_rows=max(1, rows),
        max_weight=MAX_BLOCK_TERMS // n_variants,
    )
