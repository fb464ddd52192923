"""Fusion, multi-query merge, compression and reranking of small candidate sets.

Inputs hold at most a few dozen rows per question, so all groups here are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import (
    let,
    overlap_count,
    overlap_ratio,
    split_on_period,
    strip,
    tokenize,
)
from trovelake.operators.block_search import SCORE_DIGITS, ranked


def hybrid_fusion(
    hits: DataFrame, k: int = fv.TOP_K, vector_weight: float = fv.VECTOR_WEIGHT
) -> DataFrame:
    """Weighted sum of max-normalised scores per (qid, variant, chunk_id).

    ``hits`` carries qid, variant, side (0 vector, 1 BM25), chunk_id, score, rank within
    its side, and any payload columns.  Ties keep the vector list's order, then that of
    chunks only BM25 found.  Rows sharing a chunk_id collapse: scores add up, the last
    one listed gives the payload.
    """
    fixed = ("qid", "variant", "side", "chunk_id", "score", "rank")
    payload = [c for c in hits.columns if c not in fixed]
    per_list = Window.partitionBy("qid", "variant", "side")
    top = F.max("score").over(per_list)
    share = F.when(F.col("side") == 0, F.lit(vector_weight)).otherwise(F.lit(1 - vector_weight))
    part = share * (F.col("score") / F.when(top == 0, F.lit(1.0)).otherwise(top))
    place = F.struct("side", "rank")
    fused = (
        hits.withColumn("part", part)
        .groupBy("qid", "variant", "chunk_id")
        .agg(
            F.round(F.sum("part"), SCORE_DIGITS).alias("score"),
            F.min(place).alias("place"),
            F.max_by(F.struct(*payload), place).alias("payload"),
        )
    )
    fused = ranked(fused, k, F.col("score").desc(), F.col("place"))
    return fused.select("qid", "variant", "chunk_id", "score", "rank", "payload.*")


def merge_variants(hits: DataFrame) -> DataFrame:
    """Best score per (qid, chunk_id) over all variants; ``seen`` orders by first sight."""
    payload = [c for c in hits.columns if c not in ("qid", "variant", "chunk_id", "score", "rank")]
    first_best = F.struct(F.col("score"), -F.col("variant"), -F.col("rank"))
    return (
        hits.groupBy("qid", "chunk_id")
        .agg(
            F.max("score").alias("score"),
            F.min(F.struct("variant", "rank")).alias("seen"),
            F.max_by(F.struct(*payload), first_best).alias("payload"),
        )
        .select("qid", "chunk_id", "score", "seen", "payload.*")
    )


def compress_text(
    text: Column, query_tokens: Column, max_chars: int = fv.COMPRESS_MAX_CHARS
) -> Column:
    """Texts over ``max_chars`` keep their sentences closest to the query, within the budget.

    Sentences are ordered by shared tokens (ties in text order); one that would overrun
    the budget is skipped unless it is the first; the fold stops once the budget is used.
    """
    start = F.struct(F.array().cast("array<string>").alias("picked"), F.lit(0).alias("total"))

    def ordered(tokens: Column) -> Column:
        scored = F.transform(
            split_on_period(text),
            lambda s, i: F.struct(
                (-overlap_count(tokens, tokenize(s))).alias("o"),
                i.alias("i"),
                F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit("."))).alias("s"),
            ),
        )
        return F.array_sort(scored)

    def step(state: Column, item: Column) -> Column:
        longer = state["total"] + F.length(item["s"])
        full = state["total"] >= max_chars
        overrun = (longer > max_chars) & (F.size(state["picked"]) > 0)
        taken = F.struct(
            F.concat(state["picked"], F.array(item["s"])).alias("picked"), longer.alias("total")
        )
        return F.when(full | overrun, state).otherwise(taken)

    kept = F.aggregate(let(query_tokens, ordered), start, step)["picked"]
    short = strip(F.substring(F.array_join(kept, " "), 1, max_chars))
    return F.when(F.length(text) <= max_chars, text).otherwise(short)


def rerank(merged: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    """Order by score plus overlap of the question with the (compressed) text; score is kept.

    ``merged`` carries query_tokens and seen.
    """
    bonus = overlap_ratio(F.col("query_tokens"), tokenize(F.col("text")))
    keyed = merged.withColumn("key", F.round(F.col("score") + bonus, SCORE_DIGITS))
    return ranked(keyed, k, F.col("key").desc(), F.col("seen"), by=("qid",)).drop("key", "seen")
