"""Exact vector search and maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.vector import dot_product, l2_norm
from trovelake.operators.block_search import (
    SCORE_DIGITS,
    final_topk,
    flat_lists,
    local_topk,
    query_keys,
    with_rows,
)
from trovelake.operators.chunking import apply_filters
from trovelake.runtime import MAX_BLOCK_HITS, MAX_BLOCK_QUERIES, per_block


def _matrix(lists: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a dense matrix cut or zero-padded to ``width``, and the norms of the whole rows."""
    row, cells = flat_lists(lists)
    values = cells.cast(pa.float64()).to_numpy(zero_copy_only=False)
    n = len(lists)
    lengths = np.bincount(row, minlength=n)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        dense = values.reshape(n, width)
        return dense, np.sqrt(np.einsum("ij,ij->i", dense, dense))
    norms = np.sqrt(np.bincount(row, weights=values * values, minlength=n))
    col = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    dense = np.zeros((n, width))
    keep = col < width
    dense[row[keep], col[keep]] = values[keep]
    return dense, norms


def _vector_kernel(qmatrix: np.ndarray, qnorms: np.ndarray, metric: str):
    def prepare(batch: pa.RecordBatch):
        dense, norms = _matrix(batch.column(2), qmatrix.shape[1])

        def scores(ids: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
            part, length = (dense, norms) if rows is None else (dense[rows], norms[rows])
            dots = qmatrix[ids] @ part.T
            if metric == "cosine":
                scale = qnorms[ids, None] * length[None, :]
                return np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
            gap = qnorms[ids, None] ** 2 + length[None, :] ** 2 - 2 * dots
            return 1.0 / (1.0 + np.maximum(gap, 0.0))

        return scores

    return prepare


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = fv.TOP_K,
    filters: dict[str, str] | None = None,
    query_filter: str | None = None,
    metric: str = "cosine",
    one_block: bool = False,
) -> DataFrame:
    """The k nearest corpus rows of every query, exactly.

    ``vectors``: doc_pos, piece, embedding and filter columns.  ``queries``: qid,
    variant, embedding, and with ``query_filter`` a column of that name whose value
    (null = no filter) must equal the corpus column.  ``metric`` is ``cosine`` (0 for a
    zero vector) or ``l2`` (score 1 / (1 + squared distance)).

    Query blocks are counted before they are shipped to the tasks; more queries mean
    more passes, not a larger broadcast (``one_block``: the caller has split them).
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"Unknown metric: {metric}")
    corpus = apply_filters(vectors, filters)
    queries = queries.select("qid", "variant", "embedding", *([query_filter] if query_filter else []))

    def search(block: DataFrame) -> DataFrame:
        table = block.toArrow()
        matrix, norms = _matrix(table.column("embedding").combine_chunks())
        wanted = table.column(query_filter).to_pylist() if query_filter else None
        kernel = _vector_kernel(matrix, norms, metric)
        return local_topk(corpus, "embedding", query_keys(table), wanted, query_filter, kernel, k)

    return final_topk(search(queries) if one_block else per_block(queries, search), k)


def mmr_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = fv.TOP_K,
    fetch_k: int = fv.MMR_FETCH_K,
    lambda_mult: float = fv.MMR_LAMBDA,
    filters: dict[str, str] | None = None,
    query_filter: str | None = None,
    one_block: bool = False,
) -> DataFrame:
    """Maximal marginal relevance over the ``fetch_k`` nearest rows; scores stay cosines.

    The candidates' vectors are fetched for the winners only.  Per query at most
    ``fetch_k`` candidates are folded: pairwise similarities once, then k greedy picks.
    """

    def search(block: DataFrame) -> DataFrame:
        near = vector_topk(vectors, block, fetch_k, filters, query_filter, one_block=True)
        return _diversify(vectors, near, k, lambda_mult)

    rows = max(1, MAX_BLOCK_HITS // fetch_k)
    return search(queries) if one_block else per_block(queries, search, max_rows=min(rows, MAX_BLOCK_QUERIES))


def _diversify(vectors: DataFrame, near: DataFrame, k: int, lambda_mult: float) -> DataFrame:
    wide = with_rows(vectors, near, "embedding")
    wide = wide.withColumn("norm", l2_norm(F.col("embedding")))
    lists = wide.groupBy("qid", "variant").agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "doc_pos", "piece", "score", "embedding", "norm"))
        ).alias("near")
    )

    def similarity(a: Column, b: Column) -> Column:
        scale = a["norm"] * b["norm"]
        cosine = dot_product(a["embedding"], b["embedding"]) / scale
        return F.when(scale > 0, F.round(cosine, SCORE_DIGITS)).otherwise(F.lit(0.0))

    # Lower triangle only: row a holds its similarity to every better ranked b.
    sims = F.transform(
        "near",
        lambda a: F.transform(
            "near",
            lambda b: F.when(b["rank"] < a["rank"], similarity(a, b)),
        ),
    )
    fields = ("doc_pos", "piece", "score")
    slim = F.transform("near", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    picks = F.posexplode(mmr_order(F.col("cands"), F.col("sims"), k, lambda_mult))
    return (
        lists.select("qid", "variant", slim.alias("cands"), sims.alias("sims"))
        .select("qid", "variant", "cands", picks.alias("at", "pick"))
        .select("qid", "variant", "at", F.get("cands", F.col("pick")).alias("hit"))
        .select("qid", "variant", "hit.*", (F.col("at") + 1).alias("rank"))
    )


def mmr_order(candidates: Column, sims: Column, k: int, lambda_mult: float) -> Column:
    """Indices of the greedy picks: a fold whose state is the list of picked indices."""

    def step(picked: Column, _: Column) -> Column:
        def gain(item: Column, at: Column) -> Column:
            nearest = F.array_max(
                F.transform(
                    picked, lambda p: F.get(F.get(sims, F.greatest(at, p)), F.least(at, p))
                )
            )
            worth = lambda_mult * item["score"] - (1 - lambda_mult) * F.coalesce(nearest, F.lit(0.0))
            value = F.struct((-F.round(worth, SCORE_DIGITS)).alias("v"), at.alias("at"))
            return F.when(~F.array_contains(picked, at), value)

        best = F.array_min(F.transform(candidates, gain))
        return F.when(best.isNotNull(), F.concat(picked, F.array(best["at"]))).otherwise(picked)

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast("array<int>"), step)
