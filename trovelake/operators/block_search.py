"""Top-k search of a query block: one corpus pass, a local top-k per task, a final window.

Scoring a block of queries against a batch of rows is a small matrix computation.  As a
relational plan it would be one row per (query, row) pair, aggregated and sorted; here a
task scores its Arrow batches with numpy and emits k rows per query, so the only shuffle
carries tasks x queries x k rows whatever the corpus size, and no task ever holds more
than a batch and its current best rows.  Spark plans the scan (column pruning, filter
pushdown), the partitioning, the final ranking and every retry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are rounded so that equal scores stay equal whatever order they were summed
# in; equal scores are then ordered by corpus position, as a stable sort would.
SCORE_DIGITS = 10
HIT_SCHEMA = "qid bigint, variant int, doc_pos bigint, piece bigint, score double"
COLUMN_BLOCK = 128
_PRUNED_DOCUMENTS = 64
# More than rounding can add to a score, and scores per query and place from which a batch's k-th best is looked for.
_ROUNDING = 10.0**-SCORE_DIGITS
_MANY = 4

# Kernel: batch -> score(query indices, row indices or None for all) -> query x row matrix.
Scores = Callable[[np.ndarray, "np.ndarray | None"], np.ndarray]
Kernel = Callable[[pa.RecordBatch], Scores]


def ranked(hits: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("qid", "variant")) -> DataFrame:
    """Rows with ``rank`` 1..k per group (planned as partial and final WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def final_topk(local_hits: DataFrame, k: int) -> DataFrame:
    return ranked(local_hits, k, F.col("score").desc(), F.col("doc_pos"), F.col("piece"))


def local_topk(
    corpus: DataFrame,
    payload: str,
    keys: np.ndarray,
    wanted: list | None,
    query_filter: str | None,
    kernel: Kernel,
    k: int,
    positive: bool = False,
) -> DataFrame:
    """Each task's k best rows per query.

    ``payload`` is the column the kernel reads, ``keys`` the (qid, variant) pairs.
    ``wanted`` holds per query the value its rows need in the ``query_filter`` column, or
    None for no filter.  ``positive`` drops scores that are not above zero.
    """
    columns = ["doc_pos", "piece", payload] + ([query_filter] if query_filter else [])
    groups = [(None, np.arange(len(keys)))]
    if wanted is not None:
        names = [None, *sorted({w for w in wanted if w is not None})]
        groups = [(n, np.array([i for i, w in enumerate(wanted) if w == n], dtype=int)) for n in names]
    blocks = [
        (name, ids[start : start + COLUMN_BLOCK])
        for name, ids in groups
        for start in range(0, len(ids), COLUMN_BLOCK)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]
        kth = np.full(len(keys), -np.inf)  # the score a row needs at least to be among a query's best so far
        for batch in batches:
            if batch.num_rows == 0:
                continue
            doc, piece = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            scores = kernel(batch)
            for name, ids in blocks:
                rows = None
                if name is not None:
                    rows = np.flatnonzero(pc.fill_null(pc.equal(batch.column(3), name), False))
                    if not len(rows):
                        continue
                raw = scores(ids, rows)
                enough = raw >= kth[ids, None] - _ROUNDING
                if positive:
                    enough &= raw > 0
                if np.count_nonzero(enough) > _MANY * k * len(ids):
                    q, r = _best(np.round(raw, SCORE_DIGITS), k, enough)
                else:
                    q, r = np.nonzero(enough)
                at = r if rows is None else rows[r]
                found = _keep([ids[q], np.round(raw[q, r], SCORE_DIGITS) + 0.0, doc[at], piece[at]], k)
                pool = [np.concatenate(pair) for pair in zip(pool, found)]
            pool = _keep(pool, k)
            last = np.flatnonzero(np.arange(len(pool[0])) - np.searchsorted(pool[0], pool[0]) == k - 1)
            kth[pool[0][last]] = pool[1][last]
        q, score, doc, piece = pool
        columns = [keys[q, 0], keys[q, 1].astype(np.int32), doc, piece, score]
        names = ["qid", "variant", "doc_pos", "piece", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return corpus.select(*columns).coalesce(search_tasks(corpus)).mapInArrow(run, HIT_SCHEMA)


def search_tasks(corpus: DataFrame) -> int:
    """Most tasks of a search pass: every task sends k rows per query to the last ranking.

    A task takes several scan splits in turn, so these rows follow the cluster and not the
    number of splits of the corpus.
    """
    spark = corpus.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _best(matrix: np.ndarray, k: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, row) of every kept score not below its query's k-th best."""
    n = matrix.shape[1]
    if n > k:
        floor = np.partition(matrix, n - k, axis=1)[:, n - k]
        keep &= matrix >= floor[:, None]
    return np.nonzero(keep)


def _keep(pool: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Cut a pool (query, score, doc_pos, piece) to the first k per query."""
    query, score, doc, piece = pool
    order = np.lexsort((piece, doc, -score, query))
    query = query[order]
    first = np.searchsorted(query, query, side="left")
    order = order[np.arange(len(order)) - first < k]
    return [column[order] for column in pool]


def with_rows(corpus: DataFrame, hits: DataFrame, *columns: str) -> DataFrame:
    """Join the hits of one counted query block with ``columns`` of their corpus rows.

    The hits are computed once and come back as a local table: their number is bounded by
    the block.  When they lie in few documents, the scan is told which, so that it skips
    the row groups of all others.
    """
    table = hits.toArrow()
    local = corpus.sparkSession.createDataFrame(table, hits.schema)
    places = pc.unique(table.column("doc_pos")).to_pylist()
    if len(places) <= _PRUNED_DOCUMENTS:  # equalities, as a long IN reaches Parquet as one range only
        wanted = reduce(lambda a, b: a | b, (F.col("doc_pos") == p for p in places), F.lit(False))
        corpus = corpus.where(wanted)
    return corpus.select("doc_pos", "piece", *columns).join(F.broadcast(local), ["doc_pos", "piece"])


def query_keys(table: pa.Table) -> np.ndarray:
    """(qid, variant) of a collected query block."""
    parts = [table.column(c).to_numpy().astype(np.int64) for c in ("qid", "variant")]
    return np.stack(parts, axis=1)


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of every list element, and the elements."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten()
