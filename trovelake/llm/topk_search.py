"""Exact top-k inner-product search by distributed histogram selection.

Every vector is scored against every query of a block.  Tasks count the scores in bins of
each query's range; the bins of all tasks together say in which one the kth highest score
lies, and that bin becomes the next range, until it holds a single score.  A last pass keeps
the scores above the kth and, of those equal to it, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelake.llm.tables import stored
from trovelake.runtime import per_block, scratch_dir

#: Queries that are broadcast together, and their components in all.
BLOCK_QUERIES = 1024
BLOCK_COMPONENTS = 1 << 20
BINS = 256
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class _Block:
    """A bounded block of queries with the range of scores in which each kth highest lies."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int, largest: dict[int, int]):
        self.ids, self.k = ids, k
        self.length = np.array([len(v) for v in vectors], np.int64)
        self.groups = {}
        bound = np.zeros(len(ids), object)
        for length in np.unique(self.length).tolist():
            rows = np.flatnonzero(self.length == length)
            matrix = np.array([vectors[i] for i in rows], np.int64).reshape(len(rows), length)
            self.groups[length] = rows, matrix
            sums = np.abs(matrix.astype(object)).sum(axis=1) if length else np.zeros(len(rows), object)
            bound[rows] = sums * largest.get(length, 0)
        self.low = np.array([max(-b, _LEAST) for b in bound], object)
        self.high = np.array([min(b, _MOST) for b in bound], object)
        self.need = np.full(len(ids), k)  # rank of the kth highest within its range

    def open(self) -> bool:
        return bool((self.low < self.high).any())

    def width(self) -> np.ndarray:
        return np.array([-(-(h - lo + 1) // BINS) for lo, h in zip(self.low, self.high, strict=True)], object)

    def narrow(self, counts: pa.Table) -> None:
        bins = np.zeros((len(self.ids), BINS), np.int64)
        bins[counts.column("q").to_numpy(), counts.column("bin").to_numpy()] = counts.column("n").to_numpy()
        reached = np.cumsum(bins[:, ::-1], axis=1)
        enough = reached[:, -1] >= self.need
        at = np.argmax(reached >= self.need[:, None], axis=1)
        for q, width in enumerate(self.width()):
            if not enough[q]:  # fewer candidates than k: all of them
                self.high[q] = self.low[q]
            elif self.low[q] < self.high[q]:
                self.need[q] -= reached[q, at[q] - 1] if at[q] else 0
                self.low[q] += (BINS - 1 - int(at[q])) * width
                self.high[q] = min(self.high[q], self.low[q] + width - 1)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of queries, vector ids, scores) for the vectors of each length."""
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        lengths = pc.list_value_length(lists).to_numpy()
        for length, (queries, matrix) in self.groups.items():
            rows = np.flatnonzero(lengths == length)
            if not len(rows):
                continue
            v = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), length)
            most = max(1, length) * float(np.abs(matrix).max(initial=0)) * float(np.abs(v).max(initial=0))
            if most < 1 << 53:  # exact in double precision
                found = (v.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64)
            else:
                exact = v.astype(object) @ matrix.T.astype(object)
                found = np.clip(exact, _LEAST, _MOST).astype(np.int64)
            yield queries, ids[rows], found


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each query.

    ``vectors`` (vec_id, v) and ``queries`` (query_id, v) hold arrays of long.  A query's own
    id is no candidate, nor is a vector of another length; ties go to the smaller vec_id; a
    query with fewer candidates gets all, one without any gets no row.  Rows with null ids,
    vectors or components take no part.  Rows that repeat a vec_id are each a candidate; a
    repeated query_id is asked once, with its least vector.  Scores beyond a long are cut to
    its range.  Other columns are not read.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = stored(
        vectors.select(F.col("vec_id").cast("long"), F.col("v").cast("array<long>")).where(usable & F.col("vec_id").isNotNull())
        .repartition(parts)
    )
    asked = (
        queries.select(F.col("query_id").cast("long"), F.col("v").cast("array<long>"))
        .where(usable & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("v").alias("v"))
    )
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    lengths = table.groupBy(F.size("v").alias("length")).agg(F.max(size).alias("most")).join(
        asked.select(F.size("v").alias("length")).distinct(), "length", "left_semi")
    largest = {r.length: r.most for r in lengths.collect()}

    def run(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        state = _Block(rows.column("query_id").to_numpy(), [np.array(v, np.int64) for v in rows.column("v").to_pylist()], k, largest)
        while state.open():
            state.narrow(_histogram(table, state))
        found = table.mapInArrow(_chosen(state), "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        return block

    path = scratch_dir(spark)  # one table for all blocks, so that the result's plan doesn't grow with them
    per_block(asked, run, key="query_id", weight="v", max_rows=BLOCK_QUERIES, max_weight=BLOCK_COMPONENTS)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def _histogram(table: DataFrame, state: _Block) -> pa.Table:
    """Counts per query and bin of its range; a task leaves out bins below its own kth highest."""
    low, high, width = (c.astype(np.int64) if c.dtype != object or _small(c) else c for c in (state.low, state.high, state.width()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(len(state.ids) * BINS, np.int64)
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                for queries, ids, scores in state.scores(batch.slice(part, 2048)):
                    lo = low[queries]
                    at = np.asarray((scores - lo) // width[queries])
                    inside = (scores >= lo) & (scores <= high[queries]) & (ids[:, None] != state.ids[queries])
                    cell = np.broadcast_to(queries * BINS, at.shape)[inside] + at[inside].astype(np.int64)
                    bins += np.bincount(cell, minlength=len(bins))
        bins = bins.reshape(-1, BINS)
        reached = np.cumsum(bins[:, ::-1], axis=1)[:, ::-1]
        above = np.c_[reached[:, 1:], np.zeros(len(bins), np.int64)]
        q, bin_ = np.nonzero((bins > 0) & (above < state.need[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.astype("i4")), pa.array(bin_.astype("i4")), pa.array(bins[q, bin_])], names=["q", "bin", "n"])

    counts = table.mapInArrow(count, "q int, bin int, n long")
    return counts.groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()


def _small(values: np.ndarray) -> bool:
    """Differences of such values can't overflow."""
    return all(abs(v) < 1 << 61 for v in values)


def _chosen(state: _Block):
    """Scores above the kth highest, and per task as many equal ones as are needed, smallest ids first."""
    kth, need, k = state.low.astype(np.int64), state.need, state.k

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties = (np.zeros(0, np.int64),) * 2
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                for queries, ids, scores in state.scores(batch.slice(part, 2048)):
                    other = ids[:, None] != state.ids[queries]
                    row, q = np.nonzero((scores > kth[queries]) & other)
                    yield _rows(state.ids[queries[q]], ids[row], scores[row, q])
                    row, q = np.nonzero((scores == kth[queries]) & other)
                    ties = _least(np.r_[ties[0], queries[q]], np.r_[ties[1], ids[row]], need)
        yield _rows(state.ids[ties[0]], ties[1], kth[ties[0]])

    return choose


def _least(query: np.ndarray, ids: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, query))
    query, ids = query[order], ids[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < need[query]
    return query[keep], ids[keep]


def _rows(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (query, ids, score)], names=["query_id", "vec_id", "score"])
