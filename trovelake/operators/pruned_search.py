"""Exact vector search that skips cells of vectors by the triangle inequality.

Vectors are laid out by their nearest pivot and the distance to it; runs of ``CELL`` rows of one
pivot are cells, with the least and largest distance in each.  No vector of a cell is nearer to
a query than |query to pivot - vector to pivot| allows.  A search scores the cells of the least
bounds first, which gives each query a kth distance, and of the others only those whose bound
is within it; cells that no query of the block needs are not read.  Cosines are searched as
distances of unit vectors.  The pivots are a bounded sample (``PIVOTS`` rows, the first by hash);
they decide how much is skipped, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelake import fixed_values as fv
from trovelake.operators.block_search import HIT_SCHEMA, SCORE_DIGITS, _best, _keep, final_topk, query_keys, search_tasks
from trovelake.operators.vector_search import _matrix
from trovelake.runtime import per_block, scratch_dir

PIVOTS = 256
CELL = 512
#: Cells of each query that are scored for its first kth distance.
FIRST = 4
#: Queries of a block: their distances to all pivots are held by every task.
BLOCK_QUERIES = 1024
#: Cells that the scan is told as equalities, and that are broadcast; more are joined by a shuffle.
PUSHED, BROADCAST_CELLS = 64, 1 << 18
#: Slack for rounding between a bound and a distance.
_SLACK = 1e-9
_CELL_TYPE = "cell long, pivot int, least double, most double, vectors long"


def _points(lists: pa.Array, width: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as points of the metric, and which of them can be bounded: those of this width that are not zero."""
    dense, norms = _matrix(lists, width)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    usable = (lengths == width) & np.isfinite(norms)
    if metric == "cosine":
        usable &= norms > 0
        dense = np.divide(dense, norms[:, None], out=np.zeros_like(dense), where=(norms > 0)[:, None])
    return dense, usable


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gap = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(gap, 0.0))


def write_pivoted(vectors: DataFrame, path: str, metric: str = "cosine") -> str:
    """Write vectors (doc_pos, piece, embedding and other columns) to ``path`` by pivot and distance, replacing it."""
    if metric not in ("cosine", "l2"):
        raise ValueError(f"Unknown metric: {metric}")
    spark = vectors.sparkSession
    sample = vectors.where(F.size("embedding") > 0).select("doc_pos", "piece", "embedding").orderBy(
        F.xxhash64("doc_pos", "piece"), "doc_pos", "piece").limit(PIVOTS).toArrow()
    lists = sample.column("embedding").combine_chunks()
    widths = pc.list_value_length(lists).to_pylist()
    width = max(set(widths), key=widths.count) if widths else 0
    points, usable = _points(lists, width, metric)
    pivots = points[usable]
    at = vectors.columns.index("embedding")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, near = np.full(batch.num_rows, -1, "i4"), np.zeros(batch.num_rows)
            points, usable = _points(batch.column(at), width, metric)
            if len(pivots) and usable.any():
                gaps = _distances(points[usable], pivots)
                own[usable] = gaps.argmin(axis=1)
                near[usable] = gaps.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(near)], names=[*batch.schema.names, "pivot", "near"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = vectors.mapInArrow(assign, f"{kind}, pivot int, near double").repartitionByRange("pivot", "near")
    placed = placed.sortWithinPartitions("pivot", "near").withColumn("cell", F.floor(F.monotonically_increasing_id() / CELL))
    placed.write.mode("overwrite").options(**{"parquet.block.size": str(4 << 20)}).parquet(f"{path}/vectors")
    cells = spark.read.parquet(f"{path}/vectors").groupBy("cell", "pivot").agg(
        F.min("near").alias("least"), F.max("near").alias("most"), F.count("*").alias("vectors"))
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    row = [(metric, width, pivots.ravel().tolist())]
    spark.createDataFrame(row, "metric string, width int, pivots array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    return path


class _Asked:
    def __init__(self, table: pa.Table, pivots: np.ndarray, width: int, metric: str):
        self.keys, self.metric, self.width = query_keys(table), metric, width
        lists = table.column("embedding").combine_chunks()
        self.points, self.usable = _points(lists, width, metric)
        self.to_pivots = _distances(self.points, pivots) if len(pivots) else np.zeros((len(self.points), 0))
        self.reach = np.full(len(self.points), np.inf)

    def bounds(self, pivot: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each query and cell the least distance possible; 0 where none is known."""
        out = np.zeros((len(self.points), len(pivot)))
        known = pivot >= 0
        to = self.to_pivots[:, pivot[known]]
        out[:, known] = np.maximum(np.maximum(to - most[known], least[known] - to), 0.0)
        out[~self.usable] = 0.0
        return out

    def score(self, lists: pa.Array, q: np.ndarray) -> np.ndarray:
        dense, norms = _matrix(lists, self.width)
        dots = self.points[q] @ dense.T
        if self.metric == "cosine":
            return np.divide(dots, norms[None, :], out=np.zeros_like(dots), where=norms[None, :] > 0)
        gap = (self.points[q] ** 2).sum(axis=1)[:, None] + norms[None, :] ** 2 - 2 * dots
        return 1.0 / (1.0 + np.maximum(gap, 0.0))


def pruned_topk(spark: SparkSession, path: str, queries: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    """The rows of ``vector_search.vector_topk`` for queries (qid, variant, embedding), from a table of ``write_pivoted``.

    Queries have the width of the table's vectors.  Vectors of another width, zero vectors and
    such queries have no bounds and are always scored.
    """
    vectors, cells = spark.read.parquet(f"{path}/vectors"), spark.read.schema(_CELL_TYPE).parquet(f"{path}/cells")
    info = spark.read.parquet(f"{path}/pivots").first()
    pivots = np.array(info.pivots, float).reshape(-1, max(info.width, 1))

    def search(block: DataFrame) -> DataFrame:
        asked = _Asked(block.select("qid", "variant", "embedding").toArrow(), pivots, info.width, info.metric)
        nearest = _nearest(cells, asked)
        pairs = _stored(nearest)
        begun = _stored(_scored(vectors, pairs.select("cell").distinct(), asked, k, pairs.select("q", "cell", "pivot").toArrow(), None))
        kth = {(r.qid, r.variant): r.score for r in final_topk(begun, k).where(F.col("rank") == k).collect()}
        asked.reach = np.array([_reach(kth.get(tuple(key)), info.metric) for key in asked.keys.tolist()])
        needed = _stored(_needed(cells, asked))
        done = pairs.select("q", "cell", "pivot").toArrow()
        return begun.unionByName(_scored(vectors, needed, asked, k, None, done))

    return final_topk(per_block(queries, search, max_rows=BLOCK_QUERIES), k)


def _reach(score: float | None, metric: str) -> float:
    """The distance at which a score lies."""
    if score is None:
        return np.inf
    score -= 10.0**-SCORE_DIGITS  # scores are rounded
    if metric == "cosine":
        return np.sqrt(max(2 - 2 * score, 0.0)) + _SLACK
    return np.sqrt(max(1 / score - 1, 0.0)) * (1 + _SLACK) + _SLACK if score > 0 else np.inf


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cell_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(i).to_numpy() for i in range(4))


def _nearest(cells: DataFrame, asked: _Asked) -> DataFrame:
    """The cells of the least bounds for each query: a few from each task, then a few in all."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, pivot, least, most = _cell_columns(batch)
            bounds = asked.bounds(pivot, least, most)
            order = np.argsort(bounds, axis=1, kind="stable")[:, :FIRST]
            q = np.repeat(np.arange(len(order), dtype="i4"), order.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(cell[order.ravel()]), pa.array(pivot[order.ravel()]), pa.array(bounds[q, order.ravel()])],
                names=["q", "cell", "pivot", "bound"])

    rows = cells.mapInArrow(best, "q int, cell long, pivot int, bound double")
    first = Window.partitionBy("q").orderBy("bound", "cell", "pivot")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FIRST).drop("n")


def _needed(cells: DataFrame, asked: _Asked) -> DataFrame:
    """Cells that some query has to look at."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, pivot, least, most = _cell_columns(batch)
            some = (asked.bounds(pivot, least, most) <= asked.reach[:, None]).any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(cell[some]))], names=["cell"])

    return cells.mapInArrow(near, "cell long").distinct()


def _scored(vectors: DataFrame, wanted: DataFrame, asked: _Asked, k: int, only: pa.Table | None, done: pa.Table | None) -> DataFrame:
    """Each task's k best vectors per query, in the pairs of ``only`` or in those within reach that aren't ``done``."""
    count = wanted.count()
    if count <= PUSHED:
        cells = [r.cell for r in wanted.collect()]
        rows = vectors.where(reduce(lambda a, b: a | b, (F.col("cell") == c for c in cells), F.lit(False)))
    else:
        rows = vectors.join(F.broadcast(wanted) if count <= BROADCAST_CELLS else wanted, "cell", "left_semi")
    listed: dict[tuple[int, int], list[int]] = {}
    for r in (only if only is not None else done).to_pylist():
        listed.setdefault((r["cell"], r["pivot"]), []).append(r["q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]
        for batch in batches:
            doc, piece, near, cell, pivot = (batch.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
            order = np.lexsort((pivot, cell))
            edge = np.flatnonzero((np.diff(cell[order], prepend=-1) != 0) | (np.diff(pivot[order], prepend=-2) != 0))
            found = [pool]
            for low, high in zip(edge, [*edge[1:], len(order)], strict=True):
                at = order[low:high]
                mine = np.array(listed.get((int(cell[at[0]]), int(pivot[at[0]])), []), int)
                if only is not None:
                    q = np.sort(mine)
                else:
                    bound = asked.bounds(pivot[at[:1]], near[at].min(keepdims=True), near[at].max(keepdims=True))[:, 0]
                    within = bound <= asked.reach
                    within[mine] = False
                    q = np.flatnonzero(within)
                if len(q):
                    matrix = np.round(asked.score(batch.column(2).take(pa.array(at)), q), SCORE_DIGITS) + 0.0
                    i, j = _best(matrix, k, np.ones(matrix.shape, bool))
                    found.append([q[i], matrix[i, j], doc[at[j]], piece[at[j]]])
            pool = _keep([np.concatenate(c) for c in zip(*found, strict=True)], k)
        q, score, doc, piece = pool
        columns = [asked.keys[q, 0], asked.keys[q, 1].astype(np.int32), doc, piece, score]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "variant", "doc_pos", "piece", "score"])

    columns = rows.select("doc_pos", "piece", "embedding", "near", "cell", "pivot")
    return columns.coalesce(search_tasks(vectors)).mapInArrow(run, HIT_SCHEMA)


def skipped_share(spark: SparkSession, path: str, hits: DataFrame, queries: DataFrame) -> float:
    """Share of (query, cell) pairs whose bound is beyond the query's last hit: those that need no scoring."""
    cells, info = spark.read.schema(_CELL_TYPE).parquet(f"{path}/cells"), spark.read.parquet(f"{path}/pivots").first()
    pivots = np.array(info.pivots, float).reshape(-1, max(info.width, 1))
    asked = _Asked(queries.select("qid", "variant", "embedding").toArrow(), pivots, info.width, info.metric)
    last = {(r.qid, r.variant): r.score for r in hits.groupBy("qid", "variant").agg(F.min("score").alias("score")).collect()}
    asked.reach = np.array([_reach(last.get(tuple(key)), info.metric) for key in asked.keys.tolist()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, pivot, least, most = _cell_columns(batch)
            beyond = asked.bounds(pivot, least, most) > asked.reach[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([int(beyond.sum())]), pa.array([beyond.size])], names=["beyond", "pairs"])

    sums = cells.mapInArrow(count, "beyond long, pairs long").agg(F.sum("beyond").alias("beyond"), F.sum("pairs").alias("pairs")).first()
    return sums.beyond / sums.pairs if sums.pairs else 0.0
