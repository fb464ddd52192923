"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and stored as the signs of its coordinates, with the
inner product of vector and code as correction factor.  Code times rotated query, divided by
the factor, estimates the inner product without bias; its error is bounded with confidence by
the factor, the dimension and the angle at the threshold.  Only pairs whose upper bound
reaches the threshold are computed exactly.

Candidates share a bucket: the signs of some random directions, in enough tables that a pair
at the threshold shares one with the wanted probability.  Buckets grow in number with the
vectors, not in size; large ones are cut into tiles, and a pair counts in its first table
only, so links are summed inside tiles and no list of pairs leaves them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.components import components
from trovelake.llm.tables import stored

COSINE = 0.95
RECALL = 0.999
#: Standard errors between an estimate and its confidence bound.
CONFIDENCE = 5.0
#: Vectors that a bucket holds on average, and the most in a side of a tile.
BUCKET = 64
TILE = 1024
_SEED = 20011


def rotation(dimension: int, number: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng([_SEED, dimension, number]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def directions(dimension: int, count: int) -> np.ndarray:
    """``count`` random directions, orthogonal within each run of ``dimension``."""
    return np.vstack([rotation(dimension, 1 + i) for i in range(-(-count // dimension))])[:count]


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]  # so that squares neither vanish nor overflow
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign code of each unit vector, packed, and the inner product of vector and code."""
    turned = unit @ rotation(unit.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) and rotated ones (columns)."""
    dimension = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dimension).astype(np.float64) * 2 - 1
    return (signs @ turned.T) / (math.sqrt(dimension) * factors[:, None])


def error_bound(factors: np.ndarray, dimension: int, cosine: float, confidence: float) -> np.ndarray:
    """Error of the estimate for a pair at the threshold that isn't exceeded with confidence."""
    spread = np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(1, dimension - 1))
    return confidence * math.sqrt(1 - cosine**2) * spread + 1e-9


class _Tile:
    def __init__(self, cosine: float, confidence: float):
        self.cosine, self.confidence = cosine, confidence

    def __call__(self, group: pa.Table) -> pa.Table:
        names = ("node", "weight", "part", "bucket", "side")
        node, weight, part, bucket, side = (group.column(c).to_numpy() for c in names)
        vectors, codes, buckets = (group.column(c).combine_chunks() for c in ("vec", "code", "buckets"))
        lengths = vectors.value_lengths().to_numpy()
        factor = group.column("factor").to_numpy()
        order = np.lexsort((node, bucket, part, lengths))
        keys = np.stack([lengths[order], part[order], bucket[order]])
        begins = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        hashes = np.array(buckets.to_pylist(), np.int64)
        found = []
        for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
            rows = order[a:b]
            if len(rows) > 1:
                take = pa.array(rows)
                unit = _unit(vectors.take(take).flatten().to_numpy().reshape(len(rows), -1))
                code = np.frombuffer(b"".join(codes.take(take).to_pylist()), np.uint8).reshape(len(rows), -1)
                found.append(self._bucket(
                    unit, code, factor[rows], node[rows], weight[rows], side[rows], hashes[rows], int(part[rows[0]])))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("a", "b", "links"), columns, strict=True)})

    def _bucket(self, unit, code, factor, node, weight, side, hashes, part):
        guess = estimate(code, factor, unit @ rotation(unit.shape[1]).T)
        near = guess + error_bound(factor, unit.shape[1], self.cosine, self.confidence)[:, None] >= self.cosine
        near &= near.T
        near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
        i, j = np.nonzero(np.triu(near, 1))
        exact = np.zeros(len(i))
        for low in range(0, len(i), 1 << 15):
            at = slice(low, low + (1 << 15))
            exact[at] = np.einsum("ij,ij->i", unit[i[at]], unit[j[at]])
        i, j = i[exact >= self.cosine], j[exact >= self.cosine]
        for low in range(part):  # a pair counts in the first table where it shares a bucket
            new = hashes[i, low] != hashes[j, low]
            i, j = i[new], j[new]
        links = np.bincount(i, weights=weight[j], minlength=len(node)) + np.bincount(j, weights=weight[i], minlength=len(node))
        label = np.arange(len(node))
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                break
        linked = links > 0
        return node[linked], node[label[linked]], links[linked]


def near_duplicates(
    embeddings: DataFrame, *, cosine: float = COSINE, recall: float = RECALL, confidence: float = CONFIDENCE
) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link at a cosine (double precision) of ``cosine`` or more; no pair below it
    links, and one at it is found with probability ``recall`` at least.  n_links counts the
    other vectors linked directly, component_id is the smallest vec_id reachable, kept marks
    that row.  Vectors that are null, empty or zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths.  Rows that share or lack a vec_id
    are vectors of their own; where a component has no vec_id at all, component_id is null
    and its rows are kept.  Other columns are not read; an empty table gives no rows.
    """
    if not 0 < cosine <= 1 or not 0 < recall < 1:
        raise ValueError("cosine must be in (0, 1] and recall in (0, 1)")
    rows = embeddings.select("vec_id", F.col("embedding").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    names = [F.xxhash64("vec").alias("one"), F.xxhash64(F.lit(1), "vec").alias("two")]
    valid = rows.where(usable)
    copies = valid.select("vec_id", *names, "vec").groupBy("one", "two").agg(
        F.count("*").alias("weight"), F.first("vec").alias("vec"))
    nodes = stored(stored(copies).withColumn("node", F.monotonically_increasing_id()))
    count = nodes.count()
    bits = max(1, math.ceil(math.log2(max(2, count) / BUCKET)))
    shared = (1 - math.acos(cosine) / math.pi) ** bits
    tables = 1 if shared >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared)))

    def code(batches):
        for batch in batches:
            lists = batch.column(0)
            lengths = lists.value_lengths().to_numpy()
            codes, factors = [b""] * len(lists), np.zeros(len(lists))
            buckets = np.zeros((len(lists), tables), np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                unit = _unit(lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), length))
                packed, factors[at] = encode(unit)
                for i, row in zip(at, packed, strict=True):
                    codes[i] = row.tobytes()
                signs = (unit @ directions(length, bits * tables).T > 0).reshape(len(at), tables, bits)
                buckets[at] = signs @ (1 << np.arange(bits)) + (length << 32)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(lists) + 1, dtype="i4") * tables), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), lists, pa.array(codes, pa.binary()), pa.array(factors), flat],
                names=["node", "weight", "vec", "code", "factor", "buckets"])

    kind = nodes.schema["vec"].dataType.simpleString()
    coded = stored(nodes.select("vec", "node", "weight").mapInArrow(
        code, f"node long, weight long, vec {kind}, code binary, factor double, buckets array<long>"))
    places = coded.select("node", F.posexplode("buckets").alias("part", "bucket"))
    sizes = places.groupBy("part", "bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    groups = max(1, math.ceil(count * tables / (8 * TILE)))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
        F.least(c, F.col("chunk")).alias("low"), F.greatest(c, F.col("chunk")).alias("high")))
    tiles = places.join(sizes, ["part", "bucket"]).withColumn("chunk", chunk).withColumn("tile", F.explode(others)).select(
        "node", "part", "bucket",
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("part", "bucket"), F.lit(groups))).otherwise(
            F.xxhash64("part", "bucket", "tile.low", "tile.high")).alias("group"),
        (F.col("chunks") == 1).alias("whole"), "tile.low", "tile.high",
        F.when(F.col("tile.low") == F.col("tile.high"), 2).when(F.col("chunk") == F.col("tile.low"), 0).otherwise(1).alias("side"),
    )
    work = _Tile(cosine, confidence)
    found = stored(
        tiles.join(coded, "node").groupBy("group", "whole", "low", "high")
        .applyInArrow(lambda t: work(t), "a long, b long, links long")
    )
    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b")).withColumnRenamed("node", "a")
    classes = nodes.select("one", "two", "weight", F.col("node").alias("a")).join(linked, "a", "left").join(joined, "a", "left")
    classes = classes.select(
        "one", "two", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "a").alias("component"))
    members = valid.select("vec_id", *names).join(classes, ["one", "two"])
    first = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = members.join(first, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
