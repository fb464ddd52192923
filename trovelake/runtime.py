"""Session helpers: scratch location, and size-checked blocks of query rows."""

from __future__ import annotations

import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A block of queries is what may be broadcast to every task.  4096 queries of 384
# doubles are 12 MB; 400k (query, term) rows are about 30 MB.
MAX_BLOCK_QUERIES = 4096
MAX_BLOCK_TERMS = 400_000
# Hits of a block that are joined with their rows: about 10 MB.
MAX_BLOCK_HITS = 160_000


def local_session(app: str = "trovelake", cores: str = "*", **conf: str) -> SparkSession:
    """A session for the CLI, tests and bench; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, however they were started."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="trovelake-ship-")) / package.name
        _shipped[application] = shutil.make_archive(str(base), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(_shipped[application])


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="trovelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str, *, row_groups: bool = False) -> DataFrame:
    """Use all cores when a file scan cannot; leave inputs that are spread well alone.

    It cannot with fewer splits than cores.  With ``row_groups``, for a plain scan of Parquet,
    neither where one split has over twice a core's share of the rows: a split is a range of
    bytes and has the row groups of that range, so of the many splits of a file with few large
    row groups most are empty.  Their rows are counted without reading a column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and not row_groups:
        return df
    if splits >= cores:
        held = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count("*").alias("rows"))
        most, rows = held.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if most * cores <= 2 * rows:
            return df
    return df.repartition(max(splits, cores), key)


def unnest(df: DataFrame, array: Column, *names: str, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """One row per array element, as (position, element) or element; empty arrays give none.

    The outer form with a filter on its output evaluates the array once.  A plain explode
    makes the optimizer infer a size(array) > 0 filter below it, which would compute an
    expensive array (cleaned text, tokens) a second time.
    """
    generate = F.posexplode_outer if len(names) == 2 else F.explode_outer
    rows = df.select(*keep, generate(array).alias(*names))
    return rows.where(F.col(names[-1]).isNotNull())


def per_block(
    queries: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    *,
    key: str = "qid",
    weight: str | None = None,
    max_rows: int = MAX_BLOCK_QUERIES,
    max_weight: int = MAX_BLOCK_TERMS,
) -> DataFrame:
    """Run ``run`` on blocks of ``queries`` small enough to broadcast, and union the results.

    The queries are computed once into a table in the shared folder: several branches
    of a search read them, and it cuts their lineage.  The size is counted, not
    estimated: one block when everything fits, otherwise the queries are hash-split on
    ``key`` until every block fits or holds a single key.  ``weight`` names an array column
    whose total length is bounded too; one query that is heavier by itself is a block alone.
    """
    spark = queries.sparkSession
    schema = queries.schema
    path = scratch_dir(spark)
    queries.write.parquet(path)
    queries = spark.read.schema(schema).parquet(path)
    size = F.coalesce(F.sum(F.size(weight)), F.lit(0)) if weight else F.lit(0)
    keys = queries.groupBy(key).agg(F.count("*").alias("rows"), size.alias("terms"))

    def excess(n: int) -> float:
        """How far the largest block that can still be split is over the bounds."""
        block = keys.groupBy(_block(key, n)).agg(
            F.sum("rows").alias("rows"), F.sum("terms").alias("terms"), F.count("*").alias("keys")
        )
        over = F.greatest(F.col("rows") / max_rows, F.col("terms") / max_weight)
        return block.where("keys > 1").agg(F.coalesce(F.max(over), F.lit(0.0))).first()[0]

    blocks, load = 1, excess(1)
    while load > 1:
        blocks = max(blocks + 1, math.ceil(blocks * min(load * 1.2, 64)))
        load = excess(blocks)
    if blocks == 1:
        return run(queries)
    path = scratch_dir(spark)  # laid out by block, so that each block reads its own files
    queries.withColumn("_block", _block(key, blocks)).write.partitionBy("_block").parquet(path)
    stored = spark.read.parquet(path)
    parts = [run(stored.where(F.col("_block") == b).drop("_block")) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _block(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
