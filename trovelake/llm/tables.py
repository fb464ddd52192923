"""Stored intermediates, unique document keys and counted sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelake.runtime import scratch_dir

#: Text bytes that one block of documents holds on average.
BLOCK_BYTES = 24 << 20


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared scratch folder and read it: computed once, lineage cut."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with a table in which ``on`` is unique, whatever share of the rows one key holds.

    Keys of a thousandth of the ``total`` rows or more, so at most a thousand, are broadcast; the
    others are shuffled.
    """
    common = stored(rows.groupBy(*on).agg(F.count("*").alias("held_rows")).where(F.col("held_rows") * 1000 >= total).select(*on))
    if common.isEmpty():
        return rows.join(table, on)
    hot = rows.join(F.broadcast(table.join(F.broadcast(common), on)), on)
    return hot.unionByName(rows.join(F.broadcast(common), on, "left_anti").join(table, on))


@dataclass
class Corpus:
    """``docs`` holds doc_id, text and ``key``, a unique long in the order of doc_id."""

    docs: DataFrame
    rows: int
    text_bytes: int

    @property
    def blocks(self) -> int:
        """Blocks for work by document: more with more text, so a block stays small."""
        least = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(least, math.ceil(self.text_bytes / BLOCK_BYTES))

    def by_block(self) -> DataFrame:
        return self.docs.withColumn("block", block_of("key", self.blocks)).repartition(
            self.blocks, "block"
        )


def block_of(key: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")


def _unique(kind: T.DataType, rows: int, known: int | None, distinct: int) -> bool:
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return whole and (known or 0) == rows == distinct


def _numbered(df: DataFrame, first: str, into: str = "key") -> DataFrame:
    others = [f.name for f in df.schema.fields if f.name != first and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return stored(df.orderBy(first, *others).withColumn(into, F.monotonically_increasing_id()))


def unique_keys(df: DataFrame, name: str, into: str = "key") -> DataFrame:
    """Add column ``into``, a unique long in the order of column ``name``.

    Where the column is a unique, non-null integer it is the key itself.  Otherwise rows are
    sorted by it and all other columns, nulls first, and numbered; equal rows get keys of
    their own.
    """
    n, known, distinct = df.groupBy(name).agg(F.count("*").alias("n")).agg(
        F.sum("n"), F.sum(F.when(F.col(name).isNotNull(), F.col("n"))), F.count(name)).first()
    if _unique(df.schema[name].dataType, n or 0, known, distinct):
        return df.withColumn(into, F.col(name).cast("long"))
    return _numbered(df, name, into)


def corpus(documents: DataFrame) -> Corpus:
    """Documents with unique keys (see ``unique_keys``) and counted sizes; null text is empty.

    Rows that share or lack a doc_id are documents of their own, in the order of (doc_id with
    nulls first, text).
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, known, distinct, size = (
        docs.groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
        .agg(F.sum("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.count("doc_id"), F.sum("size"))
        .first()
    )
    rows, size = rows or 0, size or 0
    if _unique(documents.schema["doc_id"].dataType, rows, known, distinct):
        return Corpus(docs.withColumn("key", F.col("doc_id").cast("long")), rows, size)
    return Corpus(_numbered(docs, "doc_id"), rows, size)
