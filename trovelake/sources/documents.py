"""Nested-document and question sources, and the clean-document sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelake import fixed_values as fv
from trovelake.functions.text import clean_text
from trovelake.runtime import spread
from trovelake.sources.json_array import read_json_array, write_json_array

SCALARS = ("doc_id", "title", "product_type", "updated_at", "source")
SECTION = T.StructType(
    [T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())]
)
DOCUMENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in SCALARS]
    + [T.StructField("sections", T.ArrayType(SECTION))]
)


def _required(value: Column, name: str) -> Column:
    missing = F.raise_error(F.lit(f"required field is missing: {name}"))
    return F.when(value.isNull(), missing).otherwise(value)


def clean_documents(raw: DataFrame) -> DataFrame:
    """Clean the five scalars and every section; ``doc_pos`` keeps the input order.

    A frame that already has a unique, ordered ``doc_pos`` keeps it, so a corpus table
    with a numeric key needs no generated one.
    """
    position = F.col("doc_pos") if "doc_pos" in raw.columns else F.monotonically_increasing_id()
    sections = F.transform(
        _required(F.col("sections"), "sections"),
        lambda s: F.struct(
            clean_text(_required(s["heading"], "heading")).alias("heading"),
            clean_text(_required(s["text"], "text")).alias("text"),
        ),
    )
    return raw.select(
        position.cast("bigint").alias("doc_pos"),
        *[clean_text(_required(F.col(c), c)).alias(c) for c in SCALARS],
        sections.alias("sections"),
    )


def load_documents(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Read documents from files of one JSON array each, or with ``lines`` from JSON Lines.

    Both are read by many tasks, also where there is one large file.
    """
    if lines:
        raw = spark.read.schema(DOCUMENT_SCHEMA).option("encoding", "UTF-8").option("mode", "FAILFAST").json(path)
        raw = raw.withColumn("doc_pos", F.monotonically_increasing_id())
    else:
        raw = read_json_array(spark, path, DOCUMENT_SCHEMA)
    return clean_documents(spread(raw, "doc_pos"))


def clean_questions(raw: DataFrame) -> DataFrame:
    """Every value as cleaned text, plus ``qid`` in input order."""
    position = F.col("qid") if "qid" in raw.columns else F.monotonically_increasing_id()
    fields = [c for c in raw.columns if c != "qid"]
    return raw.select(
        position.cast("bigint").alias("qid"),
        *[clean_text(F.col(c).cast("string")).alias(c) for c in fields],
    )


def load_questions(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Evaluation questions with whatever fields the file has."""
    raw = (
        spark.read.option("multiLine", not lines)
        .option("primitivesAsString", True)
        .option("mode", "FAILFAST")
        .json(path)
    )
    return clean_questions(raw)


def write_clean_documents(documents: DataFrame, path: str, *, array: bool = False) -> str:
    """Overwrite ``path`` with cleaned documents, written by the executors: JSON Lines, or an array in each file."""
    rows = documents.select(*SCALARS, "sections")
    if array:
        return write_json_array(rows, path)
    rows.write.mode("overwrite").json(path)
    return path


def document_text(title: Column, product_type: Column, source: Column, sections: Column) -> Column:
    """One text per document: title, type, source and sections, parted by blank lines."""
    body = F.transform(sections, lambda s: F.concat(s["heading"], F.lit("\n"), s["text"]))
    head = F.array(
        title,
        F.concat(F.lit(fv.FLAT_TYPE_LABEL), product_type),
        F.concat(F.lit(fv.FLAT_SOURCE_LABEL), source),
    )
    return F.array_join(F.concat(head, body), "\n\n")
