"""The persisted index: segments of embedded chunks with statistics that add up, and their manifest.

A folder holds versions of an index side by side.  A segment is written first, under a name of
its own; then one small file of the manifest, which Spark's commit moves into place at once,
names it.  A rebuild starts a new version with one segment, an addition adds a segment to the
newest version.  A reader takes the newest version as the manifest lists it when it opens the
index, so during a rebuild or an addition it sees the one or the other as a whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import tokenize
from trovelake.functions.vector import l2_norm
from trovelake.operators.bm25 import term_counts, with_idf
from trovelake.operators.chunking import chunk_documents
from trovelake.operators.embedding import Embedder, HashingEmbedder
from trovelake.sources.vector_store import read_vectors, write_vectors


@dataclass
class CorpusIndex:
    """Handle over the tables of one index folder.

    ``chunks`` holds the chunk key, chunk_id, text, metadata, tokens, embedding and norm.
    It is columnar, so every search reads only its own columns.
    """

    path: str
    chunks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    embedder: Embedder

    @property
    def stats(self) -> tuple[int, float]:
        return self.n, self.avgdl


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks with ``tokens``, ``embedding`` and ``norm``: a narrow plan, no zip of two lists."""
    tokenized = chunks.withColumn("tokens", tokenize(F.col("text")))
    embedding = embedder.documents(F.col("text"), F.col("tokens"))
    return tokenized.withColumn("embedding", embedding).withColumn("norm", l2_norm(F.col("embedding")))


def build_index(
    spark: SparkSession,
    documents: DataFrame,
    path: str,
    strategy: str = "recursive",
    embedder: Embedder | None = None,
    chunk_size: int = fv.CHUNK_SIZE,
    chunk_overlap: int = fv.CHUNK_OVERLAP,
    splitter: str = "window",
) -> CorpusIndex:
    """Chunk, embed and index documents under ``path`` as its newest version, in Parquet.

    One map-only pass writes the chunk table; the statistics aggregate its token
    column.  The only shuffle carries (term, count) rows that each task has combined.  Readers
    of the version before keep it; its files stay.
    """
    embedder = embedder or HashingEmbedder()
    chunked = chunk_documents(documents, strategy, chunk_size, chunk_overlap, splitter)
    known = [r.version for r in _manifest(spark, path)]
    _add_segment(spark, path, embed_chunks(chunked, embedder), max(known, default=-1) + 1, uuid.uuid4().hex)
    return open_index(spark, path, embedder)


def add_documents(
    spark: SparkSession,
    documents: DataFrame,
    path: str,
    strategy: str = "recursive",
    embedder: Embedder | None = None,
    chunk_size: int = fv.CHUNK_SIZE,
    chunk_overlap: int = fv.CHUNK_OVERLAP,
    splitter: str = "window",
    *,
    keep_positions: bool = False,
) -> CorpusIndex:
    """Add documents to the newest version of the index under ``path``, at the cost of their own chunks.

    They stand behind the documents that are there: where their ``doc_pos`` does not begin
    above those, all of it is shifted.  With ``keep_positions`` it stays as it is and must be
    new.  Additions at the same time are all kept and need it.
    """
    embedder = embedder or HashingEmbedder()
    there = _newest(_manifest(spark, path))
    if not there:
        raise ValueError(f"no index at {path}")
    last = max(r.last_doc for r in there)
    first = documents.agg(F.min("doc_pos")).first()[0]
    if not keep_positions and first is not None and first <= last:
        documents = documents.withColumn("doc_pos", F.col("doc_pos") + (last + 1 - first))
    chunked = chunk_documents(documents, strategy, chunk_size, chunk_overlap, splitter)
    _add_segment(spark, path, embed_chunks(chunked, embedder), there[0].version, there[0].build)
    return open_index(spark, path, embedder)


_MANIFEST = "version long, build string, segment string, n long, tokens long, last_doc long"


def _manifest(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest/*").collect()  # one row for each segment
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _newest(manifest: list) -> list:
    """The segments of the newest version, in the order of their documents."""
    newest = max(((r.version, r.build) for r in manifest), default=None)
    return sorted((r for r in manifest if (r.version, r.build) == newest), key=lambda r: (r.last_doc, r.segment))


def _add_segment(spark: SparkSession, path: str, embedded: DataFrame, version: int, build: str) -> None:
    segment = uuid.uuid4().hex
    folder = f"{path}/segments/{segment}"
    write_vectors(embedded, f"{folder}/chunks")
    chunks = read_vectors(spark, f"{folder}/chunks")
    term_counts(chunks).write.parquet(f"{folder}/terms")
    sums = chunks.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("doc_pos"), F.lit(-1)).alias("last_doc")).first()
    row = [(version, build, segment, sums.n, sums.tokens, sums.last_doc)]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.json(f"{path}/manifest/{segment}")


def open_index(spark: SparkSession, path: str, embedder: Embedder | None = None) -> CorpusIndex:
    """Open the newest version of a stored index; only its manifest is read."""
    segments = _newest(_manifest(spark, path))
    if not segments:
        raise ValueError(f"no index at {path}")
    n, tokens = (sum(r[c] for r in segments) for c in ("n", "tokens"))
    terms = spark.read.parquet(*(f"{path}/segments/{r.segment}/terms" for r in segments))
    if len(segments) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
    return CorpusIndex(
        path=path,
        chunks=spark.read.parquet(*(f"{path}/segments/{r.segment}/chunks" for r in segments)),
        terms=with_idf(terms, n),
        n=n,
        avgdl=tokens / n if n else 0.0,
        embedder=embedder or HashingEmbedder(),
    )
