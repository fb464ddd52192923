"""Keeping a vector collection current from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trovelake.operators.chunking import chunk_documents
from trovelake.operators.embedding import Embedder, HashingEmbedder
from trovelake.plans.index import embed_chunks
from trovelake.sources.documents import clean_documents
from trovelake.sources.vector_store import VectorCollection


def upsert_stream(
    documents: DataFrame,
    collection: VectorCollection,
    checkpoint: str,
    strategy: str = "recursive",
    embedder: Embedder | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Chunk, embed and upsert every micro-batch of a streaming document source.

    A micro-batch is named by the id that Spark keeps in the checkpoint and its batch id: run
    again after a failure it replaces its own rows and nothing else, so the effect is exactly
    once, and streams, checkpoints and direct upserts may share a collection.
    """
    embedder = embedder or HashingEmbedder()

    def upsert(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.read.schema("id string").json(f"{checkpoint}/metadata").first().id
        chunks = chunk_documents(clean_documents(batch), strategy)
        collection.upsert(embed_chunks(chunks, embedder), writer=stream, batch=batch_id)

    writer = documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
