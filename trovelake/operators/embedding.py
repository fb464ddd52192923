"""Embedding back ends.  An embedder maps a text and its tokens to an ARRAY<DOUBLE> column."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import tokenize

BACKEND_VARIABLE = "TROVELAKE_EMBEDDING_BACKEND"
HASHERS = ("blake2b", "md5")


class Embedder(Protocol):
    def documents(self, text: Column, tokens: Column | None = None) -> Column: ...

    def queries(self, text: Column, tokens: Column | None = None) -> Column: ...


def _digest(token: str, hasher: str) -> bytes:
    raw = token.encode("utf-8")
    if hasher == "blake2b":
        return hashlib.blake2b(raw, digest_size=8).digest()
    return hashlib.md5(raw).digest()


def _hash_vectors(tokens: pa.Array, dim: int, hasher: str) -> pa.Array:
    """Signed token counts per bucket, scaled to unit length; one row per token list."""
    n = len(tokens)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    vocabulary = pc.dictionary_encode(tokens.flatten())
    digests = [_digest(t, hasher) for t in vocabulary.dictionary.to_pylist()]
    bucket = np.array([int.from_bytes(d[:4], "big") % dim for d in digests], dtype=np.int64)
    sign = np.array([1.0 if d[4] % 2 == 0 else -1.0 for d in digests])
    codes = vocabulary.indices.to_numpy(zero_copy_only=False)
    cells = np.repeat(np.arange(n, dtype=np.int64) * dim, lengths) + bucket[codes]
    counts = np.bincount(cells, weights=sign[codes], minlength=n * dim).reshape(n, dim)
    norms = np.sqrt((counts * counts).sum(axis=1))
    norms[norms == 0] = 1.0
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array((counts / norms[:, None]).ravel()))


class HashingEmbedder:
    """Feature hashing of tokens.

    Narrow: one Arrow call per batch hashes the batch's distinct tokens once, so no
    vocabulary has to be shuffled or broadcast and a hot token costs nothing extra.
    ``md5`` exists because SQL engines have it, which makes results checkable in SQL.
    """

    def __init__(self, dimension: int = fv.EMBEDDING_DIM, hasher: str = "blake2b"):
        if hasher not in HASHERS:
            raise ValueError(f"Unknown hasher: {hasher}")
        self.dimension = dimension
        self.hasher = hasher

    def documents(self, text: Column, tokens: Column | None = None) -> Column:
        dim, hasher = self.dimension, self.hasher

        @F.arrow_udf("array<double>")
        def hash_vectors(batch: pa.Array) -> pa.Array:
            return _hash_vectors(batch, dim, hasher)

        return hash_vectors(tokenize(text) if tokens is None else tokens)

    queries = documents


def _load_sentence_transformer(name: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


class NeuralEmbedder:
    """Sentence-transformer vectors; the model is loaded once per Python worker.

    ``loader`` may return any object with ``encode(list, **options) -> 2-d array``.
    """

    def __init__(self, model_name: str = fv.NEURAL_MODEL, loader: Callable | None = None):
        self.model_name = model_name
        self.loader = loader or _load_sentence_transformer

    def _encode(self, text: Column, prefix: str) -> Column:
        name, loader = self.model_name, self.loader

        @F.arrow_udf("array<double>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = loader(name)
            for batch in batches:
                texts = [f"{prefix}{t}" for t in batch.to_pylist()]
                vectors = model.encode(texts, normalize_embeddings=True, show_progress_bar=False)
                yield pa.array(np.asarray(vectors, dtype=np.float64).tolist(), pa.list_(pa.float64()))

        return encode(text)

    def documents(self, text: Column, tokens: Column | None = None) -> Column:
        return self._encode(text, fv.PASSAGE_PREFIX)

    def queries(self, text: Column, tokens: Column | None = None) -> Column:
        return self._encode(text, fv.QUERY_PREFIX)


def create_embedder(backend: str | None = None, model_name: str = fv.NEURAL_MODEL) -> Embedder:
    """The named back end; without a name the environment variable, then 'hash'."""
    chosen = backend or os.getenv(BACKEND_VARIABLE, "hash")
    if chosen == "hash":
        return HashingEmbedder()
    if chosen == "sentence-transformers":
        return NeuralEmbedder(model_name)
    raise ValueError(f"Unknown embedding backend {chosen!r}: use 'hash' or 'sentence-transformers'")
