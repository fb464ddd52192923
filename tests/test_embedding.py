import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelake.operators.embedding import HashingEmbedder, NeuralEmbedder, create_embedder

TEXTS = {
    "": [],
    "Кредит кредит ставка 5%": ["кредит", "кредит", "ставка", "5%"],
    "the cat sat on the mat": ["the", "cat", "sat", "on", "the", "mat"],
    "ё е": ["е", "е"],
    "...": [],
    "a b c d e f g": list("abcdefg"),
}


@pytest.mark.parametrize("hasher", ["blake2b", "md5"])
def test_hash_vectors_like_brute_force(spark, hasher):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    embedder = HashingEmbedder(hasher=hasher)
    rows = {r.i: r.v for r in df.select("i", embedder.documents(F.col("t")).alias("v")).collect()}
    for i, tokens in enumerate(TEXTS.values()):
        assert len(rows[i]) == 384
        assert np.allclose(rows[i], brute.hash_vector(tokens, name=hasher), atol=0, rtol=0)


def test_queries_and_documents_agree_and_dimension_is_a_parameter(spark):
    df = spark.createDataFrame([("one two",)], "t string")
    embedder = HashingEmbedder(dimension=16)
    row = df.select(embedder.documents(F.col("t")).alias("d"), embedder.queries(F.col("t")).alias("q")).first()
    assert row.d == row.q and len(row.d) == 16


def test_neural_back_end_prefixes(spark):
    class LengthModel:  # local, so that it is pickled by value
        def encode(self, texts, normalize_embeddings, show_progress_bar):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",)], "t string")
    embedder = NeuralEmbedder("stub", loader=lambda name: LengthModel())
    row = df.select(embedder.documents(F.col("t")).alias("d"), embedder.queries(F.col("t")).alias("q")).first()
    assert row.d == [len("passage: abc"), 1.0]
    assert row.q == [len("query: abc"), 1.0]


def test_factory(monkeypatch):
    assert isinstance(create_embedder(), HashingEmbedder)
    assert isinstance(create_embedder("sentence-transformers"), NeuralEmbedder)
    monkeypatch.setenv("TROVELAKE_EMBEDDING_BACKEND", "sentence-transformers")
    assert isinstance(create_embedder(), NeuralEmbedder)
    assert isinstance(create_embedder("hash"), HashingEmbedder)
    with pytest.raises(ValueError):
        create_embedder("word2vec")
    with pytest.raises(ValueError):
        HashingEmbedder(hasher="crc")
