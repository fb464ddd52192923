"""Search with triangle bounds against the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelake.operators import pruned_search
from trovelake.operators.pruned_search import pruned_topk, skipped_share, write_pivoted
from trovelake.operators.vector_search import vector_topk


def table(spark, clustered: bool):
    rng = np.random.default_rng(int(clustered))
    centres = rng.standard_normal((12, 6)) * 5
    points = [(centres[i % 12] + rng.standard_normal(6) * (0.1 if clustered else 5)).tolist() for i in range(1500)]
    points += [points[3]] * 5 + [[0.0] * 6, [1.0, 2.0]]
    rows = [(i, i % 2, p, i % 3) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "doc_pos long, piece long, embedding array<double>, label int")


@pytest.mark.parametrize(("metric", "small"), [("cosine", False), ("l2", True)])
def test_same_rows(spark, tmp_path, monkeypatch, metric, small):
    monkeypatch.setattr(pruned_search, "CELL", 32)
    monkeypatch.setattr(pruned_search, "PIVOTS", 24)
    if small:
        for name, value in (("PUSHED", 1), ("BROADCAST_CELLS", 1), ("BLOCK_QUERIES", 9), ("FIRST", 1)):
            monkeypatch.setattr(pruned_search, name, value)
    vectors = table(spark, True)
    path = write_pivoted(vectors, str(tmp_path / "v"), metric)
    queries = vectors.where("doc_pos % 50 = 0 or doc_pos = 1505").where(F.size("embedding") == 6).select(
        F.col("doc_pos").alias("qid"), F.lit(0).alias("variant"), "embedding")
    got, wanted = pruned_topk(spark, path, queries, 5), vector_topk(vectors, queries, 5, metric=metric)
    columns = ["qid", "rank", "doc_pos", "piece", "score"]
    rows = lambda df: sorted((*r[:4], round(r[4], 8)) for r in df.select(*columns).collect())
    assert rows(got) == rows(wanted)
    if not small:
        assert skipped_share(spark, path, got, queries) > 0.5


def test_empty(spark, tmp_path):
    vectors = table(spark, False)
    path = write_pivoted(vectors.limit(0), str(tmp_path / "v"))
    queries = vectors.limit(2).select(F.col("doc_pos").alias("qid"), F.lit(0).alias("variant"), "embedding")
    assert pruned_topk(spark, path, queries).count() == 0
