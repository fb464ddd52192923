"""Whitening against the eigenvectors of the whole covariance."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from trovelake.llm.queries import op11_whitening
from trovelake.llm.whitening import RANK, whiten


def check(rows: list, got: list, k: int) -> None:
    """Rows (id, vector) against their result, by length of vector."""
    valid = [(i, v) for i, v in rows if v and None not in v]
    lengths = {len(v) for _, v in valid}
    size = 0
    for d in lengths:
        own = [(i, v) for i, v in valid if len(v) == d]
        fit = sorted({tuple(v) for _, v in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
        cov = centred.T @ centred / n
        values = np.linalg.eigvalsh(cov)[::-1]
        count = int((values > RANK * values[0]).sum()) if values[0] > 0 else 0
        count = min(count, k)
        size += count * len(own)
        mine = [r for r in got if (r.vec_id, r.deviation) in {
            (i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in own} and r.n == n]
        assert len(mine) >= count * len(own)
        if not count:
            continue
        by = {}
        for r in mine:
            by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
        assert all(sorted(c) == list(range(1, count + 1)) for c in by.values())
        for r in mine:
            assert abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-6
            assert r.identity_error < 1e-6
        white = np.zeros((n, count))
        for at, v in enumerate(fit):
            i = next(i for i, w in own if tuple(w) == v)
            dev = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
            for c in range(count):
                same = by[(i, dev)][c + 1]
                white[at, c] = same[0].whitened
        # Whitened columns span eigenspaces: X' w is the covariance's action on the component.
        axes = centred.T @ white / n
        for c in range(count):
            axis = axes[:, c] / math.sqrt(values[c])
            assert abs(np.linalg.norm(axis) - 1) < 1e-6
            assert np.linalg.norm(cov @ axis - values[c] * axis) < 1e-6 * values[0]
        assert np.abs(white.T @ white / n - np.eye(count)).max() < 1e-6
    assert len(got) == size


@pytest.mark.parametrize(("d", "n", "k"), [(5, 40, 3), (6, 4, 16), (3, 30, 16)])
def test_whiten(spark, d, n, k):
    rng = np.random.default_rng(d)
    rows = [(i, (rng.integers(-50, 50, d) * (1 + np.arange(d)) + 1_000_000).tolist()) for i in range(n)]
    rows += [(100, rows[0][1]), (101, None), (102, [1] * (d - 1) + [None]), (103, []), (None, rows[1][1]), (2, rows[2][1])]
    df = spark.createDataFrame([(a, b, 0, 0.5) for a, b in rows], "vec_id long, x array<long>, component int, n double")
    check(rows, whiten(df, components=k).collect(), k)


def test_equal_eigenvalues_and_huge_values(spark):
    corners = [(i, [1_000_000 + (7 if j == i // 2 else 0) * (-1) ** i for j in range(4)]) for i in range(8)]
    df = spark.createDataFrame(corners, "vec_id long, x array<long>")
    check(corners, whiten(df, components=3).collect(), 3)
    huge = [(i, [(1 << 58) * (i % 3), (1 << 58) * (i % 2)]) for i in range(6)]
    got = whiten(spark.createDataFrame(huge, "vec_id long, x array<long>")).collect()
    check(huge, got, 16)
    lengths = [(i, [i * i] * (1 + i % 2) + [5 - i]) for i in range(12)]
    check(lengths, whiten(spark.createDataFrame(lengths, "vec_id long, x array<long>")).collect(), 16)


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [3, 4]), (2, [3, 4])], "vec_id long, x array<long>")
    assert whiten(one).count() == 0 and whiten(one.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 5)).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(60, vectors[3], 1), (61, None, 1), (62, [1.0, None, 1.0, 1.0, 1.0], 1), (63, [math.inf] * 5, 1), (64, [math.nan] * 5, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_whitening(spark, str(tmp_path)).collect()
    stepped = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, _ in rows[:61]]
    check(stepped, got, 16)
    wide = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 0.0])]
    spark.createDataFrame(wide, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "wide" / "embeddings.parquet"))
    assert {r.vec_id for r in op11_whitening(spark, str(tmp_path / "wide")).collect()} == {0, 1, 2}
