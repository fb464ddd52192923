import random

import pytest
from pyspark.sql import functions as F

from trovelake.functions.text import tokenize
from trovelake.operators.fusion import compress_text, hybrid_fusion, merge_variants, rerank

SCHEMA = "qid bigint, variant int, side int, chunk_id string, score double, rank int, text string"


def hits(spark, near, words):
    rows = [
        (1, 0, side, i, s, rank, f"{side}:{i}:{rank}")
        for side, found in enumerate((near, words))
        for rank, (i, s) in enumerate(found, 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "near, words, fused",
    [
        (
            [("a", 0.9), ("b", 0.5), ("c", 0.1)],
            [("c", 7.0), ("d", 3.5)],
            [("a", 0.55), ("c", 0.55 / 9 + 0.45), ("b", 0.55 * 5 / 9)],
        ),
        ([("a", 0.5), ("b", 0.5)], [], [("a", 0.55), ("b", 0.55)]),
        ([], [("x", 2.0), ("y", 2.0)], [("x", 0.45), ("y", 0.45)]),
        ([("a", 0.0), ("b", -0.2)], [("b", 1.0)], [("b", 0.34), ("a", 0.0)]),  # a best of zero scales nothing
        ([("a", -0.1), ("b", -0.4)], [("c", 1.0)], [("b", 2.2), ("a", 0.55), ("c", 0.45)]),  # below zero: flipped
        ([("a", 0.8), ("b", 0.4)], [("b", 4.0), ("a", 2.0)], [("a", 0.775), ("b", 0.725)]),
    ],
)
@pytest.mark.parametrize("k", [1, 3])
def test_hybrid_fusion(spark, near, words, fused, k):
    rows = hybrid_fusion(hits(spark, near, words), k).orderBy("rank").collect()
    assert [(r.chunk_id, pytest.approx(r.score)) for r in rows] == fused[:k]


def test_fusion_collapses_equal_chunk_ids(spark):
    near = [("a", 1.0), ("a", 0.5)]
    row = hybrid_fusion(hits(spark, near, [("a", 2.0)]), 5).collect()
    assert len(row) == 1 and row[0].score == pytest.approx(0.55 * 1.5 + 0.45)
    assert row[0].text == "1:a:1"  # the last one listed


def test_merge_keeps_best_score_and_first_sight(spark):
    rows = [
        (1, 0, "a", 0.4, 1, "x"),
        (1, 0, "b", 0.3, 2, "y"),
        (1, 1, "b", 0.9, 1, "y2"),
        (1, 1, "a", 0.4, 2, "x2"),
    ]
    df = spark.createDataFrame(rows, "qid bigint, variant int, chunk_id string, score double, rank int, text string")
    got = {r.chunk_id: r for r in merge_variants(df).collect()}
    assert (got["a"].score, got["a"].text, tuple(got["a"].seen)) == (0.4, "x", (0, 1))
    assert (got["b"].score, got["b"].text, tuple(got["b"].seen)) == (0.9, "y2", (0, 2))


def test_rerank_adds_overlap_but_keeps_the_score(spark):
    rows = [
        (1, "a", 0.5, (0, 1), "nothing", ["cat", "dog"]),
        (1, "b", 0.2, (0, 2), "cat and dog", ["cat", "dog"]),
        (1, "c", 0.7, (1, 1), "a cat", ["cat", "dog"]),
        (1, "d", 0.7, (0, 3), "cat", ["cat", "dog"]),
    ]
    schema = (
        "qid bigint, chunk_id string, score double, seen struct<variant:int,rank:int>, text string, "
        "query_tokens array<string>"
    )
    got = rerank(spark.createDataFrame(rows, schema), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("b", 0.2), ("d", 0.7), ("c", 0.7)]


def compressed(spark, asked, text, limit=520):
    df = spark.createDataFrame([(asked, text)], "q string, t string")
    return df.select(compress_text(F.col("t"), tokenize(F.col("q")), limit)).first()[0]


def test_compression_edges(spark):
    assert compressed(spark, "a", "x" * 520) == "x" * 520
    assert compressed(spark, "a", "x" * 600) == "x" * 520  # the first sentence is always taken
    assert compressed(spark, "", ". . . ", 2) == ""
    assert compressed(spark, "b", "a a. b b. c c", 8) == "b b. a a."[:8].strip()


def test_compression_by_hand(spark):
    """The sentence with the asked word first, then those that still fit; the third does not."""
    assert compressed(spark, "кот", "дом дом. кот рад. вклад", 20) == "кот рад. дом дом."


def test_compression_properties(spark):
    random.seed(11)
    words = ["вклад", "кот", "dog", "5%", "дом"]
    cases = []
    for _ in range(40):
        parts = [" ".join(random.choice(words) for _ in range(random.randint(1, 14))) for _ in range(20)]
        cases.append((random.choice(words) + " кот", random.choice([". ", ".\n", ". . "]).join(parts)))
    df = spark.createDataFrame(cases, "q string, t string")
    for limit in (60, 200):
        got = df.select("q", "t", compress_text(F.col("t"), tokenize(F.col("q")), limit).alias("c")).collect()
        for r in got:
            said = {p.strip(" .\n") for p in r.t.replace("\n", " ").split(". ")}
            chosen = [p.strip(" .") for p in r.c.split(". ")]
            assert 0 < len(r.c) <= limit
            assert all(p in said for p in chosen[:-1]) and any(p.startswith(chosen[-1]) for p in said)
            asked = [len(set(r.q.split()) & set(p.split())) for p in chosen]
            assert asked[0] == max(len(set(r.q.split()) & set(p.split())) for p in said)
            assert asked[:-1] == sorted(asked[:-1], reverse=True)
