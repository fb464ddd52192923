import random

import brute
import pytest
from pyspark.sql import functions as F

from trovelake.functions.text import tokenize
from trovelake.operators import bm25, vector_search
from trovelake.operators.vector_search import mmr_topk, vector_topk
from trovelake.runtime import per_block

random.seed(7)
DIM = 6
# Few distinct values give many exact ties; a zero, an empty, a short and a long vector are included.
VECTORS = [[float(random.choice([-1, 0, 1])) for _ in range(DIM)] for _ in range(60)]
VECTORS += [[0.0] * DIM, [], [1.0, 2.0], [1.0] * (DIM + 3)]
GROUPS = ["a" if i % 3 == 0 else "b" for i in range(len(VECTORS))]
QUERIES = [[1.0, 0.0, 1.0, -1.0, 0.0, 1.0], [0.0] * DIM, [-1.0, -1.0, 0.0, 0.0, 1.0, 0.5]]
WORDS = ["вклад", "ставка", "the", "cat", "5%", "дом", "банк"]
TEXTS = [" ".join(random.choice(WORDS) for _ in range(random.randint(0, 12))) for _ in range(50)]
TOKENS = [t.split() for t in TEXTS]
ASKED = ["ставка the the", "дом", "zebra", "", "5% банк cat вклад"]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i // 8, i % 8, g, v) for i, (g, v) in enumerate(zip(GROUPS, VECTORS))]
    return spark.createDataFrame(rows, "doc_pos bigint, piece bigint, g string, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i, 0, q, ["a", None, "b"][i]) for i, q in enumerate(QUERIES)]
    return spark.createDataFrame(rows, "qid bigint, variant int, embedding array<double>, g string")


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.doc_pos * 8 + r.piece, pytest.approx(r.score, abs=1e-9)))
    return out


def expected(k, score, allow=lambda q, i: True):
    out = {}
    for n, q in enumerate(QUERIES):
        ids = [i for i in range(len(VECTORS)) if allow(n, i)]
        scores = [score(q, VECTORS[i]) for i in ids]
        out[n] = [(ids[j], scores[j]) for j in brute.top(scores, k)]
    return out


@pytest.mark.parametrize("k", [1, 5, 100])
def test_vector_topk(vectors, queries, k):
    """Zero and negative scores are listed too, and ties keep corpus order."""
    assert found(vector_topk(vectors, queries, k)) == expected(k, brute.cosine)


def test_vector_topk_under_filters(vectors, queries):
    same = vector_topk(vectors, queries, 4, {"g": "a"})
    assert found(same) == expected(4, brute.cosine, lambda q, i: GROUPS[i] == "a")
    wanted = ["a", None, "b"]
    own = vector_topk(vectors, queries, 4, query_filter="g")
    assert found(own) == expected(4, brute.cosine, lambda q, i: wanted[q] in (None, GROUPS[i]))
    assert vector_topk(vectors, queries, 4, {"nothing": "a"}).count() == 0


def test_distance_scores(vectors, queries):
    def score(a, b):
        n = max(len(a), len(b))
        a, b = a + [0.0] * (n - len(a)), b + [0.0] * (n - len(b))
        return 1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b)))

    assert found(vector_topk(vectors, queries, 6, metric="l2")) == expected(6, score)
    with pytest.raises(ValueError):
        vector_topk(vectors, queries, metric="l1")


def test_mmr(vectors, queries):
    got = found(mmr_topk(vectors, queries, 5, 12, 0.65))
    for n, q in enumerate(QUERIES):
        near = brute.top([brute.cosine(q, v) for v in VECTORS], 12)
        picks = [i for i, _ in got[n]]
        assert picks[0] == near[0] and len(set(picks)) == 5 and set(picks) <= set(near)
        assert got[n] == [(i, brute.cosine(q, VECTORS[i])) for i in picks]


def test_mmr_by_hand(spark):
    """b is nearer than c but nearly a copy of a: -0.4 x 0.995 against -0.4 x 0.6."""
    data = [(0, 0, [1.0, 0.0]), (1, 0, [0.995, 0.1]), (2, 0, [0.6, 0.8])]
    corpus = spark.createDataFrame(data, "doc_pos bigint, piece bigint, embedding array<double>")
    query = spark.createDataFrame([(1, 0, [1.0, 0.0])], "qid bigint, variant int, embedding array<double>")
    order = {w: [r.doc_pos for r in mmr_topk(corpus, query, 3, 3, w).orderBy("rank").collect()] for w in (0.3, 0.9)}
    assert order == {0.3: [0, 2, 1], 0.9: [0, 1, 2]}


def test_mmr_without_diversity_is_similarity(vectors, queries):
    assert found(mmr_topk(vectors, queries, 5, 12, 1.0)) == found(vector_topk(vectors, queries, 5))


def test_query_blocks_do_not_change_results(vectors, queries):
    whole = found(vector_topk(vectors, queries, 5))
    split = per_block(queries, lambda b: vector_topk(vectors, b, 5, one_block=True), max_rows=1)
    assert found(split) == whole


def test_a_query_too_large_for_any_block_is_a_block_alone(spark):
    many = spark.createDataFrame([(i, ["x"] * (50 if i == 3 else 1)) for i in range(20)], "qid bigint, tokens array<string>")
    sizes = []

    def run(block):
        sizes.append(sorted(r.qid for r in block.collect()))
        return block

    assert per_block(many, run, weight="tokens", max_weight=10).count() == 20
    assert [3] in sizes and max(map(len, sizes)) <= 10


def test_the_shuffle_of_a_search_does_not_grow_with_the_scan(spark, tmp_path):
    """Few tasks take all splits, so the rows for the last ranking follow the cluster."""
    query = spark.createDataFrame([(1, 0, [1.0, 0.5])], "qid bigint, variant int, embedding array<double>")
    rows = []
    for splits in (8, 64):
        path = str(tmp_path / str(splits))
        data = spark.range(0, 6400, numPartitions=splits).select(
            F.col("id").alias("doc_pos"), F.lit(0).cast("bigint").alias("piece"),
            F.array(F.sin("id"), F.cos("id")).alias("embedding"))
        data.write.parquet(path)
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # one split per file
        hits = local_hits(spark.read.parquet(path), query)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        rows.append(hits)
    assert rows[0] == rows[1] <= 5 * 8


def local_hits(corpus, query):
    """Rows of the local top-k, counted below the final ranking."""
    seen = []
    real = vector_search.final_topk
    vector_search.final_topk = lambda hits, k: seen.append(hits.count()) or real(hits, k)
    try:
        vector_topk(corpus, query, 5).collect()
    finally:
        vector_search.final_topk = real
    return seen[0]


def test_a_heavy_term_keeps_its_hits(spark):
    """The sign is tested on the raw score, not on the rounded one."""
    rows = [(i, 0, "loan", ["the"]) for i in range(20)]
    chunks = spark.createDataFrame(rows, "doc_pos bigint, piece bigint, product_type string, tokens array<string>")
    terms = spark.createDataFrame([("the", 20, 1e-12)], "term string, df bigint, idf double")
    query = spark.createDataFrame([(1, 0, ["the"])], "qid bigint, variant int, tokens array<string>")
    assert bm25.bm25_topk(chunks, terms, (20, 1.0), query, 5).count() == 5


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, 0, "loan" if i % 2 else "faq", t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_pos bigint, piece bigint, product_type string, text string")
    return bm25.with_tokens(df).repartition(4).cache()


@pytest.fixture(scope="module")
def statistics(texts):
    stats = bm25.corpus_stats(texts).first()
    return bm25.term_stats(texts, stats.n), (stats.n, stats.avgdl)


def asked(spark, wanted=None):
    rows = [(i, 0, t, wanted) for i, t in enumerate(ASKED)]
    df = spark.createDataFrame(rows, "qid bigint, variant int, text string, product_type string")
    return df.withColumn("tokens", tokenize(F.col("text")))


def test_bm25_topk(spark, texts, statistics):
    """Repeated query words count repeatedly; chunks without tokens count in the statistics."""
    rows = bm25.bm25_topk(texts, *statistics, asked(spark), 7).orderBy("qid", "rank").collect()
    for n, query in enumerate(ASKED):
        scores = brute.bm25(TOKENS, query.split())
        order = [i for i in brute.top(scores, 7) if scores[i] > 0]
        mine = [(r.doc_pos, pytest.approx(r.score, abs=1e-9)) for r in rows if r.qid == n]
        assert mine == [(i, scores[i]) for i in order]


@pytest.mark.parametrize("per_query", [True, False])
def test_bm25_statistics_stay_global_under_filters(spark, texts, statistics, per_query):
    how = {"query_filter": "product_type"} if per_query else {"filters": {"product_type": "loan"}}
    rows = bm25.bm25_topk(texts, *statistics, asked(spark, "loan"), 5, **how).orderBy("rank").collect()
    for n, query in enumerate(ASKED):
        scores = [s if i % 2 else 0.0 for i, s in enumerate(brute.bm25(TOKENS, query.split()))]
        order = [i for i in brute.top(scores, 5) if scores[i] > 0]
        assert [(r.doc_pos, pytest.approx(r.score)) for r in rows if r.qid == n] == [(i, scores[i]) for i in order]


def test_postings_are_counted_without_a_shuffle(texts):
    df = bm25.postings(texts)
    found = {(r.doc_pos, r.term): (r.tf, r.dl) for r in df.collect()}
    assert found == {(i, w): (t.count(w), len(t)) for i, t in enumerate(TOKENS) for w in t}
    below = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in below and "Repartition" not in below.split("InMemoryRelation")[0]


def test_later_batches_rank_only_what_can_be_among_the_best(monkeypatch):
    """A batch is searched for its own k-th best only until a task knows k good rows of each query."""
    import numpy as np
    import pyarrow as pa

    from trovelake.operators import block_search

    class Here:  # the task's function instead of a data frame
        select = coalesce = lambda self, *a: self
        mapInArrow = lambda self, run, schema: run

    calls = []
    best = block_search._best
    monkeypatch.setattr(block_search, "_best", lambda *a: calls.append(1) or best(*a))
    monkeypatch.setattr(block_search, "search_tasks", lambda corpus: 1)
    rng = np.random.default_rng(3)
    table = np.round(rng.random((30, 200, 400)), 2)  # batches x queries x rows, with many ties
    keys = np.stack([np.arange(200), np.zeros(200, int)], axis=1)
    kernel = lambda batch: lambda ids, rows: table[batch.column(0)[0].as_py() // 400][ids]
    run = block_search.local_topk(Here(), "x", keys, None, None, kernel, 5, positive=True)
    batches = (pa.RecordBatch.from_arrays([pa.array(np.arange(i * 400, i * 400 + 400)), pa.array(np.zeros(400, int))], names=["doc_pos", "piece"]) for i in range(30))
    (hits,) = run(batches)
    whole = table.transpose(1, 0, 2).reshape(200, -1)
    wanted = [(q, d, whole[q, d]) for q in range(200) for d in np.lexsort((np.arange(12_000), -whole[q]))[:5]]
    got = zip(*(hits.column(c).to_pylist() for c in ("qid", "doc_pos", "score")), strict=True)
    assert sorted(got) == sorted(wanted) and len(calls) < 20


def test_rows_without_a_query_term_score_nothing():
    import numpy as np

    total, none = np.zeros((2, 3)), np.zeros(0, int)
    bm25.add_gains(total, np.arange(2), [], none, none, np.zeros(0))
    assert not total.any()
    bm25.add_gains(total, np.array([4, 7]), [(np.array([7, 9]), np.array([2, 1]))], np.array([0]), np.array([0, 2]), np.array([0.5, 1.0]))
    assert total.tolist() == [[0, 0, 0], [1, 0, 2]]
