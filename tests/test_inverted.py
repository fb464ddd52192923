"""The stored inverted index against the corpus pass, and what a single question reads."""

import random

import pytest
from pyspark.sql import functions as F

from trovelake.operators import bm25, inverted


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    weights = [40 / (i + 1) for i in range(40)]
    rows = []
    for i in range(900):
        tokens = rng.choices(words, weights, k=rng.choice([0, 1, 3, 8, 8, 30]))
        rows.append((i // 3, i % 3, tokens, rng.choice(["a", "b", None]), f"s{i % 5}"))
    rows += [(400 + i, 0, ["w0", "w1", "w39"], "a", "s0") for i in range(40)]  # ties
    return spark.createDataFrame(rows, "doc_pos long, piece long, tokens array<string>, product_type string, source string").cache()


def asked(spark):
    rows = [(1, 0, ["w0"], None), (1, 1, ["w39", "w1", "w1"], "a"), (2, 0, ["none"], None), (3, 0, [], "b"),
            (4, 0, ["w0", "w1", "w39"], "b"), (5, 0, [f"w{i}" for i in range(40)], None), (6, 0, ["w38", "w37"], "c")]
    return spark.createDataFrame(rows, "qid long, variant int, tokens array<string>, product_type string")


@pytest.mark.parametrize(("query_filter", "filters", "small"), [
    (None, None, False), ("product_type", {"source": "s2"}, False), ("product_type", {"source": "s2"}, True)])
def test_same_rows(spark, chunks, tmp_path, monkeypatch, query_filter, filters, small):
    if small:  # many ranges and blocks of queries, shuffled joins, few scored first
        for name, value in (("RANGE", 16), ("GROUP", 3), ("FIRST", 1), ("BLOCK_QUERIES", 2), ("PUSHED", 2), ("BROADCAST_RANGES", 1)):
            monkeypatch.setattr(inverted, name, value)
    n, avgdl = bm25.corpus_stats(chunks).first()
    terms = bm25.term_stats(chunks, n)
    postings = inverted.read_postings(spark, inverted.write_postings(chunks, str(tmp_path / "p"), ("product_type", "source")))
    options = {"k": 5, "filters": filters, "query_filter": query_filter}
    wanted = bm25.bm25_topk(chunks, terms, (n, avgdl), asked(spark), **options)
    got = inverted.indexed_topk(postings, terms, (n, avgdl), asked(spark), **options)
    columns = ["qid", "variant", "rank", "doc_pos", "piece", "score"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(got) == rows(wanted) and wanted.count() > 5


def test_blocks_hold_every_posting(spark, chunks, tmp_path):
    postings = inverted.read_postings(spark, inverted.write_postings(chunks, str(tmp_path / "p")))
    found = postings.where("term is not null").select("term", F.explode(F.arrays_zip("slot", "tf")).alias("x"), "max_tf")
    wanted = bm25.postings(chunks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    got = found.groupBy("term").agg(F.count("*").alias("df"), F.sum("x.tf").alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert found.where("x.tf > max_tf").isEmpty()
    empty = inverted.read_postings(spark, inverted.write_postings(chunks.limit(0), str(tmp_path / "e")))
    assert empty.count() == 0


def bytes_read(spark, work) -> int:
    """Bytes that this process read from files while ``work`` ran."""
    def total():
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        return sum(f.getBytesRead() for f in files)

    before = total()
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # vectored reads are not counted
    work()
    spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    return total() - before


def test_one_question_reads_little(spark, tmp_path):
    """20 000 chunks: one question reads less than a tenth of the token column and skips ranges."""
    rng = random.Random(8)
    words = [f"term{i:05d}" for i in range(20_000)]
    rows = [(i, 0, rng.choices(words, k=60), "a") for i in range(20_000)]
    spark.createDataFrame(rows, "doc_pos long, piece long, tokens array<string>, product_type string").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    n, avgdl = bm25.corpus_stats(chunks).first()
    bm25.term_stats(chunks, n).write.parquet(str(tmp_path / "t"))
    terms = spark.read.parquet(str(tmp_path / "t"))
    postings = inverted.read_postings(spark, inverted.write_postings(chunks, str(tmp_path / "p")))
    one = spark.createDataFrame([(1, 0, ["term00007", "term01234", "term19999"])], "qid long, variant int, tokens array<string>")
    hits: list = []
    column = bytes_read(spark, lambda: chunks.select("tokens").write.format("noop").mode("overwrite").save())
    kept = terms.where(F.col("term").isin("term00007", "term01234", "term19999")).cache()
    kept.count()
    index = bytes_read(spark, lambda: hits.extend(inverted.indexed_topk(postings, kept, (n, avgdl), one).collect()))
    assert index < column / 10, (index, column)
    wanted = bm25.bm25_topk(chunks, terms, (n, avgdl), one).collect()
    key = lambda r: (r.rank, r.doc_pos, r.piece, r.score)
    assert sorted(map(key, hits)) == sorted(map(key, wanted))


@pytest.mark.parametrize(("filters", "query_filter"), [(None, None), ({"source": "s2"}, "product_type")])
def test_many_questions_share_one_pass(spark, chunks, tmp_path, filters, query_filter):
    """200 questions: every block of their terms is read and grouped once, whatever the number of questions."""
    rng = random.Random(6)
    rows = [(i, 0, rng.choices([f"w{j}" for j in range(50)], k=rng.choice([0, 1, 6, 20])), rng.choice(["a", "b", None])) for i in range(200)]
    many = spark.createDataFrame(rows, "qid long, variant int, tokens array<string>, product_type string")
    n, avgdl = bm25.corpus_stats(chunks).first()
    terms = bm25.term_stats(chunks, n)
    postings = inverted.read_postings(spark, inverted.write_postings(chunks, str(tmp_path / "p"), ("product_type", "source")))
    options = {"k": 5, "filters": filters, "query_filter": query_filter}
    hits = inverted.indexed_topk(postings, terms, (n, avgdl), many, **options)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") + plan.count("FlatMapCoGroupsInArrow") == 1
    columns = ["qid", "variant", "rank", "doc_pos", "piece", "score"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(hits) == rows(bm25.bm25_topk(chunks, terms, (n, avgdl), many, **options))


def test_no_null_lists_are_sent(spark, chunks, tmp_path):
    """Spark's Arrow writer takes the square of a batch's rows for a list column of nulls."""
    n, avgdl = bm25.corpus_stats(chunks).first()
    terms = bm25.term_stats(chunks, n)
    postings = inverted.read_postings(spark, inverted.write_postings(chunks, str(tmp_path / "p")))
    many = spark.createDataFrame([(i, 0, [f"w{i % 40}"]) for i in range(100)], "qid long, variant int, tokens array<string>")
    for queries in (many, many.limit(3)):
        hits = inverted.indexed_topk(postings, terms, (n, avgdl), queries, filters={"product_type": "a"})
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert all(f"coalesce({c}#" in plan for c in ("tf", "doc_pos", "piece", "dl", "of_product_type"))


def test_statistics_of_postings(spark, chunks, tmp_path):
    for name, rows in (("all", chunks), ("none", chunks.limit(0))):
        postings = inverted.read_postings(spark, inverted.write_postings(rows, str(tmp_path / name)))
        n, avgdl = inverted.postings_stats(postings)
        assert (n, avgdl) == tuple(bm25.corpus_stats(rows).first())
        assert sorted(map(tuple, inverted.postings_terms(postings, n).collect())) == sorted(map(tuple, bm25.term_stats(rows, n).collect()))


def test_index_query_needs_no_embeddings(spark, monkeypatch):
    from trovelake.plans import catalog

    for name in ("_indexes", "_postings"):
        monkeypatch.setattr(catalog, name, {})
    hits = catalog.bm25_index_topk(spark, "/root/testdata/sf0.001")
    assert hits.count() and not catalog._indexes
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, catalog.bm25_topk(spark, "/root/testdata/sf0.001").collect()))
