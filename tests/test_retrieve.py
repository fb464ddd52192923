import pytest
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import overlap_ratio, tokenize
from trovelake.operators.embedding import HashingEmbedder
from trovelake.operators.fusion import compress_text
from trovelake.operators.query import infer_product
from trovelake.plans import retrieve as plan
from trovelake.plans.index import open_index
from trovelake.plans.retrieve import retrieve


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "qid bigint, query string, product_type string")


def listed(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.chunk_id, pytest.approx(r.score, abs=1e-9)))
    return out


def test_hybrid_retrieval_of_the_sample(spark, sample_index, sample_questions):
    """One product per inferred question, ranks by score plus overlap, and the expected document near the top."""
    queries = sample_questions.select("qid", F.col("question").alias("query"))
    found = retrieve(sample_index, queries, compress=False).join(queries, "qid")
    overlap = overlap_ratio(tokenize(F.col("query")), tokenize(F.col("text")))
    product = infer_product(tokenize(F.col("query")))
    rows = found.select("*", (F.col("score") + overlap).alias("order"), product.alias("inferred")).orderBy("qid", "rank").collect()
    expected = {r.qid: r.expected_doc_id for r in sample_questions.collect()}
    hits = 0
    for qid in expected:
        own = [r for r in rows if r.qid == qid]
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and 0 < len(own) <= 5
        assert len({r.chunk_id for r in own}) == len(own)
        assert own[0].inferred is None or {r.product_type for r in own} == {own[0].inferred}
        assert all(a.order >= b.order - 1e-9 for a, b in zip(own, own[1:]))
        hits += expected[qid] in {r.doc_id for r in own}
    assert hits >= 0.85 * len(expected)


def test_filter_is_respected_and_finds_the_document(spark, sample_index):
    question = ask(spark, (1, "Можно ли пополнять вклад Рост?", None))
    rows = retrieve(sample_index, question, filters={"product_type": "deposit"}).orderBy("rank").collect()
    assert rows and rows[0].doc_id == "savings_rates"
    assert all(r.product_type == "deposit" for r in rows)
    assert rows[0].citation == f"DOC-SV-30 / {rows[0].section}"
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))


def test_explicit_product_empty_product_and_no_inference(spark, sample_index):
    text = "кредит"
    rows = ask(spark, (1, text, "faq"), (2, text, ""), (3, text, None))
    found = retrieve(sample_index, rows)
    got = listed(found)
    products = {r.qid: set(r.p) for r in found.groupBy("qid").agg(F.collect_set("product_type").alias("p")).collect()}
    assert products[1] == {"faq"} and products[3] == {"loan"} and len(products[2]) > 1
    given = ask(spark, (3, text, "loan"))
    assert listed(retrieve(sample_index, given))[3] == got[3]
    plain = listed(retrieve(sample_index, rows, use_self_query=False))
    assert plain[3] == got[2]


def test_other_metadata_filters_and_unknown_keys(spark, sample_index):
    question = ask(spark, (1, "ставка", None))
    rows = retrieve(sample_index, question, filters={"source": "DOC-MO-20", "section": "Полис и залог"}).collect()
    assert [r.doc_id for r in rows] == ["house_mortgage"]
    assert retrieve(sample_index, question, filters={"colour": "red"}).count() == 0


@pytest.mark.parametrize("mode", fv.SEARCH_MODES)
def test_modes(spark, small_index, mode):
    rows = retrieve(small_index, ask(spark, (1, "процентная ставка", "")), k=3, mode=mode).collect()
    assert len(rows) == 3 and {r.retrieval_mode for r in rows} == {mode}
    assert len({r.chunk_id for r in rows}) == 3


def test_unknown_mode(spark, small_index):
    with pytest.raises(ValueError):
        retrieve(small_index, ask(spark, (1, "a", None)), mode="fuzzy")


def test_history_words_take_part(spark, small_index):
    """The rewritten text is the query: its earlier words decide the product."""
    text = "Клиент: ипотека Консультант: да Новый вопрос: какой срок?"
    rows = retrieve(small_index, ask(spark, (1, text, None))).collect()
    assert {r.product_type for r in rows} == {"mortgage"}


def test_query_blocks_do_not_change_results(spark, small_index, sample_questions, monkeypatch):
    queries = sample_questions.select("qid", F.col("question").alias("query")).where("qid < 6")
    whole = listed(retrieve(small_index, queries))
    monkeypatch.setattr(plan, "MAX_BLOCK_QUERIES", 15)  # three questions of five variants
    assert listed(retrieve(small_index, queries)) == whole


def test_compression_is_used_for_long_chunks(spark, sample, tmp_path):
    from trovelake.plans.index import build_index

    index = build_index(spark, sample, str(tmp_path / "long"), chunk_size=5000, splitter="window")
    long = index.chunks.withColumn("text", F.repeat(F.concat("text", F.lit(". ")), 5))
    index.chunks = long
    question = ask(spark, (1, "Какая ставка по кредиту?", ""))
    for r in retrieve(index, question).collect():
        source = long.where(F.col("chunk_id") == r.chunk_id).first().text
        short = compress_text(F.lit(source), tokenize(F.lit("Какая ставка по кредиту?")))
        assert r.text == spark.range(1).select(short).first()[0] and len(r.text) <= 520
    whole = retrieve(index, question, compress=False).collect()
    assert all(len(r.text) > 520 for r in whole)


def test_index_opens_again(spark, sample_index):
    again = open_index(spark, sample_index.path)
    assert (again.n, again.avgdl) == (sample_index.n, sample_index.avgdl)
    assert again.chunks.count() == again.n
    row = again.chunks.first()
    vector = HashingEmbedder().documents(F.col("text"))
    assert again.chunks.where(F.col("chunk_id") == row.chunk_id).select(vector).first()[0] == row.embedding
    assert row.norm == pytest.approx(1.0)


def test_searches_read_only_their_columns_and_push_the_filter_down(spark, sample_index):
    from trovelake.operators.vector_search import vector_topk

    query = spark.createDataFrame([(1, 0, [1.0] * 384)], "qid bigint, variant int, embedding array<double>")
    df = vector_topk(sample_index.chunks, query, filters={"product_type": "loan"})
    plan_text = df._jdf.queryExecution().executedPlan().toString()
    read = plan_text.split("ReadSchema: ")[1].split("\n")[0]
    assert "text" not in read and "tokens" not in read and "embedding" in read
    assert "EqualTo(product_type,loan)" in plan_text
    assert "CartesianProduct" not in plan_text and "NestedLoop" not in plan_text


def test_retrieval_shuffles_local_winners_and_questions_only(spark, sample_index):
    df = retrieve(sample_index, ask(spark, (1, "Какая ставка по кредиту?", None)))
    plan_text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan_text and "NestedLoop" not in plan_text
    # the searches have run; what is left partitions their few hits by question
    assert plan_text.count("Exchange hashpartitioning") == 1


def test_one_question_fetches_the_texts_of_its_hits_only(spark, sample_index):
    df = retrieve(sample_index, ask(spark, (1, "Какая ставка по кредиту?", None)))
    scan = df._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1]
    assert "EqualTo(doc_pos" in scan.split("PushedFilters: ")[1].split("\n")[0]
    assert "embedding" not in scan.split("ReadSchema: ")[1].split("\n")[0]


def test_added_documents_equal_a_rebuild(spark, sample, sample_index, tmp_path):
    from trovelake.plans.index import add_documents, build_index

    path = str(tmp_path / "grown")
    middle = sample.agg(F.median("doc_pos")).first()[0]
    old = build_index(spark, sample.where(F.col("doc_pos") < middle), path)
    grown = add_documents(spark, sample.where(F.col("doc_pos") >= middle), path)
    assert grown.stats == sample_index.stats
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(grown.terms, "term", "df", "idf") == rows(sample_index.terms, "term", "df", "idf")
    assert rows(grown.chunks, "doc_pos", "piece", "text") == rows(sample_index.chunks, "doc_pos", "piece", "text")
    before = old.chunks.count()
    again = build_index(spark, sample, path)  # a new version: readers of the others keep theirs
    assert old.chunks.count() == before < again.n == grown.chunks.count() == open_index(spark, path).n
    shifted = add_documents(spark, sample, path)
    assert shifted.n == 2 * again.n and shifted.chunks.select("doc_pos", "piece").distinct().count() == shifted.n


def test_index_is_stored_compressed(sample_index):
    """Texts, tokens and vectors are written in zstd."""
    import pyarrow.parquet as pq

    codecs = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(i).compression for f in sample_index.chunks.inputFiles() for i in range(10)}
    assert codecs == {"ZSTD"}
