import pytest
from pyspark.sql import functions as F

from trovelake import AnswerPipeline, fixed_values as fv
from trovelake.operators.generators import OllamaGenerator, RuleBasedGenerator
from trovelake.plans.answers import AnswerCache, answer_questions, first_requests, replay
from trovelake.plans.evaluate import (
    compare_chunking,
    evaluate_answers,
    evaluate_retrieval,
    measure_latency,
)


@pytest.fixture(scope="module")
def pipeline(sample_index):
    return AnswerPipeline(sample_index, RuleBasedGenerator())


def test_answer_with_a_valid_citation(pipeline):
    response = pipeline.answer("Какая процентная ставка по ипотеке Новый дом?", product_type="mortgage")
    assert "Источники: [DOC-MO-20 / " in response.answer
    assert response.contexts and response.latency_ms > 0
    assert response.metadata == {
        "mode": "hybrid",
        "product_type_filter": "mortgage",
        "cache_enabled": True,
        "citation_validation": True,
    }


def test_cache_ignores_history_and_k(pipeline):
    first = pipeline.answer("Какой первый взнос?", product_type="mortgage")
    again = pipeline.answer("Какой первый взнос?", [("a", "b")], product_type="mortgage", k=1)
    assert again is first
    fresh = AnswerPipeline(pipeline.index, cache_enabled=False)
    assert len(fresh.answer("Какой первый взнос?", product_type="mortgage", k=1).contexts) == 1


def test_refusal_keeps_its_contexts(spark, sample_index):
    asked = spark.createDataFrame([(1, "Какая ставка?")], "qid bigint, question string")
    row = answer_questions(sample_index, asked, RuleBasedGenerator(), min_relevance=5.0).first()
    assert row.answer == fv.LOW_RELEVANCE_ANSWER
    assert len(row.contexts) == 5 and row.citation_validation is True
    none = answer_questions(
        sample_index, asked.withColumn("product_type", F.lit("unknown")), RuleBasedGenerator()
    ).first()
    assert (none.answer, none.contexts, none.citation_validation) == (fv.LOW_RELEVANCE_ANSWER, [], True)


class BadGenerator:
    def generate(self, question, contexts, history):
        return F.lit("see [nowhere]")


def test_bad_citations_are_repaired_but_stay_invalid(spark, sample_index):
    asked = spark.createDataFrame([(1, "Какая ставка?")], "qid bigint, question string")
    row = answer_questions(sample_index, asked, BadGenerator()).first()
    assert row.answer.startswith("see [nowhere]\n\nПроверенные источники: [")
    assert row.citation_validation is False


REQUESTS = "qid bigint, question string, product_type string, mode string"


def test_first_request_of_a_hot_key_answers_all(spark):
    rows = [(i, "hot" if i % 3 else f"q{i}", None if i % 2 else "loan", "hybrid") for i in range(600)]
    requests = spark.createDataFrame(rows, REQUESTS)
    firsts = first_requests(requests)
    responses = firsts.withColumn("by", F.col("qid"))
    got = {r.qid: r.by for r in replay(requests, responses).collect()}
    first = {}
    for i, *key in rows:
        first.setdefault(tuple(key), i)
    assert got == {i: first[tuple(key)] for i, *key in rows}


def test_batch_with_a_stored_cache(spark, pipeline, tmp_path):
    cache = AnswerCache(spark, str(tmp_path / "answers"))
    asked = [(1, "Какая ставка?", None), (2, "Какая ставка?", None), (3, "Какая ставка?", "loan")]
    requests = spark.createDataFrame(asked, "qid bigint, question string, product_type string")
    first = {r.qid: r for r in pipeline.answer_batch(requests, cache=cache).collect()}
    assert len(first) == 3 and first[1].answer == first[2].answer
    assert cache.stored().count() == 2
    later = requests.where("qid = 3").withColumn("qid", F.lit(9).cast("bigint"))
    again = pipeline.answer_batch(later, cache=cache).collect()
    assert [(r.qid, r.answer) for r in again] == [(9, first[3].answer)]
    assert cache.stored().count() == 2
    assert cache.missing(later.withColumn("mode", F.lit("mmr"))).count() == 1


def test_one_stored_response_for_each_key(spark, pipeline, tmp_path):
    """Writers that did not see each other, and equal requests without the answers' own cache."""
    cache = AnswerCache(spark, str(tmp_path / "answers"))
    requests = spark.createDataFrame([(1, "q", None), (2, "q", None), (3, "q", "loan")], "qid bigint, question string, product_type string")
    plain = AnswerPipeline(pipeline.index, RuleBasedGenerator(), cache_enabled=False)
    assert plain.answer_batch(requests, cache=cache).count() == 3
    assert cache.stored().count() == 2
    kind = "qid bigint, question string, answer string, product_type string, mode string"
    for name, answer in (("a", "first"), ("b", "second")):
        row = spark.createDataFrame([(9, "new", answer, None, "hybrid")], kind)
        row.write.parquet(f"{cache.path}/version=5/batch={name}")  # two writers that took the same version
    cache.add(spark.createDataFrame([(9, "new", "late", None, "hybrid")], kind))
    for known in (cache, cache.compact(str(tmp_path / "compact"))):
        rows = known.stored().where("question = 'new'").collect()
        assert [r.answer for r in rows] == ["first"]
    asked = spark.createDataFrame([(1, "new", None)], "qid bigint, question string, product_type string")
    assert [r.answer for r in pipeline.answer_batch(asked, cache=cache).collect()] == ["first"]


def test_batch_without_cache_answers_every_request(spark, sample_index):
    requests = spark.createDataFrame([(1, "Вклад"), (2, "Вклад")], "qid bigint, question string")
    pipeline = AnswerPipeline(sample_index, RuleBasedGenerator(), cache_enabled=False)
    rows = pipeline.answer_batch(requests).collect()
    assert len(rows) == 2 and rows[0].answer == rows[1].answer


def test_retrieval_metrics_on_the_sample(sample_index, sample_questions):
    result = evaluate_retrieval(sample_index, sample_questions)
    metrics = result["metrics"].first()
    assert metrics.questions == 20
    assert metrics.hit_rate_at_k >= 0.85 and metrics.mrr >= 0.75
    report = result["per_question"].collect()
    assert len(report) == 20
    assert all(r.hit == (r.rank > 0) and 0 < len(r.top_chunks) <= 5 for r in report)
    assert all(r.top_chunks[r.rank - 1] == r.expected for r in report if r.hit)


def test_a_question_without_gold_is_a_miss(spark, sample_index, sample_questions):
    lost = sample_questions.where("qid < 2").withColumn(
        "expected_doc_id", F.when(F.col("qid") == 0, F.col("expected_doc_id")).otherwise("none")
    )
    metrics = evaluate_retrieval(sample_index, lost)["metrics"].first()
    assert (metrics.hit_rate_at_k, metrics.questions) == (0.5, 2)
    empty = evaluate_retrieval(sample_index, lost.where("qid < 0"))["metrics"].first()
    assert empty.questions == 0 and empty.mrr is None


def test_strategy_comparison(sample_index, small_index, sample_questions):
    rows = compare_chunking({"recursive": sample_index, "size": small_index}, sample_questions).collect()
    assert {r.strategy: r.questions for r in rows} == {"recursive": 20, "size": 20}


def test_answer_quality(pipeline, sample_questions):
    result = evaluate_answers(pipeline, sample_questions)
    assert set(result["metrics"]) == {"faithfulness", "answer_relevancy", "context_relevancy"}
    assert all(0 < v <= 1 for v in result["metrics"].values())


def test_latency_report(sample_index):
    report = measure_latency(sample_index, "вклад", runs=2)
    assert report["cached_avg_ms"] < report["baseline_avg_ms"]


def test_refused_questions_reach_no_service(spark, sample_index, tmp_path):
    calls = tmp_path / "calls"

    def post(url, data, timeout):  # local, so that it is pickled by value
        with open(str(calls), "a") as log:
            log.write("call\n")

        class Reply:
            def raise_for_status(self):
                pass

            def json(self):
                return {"message": {"content": "ok"}}

        return Reply()

    rows = spark.createDataFrame([(1, "вклад", "deposit"), (2, "zzz", "none")], "qid bigint, question string, product_type string")
    refused = answer_questions(sample_index, rows, OllamaGenerator(post=post), min_relevance=99.0).collect()
    assert [r.answer for r in refused] == [fv.LOW_RELEVANCE_ANSWER] * 2 and not calls.exists()
    answered = answer_questions(sample_index, rows, OllamaGenerator(post=post)).collect()
    assert sum(r.answer != fv.LOW_RELEVANCE_ANSWER for r in answered) == 1
    assert calls.read_text().count("call") == 1
