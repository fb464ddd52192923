"""Evaluation runs: retrieval metrics, chunking comparison, answer proxies, latency."""

from __future__ import annotations

import statistics
import time
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.operators.evaluation import (
    first_relevant_rank,
    mean_proxies,
    per_question_report,
    proxy_scores,
    retrieval_metrics,
)
from trovelake.plans.index import CorpusIndex
from trovelake.plans.answers import AnswerPipeline, answer_questions
from trovelake.plans.retrieve import retrieve

GOLD = ("qid", "question", "expected_doc_id", "expected_section")


def gold_ranks(
    index: CorpusIndex, questions: DataFrame, k: int = fv.TOP_K, gold: DataFrame | None = None, **options
) -> DataFrame:
    """First relevant rank of every question, searched in hybrid mode under its gold product.

    ``gold`` (qid, doc_id, section) lists all relevant places; without it the expected
    document and section of a question are its only one.
    """
    queries = questions.select("qid", F.col("question").alias("query"), "product_type")
    contexts = retrieve(index, queries, k, "hybrid", **options)
    return first_relevant_rank(questions.select(*GOLD), contexts, gold)


def evaluate_retrieval(
    index: CorpusIndex, questions: DataFrame, k: int = fv.TOP_K, **options
) -> dict[str, DataFrame]:
    """``metrics`` (hit rate, MRR, questions) and ``per_question`` over a question table.

    ``questions``: qid, question, expected_doc_id, expected_section, product_type.
    """
    ranks = gold_ranks(index, questions, k, **options)
    return {"metrics": retrieval_metrics(ranks), "per_question": per_question_report(ranks)}


def compare_chunking(
    indexes: dict[str, CorpusIndex], questions: DataFrame, k: int = fv.TOP_K, **options
) -> DataFrame:
    """One metrics row per chunking strategy, rounded to four digits.

    Strategies that name the same index are ranked once.
    """
    named: dict[int, list[str]] = {}
    for name, index in indexes.items():
        named.setdefault(id(index), []).append(name)
    ranks = [
        gold_ranks(indexes[names[0]], questions, k, **options).select(
            F.explode(F.array(*map(F.lit, names))).alias("strategy"), "rank"
        )
        for names in named.values()
    ]
    scored = retrieval_metrics(reduce(DataFrame.unionByName, ranks), "strategy")
    return scored.select(
        "strategy",
        F.round("hit_rate_at_k", 4).alias("hit_rate_at_k"),
        F.round("mrr", 4).alias("mrr"),
        "questions",
    )


def answer_proxies(pipeline: AnswerPipeline, questions: DataFrame) -> DataFrame:
    """Per question the three overlap proxies of its answer (product inferred)."""
    scores = proxy_scores(
        F.col("question"), F.col("expected_section"), F.col("answer"), F.col("contexts")
    )
    answers = answer_questions(
        pipeline.index,
        questions.select("qid", "question"),
        pipeline.generator,
        min_relevance=pipeline.min_relevance_score,
        **pipeline.options,
    )
    return answers.join(questions.select("qid", "expected_section"), "qid").select("qid", *scores)


def evaluate_answers(pipeline: AnswerPipeline, questions: DataFrame) -> dict[str, Any]:
    """Answer quality over all questions by the token-overlap proxies."""
    row = mean_proxies(answer_proxies(pipeline, questions)).first()
    return {"framework": "offline_proxy", "metrics": row.asDict()}


def measure_latency(
    index: CorpusIndex, question: str = fv.PERFORMANCE_QUESTION, runs: int = 3
) -> dict[str, Any]:
    """Mean latency without a cache and with one (whose first call is a miss)."""

    def mean_ms(pipeline: AnswerPipeline) -> float:
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            pipeline.answer(question)
            times.append(time.perf_counter() - started)
        return round(statistics.mean(times) * 1000, 2)

    return {
        "question": question,
        "baseline_avg_ms": mean_ms(AnswerPipeline(index, cache_enabled=False)),
        "cached_avg_ms": mean_ms(AnswerPipeline(index, cache_enabled=True)),
        "improvement": "answer cache over a stored index",
    }
