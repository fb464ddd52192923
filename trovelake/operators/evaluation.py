"""Retrieval metrics and answer-quality proxies as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelake.functions.text import let, overlap_ratio, tokenize


def first_relevant_rank(questions: DataFrame, contexts: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Per question the first rank at a relevant place, 0 if none, and the listed chunks.

    ``questions``: qid, question, expected_doc_id, expected_section.  ``gold`` (qid, doc_id,
    section) lists all relevant places of a question; without it the expected one counts.
    """
    label = F.concat_ws(" / ", F.col("doc_id"), F.col("section"))
    found = contexts.select("qid", "rank", "doc_id", "section", label.alias("label"))
    match = (F.col("doc_id") == F.col("expected_doc_id")) & (F.col("section") == F.col("expected_section"))
    if gold is not None:
        places = gold.select("qid", "doc_id", "section").distinct().withColumn("relevant", F.lit(True))
        found = found.join(places, ["qid", "doc_id", "section"], "left")
        match = F.col("relevant")
    listed = F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "label"))))
    return (
        questions.join(found, "qid", "left")
        .groupBy("qid", "question", "expected_doc_id", "expected_section")
        .agg(
            F.coalesce(F.min(F.when(match, F.col("rank"))), F.lit(0)).alias("rank"),
            F.transform(listed, lambda x: x["label"]).alias("top_chunks"),
        )
    )


def per_question_report(ranks: DataFrame) -> DataFrame:
    """question, expected, hit, rank and top_chunks per qid."""
    expected = F.concat(F.coalesce("expected_doc_id", F.lit("none")), F.lit(" / "), F.col("expected_section"))
    return ranks.select(
        "qid",
        "question",
        expected.alias("expected"),
        (F.col("rank") > 0).alias("hit"),
        "rank",
        "top_chunks",
    )


def retrieval_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """Hit rate, mean reciprocal rank and number of questions; nulls for an empty set."""
    hit = F.col("rank") > 0
    reciprocal = F.when(hit, F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0))
    return ranks.groupBy(*by).agg(
        F.avg(hit.cast("double")).alias("hit_rate_at_k"),
        F.avg(reciprocal).alias("mrr"),
        F.count("*").alias("questions"),
    )


def proxy_scores(question: Column, expected_section: Column, answer: Column, contexts: Column) -> list[Column]:
    """Faithfulness, answer relevancy and context relevancy of one response.

    A response without contexts has faithfulness and context relevancy 0.
    """
    asked, said = tokenize(question), tokenize(answer)
    texts = F.transform(contexts, lambda c: c["text"])
    ratios = let(
        F.array_union(asked, tokenize(expected_section)),
        lambda wanted: F.transform(texts, lambda t: overlap_ratio(wanted, tokenize(t))),
    )
    best = F.array_max(ratios)
    return [
        overlap_ratio(said, tokenize(F.array_join(texts, " "))).alias("faithfulness"),
        overlap_ratio(asked, said).alias("answer_relevancy"),
        F.coalesce(best, F.lit(0.0)).alias("context_relevancy"),
    ]


def mean_proxies(scores: DataFrame) -> DataFrame:
    names = ("faithfulness", "answer_relevancy", "context_relevancy")
    return scores.agg(*[F.avg(n).alias(n) for n in names])
