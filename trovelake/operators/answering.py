"""Answers from contexts, prompts, citation checks and the relevance gate.

Contexts of a question are an array of at most k structs, so every step is a
row-wise expression and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import (
    extract_citations,
    let,
    overlap_count,
    split_sentences,
    strip,
    tokenize,
)

STRINGS = "array<string>"


def collect_contexts(contexts: DataFrame) -> DataFrame:
    """One row per question: ``contexts`` as an array in rank order (at most k elements)."""
    fields = ["rank"] + [c for c in contexts.columns if c not in ("qid", "rank")]
    return contexts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("contexts"))


def _bracketed(citation: Column) -> Column:
    return F.concat(F.lit("["), citation, F.lit("]"))


def extractive_answer(question: Column, contexts: Column) -> Column:
    """The two sentences of each context closest to the question, until four are found.

    Repeated sentences count once.  The first four are joined and up to three distinct
    citations follow.
    """
    start = F.struct(
        F.array().cast(STRINGS).alias("sentences"), F.array().cast(STRINGS).alias("citations")
    )

    def pick(tokens: Column) -> Column:
        def closest(text: Column) -> Column:
            scored = F.transform(
                split_sentences(text),
                lambda s, i: F.struct(
                    (-overlap_count(tokens, tokenize(s))).alias("o"), i.alias("i"), s.alias("s")
                ),
            )
            return F.transform(F.slice(F.array_sort(scored), 1, 2), lambda r: r["s"])

        def step(state: Column, context: Column) -> Column:
            cited = F.array(_bracketed(context["citation"]))
            grown = F.struct(
                F.array_union(state["sentences"], closest(context["text"])).alias("sentences"),
                F.array_union(state["citations"], cited).alias("citations"),
            )
            return F.when(F.size(state["sentences"]) >= 4, state).otherwise(grown)

        return F.aggregate(contexts, start, step)

    picked = let(tokenize(question), pick)
    text = strip(F.array_join(F.slice(picked["sentences"], 1, 4), " "))
    body = F.when(text == "", F.lit(fv.UNCERTAIN_ANSWER)).otherwise(text)
    sources = F.array_join(F.slice(picked["citations"], 1, 3), " ")
    answer = F.concat(body, F.lit("\n\n" + fv.ANSWER_SOURCES_LABEL), sources)
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, answer).otherwise(fv.NO_CONTEXT_ANSWER)


def citations_valid(answer: Column, contexts: Column) -> Column:
    """True when every [...] body is the citation of a context; also when there is none."""
    allowed = F.transform(contexts, lambda c: c["citation"])
    unknown = F.array_except(extract_citations(answer), allowed)
    return F.coalesce(F.size(unknown) == 0, F.lit(True))


def repair_citations(answer: Column, contexts: Column) -> Column:
    """An answer with a bad citation gets the first three contexts' citations appended."""
    good = F.array_join(F.transform(F.slice(contexts, 1, 3), lambda c: _bracketed(c["citation"])), " ")
    fixed = F.concat(answer, F.lit("\n\n" + fv.VERIFIED_SOURCES_LABEL), good)
    return F.when(citations_valid(answer, contexts), answer).otherwise(fixed)


def is_relevant(contexts: Column, minimum: float = fv.MIN_RELEVANCE) -> Column:
    """Gate on the stored score of the context ranked first."""
    first = F.get(contexts, F.lit(0))["score"]
    return F.coalesce(first >= minimum, F.lit(False))


def chat_messages(question: Column, contexts: Column, history: Column) -> Column:
    """Prompt as ARRAY<STRUCT<role, content>>: system, earlier turns, contexts with the question."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = F.flatten(
        F.transform(
            history, lambda t: F.array(message("user", t["user"]), message("assistant", t["assistant"]))
        )
    )
    blocks = F.transform(contexts, lambda c: F.concat(_bracketed(c["citation"]), F.lit("\n"), c["text"]))
    ask = F.concat(
        F.lit(fv.PROMPT_CONTEXT_LABEL),
        F.array_join(blocks, "\n\n"),
        F.lit(fv.PROMPT_QUESTION_LABEL),
        question,
    )
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(
        F.array(message("system", F.lit(fv.SYSTEM_PROMPT))),
        F.coalesce(turns, none),
        F.array(message("user", ask)),
    )
