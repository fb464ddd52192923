"""Query analysis: filter inference, expansion and history, as row-wise projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import overlap_count, tokenize

HALO = 4


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def infer_product(tokens: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Product sharing most distinct tokens with the query; first declared wins ties; null if none."""
    lexicon = fv.PRODUCT_KEYWORDS if lexicon is None else lexicon
    if not lexicon:
        return F.lit(None).cast("string")
    scored = F.array(
        *[
            F.struct(
                overlap_count(tokens, _words(words)).alias("n"),
                F.lit(-order).alias("order"),
                F.lit(product).alias("product"),
            )
            for order, (product, words) in enumerate(lexicon.items())
        ]
    )
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["product"])


def effective_product(
    explicit: Column, tokens: Column, lexicon: dict[str, list[str]] | None = None
) -> Column:
    """A given product wins; an empty text means no filter and no inference; null means infer."""
    return F.when(explicit.isNull(), infer_product(tokens, lexicon)).when(explicit != "", explicit)


def expanded_queries(query: Column, tokens: Column, rules=None) -> Column:
    """The query followed by one variant per triggered rule, in rule order."""
    rules = fv.EXPANSION_RULES if rules is None else rules
    variants = [query] + [
        F.when(F.arrays_overlap(tokens, _words(triggers)), F.concat(query, F.lit(" " + suffix)))
        for triggers, suffix in rules
    ]
    return F.filter(F.array(*variants), lambda v: v.isNotNull())


def explode_variants(queries: DataFrame, rules=None, multi: bool = True) -> DataFrame:
    """(qid, query, ...) to one row per variant with its text and tokens."""
    texts = (
        expanded_queries(F.col("query"), tokenize(F.col("query")), rules)
        if multi
        else F.array("query")
    )
    keep = [c for c in queries.columns if c != "query"]
    return queries.select(*keep, F.posexplode(texts).alias("variant", "text")).withColumn(
        "tokens", tokenize(F.col("text"))
    )


def with_history(question: Column, history: Column) -> Column:
    """Question prefixed by the last two (user, assistant) turns; unchanged without history."""
    recent = F.slice(history, F.greatest(F.size(history) - 1, F.lit(1)), F.lit(2))
    turns = F.transform(
        recent,
        lambda t: F.concat(
            F.lit(fv.HISTORY_USER_LABEL), t["user"], F.lit(fv.HISTORY_ASSISTANT_LABEL), t["assistant"]
        ),
    )
    text = F.concat(F.array_join(turns, " "), F.lit(fv.HISTORY_QUESTION_LABEL), question)
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, text).otherwise(question)


def conversation_questions(turns: DataFrame, segment: int = 64) -> DataFrame:
    """User turns with the up to two exchanges directly before them.

    ``turns``: conv_id, turn, role, text.  An exchange is a user turn answered by the next
    turn; anything else in between ends the history.  Only four turns back matter, so a
    conversation is cut into segments of turn numbers and a row near the end of one
    is copied into the next: a conversation with most of the rows is spread over many
    tasks, at one shuffle of 1 + 4/segment times the data.
    """
    own = F.floor(F.col("turn") / segment).cast("bigint")
    spill = F.pmod(F.col("turn"), F.lit(segment)) >= segment - HALO
    homes = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    rows = turns.select(
        "conv_id", "turn", "role", "text", own.alias("own"), F.explode(homes).alias("seg")
    )
    w = Window.partitionBy("conv_id", "seg").orderBy("turn")

    def back(d: int, role: str) -> Column:
        row = F.lag(F.struct("turn", "role", "text"), d).over(w)
        fits = (row["turn"] == F.col("turn") - d) & (row["role"] == role)
        return F.when(fits, row["text"])

    texts = [back(d, role) for d, role in ((1, "assistant"), (2, "user"), (3, "assistant"), (4, "user"))]
    seen = rows.select("*", *[t.alias(f"b{d}") for d, t in enumerate(texts, 1)])
    last = F.when(
        F.col("b1").isNotNull() & F.col("b2").isNotNull(),
        F.array(F.struct(F.col("b2").alias("user"), F.col("b1").alias("assistant"))),
    )
    prior = F.when(
        last.isNotNull() & F.col("b3").isNotNull() & F.col("b4").isNotNull(),
        F.array(F.struct(F.col("b4").alias("user"), F.col("b3").alias("assistant"))),
    )
    empty = F.array().cast("array<struct<user:string,assistant:string>>")
    history = F.concat(F.coalesce(prior, empty), F.coalesce(last, empty))
    return seen.where((F.col("seg") == F.col("own")) & (F.col("role") == "user")).select(
        "conv_id", "turn", F.col("text").alias("question"), history.alias("history")
    )
