"""Corpus pipeline over ``documents``: language ID, near-duplicate removal, suffix dedup, packing.

The stages take any columns beside doc_id, text (and lang for training) and return them
unchanged under their own names: what a stage adds for its work gets a name that the input
does not have.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelake.llm import language_id, ngram_join, packing, suffix_dedup
from trovelake.llm.tables import stored, unique_keys

#: The 8 bits of a plain byte and one for an escape: a text that costs more a byte in its best language is
#: in none of them.
FOREIGN_BITS = 9.0


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, also in another case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; null texts and texts without a letter go.

    The trees are fitted on the documents' own language tags, which are no input of a prediction.
    A text goes whose code in the predicted, cheapest language is longer than the text itself and
    an escape for each byte (``FOREIGN_BITS``), as that of an unknown alphabet or of random characters.  Where no
    text has a tag, no language can be told apart and every text with a letter stays.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (row,) = _unused(docs, "row")
    scored = language_id.predict(docs.select(F.struct("*").alias(row), F.col("text").alias("text")), model)
    told = scored.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("bits_per_byte") <= FOREIGN_BITS))
    return told.select(f"{row}.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    Documents without words are in no group and stay.  All columns pass through.
    """
    (key,) = _unused(docs, "key")
    keyed = unique_keys(docs, "doc_id", key)
    found = ngram_join.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80)
    kept = found.where("keep").select(F.col("doc_id").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also begin earlier; a character goes only as a whole.

    Documents of which nothing is left go; null texts stay null.  ``n_chars`` follows the text.
    """
    key, none, kept = _unused(docs, "key", "none", "kept")
    keyed = unique_keys(docs, "doc_id", key)
    cut = suffix_dedup.remove_repeats(
        keyed.select(F.col(key).alias("doc_id"), "text"), whole_characters=True
    ).where("n_bytes > n_removed or n_bytes = 0")
    cut = cut.select(F.col("doc_id").alias(key), F.decode("kept", "utf-8").alias(kept))
    rest = keyed.withColumn(none, F.col("text").isNull()).drop("text").join(cut, key)
    out = rest.withColumn("text", F.when(~F.col(none), F.col(kept)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents with their places in training sequences."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("ngram_join", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_documents),
]

#: Trained code lengths and tokenizer ids are beyond SQL; a test holds ``run`` against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
