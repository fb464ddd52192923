"""Registered queries: each dealt operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelake.functions.text import let
from trovelake.llm import (
    bpe,
    chat_format,
    decontamination,
    embedding_dedup,
    language_id,
    ngram_join,
    packing,
    periodic_runs,
    substring_dedup,
    suffix_dedup,
    topk_search,
    warc,
    whitening,
)
from trovelake.llm.tables import stored
from trovelake.runtime import scratch_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _finite() -> Column:
    return F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    vectors = _read(spark, sf_dir, "embeddings").where(_finite()).select("vec_id", steps.alias("v"))
    queries = vectors.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    return topk_search.exact_top_k(vectors, queries, k=10)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repair_roles(_read(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"), words=4, percent=85).drop("keep")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_dir(spark)
    warc.write_archives(_read(spark, sf_dir, "pages"), archives)
    captures = warc.assemble(warc.read_records(spark, archives))
    page = F.regexp_extract(F.decode(F.col("metadata")[0]["payload"], "utf-8"), r"page_id: (-?\d*)", 1)
    read = stored(captures.select(
        "capture_id", page.try_cast("long").alias("page_id"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers"), F.octet_length("response.payload").cast("long").alias("size"),
        F.when(F.col("response.type") == "revisit", F.substring_index("response.digest", ":", -1))
        .otherwise(F.sha2("response.payload", 256)).alias("payload_digest")))
    first = read.select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("size").alias("full"))
    return read.join(first, "refers", "left").select(
        "page_id", F.coalesce("full", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(documents.where(F.coalesce(~held_out, F.lit(True))))
    scored = language_id.predict(documents.select("doc_id", "text"), model)
    return scored.withColumn("held_out", F.coalesce(held_out, F.lit(False))).drop("text")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Steps beyond these are cut, so that they stay a long; 64 * c reaches them from 2 ** 56 on.
_MOST = 1 << 62


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform("embedding", lambda c: F.least(
        F.greatest(F.floor(F.lit(64.0) * c.cast("double")), F.lit(-_MOST)), F.lit(_MOST)) + 1_000_000)
    vectors = _read(spark, sf_dir, "embeddings").where(_finite()).select("vec_id", steps.alias("x"))
    return whitening.whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _repeating(text: Column, h: Column) -> Column:
    """The words from a on begin anew every p words; a and p follow from the number h."""
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        return let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), lambda at: F.array_join(F.transform(
            words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, (at["a"] + (i - at["a"]) % at["p"]).cast("int")))), " "))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    return let(words, lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    texts = _read(spark, sf_dir, "documents").select(
        "doc_id", F.when(h % 10 == 0, _repeating(F.col("text"), h)).otherwise(F.col("text")).alias("text"))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        -r["length"], r["start"], r["period"]))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = periodic_runs.periodic_runs(texts).withColumn("best", F.when(F.size("runs") > 0, best))
    length = -F.col("best.col1")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_chat_format": op2_chat_format,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_bpe": op9_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}
