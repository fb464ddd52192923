import re

import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelake.functions import text as tx
from trovelake.functions.vector import cosine_similarity, squared_distance


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string")
    row = df.select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("  Кредит\t\tУдобный\x00 \r\n\n\n ставка  ", "Кредит Удобный\n\nставка"),
        ("a\rb\r\nc", "a\nb\nc"),
        ("a \t b", "a b"),
        ("a\n \n \n \nb", "a\n\nb"),
        (" a b \nc　", "a b\nc"),
        ("x\x0b\x1fy\x7f", "xy"),
        (" \n\t ", ""),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, tx.clean_text) == clean


def test_clean_text_keeps_null(spark):
    assert one(spark, None, tx.clean_text) is None


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Ставка 6,0% ЁЛКА ёж", ["ставка", "6", "0%", "елка", "еж"]),
        ("naïve Straße x x", ["na", "ve", "stra", "e", "x", "x"]),
        ("ДОХОД доход", ["доход", "доход"]),
        ("...", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, tx.tokenize) == tokens


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_tokens_are_the_folded_runs_of_a_text(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.k for r in rows.select("i", tx.tokenize(F.col("t")).alias("k")).collect()}
    for i, text in enumerate(texts):
        kept = re.findall("[a-zа-яё0-9%]", text, re.IGNORECASE)
        assert "".join(found[i]) == "".join(kept).lower().replace("ё", "е")
        assert all(found[i])
        assert found[i] == [w for part in found[i] for w in part.split()]


def test_two_sentence_splitters(spark):
    text = "Один. Два!  Три?\nЧетыре. 5.5 и всё "
    assert one(spark, text, tx.split_sentences) == ["Один.", "Два!", "Три?", "Четыре.", "5.5 и всё"]
    assert one(spark, text, tx.split_on_period) == ["Один", "Два!  Три? Четыре", "5.5 и всё"]


def test_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["a", "c"]), ([], ["a"])], "l array<string>, r array<string>")
    rows = df.select(tx.overlap_count(F.col("l"), F.col("r")), tx.overlap_ratio(F.col("l"), F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [(1, 0.5), (0, 0.0)]


def test_citation_fallbacks(spark):
    df = spark.createDataFrame(
        [("S", "d", "c", "h"), (None, "d", "c", None), (None, None, "c", "h")],
        "s string, d string, c string, h string",
    )
    cited = tx.citation(F.col("s"), F.col("d"), F.col("c"), F.col("h"))
    assert [r[0] for r in df.select(cited).collect()] == ["S / h", "d / ", "c / h"]


def test_extract_citations(spark):
    assert one(spark, "a [x / y] [] [z] [open", tx.extract_citations) == ["x / y", "z"]


def test_vector_scalars(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0]), ([3.0, 4.0, 12.0], [3.0, 4.0])],
        "a array<double>, b array<double>",
    )
    rows = df.select("a", "b", cosine_similarity(F.col("a"), F.col("b")), squared_distance(F.col("a"), F.col("b")))
    got = [(r[2], r[3]) for r in rows.collect()]
    assert got[0] == (pytest.approx(2**-0.5), 1.0)
    assert got[1][0] == 0.0 and got[2][0] == 0.0
    assert got[3] == (pytest.approx(brute.cosine([3, 4, 12], [3, 4])), 144.0)


def test_sql_functions(spark):
    tx.register_sql_functions(spark)
    row = spark.sql(
        "SELECT clean_text('  a\\t\\tb \\r\\n\\n\\n c ') AS c, tokenize('Ёж 5%') AS t, "
        "token_overlap(array('a', 'b'), array('a')) AS o, vector_cosine(array(1D, 0D), array(1D, 1D)) AS v"
    ).first()
    assert (row.c, row.t, row.o) == ("a b\n\nc", ["еж", "5%"], 0.5)
    assert row.v == pytest.approx(2**-0.5)


def test_clean_texts_are_left_alone(spark):
    """Cleaning and stripping equal their regular expressions on every short mix of blank space and control characters."""
    import random

    rng = random.Random(5)
    marks = ["a", "b.", " ", "\n", "\n\n", "\t", "\r", "\x00", "\x0b", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", " ", "﻿", "é", "😀"]
    rows = [(i, "".join(rng.choices(marks, k=rng.randrange(9)))) for i in range(6000)]
    rows += [(6000, None), (6001, "one\ntwo\n\nthree four")]
    texts = spark.createDataFrame(rows, "n long, t string")
    clean = F.col("t")
    for pattern, replacement in tx._CLEANING:
        clean = F.regexp_replace(clean, pattern, replacement)
    got = texts.select("t", clean.alias("a"), tx.clean_text(F.col("t")).alias("b"), F.regexp_replace("t", tx._EDGES, "").alias("c"), tx.strip(F.col("t")).alias("d"))
    found = got.collect()
    assert all(r.a == r.b and r.c == r.d for r in found)
    changed = {r.t for r in texts.join(got.where("a <> t"), "t").select("t").collect()}
    dirty = {r.t for r in texts.where(F.rlike("t", F.lit(tx._UNCLEAN))).select("t").collect()}
    assert changed <= dirty and "one\ntwo\n\nthree four" not in dirty
