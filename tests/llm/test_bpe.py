"""BPE through the distinct-word table against the library itself."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trovelake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t ", "Hello WORLD's it'll 12³¼ ½ don't''s ...'s x_y", "<|endoftext|>a<|startoftext|> B<|ENDOFTEXT|>",
    "İstanbul ﬁne é ÀÇ ß ẞ Σας ΟΔΟΣ 日本語 漢字 한글 🙂🙂 áb   x y\x1cz\x85w ​", "ª º ² ÿ \xad soft",
    "Ａ ｆｕｌｌ ١٢٣ ৪ क्षि ก็ \x00\x01 \x7f tail", "word " * 5000, "Ɏ ƻ ǀ ȁ́", "﻿bom ퟿ \U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(spark, library, rows, columns="doc_id long, text string, ids int, decoded string, block int"):
    df = spark.createDataFrame([(i, t, 0, "x", 1)[: len(columns.split(","))] for i, t in rows], columns)
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows)
    wanted = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == wanted
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)


def test_against_library(spark, library):
    check(spark, library, list(enumerate(TEXTS)))


def test_repeated_rows_and_null_ids(spark, library):
    check(spark, library, [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "f"), (None, None)])


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_decode_bounds(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, None, 10**6, -5, 49407])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: "", 2: "", 3: "! <|endoftext|>"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the given tables")
def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, library, [(r.doc_id, r.text) for r in docs])
