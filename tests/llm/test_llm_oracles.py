"""Registered queries against their SQL on the smallest given tables, and the pipeline's stages."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trovelake.llm.oracles import ORACLES
from trovelake.llm.queries import QUERIES
from trovelake.llm.tables import corpus, unique_keys

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@needs_tables
@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wanted = con.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    wanted = sorted(map(repr, wanted.fetchall()))
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == wanted


def documents(spark, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, key int, _rank int"
    return spark.createDataFrame([(i, t, la, "s", None if t is None else len(t), 1, 2) for i, t, la in rows], kind)


def test_stages(spark):
    words = [f"wört{i}" for i in range(200)]
    long = " ".join(words)
    near = " ".join([*words[:199], "other"])
    passage = " ".join(words[40:80])
    rows = [(1, long, "de"), (2, near, "de"), (3, long, "de"), (4, "eigener Text " + passage + " Ende", "de"),
            (5, None, "de"), (6, "12 34", "de"), (7, "", "de"), (8, "ganz anders und klein", "de"), (8, "noch eine Zeile", None)]
    docs = documents(spark, rows)
    kept = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], ([1, 2, 3, 4, 8, 8], [1, 4, 8, 8], [1, 4, 8, 8]), strict=True):
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        assert sorted(r.doc_id for r in kept.collect()) == ids, name
    cut = {r.doc_id: r for r in kept.collect()}
    assert passage not in cut[4].text and cut[4].text.startswith("eigener Text") and cut[1].text == long
    assert cut[4].n_chars == len(cut[4].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


@needs_tables
def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert pieces.count() > 0 and pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_keys(spark):
    df = spark.createDataFrame([(2, "a"), (None, "b"), (2, "A"), (None, "b")], "doc_id long, text string")
    keys = [tuple(r) for r in unique_keys(df, "doc_id").orderBy("key").select("doc_id", "text").collect()]
    assert keys == [(None, "b"), (None, "b"), (2, "A"), (2, "a")]
    assert corpus(df.where("doc_id = 9")).rows == 0
    strings = spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string")
    assert [r.doc_id for r in corpus(strings).docs.orderBy("key").collect()] == ["a", "b"]
