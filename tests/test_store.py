import random

import pytest
from pyspark.sql import functions as F

from trovelake.sources import vector_store
from trovelake.sources.vector_store import (
    VectorCollection,
    last_writer_wins,
    read_vectors,
    write_vectors,
)
from trovelake.streaming.upsert import upsert_stream

SCHEMA = "chunk_id string, doc_pos bigint, piece bigint, embedding array<double>, text string"


def rows(spark, *items):
    data = [(i, n, 0, v, t) for n, (i, v, t) in enumerate(items)]
    return spark.createDataFrame(data, SCHEMA)


def test_store_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    write_vectors(rows(spark, ("a", [1.0], "x"), ("b", [2.0], "y")), path)
    write_vectors(rows(spark, ("c", [3.0], "z")), path)
    assert [tuple(r) for r in read_vectors(spark, path).collect()] == [("c", 0, 0, [3.0], "z")]


def test_last_writer_wins_on_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.col("id").alias("version"),
    )
    kept = last_writer_wins(df, "key", "version")
    assert kept.count() == 2001
    assert kept.where("key = 'hot'").first().version == 2997


def test_collection_upsert(spark, tmp_path):
    collection = VectorCollection(spark, str(tmp_path))
    with pytest.raises(ValueError):
        collection.rows()
    assert collection.upsert(rows(spark, ("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y"), ("a", [1.0, 1.0], "x2"))) == 0
    assert {r.chunk_id: r.text for r in collection.rows().collect()} == {"a": "x2", "b": "y"}
    assert collection.upsert(rows(spark, ("b", [0.0, 2.0], "y2"), ("c", [2.0, 0.0], "z"))) == 1
    current = {"a": "x2", "b": "y2", "c": "z"}
    assert {r.chunk_id: r.text for r in collection.rows().collect()} == current
    collection.upsert(rows(spark, ("c", [2.0, 0.0], "z")), writer="w", batch=0)
    collection.upsert(rows(spark, ("d", [2.0, 0.0], "t")))
    collection.upsert(rows(spark, ("c", [2.0, 0.0], "z3")), writer="w", batch=0)  # repeated: replaces its own rows
    assert {r.chunk_id: r.text for r in collection.rows().collect()} == {**current, "c": "z3", "d": "t"}
    assert collection.versions() == [0, 1, 2, 3]


def test_tied_null_and_repeated_versions_give_one_row(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 1, "y"), ("b", None, "p"), ("b", 0, "q"), (None, None, "n"), ("c", None, "c"), ("c", None, "c")],
        "key string, version int, text string",
    )
    kept = {r.key: r.text for r in last_writer_wins(df.repartition(4), "key", "version").collect()}
    assert kept.pop("a") in ("x", "y") and kept == {"b": "q", None: "n", "c": "c"}


def test_collection_search_and_compaction(spark, tmp_path):
    collection = VectorCollection(spark, str(tmp_path / "one"), "named")
    collection.upsert(rows(spark, ("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y")))
    collection.upsert(rows(spark, ("a", [3.0, 0.0], "x2")))
    query = spark.createDataFrame([(1, 0, [0.0, 0.0])], "qid bigint, variant int, embedding array<double>")
    compacted = collection.compact(str(tmp_path / "two"))
    for stored in (collection, compacted):
        hits = stored.search(query, 2).orderBy("rank").collect()
        assert [h.score for h in hits] == [pytest.approx(0.5), pytest.approx(0.1)]
        assert [(h.chunk_id, h.text) for h in hits] == [("b", "y"), ("a", "x2")]
    assert compacted.versions() == [0]
    assert compacted.path.endswith("named")


def test_stream_of_documents_updates_a_collection(spark, tmp_path):
    schema = (
        "doc_id string, title string, product_type string, updated_at string, source string, "
        "sections array<struct<heading:string,text:string>>"
    )
    folder, collection = str(tmp_path / "in"), VectorCollection(spark, str(tmp_path / "out"))

    def arrive(*docs, source=folder, checkpoint="checkpoint"):
        data = [(i, "T", "loan", "", "S", [("h", text)]) for i, text in docs]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        upsert_stream(stream, collection, str(tmp_path / checkpoint)).awaitTermination()

    collection.upsert(rows(spark, ("before", [1.0], "kept")).withColumn("doc_id", F.lit("d0")))
    arrive(("d1", "first"), ("d2", "second"))
    collection.upsert(rows(spark, ("between", [1.0], "kept")).withColumn("doc_id", F.lit("d9")))
    arrive(("d1", "changed"), ("d3", "third"))
    arrive(("d4", "fourth"), source=str(tmp_path / "other"), checkpoint="fresh")
    texts = {r.doc_id: r.text for r in collection.rows().collect()}
    assert texts == {"d0": "kept", "d9": "kept", "d4": "T\nh\nfourth",
                     "d1": "T\nh\nchanged", "d2": "T\nh\nsecond", "d3": "T\nh\nthird"}


def newest(batches) -> dict:
    found = {}
    for batch in batches:
        found |= batch
    return found


@pytest.mark.parametrize("pages", [4096, 2])
def test_merge_on_read(spark, tmp_path, monkeypatch, pages):
    """Many batches of several files, small pages, one or more broadcasts: the newest row of every id, no row moved."""
    rng = random.Random(pages)
    monkeypatch.setattr(vector_store, "PAGE_ROWS", 64)
    monkeypatch.setattr(vector_store, "BROADCAST_PAGES", pages)
    collection, batches = VectorCollection(spark, str(tmp_path)), []
    for n in range(5):
        ids = [None, *rng.sample(range(300), 250 if n == 0 else 40)]
        batch = {None if i is None else f"c{i}": f"{n}/{i}" for i in ids}
        batches.append(batch)
        collection.upsert(rows(spark, *((i, [float(n)], t) for i, t in batch.items())).repartition(4))
    assert {r.chunk_id: r.text for r in collection.rows().collect()} == newest(batches)
    assert collection.rows().count() == len(newest(batches))
    plan = collection.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_bitmaps_of_repeated_and_concurrent_batches(spark, tmp_path, monkeypatch):
    collection = VectorCollection(spark, str(tmp_path))
    collection.upsert(rows(spark, ("a", [1.0], "1"), ("b", [1.0], "1"), ("c", [1.0], "1")), writer="w w/%")
    collection.upsert(rows(spark, ("b", [2.0], "2"), ("d", [2.0], "2")), writer="x")
    collection.upsert(rows(spark, ("a", [3.0], "3")), writer="y")
    collection.upsert(rows(spark, ("d", [4.0], "4"), ("c", [4.0], "4")), writer="x")  # repeated: gives b back, newer than 0 only
    assert {r.chunk_id: r.text for r in collection.rows().collect()} == {"a": "3", "b": "1", "c": "4", "d": "4"}
    other = VectorCollection(spark, str(tmp_path))
    monkeypatch.setattr(other, "batches", lambda: {})  # a writer that saw no batch takes version 0 as well
    other.upsert(rows(spark, ("e", [5.0], "5"), ("a", [5.0], "old")), writer="a")
    assert {r.chunk_id: r.text for r in collection.rows().collect()} == {"a": "3", "b": "1", "c": "4", "d": "4", "e": "5"}
