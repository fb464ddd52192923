"""Array files read by many tasks against the multi-line reader, and written by many tasks."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trovelake.sources import json_array
from trovelake.sources.documents import DOCUMENT_SCHEMA, load_documents, write_clean_documents
from trovelake.sources.json_array import read_json_array, write_json_array

ODD = ['say "hi"', "}{][", "\\", '\\"}', "a\nb", "é€😀", "", "{\"x\": [1, 2]}", "end\\\\", '"', "],[", "\t"]


def documents(seed: int, n: int) -> list[dict]:
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(ODD, k=rng.randint(0, 9)))
    rows = []
    for i in range(n):
        row = {"doc_id": f"d{i}", "title": text(), "product_type": rng.choice(["loan", None]), "updated_at": text(), "source": text(),
               "extra": {"deep": [[{"a": text()}], {}]}, "sections": [{"heading": text(), "text": text()} for _ in range(rng.randint(0, 3))]}
        rows.append({k: row[k] for k in rng.sample(list(row), len(row))})
    return rows


def same(spark, path: str, names: list[str]) -> list:
    """Rows by the multi-line reader, file by file in the order of names."""
    out = []
    for name in names:
        out += spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/{name}").collect()
    return out


@pytest.mark.parametrize(("indent", "block"), [(2, 97), (None, 997), (None, 1 << 27)])
def test_equals_the_multi_line_reader(spark, tmp_path, indent, block):
    for name, n in (("a.json", 60), ("b.json", 1), ("c.json", 0), ("e.json", 2)):
        (tmp_path / name).write_text(json.dumps(documents(n, n), indent=indent, ensure_ascii=n == 60) + ("\n" if n == 1 else ""), "utf-8")
    (tmp_path / "d.json").write_text(json.dumps(documents(9, 1)[0], indent=indent), "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        tasks = json_array._records(spark, str(tmp_path)).rdd.getNumPartitions()
        got = read_json_array(spark, str(tmp_path), DOCUMENT_SCHEMA)
        rows = got.orderBy("doc_pos").drop("doc_pos").collect()
        assert got.select("doc_pos").distinct().count() == len(rows)
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")
    assert tasks > 20 or block > 1000
    assert rows == same(spark, str(tmp_path), ["a.json", "b.json", "c.json", "d.json", "e.json"])


def test_groups_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_array, "BROADCAST_RANGES", 1)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(documents(i, 4)), "utf-8")
    got = read_json_array(spark, str(tmp_path), DOCUMENT_SCHEMA).orderBy("doc_pos").drop("doc_pos").collect()
    assert got == same(spark, str(tmp_path), ["0.json", "1.json", "2.json"])


@pytest.mark.parametrize("text", ['[{"doc_id": "a"}', '[{"doc_id": "a}]', "null", '[1, {"doc_id": "a"}]'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_json_array(spark, str(tmp_path), DOCUMENT_SCHEMA).collect()


def test_arrays_are_written_whole_or_not(spark, tmp_path):
    rows = spark.createDataFrame([tuple(d.get(f) for f in DOCUMENT_SCHEMA.names[:5]) for d in documents(3, 40)], "doc_id string, title string, product_type string, updated_at string, source string")
    path = write_json_array(rows.repartition(5), str(tmp_path / "out"))
    files = sorted(Path(path).glob("part-*"))
    assert len(files) == 5 and sum(len(json.loads(f.read_text("utf-8"))) for f in files) == 40
    back = read_json_array(spark, path, rows.schema)
    assert sorted(map(str, back.drop("doc_pos").collect())) == sorted(map(str, rows.collect()))
    empty = write_json_array(rows.limit(0), str(tmp_path / "empty"))
    assert read_json_array(spark, empty, rows.schema).count() == 0
    broken = rows.withColumn("title", F.when(F.col("doc_id") == "d7", F.raise_error(F.lit("no"))).otherwise(F.col("title")))
    with pytest.raises(Exception):
        write_json_array(broken.repartition(5), str(tmp_path / "failed"))
    assert not list((tmp_path / "failed").rglob("part-*")) and not (tmp_path / "failed" / "_SUCCESS").exists()


def test_clean_documents_round_trip(spark, sample, tmp_path):
    path = write_clean_documents(sample, str(tmp_path / "clean"), array=True)
    again = load_documents(spark, path)
    assert sorted(map(str, again.drop("doc_pos").collect())) == sorted(map(str, sample.drop("doc_pos").collect()))
