import json

import pytest

from trovelake.cli import main


def run(capsys, tmp_path, *args):
    main(["--index-path", str(tmp_path / "index"), *args])
    return capsys.readouterr().out


def test_prepare_and_build(spark, capsys, tmp_path):
    out = json.loads(run(capsys, tmp_path, "prepare", "--output", str(tmp_path / "clean")))
    assert out == {"output": str(tmp_path / "clean")}
    built = json.loads(run(capsys, tmp_path, "build-index", "--strategy", "sentence"))
    assert built["store"] == "table" and built["chunks"] == 20
    stored = json.loads(
        run(capsys, tmp_path, "build-index", "--store", "collection", "--collection-path", str(tmp_path / "c"))
    )
    assert stored["store"] == "collection"
    assert spark.read.parquet(stored["path"]).count() == 20


def test_ask_and_evaluate(spark, capsys, tmp_path):
    with pytest.raises(SystemExit, match="no index"):
        run(capsys, tmp_path, "ask", "x")
    run(capsys, tmp_path, "build-index")
    out = run(capsys, tmp_path, "ask", "Какая доходность у вклада Копилка?", "--product-type", "deposit")
    answer, _, rest = out.partition("{")
    assert "DOC-SV-30" in answer and json.loads("{" + rest)["metadata"]["mode"] == "hybrid"
    metrics = json.loads(run(capsys, tmp_path, "evaluate-retrieval", "--k", "3"))
    assert metrics["questions"] == 20 and metrics["hit_rate_at_k"] >= 0.85


def test_stored_index_is_opened_and_quality_commands(spark, capsys, tmp_path):
    run(capsys, tmp_path, "ask", "вклад", "--build")
    files = sorted(p.name for p in (tmp_path / "index").rglob("*"))
    run(capsys, tmp_path, "ask", "вклад")
    assert sorted(p.name for p in (tmp_path / "index").rglob("*")) == files
    compared = json.loads(run(capsys, tmp_path, "compare-chunking"))
    assert set(compared) == {"size", "sentence", "recursive"} and all(m["questions"] == 20 for m in compared.values())
    quality = json.loads(run(capsys, tmp_path, "evaluate-rag"))
    assert all(0 < v <= 1 for v in quality["metrics"].values())
    latency = json.loads(run(capsys, tmp_path, "performance"))
    assert latency["cached_avg_ms"] < latency["baseline_avg_ms"]


def test_bad_arguments(tmp_path):
    with pytest.raises(SystemExit):
        main(["ask", "x", "--mode", "fuzzy"])
