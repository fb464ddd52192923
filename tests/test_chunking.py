import random
import time

import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.operators.chunking import (
    apply_filters,
    chunk_documents,
    metadata_map,
    sliding_windows,
    split_text,
)
from trovelake.operators.separator_split import separator_pieces, split_by_separators


def windows(spark, text, size, overlap):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(sliding_windows(F.col("t"), size, overlap)).first()[0]


@pytest.mark.parametrize("length", [0, 1, 9, 10, 11, 13, 16, 17, 18, 23, 24, 25, 100])
@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (10, 9), (5, 5), (4, 9)])
def test_windows_at_the_borders(spark, length, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(length))
    assert windows(spark, text, size, overlap) == brute.windows(text, size, overlap)


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \né\U0001f600", max_size=80), st.integers(1, 12), st.integers(0, 14))
def test_windows_like_brute_force(spark, text, size, overlap):
    assert windows(spark, text, size, overlap) == brute.windows(text, size, overlap)


def test_windows_cover_a_long_text(spark):
    text = "word " * 40_000
    got = windows(spark, text.strip(), 420, 60)
    assert got == brute.windows(text.strip(), 420, 60)


@pytest.mark.parametrize("strategy", fv.CHUNK_STRATEGIES)
def test_strategies_create_metadata(sample, strategy):
    rows = chunk_documents(sample, strategy, 220, 30).collect()
    assert rows
    assert all(r.chunk_strategy == strategy and r.doc_id and r.section for r in rows)
    assert all(len(r.text) <= 220 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_chunk_ids_count_after_empty_pieces_are_dropped(spark):
    text = "a" * 6 + "\n\n" + "b" * 6
    doc = spark.createDataFrame(
        [(0, "d", "T", "p", "u", "s", [("h", text)])],
        "doc_pos bigint, doc_id string, title string, product_type string, updated_at string, "
        "source string, sections array<struct<heading:string,text:string>>",
    )
    whole = f"T\nh\n{text}"
    rows = chunk_documents(doc, "size", 2, 0).orderBy("piece").collect()
    assert [r.text for r in rows] == brute.windows(whole, 2, 0)
    assert [r.chunk_id for r in rows] == [f"d:h:size:{i}" for i in range(len(rows))]
    assert rows[3].chunk_index == "3"


def test_sentence_strategy_normalises_gaps(spark):
    df = spark.createDataFrame([("Один.\n\nДва!   Три",)], "t string")
    assert df.select(split_text(F.col("t"), "sentence", 100, 0)).first()[0] == ["Один. Два! Три"]


def test_unknown_strategy_and_splitter(sample):
    with pytest.raises(ValueError):
        chunk_documents(sample, "words")
    with pytest.raises(ValueError):
        chunk_documents(sample, "size", splitter="none")


def test_filters(sample):
    chunks = chunk_documents(sample)
    loans = apply_filters(chunks, {"product_type": "loan", "section": "Как погасить долг"}).collect()
    assert [r.doc_id for r in loans] == ["consumer_credit"]
    assert apply_filters(chunks, {"colour": "red"}).count() == 0
    assert apply_filters(chunks, {}).count() == chunks.count()


def test_metadata_map(sample):
    row = chunk_documents(sample).select(metadata_map(chunk_documents(sample)).alias("m")).first()
    assert set(row.m) == set(fv.METADATA_COLUMNS)


def separated(spark, text, separators, size, overlap):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(separator_pieces(F.col("t"), separators, size, overlap)).first()[0]


def test_separator_splitter_keeps_everything(spark):
    text = "Первое предложение. Второе предложение! Третье; четвертое, пятое.\n\nНовый абзац " + "x" * 90
    for name, separators in fv.SPLIT_SEPARATORS.items():
        for overlap in (0, 10):
            pieces = separated(spark, text, separators, 40, overlap)
            assert all(0 < len(p) <= 40 for p in pieces), name
            assert "".join(pieces).count("x") >= 90
            assert all(word in " ".join(pieces) for word in ("Первое", "Второе", "Третье", "пятое", "абзац"))


def test_separator_splitter_by_hand(spark):
    split = lambda t, n, o, s=(". ", " ", ""): separated(spark, t, s, n, o)
    assert split("aa bb cc", 100, 0) == ["aa bb cc"]
    assert split("aa bb cc", 5, 0) == ["aa bb", "cc"]
    assert split("aa bb cc", 6, 3) == ["aa bb", "bb cc"]  # the tail " bb" is kept
    assert split("one. two words. x", 8, 0) == ["one", ". two", "words", ". x"]  # the long part is cut at spaces
    assert split("abcdef", 3, 1) == ["abc", "cde", "ef"]
    assert split("abc de", 3, 0) == ["abc", "de"]  # a part of exactly the size is cut to letters and merged again
    assert split("", 5, 0) == [] and split(None, 5, 0) == [] and split("  \n ", 5, 0) == []


def test_separator_splitter_as_a_column(sample):
    rows = chunk_documents(sample, "recursive", 120, 20, splitter="separators").collect()
    assert rows and all(0 < len(r.text) <= 120 for r in rows)


def test_plan_has_no_shuffle_beyond_spreading_and_evaluates_windows_once(spark, sample):
    plan = chunk_documents(sample)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def fold(text, separators, size, overlap):
    """The specified scheme by plain lists: cut level by level, then merge settled parts of one run."""
    parts = [(text, 0, False)]
    for level, sep in enumerate(separators, 1):
        new = []
        for i, (t, run, settled) in enumerate(parts):
            if settled or not (level == len(separators) or not sep or sep in t):
                new.append((t, run, settled))
                continue
            own = list(t) if not sep else [p if n == 0 else sep + p for n, p in enumerate(t.split(sep))]
            new += [(p, (level, i), len(p) < size) for p in own if p]
        parts = new
    chunks, window, run = [], [], None
    for t, own, settled in parts:
        if not settled:
            chunks += ["".join(window), t]
            window, run = [], None
        elif own != run:
            chunks.append("".join(window))
            window, run = [t], own
        elif sum(map(len, window)) + len(t) > size:
            chunks.append("".join(window))
            while window and sum(map(len, window)) > min(overlap, size - len(t)):
                window.pop(0)
            window.append(t)
        else:
            window.append(t)
    return [c.strip() for c in [*chunks, "".join(window)] if c.strip()]


def test_separator_splitter_by_brute_force():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "bb", "é", " ", ". ", "\n", "\n\n", "! ", "xyz" * 5, " "], k=rng.randint(0, 60)))
        separators = rng.choice([*fv.SPLIT_SEPARATORS.values(), ("\n", " "), (". ", ""), ("bb",)])
        size, overlap = rng.randint(1, 30), rng.randint(0, 12)
        assert split_by_separators(text, separators, size, overlap) == (fold(text, separators, size, overlap) if text else [])


def test_separator_splitter_is_linear():
    rng = random.Random(1)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) + ". "
    text = "".join(sentence() for _ in range(9500))  # 800 KB
    times = []
    for part in (text, text * 12):  # 10 MB
        started = time.perf_counter()
        chunks = split_by_separators(part, fv.SPLIT_SEPARATORS["recursive"], 700, 120)
        times.append(time.perf_counter() - started)
        assert len(chunks) > len(part) / 700
    assert times[0] < 1 and times[1] < 40 * max(times[0], 0.05)


@pytest.mark.parametrize("strategy", ["size", "sentence", "recursive"])
def test_separator_slices_bound_python_memory(monkeypatch, strategy):
    """A batch of 16 MB never has more than a few slices' texts and chunks as Python objects, and slices change nothing."""
    import tracemalloc

    import pyarrow as pa

    from trovelake import fixed_values as fv
    from trovelake.operators import separator_split

    text = "One two three, four five. Six seven eight; nine ten! " * 80
    separators = fv.SPLIT_SEPARATORS[strategy]
    batch = pa.array([text, None, "", "short"] * 4000)
    tracemalloc.start()
    found = separator_split.split_texts(batch, separators, 420, 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(batch) and peak < batch.nbytes / 2
    few = batch[:40]
    wanted = [separator_split.split_by_separators(t, separators, 420, 60) for t in few.to_pylist()]
    for size in (1, 5000, 1 << 30):
        monkeypatch.setattr(separator_split, "SLICE", size)
        assert separator_split.split_texts(few, separators, 420, 60).to_pylist() == wanted
    assert separator_split.split_texts(batch[:0], separators, 420, 60).to_pylist() == []


def test_character_cuts_take_no_object_each():
    """A text of 1 MB that is cut between all its characters takes a few times its size, and is cut as before."""
    import tracemalloc

    text = "abcd efgh " * 100_000
    tracemalloc.start()
    chunks = split_by_separators(text, ("",), 700, 120)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(text) and len(chunks) == 1 + -(-(len(text) - 700) // 580)
    for size, overlap in ((1, 0), (1, 3), (2, 5), (7, 0), (7, 6), (30, 40), (30, -2)):
        for part in (text[:1], text[:30], text[:95]):
            assert split_by_separators(part, ("",), size, overlap) == fold(part, ("",), size, overlap)


def test_separator_slices_leave_one_by_one(spark, monkeypatch):
    """A worker hands over slice after slice and never joins the chunks of a batch."""
    import pyarrow as pa

    from trovelake.operators import separator_split

    batch = pa.array(["One two. Three four. " * 500, None, ""] * 300)
    sizes = [a.nbytes for a in separator_split.split_slices(batch, (". ", ""), 420, 60)]
    assert len(sizes) > 2 and max(sizes) < batch.nbytes / 2
    rows = spark.createDataFrame(pa.table({"i": pa.array(range(len(batch))), "t": batch})).coalesce(1)
    found = rows.select("i", separator_pieces(F.col("t"), (". ", ""), 420, 60).alias("p")).toArrow().sort_by("i")
    assert found["p"].to_pylist() == separator_split.split_texts(batch, (". ", ""), 420, 60).to_pylist()
