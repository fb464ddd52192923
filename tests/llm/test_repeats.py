"""Substring and suffix dedup against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trovelake.llm import substring_dedup, suffix_dedup
from trovelake.llm.repeats import Repeats
from trovelake.llm.tables import corpus

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def removed(texts: list, size: int) -> list[list[bool]]:
    """Units that lie in a window whose units also begin earlier; texts in document order."""
    seen, out = set(), []
    for units in texts:
        gone = [False] * len(units)
        for s in range(len(units) - size + 1):
            window = tuple(units[s : s + size])
            if window in seen:
                gone[s : s + size] = [True] * size
            seen.add(window)
        out.append(gone)
    return out


def sample(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [rng.choice(["a", "b", "été", "x-y", "ß", "zz9"]) + str(i % 7) for i in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) for _ in range(6)]
    rows: list[tuple[int, str | None]] = []
    for i in range(70):
        parts = [rng.choice([*passages, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]) for _ in range(4)]
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (503, "a b " * 900), (504, "\n \t"), (505, "ab" * 700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("size", "anchor"), [(20, 6), (5, 2), (3, 3)])
def test_words(spark, seed, size, anchor):
    rows = sample(seed)
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, key int, block string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, min_words=size, seed_words=anchor).collect()}
    ordered = sorted(rows)
    words = [WORD.findall((t or "").encode()) for _, t in ordered]
    assert len(got) == len(rows)
    for (doc_id, _), units, gone in zip(ordered, words, removed(words, size), strict=True):
        r = got[doc_id]
        kept = b" ".join(u for u, g in zip(units, gone, strict=True) if not g).decode()
        assert (r.n_words, r.n_removed, r.kept) == (len(units), sum(gone), kept)


def test_long_texts_in_parts(spark, monkeypatch):
    """Texts cut for memory give the same result as whole ones."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([*rng.choices("abcdefgh", k=150), passage, *rng.choices("abc", k=150)])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for module, cut in ((substring_dedup, lambda t: WORD.findall(t.encode())), (suffix_dedup, lambda t: t.encode())):
        size = 20 if module is substring_dedup else 100
        wanted = [sum(g) for g in removed([cut(t) for _, t in rows], size)]
        from trovelake.llm import grams, repeats

        monkeypatch.setattr(repeats, "SEGMENT_UNITS", 130)
        monkeypatch.setattr(grams, "CHUNK_BYTES", 64)
        whole = Repeats(size, 6, "words" if size == 20 else "bytes", None)
        batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["key", "text"])
        places = [c for b in whole._stretches(iter([batch]), bytes(1 << 17)) for c in zip(*(x.to_pylist() for x in b.columns), strict=True)]
        covered = sum(p & 255 for _, _, _, p, run in places if not run) + sum(run for *_, run in places)
        assert covered == sum(max(0, len(cut(t)) - size + 1) for _, t in rows)
        assert [r.n_removed for r in module.remove_repeats(df).orderBy("doc_id").collect()] == wanted


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("size", "anchor"), [(100, 16), (30, 8), (9, 9), (5, 2)])
def test_bytes(spark, seed, size, anchor):
    rows = sample(seed)
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, key int, block string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, min_bytes=size, seed_bytes=anchor).collect()}
    ordered = sorted(rows)
    texts = [(t or "").encode() for _, t in ordered]
    for (doc_id, _), units, gone in zip(ordered, texts, removed(texts, size), strict=True):
        r = got[doc_id]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(u for u, g in zip(units, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(units), sum(gone), spans, kept)


def test_whole_characters(spark):
    df = spark.createDataFrame([(1, "xé" + "é" * 5), (2, "é" * 6 + "ß")], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(df, min_bytes=3, seed_bytes=2, whole_characters=True).collect():
        assert bytes(r.kept).decode() is not None


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (7, "other"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [
        (-1, 0, 0), (-1, 30, 0), (7, 1, 0), (7, 30, 30), (7, 30, 30)]


@pytest.mark.parametrize(("size", "anchor"), [(20, 6), (7, 2), (3, 3), (4, 3)])
@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_split_anchors(spark, size, anchor, unit):
    """Anchors of many stretches, split by side, give the same windows."""
    rows = sorted(sample(3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    resolve = substring_dedup.extend if unit == "words" else suffix_dedup.by_suffixes
    kind = Repeats(size, anchor, unit, resolve, split_rows=1)
    sides = [int(kind._side(np.array([5 << 16 | (size - anchor) << 8 | 1]), s)[0]) & 255 for s in (1, 2)]
    assert sum(sides) == 1
    got = set()
    for r in kind.find(corpus(df)).collect():
        got |= {(r.key, r.start + i) for i in range(r.run)}
    seen, wanted = set(), set()
    for doc_id, text in rows:
        units = WORD.findall((text or "").encode()) if unit == "words" else (text or "").encode()
        for s in range(len(units) - size + 1):
            window = tuple(units[s : s + size])
            if window in seen:
                wanted.add((doc_id, s))
            seen.add(window)
    assert got == wanted
