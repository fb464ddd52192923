"""Periodic runs against a plain search over all periods, also through the registered query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trovelake.llm.grams import CHUNK_BYTES
from trovelake.llm.periodic_runs import Suffixes, WaveletTree, periodic_runs, runs
from trovelake.llm.queries import op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list) -> list[tuple[int, int, int]]:
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                least.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted((s, length, q) for (s, length), q in least.items())


def collapsed(words: list, found: list) -> str:
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequence(rng: random.Random) -> list[str]:
    """Nested repeats of all kinds: runs within the periods of runs, broken ones, shifted ones."""
    words = rng.choices("abc", k=rng.randint(1, 4))
    for _ in range(rng.randint(0, 5)):
        cut = rng.randrange(len(words) + 1)
        words = rng.choice([words * rng.randint(2, 6), words + rng.choices("abcd", k=rng.randint(1, 5)), words[cut:] + words[:cut] * 3,
                            words[:cut] + ["x"] + words[cut:]])[:400]
    return words


def test_runs():
    rng = random.Random(5)
    texts = [sequence(rng) for _ in range(1000)]
    texts += [["a"] * n for n in range(12)] + [list("ab") * 3, list("ab") * 4, list("aabaab") * 4, list("aaaab") * 9, list("aaaaaaab") * 4]
    for words in texts:
        codes = np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint64)
        assert list(zip(*(c.tolist() for c in runs(codes)), strict=True)) == brute(words), words


def test_wavelet_tree_and_suffix_array():
    rng = np.random.default_rng(1)
    values = rng.permutation(100)
    tree = WaveletTree(values, 100)
    low = rng.integers(0, 100, 500)
    high, x = low + rng.integers(0, 101 - low), rng.integers(0, 101, 500)
    wanted = [min((v for v in values[a:b] if v >= y), default=-1) for a, b, y in zip(low, high, x, strict=True)]
    assert tree.successor(low, high, x).tolist() == wanted
    codes = rng.integers(0, 3, 200).astype(np.uint64)
    assert Suffixes(codes).array.tolist() == sorted(range(200), key=lambda i: codes[i:].tolist())


def rows_of(seed: int) -> list:
    rng = random.Random(seed)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(sequence(rng))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, " \n"), (None, "a " * 9), (3, "ü ß " * 7), (-4, " ".join(map(str, range(50)))), (95, "w " * 700)]
    return rows


@pytest.mark.parametrize("long", [False, True])
def test_periodic_runs(spark, monkeypatch, long):
    rows = rows_of(1)
    if long:
        rows.append((96, " ".join(f"w{i % 60_001}" for i in range(260_000))))
        assert len(rows[-1][1]) > CHUNK_BYTES
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, runs int, start string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=repr)
    wanted = []
    for i, text in rows:
        words = WORD.findall(text or "")
        found = [(0, 260_000, 60_001)] if i == 96 else brute(words)
        wanted.append((i, len(words), found, collapsed(words, found)))
    assert got == sorted(wanted, key=repr)
    assert periodic_runs(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    """The registered query with its repeated tails, nulls and ties."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["é", "b", "cc", "d"], k=rng.randint(0, 60)))) for i in range(300)] + rows_of(2)[80:]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    wanted, changed = [], 0
    for i, text in rows:
        words, h = WORD.findall(text or ""), None if i is None else zlib.crc32(str(i).encode())
        n = len(words)
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [words[j if j < a else a + (j - a) % p] for j in range(n)], changed + 1
        found = brute(words)
        best = min(((-length, s, q) for s, length, q in found), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed(words, found))]
        four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        wanted.append((i, len(found), *four, *sha))
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    assert changed > 10 and sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
