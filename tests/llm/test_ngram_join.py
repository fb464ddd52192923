"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from trovelake.llm.components import components
from trovelake.llm.ngram_join import near_duplicates, similar_pairs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None, words: int) -> frozenset:
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    found = WORD.findall(raw)
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(rows: list, words: int, percent: int) -> tuple[dict, set]:
    sets = {i: shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, ids = set(), sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
                links.add((a, b))
    return {i: (len(sets[i]), find(i)) for i in ids}, links


def sample(seed: int) -> list:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of", "AND", "é"]
    common = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for i in range(40):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 9, 40, 150, 400]))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], ["x", "y"]])
            rows.append(rng.choice([" ", "\n"]).join(copy).upper() + rng.choice(["", "", " " + common]))
    rows += [None, "", " \n", "a", "A", "a b", "a b c d"]
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 50), (4, 1, 100)])
def test_against_all_pairs(spark, monkeypatch, seed, words, percent):
    from trovelake.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TILE", 16)
    rows = sample(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    wanted, links = brute(rows, words, percent)
    got = near_duplicates(df, words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted
    assert len(got) == len(rows) and all(r.keep == (r.doc_id == r.component_id) for r in got)
    pairs = similar_pairs(df, words=words, percent=percent).collect()
    sets = {i: shingles(t, words) for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    distinct = {tuple(sorted((first[sets[a]], first[sets[b]]))) for a, b in links if sets[a] != sets[b]}
    assert sorted(tuple(sorted((r.doc_a, r.doc_b))) for r in pairs) == sorted(distinct)


def test_empty_and_repeated(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "q")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sum(r.keep for r in got) == 2


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(7, 2000 + i) for i in range(200)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {i: find(i) for i in linked}
