"""Benchmark decontamination against a plain search for every window."""

from __future__ import annotations

import random
import re

import pytest

from trovelake.llm import decontamination
from trovelake.llm.decontamination import contamination

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return TERM.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def brute(documents: list, benchmark: list, size: int) -> list:
    windows = []
    for item, text in benchmark:
        ws = terms(text)
        m = min(size, len(ws))
        windows += [(item, ws[s : s + m]) for s in range(len(ws) - m + 1) if m]
    out = []
    for doc, text in documents:
        ws, hit, items = terms(text), set(), set()
        for item, window in windows:
            for s in range(len(ws) - len(window) + 1):
                if ws[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    items |= {item} - {None}
        out.append((doc, len(ws), len(hit), sorted(map(str, items))))
    return sorted(out, key=repr)


def sample(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    words = ["a", "B", "été", "x9", "Ünder", "the", "of", "42"]
    sentence = lambda n: rng.choice([" ", ", ", "--", "\n"]).join(rng.choices(words, k=n))
    benchmark = [(i, sentence(rng.choice([0, 1, 2, 3, 5, 6, 12, 30]))) for i in range(25)]
    benchmark += [(7, sentence(9)), (None, "only here without id one two three"), (26, None), (27, benchmark[8][1]), (28, "!?")]
    benchmark = [b for b in benchmark if len(terms(b[1])) != 1] + [(30, "Zebra")]
    documents = []
    for i in range(60):
        parts = [rng.choice([sentence(rng.randint(0, 40)), str(rng.choice(benchmark)[1] or ""), "zebra."]) for _ in range(4)]
        documents.append((i, rng.choice([" ", "; "]).join(parts)))
    documents += [(70, None), (71, ""), (None, documents[3][1]), (3, documents[5][1]), (72, "the of " * 800 + "ONLY here: without id one two three")]
    return documents, benchmark


@pytest.mark.parametrize("size", [10, 4, 1])
@pytest.mark.parametrize("small", [False, True])
def test_contamination(spark, monkeypatch, size, small):
    documents, benchmark = sample(size)
    if small:  # many blocks, pairs joined by a shuffle, short lanes
        for name, value in (("BLOCK_WINDOWS", 30), ("BROADCAST_PAIRS", 0), ("LOADED_BLOCKS", 1), ("_LANE", 3)):
            monkeypatch.setattr(decontamination, name, value)
    docs = spark.createDataFrame([(a, b, 1, "i") for a, b in documents], "doc_id long, text string, key int, items string")
    items = spark.createDataFrame([(a, b, 1) for a, b in benchmark], "item_id long, text string, m int")
    got = contamination(docs, items, words=size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(documents, benchmark, size)


def test_empty(spark):
    docs = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in contamination(docs, items).collect()] == [("x", 2, 0, [])]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], items.schema)).count() == 0
