"""The corpus pipeline against brute force, stage by stage and as a whole, with clashing column names."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_oracles import SF_DIR, needs_tables
from test_ngram_join import brute as near_copies
from test_repeats import removed
from test_small_operators import brute_bits
from tokenizers import Tokenizer

import corpus_pipeline
from trovelake.llm import language_id

CLASHES = ("key", "none", "kept", "row", "score", "bits_per_byte", "lang_pred", "_guess", "_key", "_none", "_kept", "Row", "block")


def texts() -> list[tuple]:
    """doc_id, text, lang: two languages with copies, near copies, shared passages, nulls and junk."""
    rng = random.Random(3)
    words = {"en": ["the", "house", "and", "water", "of", "green", "then", "thanked", "with", "there", "market", "over"],
             "de": ["der", "Straße", "und", "Wasser", "für", "grün", "dann", "dankte", "mit", "schön", "Markt", "über"]}
    rows, n = [], 0
    passage = " ".join(f"{w}{i}" for i, w in enumerate(rng.choices(words["en"], k=40)))

    def add(text, lang):
        nonlocal n
        rows.append((n, text, lang))
        n += 3

    for _ in range(20):
        lang = rng.choice(["en", "de"])
        base = rng.choices(words[lang], k=rng.randint(3, 120))
        base = [w if rng.random() < 0.6 else w + rng.choice("aeiou") + rng.choice("nrst") for w in base]
        add(" ".join(base), lang)
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = words[lang][0]
            add(" ".join(copy), rng.choice([lang, None]))
        if rng.random() < 0.3:
            add(" ".join(base[:5]) + " " + passage + " " + " ".join(base[5:9]), lang)
    add(None, "en")
    add("", "de")
    add("12 -- 34", None)
    add("Привет, мир! Это русский текст о погоде.", None)
    add("日本語の文章です。今日は天気がいい。", None)
    add("zq9Xk7vJw2QpLx0ZbYf8Kd3", None)
    add("the house", None)
    add("ü" * 90 + " " + "ü" * 90, "de")
    return rows


def documents(spark, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long" + "".join(
        f", {c} string" for c in CLASHES if c != "Row")
    data = [(i, t, la, "s", None if t is None else len(t), *(f"{c}{i}" for c in CLASHES if c != "Row")) for i, t, la in rows]
    return spark.createDataFrame(data, kind)


def languages(rows):
    samples = {la: sorted({t.encode() for _, t, x in rows if x == la and t and any(c.isalpha() for c in t)}) for la in ("de", "en")}
    out = []
    for i, t, la in rows:
        if t and any(c.isalpha() for c in t):
            bits = min(brute_bits(own, t.encode(), language_id.ORDER) for own in samples.values()) / len(t.encode())
            if bits <= corpus_pipeline.FOREIGN_BITS:
                out.append((i, t, la))
    return out


def first_of_copies(rows):
    found, _ = near_copies([(i, t) for i, t, _ in rows], 5, 80)
    return [r for r in rows if found[r[0]][1] == r[0]]


def cut(rows):
    raw = [t.encode() for _, t, _ in rows]
    out = []
    for (i, t, la), gone in zip(rows, removed(raw, 100), strict=True):
        at, left = 0, []
        for c in t:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                left.append(c)
            at += size
        if left or not t:
            out.append((i, "".join(left), la))
    return out


def test_stages_and_run(spark, tmp_path):
    rows = texts()
    docs = documents(spark, rows)
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    docs, wanted, sizes = spark.read.parquet(path), sorted(rows), []
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (languages, first_of_copies, cut), strict=True):
        docs, wanted = stage(spark, docs, str(tmp_path)), brute(wanted)
        assert docs.columns == documents(spark, rows[:1]).columns, name
        got = sorted(docs.collect())
        assert [(r.doc_id, r.text, r.lang) for r in got] == wanted, name
        for r in got:
            assert r.n_chars == len(r.text) and all(r[c] == f"{c}{r.doc_id}" for c in CLASHES if c != "Row"), name
        sizes.append(len(wanted))
    assert len(rows) - sizes[0] == 6 and sizes[0] > sizes[1] >= sizes[2]
    assert any(a[1] != b[1] for a in rows for b in wanted if a[0] == b[0])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in wanted}
    found, filled = {}, {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = [int.from_bytes(p.ids[k : k + 4], "little") for k in range(0, len(p.ids), 4)]
        assert len(own) == p.length and p.doc_tokens == len(ids[p.doc_id])
        found.setdefault(p.doc_id, []).append((p.start, own))
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {i: sum((own for _, own in sorted(parts)), []) for i, parts in found.items()} == ids
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


@pytest.mark.parametrize("text", ["Привет, мир! Это русский текст.", "qzx kvjw zzxq wqpj vvkx", "日本語の文章です"])
def test_foreign_texts_go(spark, text):
    rows = [(i, f"the cat and the hat sat there with the other cats number {i % 3}", "en") for i in range(6)]
    kept = corpus_pipeline.keep_languages(spark, documents(spark, [*rows, (9, text, None), (10, "the hat", None)]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(6), 10]


def test_without_tags_and_empty(spark):
    docs = documents(spark, [(1, "Привет", None), (2, "12", None), (3, None, None)])
    assert [r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()] == [1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


@needs_tables
def test_given_documents_stay(spark):
    """Every given text with a letter is in a language of the corpus."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = corpus_pipeline.keep_languages(spark, docs, SF_DIR)
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
