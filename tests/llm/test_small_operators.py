"""Top-k, chat formatting, embedding dedup, WARC, packing and language ID against brute force."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trovelake.llm import chat_format, embedding_dedup, language_id, packing, topk_search, warc


# --- exact top-k ---------------------------------------------------------------------------


@pytest.mark.parametrize(("span", "k"), [(3, 4), (500, 10), (1 << 40, 3), (1 << 62, 2)])
def test_topk(spark, span, k):
    rng = random.Random(span)
    vectors = [(i, [rng.randint(-span, span) for _ in range(3)]) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(30)] + [(500, [1, 2]), (501, None), (None, [1, 2, 3]), (502, [1, None, 2])]
    vectors += [(503, []), (3, vectors[3][1])]
    df = spark.createDataFrame([(a, b, 0) for a, b in vectors], "vec_id long, v array<long>, score int")
    queries = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in topk_search.exact_top_k(df, queries, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    valid = [(i, v) for i, v in vectors if i is not None and v is not None and None not in v]
    least, most = -(1 << 63), (1 << 63) - 1
    for q, v in valid:
        if q % 10 == 0:
            scored = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), least), most), i)
                      for i, w in valid if i != q and len(w) == len(v)]
            wanted = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
            assert sorted(got.get(q, [])) == wanted
    assert topk_search.exact_top_k(df.limit(0), queries.limit(0)).count() == 0


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 4)
    df = spark.createDataFrame([(i, [i % 7, i % 5]) for i in range(60)], "vec_id long, v array<long>")
    assert topk_search.exact_top_k(df, df.withColumnRenamed("vec_id", "query_id"), 5).count() == 300


# --- chat formatting -----------------------------------------------------------------------


def cheapest(roles: list[str]) -> int:
    """Least cost over all ways to treat each turn, by plain search over states."""
    known = {"system": 1, "user": 2, "assistant": 3}
    after = {0: {1, 2}, 1: {2}, 2: {3}, 3: {2}}

    def gaps(state, depth=3):
        yield state, 0
        if depth:
            for t in after[state] - {1}:
                for end, n in gaps(t, depth - 1):
                    yield end, n + 1

    best = {0: 0}
    for role in roles:
        code, new = known.get((role or "").strip().lower(), 0), {}
        for state, paid in best.items():
            ways = [(state, 1 + (0 if code == state else 2))] if state else []
            ways += [(t, 0 if t == code else 2) for t in after[state]]
            ways += [(code, 3 * n) for s, n in gaps(state) if n and code in after[s]]
            for t, cost in ways:
                new[t] = min(new.get(t, 1 << 30), paid + cost)
        best = new
    return min((c + {0: 0, 1: 6, 2: 3, 3: 0}[s] for s, c in best.items()), default=0)


def test_chat(spark):
    rng = random.Random(3)
    names = ["user", "assistant", "system", "User ", "tool", None]
    rows, roles = [], {}
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 3, 9, 40])):
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), rng.choice(names), rng.choice(["hi", "", None, "a\nb"]), 1))
    rows += [(77, 1, "user", "same", 1)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    got = {}
    for segment in (4, 256):
        out = chat_format.repair_roles(df, segment=segment).orderBy("position").collect()
        assert len(out) == len(rows)
        got = {}
        for r in out:
            got.setdefault(r.conv_id, []).append(r)
        for conv, turns in got.items():
            rendered = "".join(t.rendered for t in turns)
            parts = rendered.split("<|im_start|>")
            assert parts[0] == "" and all(p.endswith("<|im_end|>\n") for p in parts[1:])
            order = [p.split("\n", 1)[0] for p in parts[1:]]
            order = order[1:] if order[0] == "system" else order
            assert order and order == ["user", "assistant"] * (len(order) // 2)
            assert sum(t.cost for t in turns) == cheapest([t.role for t in turns]), conv
            key = [(t.turn is not None, t.turn or 0, t.role is not None, t.role or "") for t in turns]
            assert key == sorted(key)
    assert chat_format.repair_roles(df.limit(0)).count() == 0


def test_chat_segments_are_bounded(spark, monkeypatch):
    """One conversation of null turns and one of equal rows: no segment is longer than asked, in rows or in bytes."""
    rng = random.Random(5)
    names = ["user", "assistant", "system", None]
    rows = [(None, rng.choice([None, None, 3]), rng.choice(names), f"t{rng.randint(0, 50)}") for _ in range(3000)]
    rows += [(2**60 + 1, 7, "assistant", "same")] * 1000 + [(1, 2**60 + 1, "user", "x" * 3000)] * 20
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat_format, "SEGMENT_BYTES", 10000)
    got = {}
    for r in chat_format.repair_roles(df, segment=32).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert {c: len(t) for c, t in got.items()} == {None: 3000, 2**60 + 1: 1000, 1: 20}
    for turns in got.values():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        assert sum(r.cost for r in turns) == cheapest([r.role for r in turns])
    assert {r.turn for r in got[1]} == {2**60 + 1}


def test_chat_cut_by_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "conv_id": [None] * 5 + [1, 1, 2], "turn": [None] * 8, "role": ["user"] * 8, "text": ["x"] * 8, "code": [2] * 8, "size": [1, 1, 1, 9, 9, 1, 1, 50]})
    context = type("Context", (), {"partitionId": lambda self: 4})()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chat_format.TaskContext, "get", lambda: context)
        halves = [batch.slice(0, 4), batch.slice(4)]
        out = [r for b in chat_format._segments(3, 10)(iter(halves)) for r in b.to_pylist()]
    assert [(r["run"], r["segment"], r["at"]) for r in out] == [
        (0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 2, 0), (1, 3, 0), (1, 3, 1), (2, 4, 0)]


# --- embeddings ----------------------------------------------------------------------------


def brute_links(rows, cosine):
    unit = []
    for _, v in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if ok else None)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("tile", [8, 1024])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(24)
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            rows.append((base + rng.standard_normal(24) * rng.choice([0, 0.1, 0.3, 0.5])).tolist())
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf"), *[1.0] * 23], [None, *[1.0] * 23], [1e300] * 24, [2e300] * 24, [1.0, 2.0], [1.0, 2.1]]
    rows = [(i, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    links, root = brute_links(rows, 0.95)
    assert len(got) == len(rows)
    wanted = {i: (n, c) for (i, _), n, c in zip(rows, links, root, strict=True)}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (0, 2), (1, 2), (1, 2)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((400, 64))
    unit[1::2] = unit[::2] + 0.3 * unit[1::2]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, factors = embedding_dedup.encode(unit)
    guess = embedding_dedup.estimate(codes, factors, unit @ embedding_dedup.rotation(64).T)
    exact = unit @ unit.T
    off = ~np.eye(400, dtype=bool)
    assert abs((guess - exact)[off].mean()) < 0.01
    near = off & (exact >= 0.9)
    bound = embedding_dedup.error_bound(factors, 64, 0.9, 5.0)[:, None]
    assert near.any() and (np.abs(guess - exact) <= bound)[near].all()


# --- WARC ----------------------------------------------------------------------------------


def captures(spark, rows, path):
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, type string")
    warc.write_archives(df, path)
    return warc.assemble(warc.read_records(spark, path)).collect()


def test_warc(spark, tmp_path):
    big, small = "é" * 60, "a" * 99
    rows = [(5, "http://a/b c", big), (3, "http://b\r\nX: y", big), (9, None, big), (4, "u", small), (2, "u", small), (7, "u", None),
            (8, "u", ""), (1, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (11, "u", "\r\n\r\nx\x00y" * 20)]
    got = captures(spark, rows, str(tmp_path / "w"))
    assert len(got) == len(rows)
    page = {}
    for c in got:
        assert len(c.requests) == len(c.metadata) == 1
        page[int(bytes(c.metadata[0].payload).decode().split(": ")[1])] = c
    ids = {c.capture_id: p for p, c in page.items()}
    for i, _, html in rows:
        payload, c = (html or "").encode(), page[i].response
        if html == big and i != 3:
            assert c.type == "revisit" and ids[c.refers_to] == 3 and bytes(c.payload) == b""
        else:
            assert c.type == "response" and bytes(c.payload) == payload and c.refers_to is None
        assert c.digest == "sha256:" + hashlib.sha256(payload).hexdigest()


def test_warc_rows(spark, tmp_path):
    long = "z" * 200
    got = captures(spark, [(1, "u", long), (1, "u", long), (None, "u", long), (None, None, None)], str(tmp_path / "w"))
    assert sorted(c.response.type for c in got) == ["response", "response", "revisit", "revisit"]
    assert captures(spark, [], str(tmp_path / "e")) == []


def test_warc_negative_ids(spark, tmp_path):
    from trovelake.llm.queries import op6_warc

    long = "z" * 200
    rows = [(-5, "u", long), (3, "u", long), (-1, "u", "short"), (None, "u", "none")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in op6_warc(spark, str(tmp_path)).collect()}
    assert got == {-5: ("response", None), 3: ("revisit", -5), -1: ("response", None), None: ("response", None)}


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choices("abcdé ", k=rng.choice([50, 1500, 12_000, 300_000])))) for i in range(120)]
    got = captures(spark, rows, str(tmp_path / "w"))
    texts = {int(bytes(c.metadata[0].payload).decode().split(": ")[1]): bytes(c.response.payload).decode() for c in got}
    assert texts == {i: html for i, _, html in rows}
    for file in (tmp_path / "w").glob("*.gz"):
        with gzip.open(file) as f:
            found = [len(block) for headers, block in warc.parse([f.read()]) if headers["WARC-Type"] == "response"]
        assert len(found) == 1 or sum(found) <= 200_000 + 200 * len(found)


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_stream(monkeypatch, zipped):
    monkeypatch.setattr(warc, "_READ", 7)
    blocks = [b"", b"WARC/1.1\r\n\r\n", bytes(range(256)) * 9]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks]
    data = b"".join(gzip.compress(r) if zipped else r for r in records)
    assert [b for _, b in warc.parse(warc._unzipped(memoryview(data)))] == blocks
    with pytest.raises(ValueError):
        list(warc.parse(warc._unzipped(memoryview(data[:-20]))))


def test_warc_orphans(spark):
    kind = ", ".join(f"{c} string" for c in warc._HEADERS.values()) + ", http string, payload binary"
    df = spark.createDataFrame([("request", "<r>", "<gone>", None, None, None, None, None, None),
                                ("warcinfo", "<i>", None, None, None, None, None, None, None)], kind)
    (row,) = warc.assemble(df).collect()
    assert row.capture_id == "<gone>" and row.response is None and len(row.requests) == 1


# --- packing -------------------------------------------------------------------------------


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "a", "Hello <|endoftext|> world", "日本 🙂 ﬁ", "x y " * 3000, " \n\n  z's 12"] + [f"w{i} " * i for i in range(60)]
    df = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    got = packing.pack(packing.token_pieces(df, path, window=64), window=64, shard_pieces=50).collect()
    library = Tokenizer.from_file(path)
    wanted = sorted((i % 50, s, tuple(p)) for i, t in enumerate(texts)
                    for ids in [library.encode(t or "", add_special_tokens=False).ids + [1]]
                    for s, p in ((s, ids[s : s + 64]) for s in range(0, len(ids), 64)))
    assert sorted((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4"))) for r in got) == wanted
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and r.length == len(r.ids) // 4
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64
    assert sum(filled.values()) / (64 * len(filled)) > 0.93
    assert packing.pack(packing.token_pieces(df.limit(0), path)).count() == 0


def test_best_fit_against_scan():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 65, 500)
    sequence, offset = packing.best_fit_decreasing(lengths, 64)
    room, wanted = [], np.zeros(500, int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(c, -w) for w, c in enumerate(room) if c >= lengths[i]]
        wanted[i] = min(fits)[0] if fits else 64
        at = next((w for w, c in enumerate(room) if c == wanted[i]), None) if fits else len(room)
        if not fits:
            room.append(64)
        room[at] -= lengths[i]
    assert (64 - offset == wanted).all()
    assert len(room) == sequence.max() + 1


# --- language ID ---------------------------------------------------------------------------


def brute_bits(samples: list[bytes], text: bytes, order: int) -> float:
    counts: dict = {}
    for s in samples:
        for i, b in enumerate(s):
            for k in range(min(i, order) + 1):
                counts.setdefault(s[i - k : i], {}).setdefault(b, 0)
                counts[s[i - k : i]][b] += 1
    total = 0.0
    for i, b in enumerate(text):
        for k in range(min(i, order), -1, -1):
            seen = counts.get(text[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if b in seen:
                total -= math.log2(seen[b] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_language_code_lengths(spark):
    train = [("en", "the cat and the hat sat"), ("en", "then they thanked them"), ("fr", "le chat était là"), ("fr", "élan de l'été"), (None, "x"), ("de", None)]
    docs = spark.createDataFrame([(i, t, la, "x") for i, (la, t) in enumerate(train)], "doc_id long, text string, lang string, score string")
    model = language_id.train(docs)
    assert model.languages == ["en", "fr"]
    texts = ["the hat", "là", "zß\x00q", "t", "", "été chat"]
    raw = [t.encode() for t in texts]
    bits = model.code_lengths(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]))
    for col, lang in enumerate(model.languages):
        own = [t.encode() for la, t in train if la == lang]
        for row, text in enumerate(raw):
            assert bits[row, col] == pytest.approx(brute_bits(own, text, language_id.ORDER), rel=1e-4)
    asked = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*texts, None, "12 34 --"])], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert (got[0].lang_pred, got[1].lang_pred) == ("en", "fr")
    assert [got[i].lang_pred for i in (4, 6, 7)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(asked, none).collect()} == {"und"}
    assert language_id.predict(asked.limit(0), model).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    """Seventy languages, of which one has long texts only, in groups that don't change the result."""
    rng = random.Random(8)
    words = {f"l{n:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzåß", k=5)) for _ in range(12)] for n in range(70)}
    say = {lang: [" ".join(rng.choices(own, k=30)) for _ in range(3)] for lang, own in words.items()}
    say["l07"] = [" ".join(rng.choices(words["l07"], k=8000))]
    rows = [(f"{lang}", text, lang) for lang, texts in say.items() for text in texts]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    asked = spark.createDataFrame([(lang, " ".join(rng.choices(own, k=20))) for lang, own in words.items()], "doc_id string, text string")
    wanted = None
    for most, loaded in ((100, 1 << 30), (9, 1 << 30), (9, 0)):
        monkeypatch.setattr(language_id, "GROUP_LANGUAGES", most)
        monkeypatch.setattr(language_id, "LOADED_GRAMS", loaded)
        model = language_id.train(docs)
        assert model.languages == sorted(words) and len(model.groups) == -(-70 // most)
        got = sorted(map(tuple, language_id.predict(asked, model).select("doc_id", "lang_pred", "score", "bits_per_byte").collect()))
        assert all(row[0] == row[1] for row in got)
        wanted = wanted or got
        assert [r[1:] for r in got] == [(r[1], pytest.approx(r[2], rel=1e-4), pytest.approx(r[3], rel=1e-4)) for r in wanted]


def test_long_texts_are_drawn_in_pieces(spark):
    text = "é" * 5 + "abc " * 9
    docs = spark.createDataFrame([(1, text, "xx")], "doc_id long, text string, lang string")
    model = language_id.train(docs, sample_bytes=7)
    raw = text.encode()
    pieces = [raw[i : i + 7] for i in range(0, len(raw), 7)]
    bits = model.code_lengths(np.frombuffer(b"abc ab", np.uint8), np.array([6]))
    assert bits[0, 0] == pytest.approx(brute_bits(list(dict.fromkeys(pieces)), b"abc ab", language_id.ORDER), rel=1e-4)


@pytest.mark.parametrize("lang", [None, "xx"])
def test_pipeline_keeps_texts_with_letters(spark, lang):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "word " * 5000, lang), (2, "12", lang), (3, None, lang), (4, "wort " * 4000, lang)],
                                 "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()) == [1, 4]


def test_held_out_accuracy(spark):
    from trovelake.llm.queries import op7_language_id

    got = op7_language_id(spark, "/root/testdata/sf0.01").where("held_out and lang_pred <> 'und'")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
