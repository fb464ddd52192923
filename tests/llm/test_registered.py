"""The registered queries of packing, BPE and chat formatting themselves, against the tokenizers library and the tested operator."""

from __future__ import annotations

import hashlib
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from trovelake.llm import chat_format
from trovelake.llm.queries import op2_chat_format, op3_packing, op9_bpe

TEXTS = ["Hello, world!\n\nSecond  paragraph.", None, "", " ", "été ß €", "日本語の文章 😀", "a" * 3000, "word " * 5000, "Hello, world!\n\nSecond  paragraph.",
         "<s> </s> <unk> [PAD]", "tab\tand\r\nline", "x y​z", "1234567890 " * 40]


def documents(spark, path):
    rows = [(7 * i, t, "s") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return {i: t or "" for i, t, _ in rows}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_packing(spark, tmp_path):
    texts = documents(spark, tmp_path)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    found, filled = {}, {}
    for r in op3_packing(spark, str(tmp_path)).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        found.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(found) == set(ids)
    for parts, total in ((found[i], len(own)) for i, own in ids.items()):
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == total
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_bpe(spark, tmp_path):
    texts = documents(spark, tmp_path)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    wanted = []
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        wanted.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = op9_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_chat(spark, tmp_path):
    rows = [(c, t, role, f"{role} {t}") for c in range(6) for t, role in enumerate(["user", "user", "assistant", "system", "assistant", None][: c + 1])]
    rows += [(2, 1, "tool", "again"), (None, None, "user", None), (9, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got, wanted = op2_chat_format(spark, str(tmp_path)), chat_format.repair_roles(df)
    assert got.columns == wanted.columns and got.count() == len(rows)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
