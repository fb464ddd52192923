"""Encoding and decoding with a word-level BPE tokenizer through a table of distinct words.

Each block of documents sends its distinct words to buckets by word; a bucket holds all
blocks' words, encodes each distinct one once with the tokenizers library and answers every
block.  A block then joins the ids back to its texts word by word, in order.  The cost of
BPE grows with the vocabulary of the corpus, not with its length, and a word in every text
crosses the shuffle once per block.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trovelake.llm.tables import block_of, corpus

_ANSWER = "block int, words binary, sizes binary, ids binary"
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_ENCODE_ROWS = 8192
#: Text bytes of a block on average; a task holds the distinct words of one block.
_BLOCK_BYTES = 12 << 20


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class WordSplitter:
    """The words of a text as the tokenizer file's normalizer and pre-tokenizer cut it.

    Texts of common Latin characters, where these steps are lower-casing and one pattern, are
    cut directly; other texts go through the library.  Strings of special tokens are words.
    """

    def __init__(self, path: str):
        self.path = path
        specials = [re.escape(t["content"]) for t in _spec(path)["added_tokens"]]
        self.special = re.compile("(" + "|".join(specials) + ")") if specials else None
        kinds: dict[str, str] = {"L": "", "N": ""}
        for c in map(chr, range(0x250)):
            if (kind := unicodedata.category(c)[0]) in kinds:
                kinds[kind] += c
        letters, numbers = kinds["L"], kinds["N"]
        pattern = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+"
        self.find = re.compile(pattern).findall

    def _tokenizer(self, **changes):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(_spec(self.path) | {"truncation": None, "padding": None} | changes))

    @cached_property
    def library(self):
        return self._tokenizer()

    @cached_property
    def words(self):
        """Encodes words that are normalized already."""
        return self._tokenizer(normalizer=None)

    def __call__(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            out: list[str] = []
            for i, part in enumerate(self.special.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            return self.find(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def splitter(path: str) -> WordSplitter:
    return WordSplitter(path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[str | None]:
    """Piece of each id; null where the vocabulary has none."""
    spec = _spec(path)
    piece_of = {i: piece for piece, i in spec["model"]["vocab"].items()}
    piece_of |= {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [piece_of.get(i) for i in range(max(piece_of, default=-1) + 1)]


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ``ids``, the token ids of the whole text without special tokens added.

    Null and empty texts have no ids.  Every row is encoded, also where doc_id is null or
    repeated; other columns are not read; an empty table gives no rows.
    """
    docs = corpus(documents)
    buckets = max(docs.blocks, math.ceil(docs.text_bytes / _BLOCK_BYTES))
    id_type = to_arrow_type(documents.schema["doc_id"].dataType)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of each block in a batch as one compressed row, which is what the shuffle carries."""
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            block, texts = batch.column(0).to_numpy(), batch.column(2).cast(pa.large_binary())
            begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
            rows: list[list] = [[], [], [], []]
            for low, high in zip(begins, [*begins[1:], len(block)], strict=True):
                part = texts[low:high].to_pylist()
                values = (block[low], batch.column(1)[low:high].to_pylist(), _packed(list(map(len, part))), _squeezed(b"".join(part)))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.list_(id_type), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["block", "ids", "sizes", "texts"])

    def texts_of(sizes: bytes, data: bytes) -> list[str]:
        data, stops = _opened(data), np.cumsum(_unpacked(sizes)).tolist()
        return [data[a:b].decode() for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = splitter(tokenizer), {}
        for batch in batches:
            for block, _, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for text in texts_of(sizes, data):
                    words.setdefault(block, set()).update(split(text))
        for block, found in words.items():
            own: dict[int, list[str]] = {}
            for word in sorted(found):
                own.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
            packed = [_squeezed("\n".join(w).encode()) for w in own.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(own), pa.int32()), pa.array(list(own), pa.int32()), pa.array(packed, pa.binary())],
                names=["block", "bucket", "words"])

    def encode_bucket(group: pa.Table) -> pa.Table:
        library, ids_of = splitter(tokenizer).words, {}
        for packed in group.column("words"):
            ids_of.update(dict.fromkeys(_opened(packed.as_py()).decode().split("\n"), b""))
        words = list(ids_of)
        for low in range(0, len(words), _ENCODE_ROWS):
            part = words[low : low + _ENCODE_ROWS]
            for word, found in zip(part, library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids_of[word] = found.ids
        sizes, ids = [], []
        for packed in group.column("words"):
            found = [ids_of[w] for w in _opened(packed.as_py()).decode().split("\n")]
            sizes.append(_packed(list(map(len, found))))
            ids.append(_packed([i for word in found for i in word]))
        return pa.table({"block": group.column("block"), "words": group.column("words"),
                         "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def assemble(bundles: pa.Table, answers: pa.Table) -> pa.Table:
        split, ids_of = splitter(tokenizer), {}
        for packed, sizes, ids in zip(*(answers.column(c).to_pylist() for c in ("words", "sizes", "ids")), strict=True):
            stops = (4 * np.cumsum(_unpacked(sizes))).tolist()
            data, low = _unpacked(ids).astype("<i4").tobytes(), 0
            for word, stop in zip(_opened(packed).decode().split("\n"), stops, strict=True):
                ids_of[word] = data[low:stop]
                low = stop
        out = []
        for _, ids, sizes, data in zip(*(c.to_pylist() for c in bundles.columns), strict=True):
            rows = [b"".join(map(ids_of.__getitem__, split(t))) for t in texts_of(sizes, data)]
            offsets = np.cumsum([0, *map(len, rows)]) // 4
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, id_type), lists], names=["doc_id", "ids"]))
        return pa.Table.from_batches(out)

    kind = documents.schema["doc_id"].dataType.simpleString()
    located = docs.docs.select(block_of("key", buckets).alias("block"), "doc_id", "text")
    blocks = located.mapInArrow(bundle, f"block int, ids array<{kind}>, sizes binary, texts binary").repartition(buckets, "block")
    words = blocks.mapInArrow(distinct, "block int, bucket int, words binary")
    answers = words.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(encode_bucket, _ANSWER)
    return (
        blocks.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(assemble, f"doc_id {kind}, ids array<int>")
    )


def _squeezed(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _opened(data: bytes) -> bytes:
    return zstandard.decompress(data)


def _packed(numbers: list[int]) -> bytes:
    """Small numbers, compressed; in 16 bits where all fit."""
    values = np.array(numbers, np.int64)
    wide = len(values) and int(values.max()) >> 16
    return (b"w" if wide else b"n") + _squeezed(values.astype("<u4" if wide else "<u2").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_opened(data[1:]), "<u4" if data[:1] == b"w" else "<u2").astype(np.int64)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``decoded``: the pieces of ``ids``, special tokens too, joined by one space.

    Ids meet their pieces in a join with the vocabulary, which the tokenizer file bounds: one
    row that holds it as an array, by position.  Null ids give an empty text; ids outside the
    vocabulary and null ones are left out.  A column ``decoded`` of the input is replaced.
    """
    vocabulary = encoded.sparkSession.createDataFrame([(_pieces(tokenizer),)], "pieces array<string>")
    rows = encoded.drop("decoded").withColumn("_pieces", vocabulary.scalar())
    found = F.transform("ids", lambda i: F.get("_pieces", i))
    return rows.withColumn("decoded", F.coalesce(F.array_join(found, " "), F.lit(""))).drop("_pieces")
