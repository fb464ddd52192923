"""Packing token sequences: best-fit decreasing over windows of a fixed length.

Documents are cut into full windows and one remainder; the full windows are sequences by
themselves, the remainders are packed.  Packing runs in shards of a bounded number of
pieces; each shard leaves at most a few windows open, whatever the size of the corpus.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.tables import stored

WINDOW = 2048
#: Pieces that one task packs together.
SHARD_PIECES = 1 << 16

_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


@lru_cache(maxsize=2)
def _ranks(path: str):
    """The tokenizer file as byte-pair ranks, which give the same ids several times faster.

    Only texts of common Latin characters go this way, where no two Unicode versions
    disagree; other texts go to the library itself.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in piece): i
        for piece, i in model["model"]["vocab"].items()
        if piece not in special
    }
    pattern = (
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    )
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return fast


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def encode_texts(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """Token ids of each text as the tokenizers library gives them, without special tokens added."""
    fast = _ranks(path)
    for text in texts:
        if _UNUSUAL.search(text):
            ids = _library(path).encode(text, add_special_tokens=False).ids
            yield np.asarray(ids, dtype="<u4")
        else:
            yield fast.encode_to_numpy(text, allowed_special="all")


def token_pieces(
    documents: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = 1
) -> DataFrame:
    """Cut documents (doc_id, text) into pieces of at most ``window`` ids, each ended by ``end_id``.

    A piece has its ids as little-endian unsigned 32-bit integers.  Null text is empty text
    and gives one piece with the end id alone.  Every input row gives its own pieces, also
    where rows repeat or share a doc_id (null is kept); other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64())]
            + [(name, pa.int64()) for name in ("start", "length", "doc_tokens")]
            + [("ids", pa.binary())]
        )
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows: list[list] = [[], [], [], [], []]
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode_texts(texts, tokenizer), strict=True):
                    data = ids.astype("<u4", copy=False).tobytes() + end_id.to_bytes(4, "little")
                    total = len(data) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        values = (doc_id, start, length, total, data[4 * start : 4 * (start + length)])
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities marks the non-empty ones."""

    def __init__(self, window: int):
        self.size = 1 << max(1, window.bit_length())
        self.tree = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, sequence: int) -> None:
        self.open.setdefault(capacity, []).append(sequence)
        node = capacity + self.size
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with room for ``need``, as (capacity, sequence)."""
        tree, node = self.tree, need + self.size
        while not tree[node]:
            while node & 1:  # a right child: the larger capacities are further up
                node >>= 1
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # walked off the right edge of its level
                return None
        while node < self.size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    windows, used = OpenWindows(window), 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if found := windows.take(length):
            capacity, sequence[i] = found
        else:
            capacity, sequence[i] = window, used
            used += 1
        offset[i] = window - capacity
        if capacity > length:
            windows.add(capacity - length, int(sequence[i]))
    return sequence, offset


def pack(pieces: DataFrame, *, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each piece (``length`` from 1 to ``window``) a ``sequence_id`` and an ``offset`` in it.

    All other columns pass through, beside the packing itself, which sees lengths only (columns
    of the two new names are replaced).  Rows are packed as they are, repeated ones too; an
    empty table gives an empty one; a null length or one outside the window is an error.
    """
    table = stored(pieces.drop("sequence_id", "offset").withColumn("_piece", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(table.count() / shard_pieces))
    shard = F.pmod(F.xxhash64("_piece"), F.lit(shards)).alias("_shard")

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("_piece")
        lengths = group.column("length").to_numpy()
        if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= window:
            raise ValueError("a piece must have from 1 to window tokens")
        sequence, offset = best_fit_decreasing(lengths, window)
        ids = (group.column("_shard").to_numpy() << 32) + sequence
        return pa.table({"_piece": group.column("_piece"), "sequence_id": pa.array(ids), "offset": pa.array(offset)})

    narrow = table.select("_piece", shard, F.col("length").cast("long").alias("length"))
    places = narrow.groupBy("_shard").applyInArrow(place, "_piece long, sequence_id long, offset long")
    return table.join(places, "_piece").drop("_piece")
