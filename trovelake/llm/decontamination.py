"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of the benchmark items.  For each length m of a window, a
shift table says how far a search may move when a block of words ends at some place: to the
next place where that block could lie in a test string.  Where the shift is zero, the block is
the last one of some test strings; these stand in the bucket of its hash, ordered by the hash
of the whole, and are compared with the text byte by byte.  A text is searched in many lanes
at once, each of which skips by its own shifts.

The windows are dealt to blocks of bounded size, each a broadcast of its own, so a larger
benchmark makes more blocks; a task reads its texts once and takes the blocks in turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.grams import Texts, mix
from trovelake.llm.tables import stored

WORDS = 10
#: Bounds of a block of test strings: how many, and their bytes (or one string alone).
BLOCK_WINDOWS = 1 << 17
BLOCK_BYTES = 1 << 24
#: Blocks that stay loaded in a worker; of more, one is loaded at a time.
LOADED_BLOCKS = 4
#: Rows of (window, item) that are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 1 << 17
_SALTS = 16
_LANE = 64
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)

_LOWERED = np.full(256, 32, np.uint8)  # all that is no word byte becomes a space
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _LOWERED[_low : _high + 1] = np.arange(_low, _high + 1)
_LOWERED[0x41:0x5B] = np.arange(0x61, 0x7B)


def lowered(texts: Texts) -> Texts:
    return Texts(_LOWERED[texts.data], texts.offsets)


def item_windows(benchmark: DataFrame, words: int) -> DataFrame:
    """(item, m, window): each item's distinct windows of ``words`` words, or the whole of a shorter item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0)
            for low, high, texts in Texts.chunks(batch.column(1)):
                texts = lowered(texts)
                starts, ends, first = texts.words()
                own = [texts.data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                for i in range(high - low):
                    mine = own[first[i] : first[i + 1]]
                    m = min(words, len(mine))
                    for at in range(0, len(mine) - m + 1 if m else 0, 1 << 14):
                        part = range(at, min(at + (1 << 14), len(mine) - m + 1))
                        windows = sorted({b" ".join(mine[j : j + m]) for j in part})
                        yield pa.RecordBatch.from_arrays(
                            [items.slice(low + i, 1).take(pa.array(np.zeros(len(windows), "i8"))), pa.array(np.full(len(windows), m, "i4")),
                             pa.array(windows, pa.binary())], names=["item", "m", "window"])

    texts = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    return texts.mapInArrow(cut, "item string, m int, window binary").distinct()


class WuManber:
    """Shift table and buckets of test strings of ``m`` words each."""

    def __init__(self, ids: np.ndarray, windows: list[bytes], m: int):
        self.m, self.block = m, min(2, m)
        table = pa.array(windows, pa.large_binary())
        texts = next(Texts.chunks(table.cast(pa.large_string()), max(1, sum(map(len, windows)))))[2]
        starts, ends, _ = texts.words()
        hashes, _ = texts.word_hashes()
        hashes = hashes.reshape(len(ids), m)
        self.bits = min(22, max(12, math.ceil(math.log2(8 * len(ids) * m))))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int32)
        for end in range(self.block - 1, m):  # the later the place of a block, the smaller its shift
            self.shift[self.suffix([hashes[:, j] for j in range(end - self.block + 1, end + 1)])] = m - 1 - end
        last = self.suffix([hashes[:, j] for j in range(m - self.block, m)])
        codes = self.codes(last, self.whole([hashes[:, j] for j in range(m)]))
        order = np.argsort(codes, kind="stable")
        self.order_codes, self.ids = codes[order], ids[order]
        self.data, self.starts, self.ends = texts.data, starts.reshape(-1, m)[order], ends.reshape(-1, m)[order]

    def suffix(self, words: list[np.ndarray]) -> np.ndarray:
        """Hash of a block of words, as a row of the shift table."""
        value = words[0]
        for w in words[1:]:
            value = mix(value * _BASE + w)
        return (value >> _U(64 - self.bits)).astype(np.int64)

    def whole(self, words: list[np.ndarray]) -> np.ndarray:
        value = np.zeros(len(words[0]), _U)
        for w in words:
            value = value * _BASE + w
        return mix(value)

    def codes(self, suffix: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Bucket in the leading bits, then the hash of the whole."""
        return suffix.astype(_U) << _U(64 - self.bits) | whole >> _U(self.bits)

    def search(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, id of the test string) of each occurrence within one of the texts."""
        m, n = self.m, len(hashes)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < m:
            return nothing
        at = np.arange(0, n - m + 1, _LANE)
        stop = np.minimum(at + _LANE, n - m + 1)
        places, keys = [], []
        while len(at):
            key = self.suffix([hashes[at + j] for j in range(m - self.block, m)])
            step = self.shift[key]
            zero = step == 0
            places.append(at[zero])
            keys.append(key[zero])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at, key = np.concatenate(places), np.concatenate(keys)
        inside = text[at] == text[at + m - 1]
        at, key = at[inside], key[inside]
        code = self.codes(key, self.whole([hashes[at + j] for j in range(m)]))
        low, high = np.searchsorted(self.order_codes, code), np.searchsorted(self.order_codes, code, "right")
        many = high - low
        if not many.any():
            return nothing
        at = np.repeat(at, many)
        row = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        same = np.concatenate([self._equal(texts, starts, ends, at[i : i + 8192], row[i : i + 8192]) for i in range(0, len(at), 8192)])
        return at[same], self.ids[row[same]]

    def _equal(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Do the words at these places equal those of these test strings, byte by byte?"""
        word = at[:, None] + np.arange(self.m)
        length = ends[word] - starts[word]
        same = (length == self.ends[row] - self.starts[row]).all(axis=1)
        rows = np.flatnonzero(same)
        if len(rows):
            length = length[rows].ravel()
            stop = np.cumsum(length)
            inner = np.arange(stop[-1]) - np.repeat(stop - length, length)
            own = texts.data[inner + np.repeat(starts[word[rows]].ravel(), length)]
            wanted = self.data[inner + np.repeat(self.starts[row[rows]].ravel(), length)]
            bad = np.cumsum(np.r_[0, own != wanted])
            edge = np.r_[0, stop][:: self.m]
            same[rows] = bad[edge[1:]] == bad[edge[:-1]]
        return same


def _blocks(windows: DataFrame) -> list[Broadcast]:
    """Searchers of the windows (id, m, window), built one block at a time."""
    spark = windows.sparkSession
    rows, size = windows.agg(F.count("*"), F.sum(F.octet_length("window"))).first()
    count = max(1, math.ceil(rows / BLOCK_WINDOWS), math.ceil((size or 0) / BLOCK_BYTES))
    out = []
    for b in range(count if rows else 0):
        block = windows.where(F.pmod(F.xxhash64("window"), F.lit(count)) == b).toArrow()
        found = []
        for m in sorted(pc.unique(block.column("m")).to_pylist()):
            own = block.filter(pc.equal(block.column("m"), m))
            found.append(WuManber(own.column("id").to_numpy(), own.column("window").to_pylist(), m))
        out.append(spark.sparkContext.broadcast(found))
    return out


def _search(blocks: list[Broadcast]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, texts in Texts.chunks(batch.column(1)):
                texts = lowered(texts)
                starts, ends, first = texts.words()
                hashes, _ = texts.word_hashes()
                text = np.repeat(np.arange(high - low), np.diff(first))
                hit = np.zeros(len(starts) + 1, np.int64)
                place, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for block in blocks:
                    for searcher in block.value:
                        at, found = searcher.search(texts, starts, ends, hashes, text)
                        np.add.at(hit, at, 1)
                        np.add.at(hit, at + searcher.m, -1)
                        place.append(text[at])
                        window.append(found)
                    if len(blocks) > LOADED_BLOCKS and getattr(block, "_path", None):
                        vars(block).pop("_value", None)  # read from its local file again for the next texts
                hit = np.r_[0, np.cumsum(np.cumsum(hit)[:-1] > 0)]
                pairs = np.unique(np.stack([np.concatenate(place), np.concatenate(window)]), axis=1)
                bounds = np.searchsorted(pairs[0], np.arange(high - low + 1)).astype("i4")
                yield pa.RecordBatch.from_arrays([
                    ids.slice(low, high - low), pa.array(np.diff(first).astype("i8")), pa.array(hit[first[1:]] - hit[first[:-1]]),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(pairs[1])),
                ], names=["doc_id", "n_words", "n_hit", "windows"])

    return search


def contamination(documents: DataFrame, benchmark: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_hit and ``items`` (array of item ids as sorted strings) of each row of ``documents``.

    Words are runs of digits, letters a-z (A-Z count as these) and bytes from 0x80 on.  A
    window is ``words`` consecutive words of a benchmark item; a shorter item is one window.  A
    document's word is hit if it lies in an occurrence of a window; ``items`` are those of
    which a window occurs.  Null or empty texts, and texts without words, have no words and
    no windows.  Items that share an id count once; an item without id marks words but is
    not listed.  Documents that repeat, or share or lack a doc_id, are rows of their own.  Other columns
    are not read; empty tables give no rows, or no hits.
    """
    if words < 1:
        raise ValueError("words must be positive")
    of_items = stored(item_windows(benchmark, words))
    windows = stored(of_items.select("m", "window").distinct().withColumn("id", F.monotonically_increasing_id()))
    blocks = _blocks(windows)
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = stored(
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_search(blocks), f"doc_id {kind}, n_words long, n_hit long, windows array<long>")
        .withColumn("key", F.monotonically_increasing_id())
    )
    pairs = stored(of_items.join(windows, ["m", "window"]).where(F.col("item").isNotNull()).select(F.col("id").alias("window"), "item"))
    met = found.where(F.size("windows") > 0).select("key", F.explode("windows").alias("window"))
    if pairs.count() <= BROADCAST_PAIRS:
        named = met.join(F.broadcast(pairs), "window")
    else:  # a window that very many documents share is dealt to several tasks
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        named = met.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int")).join(salted, ["window", "salt"])
    items = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    hit = found.where(F.size("windows") > 0).join(items, "key", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items"))
    clean = found.where(F.size("windows") == 0).select("doc_id", "n_words", "n_hit", none.alias("items"))
    return clean.unionByName(hit)
