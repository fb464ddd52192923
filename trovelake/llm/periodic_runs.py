"""Periodic runs of words by internal pattern matching.

The words of some documents are laid end to end and named with their document, so no match
crosses documents.  Prefix doubling sorts the suffixes; after k rounds equal ranks mean equal
stretches of 2 ** k words, which are neighbours in the suffix array.

A run of period q and at least 4 q words contains, for the dyadic length L with L <= q < 2 L, an
aligned block of L words within its first 2 L words, and this block occurs again q words on.
So each aligned block queries the window of the next L places: the occurrences there are the
range successors of places in the block's part of the suffix array, which a wavelet tree
answers.  Up to two occurrences are candidate distances.  Three or more form a progression
whose difference r is the block's own period; then q can only be the distance by which the
end of the block's stretch of period r is shifted.  Common extensions to both sides by the
ranks turn a candidate into a run, or reject it; of candidates of one stretch the smallest is
its period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.grams import Texts, mix

LEAST_WORDS = 6
LEAST_EXPONENT = 4
_U = np.uint64


class Suffixes:
    """Suffix array of a sequence of codes, and the ranks of its stretches of 1, 2, 4 ... codes.

    A rank is the place in the suffix array where the suffixes begin that share the stretch.
    ``repeated[k]`` holds the places of stretches of 2 ** k codes that occur more than once.
    """

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        self.array = np.argsort(codes, kind="stable").astype(np.int32)
        ordered = codes[self.array]
        begin, again = _runs(ordered)
        rank = np.empty(n, np.int32)
        rank[self.array] = begin
        self.ranks, self.repeated = [rank], []
        slots, length = np.flatnonzero(again).astype(np.int32), 1
        while len(slots):
            self.repeated.append(slots)
            at = self.array[slots]
            ahead = at.astype(np.int64) + length
            key = rank[at].astype(np.int64) * (n + 1)
            known = ahead < n
            key[known] += rank[ahead[known]] + 1
            order = np.argsort(key, kind="stable")
            at = at[order]
            self.array[slots] = at
            begin, again = _runs(key[order])
            rank = rank.copy()
            rank[at] = slots[begin]
            self.ranks.append(rank)
            slots, length = slots[again], 2 * length

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a on equal those from b on; a < b."""
        equal = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + equal, b + equal
            on = y < self.n
            on[on] = self.ranks[k][x[on]] == self.ranks[k][y[on]]
            equal[on] += 1 << k
        return equal

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes that end before a equal those that end before b."""
        equal = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - equal - (1 << k), b - equal - (1 << k)
            on = x >= 0
            on[on] = self.ranks[k][x[on]] == self.ranks[k][y[on]]
            equal[on] += 1 << k
        return equal


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of a sorted array: where its equals begin, and are there others?"""
    n = len(ordered)
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return begin, ~(new & np.r_[new[1:], True][:n])


class WaveletTree:
    """Values below a bound in a fixed order, for queries on ranges of that order."""

    def __init__(self, values: np.ndarray, bound: int):
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(max(1, int(bound).bit_length()) - 1, -1, -1):
            zero = (values >> bit & 1) == 0
            self.levels.append((bit, np.r_[0, np.cumsum(zero)].astype(np.int32)))
            values = np.r_[values[zero], values[~zero]]

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of x or more in each range; -1 where there is none."""
        a, b, less = low, high, np.zeros(len(x), np.int64)
        for bit, zeros in self.levels:
            left, right = zeros[a], zeros[b]
            one = (x >> bit & 1) == 1
            less += np.where(one, right - left, 0)
            a, b = np.where(one, zeros[-1] + a - left, left), np.where(one, zeros[-1] + b - right, right)
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(less < high - low)
        a, b, place, value = low[some], high[some], less[some], np.zeros(len(some), np.int64)
        for bit, zeros in self.levels:
            left, right = zeros[a], zeros[b]
            one = place >= right - left
            place = np.where(one, place - (right - left), place)
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, zeros[-1] + a - left, left), np.where(one, zeros[-1] + b - right, right)
        out[some] = value
        return out


def candidates(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): a block there may lie in a run of this period."""
    n = suffixes.n
    same = np.flatnonzero(suffixes.ranks[0][1:] == suffixes.ranks[0][:-1])  # a block of one word, and the one place next to it
    places, distances = [same], [np.ones(len(same), np.int64)]
    if len(suffixes.repeated) > 1:
        base = suffixes.repeated[1]  # longer blocks lie in these slots
        tree = WaveletTree(suffixes.array[base].astype(np.int64), n)
        for k in range(1, len(suffixes.repeated)):
            length, rank = 1 << k, suffixes.ranks[k]
            slots = suffixes.repeated[k]
            begins = np.flatnonzero(np.r_[True, np.diff(rank[suffixes.array[slots]]) != 0])
            size = np.zeros(n, np.int32)
            size[slots[begins]] = np.diff(np.r_[begins, len(slots)])
            p = np.arange(0, n, length)
            p = p[size[rank[p]] > 0]
            low = np.searchsorted(base, rank[p])
            high = low + size[rank[p]]
            first = tree.successor(low, high, p + length)
            met = (first >= 0) & (first < p + 2 * length)
            p, low, high, first = p[met], low[met], high[met], first[met]
            second = tree.successor(low, high, first + 1)
            two = (second >= 0) & (second < p + 2 * length)
            third = np.full(len(p), -1, np.int64)
            third[two] = tree.successor(low[two], high[two], second[two] + 1)
            many = two & (third >= 0) & (third < p + 2 * length)
            few, pair = ~many, two & ~many
            places += [p[few], p[pair]]
            distances += [(first - p)[few], (second - p)[pair]]
            at, o, r = p[many], first[many], (second - first)[many]
            shifted = o + suffixes.after(o, o + r) - at - suffixes.after(at, at + r)
            ok = shifted >= length
            places.append(at[ok])
            distances.append(shifted[ok])
    return np.concatenate(places), np.concatenate(distances)


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, by start and period."""
    nothing = (np.zeros(0, np.int64),) * 3
    if len(codes) < 2:
        return nothing
    suffixes = Suffixes(codes)
    p, q = candidates(suffixes)
    inside = p + q < len(codes)
    p, q = p[inside], q[inside]
    start = p - suffixes.before(p, p + q)
    end = p + q + suffixes.after(p, p + q)
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
    found = np.unique(np.stack([start[long], end[long], q[long]]), axis=1)
    new = np.r_[True, (found[:2, 1:] != found[:2, :-1]).any(axis=0)][: found.shape[1]]
    start, end, q = found[:, new]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def _collapsed(texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The words left of each text, joined by one space."""
    kept = np.flatnonzero(~gone)
    length = ends[kept] - starts[kept] + 1  # with a space behind
    stop = np.cumsum(length)
    size = int(stop[-1]) if len(stop) else 0
    take = np.arange(size) + np.repeat(starts[kept] - (stop - length), length)
    data = texts.data[np.minimum(take, max(len(texts.data) - 1, 0))] if size else np.zeros(0, np.uint8)
    data[stop - 1] = 32
    edge = np.r_[0, stop][np.searchsorted(kept, first)]
    some = np.diff(edge) > 0
    stays = np.ones(size, bool)
    stays[edge[1:][some] - 1] = False  # no space at the end of a text
    offsets = edge - np.r_[0, np.cumsum(some)]
    return pa.Array.from_buffers(
        pa.large_string(), len(first) - 1,
        [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(np.ascontiguousarray(data[stays]))],
    ).cast(pa.string())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for low, high, texts in Texts.chunks(batch.column(1)):
            starts, ends, first = texts.words()
            hashes, _ = texts.word_hashes()
            text = np.repeat(np.arange(high - low), np.diff(first))
            start, length, period = runs(mix(hashes ^ mix(text.astype(_U) + _U(1))))
            owner = text[start] if len(start) else start
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            gone = np.cumsum(depth)[:-1] > 0
            bounds = np.searchsorted(owner, np.arange(high - low + 1)).astype("i4")
            triples = pa.StructArray.from_arrays(
                [pa.array(start - first[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                ids.slice(low, high - low), pa.array(np.diff(first).astype("i8")),
                pa.ListArray.from_arrays(pa.array(bounds), triples), _collapsed(texts, starts, ends, first, gone),
            ], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs`` (array of start, length, period, in that order) and ``collapsed`` of each document.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r, numbered from 0, compared by a
    64-bit hash.  A run is a stretch with smallest period q of at least 6 and 4 q words that
    neither neighbour extends.  ``collapsed`` holds the words that lie behind the first q
    words of no run, joined by one space.  Null or empty text has no words and no runs.  Rows
    are documents of their own, whether they repeat, share or lack a doc_id.  Other columns
    are not read; an empty table gives no rows.  A text is held whole by one task, with about
    150 bytes a word.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return texts.mapInArrow(_documents, schema)
