"""Substring dedup by seed and extend, over words.

Documents meet on winnowed anchors (see ``repeats``).  The match of two anchors is extended word
by word to the left and to the right, up to the first word that differs; the windows that both
extensions cover are repeats, and repeats in a row join to maximal ones.  Of stretches that equal
each other as a whole the first two are extended; further copies of the second follow it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trovelake.llm.grams import Texts
from trovelake.llm.repeats import Group, Repeats, by_document, covered
from trovelake.llm.tables import Corpus, corpus

MIN_WORDS = 20
SEED_WORDS = 6


def extend(group: Group, repeats: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that an earlier stretch of the same anchor matches from end to end.

    The matches of an anchor are extended without pairing all of its stretches: sorted by the
    words that follow the seed, each stretch is matched with its neighbour up to the first
    word that differs, and two stretches match as far as all neighbours between them.  The
    same to the left.  A window is repeated if one earlier stretch matches it on both sides.
    """
    reach = repeats.size - repeats.seed
    seed = group.at + group.lead
    rightward = group.windows + reach - group.lead  # words of a stretch behind its seed
    right = _matched(group.anchor, group.units, seed + repeats.seed, 1, np.minimum(rightward, reach), reach)
    left = _matched(group.anchor, group.units, seed - 1, -1, np.minimum(group.lead, reach), reach)
    stretch = np.repeat(np.arange(len(group.key)), group.windows)
    step = np.arange(len(stretch)) - np.repeat(np.cumsum(group.windows) - group.windows, group.windows)
    lead = group.lead[stretch] - step
    key, start = group.key[stretch], group.start[stretch] + step
    sides = left[lead, stretch], right[reach - lead, stretch]
    order = np.lexsort((start, key, *sides, lead))
    again = np.ones(len(order), bool)
    again[:1] = False
    for c in (lead, *sides):
        again[1:] &= c[order][1:] == c[order][:-1]
    found = order[again]
    return key[found], start[found], np.ones(len(found), np.int64)


def _matched(anchor: np.ndarray, units: np.ndarray, begin: np.ndarray, step: int, have: np.ndarray, reach: int) -> np.ndarray:
    """For each length up to ``reach``: a number that stretches share if they match over that length.

    A stretch is read from ``begin`` in steps of 1 or -1 and has ``have`` units there.
    """
    ahead = np.arange(reach)[:, None]
    words = units[np.clip(begin + step * ahead, 0, len(units) - 1)]
    words[ahead >= have] = 0  # past the end of the stretch, where none of its windows reaches
    order = np.lexsort((*words[::-1], anchor))
    same = np.ones((reach + 1, len(order)), bool)
    same[:, :1] = False
    same[0, 1:] = anchor[order][1:] == anchor[order][:-1]
    same[1:, 1:] = words[:, order[1:]] == words[:, order[:-1]]
    match = np.logical_and.accumulate(same, axis=0)  # with the neighbour, up to the first word that differs
    out = np.empty((reach + 1, len(order)), np.int64)
    out[:, order] = np.cumsum(~match, axis=1)
    return out


def repeated_windows(docs: Corpus, *, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    return Repeats(min_words, min(seed_words, min_words), "words", extend).find(docs)


def remove_repeats(documents: DataFrame, *, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """Remove the words covered by a window of ``min_words`` words that also begins earlier.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r, unchanged.  Returns doc_id,
    n_words, n_removed and ``kept``, the words left joined by one space.  Null or empty text
    has no words; shorter texts lose none.  Rows that share or lack a doc_id are documents of
    their own, in the order of (doc_id with nulls first, text); of equal rows the first
    stays whole.  Other columns of the input are not read; an empty table gives no rows.
    """
    docs = corpus(documents)
    runs = repeated_windows(docs, min_words=min_words, seed_words=seed_words)

    def cut(ids: pa.Array, texts: Texts, rows: tuple, keys: np.ndarray) -> pa.RecordBatch:
        starts, ends, first = texts.words()
        gone = covered(rows, keys, first, min_words)
        total = np.r_[0, np.cumsum(gone)]
        n_removed = total[first[1:]] - total[first[:-1]]
        kept = np.flatnonzero(~gone)
        length = ends[kept] - starts[kept] + 1  # with a space behind
        stop = np.cumsum(length)
        size = int(stop[-1]) if len(stop) else 0
        take = np.arange(size) + np.repeat(starts[kept] - (stop - length), length)
        data = texts.data[np.minimum(take, max(len(texts.data) - 1, 0))] if size else np.zeros(0, np.uint8)
        data[stop - 1] = 32
        edge = np.r_[0, stop][np.searchsorted(kept, first)]
        has = np.diff(edge) > 0
        keep = np.ones(size, bool)
        keep[edge[1:][has] - 1] = False  # no space at the end of a text
        offsets = edge - np.r_[0, np.cumsum(has)]
        text = pa.Array.from_buffers(
            pa.large_string(), len(keys),
            [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(np.ascontiguousarray(data[keep]))],
        ).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(first)), pa.array(n_removed), text], names=["doc_id", "n_words", "n_removed", "kept"]
        )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_document(docs, runs, cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
