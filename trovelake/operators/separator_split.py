"""Separator-based splitting: an alternative to character windows, in time linear in the text.

Text is cut at the coarsest separator it contains, parts that are too long are cut at finer
ones, and neighbours are merged up to the chunk size with a tail kept as overlap.  A part is
*settled* once it is shorter than the chunk size; settled neighbours that were cut from one
text are a run, and only parts of a run are merged.

The parts are places in the text: each separator looks at the unsettled stretches only, and
chunks are slices between two borders of parts.  As a part is never longer than the text it
was cut from, every level reads each character once, and merging reads each border once.  A
stretch that is cut between all its characters stays one part, whose chunks are windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of texts whose chunks are Python objects at the same time (one longer text is alone).
SLICE = 1 << 20


def _cuts(text: str, separator: str, start: int, end: int) -> Iterator[int]:
    """Where the parts of a stretch begin, beside its start; each later part has the separator in front."""
    at = text.find(separator, start, end)
    while at >= 0:
        yield at
        at = text.find(separator, at + len(separator), end)


def _parts(text: str, separators: tuple[str, ...], size: int) -> list[tuple[int, int, int, bool | None]]:
    """(start, end, run, settled) in reading order; settled is null where the part is cut between all characters."""
    parts, run = [(0, len(text), 0, False)], 0
    for separator in separators:
        finer = []
        for part in parts:
            start, end, _, settled = part
            last = separator == separators[-1] or not separator
            if settled is not False or not (last or text.find(separator, start, end) >= 0):
                finer.append(part)
                continue
            run += 1
            if not separator:
                finer.append((start, end, run, None))
                continue
            for cut in (*_cuts(text, separator, start, end), end):
                if cut > start:
                    finer.append((start, cut, run, cut - start < size))
                start = cut
        parts = finer
    return parts


def _merged(text: str, parts: list[tuple[int, int, int, bool | None]], size: int, overlap: int) -> list[str]:
    """Chunks: runs of parts up to the size; the next chunk begins with a tail of at most ``overlap`` characters."""
    chunks, first, run = [], 0, -1  # the open chunk holds the parts from ``first`` on

    def keep(start: int, end: int) -> None:
        if chunk := text[start:end].strip():
            chunks.append(chunk)

    def flush(low: int, high: int) -> None:
        if low < high:
            keep(parts[low][0], parts[high - 1][1])

    for i, (start, end, own, settled) in enumerate(parts):
        if not settled:
            flush(first, i)
            if settled is None:  # single characters, merged: windows of ``size`` that share ``overlap``
                width = max(size, 1)
                step = width - max(0, min(overlap, width - 1))
                while end - start > width:
                    keep(start, start + width)
                    start += step
            keep(start, end)
            first, run = i + 1, -1
        elif own != run:
            flush(first, i)
            first, run = i, own
        elif end - parts[first][0] > size:
            flush(first, i)
            most = min(overlap, size - (end - start))
            while first < i and start - parts[first][0] > most:
                first += 1
    flush(first, len(parts))
    return chunks


def split_by_separators(text: str | None, separators: tuple[str, ...], size: int, overlap: int) -> list[str]:
    """The chunks of one text, see ``separator_pieces``."""
    return _merged(text, _parts(text, separators, size), size, overlap) if text else []


def split_slices(texts: pa.Array, separators: tuple[str, ...], size: int, overlap: int) -> Iterator[pa.Array]:
    """The chunks of each text of a batch, slice by slice: only one slice's texts and chunks are Python objects."""
    held, count = [], 0
    for text in texts:
        value = text.as_py()
        length = len(value) if value else 0
        if held and count + length > SLICE:
            yield pa.array(held, pa.list_(pa.string()))
            held, count = [], 0
        held.append(split_by_separators(value, separators, size, overlap))
        count += length
    yield pa.array(held, pa.list_(pa.string()))


def split_texts(texts: pa.Array, separators: tuple[str, ...], size: int, overlap: int) -> pa.Array:
    """The chunks of each text of a batch in one array."""
    return pa.concat_arrays(list(split_slices(texts, separators, size, overlap)))


def separator_pieces(text: Column, separators: tuple[str, ...], size: int, overlap: int) -> Column:
    """Stripped, non-empty chunks of a text; null and empty text give none.

    A part of exactly ``size`` characters is cut further where a finer separator allows.
    Slices leave the worker as they are made, so the chunks of a whole batch are never held.
    """
    separators = tuple(separators)

    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from split_slices(texts, separators, size, overlap)

    return F.arrow_udf(pieces, "array<string>")(text)
