"""Repeated stretches of a fixed length over a whole corpus, from winnowed anchors.

A text is a sequence of units (words or bytes); a window is ``size`` consecutive units of
one text.  A window is repeated if its units also begin at an earlier place (smaller key,
or same key and earlier start).

Winnowing gives each window one anchor: of its seeds (``seed`` consecutive units) the one
that comes first in an order that is the same everywhere, the leftmost of equals.  The order
puts very common seeds last, then goes by hash.  Equal windows have equal anchors at the same
place, so windows need comparison only where anchors are equal.  A window at the border of a
passage that very many texts share is anchored outside the passage, so a common seed anchors
only windows inside it, which are equal.  Windows in a row with one anchor form a stretch:

1. Stretches that are equal as a whole go to one task, by the hash of the whole.  The first two
   of them stay; further ones repeat the second and are settled, in each batch and again across
   batches, so a passage of many copies crosses the shuffle at most twice per batch.
2. All stretches left under an anchor that occurs twice get their units from the texts, and
   ``resolve`` compares them window by window.  An anchor of very many stretches is split: each
   of its windows goes by the units on that side of the seed where more of the window lies.
3. The repeated windows of a document meet its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.grams import BYTE_VALUES, Rolling, Texts, mix, sliding_min
from trovelake.llm.tables import Corpus, block_of, stored

_U = np.uint64
#: Units of one long text that are compared at once.  A stretch cut here differs from whole
#: ones, so its windows are compared one by one; no window is lost.
SEGMENT_UNITS = 1 << 20
#: Cells in which seeds are counted to find the common ones.
SEED_BITS = 20
SEED_CELLS = 1 << SEED_BITS
#: Stretches of one anchor that are compared together; the windows of more are split by side.
SPLIT_ROWS = 4096
_WHOLE, _LEFT, _RIGHT = 0, 1, 2


@dataclass
class Group:
    """Stretches that share anchors: ``units`` holds those of all, laid end to end."""

    anchor: np.ndarray
    key: np.ndarray
    start: np.ndarray
    lead: np.ndarray  # units before the anchor
    windows: np.ndarray  # windows of the stretch
    units: np.ndarray
    at: np.ndarray  # where a stretch begins in units


@dataclass(frozen=True)
class Repeats:
    size: int
    seed: int
    #: "words" or "bytes"
    unit: str
    #: For each window of a group (stretch, place): is it equal to an earlier one?
    resolve: Callable[[Group, Repeats], tuple[np.ndarray, np.ndarray, np.ndarray]]
    split_rows: int = SPLIT_ROWS

    def find(self, docs: Corpus) -> DataFrame:
        """Runs of repeated windows: key, start, run (windows in a row); runs may touch or overlap."""
        if not 0 < self.seed <= self.size <= self.seed + 254:
            raise ValueError("seed must be shorter than the window, by at most 254 units")
        parts, common = docs.blocks, self._common_seeds(docs)
        settled = stored(
            docs.docs.select("key", "text").mapInArrow(lambda it: self._stretches(it, common), _STRETCHES)
            .repartition(parts, "anchor").mapInArrow(self._settle, _SETTLED)
        )
        runs = settled.where("run > 0").select("key", "start", "run")
        open_ones = settled.where("run = 0").withColumn("block", block_of("key", parts))
        contexts = (
            docs.by_block().groupBy("block").cogroup(open_ones.groupBy("block"))
            .applyInArrow(lambda left, right: self._contexts(left, right), _CONTEXTS)
        )
        border = contexts.repartition(parts, "anchor").mapInArrow(self._resolved, "key long, start long, run long")
        return runs.unionByName(border)

    def units(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Each unit (a byte, or the hash of a word), and the number of the first one of each text (and the total)."""
        if self.unit == "bytes":
            return texts.data, texts.offsets
        return texts.word_hashes()

    def _common_seeds(self, docs: Corpus) -> bytes:
        """One bit for each of a fixed number of cells of the seed hash: is it far above the mean?

        Every seed of the corpus counts.  A task reports the cells that stand out in it, so the
        counts are low estimates; they decide the order of seeds only, never a result.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(SEED_CELLS, np.int64)
            for batch in batches:
                for _, _, texts in Texts.chunks(batch.column(0)):
                    units, _ = self.units(texts)
                    for at in range(0, len(units), SEGMENT_UNITS):
                        seeds = self._seeds(units[at : at + SEGMENT_UNITS + self.seed - 1])
                        cells += np.bincount(_cell(seeds), minlength=SEED_CELLS)
            total = int(cells.sum())
            found = np.flatnonzero(cells >= max(32, total >> 16))  # so few cells, whatever the task's size
            yield _batch(cell=np.r_[found, -1], n=np.r_[cells[found], total])

        counts = docs.docs.select("text").mapInArrow(count, "cell long, n long")
        table = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row for each cell at most
        cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
        common = np.zeros(SEED_CELLS, bool)
        common[cell[(cell >= 0) & (n >= 8 * n[cell < 0].sum() // SEED_CELLS)]] = True
        return np.packbits(common).tobytes()

    def _seeds(self, units: np.ndarray) -> np.ndarray:
        values = BYTE_VALUES[units] if self.unit == "bytes" else units
        return Rolling(values).windows(self.seed)

    def _stretches(self, batches: Iterator[pa.RecordBatch], common: bytes) -> Iterator[pa.RecordBatch]:
        last = np.unpackbits(np.frombuffer(common, np.uint8)).astype(_U) << _U(63)
        for batch in batches:
            keys, found = batch.column(0).to_numpy(), []
            for low, high, texts in Texts.chunks(batch.column(1)):
                units, first = self.units(texts)
                step = max(SEGMENT_UNITS, self.size)
                if high - low > 1 or len(units) <= step:
                    found.append(self._chunk(keys[low:high], units, first, last))
                    continue
                for at in range(0, len(units) - self.size + 1, step):  # a long text, window by window in one part
                    part = units[at : at + step + self.size - 1]
                    anchor, body, key, place = self._chunk(keys[low:high], part, np.array([0, len(part)]), last)
                    found.append((anchor, body, key, place + (at << 16)))
            if found:
                anchor, body, key, place = (np.concatenate(c) for c in zip(*found, strict=True))
                order, again = _equals(anchor, body, key, place)
                more = _third(again)
                first = order[~more]
                run = _merged(key[order[more]], place[order[more]] >> 16, place[order[more]] & 255)
                yield _batch(
                    anchor=np.r_[anchor[first], mix(run[0].astype(_U))].astype("i8"),
                    body=np.r_[body[first], np.zeros(len(run[0]), _U)].astype("i8"),
                    key=np.r_[key[first], run[0]],
                    place=np.r_[place[first], run[1] << 16],
                    run=np.r_[np.zeros(len(first), "i8"), run[2]],
                )

    def _chunk(self, keys: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
        """The stretches of some texts: anchor, hash of the whole, key, place (start, lead, windows)."""
        values = BYTE_VALUES[values] if self.unit == "bytes" else values
        n, size = len(values), self.size
        lengths = np.diff(first)
        if n < size:
            return tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64))
        rolling = Rolling(values)
        seeds = rolling.windows(self.seed)
        ranked = (seeds >> _U(1)) & _U(0x7FFFFFFF00000000) | np.arange(len(seeds), dtype=_U)
        ranked |= last[_cell(seeds)]
        owner = (sliding_min(ranked, size - self.seed + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        room = np.maximum(lengths - size + 1, 0)  # windows of each text
        text = np.repeat(np.arange(len(lengths)), room)
        start = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + first[text]
        owner = owner[start]
        change = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        windows = np.diff(np.r_[change, len(text)])
        begin, owner, text = start[change], owner[change], text[change]
        lead = owner - begin
        shape = (lead << 8 | windows).astype(_U)
        body = mix(rolling.of(begin, begin + windows + size - 1) ^ mix(shape + _U(1)))
        return seeds[owner], body, keys[text], (begin - first[text]) << 16 | lead << 8 | windows

    def _settle(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of third and further equal stretches; the stretches of each anchor that occurs again."""
        columns = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not columns:
            return
        anchor, body, key, place, run = (np.concatenate(c) for c in zip(*columns, strict=True))
        known = run > 0
        runs = key[known], place[known] >> 16, run[known]
        anchor, body, key, place = (c[~known] for c in (anchor, body, key, place))
        order, again = _equals(anchor, body, key, place)
        third = _third(again)
        more = order[third]
        runs = _merged(*(np.r_[a, b] for a, b in zip(runs, (key[more], place[more] >> 16, place[more] & 255), strict=True)))
        zero = np.zeros(len(runs[0]), np.int64)
        yield _batch(anchor=zero, key=runs[0], place=zero, start=runs[1], run=runs[2], side=zero)
        rows = order[~third]  # by anchor
        edge = np.flatnonzero(np.r_[True, anchor[rows][1:] != anchor[rows][:-1]]) if len(rows) else rows
        many = np.diff(np.r_[edge, len(rows)])
        many = np.repeat(many, many)
        crowded = many > max(self.split_rows, 1)
        for side, chosen in ((_WHOLE, (many > 1) & ~crowded), (_LEFT, crowded), (_RIGHT, crowded)):
            part = rows[chosen]
            own = self._side(place[part], side)
            part, own = part[own & 255 > 0], own[own & 255 > 0]
            zero = np.zeros(len(part), np.int64)
            yield _batch(anchor=anchor[part], key=key[part], place=own, start=zero, run=zero, side=zero + side)

    def _side(self, place: np.ndarray, side: int) -> np.ndarray:
        """Places of the windows with at least (left) or fewer than (right) ``_half`` units before the seed."""
        if side == _WHOLE:
            return place
        start, lead, windows = place >> 16, place >> 8 & 255, place & 255
        left = np.clip(lead - self._half + 1, 0, windows)
        if side == _LEFT:
            return start << 16 | lead << 8 | left
        return np.where(left < windows, (start + left) << 16 | (lead - left) << 8 | (windows - left), 0)

    @property
    def _half(self) -> int:
        return (self.size - self.seed + 1) // 2

    def _side_anchor(self, units: np.ndarray, begin: np.ndarray, place: np.ndarray, anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Of split anchors: the hash of the seed and the units that all windows of this side have beside it."""
        if not side.any():
            return anchor
        values = Rolling(BYTE_VALUES[units] if self.unit == "bytes" else units)
        seed = begin + (place >> 8 & 255)
        left, right = side == _LEFT, side == _RIGHT
        low = seed - np.where(left, self._half, 0)
        high = seed + self.seed + np.where(right, self.size - self.seed - self._half + 1, 0)
        split = mix(values.of(low[side > 0], high[side > 0]) ^ mix(side[side > 0].astype(_U)))
        out = anchor.copy()
        out[side > 0] = split.astype("i8")
        return out

    def _contexts(self, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows or not docs.num_rows:
            return pa.table({f: [] for f in ("anchor", "key", "place", "units")}, schema=_CONTEXT_TYPE)
        key = wanted.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        place, anchor, side = (wanted.column(c).to_numpy()[order] for c in ("place", "anchor", "side"))
        out = []
        docs = docs.filter(pc.is_in(docs.column("key"), pa.array(np.unique(key))))
        for batch in docs.combine_chunks().to_batches():
            own = batch.column(batch.schema.get_field_index("key")).to_numpy()
            for low, high, texts in Texts.chunks(batch.column(batch.schema.get_field_index("text"))):
                values, first = self.units(texts)
                left, right = np.searchsorted(key, own[low:high]), np.searchsorted(key, own[low:high], "right")
                many = right - left
                pick = np.arange(many.sum()) + np.repeat(left - (np.cumsum(many) - many), many)
                begin = (place[pick] >> 16) + np.repeat(first[:-1], many)
                length = (place[pick] & 255) + self.size - 1
                ends = np.cumsum(length)
                if len(ends) and ends[-1]:
                    take = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
                    data = np.ascontiguousarray(values[take])
                    offsets = np.r_[0, ends].astype("i4") * data.itemsize
                    group = self._side_anchor(values, begin, place[pick], anchor[pick], side[pick])
                    units = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    out.append(pa.record_batch(
                        [pa.array(group), pa.array(key[pick]), pa.array(place[pick]), units], schema=_CONTEXT_TYPE))
        return pa.Table.from_batches(out, schema=_CONTEXT_TYPE)

    def _resolved(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=_CONTEXT_TYPE)
        if table.num_rows:
            place = table.column("place").to_numpy()
            kind = np.uint8 if self.unit == "bytes" else _U
            units = np.concatenate([
                np.frombuffer(c.buffers()[2], kind)[_range(c, np.dtype(kind).itemsize)]
                for c in table.column("units").chunks if len(c)
            ])
            anchor, key = table.column("anchor").to_numpy(), table.column("key").to_numpy()
            length = (place & 255) + self.size - 1
            at = np.cumsum(length) - length
            for rows in _by_anchor(anchor, length):
                ends = np.cumsum(length[rows])
                take = np.arange(ends[-1]) + np.repeat(at[rows] - (ends - length[rows]), length[rows])
                own = place[rows]
                group = Group(anchor[rows], key[rows], own >> 16, own >> 8 & 255, own & 255, units[take], ends - length[rows])
                found, start, run = _merged(*self.resolve(group, self))
                yield _batch(key=found, start=start, run=run)


#: Units that are compared at once; the stretches of one anchor stay together.
_RESOLVE_UNITS = 1 << 19


def _by_anchor(anchor: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in parts of bounded size, all rows of an anchor in one part."""
    order = np.argsort(anchor, kind="stable")
    begins = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    units = np.r_[0, np.cumsum(length[order])][begins]
    low = 0
    while low < len(begins):
        high = max(low + 1, int(np.searchsorted(units, units[low] + _RESOLVE_UNITS)))
        stop = begins[high] if high < len(begins) else len(order)
        yield order[begins[low] : stop]
        low = high


def _cell(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> _U(64 - SEED_BITS)).astype(np.int64)


def _range(column: pa.Array, width: int) -> slice:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return slice(offsets[0] // width, offsets[-1] // width)


_STRETCHES = "anchor long, body long, key long, place long, run long"
_SETTLED = "anchor long, key long, place long, start long, run long, side long"
_CONTEXTS = "anchor long, key long, place long, units binary"
_CONTEXT_TYPE = pa.schema(
    [("anchor", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("units", pa.binary())]
)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64, copy=False)) for c in columns.values()], names=list(columns)
    )


def _equals(anchor, body, key, place) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal stretches together by place, and which of them are not the first."""
    order = np.lexsort((place, key, body, anchor))
    a, b = anchor[order], body[order]
    again = np.zeros(len(order), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, again


def _third(again: np.ndarray) -> np.ndarray:
    """Which rows are at least the third of equals, in an order in which equals follow each other."""
    out = again.copy()
    out[1:] &= again[:-1]
    return out


def _merged(key: np.ndarray, start: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one key that touch or overlap become one, unless a run lies inside an earlier longer one."""
    order = np.lexsort((start, key))
    key, start, run = key[order], start[order], run[order]
    if not len(key):
        return key, start, run
    end = start + run
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return key[at], start[at], np.maximum.reduceat(end, at) - start[at]


def covered(rows: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Which units of some texts lie in a repeated window; ``rows`` (key, start, run) are sorted by key."""
    key, start, run = rows
    left, right = np.searchsorted(key, keys), np.searchsorted(key, keys, "right")
    many = right - left
    pick = np.arange(many.sum()) + np.repeat(left - (np.cumsum(many) - many), many)
    begin = start[pick] + np.repeat(first[:-1], many)
    depth = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + run[pick] + size - 1, -1)
    return np.cumsum(depth[:-1]) > 0


def by_document(docs: Corpus, runs: DataFrame, each: Callable, schema: str) -> DataFrame:
    """``each(ids, texts, rows, keys)`` on chunks of documents with their runs gives record batches of ``schema``."""
    located = runs.withColumn("block", block_of("key", docs.blocks))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = tuple(right.column(c).to_numpy() for c in ("key", "start", "run"))
        order = np.lexsort((rows[1], rows[0]))
        rows, out = tuple(c[order] for c in rows), []
        for batch in left.combine_chunks().to_batches():
            at = {f: i for i, f in enumerate(batch.schema.names)}
            for low, high, texts in Texts.chunks(batch.column(at["text"])):
                ids = batch.column(at["doc_id"])[low:high]
                out.append(each(ids, texts, rows, batch.column(at["key"]).to_numpy()[low:high]))
        return pa.Table.from_batches(out) if out else empty

    empty = _empty(schema)
    return docs.by_block().groupBy("block").cogroup(located.groupBy("block")).applyInArrow(join, schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()
