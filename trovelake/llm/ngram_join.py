"""Jaccard self-join on word n-grams: rare-first prefixes, length, positional and suffix filters.

1. Each document becomes a set of hashed n-grams; equal sets are one class.
2. A class whose n-grams nearly all occur nowhere else has no partner: in any order of the
   n-grams, similar sets share at least l of the first n - need + l.  The order by hash needs
   no counts, so only these leading n-grams are exchanged, and classes sharing fewer go.
3. For the classes left, n-grams are counted and each set is ordered rare-first.  Sets are
   joined on the n-grams of their prefix, within bands of size outside which no pair is
   similar; sets so joined form clusters.
4. Clusters are cut into tiles of bounded size.  A tile finds the candidates of each set by
   its prefix with the length, positional and suffix filters and verifies each pair once.
   For components, pairs connected already aren't verified again, so a group of
   near copies needs about one verification per member and no list of all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.components import components
from trovelake.llm.grams import Rolling, Texts, mix
from trovelake.llm.tables import Corpus, block_of, corpus, joined, stored

WORDS = 5
PERCENT = 80
#: Sets in a tile.
TILE = 1024
#: An n-gram in so many classes of one batch is settled there: it crosses the shuffle once.
_COMMON = 16
#: An n-gram within its part, a class and a count on their way to the part.  Equal low bytes of different
#: ones can only add a candidate; a part is named by other bits of the n-gram than these bytes.
GRAM_BYTES, OWNER_BYTES, COUNT_BYTES = 5, 6, 4
_U = np.uint64


def _needed(n, percent: int):
    """Least overlap of a set of n with any similar set."""
    return (percent * n + 99) // 100


def _slack(n):
    return np.maximum(1, n // 10)


def _pair_need(n, m, percent: int):
    return -((-percent * (n + m)) // (100 + percent))


class NgramSets:
    def __init__(self, words: int, percent: int):
        if words < 1 or not 1 <= percent <= 100:
            raise ValueError("words must be positive and percent from 1 to 100")
        self.words, self.percent = words, percent

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram hashes, sorted within each text, and the bounds of each text's set."""
        data = texts.data
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
        hashes, first = Texts(data, texts.offsets).word_hashes()
        count = np.diff(first)
        grams = Rolling(hashes)
        many = np.where(count >= self.words, count - self.words + 1, np.minimum(count, 1))
        text = np.repeat(np.arange(len(count)), many)
        begin = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + first[text]
        hashes = grams.of(begin, begin + np.minimum(self.words, count)[text])
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        return hashes[new], np.searchsorted(text[new], np.arange(len(count) + 1))

    def classes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for low, high, texts in Texts.chunks(batch.column(1)):
                hashes, at = self.of(texts)
                one, two = _fingerprints(hashes, at)
                yield _longs(key=keys[low:high], n=np.diff(at), one=one, two=two)

    def leading(self, batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
        """The leading n-grams of each class by part: ``entries`` of (n-gram, class) and, for n-grams
        common in a batch, ``marks`` of the n-gram and ``counts`` of them for each class."""
        for batch in batches:
            found = []
            for _, _, texts in Texts.chunks(batch.column(1)):
                hashes, at = self.of(texts)
                one, _ = _fingerprints(hashes, at)
                n = np.diff(at)
                text = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(hashes)) - at[text]
                lead = place < (n - _needed(n, self.percent) + _slack(n))[text]
                found.append((hashes[lead], one[text[lead]]))
            if not found:
                continue
            grams, owners = _distinct_pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
            begin, size = _groups(grams)
            common = np.repeat(size >= _COMMON, size)
            mark = grams[begin[size >= _COMMON]]
            own, count = np.unique(owners[common], return_counts=True)
            # Sorted by n-gram, so by part; the classes' counts go by their own leading bits.
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(parts, dtype="i4")),
                _packed(_part(grams[~common], parts), parts, (grams[~common], GRAM_BYTES), (owners[~common], OWNER_BYTES)),
                _packed(_part(mark, parts), parts, (mark, GRAM_BYTES)),
                _packed(_part(own, parts), parts, (own, OWNER_BYTES), (count.astype(_U), COUNT_BYTES)),
            ], names=["part", "entries", "marks", "counts"])

    def cut(self, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        """The sets of the wanted documents."""
        keys = wanted.column("key")
        docs = docs.filter(pc.is_in(docs.column("key"), keys.combine_chunks()))
        out = []
        for batch in docs.combine_chunks().to_batches():
            own = batch.column(batch.schema.get_field_index("key"))
            for low, high, texts in Texts.chunks(batch.column(batch.schema.get_field_index("text"))):
                hashes, at = self.of(texts)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view("i8")))
                out.append(pa.record_batch([own[low:high], pa.array(np.diff(at)), sets], schema=_SET_TYPE))
        return pa.Table.from_batches(out, schema=_SET_TYPE)


_SET_TYPE = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    values = [c.view("i8") if c.dtype == _U else c.astype("i8", copy=False) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in values], names=list(columns))


def _fingerprints(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit fingerprints of each set."""
    out = []
    for salt in (_U(0x1B873593CC9E2D51), _U(0x52DCE72938495AB5)):
        sums = np.r_[_U(0), np.cumsum(mix(hashes ^ salt), dtype=_U)]
        out.append(sums[at[1:]] - sums[at[:-1]])
    return out[0], out[1]


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of runs of equal values."""
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return begin, np.diff(np.r_[begin, len(values)])


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash, by its 24 leading bits."""
    return ((values >> _U(40)) * _U(parts) >> _U(24)).astype(np.int64)


def _packed(part: np.ndarray, parts: int, *columns: tuple[np.ndarray, int]) -> pa.Array:
    """One value for each part: its rows, of the low bytes of each column; ``part`` is sorted."""
    rows = np.hstack([c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width] for c, width in columns])
    offsets = np.searchsorted(part, np.arange(parts + 1)) * rows.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), parts, [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _unpacked(values: pa.ChunkedArray, *widths: int) -> list[np.ndarray]:
    rows = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, sum(widths))
    out, at = [], 0
    for width in widths:
        full = np.zeros((len(rows), 8), np.uint8)
        full[:, :width] = rows[:, at : at + width]
        out.append(full.view("<u8").ravel().astype(_U))
        at += width
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many leading n-grams of a class other classes have too, for each part."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("part")
    bounds = np.searchsorted(table.column("part").to_numpy(), pc.unique(table.column("part")).to_numpy())
    for low, high in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
        own = table.slice(low, high - low)
        gram, owner = _unpacked(own.column("entries"), GRAM_BYTES, OWNER_BYTES)
        (marks,) = _unpacked(own.column("marks"), GRAM_BYTES)
        counted, n = _unpacked(own.column("counts"), OWNER_BYTES, COUNT_BYTES)
        grams, owners = _distinct_pairs(gram, owner)
        begin, size = _groups(grams)
        common = (size > 1) | np.isin(grams[begin], marks)
        named, count = np.unique(owners[np.repeat(common, size)], return_counts=True)
        yield _longs(owner=np.r_[named, counted], shared=np.r_[count, n.astype(np.int64)])


class Links:
    """Similar pairs of sets within a tile."""

    def __init__(self, percent: int, spanning: bool):
        self.percent, self.spanning = percent, spanning

    def __call__(self, group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        key, n = group.column("key").to_numpy(), group.column("n").to_numpy()
        lists = group.column("grams").combine_chunks()
        order = np.lexsort((key, n))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        sizes = lists.value_lengths().to_numpy()
        tokens = lists.flatten().to_numpy().view(_U)
        owner = np.repeat(place, sizes)
        arrange = np.lexsort((tokens, owner))
        tokens, owner = tokens[arrange], owner[arrange]
        key, n, side = key[order], n[order].astype(np.int64), side[order]
        at = np.searchsorted(owner, np.arange(len(n) + 1))
        sets = [tokens[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        bins = np.bincount(owner * 16 + (tokens >> _U(60)).astype(np.int64), minlength=16 * len(n)).reshape(-1, 16)
        # Rare-first order of each set, and its prefix without n-grams that no other set here has.
        _, number, df = np.unique(tokens, return_inverse=True, return_counts=True)
        rare = np.lexsort((number, df[number], owner))
        place = np.arange(len(rare)) - at[owner[rare]]
        prefix = place < (n - _needed(n, self.percent) + 1)[owner[rare]]
        prefix &= df[number[rare]] > 1
        token, doc, place = number[rare][prefix], owner[rare][prefix], place[prefix]
        by_token = np.lexsort((doc, token))
        token, doc, place = token[by_token], doc[by_token], place[by_token]
        begin, many = _groups(token)
        begin = np.repeat(begin, many)
        entries = np.lexsort((place, doc))
        bounds = np.searchsorted(doc[entries], np.arange(len(n) + 1))
        label = np.arange(len(n))
        pairs = []
        for x in range(len(n)):
            e = entries[bounds[x] : bounds[x + 1]]
            many = e - begin[e]  # earlier sets in the list of each prefix n-gram
            if not many.sum():
                continue
            spot = np.arange(many.sum()) + np.repeat(begin[e] - (np.cumsum(many) - many), many)
            y, at_x, at_y = doc[spot], np.repeat(place[e], many), place[spot]
            ok = (side[y] != side[x]) | (side[x] == 2)
            ok &= _needed(n[x], self.percent) <= n[y]
            if self.spanning:
                ok &= label[y] != label[x]
            y, first = np.unique(y[ok], return_index=True)
            if not len(y):
                continue
            need = _pair_need(n[x], n[y], self.percent)
            room = 1 + np.minimum(n[x] - at_x[ok][first], n[y] - at_y[ok][first]) - 1
            ok = room >= need
            ok &= np.abs(bins[y] - bins[x]).sum(axis=1) <= n[x] + n[y] - 2 * need
            for other, least in zip(y[ok][::-1].tolist(), need[ok][::-1].tolist(), strict=True):
                if self.spanning and label[other] == label[x]:
                    continue
                if _overlap(sets[x], sets[other]) >= least:
                    pairs.append((key[x], key[other]))
                    if self.spanning:
                        label[label == label[x]] = label[other]
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class NgramJoin:
    """Classes of equal sets and the links between them."""

    def __init__(self, documents: DataFrame, words: int, percent: int):
        self.sets, self.percent = NgramSets(words, percent), percent
        self.docs: Corpus = corpus(documents)
        self.members = stored(
            self.docs.docs.select("key", "text").mapInArrow(self.sets.classes, "key long, n long, one long, two long")
        )
        self.classes = self.members.where("n > 0").groupBy("n", "one", "two").agg(F.min("key").alias("key"))

    def links(self, *, spanning: bool) -> DataFrame:
        """Similar pairs (a, b) of classes by their least key: all of them, or enough to connect them."""
        sets = stored(self._candidates())
        clusters = components(self._joined(sets))
        size = clusters.groupBy("component").agg(F.count("*").alias("members"))
        many = clusters.join(size, "component").withColumn("chunks", F.ceil(F.col("members") / TILE).cast("int"))
        small = math.ceil(max(1, clusters.count()) / TILE)
        chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
        rows = sets.join(many.withColumnRenamed("node", "key"), "key").withColumn("chunk", chunk)
        others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
            F.least(c, F.col("chunk")).alias("low"), F.greatest(c, F.col("chunk")).alias("high")))
        tiles = rows.withColumn("tile", F.explode(others)).select(
            F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(small))).otherwise(F.col("component")).alias("cluster"),
            (F.col("chunks") == 1).alias("whole"), "tile.low", "tile.high",
            F.when(F.col("tile.low") == F.col("tile.high"), 2).when(F.col("chunk") == F.col("tile.low"), 0).otherwise(1).alias("side"),
            "key", "n", "grams",
        )
        work = Links(self.percent, spanning)
        return tiles.groupBy("cluster", "whole", "low", "high").applyInArrow(lambda t: work(t), "a long, b long")

    def _candidates(self) -> DataFrame:
        """The sets of classes that share enough leading n-grams with others."""
        parts, work = self.docs.blocks, self.sets
        leading = self.docs.docs.select("key", "text").mapInArrow(
            lambda it: work.leading(it, parts), "part int, entries binary, marks binary, counts binary")
        leading = leading.where(F.octet_length("entries") + F.octet_length("marks") + F.octet_length("counts") > 0)
        shared = leading.repartitionById(parts, "part").mapInArrow(_shared, "owner long, shared long")
        shared = shared.groupBy("owner").agg(F.sum("shared").alias("shared"))
        least = F.greatest(F.lit(1), F.expr(f"(({self.percent} * n + 99) div 100) div 10"))
        name = F.col("one").bitwiseAND(F.lit((1 << 8 * OWNER_BYTES) - 1))
        kept = self.classes.join(shared, name == F.col("owner")).where(F.col("shared") >= least)
        located = kept.select("key").withColumn("block", block_of("key", self.docs.blocks))
        sets = self.sets
        return (
            self.docs.by_block().groupBy("block").cogroup(located.groupBy("block"))
            .applyInArrow(lambda d, w: sets.cut(d, w), "key long, n long, grams array<long>")
        )

    def _joined(self, sets: DataFrame) -> DataFrame:
        """Join sets on their rare-first prefixes: edges from each set to the least key that it meets."""
        tokens = sets.select("key", "n", F.explode("grams").alias("gram"))
        df = tokens.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
        known = tokens.join(df, "gram").groupBy("key", "n").agg(
            F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
        alone = F.col("n") - F.size("grams")  # n-grams of no other set come first
        length = F.col("n") - F.expr(f"({self.percent} * n + 99) div 100") + 1 - alone
        step = math.log(100 / self.percent) if self.percent < 100 else 1.0
        band = F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)).cast("int")
        prefix = known.where(length > 0).select(
            "key", F.explode(F.slice("grams", 1, length.cast("int"))).alias("g"), band.alias("band"))
        prefix = stored(prefix.select("key", "g.gram", "band"))  # read for the least keys and for the join
        met = prefix.select("key", "gram", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
        first = met.groupBy("gram", "band").agg(F.min("key").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
        return met.join(first, ["gram", "band"]).where("key <> b").select(F.col("key").alias("a"), "b").distinct()


def similar_pairs(documents: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All pairs (a, b) of different n-gram sets with Jaccard similarity of ``percent`` or more, by doc_id.

    Each set stands under the first of its documents; see ``near_duplicates`` for the rows of
    a set and for nulls, empty texts and repeated ids.
    """
    join = NgramJoin(documents, words, percent)
    ids = join.docs.docs.select("key", "doc_id")
    pairs = join.links(spanning=False)
    for c in ("a", "b"):
        named = ids.select(F.col("key").alias(c), F.col("doc_id").alias(f"doc_{c}"))
        pairs = pairs.join(named, c).drop(c)
    return pairs


def near_duplicates(documents: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id and ``keep``.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r with A-Z in lower case; the
    set holds the distinct runs of ``words`` words, or the whole sequence if it is shorter.
    Texts without words and null texts have no shingles and no links.  component_id is the
    smallest doc_id reachable over links of ``percent`` or more; ``keep`` marks that row.
    Rows that share or lack a doc_id are documents of their own, in the order of (doc_id with
    nulls first, text).  Other columns are not read; an empty table gives no rows.
    """
    join = NgramJoin(documents, words, percent)
    found = stored(components(join.links(spanning=True)))
    classes = join.classes.join(found, F.col("key") == F.col("node"), "left").select(
        "n", "one", "two", F.coalesce("component", "key").alias("component"))
    rows = joined(join.members.where("n > 0"), stored(classes), ["n", "one", "two"], join.docs.rows).select("key", "n", "component")
    rows = stored(rows.unionByName(join.members.where("n = 0").select("key", "n", F.col("key").alias("component"))))
    ids = join.docs.docs.select("key", "doc_id")
    named = ids.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    return joined(rows.join(ids, "key"), named, ["component"], join.docs.rows).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("key") == F.col("component")).alias("keep"))
