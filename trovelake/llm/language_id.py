"""Language identification by prediction by partial matching.

Each language has a byte context tree of bounded order with frozen counts.  A byte costs
the code length the tree gives it: count / (total + distinct) in the longest known context,
else the escape distinct / (total + distinct) and the next shorter context, down to a
uniform code.  The language whose tree codes the text in the fewest bits is predicted.

The trees of a group of languages share one set of nodes.  Per (context, byte) seen in any
language of the group a row holds the exact code length in every one, so scoring is two table
look-ups per byte for all of them at once; bytes unseen in a context pay the context's
escape row and fall to the shorter one.  More languages make more groups, not larger ones; a
code length doesn't depend on the grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelake.functions.text import let
from trovelake.llm.tables import stored
from trovelake.runtime import unnest

ORDER = 3
#: Bounds of the training sample: pieces of a language, and bytes of a piece (a longer text is
#: cut into several).
SAMPLE_DOCS = 400
SAMPLE_BYTES = 16384
#: Bounds of a group of languages (or one language alone): how many, and their counted grams.
GROUP_LANGUAGES = 16
GROUP_GRAMS = 1 << 20
#: Groups of no more grams in all stay loaded in a worker; else one is loaded at a time.
LOADED_GRAMS = 1 << 21
UNDETERMINED = "und"
_CHUNK = 1 << 19


def _grams(data: np.ndarray, inside: np.ndarray, order: int) -> np.ndarray:
    """Big-endian keys of the order + 1 bytes that end at each position where they are in one text."""
    key = data.astype(np.uint64)
    for back in range(1, order + 1):
        key[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * back)
    return key[inside >= order]


def _positions(lengths: np.ndarray) -> np.ndarray:
    """Position of each byte in its own text, for texts laid end to end."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def _pieces(text: Column, size: int) -> Column:
    """The text's bytes, cut every ``size`` bytes."""

    def cut(data: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.octet_length(data) - 1) / size).cast("int"))
        return F.transform(parts, lambda i: F.substring(data, i * size + 1, F.lit(size)))

    data = text.cast("binary")
    return F.when(F.octet_length(text) <= size, F.array(data)).otherwise(let(data, cut))


def train(documents: DataFrame, *, order: int = ORDER, sample_docs: int = SAMPLE_DOCS,
          sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Fit on rows with a text and a lang: a bounded sample of text pieces per language, drawn by hash.

    Rows with null text or lang and texts without letters don't count.  Every language of the
    other rows is learned, whatever the number of languages and the length of its texts.
    Without any usable row the model knows no language and predicts ``und``.
    """
    spark = documents.sparkSession
    usable = unnest(
        documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text"),
        _pieces(F.col("text"), sample_bytes), "piece", keep=("lang",)
    ).withColumn("draw", F.xxhash64("piece"))
    found = usable.groupBy("lang").agg(F.approx_count_distinct("draw").alias("pieces")).collect()
    if not found:
        return LanguageModel([], [], 0, order)
    # Twice the wanted share of the hash range: few rows, and copies of a piece combine in each task.
    last = [(r.lang, min(int((min(1.0, 2 * sample_docs / max(r.pieces, 1)) - 0.5) * 2.0**64), (1 << 63) - 1)) for r in found]
    reach = spark.createDataFrame(last, f"lang {documents.schema['lang'].dataType.simpleString()}, last long")
    drawn = Window.partitionBy("lang").orderBy("draw", "piece")
    sample = (
        usable.join(F.broadcast(reach), "lang").where("draw <= last")
        .groupBy("lang", "draw").agg(F.min("piece").alias("piece"))
        .withColumn("_rank", F.row_number().over(drawn)).where(F.col("_rank") <= sample_docs)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, pieces in pd.DataFrame({"lang": batch.column(0).to_pylist(), "piece": batch.column(1).to_pylist()}).groupby("lang"):
                raw = pieces["piece"].tolist()
                data = np.frombuffer(b"".join(raw), np.uint8)
                inside = _positions(np.array([len(r) for r in raw]))
                for k in range(order + 1):
                    keys, n = np.unique(_grams(data, inside, k), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(np.full(len(keys), k, "i4")),
                         pa.array(keys.astype("i8")), pa.array(n.astype("i8"))],
                        names=["lang", "k", "gram", "n"])

    counts = stored(
        sample.select("lang", "piece").mapInArrow(count, "lang string, k int, gram long, n long")
        .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).repartitionByRange("lang")
    )
    groups: list[list[str]] = []
    grams = held = 0
    for r in sorted(counts.groupBy("lang").agg(F.count("*").alias("n")).collect()):
        if not groups or len(groups[-1]) == GROUP_LANGUAGES or held + r.n > GROUP_GRAMS:
            groups.append([])
            held = 0
        groups[-1].append(r.lang)
        grams, held = grams + r.n, held + r.n
    shared = []
    for group in groups:  # one at a time in the driver
        own = counts.where(F.col("lang").between(group[0], group[-1])).toPandas()
        shared.append(spark.sparkContext.broadcast(PartialMatching(group, own, order)))
    return LanguageModel([lang for group in groups for lang in group], shared, grams, order)


class LanguageModel:
    """The groups of languages, each a broadcast of its own; the driver and a task hold few at a time."""

    def __init__(self, languages: list[str], groups: list[Broadcast], grams: int, order: int):
        self.languages, self.groups, self.grams, self.order = languages, groups, grams, order

    def each_group(self) -> Iterator[PartialMatching]:
        for group in self.groups:
            yield group.value
            if self.grams > LOADED_GRAMS and getattr(group, "_path", None):
                vars(group).pop("_value", None)  # read from its local file again for the next batch

    def code_lengths(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits of each text (laid end to end in ``data``) in each language."""
        parts = [group.code_lengths(data, lengths) for group in self.each_group()]
        return np.hstack(parts) if parts else np.zeros((len(lengths), 0))


class PartialMatching:
    """Frozen statistics of a group of languages; small, as it grows with the bounded sample only."""

    def __init__(self, languages: list[str], counts: pd.DataFrame, order: int):
        self.languages, self.order = languages, order
        self.keys: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.escape_keys: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        size = len(languages)
        column = {lang: i for i, lang in enumerate(languages)}
        shorter = None  # costs of every known (context, byte) one order down, per language
        for k in range(order + 1):
            own = counts[counts["k"] == k]
            keys = np.unique(own["gram"].to_numpy().astype(np.uint64))
            n = np.zeros((len(keys), size))
            n[np.searchsorted(keys, own["gram"].to_numpy().astype(np.uint64)),
              own["lang"].map(column).to_numpy(dtype=int)] = own["n"]
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, at, n)
            np.add.at(distinct, at, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                coded = -np.log2(n / (total + distinct)[at])
            if k == 0:
                fallen = np.full((len(keys), size), 8.0)
            else:
                low = keys & np.uint64((1 << 8 * k) - 1)
                fallen = shorter[np.searchsorted(self.keys[-1], low)]
            cost = np.where(n > 0, coded, escape[at] + fallen)
            self.keys.append(keys)
            self.costs.append(cost.astype(np.float32))
            self.escape_keys.append(contexts)
            self.escapes.append(escape.astype(np.float32))
            shorter = cost
        self._tables: list | None = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def _trees(self) -> list[tuple[np.ndarray, ...]]:
        """Per order k, built once in each worker: (names, children, costs, escapes).

        ``names`` leads from a row one order down, which is a string of k bytes, to the node
        of the context of these bytes; ``children`` from (node, byte) to a row of costs.  The
        last node, name and cost row stand for what no language has seen.
        """
        if self._tables is None:
            self._tables, zero = [], np.zeros((1, len(self.languages)), np.float32)
            for k, (keys, contexts) in enumerate(zip(self.keys, self.escape_keys, strict=True)):
                child = np.full((len(contexts) + 1, 256), -1, np.int32)
                node = np.searchsorted(contexts, keys >> np.uint64(8))
                child[node, (keys & np.uint64(255)).astype(int)] = np.arange(len(keys))
                shorter = self.keys[k - 1] if k else np.zeros(1, np.uint64)
                found = np.minimum(np.searchsorted(contexts, shorter), len(contexts) - 1)
                names = np.where(contexts[found] == shorter, found, len(contexts))
                names = np.append(names, len(contexts)).astype(np.int32)
                costs, escapes = np.vstack([self.costs[k], zero]), np.vstack([self.escapes[k], zero])
                self._tables.append((names, child, costs, escapes))
        return self._tables

    def code_lengths(self, data: np.ndarray, lengths: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Bits of each text (laid end to end in ``data``) in each language.

        The first ``known`` bytes of a text are context only and cost nothing.
        """
        size, texts = len(self.languages), len(lengths)
        bits = np.zeros((texts, size))
        if not len(data):
            return bits
        inside, owner = _positions(lengths), np.repeat(np.arange(texts), lengths)
        below = np.full((len(data), size), 8.0, np.float32)
        rows = np.zeros(len(data), np.int32)
        for k, (names, child, costs, escapes) in enumerate(self._trees()):
            if k:
                before = np.empty_like(rows)
                before[0], before[1:] = -1, rows[:-1]
                before[inside < k] = -1
                node = names[before]
            else:
                node = np.full(len(data), names[0], np.int32)
            rows = child[node, data]
            fallen = np.flatnonzero(rows < 0)
            below[fallen] += escapes[node[fallen]]
            seen = np.flatnonzero(rows >= 0)
            below[seen] = costs[rows[seen]]
        if known is not None:
            below[inside < known[owner]] = 0
        for lang in range(size):
            bits[:, lang] = np.bincount(owner, weights=below[:, lang], minlength=texts)
        return bits


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte`` to documents with a text column.

    Only the text is read.  Null text, text without a letter, and any text when the model
    knows no language give ``und`` with score 0.  Equal code lengths give the language that
    sorts first.  The score is the share of the predicted language when each language
    weighs 2 to minus its bits per byte times a fixed sharpness.  Columns of these three
    names in the input are replaced; all other columns pass through.
    """
    docs = documents.drop("lang_pred", "score", "bits_per_byte")
    languages = np.array([*model.languages, UNDETERMINED])

    def rates(trees: PartialMatching, raw: list[bytes]) -> np.ndarray:
        """Bits per byte of each text in each language of a group."""
        out = np.zeros((len(raw), len(trees.languages)))
        low = 0
        while low < len(raw):
            high, size = low, 0
            while high < len(raw) and (high == low or size + len(raw[high]) <= _CHUNK):
                size += len(raw[high])
                high += 1
            lengths = np.array([len(r) for r in raw[low:high]])
            for start in range(0, int(lengths.max()) or 1, _CHUNK):  # more than once for a long text alone
                back = min(start, trees.order)
                parts = [r[start - back : start + _CHUNK] for r in raw[low:high]]
                own = np.array([len(p) for p in parts])
                out[low:high] += trees.code_lengths(np.frombuffer(b"".join(parts), np.uint8), own, np.full(len(own), back))
            out[low:high] /= np.maximum(lengths, 1)[:, None]
            low = high
        return out

    def score(texts: pd.Series) -> pd.DataFrame:
        raw = [b"" if t is None else t.encode() for t in texts]
        at, before = np.zeros(len(raw), int), 0
        least, weight = np.full(len(raw), np.inf), np.zeros(len(raw))
        for trees in model.each_group():
            each = rates(trees, raw)
            own = each.argmin(axis=1)
            best = each[np.arange(len(raw)), own]
            at = np.where(best < least, before + own, at)
            now = np.minimum(least, best)
            weight = weight * np.exp2(-_SHARPNESS * (least - now)) + np.exp2(-_SHARPNESS * (each - now[:, None])).sum(axis=1)
            least, before = now, before + len(trees.languages)
        return pd.DataFrame({"lang_pred": languages[at], "score": 1 / weight, "bits_per_byte": least})

    kind = "lang_pred string, score double, bits_per_byte double"
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        letters = F.lit(False)
    guess = F.pandas_udf(score, kind)(F.when(letters, F.col("text")).otherwise(F.lit("")))
    empty = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                     F.lit(None).cast("double").alias("bits_per_byte"))
    if not model.languages:
        return docs.select("*", empty.alias("_guess")).select(*docs.columns, "_guess.*")
    out = docs.withColumn("_guess", guess).withColumn("_guess", F.when(letters, F.col("_guess")).otherwise(empty))
    return out.select(*docs.columns, "_guess.*")


#: Sharpness of the score: a lead of one bit per byte is a factor of 2 ** 16.
_SHARPNESS = 16.0
