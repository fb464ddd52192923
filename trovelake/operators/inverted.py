"""Stored inverted index: postings in blocks with bounds, and exact BM25 top-k that skips blocks.

Chunks are numbered in runs of ``RANGE``; a row of the index is one block: a term's postings in
one range, as places in the range and term frequencies, with the largest frequency and the
least chunk length of the block.  These two bound the term's weight in the block under any
parameters and corpus statistics.  A range has one more row, without a term, for the keys,
lengths and filter values of its chunks.  The table is range-partitioned and sorted by (term,
range), so a term's blocks are few pages of few files, and a very common term is spread over
many files.  The statistics of BM25 are sums over these rows.

A search reads the bounds of its terms first.  Per query the bounds of a range add up to a
bound of every score in it; the best ranges are scored, which gives a kth score, and of the
others only those are read whose bound reaches it.  Many queries together leave out next to
nothing: they share one pass over the blocks of all their terms, grouped by range, whose cost
follows the index and not index times blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelake import fixed_values as fv
from trovelake.operators.block_search import (
    COLUMN_BLOCK,
    HIT_SCHEMA,
    SCORE_DIGITS,
    _best,
    _keep,
    final_topk,
    flat_lists,
    query_keys,
)
from trovelake.operators.bm25 import add_gains, with_idf, with_tokens
from trovelake.runtime import per_block, scratch_dir, unnest

#: Chunks of a range, and ranges that are scored together.
RANGE = 1024
GROUP = 16
#: Ranges of each query that are scored for its first kth score.
FIRST = 4
#: Queries of a block whose ranges are bounded; more queries take more passes over the bounds.
BLOCK_QUERIES = 64
#: More queries than these share one pass over all ranges.
PRUNED_QUERIES = 64
#: Values that are pushed to the scan as equalities; more are joined.
PUSHED = 64
#: Ranges that are broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 1 << 17
_PAGE = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.page.size": str(32 << 10), "parquet.page.row.count.limit": "2048"}


def write_postings(chunks: DataFrame, path: str, filter_columns: tuple[str, ...] = ("product_type",)) -> str:
    """Write the index of chunks (doc_pos, piece, tokens or text, filter columns) to ``path``, replacing it.

    Blocks are made inside each Arrow batch and stored as they come, as finding the bounds of the
    ranges reads them once more; the one shuffle lays them out.
    """
    rows = with_tokens(chunks).select(
        F.monotonically_increasing_id().alias("n"), "doc_pos", "piece", "tokens",
        *(F.col(c).cast("string").alias(c) for c in filter_columns))
    names = [f"of_{c}" for c in filter_columns]
    schema = ("term string, range long, slot array<int>, tf array<int>, max_tf int, min_dl int, "
              "doc_pos array<long>, piece array<long>, dl array<int>" + "".join(f", {c} array<string>" for c in names))

    def lists(values: np.ndarray | pa.Array, begin: np.ndarray, end: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[begin, end].astype("i4")), pa.array(values) if isinstance(values, np.ndarray) else values)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            row, words = flat_lists(batch.column(3))
            dl = np.bincount(row, minlength=batch.num_rows).astype("i4")
            coded = words.dictionary_encode()
            size = max(1, len(coded.dictionary))
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cells, tf = np.unique(code * batch.num_rows + row, return_counts=True)
            code, row = cells // batch.num_rows, cells % batch.num_rows
            span = number // RANGE
            begin = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(span[row], prepend=-1) != 0))
            count, tf = len(begin), tf.astype("i4")
            own = np.flatnonzero(np.diff(span, prepend=-1) != 0)
            slot = (number % RANGE).astype("i4")
            both = len(begin) + len(own)
            columns = [
                pa.concat_arrays([coded.dictionary.take(pa.array(code[begin] % size)), pa.nulls(len(own), pa.string())]),
                pa.array(np.r_[span[row[begin]], span[own]]),
                pa.concat_arrays([lists(slot[row], begin, len(row)), lists(slot, own, len(slot))]),
                pa.concat_arrays([lists(tf, begin, len(tf)), pa.nulls(len(own), pa.list_(pa.int32()))]),
                pa.concat_arrays([pa.array(np.maximum.reduceat(tf, begin) if count else tf[:0]), pa.nulls(len(own), pa.int32())]),
                pa.concat_arrays([pa.array(np.minimum.reduceat(dl[row], begin) if count else dl[:0]), pa.nulls(len(own), pa.int32())]),
            ]
            for values in (*(batch.column(i) for i in (1, 2)), pa.array(dl), *(batch.column(i) for i in range(4, 4 + len(names)))):
                kept = lists(values, own, len(values))
                columns.append(pa.concat_arrays([pa.nulls(count, kept.type), kept]))
            assert all(len(c) == both for c in columns)
            yield pa.RecordBatch.from_arrays(columns, names=["term", "range", "slot", "tf", "max_tf", "min_dl", "doc_pos", "piece", "dl", *names])

    table = _stored(rows.mapInArrow(blocks, schema)).repartitionByRange("term", "range").sortWithinPartitions("term", "range")
    table.write.mode("overwrite").options(**_PAGE).parquet(path)
    return path


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def postings_stats(postings: DataFrame) -> tuple[int, float]:
    """Number of chunks and mean length, as ``bm25.corpus_stats``; only the rows of the ranges are read."""
    dl = F.aggregate("dl", F.lit(0).cast("long"), lambda total, n: total + n)
    n, tokens = postings.where(F.col("term").isNull()).agg(F.sum(F.size("dl")), F.sum(dl)).first()
    return n or 0, (tokens / n if n else 0.0)


def postings_terms(postings: DataFrame, n: int) -> DataFrame:
    """df and idf per term, as ``bm25.term_stats``."""
    counts = postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("slot")).alias("df"))
    return with_idf(counts, n)


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _among(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column has one of the values; few of them reach the scan (a long IN would as its ends only)."""
    if len(values) <= PUSHED:
        return rows.where(reduce(lambda a, b: a | b, (F.col(column) == v for v in values), F.lit(False)))
    known = rows.sparkSession.createDataFrame(pa.table({column: pa.array(values)}))
    return rows.join(F.broadcast(known), column, "left_semi")


class _Query:
    """The counted block of queries: for each known term the queries with it, how often, and its idf."""

    def __init__(self, asked: pa.Table, idf: pa.Table, avgdl: float, k1: float, b: float):
        self.keys = query_keys(asked)
        vocabulary = idf.column("term").combine_chunks()
        self.terms = {t: i for i, t in enumerate(vocabulary.to_pylist())}
        self.idf = idf.column("idf").to_numpy()
        query, tokens = flat_lists(asked.column("tokens").combine_chunks())
        code = pc.fill_null(pc.index_in(tokens, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        pairs, times = np.unique(np.stack([code, query])[:, code >= 0], axis=1, return_counts=True)
        edge = np.searchsorted(pairs[0], np.arange(len(self.idf) + 1))
        self.of = [(pairs[1, a:b], times[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.avgdl, self.k1, self.b = max(avgdl, 1.0), k1, b

    def gain(self, term: int, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * np.maximum(dl, 1) / self.avgdl))

    def bounds(self, table: pa.Table) -> pa.Table:
        """(q, range, bound) for the ranges of a group in which a query has a term."""
        spans, at = np.unique(table.column("range").to_numpy(), return_inverse=True)
        term = np.array([self.terms[t] for t in table.column("term").to_pylist()], np.int64)
        weight = self.gain(term, table.column("max_tf").to_numpy().astype(float), table.column("min_dl").to_numpy())
        best = np.zeros((len(self.terms), len(spans)))
        np.maximum.at(best, (term, at), weight)  # a range that two batches hold has two blocks of a term
        total = np.zeros((len(self.keys), len(spans)))
        for t in np.unique(term).tolist():
            who, times = self.of[t]
            total[who] += times[:, None] * best[t]
        q, r = np.nonzero(total)
        return pa.table({"q": pa.array(q.astype("i4")), "range": pa.array(spans[r]), "bound": pa.array(total[q, r])})

    def scores(self, rows: pa.Table, pairs: pa.Table | None, k: int, wanted: list | None, query_filter: str | None, filters: dict[str, str]) -> pa.Table:
        """The k best chunks of each query in a group, within the wanted (q, range) if given."""
        rows = rows.combine_chunks()
        spans, place = np.unique(rows.column("range").to_numpy(), return_inverse=True)
        size = len(spans) * RANGE
        known = rows.column("term").is_valid().to_numpy()

        def flat(mask: np.ndarray, *names: str) -> tuple[np.ndarray, list]:
            """Cells of the masked rows' list elements, and the columns' elements."""
            part = rows.filter(pa.array(mask))
            row, slot = flat_lists(_list(part, "slot"))
            return place[mask][row] * RANGE + slot.to_numpy(), [_list(part, n).flatten() for n in names]

        doc, piece, dl = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
        columns = sorted({*filters, *([query_filter] if query_filter else [])})
        own, values = flat(~known, "doc_pos", "piece", "dl", *(f"of_{c}" for c in columns))
        for out, column in zip((doc, piece, dl), values, strict=False):
            out[own] = column.to_numpy()
        named = dict(zip(columns, values[3:], strict=True))

        def matching(column: str, value: str) -> np.ndarray:
            """Cells whose filter column has the value."""
            at = np.zeros(size, bool)
            at[own] = pc.fill_null(pc.equal(named[column], value), False).to_numpy(zero_copy_only=False)
            return at

        code = np.array([self.terms[t] for t in rows.column("term").drop_null().to_pylist()], np.int64)
        cells, (tf,) = flat(known, "tf")
        term = np.repeat(code, pc.list_value_length(_list(rows.filter(pa.array(known)), "slot")).to_numpy())
        order = np.argsort(term, kind="stable")
        term, cells = term[order], cells[order]
        gain = self.gain(term, tf.to_numpy()[order].astype(float), dl[cells])
        begin = np.flatnonzero(np.diff(term, prepend=-1) != 0)
        inside = np.ones(size, bool)
        for c, value in filters.items():
            inside &= matching(c, value)
        asked = None
        if pairs is not None:
            asked = np.zeros((len(self.keys), len(spans)), bool)
            mine = np.isin(pairs.column("range").to_numpy(), spans)
            asked[pairs.column("q").to_numpy()[mine], np.searchsorted(spans, pairs.column("range").to_numpy()[mine])] = True
        fits = {value: matching(query_filter, value) for value in {*(wanted or []), None} - {None}}
        pool = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]
        for low in range(0, len(self.keys), COLUMN_BLOCK):
            ids = np.arange(low, min(low + COLUMN_BLOCK, len(self.keys)))
            total = np.zeros((len(ids), size))
            add_gains(total, ids, [self.of[t] for t in term[begin]], begin, cells, gain)
            allowed = (total > 0) & inside
            if asked is not None:
                allowed &= np.repeat(asked[ids], RANGE, axis=1)
            for i, q in enumerate(ids) if wanted is not None else ():
                if wanted[q] is not None:
                    allowed[i] &= fits[wanted[q]]
            matrix = np.where(allowed, np.round(total, SCORE_DIGITS) + 0.0, -1.0)
            q, at = _best(matrix, k, allowed)
            found = _keep([ids[q], matrix[q, at], doc[at], piece[at]], k)
            pool = [np.concatenate(pair) for pair in zip(pool, found, strict=True)]
        q, score, doc, piece = pool
        return pa.table([pa.array(self.keys[q, 0]), pa.array(self.keys[q, 1].astype("i4")), pa.array(doc), pa.array(piece), pa.array(score)],
                        names=["qid", "variant", "doc_pos", "piece", "score"])


def _list(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def indexed_topk(
    postings: DataFrame,
    terms: DataFrame,
    n_avgdl: tuple[int, float],
    queries: DataFrame,
    k: int = fv.TOP_K,
    filters: dict[str, str] | None = None,
    query_filter: str | None = None,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
) -> DataFrame:
    """The rows of ``bm25.bm25_topk``, read from the stored index.

    ``postings`` comes from ``read_postings``; filters name columns it was written with.
    """
    spark = postings.sparkSession
    filters = filters or {}
    queries = queries.select("qid", "variant", "tokens", *([query_filter] if query_filter else []))
    group = F.floor(F.col("range") / GROUP).alias("group")
    lists = ["tf", "doc_pos", "piece", "dl", *(f"of_{c}" for c in sorted({*filters, *([query_filter] if query_filter else [])}))]
    # Spark's Arrow writer fills the nulls of a list column anew with every row, so a batch of them takes the square of its rows.
    sent = ["term", "range", "slot", *(F.coalesce(c, F.array().cast(postings.schema[c].dataType)).alias(c) for c in lists)]

    def blocks_of(block: DataFrame) -> tuple[_Query, list | None, DataFrame]:
        """The counted queries, the filter value each wants, and the blocks of their terms."""
        asked = block.toArrow()
        used = unnest(block, F.col("tokens"), "term", keep=()).distinct()
        idf = terms.select("term", "idf").join(F.broadcast(used), "term", "left_semi").toArrow()
        query = _Query(asked, idf, n_avgdl[1], k1, b)
        wanted = asked.column(query_filter).to_pylist() if query_filter else None
        return query, wanted, _among(postings.where(F.col("term").isNotNull()), "term", list(query.terms))

    def shared(block: DataFrame) -> DataFrame:
        """All ranges, each block of the index read once for all queries."""
        query, wanted, mine = blocks_of(block)
        keys = postings.where(F.col("term").isNull())
        rows = mine.unionByName(keys).select(*sent)
        return rows.groupBy(group).applyInArrow(
            lambda t: query.scores(t, None, k, wanted, query_filter, filters), HIT_SCHEMA)

    def search(block: DataFrame) -> DataFrame:
        query, wanted, mine = blocks_of(block)
        if not query.terms:
            return spark.createDataFrame([], HIT_SCHEMA)
        bounds = _stored(
            mine.select("term", "range", "max_tf", "min_dl").groupBy(group)
            .applyInArrow(lambda t: query.bounds(t), "q int, range long, bound double"))

        def scored(pairs: DataFrame) -> DataFrame:
            spans = pairs.select("range").distinct()
            few = spans.limit(BROADCAST_RANGES + 1).toArrow().column("range").to_pylist()
            if len(few) <= BROADCAST_RANGES:
                blocks = _among(mine, "range", few)
                keys = _among(postings.where(F.col("term").isNull()), "range", few)
            else:
                blocks = mine.join(spans, "range", "left_semi")
                keys = postings.where(F.col("term").isNull()).join(spans, "range", "left_semi")
            rows = blocks.unionByName(keys).select(*sent)
            return rows.groupBy(group).cogroup(pairs.groupBy(group)).applyInArrow(
                lambda left, right: query.scores(left, right, k, wanted, query_filter, filters), HIT_SCHEMA)

        best = Window.partitionBy("q").orderBy(F.desc("bound"), "range")
        ranked = bounds.withColumn("n", F.row_number().over(best))
        begun = _stored(scored(ranked.where(F.col("n") <= FIRST).select("q", "range")))
        kth = final_topk(begun, k).where(F.col("rank") == k).select("qid", "variant", F.col("score").alias("kth"))
        number = pa.table({"qid": query.keys[:, 0], "variant": query.keys[:, 1].astype("i4"), "q": np.arange(len(query.keys), dtype="i4")})
        kth = F.broadcast(spark.createDataFrame(number).join(kth, ["qid", "variant"]).select("q", "kth"))
        rest = ranked.where(F.col("n") > FIRST).join(kth, "q", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0.0)) - 1e-9)
        return begun.unionByName(scored(_stored(rest.select("q", "range"))))

    if queries.count() > PRUNED_QUERIES:
        return final_topk(per_block(queries, shared, weight="tokens"), k)
    return final_topk(per_block(queries, search, weight="tokens", max_rows=BLOCK_QUERIES), k)
