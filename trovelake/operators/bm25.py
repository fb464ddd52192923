"""BM25: corpus statistics as aggregations, and top-k search over token lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import tokenize
from trovelake.operators.block_search import final_topk, flat_lists, local_topk, query_keys
from trovelake.operators.chunking import apply_filters
from trovelake.runtime import per_block, unnest

CHUNK_KEY = ("doc_pos", "piece")


def with_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks with their token list (stored with an index, so computed once)."""
    return chunks if "tokens" in chunks.columns else chunks.withColumn("tokens", tokenize(F.col("text")))


def postings(chunks: DataFrame) -> DataFrame:
    """One row per (chunk, term): tf, the chunk's length dl and the product type.

    Terms are counted inside each Arrow batch of chunks, so nothing is shuffled.
    """
    rows = with_tokens(chunks).select(*CHUNK_KEY, "product_type", "tokens")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words = flat_lists(batch.column(3))
            length = np.bincount(row, minlength=batch.num_rows)
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            size = max(1, len(coded.dictionary))
            cells, tf = np.unique(row * size + code, return_counts=True)
            at = pa.array(cells // size)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(at) for i in range(3)),
                    pa.array(length.astype(np.int32)).take(at),
                    coded.dictionary.take(pa.array(cells % size)),
                    pa.array(tf.astype(np.int32)),
                ],
                names=[*batch.schema.names[:3], "dl", "term", "tf"],
            )

    return rows.mapInArrow(count, f"{kind}, dl int, term string, tf int")


def doc_stats(chunks: DataFrame) -> DataFrame:
    """Token count of every chunk, empty ones included."""
    return with_tokens(chunks).select(*CHUNK_KEY, F.size("tokens").cast("bigint").alias("dl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length (chunks without tokens count)."""
    return doc_stats(chunks).agg(
        F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
    )


def term_counts(chunks: DataFrame) -> DataFrame:
    """df per term; a hot term shrinks to one row per task before the shuffle.  Counts of parts of a corpus add up."""
    terms = unnest(with_tokens(chunks), F.array_distinct("tokens"), "term", keep=())
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def with_idf(counts: DataFrame, n: int) -> DataFrame:
    df = F.col("df")
    return counts.withColumn("idf", F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)))


def term_stats(chunks: DataFrame, n: int) -> DataFrame:
    """df and idf per term."""
    return with_idf(term_counts(chunks), n)


#: Cells (queries x rows) of a term from which its share of the scores is a row of a matrix product, and rows of one.
_DENSE_CELLS = 1 << 15
_DENSE_TERMS = 64


def add_gains(total: np.ndarray, ids: np.ndarray, asking: list, begin: np.ndarray, cells: np.ndarray, gain: np.ndarray) -> None:
    """Add the gains of terms to the scores (queries ``ids`` x cells), as often as each query has the term.

    ``asking`` holds per term its queries and how often they have it, ``begin`` where its run in
    ``cells`` and ``gain`` starts.  A term of few queries or cells touches those only; common
    ones are multiplied together.
    """
    if not len(ids) or not len(begin):
        return
    place = np.full(int(max(ids.max(), *(who.max(initial=0) for who, _ in asking), 0)) + 1, -1)
    place[ids] = np.arange(len(ids))
    common = []
    for (who, times), low, high in zip(asking, begin, np.append(begin[1:], len(cells)), strict=True):
        at = place[who]
        if not (mine := at >= 0).any():
            continue
        if mine.sum() * (high - low) >= _DENSE_CELLS:
            common.append((at[mine], times[mine], low, high))
        else:
            total[np.ix_(at[mine], cells[low:high])] += np.outer(times[mine], gain[low:high])
    for first in range(0, len(common), _DENSE_TERMS):
        part = common[first : first + _DENSE_TERMS]
        weight, rows = np.zeros((len(ids), len(part))), np.zeros((len(part), total.shape[1]))
        for i, (at, times, low, high) in enumerate(part):
            weight[at, i] = times
            rows[i, cells[low:high]] = gain[low:high]
        total += weight @ rows


def _bm25_kernel(asked: pa.Table, idf: pa.Table, avgdl: float, k1: float, b: float):
    """Scores of token lists: sum over query tokens, repeats included."""
    vocabulary = idf.column("term").combine_chunks()
    weight = idf.column("idf").to_numpy()
    query, tokens = flat_lists(asked.column("tokens").combine_chunks())
    code = pc.fill_null(pc.index_in(tokens, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    pairs, times = np.unique(np.stack([code, query]), axis=1, return_counts=True)
    start = np.searchsorted(pairs[0], np.arange(len(weight) + 1))  # query rows of every term

    def prepare(batch: pa.RecordBatch):
        n = batch.num_rows
        row, words = flat_lists(batch.column(2))
        length = np.maximum(np.bincount(row, minlength=n), 1)
        found = pc.index_in(words, value_set=vocabulary)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        cell = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * n + row[hit]
        cell, tf = np.unique(cell, return_counts=True)
        term, at = cell // n, cell % n
        gain = weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / max(avgdl, 1.0)))
        present, first = np.unique(term, return_index=True)
        asking = [(pairs[1, start[t] : start[t + 1]], times[start[t] : start[t + 1]]) for t in present]

        def scores(ids: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
            total = np.zeros((len(ids), n))
            add_gains(total, ids, asking, first, at, gain)
            return total if rows is None else total[:, rows]

        return scores

    return prepare


def bm25_topk(
    chunks: DataFrame,
    terms: DataFrame,
    n_avgdl: tuple[int, float],
    queries: DataFrame,
    k: int = fv.TOP_K,
    filters: dict[str, str] | None = None,
    query_filter: str | None = None,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
    one_block: bool = False,
) -> DataFrame:
    """The k best chunks of every query with a positive score.

    ``chunks``: doc_pos, piece, tokens and filter columns.  ``queries``: qid, variant,
    tokens, and with ``query_filter`` a nullable column of that name.  A repeated query
    token counts repeatedly; idf and the mean length stay those of the whole corpus
    under any filter.  Only the statistics of the block's own terms are collected.
    """
    corpus = apply_filters(chunks, filters)
    queries = queries.select("qid", "variant", "tokens", *([query_filter] if query_filter else []))

    def search(block: DataFrame) -> DataFrame:
        asked = block.toArrow()
        used = unnest(block, F.col("tokens"), "term", keep=()).distinct()
        idf = terms.select("term", "idf").join(F.broadcast(used), "term", "left_semi").toArrow()
        wanted = asked.column(query_filter).to_pylist() if query_filter else None
        kernel = _bm25_kernel(asked, idf, n_avgdl[1], k1, b)
        return local_topk(
            corpus, "tokens", query_keys(asked), wanted, query_filter, kernel, k, positive=True
        )

    local = search(queries) if one_block else per_block(queries, search, weight="tokens")
    return final_topk(local, k)
