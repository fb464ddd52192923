"""Vector tables: a replaceable Parquet store and a collection with upserts."""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trovelake import fixed_values as fv
from trovelake.operators.vector_search import vector_topk
from trovelake.runtime import scratch_dir

DEFAULT_COLLECTION = "passages"
_FOLDER = re.compile(r"/version=(\d+)/writer=([^/]+)/batch=(-?\d+)/")


def write_vectors(vectors: DataFrame, path: str) -> str:
    """Replace the store at ``path`` with chunk_id, metadata, embedding and norm rows.

    Texts, tokens and mostly empty vectors take a third less room in zstd than in Spark's default.
    """
    vectors.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _relative(name: str) -> str:
    return name[name.index("/version=") :]


def _position(file: str = "file", row: str = "row") -> list[Column]:
    """The data file of a row, from its version folder on, and the row's position in it."""
    return [F.regexp_extract("_metadata.file_path", "(/version=.*)", 1).alias(file), F.col("_metadata.row_index").alias(row)]


def _pages(lost: DataFrame) -> DataFrame:
    """Bitmaps of positions (file, row): words of 64 rows, in pages."""
    page, place = F.floor(F.col("row") / PAGE_ROWS).alias("page"), F.col("row") % PAGE_ROWS
    bits = lost.groupBy("file", page, F.floor(place / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(row % {PAGE_ROWS} % 64 AS INT))")).alias("bits"))
    words = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    return bits.groupBy("file", "page").agg(words.alias("bits")).select(
        "file", "page",
        F.transform(F.sequence(F.lit(0), F.lit(PAGE_ROWS // 64 - 1)), lambda w: F.coalesce(F.col("bits")[w], F.lit(0))).alias("words"))


def last_writer_wins(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """Exactly one row per key (null is a key too): the newest, nulls oldest.

    Rows of one version are ordered by a hash of their other columns, so the choice does not
    depend on partitioning.  The aggregate combines in each task, so a key with very many
    versions sends one row per task.
    """
    others = [f.name for f in rows.schema.fields if f.name != key]
    hashed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = F.struct(*version, F.xxhash64(*hashed).alias("_tie"))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_newest"))
    return newest.select(key, "_newest.*").select(*rows.columns)


#: Rows of a data file whose deletes one bitmap holds, and bitmaps (of 8 KB) that are broadcast together.
PAGE_ROWS = 65536
BROADCAST_PAGES = 4096
_PAGES = "file string, page long, words array<long>"


class VectorCollection:
    """A named collection keyed by chunk_id, created on first use.

    An upsert adds one folder ``version=N/writer=W/batch=B`` above all present versions, so
    its cost follows the batch and not the collection, and it never touches what another
    writer made.  A batch that its writer repeats after a failure replaces its own folder
    and keeps its version.  Readers see the newest row of every chunk_id.

    Reading merges without moving rows: a batch also writes, for each data file of older
    batches, bitmaps of the row positions that it replaces (only ids and positions are
    joined for it), and a reader drops these positions while it scans the files.  A batch
    notes the files that it looked at; where a concurrent or repeated batch has changed
    them since, the reader works the bitmaps out itself, again from ids and positions.
    """

    def __init__(self, spark: SparkSession, directory: str, name: str = DEFAULT_COLLECTION):
        self.spark = spark
        self.path = f"{directory.rstrip('/')}/{name}"

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _files(self) -> dict[tuple[int, str, int], list[str]]:
        """The data files of each batch (version, writer, batch); names only, runs no job."""
        stored, found = self._stored(), {}
        for name in stored.inputFiles() if stored is not None else []:
            if m := _FOLDER.search(name):
                found.setdefault((int(m[1]), unquote(unquote(m[2])), int(m[3])), []).append(name)
        return {batch: sorted(names) for batch, names in sorted(found.items())}

    def batches(self) -> dict[tuple[str, int], int]:
        """Version of each stored (writer, batch), from the names of the files; runs no job."""
        return {(writer, batch): version for version, writer, batch in self._files()}

    def versions(self) -> list[int]:
        return sorted(set(self.batches().values()))

    def upsert(self, rows: DataFrame, writer: str | None = None, batch: int = 0) -> int:
        """Insert or replace rows by chunk_id; the last row of a repeated id wins.

        ``rows``: chunk_id, doc_pos, piece, embedding and any metadata or text columns.
        ``writer`` and ``batch`` name a batch that may be repeated; without a writer every
        call is a batch of its own.
        """
        writer = writer or uuid.uuid4().hex
        stored = self.batches()
        version = stored.get((writer, batch), max(stored.values(), default=-1) + 1)
        unique = last_writer_wins(rows, "chunk_id", "doc_pos", "piece")
        folder = f"version={version}/writer={quote(writer, safe='')}/batch={batch}"  # names of files are quoted once more
        unique.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._mark(self._files(), (version, writer, batch))
        return version

    def _seen(self, files: dict, batch: tuple) -> str:
        """Digest of the files of a batch and of all older ones."""
        names = [n for b in files if b <= batch for n in files[b]]
        return hashlib.sha256("\n".join(_relative(n) for n in names).encode()).hexdigest()

    def _note(self, batch: tuple) -> str:
        return f"{self.path}/_deletes/{batch[0]}-{hashlib.sha256(batch[1].encode()).hexdigest()[:24]}-{batch[2]}"

    def _mark(self, files: dict, batch: tuple) -> None:
        """Write the positions in older files that this batch replaces, named by what it looked at."""
        older = [n for b in files if b < batch for n in files[b]]
        if batch not in files or not older:
            return
        new = self._read(files[batch]).select(F.col("chunk_id").alias("new_id"))
        old = self._read(older).select("chunk_id", *_position())
        lost = old.join(new, F.col("chunk_id").eqNullSafe(F.col("new_id")), "left_semi")
        _pages(lost).write.mode("overwrite").parquet(f"{self._note(batch)}/{self._seen(files, batch)}")

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*map(unquote, files))

    def _deletes(self, files: dict) -> DataFrame:
        """Bitmaps of the replaced positions of all files."""
        notes = []
        for batch in list(files)[1:]:
            try:
                notes.append(self.spark.read.schema(_PAGES).parquet(f"{self._note(batch)}/{self._seen(files, batch)}"))
            except AnalysisException:
                newest = Window.partitionBy("chunk_id").orderBy(F.desc("version"), F.desc("writer"), F.desc("batch"))
                every = self._read([n for names in files.values() for n in names]).select(
                    "chunk_id", "version", F.col("writer").cast("string").alias("writer"), "batch", *_position())
                lost = every.withColumn("n", F.row_number().over(newest)).where("n > 1")
                return _pages(lost)
        either = F.reduce(
            F.collect_list("words"), F.array().cast("array<long>"),
            lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseOR(F.coalesce(y, F.lit(0)))))
        return reduce(DataFrame.unionByName, notes).groupBy("file", "page").agg(either.alias("words"))

    def rows(self) -> DataFrame:
        """Current rows, scanned file by file without a shuffle of rows.

        The bitmaps are counted: few of them are one broadcast, more are dealt with their files
        to several, each with a scan of its own files.
        """
        files = self._files()
        if not files:
            raise ValueError(f"collection is empty: {self.path}")
        names = [n for batch in files.values() for n in batch]
        if len(files) == 1:
            return self._read(names).drop("version", "writer", "batch")
        path = scratch_dir(self.spark)
        self._deletes(files).write.parquet(path)
        deletes = self.spark.read.schema(_PAGES).parquet(path)
        size = {r.file: r.n for r in deletes.groupBy("file").agg(F.count("*").alias("n")).collect()}
        groups: list[list[str]] = [[]]
        held = 0
        for name in names:
            own = size.get(_relative(name), 0)
            if groups[-1] and held + own > BROADCAST_PAGES:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += own
        parts = []
        for group in groups:
            known = self.spark.createDataFrame([(_relative(n),) for n in group], "file string")
            marks = F.broadcast(deletes.join(F.broadcast(known), "file").select(*(F.col(c).alias(f"_{c}") for c in ("file", "page", "words"))))
            scan = self._read(group)
            columns = [c for c in scan.columns if c not in ("version", "writer", "batch")]
            scan = scan.select(*columns, *_position("_at_file", "_at_row"))
            word = F.get("_words", F.floor(F.col("_at_row") % PAGE_ROWS / 64).cast("int"))
            bit = F.getbit(F.coalesce(word, F.lit(0)), (F.col("_at_row") % 64).cast("int"))
            here = (F.col("_at_file") == F.col("_file")) & (F.floor(F.col("_at_row") / PAGE_ROWS) == F.col("_page"))
            parts.append(scan.join(marks, here, "left").where(bit == 0).select(*columns))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def search(
        self, queries: DataFrame, k: int = fv.TOP_K, filters: dict[str, str] | None = None
    ) -> DataFrame:
        """Nearest rows by squared distance, scored 1 / (1 + distance).

        Returns qid, variant, rank, score, chunk_id and the other columns of the rows, text
        and metadata included.  Rows are told apart by chunk_id; equal scores are ordered by
        its hash.
        """
        rows = self.rows().drop("doc_pos", "piece")
        keyed = rows.withColumns(
            {"doc_pos": F.xxhash64("chunk_id"), "piece": F.xxhash64(F.lit(1), "chunk_id")}
        )
        hits = vector_topk(keyed, queries, k, filters, metric="l2")
        found = keyed.drop("qid", "variant", "rank", "score").join(hits, ["doc_pos", "piece"])
        rest = [c for c in rows.columns if c not in ("qid", "variant", "rank", "score", "embedding", "norm")]
        return found.select("qid", "variant", "rank", "score", *rest)

    def compact(self, directory: str) -> VectorCollection:
        """Write the current rows as the first batch of a new collection elsewhere."""
        target = VectorCollection(self.spark, directory, self.path.rsplit("/", 1)[1])
        self.rows().write.mode("overwrite").parquet(f"{target.path}/version=0/writer=compact/batch=0")
        return target
