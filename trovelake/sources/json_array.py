"""JSON arrays of objects as a source that many tasks read, and as a sink that many tasks write.

An array file has no lines to split at, and whether a bracket counts depends on all quotes
before it.  The text reader cuts the file at every ``}`` instead, in byte ranges as it cuts at
line ends.  Per record the brackets are counted twice, for a start outside and a start inside
a string; per range these counts combine to one short row.  The rows of a file, in order, give
the state in which each range begins; with it a range knows where its objects end.  Only the
pieces of objects that cross a border of ranges are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trovelake.runtime import scratch_dir

#: An object's number: the number of its range and, in these many bits, its place in the range.
PLACE_BITS = 33
#: Ranges (a short row each) that are broadcast together, or those of one file; more files take more scans.
BROADCAST_RANGES = 1 << 17


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Texts that end before a ``}``, with their range and the change of brackets and quotes in them.

    ``outside`` and ``inside`` are the changes of depth when the record begins outside or inside
    of a string, ``odd`` tells whether it has an odd number of quotes.
    """
    def depth(text):
        opened, closed = F.translate(text, "[{", ""), F.translate(text, "]}", "")
        return F.length(closed) - F.length(opened)

    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")]
    rows = spark.read.option("lineSep", "}").text(path).select(*place, "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    every = rows.withColumn("parts", parts)
    even = F.array_join(F.filter("parts", lambda p, i: i % 2 == 0), "")
    odd = F.array_join(F.filter("parts", lambda p, i: i % 2 == 1), "")
    return every.select(
        "file", "at", "value", (F.size("parts") % 2 == 0).alias("odd"),
        depth(even).cast("int").alias("outside"), depth(odd).cast("int").alias("inside"))


def _ranges(records: DataFrame) -> DataFrame:
    """The state in which each range begins: number, depth, in a string?, and the depth between objects."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            for (file, at), own in frame.groupby(["file", "at"], sort=False):
                opener, known = state.get((file, at), (own["head"].iloc[0], [(0, 0), (1, 0)]))
                ends = []
                for inside, depth in known:
                    walk = _walk(inside, depth, own["odd"].to_numpy(), own["outside"].to_numpy(), own["inside"].to_numpy())
                    ends.append((int(walk[1]), int(walk[3])))
                state[(file, at)] = opener, ends
        keys = list(state)
        flat = [[k[0] for k in keys], [k[1] for k in keys], [state[k][0] for k in keys]]
        for start in (0, 1):
            flat += [[state[k][1][start][0] for k in keys], [state[k][1][start][1] for k in keys]]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds, strict=True)], names=names)

    names = ["file", "at", "head", "state0", "depth0", "state1", "depth1"]
    head = F.regexp_extract("value", r"^[\s\x{FEFF}]*(\S)", 1).alias("head")
    ends = records.select("file", "at", head, "odd", "outside", "inside").mapInArrow(
        combine, "file string, at long, head string, state0 long, depth0 long, state1 long, depth1 long")

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        inside, depth, states, depths = 0, 0, [], []
        for row in frame.itertuples():
            states.append(inside)
            depths.append(depth)
            inside, depth = (row.state1, depth + row.depth1) if inside else (row.state0, depth + row.depth0)
        opener = frame["head"].iloc[0]
        # The end of the file counts as one more bracket, see _walk; there is no record behind a last "}".
        if opener not in ("[", "{") or inside or (depth != -1 and (opener, depth) != ("{", 0)):
            raise ValueError(f"not a whole JSON array of objects: {frame['file'].iloc[0]}")
        return pd.DataFrame({"file": frame["file"], "at": frame["at"], "inside": states, "depth": depths, "base": int(opener == "[")})

    known = ends.groupBy("file").applyInPandas(begin, "file string, at long, inside int, depth long, base int")
    number = F.row_number().over(Window.orderBy("file", "at")) - 1  # one row for each range, not for each object
    return known.withColumn("number", number.cast("long"))


def _walk(inside: int, depth: int, odd: np.ndarray, outside: np.ndarray, within: np.ndarray) -> tuple:
    """State and depth after each record and its ``}``: (states, last state, depths, last depth).

    The last record of a file has no ``}`` behind it but is counted as if it had.
    """
    flips = np.cumsum(odd)
    after = (inside + flips) % 2
    before = np.r_[inside, after[:-1]]
    depths = depth + np.cumsum(np.where(before == 1, within, outside) - (after == 0))
    return after, after[-1], depths, depths[-1]


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, number: str = "doc_pos") -> DataFrame:
    """The objects of JSON array files, with column ``number`` in their order (files by name).

    Equals the multi-line JSON reader in FAILFAST mode on files that hold one array of objects
    or one object: anything else between objects, or a file that ends early, is an error.
    """
    records = _records(spark, path)
    folder = scratch_dir(spark)
    _ranges(records).write.parquet(folder)
    ranges = spark.read.parquet(folder)

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, state, depth, held, place, ended = None, 0, 0, [], 0, False
        out: list[tuple] = []

        def close():
            if range_ is not None and held:
                out.append((*range_[:2], place + 1, "tail" if ended else "whole", "".join(held)))

        for batch in batches:
            frame = batch.to_pandas()
            for key, own in frame.groupby(["file", "number"], sort=False):
                if key != range_:
                    close()
                    range_, held, place, ended = key, [], 0, False
                    state, depth = int(own["inside_first"].iloc[0]), int(own["depth_first"].iloc[0])
                after, state, depths, depth = _walk(state, depth, own["odd"].to_numpy(), own["outside"].to_numpy(), own["inside"].to_numpy())
                base = int(own["base"].iloc[0])
                ends = (after == 0) & (depths == base)
                for value, end in zip(own["value"], ends, strict=True):
                    held += (value, "}")
                    if end:
                        out.append((*range_, place, "object" if ended else "head", "".join(held)))
                        held, place, ended = [], place + 1, True
            yield _pieces(out)
            out = []
        close()
        yield _pieces(out)

    state = ranges.select("file", "at", "number", F.col("inside").alias("inside_first"), F.col("depth").alias("depth_first"), "base")
    parts = []
    for files in _groups(ranges):
        mine = None if files is None else F.col("file").between(*files)
        placed = (records if mine is None else records.where(mine)).join(F.broadcast(state if mine is None else state.where(mine)), ["file", "at"])
        parts.append(placed.select("file", "number", "value", "odd", "outside", "inside", "inside_first", "depth_first", "base").mapInArrow(
            objects, "file string, number long, place long, kind string, text string"))
    pieces = reduce(DataFrame.unionByName, parts)
    folder = scratch_dir(spark)
    pieces.write.partitionBy("kind").parquet(folder)
    pieces = spark.read.schema("file string, number long, place long, text string, kind string").parquet(folder)

    borders = pieces.where("kind <> 'object'")
    order = Window.partitionBy("file").orderBy("number", "place")
    heads = F.count(F.when(F.col("kind") == "head", True)).over(order) - (F.col("kind") == "head").cast("int")
    crossing = borders.withColumn("group", heads).groupBy("file", "group").agg(
        F.max(F.when(F.col("kind") == "head", F.col("number"))).alias("number"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "place", "text"))), lambda p: p["text"]), "").alias("text"),
    ).where(F.col("number").isNotNull()).select("number", F.lit(0).cast("long").alias("place"), "text")
    whole = pieces.where("kind = 'object'").select("number", "place", "text").unionByName(crossing)
    bare = F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", "")
    parsed = F.from_json(bare, schema, {"mode": "FAILFAST"})
    id_ = F.shiftleft("number", PLACE_BITS) + F.col("place")
    return whole.select(id_.alias(number), parsed.alias("object")).select(number, "object.*")


def _groups(ranges: DataFrame) -> list[tuple[str, str] | None]:
    """First and last file of groups whose ranges are broadcast together; None for all files at once."""
    files = ranges.groupBy("file").agg(F.count("*").alias("n")).orderBy("file").collect()
    groups, held = [], 0
    for r in files:
        if not groups or held + r.n > BROADCAST_RANGES:
            groups.append([r.file, r.file])
            held = 0
        groups[-1][1] = r.file
        held += r.n
    return [tuple(g) for g in groups] if len(groups) > 1 else [None]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "number", "place", "kind", "text"])


def write_json_array(rows: DataFrame, path: str) -> str:
    """Overwrite the folder ``path`` with files of one JSON array each, one file for each task.

    Spark's commit protocol publishes all files of the finished job at once; a failed task or
    job leaves nothing there.
    """

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            if batch.num_rows:
                first = [before + batch.column(0)[0].as_py(), *("," + v for v in batch.column(0)[1:].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.string())], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    rows.select(text).mapInArrow(array, "value string").write.mode("overwrite").text(path)
    return path
