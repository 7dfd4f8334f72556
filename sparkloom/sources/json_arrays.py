"""Records of large JSON arrays, a file read by as many tasks as it has splits.

Spark reads a JSON document that spans lines as one row in one task. Here a file is read as text cut after
each ``}`` instead, which Spark splits by bytes like any text. Whether such a piece begins inside a string,
and how deep, follows from what comes before it, so the file is read twice:

1. each split sums up its quotes, and its brackets for either beginning, inside a string or not; sums
   over the splits before it then tell how each begins;
2. with that, each split cuts its text where a record of the array ends and writes what it found into
   the workspace. A record that crosses splits is put together from its pieces, and a record whose array was
   opened in an earlier split learns the array's name from there.

A backslash never stands right before a brace in JSON (``\\}`` is no escape), so a piece never begins
within an escape.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.workspace import workspace

#: Most splits whose beginnings are broadcast (a few tens of bytes each); beyond, pieces are sorted anew.
BROADCAST_SPLITS = 500_000

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.DOTALL)
_KINDS = np.zeros(256, np.int8)
_KINDS[[ord(c) for c in '{[}]"']] = 1, 1, -1, -1, 2


CHUNK = "file string, split long, seq long, kind string, depth long, name string, text string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split(" ") for f in CHUNK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def brackets(text: str) -> tuple[int, int, int]:
    """How many quotes a piece has, and by how much it goes deeper if it begins outside a string, or inside."""
    parts = (_ESCAPE.sub("", text) if "\\" in text else text).split('"')
    depths = ["".join(parts[k::2]) for k in (0, 1)]
    return len(parts) - 1, *(s.count("{") + s.count("[") - s.count("}") - s.count("]") for s in depths)


def record_in(chunk: str, depth: int, level: int) -> tuple[str | None, str] | None:
    """``name, record`` of the one object that stands in an array of depth ``level`` in a chunk that begins at ``depth``.

    The name is that of the array if it begins in the chunk, else None. None if there is no such object.
    """
    if depth == level:
        rest = chunk.lstrip(" \t\r\n")
        if rest.startswith(","):
            rest = rest[1:].lstrip(" \t\r\n")
            if rest.startswith("{"):
                return None, rest
    name = key = before = None
    for token in _TOKEN.finditer(chunk):
        c = token.group()
        if c == "{" and depth == level and before in ("[", ","):
            return name, chunk[token.start() :]
        if c in "{[":
            depth += 1
            if c == "[" and depth == level:
                name = key if level > 1 else ""
        elif c in "}]":
            depth -= 1
        elif c[0] == '"' and depth == level - 1:
            key = json.loads(c)
        before = c
    return None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")


@dataclass(frozen=True)
class _Marks:
    """What Arrow batches of pieces hold: their text, each with the brace that ended it, and where in it quotes and brackets stand.

    ``step`` is 1 and -1 for brackets and 0 for quotes; ``quotes`` counts quotes up to each mark. Escaped characters are no marks.
    """

    text: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    step: np.ndarray
    quotes: np.ndarray


def _marks(pieces: pa.Array) -> _Marks:
    flat = pieces.cast(pa.large_binary())
    bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    ends = bounds[1:] - bounds[0] + np.arange(1, len(flat) + 1)
    text, own = np.full(ends[-1], ord("}"), np.uint8), np.ones(ends[-1], bool)
    own[ends - 1] = False
    text[own] = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    kinds = _KINDS[text]
    slashes = np.flatnonzero(text == ord("\\"))
    if len(slashes):  # of slashes in a row, every other one escapes what follows it
        begins = np.diff(slashes, prepend=-2) != 1
        place = np.arange(len(slashes))
        escaping = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        escaped = slashes[escaping] + 1
        kinds[escaped[text[escaped] != ord("}")]] = 0
    at = np.flatnonzero(kinds)
    quote = kinds[at] == 2
    return _Marks(text, ends, at, np.where(quote, 0, kinds[at]), np.cumsum(quote))


def _runs(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Stretches of rows that are equal in all columns: first row and the one after the last."""
    n = len(columns[0])
    differ = np.zeros(n - 1, bool)
    for c in columns:
        differ |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), n]
    return pairwise(cuts)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, _Marks, slice, int, int]]:
    """A task's batches split by split, as they come: ``(file, split, ...)``, the batch's marks, which of them, and from where to where the text goes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = _marks(batch.columns[-1])
        for first, end in _runs(batch.columns[:2]):
            begin, stop = int(marks.ends[first - 1]) if first else 0, int(marks.ends[end - 1])
            low, high = np.searchsorted(marks.at, (begin, stop))
            yield tuple(c[first].as_py() for c in batch.columns[:-1]), marks, slice(low, high), begin, stop


def _quotes(marks: _Marks, which: slice) -> np.ndarray:
    return marks.quotes[which] - (marks.quotes[which.start - 1] if which.start else 0)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, split), found in groupby(_by_split(batches), key=lambda x: x[0]):
        quotes, deeper = 0, [0, 0]
        for _, marks, which, _, _ in found:
            own = quotes + _quotes(marks, which)
            for begin in (0, 1):
                deeper[begin] += int(marks.step[which][(begin + own) % 2 == 0].sum(dtype=np.int64))
            quotes = int(own[-1])
        yield pa.RecordBatch.from_pylist([{"file": file, "split": split, "quotes": quotes, "deeper_out": deeper[0], "deeper_in": deeper[1]}])


def _cut(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of each split: its head up to the first end of a record, whole ones, and the tail that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split, inside, depth), found in groupby(_by_split(batches), key=lambda x: x[0]):
            out: list[tuple] = []
            held: list[bytes] = []
            begin, seq, kind, name = depth, 0, "head", None
            for _, marks, which, start, stop in found:
                at, within = marks.at[which], (inside + _quotes(marks, which)) % 2
                depths = depth + np.cumsum(np.where(within == 0, marks.step[which], 0), dtype=np.int64)
                # Only the brace that ends a piece is one.
                ended = (marks.text[at] == ord("}")) & (within == 0) & (depths <= level)
                for end, deep in zip((at[ended] + 1).tolist(), depths[ended].tolist(), strict=True):
                    held.append(marks.text[start:end].tobytes())
                    chunk = b"".join(held).decode()
                    if kind == "head":
                        out.append((file, split, -1, "head", begin, None, chunk))
                    elif hit := record_in(chunk, begin, level):
                        name = hit[0] if hit[0] is not None else name
                        out.append((file, split, seq, "whole", begin, name, hit[1]))
                    held, begin, start, seq, kind = [], deep, end, seq + 1, "tail"
                    if len(out) >= 1000:
                        yield _rows(out)
                        out = []
                if start < stop:
                    held.append(marks.text[start:stop].tobytes())
                inside, depth = int(within[-1]), int(depths[-1])
            out.append((file, split, seq, "middle" if kind == "head" else "tail", begin, None, b"".join(held).decode()))
            yield _rows(out)

    return run


def _beginnings(pieces: DataFrame) -> DataFrame:
    """``file, split, inside, depth``: whether each split begins inside a string, and how deep."""
    sums = pieces.select("file", "split", "value").mapInArrow(_summed, "file string, split long, quotes long, deeper_out long, deeper_in long")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    began = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    deeper = F.when(F.col("inside") == 0, F.col("deeper_out")).otherwise(F.col("deeper_in"))
    return began.select("file", "split", "inside", F.coalesce(F.sum(deeper).over(earlier), F.lit(0)).alias("depth"))


def read_array(spark: SparkSession, path: str, array: str | None, schema: str) -> DataFrame:
    """One row for each object in an array of JSON documents: the top-level array, or the array that an object holds as ``array``.

    ``path`` may be a file, a folder or a pattern; a file may hold one document or several after one another.
    Elements that aren't objects are left out, fields that ``schema`` lacks too, and missing ones are NULL.
    Every task holds one record at a time.
    """
    level = 1 if array is None else 2
    pieces = _pieces(spark, path)
    # Beginnings are few: a split is of spark.sql.files.maxPartitionBytes.
    begins = _written(_beginnings(pieces), "splits")
    few = begins.count() <= BROADCAST_SPLITS
    if few:
        placed = pieces.join(F.broadcast(begins), ["file", "split"])  # keeps the order of the pieces
    else:
        placed = pieces.join(begins, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "row")
    chunks = _written(placed.select("file", "split", "inside", "depth", "value").mapInArrow(_cut(level), CHUNK), "chunks")
    # A record that crosses splits: the tail of one, any that lie in it whole, and the head of the last.
    ended = F.count_if(F.col("kind") == "head").over(Window.partitionBy("file").orderBy("split", "seq").rowsBetween(Window.unboundedPreceding, -1))
    crossing = chunks.where("kind <> 'whole'").withColumn("at", ended)
    parts = crossing.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("split", "seq", "depth", "text"))).alias("p"), F.max("split").alias("split"))
    joined = parts.select("file", "split", F.lit(-1).cast("long").alias("seq"), F.col("p")[0]["depth"].alias("depth"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, split, seq, "whole", depth, *hit) for file, split, seq, depth, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (hit := record_in(text, depth, level))]
            if rows:
                yield _rows(rows)

    stitched = joined.mapInArrow(found, CHUNK)
    records = chunks.where("kind = 'whole'").unionByName(stitched).select("file", "split", "seq", "name", "text")
    if array is not None:
        # An array's name stands where it begins; until its split names another, records are of the last before.
        named = records.where("name IS NOT NULL").groupBy("file", "split").agg(F.max_by("name", "seq").alias("last"), F.min_by("name", "seq").alias("first"), F.min("seq").alias("least"))
        splits = begins.select("file", "split").join(named, ["file", "split"], "left")
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        inherited = splits.select("file", "split", F.last("last", ignorenulls=True).over(earlier).alias("before"), F.when(F.col("least") == -1, F.col("first")).alias("crossed"))
        own = F.coalesce("name", F.when(F.col("seq") >= 0, F.col("crossed")), "before")
        # A row for each split, like the beginnings; the records themselves stay where they are.
        records = records.join(F.broadcast(inherited) if few else inherited, ["file", "split"]).where(own == array)
    return records.select(F.from_json("text", schema).alias("r")).select("r.*")
