"""Shared helpers: durable intermediate tables and Arrow row loops."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside one Arrow batch, so that Python never holds more decoded rows.
SLICE_ROWS = 512
#: Characters of text handled together inside one Arrow batch.
SLICE_CHARS = 4_000_000

_LOCAL_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables (``spark.checkpoint.dir``).

    Only where the session names none (a local session, as in tests) is a temporary folder used.
    """
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _LOCAL_DIR


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete what :func:`durable` writes within, at the end: for work whose result has been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for made in _scratch.pop():
            discard(made)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Lineage ends here: a lost executor costs a re-read of Parquet files, never a recomputation, and
    values such as generated row ids stay what they were.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.sparkloom_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`durable` that no later plan reads."""
    path = getattr(df, "sparkloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that a slice's texts stay small; null texts come as empty strings.

    A single text larger than the bound makes a slice of its own.
    """
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or size + (n or 0) > SLICE_CHARS):
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in part.column(column).to_pylist()]
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, [x or "" for x in part.column(column).to_pylist()]


class Cover:
    """What a list of ``(kind, start, end)`` covers, as disjoint stretches; a search tells what meets it."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


_held: tuple[str, Callable[[], object]] | None = None


def hold(owner: str, release: Callable[[], object]) -> None:
    """Say that this Python worker keeps a cache of ``owner``; what another operator left in it goes.

    Workers outlive stages, so without this each stage of a pipeline would add its cache to the last's.
    """
    global _held
    if _held is not None and _held[0] != owner:
        _held[1]()
        trim()
    _held = owner, release


def trim() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = "", release: Callable[[], object] = bool) -> DataFrame:
    """``mapInArrow`` for a function whose worker may keep a cache; ``release`` empties it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(owner, release)
        yield from fn(batches)
        trim()

    if any("." in c or "`" in c for c in df.columns):  # names that mapInArrow can't take; functions go by position
        df = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return df.mapInArrow(run, schema)


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fields_of(df: DataFrame) -> str:
    """The columns of ``df`` as a schema."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def crc_bucket(id_column: str | Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; null ids count as the empty text."""
    ids = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % modulus
