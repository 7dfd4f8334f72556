"""Token ids of whole documents in files, Simple-8b coded.

A set of files is a folder with two Parquet tables. ``segments`` holds the ids: a row is a segment,
which is the run of whole documents whose words come to about :data:`SEGMENT_WORDS`, with

- ``part``, ``segment``: the range of document ids that it belongs to, and its number therein;
- ``first``: how many ids of the part come before it; ``n_ids``: how many it holds;
- ``doc_ids``, ``doc_tokens``: its documents in order, and the ids of each;
- ``block_words``: for each block of 1,024 ids where its words begin, and at the end where they end;
- ``words``: the 64-bit words of :mod:`simple8b`, least byte first.

A document begins a block, so a segment's documents and any stretch within them are decoded alone.
``parts`` holds ``part, base, n_ids``: how many ids come before a part. Documents ascend by id over
parts, segments and rows, so ``base + first`` and what stands before in the segment is a document's
place in the whole stream of ids.

Texts are dealt to parts by ranges of their id and of a hash of the text, so that an id that many rows
have is split too; encoding follows the shuffle, so that nothing is encoded twice.

Defined results: a null or empty text is the end id alone; a null id comes first; of equal ids the
order is that of the texts' hashes and then of the texts, and each of several equal rows is written; a
text of any length is encoded whole and lies in one segment; an empty table gives tables without rows;
only the id and the text column are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import simple8b
from sparkloom.llm.common import SLICE_CHARS, map_arrow
from sparkloom.llm.packing import CACHE_CHARS, CACHE_WORDS, WordTokenizer

#: Words of a segment, about: two megabytes.
SEGMENT_WORDS = 1 << 18
#: Texts encoded together.
SLICE_ROWS = 2048

_LATIN = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF)))
#: Letters of which each has one lower case, then marks that the tokenizer parts from them.
_BASE = re.compile(f"([{_LATIN}]+)([.,;:!?#]*)").fullmatch


class BatchTokenizer(WordTokenizer):
    """The word tokenizer over Arrow arrays: distinct words are found, looked up and put in place as arrays."""

    @classmethod
    @functools.lru_cache(maxsize=2)
    def of(cls, path: str) -> BatchTokenizer:
        return cls(path)

    def _pieces(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct words. Of a word of letters and marks only the letters in lower case are sent to the tokenizer."""
        kept = self.kept
        made: dict[str, bytes] = {}
        split = {word: (m[1].lower(), m[2]) for word in distinct if word not in kept and (m := _BASE(word))}
        asked = {word for word in distinct if word not in split}.union(*split.values()) - kept.keys()
        kept.update(self._encode_words(list(asked)))
        for word, (base, marks) in split.items():
            made[word] = kept[base] + kept[marks] if marks else kept[base]
        pieces = [kept[word] if word in kept else made[word] for word in distinct]
        full = len(kept) > CACHE_WORDS
        for word in asked if full else [word for word in asked if len(word) > CACHE_CHARS]:
            del kept[word]
        if len(kept) + len(made) < CACHE_WORDS // 2:
            kept.update((word, ids) for word, ids in made.items() if len(word) <= CACHE_CHARS)
        return pieces

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has; null texts have none."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        pieces = self._pieces(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint32)
        order = words.indices.to_numpy()
        lengths = sizes[order]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat((np.cumsum(sizes) - sizes)[order] - ends[:-1], lengths) + np.arange(ends[-1])
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return flat[places], np.diff(bounds)


def release() -> None:
    BatchTokenizer.of.cache_clear()


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice's texts stay small; a longer text makes a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= SLICE_ROWS or size + n > 2 * SLICE_CHARS):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of documents in a row, ``end_id`` after each."""
    out = np.full(len(ids) + len(lengths), end_id, dtype=np.uint64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, lengths + 1


class _Segments:
    """Gathers coded documents of one part into rows."""

    def __init__(self, schema: pa.Schema, part: int):
        self.schema, self.part, self.number, self.first = schema, part, 0, 0
        self.clear()

    def clear(self) -> None:
        self.doc_ids, self.tokens, self.words, self.blocks, self.size = [], [], [], [], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        block_ids, blocks = simple8b.block_lengths(lengths)
        words, per_block = simple8b.encode(ids, block_ids)
        block_ends = np.cumsum(blocks)
        word_ends = np.concatenate([[0], np.cumsum(per_block)])
        doc_words = word_ends[block_ends]
        start = 0
        while start < len(lengths):
            done = int(doc_words[start - 1]) if start else 0
            # The documents that still fit, at least one.
            stop = max(int(np.searchsorted(doc_words, done + SEGMENT_WORDS - self.size, side="right")), start + (not self.doc_ids))
            if stop > start:
                self.doc_ids.append(doc_ids.slice(start, stop - start))
                self.tokens.append(lengths[start:stop])
                self.words.append(words[done : int(doc_words[stop - 1])])
                self.blocks.append(per_block[int(block_ends[start - 1]) if start else 0 : int(block_ends[stop - 1])])
                self.size += int(doc_words[stop - 1]) - done
                start = stop
            if start < len(lengths) or self.size >= SEGMENT_WORDS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.doc_ids:
            return
        tokens = np.concatenate(self.tokens)
        total = int(tokens.sum())
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.blocks))])
        row = [self.part, self.number, self.first, total]
        columns = [pa.array([x], f.type) for x, f in zip(row, self.schema, strict=False)]
        ids = pa.concat_arrays(self.doc_ids)
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
        columns += [pa.array([x], f.type) for x, f in zip((tokens, offsets.astype(np.int32)), (self.schema.field(5), self.schema.field(6)), strict=True)]
        columns.append(pa.array([np.concatenate(self.words).astype("<u8").tobytes()], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, self.schema.names)
        self.number += 1
        self.first += total
        self.clear()


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, in ascending order of ids, into a new folder at ``path``."""
    kind = df.schema[id_col].dataType.simpleString()
    fields = f"part int, segment int, first long, n_ids long, doc_ids array<{kind}>, doc_tokens array<long>, block_words array<int>, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = BatchTokenizer.of(tokenizer_path)
        segments = None
        for part in _slices(batches, 1):
            if segments is None:
                names = ["part", "segment", "first", "n_ids", "doc_ids", "doc_tokens", "block_words", "words"]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(part.schema.field(0).type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                segments = _Segments(pa.schema(list(zip(names, kinds, strict=True))), TaskContext.get().partitionId())
            ids, lengths = _with_end(*tokenizer.encode_array(part.column(1)), end_id)
            yield from segments.add(part.column(0), ids, lengths)
        if segments is not None:
            yield from segments.flush()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    map_arrow(ordered, run, fields, "token_files", release).write.option("compression", "none").parquet(f"{path}/segments")
    parts = df.sparkSession.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    parts.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: how many ids of the whole stream come before each."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")  # a row for each part
    return spark.read.parquet(f"{path}/segments").join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("first"))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """One row for each document of the files: ``id, start, n_tokens, ids_crc32`` and its ``token_ids``.

    ``ids_crc32`` is that of the ids as unsigned 32-bit integers, least byte first.
    """
    placed = _placed(spark, path).select("doc_ids", "start", "doc_tokens", "words")
    kind = placed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, tokens = batch.column(0)[k].values, batch.column(2)[k].values.to_numpy()
                ids = simple8b.decode(np.frombuffer(batch.column(3)[k].as_buffer(), dtype="<u8"))
                ends = np.cumsum(tokens)
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
                checks = [zlib.crc32(raw[a:b]) for a, b in zip([0, *bounds], bounds, strict=False)]
                columns = [doc_ids, pa.array(batch.column(1)[k].as_py() + ends - tokens, pa.int64()), pa.array(tokens, pa.int64()), pa.array(checks, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    return map_arrow(placed, run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * keep_ids, "token_files", release)


def read_stretch(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """``start, token_ids``: the ids at places ``start`` to ``start + length`` of the stream, a row for each segment that they lie in.

    Only those segments are read and only the blocks that the stretch meets are decoded.
    """
    if length < 0 or start < 0:
        raise ValueError("a stretch begins at 0 or later and isn't of negative length")
    placed = _placed(spark, path).where((F.col("start") < start + length) & (F.col("start") + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                begin, tokens, offsets = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy()
                block_ids, _ = simple8b.block_lengths(tokens)
                ends = begin + np.cumsum(block_ids)
                low, high = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends - block_ids, start + length))
                words = np.frombuffer(batch.column(3)[k].as_buffer(), dtype="<u8")[offsets[low] : offsets[high]]
                origin = int(ends[low] - block_ids[low])
                found = simple8b.decode(words)[max(start - origin, 0) : start + length - origin]
                yield pa.RecordBatch.from_arrays([pa.array([max(start, origin)], pa.int64()), pa.array([found.astype(np.int64)], pa.list_(pa.int64()))], ["start", "token_ids"])

    return map_arrow(placed.select("start", "doc_tokens", "block_words", "words"), run, "start long, token_ids array<long>", "token_files", release)
