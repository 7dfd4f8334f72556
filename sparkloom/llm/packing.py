"""Packing by power-of-two decomposition.

A document of ``n`` tokens is cut into as many pieces of the longest allowed length as fit and then
into one piece for each set bit of the rest, the longest first. Every piece is a sequence of its own,
so no sequence crosses documents, and as each length is a power of two nothing is padded. Sequences
of one length form a bucket: their ids are one range, and :func:`write_buckets` writes a folder for
each length, from which batches of equal shape are read.

Defined results: a null or empty text is the one end token; texts of any length are packed whole; each
of several equal rows is packed; an empty table gives an empty table; only the id and the text column
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_arrow, text_slices

#: Encodings of words kept by each worker process, of words up to a length.
CACHE_WORDS, CACHE_CHARS = 750_000, 48
#: Texts encoded together: the more, the fewer words are encoded twice.
SLICE_ROWS = 1024
#: Words sent to the tokenizer in one text.
TOGETHER = 100
#: Sequence ids hold the length's logarithm above this bit, below it the partition and the row.
BUCKET_BIT = 54

_LATIN = re.compile("[A-Za-z]+|[A-Za-z%s-%s%s-%s%s-%s]+" % tuple(map(chr, (0xC0, 0xD6, 0xD8, 0xF6, 0xF8, 0xFF)))).fullmatch


def decompose(n: int, longest: int) -> list[int]:
    """The lengths of the pieces of ``n`` tokens: powers of two, none above ``longest``, descending."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class WordTokenizer:
    """A tokenizer that drops white space, applied word by word; distinct words are encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    @classmethod
    @functools.lru_cache(maxsize=2)
    def load(cls, path: str) -> WordTokenizer:
        return cls(path)

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """A plain word is one pre-token and so ends at its only closing token; others are sent one by one."""
        plain = [word for word in words if _LATIN(word)]
        rest = [word for word in words if not _LATIN(word)]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        encoded = itertools.chain.from_iterable(self.tokenizer.encode_batch_fast([" ".join(g) for g in groups[i : i + 100]], add_special_tokens=False) for i in range(0, len(groups), 100))
        for group, found in zip(groups, encoded, strict=True):
            ids = np.array(found.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):
                rest += group
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(group, (ends * 4).tolist(), strict=True):
                yield word, raw[start:end]
                start = end
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                yield word, np.array(found.ids, dtype=np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as unsigned 32-bit integers."""
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        kept = self.kept
        new = set().union(*cut) - kept.keys()
        kept.update(self._encode_words(list(new)))
        encoded = [b"".join(map(kept.__getitem__, words)) for words in cut]
        full = len(kept) > CACHE_WORDS
        for word in new if full else [word for word in new if len(word) > CACHE_CHARS]:
            del kept[word]
        return encoded


def release() -> None:
    WordTokenizer.load.cache_clear()


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int, longest: int = 4096, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where it lies in its document, its ids (or only their checksum), its sequence."""
    decompose(0, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(tokenizer_path)
        end = np.uint32(end_id).tobytes()
        for part, texts in text_slices(batches, 1, SLICE_ROWS):
            rows: list[list] = [[], [], [], [], [], []]
            for k, ids in enumerate(tokenizer.encode(texts)):
                ids += end
                total, start = len(ids) // 4, 0
                for length in decompose(total, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (k, start, length, zlib.crc32(piece), total, piece), strict=True):
                        column.append(value)
                    start += length
            columns = [part.column(0).take(pa.array(rows[0], pa.int32())), *(pa.array(x, pa.int64()) for x in rows[1:5])]
            if keep_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(rows[2])]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(rows[5]), dtype=np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids_crc32", "doc_tokens", "token_ids"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", token_ids array<int>" * keep_ids
    pieces = map_arrow(df.select(id_col, text_col), run, fields, "packing", release)
    bucket = F.log2("length").cast("long")
    return pieces.withColumns({"sequence_id": F.shiftleft(bucket, BUCKET_BIT) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences as Parquet, one folder for each length."""
    pieces.write.partitionBy("length").parquet(path)
