"""Ranked lexical search over a tiered index: high-impact postings first, exact by proof.

The index is cut into shards of up to 4,096 documents. For each term a shard keeps its postings in
order of falling impact, in three tiers: the first eighth (at least eight), up to a half, the rest.
Beside a tier stands the residual bound: the largest impact that any posting below it has. A tier is a
column of its own, so a pass that wants the first tier reads no other.

A pass scores a block of items in a shard by the tiers it has. That gives every document a lower bound
(what was seen) and an upper one (the bound of each of the item's terms for which it wasn't). The item's
k-th best lower bound over all shards then proves those shards whose inexact documents all stay
below it: their exact documents are final. Items and shards without proof fall through to the next pass,
which reads a tier more; the last reads everything, so all results are exact.

A term is a maximal run of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. With
``N`` documents that have terms, ``L`` terms in all, ``n`` in a document and ``df`` documents with a
term, a term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and occurring ``tf`` times has the impact
``10**9 * tf div (1000 * tf + 20 * (50 + 50 * n * N div L))``; a score is the sum of weight times impact
over an item's distinct terms.

Defined results: null and empty texts have no terms, an item without terms no results; every one of
several equal rows is a document or an item of its own; equal scores go by ascending document id, null
ids last, and then by place; texts of any length are read whole; without documents or items the result
is empty; only the ids and the texts are read, so further columns of any name do no harm. Ids are
integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, map_arrow

#: Documents and bytes of text of a shard, at most (one longer text is a shard of its own).
SHARD_DOCS, SHARD_BYTES = 4096, 24_000_000
#: A term's share of a shard's postings in the first tier and in the first two, and their least number.
SHARES, LEAST = (1 / 8, 1 / 2), 8
TIERS = ("first", "second", "third")
#: Pairs of an item and a term that are scored together in one task (expected; an item is never cut).
BLOCK_PAIRS = 1 << 17

_IMPACT_BITS = 20
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
_INT64_MAX = np.iinfo(np.int64).max


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, and the number of the text that each is in.

    The bytes that separate terms are all ASCII, so texts are cut as UTF-8 bytes.
    """
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = (data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b"").translate(_TABLE)
    mapped = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw))
    cut = pc.split_pattern(mapped, " ")
    words = cut.flatten()
    used = pc.not_equal(pc.binary_length(words), 0)
    numbers = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
    return words.filter(used), numbers[used.to_numpy(zero_copy_only=False)]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """The rows of a task as tables of a shard's size."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if rows and (rows >= SHARD_DOCS or size + n > SHARD_BYTES):
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start, rows, size = [], i, 0, 0
            rows, size = rows + 1, size + n
        held.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def corpus_figures(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have terms, and how many terms they have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = terms = 0
        for table in _slices(batches, 0):
            words, numbers = terms_of(table.column(0).combine_chunks())
            used, terms = used + len(np.unique(numbers)), terms + len(words)
        yield pa.RecordBatch.from_arrays([pa.array([used], pa.int64()), pa.array([terms], pa.int64())], ["n", "l"])

    row = map_arrow(docs.select(text_col), count, "n long, l long", "tiered_search").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row.n or 0, row.l or 0


@dataclass(frozen=True)
class TieredIndex:
    """A written index: ``shard, term, n, first, first_bound, second, second_bound, third, ids``, and the corpus's figures.

    The row of a shard whose term is null holds its documents' ids instead of postings. A posting is a
    document's place in its shard above :data:`_IMPACT_BITS` bits of impact.
    """

    rows: DataFrame
    documents: int
    terms: int


def _binaries(packed: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.astype("<u4").tobytes())])


def _invert(table: pa.Table, shard: int, documents: int, terms: int) -> pa.RecordBatch:
    """A shard's rows."""
    words, numbers = terms_of(table.column(1).combine_chunks())
    coded = words.dictionary_encode()
    docs = table.num_rows
    lengths = np.bincount(numbers, minlength=docs)
    keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs + numbers, return_counts=True)
    term, doc = keys // docs, keys % docs
    impact = (10**9 * tf) // (1000 * tf + 20 * (50 + (50 * lengths * documents) // max(terms, 1))[doc])
    # Terms as they were met, each one's postings by falling impact.
    order = np.argsort((term << _IMPACT_BITS) + ((1 << _IMPACT_BITS) - 1 - impact), kind="stable")
    impact, packed = impact[order], (doc[order] << _IMPACT_BITS) | impact[order]
    n = np.bincount(term, minlength=len(coded.dictionary))
    starts = np.cumsum(n) - n
    first = np.minimum(n, np.maximum(LEAST, np.ceil(n * SHARES[0]).astype(np.int64)))
    second = np.minimum(n, np.maximum(first, np.ceil(n * SHARES[1]).astype(np.int64)))
    place = np.arange(len(packed)) - np.repeat(starts, n)
    tier = (place >= np.repeat(first, n)).astype(np.int8) + (place >= np.repeat(second, n))
    bounds = [np.where(cut < n, impact[np.minimum(starts + cut, len(impact) - 1)], 0) if len(n) else n for cut in (first, second)]
    columns = [
        pa.array(np.full(len(n), shard)), coded.dictionary.cast(pa.string()), pa.array(n, pa.int64()), _binaries(packed[tier == 0], first), pa.array(bounds[0], pa.int64()),
        _binaries(packed[tier == 1], second - first), pa.array(bounds[1], pa.int64()), _binaries(packed[tier == 2], n - second), pa.nulls(len(n), pa.list_(pa.int64())),
    ]
    head = [pa.array([x], c.type) for x, c in zip((shard, None, docs, None, None, None, None, None, table.column(0).to_pylist()), columns, strict=True)]
    names = ["shard", "term", "n", "first", "first_bound", "second", "second_bound", "third", "ids"]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([h, c]) for h, c in zip(head, columns, strict=True)], names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TieredIndex:
    """Index every document: one pass counts, one inverts shard by shard; nothing is shuffled."""
    documents, terms = corpus_figures(docs, text_col)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, table in enumerate(_slices(batches, 1)):
            rows = _invert(table, base + number, documents, terms)
            for start in range(0, rows.num_rows, 20_000):
                yield rows.slice(start, 20_000)

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fields = "shard long, term string, n long, first binary, first_bound long, second binary, second_bound long, third binary, ids array<long>"
    return TieredIndex(durable(map_arrow(kept, invert, fields, "tiered_search"), "tiers"), documents, terms)


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, item_id, term`` for each distinct term of each row of ``items``; ``item`` numbers the rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 40, 0
        for table in _slices(batches, 1):
            words, numbers = terms_of(table.column(1).combine_chunks())
            coded = words.dictionary_encode()
            pairs = np.unique(numbers * max(len(coded.dictionary), 1) + coded.indices.to_numpy())
            rows = pairs // max(len(coded.dictionary), 1)
            ids = table.column(0).combine_chunks().take(pa.array(rows))
            term = coded.dictionary.take(pa.array(pairs - rows * max(len(coded.dictionary), 1))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(base + seen + rows, pa.int64()), ids, term], ["item", "item_id", "term"])
            seen += table.num_rows

    return map_arrow(items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), cut, "item long, item_id long, term string", "tiered_search")


def _score_shard(table: pa.Table, wanted: dict[int, int] | None, tiers: int, k: int) -> Iterator[tuple]:
    """``item, open_bound, ids, scores`` of the items of one block in one shard.

    ``wanted`` maps the items to score to the score they have to reach; None is all. ``open_bound`` is the
    largest that a document whose score isn't exact could have, -1 if there is none. Only exact
    documents are named, but the first ``k`` lower bounds come as ``floors``.
    """
    ids = doc_count = None
    entries: dict[int, list[tuple[int, int, int]]] = {}
    postings: list[np.ndarray] = []
    column = {name: table.column(name) for name in table.column_names}
    for row in range(table.num_rows):
        if column["ids"][row].is_valid:
            ids, doc_count = column["ids"][row].values, len(column["ids"][row].values)
            continue
        raw = b"".join(column[name][row].as_py() for name in TIERS[:tiers])
        bound = column[f"{TIERS[tiers - 1]}_bound"][row].as_py() if tiers < len(TIERS) else 0
        number = len(postings)
        postings.append(np.frombuffer(raw, dtype="<u4").astype(np.int64))
        asked = column["asked"][row].values
        for item, weight in zip(asked.field("item").to_pylist(), asked.field("w").to_pylist(), strict=True):
            if wanted is None or item in wanted:
                entries.setdefault(item, []).append((number, weight, bound))
    if ids is None:
        return
    keys = pc.fill_null(ids, _INT64_MAX).to_numpy(zero_copy_only=False)
    places = [p >> _IMPACT_BITS for p in postings]
    impacts = [p & ((1 << _IMPACT_BITS) - 1) for p in postings]
    for item, found in entries.items():
        least = 1 if wanted is None else max(wanted[item], 1)
        low, slack = np.zeros(doc_count, dtype=np.int64), np.zeros(doc_count, dtype=np.int64)
        total = 0
        for number, weight, bound in found:
            low[places[number]] += weight * impacts[number]
            if bound:
                total += weight * bound
                slack[places[number]] -= weight * bound
        slack += total
        inexact = slack > 0
        open_bound = int((low + slack)[inexact].max()) if inexact.any() else -1
        hits = np.flatnonzero(low >= least)
        if len(hits) > k:
            hits = hits[low[hits] >= np.partition(low[hits], len(hits) - k)[len(hits) - k]]
        hits = hits[np.lexsort((keys[hits], -low[hits]))][:k]
        exact = hits[~inexact[hits]]
        yield item, open_bound, low[hits].tolist(), ids.take(pa.array(exact)).to_pylist(), low[exact].tolist()


def _pass(rows: DataFrame, wanted: DataFrame | None, tiers: int, k: int) -> DataFrame:
    """One pass over the shards: ``item, shard, open_bound, floors, ids, scores``."""
    kinds = pa.schema([("item", pa.int64()), ("shard", pa.int64()), ("open_bound", pa.int64()), ("floors", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
    fields = "item long, shard long, open_bound long, floors array<long>, ids array<long>, scores array<long>"

    def score(table: pa.Table, asked: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return kinds.empty_table()
        least = None if asked is None else dict(zip(asked.column("item").to_pylist(), asked.column("least").to_pylist(), strict=True))
        shard = table.column("shard")[0].as_py()
        found = [(item, shard, *rest) for item, *rest in _score_shard(table, least, tiers, k)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds) if found else kinds.empty_table()

    grouped = rows.groupBy("block", "shard")
    if wanted is None:
        return grouped.applyInArrow(lambda table: score(table), fields)
    return grouped.cogroup(wanted.groupBy("block", "shard")).applyInArrow(lambda table, asked: score(table, asked), fields)


def search(index: TieredIndex, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents of the highest scores above 0."""
    pairs = durable(_items(items, item_col, text_col), "asked")
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    n = F.lit(index.documents)
    terms = pairs.select("term").distinct()
    df = index.rows.where("term IS NOT NULL").select("term", "n").join(terms, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = df.select("term", F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * F.col("df") + 1))).cast("long").alias("w"))
    by_block = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    asked = durable(by_block.join(weighed, "term").groupBy("block", "term").agg(F.collect_list(F.struct("item", "w")).alias("asked")), "terms")
    heads = index.rows.where("term IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    results: list[DataFrame] = []
    wanted = None
    for tiers in range(1, len(TIERS) + 1):
        bound = [f"{TIERS[tiers - 1]}_bound"] if tiers < len(TIERS) else []
        columns = ["block", "shard", *TIERS[:tiers], *bound, "ids"]
        rows = index.rows.where("term IS NOT NULL").join(asked, "term").select(*columns, "asked").unionByName(heads.select(*columns), allowMissingColumns=True)
        if wanted is not None:
            rows = rows.join(wanted.select("block", "shard").distinct(), ["block", "shard"], "left_semi")
        scored = durable(_pass(rows, wanted, tiers, k), f"tier{tiers}")
        if tiers == len(TIERS):
            results.append(scored)
            break
        # The k-th best of an item over all shards; each task hands on k of an item at most.
        best = Window.partitionBy("item").orderBy(F.desc("floor"))
        known = scored.select("item", F.explode("floors").alias("floor"))
        for earlier in results:
            known = known.union(earlier.select("item", F.explode("scores")))
        floors = known.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
        reached = floors.groupBy("item").agg(F.when(F.count("*") >= k, F.min("floor")).otherwise(1).alias("least"))
        judged = scored.join(reached, "item", "left").withColumn("least", F.coalesce("least", F.lit(1)))
        results.append(scored.join(judged.where("open_bound < least").select("item", "shard"), ["item", "shard"], "left_semi"))
        wanted = durable(judged.where("open_bound >= least").select("item", "shard", "least").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), f"open{tiers}")
        if wanted.isEmpty():
            break
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    each = found.select("item", F.explode(F.arrays_zip("ids", "scores")).alias("r")).select("item", F.col("r.ids").alias("doc_id"), F.col("r.scores").alias("score"))
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = each.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(pairs.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
