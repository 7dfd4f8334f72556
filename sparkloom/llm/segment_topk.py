"""Exact top-k by inner product, with multi-resolution segment statistics.

A vector is cut into segments, of which the means and deviations are kept, at resolutions from one
segment to many. For two vectors, the sum over segments of length * ((difference of means)^2 +
(difference of deviations)^2) bounds their squared distance from below, and with both norms their
inner product from above. Going from coarse to fine, whatever can't reach the k-th best score known so
far is dropped, first whole blocks of vectors, then single vectors; survivors are scored exactly.

Rows are dealt into blocks of like vectors (by the nearest of some centres, picked from a bounded
sample) of bounded size. Each query is first scored in its own block, which gives it a k-th best score
to start from. A block's envelope (least and greatest mean, greatest deviation of each segment) then
tells which queries it may matter to; envelopes meet blocks of queries by an equality join on their
chunks' numbers. Only for these does a block of queries travel to a block of vectors. So neither side
is broadcast, vectors are shuffled once, no task holds more than two blocks at a time, and a lost task
repeats only its own pairs. A resolution that drops too little to pay for its bounds is left out for
the next queries of a block, so where nothing can be dropped the work is that of a plain product; the
results are the same either way.

Defined results: vectors that are null or empty or hold null or non-finite components take no part,
nor do null ids; of rows that share an id the least usable vector counts, so repeated rows are one;
only vectors of equal length are compared; equal scores go to the smaller id; an empty table gives an
empty table; only the id and the vector column are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, map_arrow
from sparkloom.llm.vectors import one_for_each_id, usable

#: Most rows of a block of candidates (expected; by a hash of the id) and its bytes, and queries of a block.
BLOCK, BLOCK_BYTES, QUERY_BLOCK = 8192, 1 << 25, 1024
#: Blocks have the vectors nearest to one of so many centres for each full block, at most; from a sample as large.
CENTRES, MOST_CENTRES = 2, 512
#: Segments at each resolution.
RESOLUTIONS = (1, 4, 16)
#: Vectors scored first, where a query has no k-th best score yet.
FIRST = 256
#: Queries of a block that are compared at once, and after how many such groups left-out bounds are tried again.
TOGETHER, AGAIN = 64, 16
#: Where fewer pairs than this share stay, they are scored one by one, else by one product of matrices.
SPARSE = 0.2
#: Envelopes that are compared to a block of queries at once.
CHUNK = 1024


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of each segment: rows whose inner product bounds the vectors' from above."""
    cuts = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).round().astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = vectors[:, a:b]
        out += [part.mean(axis=1) * math.sqrt(b - a), part.std(axis=1) * math.sqrt(b - a)]
    return np.stack(out, axis=1)


def envelope(vectors: np.ndarray) -> np.ndarray:
    """Least means, greatest means and greatest deviations of all resolutions' segments, and the longest length."""
    found = [statistics(vectors, s) for s in RESOLUTIONS]
    means, deviations = (np.concatenate([x[:, k::2] for x in found], axis=1) for k in (0, 1))
    return np.concatenate([means.min(axis=0), means.max(axis=0), deviations.max(axis=0), [np.sqrt((vectors**2).sum(axis=1)).max()]])


def reachable(queries: np.ndarray, least: np.ndarray, envelopes: np.ndarray) -> np.ndarray:
    """Whether a vector within each envelope may reach each query's ``least`` score; coarse to fine."""
    norms = np.sqrt((queries**2).sum(axis=1))
    most = norms[:, None] * envelopes[None, :, -1]
    slack = most * 1e-9 + 1e-6
    stays = most >= least[:, None] - slack
    at, width = 0, (envelopes.shape[1] - 1) // 3
    for s in RESOLUTIONS:
        of_queries = statistics(queries, s)
        n = of_queries.shape[1] // 2
        low, high, spread = (envelopes[:, k * width + at : k * width + at + n] for k in range(3))
        at += n
        rows, columns = np.flatnonzero(stays.any(axis=1)), np.flatnonzero(stays.any(axis=0))
        means, deviations = of_queries[rows, 0::2], of_queries[rows, 1::2]
        bound = np.maximum(means, 0) @ high[columns].T + np.minimum(means, 0) @ low[columns].T + deviations @ spread[columns].T
        part = np.ix_(rows, columns)
        stays[part] &= bound >= least[rows, None] - slack[part]
    return stays


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of whole numbers, as 64-bit integers (held to their range)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    limit = (1 << 63) - 1
    whole = [[int(a) for a in row] for row in x]
    return np.array([[max(-limit - 1, min(limit, sum(map(int.__mul__, r, s)))) for s in whole] for r in ([int(a) for a in row] for row in q)], dtype=np.int64).reshape(len(q), len(x))


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of each query's k best in a block; of equal scores the smaller ids.

    ``least``: scores below which a query needs nothing. ``tally`` receives how many pairs there were,
    stayed after each resolution, and were scored exactly.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    least = np.full(len(query_ids), -np.inf) if least is None else least
    levels = [(s, statistics(queries, s), statistics(vectors, s)) for s in RESOLUTIONS]
    longest = np.sqrt((vectors**2).sum(axis=1)).max(initial=0)
    tally = {} if tally is None else tally
    pays = dict.fromkeys(RESOLUTIONS, True)
    parts = []
    for number, start in enumerate(range(0, len(query_ids), TOGETHER)):
        rows, columns = np.arange(start, min(start + TOGETHER, len(query_ids))), np.arange(len(ids))
        tally["pairs"] = tally.get("pairs", 0) + len(rows) * len(columns)
        slack = np.sqrt((queries[rows] ** 2).sum(axis=1)) * longest * 1e-9 + 1e-6
        floor = least[rows]
        if np.isneginf(floor).any() and len(ids) > FIRST:
            some = columns[:: -(-len(ids) // FIRST)]
            first = _exact(queries[rows], vectors[some]).astype(np.float64)
            first[query_ids[rows][:, None] == ids[some][None, :]] = -np.inf
            if len(some) > k:
                floor = np.maximum(floor, np.partition(first, len(some) - k, axis=1)[:, len(some) - k])
        floor = floor - slack
        stays, tried = np.ones((len(rows), len(columns)), dtype=bool), []
        for s, of_queries, of_vectors in levels:
            if not np.isfinite(floor).any() or not len(columns) or (not pays[s] and number % AGAIN):
                continue
            before = stays.sum()
            stays &= of_queries[rows] @ of_vectors[columns].T >= floor[:, None]
            tried.append((s, (before - stays.sum()) * queries.shape[1] > before * of_queries.shape[1]))
            tally[s] = tally.get(s, 0) + int(stays.sum())
            kept = stays.any(axis=0)
            columns, stays = columns[kept], stays[:, kept]
        sparse = stays.sum() < SPARSE * len(rows) * len(ids)
        for s, dropped in tried:
            pays[s] = sparse and dropped
        if sparse:
            q, x = np.nonzero(stays)
            ends = np.searchsorted(q, np.arange(len(rows) + 1)).tolist()
            found = np.concatenate([_exact(queries[row : row + 1], vectors[columns[x[a:b]]])[0] for row, a, b in zip(rows.tolist(), ends[:-1], ends[1:], strict=True)])
            tally["scored"] = tally.get("scored", 0) + len(x)
            other = query_ids[rows[q]] != ids[columns[x]]
            q, x, found = q[other], x[other], found[other]
        else:
            scores = _exact(queries[rows], vectors[columns])
            tally["scored"] = tally.get("scored", 0) + scores.size
            ok = query_ids[rows][:, None] != ids[columns][None, :]
            if len(columns) > k + 1:
                ranks = np.where(ok, scores, np.iinfo(np.int64).min)
                ok &= ranks >= np.partition(ranks, len(columns) - k - 1, axis=1)[:, len(columns) - k - 1][:, None]
            q, x = np.nonzero(ok)
            found = scores[q, x]
        order = np.lexsort((x, ~found, q))  # ~ turns the order of integers round without overflow
        q, x, found = q[order], x[order], found[order]
        top = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        parts.append((query_ids[rows[q[top]]], ids[columns[x[top]]], found[top]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (query_ids[:0], ids[:0], np.zeros(0, np.int64))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _in_cells(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``id, v, d, cell``: each vector with its length and its nearest centre's number (0 without centres)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            cells = np.zeros(batch.num_rows, dtype=np.int32)
            for d in np.unique(lengths).tolist():
                if d in centres:
                    at = np.flatnonzero(lengths == d)
                    x = _matrix(batch.column(1).take(pa.array(at)), len(at))
                    cells[at] = (x @ centres[d].T - (centres[d] ** 2).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(cells)], ["id", "v", "d", "cell"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, d int, cell int")


def _home(blocks: DataFrame, k: int) -> DataFrame:
    """``d, cell, sub, envelope, found`` of each block: its queries scored among its own rows."""
    found_type = pa.list_(pa.struct([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column(3)[row].values
                ids, asked = (block.field(c).to_numpy(zero_copy_only=False) for c in ("id", "asked"))
                x = _matrix(block.field("v"), len(ids))
                best = best_of_block(ids[asked], x[asked], ids, x, k)
                found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in best], ["query_id", "id", "score"])
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found).cast(found_type)
                yield pa.RecordBatch.from_arrays([*(c.slice(row, 1) for c in batch.columns[:3]), pa.array([envelope(x)], pa.list_(pa.float64())), lists], ["d", "cell", "sub", "envelope", "found"])

    return map_arrow(blocks.select("d", "cell", "sub", "rows"), run, "d int, cell int, sub int, envelope array<double>, found array<struct<query_id:long,id:long,score:long>>")


def _wanted(asked: DataFrame, envelopes: DataFrame, chunks: int) -> DataFrame:
    """``d, q, cell, sub, places``: for each block of queries the other blocks that may matter, and to which queries."""
    chunk = F.pmod(F.xxhash64("cell", "sub"), F.lit(chunks)).cast("int").alias("chunk")
    packed = envelopes.groupBy("d", chunk).agg(F.collect_list(F.struct("cell", "sub", "envelope")).alias("envelopes"))
    pairs = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(packed, ["d", "chunk"]).select("d", "q", "asked", "envelopes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                queries, blocks = batch.column(2)[row].values, batch.column(3)[row].values
                cell, sub = (blocks.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "sub"))
                own = [queries.field(c).to_numpy(zero_copy_only=False)[:, None] for c in ("cell", "sub")]
                least = queries.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
                stays = reachable(_matrix(queries.field("v"), len(queries)), least, _matrix(blocks.field("envelope"), len(blocks)))
                stays &= (own[0] != cell[None, :]) | (own[1] != sub[None, :])
                at = np.flatnonzero(stays.any(axis=0))
                places = [np.flatnonzero(stays[:, b]).astype(np.int32) for b in at]
                head = [batch.column(c).take(pa.array(np.full(len(at), row))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(cell[at]), pa.array(sub[at]), pa.array(places, pa.list_(pa.int32()))], ["d", "q", "cell", "sub", "places"])

    return map_arrow(pairs, run, "d int, q int, cell int, sub int, places array<int>")


def _elsewhere(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score`` of the queries of each pair in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                places = batch.column(0)[row].values.to_numpy(zero_copy_only=False)
                queries, block = batch.column(1)[row].values.take(pa.array(places)), batch.column(2)[row].values
                ids, wanted = (side.field("id").to_numpy(zero_copy_only=False) for side in (block, queries))
                least = queries.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
                found = best_of_block(wanted, _matrix(queries.field("v"), len(wanted)), ids, _matrix(block.field("v"), len(ids)), k, least)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "score"])

    return map_arrow(pairs, run, "query_id long, id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: the k best partners of each row for which ``is_query(id)`` holds.

    Components are ``floor(scale * component)``.
    """

    def floored(vector: str) -> Column:
        return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))

    sample = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    wanted = max(1, min(MOST_CENTRES, math.ceil(CENTRES * sample.count() / BLOCK)))
    centres: dict[int, list] = {}
    for row in sample.orderBy(F.xxhash64("id"), "id").limit(wanted).select(floored("v").alias("v")).collect():
        centres.setdefault(len(row.v), []).append(row.v)
    rows = one_for_each_id(df, id_col, vector_col).where("id IS NOT NULL AND vector IS NOT NULL").select("id", floored("vector").alias("v"))
    rows = durable(_in_cells(rows, {d: np.array(v) for d, v in centres.items()}), "cells")

    # A cell's blocks, and the number of its first block of queries: a row for each cell.
    sizes = rows.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("asked"))
    before = F.sum("asked").over(Window.partitionBy("d").orderBy("cell")) - F.col("asked")
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("d")))))
    parts = F.ceil(F.col("n") / most).cast("int").alias("parts")
    sizes = durable(sizes.select("d", "cell", parts, F.floor(before / QUERY_BLOCK).cast("int").alias("first"), F.greatest(F.lit(1), F.ceil(F.col("asked") / QUERY_BLOCK)).cast("int").alias("asked")), "sizes")
    if sizes.count() <= 4 * MOST_CENTRES:
        sizes = F.broadcast(sizes)
    number = F.xxhash64("id")
    placed = rows.join(sizes, ["d", "cell"]).select("id", "v", "d", "cell", F.pmod(number, F.col("parts")).cast("int").alias("sub"), (F.col("first") + F.pmod(number, F.col("asked"))).cast("int").alias("q"), is_query.alias("asked"))
    blocks = durable(placed.groupBy("d", "cell", "sub").agg(F.collect_list(F.struct("id", "v", "asked")).alias("rows")), "blocks")
    home = durable(_home(blocks, k), "home")
    best = home.select(F.explode("found").alias("f")).select("f.*")
    count = home.count()
    if count > 1:
        known = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
        queries = placed.where("asked").join(known, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        asked = durable(queries.groupBy("d", "q").agg(F.collect_list(F.struct("id", "v", "least", "cell", "sub")).alias("asked")), "asked")
        pairs = durable(_wanted(asked, home.select("d", "cell", "sub", "envelope"), math.ceil(count / CHUNK)), "pairs")
        joined = pairs.join(asked, ["d", "q"]).join(blocks, ["d", "cell", "sub"]).select("places", "asked", "rows")
        best = best.union(_elsewhere(joined, k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
