"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its eight nearest reference points (pivots), nearest first. Inverted lists
are kept for each vector's three nearest pivots. Two vectors are compared if they meet in a list and
share at least two of their eight pivots; whoever is compared is verified by cosine in double
precision. Two vectors that meet in several lists count in that of their smallest shared pivot only.

Pivots grow with the number of vectors, so that lists don't: up to 1,024 are compared to each vector
directly, beyond that each of 1,024 has up to 32 of its own, and a vector is compared to those of its
eight nearest. A list that is very long all the same is cut by the second shared pivot: its members
stand in a list for each pair of that pivot and another of their eight, which loses nothing, as two
pivots must be shared anyway.

Postings carry a vector once for each list. A list is worked through in blocks of bounded size, whose
number is known before vectors move, so they are shuffled once. A pair of blocks yields, for each vector, how many
links it has there and the least vector of its component among the links there, never the links
themselves; so a group of very many near copies costs rows in proportion to its members.

The pivots come from a bounded sample of the vectors (the least by a hash of the id), from which those
too near to one another are left out, so that a group of near copies doesn't fill them. Every vector is
indexed. Defined results: one row for each id; vectors that are null, empty or zero or hold null or
non-finite components link with nothing, as do those with a null id; of rows that share an id the
least usable vector counts, so repeated rows are one; only vectors of equal length are compared; an
empty table gives an empty table; only the id and the vector column are read, so further columns of
any name do no harm.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, map_arrow
from sparkloom.llm.components import connected_components
from sparkloom.llm.vectors import one_for_each_id

#: Pivots of the first kind, and pivots that each of them may have of its own: 32,768 at most.
LEAST_PIVOTS, MOST_PIVOTS, OWN_PIVOTS = 64, 1024, 32
#: Nearest pivots that describe a vector, those of them that it is listed under, and how many two must share.
NEAREST, LISTED, SHARED = 8, 3, 2
#: Wished length of a list, rows of a block, and blocks from which a list is cut by second pivots.
LIST, BLOCK, LONG = 256, 1024, 32
#: The sample has so many vectors for each pivot, in so many bytes; pivots are less alike than this, if enough are.
SAMPLED, SAMPLE_BYTES, APART = 8, 1 << 27, 0.8
#: Pairs whose pivots are compared at once.
TOGETHER = 100_000


def pivot_count(n: int) -> int:
    return max(LEAST_PIVOTS, min(MOST_PIVOTS * OWN_PIVOTS, LISTED * n // LIST))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` unit vectors that lie apart from those before; all such, if fewer."""
    chosen = np.zeros((n, sample.shape[1]))
    count = 0
    for x in sample:
        if count < n and (chosen[:count] @ x < APART).all():
            chosen[count] = x
            count += 1
    return chosen[:count]


class Pivots:
    """Pivots of one or two levels, made from unit vectors; at most MOST_PIVOTS * OWN_PIVOTS."""

    def __init__(self, sample: np.ndarray, wanted: int):
        first = spread(sample, min(wanted, MOST_PIVOTS))
        if len(first) < 2:  # all alike: any second pivot makes lists of all
            first = np.vstack([first, -first])
        self.first, self.own = first, []
        if wanted > MOST_PIVOTS:
            near = (sample @ first.T).argmax(axis=1)
            for k in range(len(first)):
                own = spread(sample[near == k], -(-wanted // MOST_PIVOTS))
                self.own.append(own if len(own) else first[k : k + 1])
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in self.own])]).astype(np.int64) if self.own else None

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The numbers of each unit vector's nearest pivots, nearest first; -1 where there are fewer."""
        near = -(x @ self.first.T)
        order = np.argsort(near, axis=1, kind="stable")[:, :NEAREST]
        if not self.own:
            return _padded(order, NEAREST)
        width = max(len(own) for own in self.own)
        scores = np.full((len(x), order.shape[1], width), -np.inf)
        for k in np.unique(order).tolist():
            rows, at = np.nonzero(order == k)
            scores[rows, at, : len(self.own[k])] = x[rows] @ self.own[k].T
        numbers = (self.starts[order][:, :, None] + np.arange(width)).reshape(len(x), -1)
        scores = scores.reshape(len(x), -1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :NEAREST]
        found = np.take_along_axis(numbers, best, axis=1)
        return _padded(np.where(np.isneginf(np.take_along_axis(scores, best, axis=1)), -1, found), NEAREST)


def _padded(numbers: np.ndarray, width: int) -> np.ndarray:
    out = np.full((len(numbers), width), -1, dtype=np.int16)
    out[:, : numbers.shape[1]] = numbers
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def describe(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """``id, vector`` with ``pivots array<short>``: the nearest, nearest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS * OWN_PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            found = [shared.value.nearest(_unit(x[i : i + 2048])) for i in range(0, len(x), 2048)]
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * NEAREST
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).reshape(-1) if found else np.zeros(0, np.int16)))], [*batch.schema.names, "pivots"])

    return map_arrow(vectors, run, f"id {vectors.schema['id'].dataType.simpleString()}, vector {vectors.schema['vector'].dataType.simpleString()}, pivots array<short>")


def counts_here(one: int, two: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of pivots share enough, and count in the list of ``one`` (cut by ``two``, unless -1)."""
    far = np.iinfo(np.int16).max
    same = (left[:, :, None] == right[:, None, :]) & (left[:, :, None] >= 0)
    listed = np.where(same[:, :LISTED, :LISTED].any(axis=2), left[:, :LISTED], far).min(axis=1) == one
    shared = same.any(axis=2)
    ok = listed & (shared.sum(axis=1) >= SHARED)
    if two >= 0:
        ok &= np.where(shared & (left != one), left, far).min(axis=1) == two
    return ok


def _least_labels(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of a two-sided graph: the least row or (after the rows) column of each."""
    rows, columns = linked.shape
    a, b = np.arange(rows), rows + np.arange(columns)
    far = rows + columns
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], far).min(axis=0, initial=far))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], far).min(axis=1, initial=far))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def links_of_block(one: int, two: int, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, link counts and component roots of the vectors with links in one block or pair of blocks.

    ``side``: 0 and 1 for a pair of different blocks, 2 for a block with itself.
    """
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    linked = x[left] @ x[right].T >= threshold
    linked &= ids[left][:, None] != ids[right][None, :]
    a, b = np.nonzero(linked)
    for start in range(0, len(a), TOGETHER):
        part = a[start : start + TOGETHER], b[start : start + TOGETHER]
        linked[part] = counts_here(one, two, pivots[left[part[0]]], pivots[right[part[1]]])
    if not linked.any():
        return ids[:0], np.zeros(0, dtype=np.int64), ids[:0]
    of_left, of_right = linked.sum(axis=1), linked.sum(axis=0)
    label_left, label_right = _least_labels(linked)
    names = np.concatenate([ids[left], ids[right]])
    if (side == 2).all():
        hit = of_left > 0
        return ids[left][hit], of_left[hit], names[np.minimum(label_left, label_right)[hit]]
    n, label = np.concatenate([of_left, of_right]), np.concatenate([label_left, label_right])
    return names[n > 0], n[n > 0], names[label[n > 0]]


def _postings(described: DataFrame) -> DataFrame:
    """A row for each list that a vector stands in: ``one, two, blocks, id, vector, pivots`` (``two`` -1 in uncut lists)."""
    under = F.explode(F.filter(F.slice("pivots", 1, LISTED), lambda p: p >= 0)).alias("one")
    lengths = described.select(under).groupBy("one").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lengths = durable(lengths.select("one", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lists")
    # A row for each pivot, so at most MOST_PIVOTS * OWN_PIVOTS.
    listed = described.select("id", "vector", "pivots", under).join(F.broadcast(lengths), "one")
    whole = listed.where(F.col("blocks") <= LONG).withColumn("two", F.lit(-1).cast("short"))
    if lengths.where(F.col("blocks") > LONG).isEmpty():
        return whole
    other = F.explode(F.filter("pivots", lambda p: (p >= 0) & (p != F.col("one")))).alias("two")
    long = listed.where(F.col("blocks") > LONG).drop("blocks").select("id", "vector", "pivots", "one", other)
    cut = long.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return whole.unionByName(long.join(cut, ["one", "two"]))


def find_links(described: DataFrame, threshold: float) -> DataFrame:
    """``id, n, root`` from each block that a vector has links in."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = _postings(described).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte")
    placed = dealt.select("one", "two", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "vector", "pivots", side.alias("side"))
    together = placed.repartition("one", "two", "low", "high").sortWithinPartitions("one", "two", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                if held is None:
                    return
                ends, columns = [len(held[0])], held
            else:
                place = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1).astype(np.int64)
                x = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                columns = (place, batch.column(4).to_numpy(zero_copy_only=False), _unit(x), batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column(7).to_numpy(zero_copy_only=False))
                if held is not None:
                    columns = tuple(np.concatenate(c) for c in zip(held, columns, strict=True))
                ends = (np.flatnonzero((columns[0][1:] != columns[0][:-1]).any(axis=1)) + 1).tolist()
            start, out = 0, []
            for end in ends:
                if end - start > 1:
                    out.append(links_of_block(int(columns[0][start, 0]), int(columns[0][start, 1]), *(c[start:end] for c in columns[1:]), threshold))
                start = end
            held = None if batch is None else tuple(c[start:] for c in columns)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "n", "root"])

    kind = described.schema["id"].dataType.simpleString()
    return map_arrow(together, run, f"id {kind}, n long, root {kind}")


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept`` of every id."""
    every = durable(one_for_each_id(df, id_col, vector_col), "vectors")
    found = None
    nonzero = every.where("id IS NOT NULL AND vector IS NOT NULL").where(F.exists("vector", lambda x: x != 0))
    for row in nonzero.groupBy(F.size("vector").alias("d")).count().collect():  # lengths of vectors: one, as a rule
        same = nonzero.where(F.size("vector") == row.d)
        wanted = pivot_count(row["count"])
        most = max(2, min(SAMPLED * wanted, SAMPLE_BYTES // (8 * row.d)))
        sample = same.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow().column(0).combine_chunks()
        x = _unit(sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sample), -1))
        links = find_links(durable(describe(same, Pivots(x, wanted)), "described"), threshold)
        found = links if found is None else found.union(links)
    if found is None:
        found = every.where("false").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root"))
    found = durable(found, "links")
    components = connected_components(found.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")), stored=True).withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    out = every.select("id").join(counts, "id", "left").join(components, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
