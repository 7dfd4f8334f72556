"""Near-duplicate texts by BagMinHash: weighted minwise hashing of multisets of word shingles.

A shingle's weight is how often it occurs. The weights up to a doubling bound, (0, 1], (1, 2],
(2, 4], ..., each carry a Poisson process of points; a point falls on one slot of the signature and,
as the bits of one random number halve its interval again and again, on one unit of weight (all
halvings are read at once, as a fraction of the interval's width). Slots keep the least point among the
units that a document's weights cover. Points come in ascending order, so a shingle is given up as
soon as its next point lies beyond the largest slot. Two signatures agree in a slot with probability
sum(min) / sum(max) of the weights.

Signatures are cut into bands. Each band's bucket is compared to one member by exact multiset
overlap, and what that leaves apart to the member nearest to the first (of a group of copies of one
text, that text as a rule); those linked become one component at once. What is left in buckets of
several components is compared pair by pair: in small buckets by a join, except where the triangle
inequality of the Jaccard distance rules a link out; in large ones by blocks of bounded size, whose
overlaps are products of incidence matrices and which yield components instead of pairs. So no pair
that shares a band is lost, and a bucket of thousands of near copies costs rows in proportion to it.

Texts are lower-cased and split at white space; texts of the same words are one class from the start
(copies never enter a bucket). A text of fewer words than a shingle is one shingle of its own.

Defined results: null and empty texts link with nothing and are kept; rows with a null id are kept and
have no component; of a group the least id stays; each of several equal rows is returned; very long
texts are taken whole, in blocks; an empty table gives an empty table; only the id and the text column
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, fields_of, map_arrow, text_slices, unused
from sparkloom.llm.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 25 = 0.99995.
BANDS, ROWS = 25, 5
SLOTS = 128
#: Shingles whose points are drawn together.
BLOCK = 1 << 19
#: Buckets with at most so many pairs to compare are joined, others are worked through in blocks.
JOINED_PAIRS = 512
#: Bands that hold more than this share of all bucket rows, so fewer than as many, are joined by broadcast.
HOT_BANDS = 2_000
#: Rows of a block: texts outside a bucket's largest component, and any texts.
BLOCK_Y, BLOCK_X = 512, 1024
#: Shingles, counted as often as they occur, that a task keeps of earlier blocks: 64 MB.
HELD_UNITS = 1 << 23
#: 64-bit words of the bitmap of wanted texts: 8 MB, whatever the input.
BITMAP_BITS = 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def key_of(words: list[str]) -> str | None:
    """96 bits that stand for a sequence of words."""
    return base64.b85encode(xxhash.xxh3_128_digest(" ".join(words))[:12]).decode() if words else None


def shingles(words: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and how often each occurs."""
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = (out * _P + h[k : k + n]) * _A
    return np.unique(_mix(out), return_counts=True)


def _draw(table: np.ndarray, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> None:
    """Lower ``table[doc, slot]`` to the least points of the given shingles' weights."""
    # One row for each shingle and interval (2 ** (k - 1), 2 ** k] that its weight reaches into.
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    at = np.repeat(np.arange(len(doc)), levels)
    level = (np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)).astype(np.uint64)
    doc, weight, seed = doc[at], weight[at], _mix(shingle[at] + level * _A)
    width = np.where(level > 0, np.exp2(np.maximum(level.astype(np.float64), 1) - 1), 1.0)
    base = np.where(level > 0, width, 0.0)
    x = np.zeros(len(at))
    step = 0
    while len(doc):
        step += 1
        r = _mix(seed + np.uint64(step * int(_C) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
        q = _mix(r + _A)
        slot = (q & np.uint64(SLOTS - 1)).astype(np.int64)
        unit = base + np.floor((q >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width)
        hit = unit < weight
        np.minimum.at(table, (doc[hit], slot[hit]), x[hit])
        go = x < table.max(axis=1)[doc]
        doc, seed, width, base, weight, x = doc[go], seed[go], width[go], base[go], weight[go], x[go]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of ``SLOTS`` least points for each multiset; rows of empty ones stay infinite."""
    table = np.full((len(bags), SLOTS), np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
    shingle = np.concatenate([s for s, _ in bags]) if bags else np.zeros(0, dtype=np.uint64)
    weight = np.concatenate([w for _, w in bags]) if bags else np.zeros(0, dtype=np.int64)
    for start in range(0, len(doc), BLOCK):
        part = slice(start, start + BLOCK)
        _draw(table, doc[part], shingle[part], weight[part])
    return table


def bands(table: np.ndarray) -> np.ndarray:
    """The hash of each band of each signature."""
    bits = table[:, : BANDS * ROWS].view(np.uint64).reshape(len(table), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, (len(table), BANDS)).copy()
    for k in range(ROWS):
        out = _mix(out * _P + bits[:, :, k])
    return out.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def sign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, bands`` of every row; both are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1):
            words = [words_of(text) for text in texts]
            full = [k for k, w in enumerate(words) if w]
            found = bands(signatures([shingles(words[k]) for k in full]))
            place = np.full(len(words), -1)
            place[full] = np.arange(len(full))
            values = pa.array(found.reshape(-1)) if full else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), values)
            where = pa.array([int(x) if x >= 0 else None for x in place], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([key_of(w) for w in words], pa.string()), lists.take(where)], [id_col, "key", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, key string, bands array<long>")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key; at most 2 ** BITMAP_BITS rows are fetched, whatever the input."""
    h = F.xxhash64("key")
    slot, bit = F.shiftrightunsigned(h, 64 - BITMAP_BITS), F.expr("shiftleft(1L, cast(h & 63 AS int))")
    out = np.zeros(1 << BITMAP_BITS, dtype=np.uint64)
    for row in keys.select(h.alias("h"), slot.alias("slot")).groupBy("slot").agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[row.slot] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _texts(df: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """``key, text`` of the wanted keys, one text each.

    Texts whose bit isn't set are never shuffled, and each task hands on only one of several copies.
    """
    spark = df.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for _, texts in text_slices(batches, 0):
            found = [key_of(words_of(text)) for text in texts]
            chosen = []
            for k in np.flatnonzero(_in_bitmap(bitmap.value, found)).tolist():
                if found[k] not in seen:
                    seen.add(found[k])
                    chosen.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([found[k] for k in chosen], pa.string()), pa.array([texts[k] for k in chosen], pa.string())], ["key", "text"])

    return map_arrow(df.select(text_col), run, "key string, text string").join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def _spark_xxhash64(key: str) -> int:
    """What the SQL function xxhash64 gives for a string, unsigned."""
    return xxhash.xxh64_intdigest(key.encode(), seed=42)


def _in_bitmap(bits: np.ndarray, keys: list[str | None]) -> np.ndarray:
    """Whether each key's bit is set; null keys have none."""
    hashes = np.array([_spark_xxhash64(k) if k else 0 for k in keys], dtype=np.uint64)
    hit = ((bits[hashes >> np.uint64(64 - BITMAP_BITS)] >> (hashes & np.uint64(63))) & np.uint64(1)).astype(bool)
    return hit & np.array([bool(k) for k in keys], dtype=bool)


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` by the exact multisets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = []
                for b, one, other in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if b != kept_key:
                        kept_key, kept = b, shingles(words_of(other))
                    found.append(overlap(shingles(words_of(one)), kept))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    first = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return map_arrow(pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b"), run, "a string, b string, similarity double")


def _units(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: each shingle hashed with each number up to its weight."""
    times = np.arange(int(bag[1].sum())) - np.repeat(np.cumsum(bag[1]) - bag[1], bag[1])
    return _mix(np.repeat(bag[0], bag[1]) + times.astype(np.uint64) * _A)


def _linked(ys: list[np.ndarray], xs: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which rows of the two sides have the wished similarity, by products of incidence matrices."""
    sizes = np.array([len(u) for u in ys + xs])
    _, column, count = np.unique(np.concatenate(ys + xs), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    row, column = row[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((len(ys), len(xs)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        has = np.zeros((len(sizes), 4096), dtype=np.float32)
        has[row[a:b], column[a:b] - start] = 1
        both += has[: len(ys)] @ has[len(ys) :].T
    return both / np.maximum(1, sizes[: len(ys), None] + sizes[None, len(ys) :] - both) >= threshold


def _least_labels(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of a two-sided graph: the least row or (after the rows) column of each."""
    rows, columns = linked.shape
    a, b, far = np.arange(rows), rows + np.arange(columns), rows + columns
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], far).min(axis=0, initial=far))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], far).min(axis=1, initial=far))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _compare_blocks(side: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links that connect what is linked in large buckets.

    ``side``: ``band, key, minor`` (outside the bucket's largest component), ``n`` and ``minors``.
    """
    blocks_y, blocks_x = (F.ceil(F.col(n) / size).cast("int") for n, size in (("minors", BLOCK_Y), ("n", BLOCK_X)))
    number = F.xxhash64("key", "band")
    as_x = side.select("band", "key", F.lit(True).alias("is_x"), F.pmod(number, blocks_x).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), blocks_y - 1)).alias("y"))
    as_y = side.where("minor").select("band", "key", F.lit(False).alias("is_x"), F.explode(F.sequence(F.lit(0), blocks_x - 1)).alias("x"), F.pmod(number, blocks_y).cast("int").alias("y"))
    placed = as_x.union(as_y).join(texts, "key").select("band", "x", "y", "is_x", "key", "text")
    together = placed.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        held = 0
        place, rows = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            ys, xs = [r for r in rows if not r[0]], [r for r in rows if r[0]]
            if not ys or not xs:
                return
            linked = _linked([u for _, _, u in ys], [u for _, _, u in xs], threshold)
            names = [key for _, key, _ in ys + xs]
            labels = np.concatenate(_least_labels(linked))
            found = [(names[k], names[label]) for k, label in enumerate(labels.tolist()) if names[k] != names[label]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["a", "b"])

        for batch in batches:
            places = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for here, is_x, key, text in zip(places, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if here != place:
                    yield from finish()
                    place, rows = here, []
                if key not in known:
                    if held > HELD_UNITS:
                        known, held = {}, 0
                    known[key] = _units(shingles(words_of(text.as_py())))
                    held += len(known[key])
                rows.append((is_x, key, known[key]))
        yield from finish()

    return map_arrow(together, run, "a string, b string")


def _with_bands(rows: DataFrame, bands: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with what ``bands`` says of their band. Bands in ``hot``, HOT_BANDS at most, are broadcast, so that no task gets all rows of one."""
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), "band", "left")
    own = bands.join(F.broadcast(hot), "band", "left_semi")
    warm = marked.where("__hot").drop("__hot").join(F.broadcast(own), "band")
    cold = marked.where("__hot IS NULL").drop("__hot").join(bands.join(F.broadcast(hot), "band", "left_anti"), "band")
    return warm.unionByName(cold)


def _placed(buckets: DataFrame, components: DataFrame, hot: DataFrame) -> DataFrame:
    """``buckets`` with the components so far, only those of several components."""
    placed = buckets.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("band").agg((F.min("component") < F.max("component")).alias("mixed")).where("mixed").select("band")
    return durable(_with_bands(placed, mixed, hot), "mixed")


def find_links(df: DataFrame, signed: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``a, b``: edges between keys whose components are those of all links (loops may be among them)."""
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.any_value("bands").alias("bands"))
    member = classes.select("key", F.explode("bands").alias("band"))
    leaders = durable(member.groupBy("band").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leaders")
    total = leaders.agg(F.sum("n")).first()[0] or 0
    # A share of all rows that fewer than HOT_BANDS bands can have.
    hot = durable(leaders.where(F.col("n") > max(1, total // HOT_BANDS)).select("band"), "hot")
    buckets = durable(_with_bands(member, leaders.select("band", "leader"), hot), "buckets")
    pairs = durable(buckets.where("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    texts = durable(_texts(df, durable(wanted, "keys"), text_col), "texts")
    first = durable(_compare(pairs, texts), "compared")
    links = first.where(F.col("similarity") >= threshold).select("a", "b")
    far = first.select(F.col("a").alias("key"), F.col("b").alias("leader"), (1 - F.col("similarity")).alias("far"))

    # A second star, about the member nearest to the leader.
    components = connected_components(links, stored=True)
    mixed = _placed(buckets, components, hot).join(far, ["key", "leader"], "left").withColumn("far", F.coalesce("far", F.lit(0.0)))
    nearest = mixed.where("key <> leader").groupBy("band").agg(F.min(F.struct("far", "key", "component")).alias("near"))
    apart = _with_bands(mixed, nearest, hot).where(F.col("component") != F.col("near.component"))
    pairs = apart.select(F.col("key").alias("a"), F.col("near.key").alias("b")).distinct()
    second = durable(_compare(pairs, texts), "compared")
    links = components.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second.where(F.col("similarity") >= threshold).select("a", "b"))

    # What is still apart within a bucket.
    components = connected_components(links, stored=True)
    mixed = _placed(buckets, components, hot)
    sizes = mixed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("major"))
    sizes = sizes.select("band", "n", F.col("major.component").alias("major"), (F.col("n") - F.col("major.c")).alias("minors"))
    side = _with_bands(mixed, sizes, hot).join(far, ["key", "leader"], "left")
    side = durable(side.select("band", "key", "component", F.coalesce("far", F.lit(0.0)).alias("far"), (F.col("component") != F.col("major")).alias("minor"), "n", "minors"), "side")
    small = F.col("n") * F.col("minors") <= JOINED_PAIRS
    x, y = side.where(small).alias("x"), side.where(small & F.col("minor")).alias("y")
    feasible = F.abs(F.col("x.far") - F.col("y.far")) <= 1 - threshold + 1e-9
    more = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & feasible)
    more = more.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    done = first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    third = durable(_compare(more.join(done, ["a", "b"], "left_anti"), texts), "compared")
    blocks = durable(_compare_blocks(side.where(~small), texts, threshold), "links")
    links = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return links.union(third.where(F.col("similarity") >= threshold).select("a", "b")).union(blocks)


def deduplicate(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id, kept`` of every row: the least id of its group, and whether it is the row's own."""
    signed = durable(sign(df, id_col, text_col), "signed")
    components = connected_components(find_links(df, signed, threshold, text_col), stored=True).select(F.col("node").alias("key"), "component")
    ids = signed.select(id_col, "key").where(F.col(id_col).isNotNull() & F.col("key").isNotNull())
    least = ids.groupBy("key").agg(F.min(id_col).alias("least")).join(components, "key", "left").withColumn("component", F.coalesce("component", "key"))
    grouped = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = durable(least.select("key", "component").join(grouped, "component").select("key", "component_id"), "groups")
    found = signed.select(id_col, "key").join(named, "key", "left")
    component = F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col))
    return found.select(id_col, component.alias("component_id")).withColumn("kept", F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))


def keep_one(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` but those of which another of their group stays.

    What goes is decided on ids and keys. Only rows that a bitmap of fixed size says may go are joined
    to the decisions, by id and key; so no group of copies meets in one task, and other texts are never
    shuffled. Of rows equal in id and words one stays; a row with a null id stays only if its group has
    no other.
    """
    signed = durable(sign(df, id_col, text_col), "signed")
    components = connected_components(find_links(df, signed, threshold, text_col), stored=True).select(F.col("node").alias("key"), "component")
    rows = signed.where(F.col("key").isNotNull()).select(F.col(id_col).alias("id"), "key")
    each = rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).join(components, "key", "left")
    several = each.where((F.col("n") > 1) | F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "key"))
    first = several.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "key")).alias("first"))
    verdict = several.join(first, "component").select("key", (F.col("key") == F.col("first.key")).alias("stays"), "least")
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("key"))
    decided = rows.join(verdict, "key").select(name.alias("key"), (F.col("stays") & F.col("id").eqNullSafe(F.col("least"))).alias("stays"))
    # Rows that stay and come once need nothing done.
    acted = durable(decided.groupBy("key").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1").select("key", "stays"), "verdicts")
    bitmap = df.sparkSession.sparkContext.broadcast(_bitmap(acted))
    names = df.columns
    at, mine = names.index(text_col), unused("__key", names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, at):
            *columns, ids = part.columns
            keys = [key_of(words_of(text)) for text in texts]
            both = [f"{i}:{k}" if k else None for i, k in zip(ids.to_pylist(), keys, strict=True)]
            hit = _in_bitmap(bitmap.value, both)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x if h else None for x, h in zip(both, hit.tolist(), strict=True)], pa.string())], [*names, mine])

    named = df.select(*(F.col(f"`{n}`") for n in names), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias(mine))
    marked = map_arrow(named, mark, f"{fields_of(df)}, `{mine}` string")
    columns = [F.col(f"r.`{n}`") for n in names]
    alone = marked.where(F.col(f"`{mine}`").isNull()).drop(mine)
    maybe = marked.where(F.col(f"`{mine}`").isNotNull()).alias("r").join(acted.alias("v"), F.col(f"r.`{mine}`") == F.col("v.key"), "left")
    others = maybe.where(F.col("v.key").isNull()).select(*columns)
    repeated = maybe.where("v.stays").groupBy(F.col("v.key").alias("k")).agg(F.first(F.struct(*columns)).alias("row")).select(*(F.col(f"row.`{n}`") for n in names))
    return alone.unionByName(others).unionByName(repeated)
