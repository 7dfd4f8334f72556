"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (one to three letters within words that
are padded with a space) by rank. A text's own list is compared to each profile by the out-of-place
distance: the sum, over the text's n-grams, of how far their ranks lie apart, or the greatest distance
for n-grams that the profile lacks. The nearest profile wins, ties go to the smaller name.

Profiles count all training texts: tasks sum counts up to a bound, Spark adds them up. N-grams are held
as 32-bit hashes.

Defined results: a text that is null or without any letter is ``und`` with score 0, as is every text
if nothing was learned; texts of any length are counted whole, in blocks; each of several equal rows
is returned; an empty table gives an empty table; only the id, text and language columns are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import fields_of, map_arrow, text_slices

#: Length of profiles and of texts' own lists.
RANKS = 400
#: More languages than this are refused: profiles are held by every task.
MOST_LANGUAGES = 2_000
#: Counts that a task holds before it hands them on; Spark adds up what several hands give.
HELD = 2_000_000
BLOCK = 1 << 18

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def _grams(block: str) -> np.ndarray:
    """Hashes of the n-grams of a text whose ends count as spaces."""
    codes = np.frombuffer(f" {block} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    c = np.where(is_letter, codes, 32).astype(np.uint64)
    one, two, three = c * _K1, c[:-1] * _K2 + c[1:] * _K1, (c[:-2] * _K3 + c[1:-1] * _K2 + c[2:] * _K1) * _K3
    found = np.concatenate([one[is_letter], two[is_letter[:-1] | is_letter[1:]], three[is_letter[1:-1]]])
    return (found >> np.uint64(32)).astype(np.uint32)


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(grams):
        return grams, np.zeros(0, dtype=np.int64)
    grams = np.sort(grams)
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.diff(np.append(starts, len(grams)))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([g for g, _ in parts])
    found, where = np.unique(grams, return_inverse=True)
    return found, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(found)).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, ascending, and how often each occurs.

    Blocks are cut before a word, so no n-gram is lost; only a single word longer than a block is cut.
    """
    text = text.lower()
    if len(text) <= BLOCK:
        return _counted(_grams(text))
    parts, start = [], 0
    while start < len(text):
        end = min(start + BLOCK, len(text))
        space = text.rfind(" ", start + 1, end)
        end = space if space > 0 and end < len(text) else end
        parts = [_added([*parts, _counted(_grams(text[start:end]))])]
        start = end
    return parts[0]


def ranked(text: str) -> np.ndarray:
    """The most frequent n-grams, the most frequent first, ties by hash."""
    grams, n = counts(text)
    keys = np.sort(((np.uint64(0xFFFFFFFF) - np.minimum(n, 0xFFFFFFFF).astype(np.uint64)) << np.uint64(32)) | grams.astype(np.uint64))
    return (keys[:RANKS] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def learn(documents: DataFrame, learn_from: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Each language's profile, from the rows with a language for which ``learn_from`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            sums.clear()

        for part, texts in text_slices(batches, 1):
            new: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                new.setdefault(lang, []).append(counts(text))
            for lang, parts in new.items():
                sums[lang] = _added([*([sums[lang]] if lang in sums else []), *parts])
            if sum(len(grams) for grams, _ in sums.values()) > HELD:
                yield from flushed()
        yield from flushed()

    texts = documents.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    totals = map_arrow(texts, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = totals.withColumn("place", place).where(F.col("place") <= RANKS).select("lang", "gram", "place")
    rows = best.limit(MOST_LANGUAGES * RANKS + 1).collect()
    if len(rows) > MOST_LANGUAGES * RANKS:
        raise ValueError(f"there are more than {MOST_LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.place)):
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class Profiles:
    """All profiles as one table from n-gram to its rank in each."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.uint32)
        self.place = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        for k, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.uint32)), k] = np.arange(len(profiles[lang]))

    def nearest(self, text: str) -> tuple[str, float]:
        """The nearest language, and one less its share of the greatest possible distance."""
        own = ranked(text)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        place = self.place[np.where(known, at, len(self.grams))]
        apart = np.where(place < 0, RANKS, np.abs(place - np.arange(len(own), dtype=np.int32)[:, None]))
        distance = apart.sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (RANKS * len(own)))


def predict(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(Profiles(profiles))  # at most MOST_LANGUAGES profiles of RANKS n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1):
            found = [shared.value.nearest(text) for text in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [id_col, "lang_pred", "score"])

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_known(df: DataFrame, profiles: dict[str, list[int]], least: float, text_col: str = "text") -> DataFrame:
    """The rows with letters whose nearest profile has a score of ``least``, columns as they are.

    Without any profile, all rows with letters.
    """
    shared = df.sparkSession.sparkContext.broadcast(Profiles(profiles))
    at = df.columns.index(text_col)

    def keep(text: str) -> bool:
        if not shared.value.langs:
            return any(map(str.isalpha, text))
        lang, score = shared.value.nearest(text)
        return lang != "und" and score >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, at):
            yield part.filter(pa.array([keep(t) for t in texts], pa.bool_()))

    return map_arrow(df, run, fields_of(df))
