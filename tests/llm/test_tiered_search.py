"""Tiered search: brute force over small corpora of all kinds, and what the tiers save."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import tiered_search
from sparkloom.llm.tiered_search import build_index, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    cut = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in cut if c), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item_id, text in items:
        terms = set(words(text))
        scores = []
        for doc_id, c in cut:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id, score))
        out += [(item_id, rank, x[3], x[4]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def found(spark, docs, items, k=50, parts=3):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit(1), "shard": F.lit("x"), "a.b": F.lit(2), "ID": F.lit(3)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(1), "block": F.lit(2)})
    return search(build_index(frame.repartition(parts)), asked, k).select("item_id", "rank", "doc_id", "score").collect()


def test_terms():
    texts = ["Ab-cÉD x 12_3\x00z", None, "", "...", "漢字 A"]
    got, numbers = terms_of(pa.array(texts))
    want = [(t, k) for k, text in enumerate(texts) for t in words(text)]
    assert list(zip(got.to_pylist(), numbers.tolist(), strict=True)) == want
    part, numbers = terms_of(pa.array(texts).slice(3, 2))
    assert part.to_pylist() == words(texts[4]) and numbers.tolist() == [1, 1]


@pytest.mark.parametrize("seed", range(4))
def test_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(tiered_search, "SHARD_DOCS", 40)
    monkeypatch.setattr(tiered_search, "BLOCK_PAIRS", 30)
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(rng.randrange(300), " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 200])))) for _ in range(400)]
    docs += [docs[0]] * 60 + [(None, docs[1][1]), (None, "w1"), (500, None), (501, ""), (502, "!?")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 6, 20])))) for k in range(12)] + [(90, None), (91, "unknown"), (92, "W0 w0, w3"), (3, "w59 w58")]
    assert ordered(found(spark, docs, items, k=7)) == ordered(brute(docs, items, 7))


def test_rare_terms_are_proven_by_the_first_tier(spark, monkeypatch):
    monkeypatch.setattr(tiered_search, "SHARD_DOCS", 500)
    rng = random.Random(5)
    docs = [(k, "common " * rng.randrange(1, 4) + " ".join(f"x{rng.randrange(5000)}" for _ in range(rng.randrange(3, 40)))) for k in range(2000)]
    docs += [(3000 + k, "common needle stack") for k in range(12)]
    tiers = []
    real = tiered_search._pass
    monkeypatch.setattr(tiered_search, "_pass", lambda rows, wanted, n, k: tiers.append((n, None if wanted is None else wanted.count())) or real(rows, wanted, n, k))
    items = [(1, "needle stack common")]
    assert ordered(found(spark, docs, items, k=10)) == ordered(brute(docs, items, 10))
    assert tiers == [(1, None)]


def test_long_texts_and_empty_tables(spark):
    docs = [(1, "a b " * 500_000 + "c"), (2, "c"), (3, "y" * 2_000_000)]
    items = [(1, "a c"), (2, "y" * 2_000_000)]
    assert ordered(found(spark, docs, items)) == ordered(brute(docs, items))
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
