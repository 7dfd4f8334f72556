import itertools
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import bagminhash as B


def bag(words, n=5):
    grams = [tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    return Counter(grams)


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out, k = [], 0
    base = [word() for _ in range(120)]
    for _ in range(60):  # a large group about one text, some of it only linked through that text
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = word()
        out.append((k, " ".join(copy)))
        k += 1
    for _ in range(30):
        own = [word() for _ in range(r.randint(1, 60))]
        out.append((k, " ".join(own)))
        out.append((k + 1, "  ".join(own).upper()))
        k += 2
    out += [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A  b"), (505, "ha ha ha ha ha ha ha ha"), (505, "ha ha ha ha ha ha ha ha"), (506, "ha ha ha ha ha ha ha"), (507, "z " * 30_000), (None, "lone text here")]
    return out


def expected(rows, threshold=0.8):
    bags = [bag((t or "").lower().split()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if bags[a] and bags[b] and rows[a][0] is not None and rows[b][0] is not None and jaccard(bags[a], bags[b]) >= threshold:
            parent[find(b)] = find(a)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return {k: min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(rows))}


@pytest.mark.parametrize("joined", [512, 0])
def test_groups_equal_all_pairs(spark, rows, joined, monkeypatch):
    monkeypatch.setattr(B, "JOINED_PAIRS", joined)
    monkeypatch.setattr(B, "BLOCK_X", 16)
    monkeypatch.setattr(B, "BLOCK_Y", 8)
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in B.deduplicate(docs).collect())
    want = expected(rows)
    assert got == Counter((i, want[k], i is None or i == want[k]) for k, (i, _) in enumerate(rows))


def test_one_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, bands string")
    want = expected(rows)
    got = sorted((r.doc_id for r in B.keep_one(docs).collect()), key=str)
    assert got == sorted({i for k, (i, _) in enumerate(rows) if i is None or want[k] == i}, key=str)
    assert B.keep_one(docs).columns == docs.columns
    assert B.keep_one(docs.limit(0)).count() == 0 and B.deduplicate(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard_without_bias():
    r = np.random.default_rng(9)
    errors = []
    for _ in range(80):
        n = int(r.choice([1, 3, 20, 200]))
        names = np.sort(r.integers(0, 1 << 62, n).astype(np.uint64))
        a, b = r.integers(1, 20, n), r.integers(0, 20, n)
        one, two = (names, a), (names[b > 0], b[b > 0])
        if not len(two[0]):
            continue
        s = B.signatures([one, two])
        errors.append((s[0] == s[1]).mean() - B.overlap(one, two))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_overlap_is_sum_of_min_over_sum_of_max():
    r = random.Random(10)
    for _ in range(200):
        a, b = ([r.choice("xyz") for _ in range(r.randint(1, 12))] for _ in range(2))
        assert B.overlap(B.shingles(a), B.shingles(b)) == pytest.approx(jaccard(bag(a, min(5, len(a))), bag(b, min(5, len(b)))))


def test_products_find_the_same_links():
    r = random.Random(11)
    texts = [[r.choice("uvwxyz") for _ in range(r.randint(3, 12))] for _ in range(60)]
    bags = [B.shingles(t) for t in texts]
    linked = B._linked([B._units(x) for x in bags[:25]], [B._units(x) for x in bags[25:]], 0.5)
    assert linked.tolist() == [[B.overlap(x, y) >= 0.5 for y in bags[25:]] for x in bags[:25]]


def test_spark_hash_is_reproduced(spark):
    row = spark.sql("SELECT xxhash64('abcdefghij') AS h").first()
    assert B._spark_xxhash64("abcdefghij") == row.h % (1 << 64)
