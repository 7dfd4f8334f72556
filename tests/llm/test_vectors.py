import duckdb
import numpy as np
import pytest

from sparkloom.llm import pivot_index, queries, segment_topk
from pyspark.sql import functions as F

ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [float("inf")] + [1.0] * 7), (905, [None] + [1.0] * 7), (906, [1.0] * 3), (None, [1.0] * 8)]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 8))
    out = [(k, (base[k % 40] + r.normal(size=8) * 0.05).tolist()) for k in range(300)]
    hot = [(1000 + k, (base[0] + r.normal(size=8) * 0.02).tolist()) for k in range(150)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in out + hot] + [(7, out[7][1])] * 0 + [(i, v) for i, v in ODD]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")


def sql(rows, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, v) for i, v in rows])
    return sorted(con.execute(queries.ORACLE_SQL[name]).fetchall(), key=str)


@pytest.mark.parametrize("block", [8192, 64])
def test_top_k_is_exact_in_any_blocks(spark, rows, table, block, monkeypatch):
    monkeypatch.setattr(segment_topk, "BLOCK", block)
    monkeypatch.setattr(segment_topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(segment_topk, "CHUNK", 3)
    monkeypatch.setattr(segment_topk, "FIRST", 16)
    got = segment_topk.top_k(table.union(table.limit(20)), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == sql(rows, "op5_segment_topk")
    assert segment_topk.top_k(table.limit(0), F.col("id") % 100 == 0).count() == 0


def test_bounds_lie_above_the_product():
    r = np.random.default_rng(6)
    q, x = r.integers(-900, 900, (30, 50)).astype(float), r.integers(-900, 900, (40, 50)).astype(float)
    before = None
    for segments in segment_topk.RESOLUTIONS:
        bound = segment_topk.statistics(q, segments) @ segment_topk.statistics(x, segments).T
        assert (bound >= q @ x.T - 1e-6).all()
        assert before is None or (bound <= before + 1e-6).all()
        before = bound


def test_products_beyond_doubles_stay_exact():
    big = np.array([[2.0**40, 3.0], [2.0**40, 1.0]])
    assert segment_topk._exact(big, big).tolist() == [[(1 << 63) - 1] * 2] * 2
    mid = np.array([[2.0**30, 3.0]])
    assert segment_topk._exact(mid, mid).tolist() == [[(1 << 60) + 9]]


def test_envelopes_hold_what_their_vectors_reach():
    r = np.random.default_rng(8)
    queries = r.integers(-900, 900, (25, 37)).astype(float)
    blocks = [(r.integers(-900, 900, 37) + r.integers(-90, 90, (20, 37))).astype(float) for _ in range(12)]
    best = np.stack([(queries @ b.T).max(axis=1) for b in blocks], axis=1)
    envelopes = np.stack([segment_topk.envelope(b) for b in blocks])
    for share in (0.2, 0.5, 0.9):
        least = np.quantile(best, share, axis=1)
        stays = segment_topk.reachable(queries, least, envelopes)
        assert stays[best >= least[:, None]].all()
    assert not stays.all()  # and some blocks are dropped


def like_vectors(clusters=60, each=50, d=64, noise=0.15, seed=9):
    """Groups of like vectors, in random order."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, d))
    x = (centres[:, None, :] + noise * r.normal(size=(clusters, each, d))).reshape(-1, d)
    x = x[r.permutation(len(x))]
    return np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True))


def test_bounds_drop_most_pairs_of_like_vectors():
    x = like_vectors()
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 20)
    true = x[asked] @ x.T
    true[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(true, axis=1)[:, -10]
    tally = {}
    order = np.argsort(x[asked] @ x[0], kind="stable")
    q, found, scores = segment_topk.best_of_block(asked[order], x[asked][order], ids, x, 10, least[order], tally)
    assert tally["scored"] < 0.05 * tally["pairs"]
    one = {}
    segment_topk.best_of_block(asked[:50], x[asked[:50]], ids, x, 10, least[:50], one)
    assert one["pairs"] >= one[1] >= one[4] >= one[16] == one["scored"]
    want = sorted((int(a), int(b), int(true[i, b])) for i, a in enumerate(asked) for b in np.lexsort((ids, -true[i]))[:10])
    assert sorted(zip(q.tolist(), found.tolist(), scores.tolist(), strict=True)) == want


def test_ties_at_the_last_rank_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(segment_topk, "BLOCK", 16)
    rows = [(k, [1.0, 0.0] if k % 3 else [0.5, 0.0]) for k in range(100)]
    got = segment_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=7)
    want = [k for k in range(100) if k % 3 and k]
    assert {q: [r.vec_id for r in sorted(got.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)} == {0: want[:7], 50: [k for k in want if k != 50][:7]}


def test_links_components_and_recall(spark, rows, table, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 32)
    got = sorted(map(tuple, pivot_index.near_duplicates(table.union(table.limit(20))).collect()), key=str)
    want = sql(rows, "op8_pivot_index")
    assert [g[0] for g in got] == [w[0] for w in want]
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found >= 0.9 * true
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    hot = {g[2] for g in got if g[0] is not None and 1000 <= g[0] < 1150}
    assert len(hot) == 1
    odd = {g[0]: g for g in got if g[0] is None or 900 <= g[0] < 907}
    assert all(g[1] == 0 and g[2] == g[0] and g[3] for g in odd.values())
    assert pivot_index.near_duplicates(table.limit(0)).count() == 0


def test_a_link_counts_in_one_list():
    left = np.array([[1, 2, 5, 9], [3, 1, 5, 9], [1, 2, 4, -1], [5, 2, 1, 8]], dtype=np.int16)
    right = np.array([[1, 5, 2, 7], [1, 5, 8, 3], [1, 7, 8, -1], [9, 8, 7, 1]], dtype=np.int16)
    # 1 and 2 shared and 1 the least list; 1, 3 and 5; only 1; shared pivots, but no list of both
    assert pivot_index.counts_here(1, -1, left, right).tolist() == [True, True, False, False]
    assert pivot_index.counts_here(5, -1, left, right).tolist() == [False] * 4
    assert pivot_index.counts_here(1, 2, left, right).tolist() == [True, False, False, False]
    assert pivot_index.counts_here(1, 3, left, right).tolist() == [False, True, False, False]


def test_cut_lists_and_two_levels_find_what_whole_lists_do(spark, rows, table, monkeypatch):
    usual = sorted(map(tuple, pivot_index.near_duplicates(table).collect()), key=str)
    monkeypatch.setattr(pivot_index, "BLOCK", 8)
    monkeypatch.setattr(pivot_index, "LONG", 2)
    assert sorted(map(tuple, pivot_index.near_duplicates(table).collect()), key=str) == usual
    monkeypatch.setattr(pivot_index, "MOST_PIVOTS", 8)
    monkeypatch.setattr(pivot_index, "OWN_PIVOTS", 12)
    deep = sorted(map(tuple, pivot_index.near_duplicates(table).collect()), key=str)
    want = sql(rows, "op8_pivot_index")
    assert sum(g[1] for g in deep) >= 0.9 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(deep, want, strict=True))


def test_recall_of_links_just_above_the_threshold(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = pivot_index.near_duplicates(table).collect()
    assert sum(row.n_links for row in got) >= 0.95 * 3000
    assert all(row.n_links <= 1 and row.component_id in (row.vec_id, row.vec_id - 1500) for row in got)
