"""Queries over the whole of their tables, against brute force on small fixtures."""

import numpy as np
import pytest

import __spark_entry__ as entry
from sparkloom.operators import retrieval

QUERIES = entry.queries()


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_text_cursor_deals_out_whole_texts(spark, tmp_path):
    texts = {1: "é" * 150 + "x" * 851, 2: "short", 3: "", 4: "ab" * 300}
    rows = [(conv, turn, "user", text if turn == 0 else "later") for conv, text in texts.items() for turn in range(conv + 1)]
    write(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")
    pieces = {}
    for row in sorted(QUERIES["text_cursor"](spark, str(tmp_path)).collect()):
        pieces.setdefault(row.conv_id, []).append(row.piece)
    assert {conv: "".join(x) for conv, x in pieces.items()} == texts
    assert [len(x) for x in pieces[4]] == [240, 120, 120, 0, 120]


def test_cosine_batch_asks_every_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 70)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    vectors = np.random.default_rng(3).normal(size=(451, 8))
    vectors[7] = vectors[50] * 2  # as near to 50 as itself
    vectors[9] = 0
    write(spark, tmp_path, "embeddings", [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None]), (1050, []), (1002, [float("inf")] * 8), (1003, [float("nan")] * 8)], "vec_id long, embedding array<double>")
    got = {}
    for row in sorted(QUERIES["cosine_batch"](spark, str(tmp_path)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
    assert got.pop(1050) == [(1050, 0.0)]  # an empty vector has only itself to be compared to
    assert sorted(got) == list(range(0, 451, 50))
    for q, found in got.items():
        scores = (unit @ unit[q]).round(6)
        best = sorted(range(451), key=lambda x: (-scores[x], x))[:3]
        assert [x for x, _ in found] == best and [s for _, s in found] == pytest.approx([scores[x] for x in best], abs=2e-6)
    assert [x for x, _ in got[50]][:2] == [7, 50]


def test_cosine_batch_takes_more_than_ten_thousand_queries(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<double>")
    queries = spark.range(10_001).selectExpr("id AS n", "array(1D, id / 20000D) AS asked")
    out = retrieval.cosine_batch(docs, "id", "v", queries, "n", "asked", 1)
    assert [tuple(r) for r in out.groupBy("id", "rank").count().collect()] == [("a", 1, 10_001)]


def test_routed_lookup_asks_every_customer(spark, tmp_path):
    write(spark, tmp_path, "customer", [(k, f"customer {k}") for k in range(120)], "c_custkey long, c_name string")
    write(spark, tmp_path, "supplier", [(k, f"supplier {k}") for k in range(3)], "s_suppkey long, s_name string")
    got = {r.id: r.found for r in QUERIES["routed_lookup"](spark, str(tmp_path)).collect()}
    assert got == {f"c:{k}": f"customer {k}" for k in range(120)} | {f"s:{k}": f"supplier {k}" for k in range(3)} | {"x:1": None}


def test_bootstrap_ci_draws_as_often_as_the_reference(spark, tmp_path):
    discounts = np.random.default_rng(5).integers(0, 11, size=(3, 12, 4)) / 100  # by flag, supplier and line
    rows = [("ANR"[f], s, float(x)) for f in range(3) for s in range(12 if f < 2 else 1) for x in discounts[f, s]]
    write(spark, tmp_path, "lineitem", rows, "l_returnflag string, l_suppkey long, l_discount double")
    got = {r.l_returnflag: (r.estimate, r.ci_low, r.ci_high) for r in QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()}
    want = {"R": (discounts[2, 0].mean(),) * 3}
    for f in range(2):
        means = np.sort(discounts[f].mean(axis=1))
        draws = np.random.default_rng(20260625).choice(means, size=(1000, 12), replace=True).mean(axis=1)
        want["ANR"[f]] = means.mean(), np.quantile(draws, 0.025), np.quantile(draws, 0.975)
    assert sorted(got) == sorted(want)
    for flag, figures in want.items():
        assert got[flag] == pytest.approx(figures, abs=1e-12), flag


def test_segment_assignment_takes_every_order(spark, tmp_path):
    orders = {c: sorted({(k * 31 + c * 7) % 500 for k in range(c * 3)}) for c in range(1, 6)}
    write(spark, tmp_path, "orders", [(c, k) for c, keys in orders.items() for k in keys], "o_custkey long, o_orderkey long")
    got = {(r.o_custkey, r.at): r.n for r in QUERIES["segment_assignment"](spark, str(tmp_path)).collect()}
    assert got == {(c, k + 37): next((n for n, end in enumerate(keys, 1) if end >= k + 37), len(keys)) for c, keys in orders.items() for k in keys}


TEXTS = {1: "Titel über\nthe license, 10 of 1: the end\n" * 3, 2: "", 3: None, 4: "Titel über\nder 1", 5: "7", 6: "x" * 5000, 7: "a@b [x]"}


def write_documents(spark, folder):
    write(spark, folder, "documents", list(TEXTS.items()), "doc_id long, text string")


def test_text_pieces_of_documents(spark, tmp_path):
    write_documents(spark, tmp_path)
    got = {r.doc_id: r.pieces for r in QUERIES["text_pieces"](spark, str(tmp_path)).collect()}
    assert got == {k: [None] * 3 if x is None else [x[len(x) * i // 3 : len(x) * (i + 1) // 3] for i in range(3)] for k, x in TEXTS.items()}


def test_masked_terms_of_documents(spark, tmp_path):
    write_documents(spark, tmp_path)
    got = {r.doc_id: r for r in QUERIES["masked_terms"](spark, str(tmp_path)).collect()}
    assert {k: r.restored for k, r in got.items()} == TEXTS
    assert got[1].masked.startswith("Titel über\n[[0]], [[1]] of [[2]]: [[3]] end\n") and got[1].n == 12
    assert got[4].masked == "Titel über\n[[0]] [[1]]" and got[7].masked == "a[[0]]b [x]" and got[6].n == 0


def test_required_documents_by_first_line(spark, tmp_path):
    write_documents(spark, tmp_path)
    got = sorted((tuple(r) for r in QUERIES["required_documents"](spark, str(tmp_path)).collect()), key=str)
    # 7 is the title of 5, which goes before the id
    assert got == sorted([("1", 1), ("", 2), ("3", 3), ("Titel über", 1), ("5", 5), ("x" * 5000, 6), ("7", 5), ("none", None)], key=str)


TURNS = [(1, 0, "user", "Hello # there"), (1, 1, "assistant", "# Facts\n- é\n\n### user\nend"), (1, 2, "user", ""), (2, 0, "user", "only " * 900), (2, 1, "assistant", "y"), (2, 2, "user", "z" * 7), (2, 3, "assistant", "w")]


def test_proportional_transcript_of_conversations(spark, tmp_path):
    write(spark, tmp_path, "conversations", TURNS, "conv_id long, turn int, role string, text string")
    got = sorted(map(tuple, QUERIES["proportional_transcript"](spark, str(tmp_path)).collect()))
    want = []
    for conv in (1, 2):
        for pair in (0, 1):
            texts = [x for c, turn, _, x in TURNS if c == conv and turn // 2 == pair]
            whole, n = " ".join(texts), 3 * len(texts)
            cuts = [-(-len(whole) * k // n) for k in range(n + 1)]
            want += [(conv, pair * 8 + k, whole[cuts[k] : cuts[k + 1]]) for k in range(n)]
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == [x[2] for x in want]


def test_markdown_sections_of_conversations(spark, tmp_path):
    write(spark, tmp_path, "conversations", TURNS, "conv_id long, turn int, role string, text string")
    got = sorted(map(tuple, QUERIES["markdown_sections"](spark, str(tmp_path)).collect()))
    first = [("001_conversation_1", "Conversation", "# Conversation"), ("002_user_1", "user", "## user\nHello # there"), ("003_assistant_1", "assistant", "## assistant"), ("004_facts_1", "Facts", "# Facts\n- é\n"), ("005_user_2", "user", "### user\nend"), ("006_user_3", "user", "## user\n")]
    assert [x[1:] for x in got if x[0] == 1] == first
    assert "\n".join(x[3] for x in got if x[0] == 2) == "# Conversation\n" + "\n".join(f"## {role}\n{text}" for c, _, role, text in TURNS if c == 2)
