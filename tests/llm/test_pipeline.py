"""The pipeline stage by stage against brute force, on documents of its own."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, score double, spans string, `a.b` int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    syllables = {"en": ["the", "ing", "er", "tion", "ou", "an"], "de": ["sch", "ei", "und", "ung", "ch", "en"]}

    def words(lang, n):
        return ["".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)]

    rows, labels = [], []
    for k in range(160):
        lang, good = ("en" if k % 3 else "de"), k % 4 != 0
        text = " ".join(words(lang, 80)) if good else " | ".join(w + "!!" for w in words(lang, 60))
        rows.append((k, text, lang))
        labels.append((k, int(good), 0))
    copy = rows[1][1].split()
    copy[40] = "different"
    rows += [(200, " ".join(copy), "en"), (201, rows[2][1] + " mail me at a.b@c.example.com or 10.0.0.1", "en"), (202, rows[2][1] + " mail me at a.b@c.example.com or 10.0.0.1", "en"), (203, None, "en"), (204, "", None), (205, "12 34", None), (2, rows[2][1], "en"), (None, "the ing er tion ou an the er ing", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, lang, "s", len(t or ""), "x", 0.0, "y", 1) for i, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = lambda name: {r.doc_id for r in kept[name]}
    good = {k for k in range(160) if k % 4 != 0}
    assert good <= ids("quality") and not ids("quality") & {k for k in range(160) if k % 4 == 0}
    assert good <= ids("language") and not ids("language") & {203, 204, 205}
    # 200 is a near copy of 1 and 202 a copy of 201; row 2 is repeated; 201 says more than 2 but is within 0.8.
    dedup = [r.doc_id for r in kept["near_dedup"]]
    assert len(dedup) == len(set(dedup)) and 1 in dedup and not {200, 202} & set(dedup) and good <= set(dedup)
    before, after = {r.doc_id: r for r in kept["near_dedup"]}, {r.doc_id: r for r in kept["pii"]}
    assert before.keys() == after.keys()
    for k, r in after.items():
        plain = re.sub(r"[\w.]+@[\w.]+", "<EMAIL>", re.sub(r"\b10\.0\.0\.1\b", "<IP>", before[k].text))
        assert r.text == plain and r.n_chars == len(plain)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {k: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in after.items()}
    packed = {}
    for r in kept["packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == total[r.doc_id]
    assert packed == total


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_a_long_text_goes_through_whole(spark, folder, tmp_path):
    r = random.Random(3)
    syllables = ["the", "ing", "er", "tion", "ou", "an"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 5))) for _ in range(450_000)]
    long = " ".join(words) + " write to long.text@example.com now"
    assert len(long) > 4_000_000
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(900, long, "en", "s", len(long), "x", 0.0, "y", 1), (901, long, "en", "s", len(long), "x", 0.0, "y", 1)], SCHEMA)
    docs = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "pii":
            kept = {row.doc_id: row.text for row in docs.where("doc_id >= 900").collect()}
            assert kept == {900: long.replace("long.text@example.com", "<EMAIL>")}  # its copy has gone
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(kept[900], add_special_tokens=False).ids
    pieces = docs.where("doc_id = 900").orderBy("start").select("start", "length", "doc_tokens").collect()
    assert sum(p.length for p in pieces) == len(ids) + 1 == pieces[0].doc_tokens and pieces[-1].start + pieces[-1].length == len(ids) + 1


def test_a_stage_that_rejects_everything(spark, folder, tmp_path):
    """Good texts without a letter: quality keeps them, language rejects all, and the later stages get none."""
    docs = spark.createDataFrame([(k, " ".join(str(k * j) for j in range(1, 60)), "en", "s", 9, "x", 0.0, "y", 1) for k in range(120)], SCHEMA)
    labels = [(k, 1, 0) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/sf/labels.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"{tmp_path}/sf").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.count()
    assert left == {"quality": 120, "language": 0, "near_dedup": 0, "pii": 0, "packing": 0}
