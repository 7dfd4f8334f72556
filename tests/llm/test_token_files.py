"""Token files: the coding against plain round trips, the files against the tokenizer library row by row."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import simple8b, token_files
from sparkloom.llm.queries import op12_token_files
from tests.conftest import DATA

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("highest", [1, 2, 4, 16, 1000, 50_000, 1 << 31, (1 << 60) - 1, 1 << 63])
def test_coding_round_trip(highest):
    rng = np.random.default_rng(highest % 1009)
    lengths = np.array([0, 1, 5, 1024, 0, 1025, 3000])
    ids = rng.integers(0, highest, int(lengths.sum()), dtype=np.uint64)
    blocks, per_stretch = simple8b.block_lengths(lengths)
    assert per_stretch.tolist() == [0, 1, 1, 1, 0, 2, 3] and blocks.max() == 1024
    words, per_block = simple8b.encode(ids, blocks)
    assert (simple8b.decode(words) == ids).all()
    offsets, places = np.concatenate([[0], np.cumsum(per_block)]), np.concatenate([[0], np.cumsum(blocks)])
    for k in range(len(blocks)):
        assert (simple8b.decode(words[offsets[k] : offsets[k + 1]]) == ids[places[k] : places[k + 1]]).all()


def test_escapes_stand_anywhere():
    special = np.array([2**64 - 1, 2**60 - 1, 2**60 - 2, 2**60, 2**53 + 1, 0, 7], dtype=np.uint64)
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = special[rng.integers(0, len(special), rng.integers(1, 60))]
        words, per_block = simple8b.encode(ids, np.array([len(ids)]))
        assert per_block.sum() == len(words) and (simple8b.decode(words) == ids).all()


def test_small_ids_take_few_words():
    words, _ = simple8b.encode(np.zeros(960, dtype=np.uint64), np.array([960]))
    assert len(words) == 4
    words, _ = simple8b.encode(np.full(1000, 30_000, dtype=np.uint64), np.array([1000]))
    assert len(words) == 250


def expected(rows):
    tokenizer = Tokenizer.from_file(WORDS)
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_words_and_marks_encode_as_in_the_text():
    rng = np.random.default_rng(11)
    parts = ["Été", "STRASSE", "straße", "ÿ", "Ÿ", "ab", "İ", "J\u030c", "'s", "don't", "x2", ".", ",", "!?", "###", ";:", "...", "n\u0303", "Σας", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "漢", "-", "_"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(3000)]
    tokenizer = token_files.BatchTokenizer(WORDS)
    ids, lengths = tokenizer.encode_array(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(lengths)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, lengths, strict=True)] == want


def test_query_equals_the_library(spark, sf_dir):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = op12_token_files(spark, sf_dir).orderBy("start").collect()
    assert [tuple(r) for r in got] == [x[:4] for x in expected(rows)]


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_WORDS", 64)
    rows = [(5, "two words"), (5, "two words"), (5, "other"), (None, "no id"), (7, None), (8, ""), (9, "a b\nc\td  e" * 60_000), (1, "<|endoftext|> été 漢字 x2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("p"), "words": F.lit(1), "a.b": F.lit(2), "TIE": F.lit(3), "id": F.lit("x")})
    token_files.write_token_files(df.repartition(3), f"file://{tmp_path}/t", WORDS, 1)
    got = token_files.read_documents(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5, 7, 8, 9]
    again = expected([(r.doc_id, t) for r, t in zip(got, ["no id", rows[-1][1], *(("two words", "two words", "other") if got[2].token_ids == got[3].token_ids else ("other", "two words", "two words")), None, "", rows[6][1]], strict=True)])
    assert [tuple(r) for r in got] == again
    stream = [x for r in got for x in r.token_ids]
    for start, length in ((0, 5), (3, 20), (17, 3000), (2047, 1), (len(stream) - 4, 100), (len(stream), 5), (4, 0)):
        found = token_files.read_stretch(spark, f"file://{tmp_path}/t", start, length).orderBy("start").collect()
        assert [x for r in found for x in r.token_ids] == stream[start : start + length]
    with pytest.raises(ValueError):
        token_files.read_stretch(spark, f"file://{tmp_path}/t", -1, 2)


def test_one_id_of_many_rows_is_split(spark, tmp_path):
    df = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    token_files.write_token_files(df.repartition(5), f"file://{tmp_path}/t", WORDS, 1)
    assert spark.read.parquet(f"file://{tmp_path}/t/segments").select("part").distinct().count() >= 1
    got = token_files.read_documents(spark, f"file://{tmp_path}/t", keep_ids=False)
    last = got.agg(F.count("*"), F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens"), F.countDistinct("start")).first()
    assert last[0] == last[3] == 4000 and last[1] == last[2]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(df, f"file://{tmp_path}/t", WORDS, 1)
    assert token_files.read_documents(spark, f"file://{tmp_path}/t").count() == 0
