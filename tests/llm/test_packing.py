import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 12345])
def test_pieces_are_descending_powers_of_two(n):
    lengths = packing.decompose(n, 4096)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 4096 for x in lengths)
    assert len(set(lengths) - {4096}) == len([x for x in lengths if x < 4096])


def test_words_encode_as_the_whole_text_does():
    plain, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "b", "the", "É", "e", "日", "😀", "'s", "'", "1", "\x1c", " ", "İ", "ſ", "!!", "́", "-", "ß", "Σ", "<|endoftext|"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for text, got in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(got, dtype=np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|startoftext|><|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>\n<|endoftext|>", "e<|startoftext|>\u0301"])
def test_special_tokens_in_a_text_are_what_the_library_makes_of_them(text):
    expected = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordTokenizer(PATH).encode([text])[0], dtype=np.uint32).tolist() == expected
    assert {49406, 49407} & set(expected)


def test_pieces_cover_each_document_once(spark):
    plain = Tokenizer.from_file(PATH)
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello, world! " * 900, "x"), (3, "Hello, world! " * 900, "x"), (4, "one", "x"), (5, "x <|endoftext|> " + "Long texts, whole. " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs, PATH, 2).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    texts = {r[0]: r[1] or "" for r in rows}
    for doc, text in texts.items():
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        copies = 2 if doc == 3 else 1
        assert sum(r.length for r in pieces) == copies * len(ids)
        assert doc != 5 or (len(ids) > 3 * 4096 and [r.length for r in pieces[:3]] == [4096] * 3)
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert list(r.token_ids) == part and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            assert r.length & (r.length - 1) == 0 and r.length <= 4096
    assert packing.pack_documents(docs.limit(0), PATH, 2).count() == 0


def test_buckets_are_folders_of_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * k) for k in range(20)], "doc_id long, text string")
    packing.write_buckets(packing.pack_documents(docs, PATH, 2), f"{tmp_path}/buckets")
    back = spark.read.parquet(f"{tmp_path}/buckets/length=4")
    assert back.count() > 0 and {len(r.token_ids) for r in back.collect()} == {4}
