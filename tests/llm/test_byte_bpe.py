import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sparkloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", "ing", "é", "日", "😀", "'s", "'re", "'", "1", "23", "\x1c", " ", "ab", "aaaa", "!!", "́", "ſ", "-", "--"]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.PrefixBpe.load(PATH)


@pytest.fixture(scope="module")
def plain(bpe):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(bpe, plain):
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    encoder = byte_bpe.TextEncoder(bpe, public_tokenizers.PATTERN)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert list(memoryview(got).cast("i")) == plain.encode_ordinary(text), text


def test_other_patterns_encode_as_the_library_does(bpe):
    pattern = r"\p{Lu}?\p{Ll}+|\p{Lu}+|\s?\p{N}{1,3}|[^\s\p{L}\p{N}]+|\s+"  # cuts inside words, by letter case
    plain = tiktoken.Encoding("cut", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(2)
    texts = ["".join(r.choice(PARTS + ["theThing", "ABCd", "123456"]) for _ in range(r.randint(0, 14))) for _ in range(500)]
    for text, got in zip(texts, byte_bpe.TextEncoder(bpe, pattern).encode(texts), strict=True):
        assert list(memoryview(got).cast("i")) == plain.encode_ordinary(text), text


def test_every_prefix_has_its_own_encoding(bpe, plain):
    piece = b"internationalizations"
    last, start = [], []
    for n in range(1, len(piece) + 1):
        bpe.extend(piece[:n], last, start)
        assert bpe.walk(last, start) == plain.encode_ordinary(piece[:n].decode())


def test_edits_keep_the_encoding_exact_and_local(bpe, plain):
    r = random.Random(2)
    text = byte_bpe.EditableEncoding(bpe, public_tokenizers.PATTERN, "the quick brown fox " * 100)
    encoded = 0
    for _ in range(200):
        begin = r.randint(0, len(text.text))
        encoded += text.replace(begin, min(len(text.text), begin + r.randint(0, 4)), "".join(r.choice(PARTS) for _ in range(r.randint(0, 3))))
        assert text.token_ids() == plain.encode_ordinary(text.text)
    text.append("'re done")
    assert text.token_ids() == plain.encode_ordinary(text.text)
    assert encoded / 200 < 12


def test_query_on_odd_rows(spark, plain):
    rows = [(1, None, 5), (2, "", 5), (3, " a  b\n", 5), (3, " a  b\n", 5), (None, "x" * 300_000 + " yé", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = byte_bpe.digests(byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for row in got:
        ids = plain.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert byte_bpe.digests(byte_bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0
