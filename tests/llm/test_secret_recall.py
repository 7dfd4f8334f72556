"""Recall of the token-efficiency test on planted random strings, and its precision on long words."""

import random
import string

import public_tokenizers
import pytest

from sparkloom.llm import secrets

VOCABULARY = secrets._vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
BASE62, LETTERS = string.ascii_letters + string.digits, string.ascii_letters


@pytest.mark.parametrize(("alphabet", "length", "least"), [(BASE62, 16, 0.98), (BASE62, 20, 0.99), (LETTERS, 16, 0.98), (LETTERS, 24, 0.99), (string.ascii_lowercase, 24, 0.88), (string.ascii_uppercase, 24, 0.97)])
def test_random_strings_are_found(alphabet, length, least):
    r = random.Random(length)
    found = 0
    for _ in range(500):
        key = "".join(r.choice(alphabet) for _ in range(length))
        found += secrets.random_spans(f"see {key} there", [], VOCABULARY, 2.0, frozenset()) == [("random", 4, 4 + length)]
    assert found >= least * 500


WORDS = "Donaudampfschifffahrtsgesellschaft getElementsByClassName antidisestablishmentarianism Bundesausbildungsfoerderungsgesetz anticonstitutionnellement electroencefalografista MAXIMUMPERMITTEDVALUE Verkehrsinfrastrukturfinanzierungsgesellschaft"


@pytest.mark.parametrize("word", WORDS.split())
def test_long_words_are_left_alone(word):
    assert not secrets.random_spans(f"see {word} there", [], VOCABULARY, 2.0, frozenset())


def test_least_length_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "see xK9v2Lq8ZtR4mWp1 and QzXvKjWqPfBdGhTnRm")], "doc_id long, text string")
    found = {n: [tuple(s) for s in secrets.find_secrets(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, least_length=n).first().spans] for n in (16, 18, 20)}
    assert found == {16: [("random", 4, 20), ("random", 25, 43)], 18: [("random", 25, 43)], 20: []}
