"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Natural words and identifiers are in a tokenizer's vocabulary as long tokens, random strings fall
apart into short ones. A long run of key-like characters is therefore reported as ``random`` if it has
few characters for each token, unless it is a known digest (by its length in hex digits, or listed) or
an identifier (a UUID, a number, words joined by separators) or a fixed pattern has found it already.
Runs of letters only may be long words, so they are held to a stricter ratio.

Limits: runs shorter than ``least_length`` aren't tested, and a random string counts as an identifier
if each of its parts between separators is all letters or all digits. The README gives measured recall.

Spans are in code points, ends exclusive. Defined results: null and empty texts have no spans; texts
of any length are scanned whole, in time proportional to their length; each of several equal rows is
returned; an empty table gives an empty table; only the id and the text column are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Cover, map_arrow, text_slices

#: The order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "random")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""")
_ASSIGN_WORDS = ("passw", "secret", "token", "key")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_JOINED_WORDS = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+|[0-9]+))+[+/_=-]*\Z")

#: The least length of a run that is tested, and the most characters for each token of a run of letters.
LEAST_LENGTH, MOST_OF_LETTERS = 16, 1.9


@functools.lru_cache(maxsize=8)
def _run(least_length: int) -> re.Pattern:
    return re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % least_length)


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(word in lower for word in _ASSIGN_WORDS):
            out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # Every access key and every long hex string lies in one long run of key-like characters.
    for run in _RUN.finditer(text):
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text, *run.span()) if m.end() - m.start() >= 20]
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text, *run.span())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def looks_random(string: str, vocabulary, most_chars_per_token: float, known: frozenset[str], most_of_letters: float = MOST_OF_LETTERS) -> bool:
    """The token-efficiency test, after digests and identifiers are set aside."""
    letters, digits = re.search("[A-Za-z]", string), re.search("[0-9]", string)
    if not letters or string in known:
        return False
    if (len(string) in DIGEST_LENGTHS and _DIGEST.match(string)) or _UUID.match(string) or _JOINED_WORDS.match(string):
        return False
    most = most_chars_per_token if digits else min(most_chars_per_token, most_of_letters)
    return len(string) < most * len(vocabulary.encode_ordinary(string))


def random_spans(
    text: str, taken: list[tuple[str, int, int]], vocabulary, most_chars_per_token: float, known: frozenset[str], least_length: int = LEAST_LENGTH, most_of_letters: float = MOST_OF_LETTERS
) -> list[tuple[str, int, int]]:
    out, cover = [], Cover(taken)
    for run in _run(least_length).finditer(text):
        start, end = run.span()
        if not cover.meets(start, end) and looks_random(run.group(), vocabulary, most_chars_per_token, known, most_of_letters):
            out.append(("random", start, end))
    return out


def find_secrets(
    df: DataFrame, ranks_path: str, pattern: str, most_chars_per_token: float = 2.0, known_digests: frozenset[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, most_of_letters: float = MOST_OF_LETTERS
) -> DataFrame:
    """``id, base_spans, spans`` of every row: those of the fixed patterns, and with the method's added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks_path, pattern)
        names = ("kind", "start", "end")
        for part, texts in text_slices(batches, 1):
            base = [base_spans(text) for text in texts]
            both = [sorted(found + random_spans(text, found, vocabulary, most_chars_per_token, known_digests, least_length, most_of_letters), key=lambda s: (s[1], KINDS.index(s[0]))) for text, found in zip(texts, base, strict=True)]
            columns = [pa.array([[dict(zip(names, s, strict=True)) for s in spans] for spans in x], SPANS) for x in (base, both)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, "base_spans", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, base_spans {SPAN_TYPE}, spans {SPAN_TYPE}")


def joined(spans: str):
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(spans: str, kinds: tuple[str, ...]) -> list:
    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return [count(kind).alias(f"n_{kind}") for kind in kinds]


def digests(found: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as one string."""
    return found.select(id_col, *counts("base_spans", kinds), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))
