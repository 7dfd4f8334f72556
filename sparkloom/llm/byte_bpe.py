"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end the piece's BPE encoding, so
a table of that one last token per prefix is the whole encoding: walking it backwards yields the
tokens, extending it by a byte looks only at the tokens that end there, and an edit keeps every entry
before it. A token may follow the last token of the prefix before it iff no merge would ever cross
the seam between the two, which :meth:`PrefixBpe.seam_holds` finds by undoing both sides' merges from
the latest to the earliest.

Defined results: a null or empty text has no tokens; texts of any length are encoded whole; equal
rows are encoded alike and each is returned; only the id and the text column are read, so further
columns of any name do no harm; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_arrow, text_slices

#: Encodings of words kept by each worker process.
CACHE_WORDS = 500_000
#: Texts encoded together: the more, the more prefixes are shared.
SLICE_ROWS = 1536
#: Words longer than this are encoded each time they occur.
CACHE_CHARS = 48
#: Answers of the seam test kept by each worker process.
CACHE_SEAMS = 400_000

#: Unicode's White_Space property (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WORDS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space before a space, where cutting before each space would be wrong.
_PAIRS = tuple(c + " " for c in SPACE if c.isascii())
_WIDE_PAIR = re.compile("[" + "".join(c for c in SPACE if not c.isascii()) + "] ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Decoder:
    """Ids to bytes; needs no more than each token's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    @classmethod
    @functools.lru_cache(maxsize=2)
    def load(cls, path: str) -> Decoder:
        return cls(read_ranks(path))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def release() -> None:
    PrefixBpe.load.cache_clear()
    Decoder.load.cache_clear()


class PrefixBpe:
    """A vocabulary of ``bytes -> rank`` in which rank order is merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.usable: dict[bytes, int] = {}
        self._seams: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.usable[token] = rank
                continue
            for cut in range(1, len(token)):
                left, right = self.usable.get(token[:cut]), self.usable.get(token[cut:])
                if left is not None and right is not None and max(left, right) < rank and self._seam_holds(left, right, rank):
                    self.halves[rank] = left, right
                    self.usable[token] = rank
                    break
        #: Every tail of a token, with the token's rank where the tail is one itself, else -1.
        self._tails = {token[k:]: self.usable.get(token[k:], -1) for token in self.usable for k in range(len(token))}
        self._seams.clear()

    @classmethod
    @functools.lru_cache(maxsize=2)
    def load(cls, path: str) -> PrefixBpe:
        return cls(read_ranks(path))

    def _seam_holds(self, left: int, right: int, before: float) -> bool:
        """Whether no merge of rank under ``before`` crosses from ``left`` into ``right``.

        Undo the later of the two sides' last merges, again and again; whatever pair then meets at
        the seam stood there until that merge, and would have been joined if its rank came first.
        At equal ranks the merge further left comes first.
        """
        text, ranks, halves = self.bytes_of, self.ranks, self.halves
        while True:
            joined = ranks.get(text[left] + text[right])
            if joined is not None and joined < before:
                return False
            undo_left, undo_right = halves.get(left), halves.get(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                before, left = left, undo_left[1]
            else:
                before, right = right + 1, undo_right[0]

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes is again these two tokens."""
        key = left << 20 | right
        found = self._seams.get(key)
        if found is None:
            if len(self._seams) >= CACHE_SEAMS:
                self._seams.clear()
            found = self._seams[key] = self._seam_holds(left, right, float("inf"))
        return found

    def extend(self, piece: bytes, last: list[int], start: list[int]) -> None:
        """Append to the tables of a prefix's last token and that token's start until they cover ``piece``.

        ``last[i]`` and ``start[i]`` belong to the prefix of ``i + 1`` bytes.
        """
        tail_rank, seams = self._tails.get, self._seams
        for end in range(len(last) + 1, len(piece) + 1):
            begin = end
            while begin:  # exactly one token that ends here is valid, so the first found is it
                begin -= 1
                token = tail_rank(piece[begin:end], -2)
                if token >= 0:
                    if not begin:
                        break
                    holds = seams.get(last[begin - 1] << 20 | token)
                    if holds or (holds is None and self.seam_holds(last[begin - 1], token)):
                        break
                elif token == -2:
                    raise ValueError("the vocabulary lacks a single byte of the text")
            start.append(begin)
            last.append(token)

    @staticmethod
    def walk(last: list[int], start: list[int]) -> list[int]:
        """The tokens that the tables stand for."""
        out = []
        at = len(last)
        while at:
            out.append(last[at - 1])
            at = start[at - 1]
        out.reverse()
        return out

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Encode distinct pieces in sorted order, each appended to the prefix it shares with the one before."""
        out: dict[bytes, list[int]] = {}
        before, last, start = b"", [], []
        for piece in sorted(set(pieces)):
            whole = self.ranks.get(piece)
            if whole is not None and piece not in self.usable:
                out[piece] = [whole]  # a vocabulary entry that no merges reach stands only for the whole piece
                continue
            keep = 0
            for a, b in zip(before, piece, strict=False):
                if a != b:
                    break
                keep += 1
            del last[keep:], start[keep:]
            self.extend(piece, last, start)
            out[piece] = self.walk(last, start)
            before = piece
        return out



class EditableEncoding:
    """One text's encoding, kept exact under appends and edits without encoding it afresh.

    The pattern looks at most two characters past a piece, so pieces ending well before an edit stay;
    after it, pieces are taken over again from the first place where old and new cuts coincide.
    """

    REACH = 3

    def __init__(self, bpe: PrefixBpe, pattern: str, text: str = ""):
        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self.text, self.ends, self.ids = "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> int:
        """Put ``new`` in place of ``text[begin:end]``; returns how many pieces were encoded."""
        if not 0 <= begin <= end <= len(self.text):
            raise IndexError("the edit lies outside the text")
        keep = 0
        while keep < len(self.ends) and self.ends[keep] + self.REACH <= begin:
            keep += 1
        shift = len(new) - (end - begin)
        old_ends = {at + shift: k for k, at in enumerate(self.ends) if at >= end}
        text = self.text[:begin] + new + self.text[end:]
        at = self.ends[keep - 1] if keep else 0
        fresh: list[tuple[int, bytes]] = []
        rest = len(self.ends)
        while at < len(text):
            if at >= begin + len(new) and at in old_ends:
                rest = old_ends[at] + 1
                break
            at_end = self.pattern.match(text, at).end()
            fresh.append((at_end, text[at:at_end].encode()))
            at = at_end
        found = self.bpe.encode_pieces(piece for _, piece in fresh)
        self.ids[keep:rest] = [found[piece] for _, piece in fresh]
        self.ends[keep:] = [e for e, _ in fresh] + [e + shift for e in self.ends[rest:]]
        self.text = text
        return len(fresh)

    def token_ids(self) -> list[int]:
        return [x for piece in self.ids for x in piece]


def words_of(text: str) -> tuple[list[str], list[str]]:
    """Cut a text after each word: words as they stand, and words that a space leads, without it.

    No piece of the pattern runs from a non-space into a space, and what precedes such a place can't
    change the pieces after it; so the pieces of a text are those of its words, white space leading.
    """
    if not text:
        return [], []
    if text[0] == " " or text[-1] == " " or any(pair in text for pair in _PAIRS) or (not text.isascii() and _WIDE_PAIR.search(text)):
        return _WORDS.findall(text), []
    rest = text.split(" ")
    return [rest.pop(0)], rest


class TextEncoder:
    """Whole texts to token ids; distinct words are encoded once and kept, up to a bound."""

    def __init__(self, bpe: PrefixBpe, pattern: str):
        self.bpe, self.pattern = bpe, regex.compile(pattern)
        #: Only of the public pattern is it known that texts may be cut after words first.
        self.by_words = pattern == public_tokenizers.PATTERN
        #: Encodings of strings as they stand, and of strings with a space before them.
        self.plain: dict[str, bytes] = {}
        self.led: dict[str, bytes] = {}

    def _known(self, piece: str) -> bytes | None:
        return self.led.get(piece[1:]) if piece[0] == " " else self.plain.get(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as native 32-bit integers."""
        if not self.by_words:
            cut = [[m.group().encode() for m in self.pattern.finditer(text)] for text in texts]
            found = {piece: array("i", ids).tobytes() for piece, ids in self.bpe.encode_pieces(set().union(*cut)).items()}
            return [b"".join(map(found.__getitem__, pieces)) for pieces in cut]
        cut = [words_of(text) for text in texts]
        first = set().union(*(words for words, _ in cut))
        new_plain = {word for word in first if word[0] != " "} - self.plain.keys()
        new_led = set().union({word[1:] for word in first if word[0] == " "}, *(words for _, words in cut)) - self.led.keys()
        # A word of letters is one piece; others are cut by the pattern, and their pieces kept as well.
        letters = [word for word in new_plain if word.isalpha()] + [" " + word for word in new_led if word.isalpha()]
        mixed = {word: self.pattern.findall(word) for word in [*(w for w in new_plain if not w.isalpha()), *(" " + w for w in new_led if not w.isalpha())]}
        pieces = {piece for found in mixed.values() for piece in found if self._known(piece) is None}
        pieces.update(letters)
        for piece, ids in self.bpe.encode_pieces(map(str.encode, pieces)).items():
            self._keep(piece.decode(), array("i", ids).tobytes())
        for word, found in mixed.items():
            self._keep(word, b"".join(map(self._known, found)))
        led = self.led.__getitem__
        encoded = [b"".join(map(self._known, words)) + b"".join(map(led, rest)) for words, rest in cut]
        full = len(self.plain) + len(self.led) > CACHE_WORDS
        for word in [*pieces, *mixed]:
            if full or len(word) > CACHE_CHARS:
                (self.led if word[0] == " " else self.plain).pop(word[1:] if word[0] == " " else word, None)
        return encoded

    def _keep(self, word: str, ids: bytes) -> None:
        if word[0] == " ":
            self.led[word[1:]] = ids
        else:
            self.plain[word] = ids


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, token_ids array<int>`` of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(PrefixBpe.load(ranks_path), pattern)
        for part, texts in text_slices(batches, 1, SLICE_ROWS):
            encoded = encoder.encode(texts)
            offsets = np.zeros(len(texts) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, "token_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, token_ids array<int>", "byte_bpe", release)


def decode_documents(df: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """The rows of ``df`` with a ``decoded`` binary column made from the token ids (null ids: empty)."""
    names = df.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Decoder.load(ranks_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(at)
                decoded = [bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, run, f"{fields}, decoded binary", "byte_bpe", release)


def digests(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Count and digests of the ids, and of the bytes that they decode to."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return decode_documents(encoded, ranks_path).select(
        id_col,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
