"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail and IP addresses, card and phone numbers. These seeds induce lexical
patterns: the word before them, the two words before them, and the words before and behind them. Other
strings that look like identifiers are further instances. Patterns and instances form a graph, which
Spark scores in rounds. A pattern's confidence is the score that its distinct instances hold, over
their number plus all other words of the corpus that stand in the same context; an instance that
isn't scored yet counts neither way. An instance that is no seed is as sure as the best pattern at
each of its places (the places differ by the two words before), joined by noisy-or. Instances scored
high enough become ``id`` spans wherever they occur. A pattern counts only with so many distinct seeds
and such a share of seeds among its instances that chance hits of a fixed pattern (one in ten of long
numbers passes the cards' checksum) can't carry it.

Words are cut in one way for instances and for counting: at white space and behind ``: = # ( [ < " '``.
An instance stands for the word that it begins in; of several that begin in one word the first is
counted. How often a context holds any word takes a second pass over the texts. It looks words up in
a bitmap of fixed size made from the induced patterns; false hits go in the join that follows, so the
counts are exact at every size.

Spans are in code points, ends exclusive. Defined results: null and empty texts have no spans; texts
of any length are scanned whole, in time proportional to their length; each of several equal rows is
returned with the same spans; a value counts once for a pattern however often it is repeated; an empty
table gives an empty table; only the id and the text column are read, so further columns of any name
do no harm.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Cover, durable, fields_of, map_arrow, text_slices, unused
from sparkloom.llm.secrets import SPAN_TYPE, SPANS

#: The order of kinds among spans with one start.
KINDS = ("email", "ip", "card", "phone", "id")
#: A pattern needs so many distinct seeds and such a share of them, and an instance such a score to be reported.
LEAST_SEEDS, LEAST_SHARE, LEAST_SCORE, ROUNDS = 5, 0.25, 0.8, 3
#: 64-bit words of the patterns' bitmap: 2 MB, whatever the input.
BITMAP_BITS = 18

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9=_/@])[0-9](?:[().\x20/-]{0,2}[0-9])++(?![A-Za-z0-9_@])")
_TOKEN = re.compile(r"[0-9][A-Za-z0-9./-]*+")
_CODE = re.compile(r"[A-Za-z]{0,4}-?[0-9][A-Za-z0-9./-]{4,30}\Z")
_CODE_LEFT = re.compile(r"[A-Za-z]{1,4}-?\Z")
_LONG_HEX = re.compile(r"[0-9a-fA-F]{16,}")
#: What each digit adds when it is doubled.
_DOUBLED = str.maketrans("0123456789", "0246813579")
#: What the hashes of a context's words are multiplied by: alone, as the two before, and on either side.
_ALONE, _FAR, _NEAR, _LEFT, _RIGHT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_MASK = (1 << 64) - 1
#: Characters that part words, beside white space.
_OPENERS = ":=#([<\"'"


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(_DOUBLED)))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost matches of local part, @ and domain, without trying a long local part at each start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by start and then kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def identifier_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Strings that look like identifiers: numbers of 7 digits or more, codes with 5 or more."""
    found: list[tuple[int, int]] = []
    cover = Cover(taken)

    def add(start: int, end: int) -> None:
        if not cover.meets(start, end) and (not found or start >= found[-1][1]):
            found.append((start, end))

    for m in _NUMBER.finditer(text):
        if 7 <= m.end() - m.start() <= 34 and sum(map(str.isdigit, m.group())) >= 7:
            add(*m.span())
    cover = Cover([*taken, *(("id", *f) for f in found)])
    numbers, found = found, []
    for m in _TOKEN.finditer(text):
        if m.end() - m.start() > 34:
            continue
        left = _CODE_LEFT.search(text, max(0, m.start() - 5), m.start())
        start = left.start() if left else m.start()
        if start and (text[start - 1].isalnum() or text[start - 1] in "=_/@"):
            continue
        code = text[start : m.end()].rstrip("./-")
        if sum(map(str.isdigit, code)) >= 5 and _CODE.match(code) and not _LONG_HEX.search(code):
            add(start, start + len(code))
    return sorted(numbers + found)


def cut(text: str) -> str:
    """The text with white space for the characters that part words; offsets stay."""
    for opener in _OPENERS:
        text = text.replace(opener, " ")
    return text


def contexts(spaced: str) -> np.ndarray:
    """The contexts of each word of a :func:`cut` text: a column for the word before, the two before, both sides.

    Rows of the first words hold 0 where there is no word before; 0 stands for the word behind the last.
    """
    words = spaced.lower().split()
    out = np.zeros((len(words), 3), dtype=np.uint64)
    if len(words) > 1:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        after = np.append(h[2:], np.uint64(0))
        out[1:, 0] = h[:-1] * _ALONE
        out[2:, 1] = h[:-2] * _FAR + h[1:-1] * _NEAR
        out[1:, 2] = h[:-1] * _LEFT + after * _RIGHT
    return out.view(np.int64)


def instance_contexts(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, bool]]]:
    """For each span (by start) its contexts, and whether counting the corpus sees the span in it."""
    if not spans:
        return []
    spaced = cut(text)
    starts, at = [], 0
    for word in spaced.split():
        starts.append(spaced.index(word, at))
        at = starts[-1] + len(word)
    hashes = contexts(spaced)
    words = spaced.lower().split()
    out, before = [], -1
    for start, end in spans:
        own, behind = bisect_right(starts, start) - 1, bisect_left(starts, end)
        alone, pair, sides = hashes[own].tolist()
        whole = behind == own + 1
        if not whole and own:  # the word behind an instance of several words
            right = np.uint64(xxhash.xxh64_intdigest(words[behind])) if behind < len(words) else np.uint64(0)
            left = np.uint64(xxhash.xxh64_intdigest(words[own - 1]))
            with np.errstate(over="ignore"):
                sides = int((left * _LEFT + right * _RIGHT).view(np.int64))
        first = own != before
        out.append([(c, seen) for c, seen in ((alone, first), (pair, first), (sides, first and whole)) if c])
        before = own
    return out


_CANDS = "array<struct<start:int,end:int,value:long,place:long,ctxs:array<struct<ctx:long,seen:boolean>>,seed:boolean>>"


def _extract(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, __key, base_spans, cands`` of every row; cands are all instances with their contexts."""
    ctx = pa.list_(pa.struct([("ctx", pa.int64()), ("seen", pa.bool_())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("place", pa.int64()), ("ctxs", ctx), ("seed", pa.bool_())]))

    def instances(text: str, found: list[tuple[str, int, int]]) -> list[dict]:
        spans = sorted([(s, e, True) for _, s, e in found] + [(s, e, False) for s, e in identifier_spans(text, found)])
        out = []
        for (s, e, seed), near in zip(spans, instance_contexts(text, [(s, e) for s, e, _ in spans]), strict=True):
            place = near[1][0] if len(near) == 3 else near[0][0] if near else 0
            out.append({"start": s, "end": e, "value": xxhash.xxh64_intdigest(text[s:e].lower()) - (1 << 63), "place": place, "ctxs": [{"ctx": c, "seen": seen} for c, seen in near], "seed": seed})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1):
            found = [base_spans(text) for text in texts]
            base = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
            cands = [instances(text, spans) for text, spans in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(base, SPANS), pa.array(cands, cand)], [id_col, "__key", "base_spans", "cands"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col, row_key(id_col, text_col).alias("__key")), run, f"`{id_col}` {kind}, __key string, base_spans {SPAN_TYPE}, cands {_CANDS}")


def row_key(id_col: str, text_col: str):
    """One value for all rows of the same id and text."""
    return F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """A bit for each pattern; the collected rows are at most 2 ** BITMAP_BITS, whatever the input."""
    slot = F.shiftrightunsigned("ctx", 6).bitwiseAND((1 << BITMAP_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(ctx & 63 AS int))")
    out = np.zeros(1 << BITMAP_BITS, dtype=np.uint64)
    for row in patterns.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[row.slot] = np.uint64(row.bits & _MASK)
    return out


def _context_totals(df: DataFrame, text_col: str, bitmap: np.ndarray) -> DataFrame:
    """``ctx, n``: how often each context whose bit is set holds any word, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, 0):
            hits = []
            for text in texts:
                found = contexts(cut(text)).reshape(-1)
                bits = bitmap[(found.view(np.uint64) >> np.uint64(6)) & np.uint64((1 << BITMAP_BITS) - 1)]
                hits.append(found[((bits >> (found.view(np.uint64) & np.uint64(63))) & np.uint64(1)) == 1])
            values, n = np.unique(np.concatenate(hits), return_counts=True) if hits else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["ctx", "n"])

    return map_arrow(df.select(text_col), run, "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("n"))


def score_graph(edges: DataFrame, others: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``value, score`` of the instances of ``edges(ctx, value, place, seed)`` after some rounds.

    ``others(ctx, others)``: how many words that look like no identifier stand in each context. Scores
    are NULL until a round reaches their instance, and NULL counts neither for nor against a pattern.
    """
    graph = durable(edges.join(others, "ctx"), "pii-graph")
    pairs = graph.groupBy("ctx", "value").agg(F.bool_or("seed").alias("seed"), F.first("others").alias("others"))
    scores = graph.groupBy("value").agg(F.when(F.bool_or("seed"), 1.0).alias("score"))
    for _ in range(rounds):
        confidence = pairs.join(scores, "value").groupBy("ctx").agg((F.sum("score") / (F.count("score") + F.first("others"))).alias("confidence"))
        places = graph.join(confidence, "ctx").groupBy("value", "place").agg(F.bool_or("seed").alias("seed"), F.max("confidence").alias("best"))
        noisy_or = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("best"), F.lit(1e-9)))))
        scores = places.groupBy("value").agg(F.when(F.bool_or("seed"), 1.0).otherwise(noisy_or).alias("score"))
    return scores


def find_pii(df: DataFrame, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """``id, __key, base_spans, spans`` of every row: those of the fixed patterns, and with the method's added."""
    rows = durable(_extract(df, id_col, text_col), "pii")
    cands = rows.select("__key", F.explode("cands").alias("c")).select("__key", "c.*")
    near = cands.select("value", "place", "seed", F.explode("ctxs").alias("x")).select("x.ctx", "x.seen", "value", "place", "seed")
    edges = near.groupBy("ctx", "value", "place").agg(F.bool_or("seed").alias("seed"), F.count_if("seen").alias("seen"))
    # By pattern and value first, as one value may stand at several places of one pattern.
    values = edges.groupBy("ctx", "value").agg(F.bool_or("seed").alias("seed"), F.sum("seen").alias("seen"))
    patterns = values.groupBy("ctx").agg(F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("instances"), F.sum("seen").alias("seen"))
    induced = durable(patterns.where((F.col("seeds") >= least_seeds) & (F.col("seeds") >= F.col("instances") * least_share)), "pii-patterns")
    plain = rows.select(id_col, "__key", "base_spans", F.col("base_spans").alias("spans"))
    # A pattern that only seeds fill can't find anything new.
    useful = induced.where("instances > seeds")
    if useful.isEmpty():
        return plain
    totals = _context_totals(df, text_col, _bitmap(useful))
    others = useful.join(totals, "ctx", "left").select("ctx", (F.coalesce("n", F.lit(0)) - F.col("seen")).alias("others"))
    accepted = score_graph(edges.select("ctx", "value", "place", "seed"), others).where(F.col("score") >= least_score).select("value")
    added = cands.where("NOT seed").join(accepted, "value").groupBy("__key").agg(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end")).alias("added"))
    rank = {kind: k for k, kind in enumerate(KINDS)}
    ranked = F.transform(F.concat("base_spans", F.coalesce("added", F.array().cast(SPAN_TYPE))), lambda s: F.struct(s["start"].alias("start"), F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))[s["kind"]].alias("k"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(added, "__key", "left").select(id_col, "__key", "base_spans", spans.alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of ``df`` with each span replaced by its kind, like ``<EMAIL>``, and lengths brought up to date.

    Overlapping spans are replaced together, by the first one's kind.
    """
    found = find_pii(df, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).groupBy("__key").agg(F.any_value("spans").alias("spans"))
    names = df.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None
    joined = df.alias("d").join(found.alias("f"), row_key(f"d.{id_col}", f"d.{text_col}") == F.col("f.__key"), "left").select(*(F.col(f"d.`{n}`") for n in names), F.col("f.spans").alias(unused("__spans", names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, spans = batch.columns
            changed = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(changed):
                texts = columns[at].to_pylist()
                for k in changed.tolist():
                    texts[k] = _replace(texts[k], spans[k].as_py())
                columns[at] = pa.array(texts, columns[at].type)
                if length_at is not None:
                    new = pa.compute.cast(pa.compute.utf8_length(columns[at]), columns[length_at].type)
                    columns[length_at] = pa.compute.if_else(spans.is_valid(), new, columns[length_at])
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(joined, run, fields_of(df))


def _replace(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        if span["start"] >= done:
            out += [text[done : span["start"]], f"<{span['kind'].upper()}>"]
        done = max(done, span["end"])
    return "".join([*out, text[done:]])
