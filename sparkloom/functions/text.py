"""Scalar functions on text, names, tags, JSON and nested values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.stats import col

#: Unicode white space, which Java's ``\s`` lacks.
SPACE = r"(?U)\s+"


def is_blank(c: str | Column) -> Column:
    """NULL or only white space."""
    return col(c).isNull() | (F.regexp_replace(col(c).cast("string"), SPACE, "") == "")


def marked_language(c: str | Column, markers: Mapping[str, Iterable[str]]) -> Column:
    """The language of which a text holds most marker words (U10): NULL where it holds none, of equals the first by name.

    ``markers`` maps a language to its lower-case words; a text is cut at everything that isn't a letter.
    """
    words = F.split(F.lower(col(c)), r"[^\p{L}]+")

    def held(names: Iterable[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*names)))

    best = F.array_min(F.array(*(F.struct((-held(markers[name])).alias("n"), F.lit(name).alias("name")) for name in sorted(markers))))
    return F.when(best["n"] < 0, best["name"])


def normal(c: str | Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(F.trim(col(c)))


def mapped(c: str | Column, names: Mapping[str, str], default: Column | str | None = None) -> Column:
    """A literal map's value, else the default (X02), else the value itself."""
    c = col(c)
    other = c if default is None else F.lit(default) if isinstance(default, str) else default
    if not names:
        return other
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c), other)


def by_contained(c: str | Column, rules: Iterable[tuple[str, str]], default: str = "") -> Column:
    """The value of the first rule whose needle occurs."""
    out = None
    for needle, value in rules:
        hit = F.contains(col(c), F.lit(needle))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def or_raw(c: str | Column, raw: str | Column) -> Column:
    """The value unless blank, else the raw one."""
    return F.when(is_blank(c), col(raw)).otherwise(col(c))


def language_code(c: str | Column) -> Column:
    """A detector's label to a bare code: ``__label__zh-Hans`` is ``zh``."""
    return F.substring_index(F.lower(F.trim(F.replace(col(c), F.lit("__label__"), F.lit("")))), "-", 1)


def tag_key(c: str | Column) -> Column:
    """Trimmed, lower-cased, with underscores."""
    return F.translate(normal(c), "- ", "__")


def canonical_tags(tags: str | Column, names: Mapping[str, str], known: Iterable[str]) -> Column:
    """Each tag's canonical name once, in order; unknown ones are ``other``, NULLs go."""
    known = list(known)
    every = {**{k: k for k in known}, **names}
    return F.array_distinct(F.transform(F.filter(col(tags), lambda t: t.isNotNull()), lambda t: mapped(tag_key(t), every, "other")))


def target_class(language: str | Column, target: str | Column) -> Column:
    """Whether a language is the target, English or another."""
    return F.when(col(language) == col(target), "target").when(col(language) == "en", "english").otherwise("other")


def expected_language(role: str | Column, roles: Iterable[str], language: str | Column) -> Column:
    """The language for the roles that speak it, English for others (X11)."""
    return F.when(col(role).isin(*roles), col(language)).otherwise(F.lit("en"))


def group_or_raise(c: str | Column, pattern: str) -> Column:
    """The first group of a pattern; no match raises."""
    found = F.regexp_extract(col(c), pattern, 1)
    return F.when(col(c).rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit("no match in "), col(c))))


def part_count(c: str | Column, separator: str = "|") -> Column:
    """How many parts a text has (X14); blank parts don't count."""
    return F.size(F.filter(F.split(col(c), re.escape(separator)), lambda x: F.trim(x) != ""))


def to_amount(c: str | Column) -> Column:
    """``$1,234.50`` as a number, NULL if it is none."""
    return F.regexp_replace(col(c), "[$,]", "").try_cast("double")


def stable_id(seed: str | Column, length: int = 16) -> Column:
    """The first hex digits of a text's SHA-256."""
    return F.left(F.sha2(col(seed), 256), F.lit(length))


def slug(c: str | Column, default: str = "section") -> Column:
    """Lower-case letters and digits joined by hyphens."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def product_of(values: str | Column) -> Column:
    """Product of an array, 1.0 of nothing; NULL members count as 1."""
    return F.aggregate(F.coalesce(col(values), F.array().cast("array<double>")), F.lit(1.0), lambda a, x: a * F.coalesce(x.cast("double"), F.lit(1.0)))


def says(message: str | Column, needle: str | Column) -> Column:
    """Whether a message says something, case aside.

    Commas go from the message only, so a needle with a comma is never found.
    """
    return F.coalesce(F.contains(F.replace(F.lower(col(message)), F.lit(","), F.lit("")), F.lower(col(needle))), F.lit(False))


def structured_payload(c: str | Column) -> Column:
    """Text that looks like JSON."""
    trimmed = F.ltrim(col(c))
    return F.coalesce(F.startswith(trimmed, F.lit("{")) | F.startswith(trimmed, F.lit("[")) | (F.regexp_count(col(c), F.lit('":')) >= 2), F.lit(False))


def spoken_turn(c: str | Column, least: int = 5) -> Column:
    """Text long enough that is no control mark like ``###STOP###``."""
    trimmed = F.trim(col(c))
    return F.coalesce((F.length(trimmed) >= least) & ~trimmed.rlike("(?s)^###.*###$"), F.lit(False))


def turn_number(turn: str | Column, position: str | Column, zero_counts: bool) -> Column:
    """The turn's own number, else its position; 0 counts as none in one of the two forms."""
    return F.coalesce(col(turn) if zero_counts else F.nullif(col(turn), F.lit(0)), col(position))


def from_fence(c: str | Column) -> Column:
    """JSON out of a Markdown fence, as VARIANT; NULL if it is none."""
    inner = F.regexp_extract(col(c), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.try_parse_json(F.coalesce(F.nullif(inner, F.lit("")), col(c)))


def split_address(c: str | Column, mark: str = "::") -> Column:
    """``file::body`` as a struct."""
    parts = F.split(col(c), re.escape(mark), 2)
    return F.struct(F.get(parts, F.lit(0)).alias("file"), F.get(parts, F.lit(1)).alias("body"))


def json_path(c: str | Column, path: str, kind: str = "string") -> Column:
    """A value in a JSON text, NULL if it isn't there or doesn't fit."""
    return F.try_variant_get(F.try_parse_json(col(c)), path, kind)


def pieces(c: str | Column, n: int) -> Column:
    """A text cut evenly into ``n`` pieces."""
    size = F.length(col(c))
    at = lambda i: F.floor(size * i / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(col(c), at(i) + 1, at(i + 1) - at(i)))


def template_pattern(template: str) -> str:
    """``Hello {name}`` as a pattern with named groups, Java's way."""
    parts = re.split(r"\{([A-Za-z][A-Za-z0-9]*)\}", template)
    return "^" + "".join(f"(?<{p}>.+?)" if k % 2 else re.escape(p) for k, p in enumerate(parts)) + "$"


def system_error(termination: str | Column, texts: str | Column, needles: Iterable[str], reasons: Iterable[str] = ("infrastructure_error", "user_error")) -> Column:
    """Whether a run ended by a system error: by reason, or by a needle in the reason or in a text's start."""
    pattern = "(?i)" + "|".join(map(re.escape, needles))
    heads = F.transform(F.coalesce(col(texts), F.array().cast("array<string>")), lambda t: F.coalesce(F.left(t, F.lit(1000)), F.lit("")))
    return F.coalesce(col(termination).isin(*reasons) | col(termination).rlike(pattern), F.lit(False)) | F.exists(heads, lambda t: t.rlike(pattern))


def skips_first_agent_turn(scenario: str | Column, role: str | Column, is_first: str | Column, of: str = "l2_interaction") -> Column:
    """Whether a turn is a fixed greeting that doesn't count."""
    return (col(scenario) == of) & col(role).isin("agent", "assistant") & col(is_first)


def flag_is(flag: str | Column, wanted: bool = True) -> Column:
    """Equality of flags (F14); NULL is neither."""
    return F.coalesce(col(flag) == F.lit(wanted), F.lit(False))


def path_wanted(path: str | Column, leaves: Iterable[str], never: Iterable[str] = ()) -> Column:
    """Whether a path like ``a/b/0/title`` ends in a wanted name and has no unwanted part (F24); numbers don't count."""
    names = F.filter(F.split(col(path), "/"), lambda p: ~p.rlike(r"^\d+$"))
    return F.coalesce(F.try_element_at(names, F.lit(-1)).isin(*leaves), F.lit(False)) & ~F.arrays_overlap(names, F.array(*map(F.lit, never)) if list(never) else F.array().cast("array<string>"))


def path_segment(path: str | Column, after: str) -> Column:
    """The part of a path behind a named part (X09), NULL without it."""
    return F.nullif(F.regexp_extract(col(path), rf"(?:^|/){re.escape(after)}/([^/]+)", 1), F.lit(""))


def time_text(c: str | Column, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    """A time as text."""
    return F.date_format(col(c), pattern)


def audio_seconds(size: str | Column, rate: int, channels: int = 1, bytes_per_sample: int = 2) -> Column:
    """Bytes of sound to seconds."""
    return col(size) / F.lit(float(rate * channels * bytes_per_sample))


def printed_call(c: str | Column) -> Column:
    """``name(a=1, b='x')`` as ``struct<name, args>`` (X29): values as texts without quotes."""
    name = F.regexp_extract(col(c), r"^\s*([A-Za-z_]\w*)\s*\(", 1)
    pairs = F.regexp_extract_all(col(c), F.lit(r"""([A-Za-z_]\w*\s*=\s*(?:'[^']*'|"[^"]*"|[^,()]+))"""), 1)
    entry = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(p, r"(?s)=(.*)$", 1)), r"""^['"]|['"]$""", "").alias("v")))
    return F.when(name != "", F.struct(name.alias("name"), F.map_from_entries(entry).alias("args")))


def response_text(c: str | Column) -> Column:
    """Any value as JSON text."""
    return F.to_json(F.struct(col(c).alias("value")))


def one_line(c: str | Column) -> Column:
    """Line breaks to spaces, NULL for blanks."""
    return F.when(~is_blank(c), F.translate(col(c), "\n", " "))


def first_present(*columns: str | Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*(F.when(~is_blank(c), col(c)) for c in columns))


def unique_names(c: str | Column, keys: list[str], order: list[Column], longest: int = 31) -> Column:
    """Names cut to a length, repeated ones numbered."""
    from pyspark.sql import Window

    cut = F.left(col(c), F.lit(longest - 4))
    n = F.row_number().over(Window.partitionBy(*keys, cut).orderBy(*order))
    return F.when(n > 1, F.concat(cut, F.lit("_"), n.cast("string"))).otherwise(cut)


def with_normal(df: DataFrame, column: str) -> DataFrame:
    """The frame with a column trimmed and lower-cased, as it is if it has none of that name."""
    return df.withColumn(column, normal(column)) if column in df.columns else df
