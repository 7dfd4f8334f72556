"""URL filters with redirect equivalence.

Rules name a host and a path prefix. A page that a rule fits gets the longest rule's verdict. Pages
are also joined into classes of aliases by their canonical links, meta refreshes and, if given, a
table of redirects: a page that no rule fits is blocked if some alias is blocked by a rule and none
is allowed by one. Explicit allow rules thus come first, on the page itself and within a class.

Links are read as browsers do: a tag ends at the first ``>`` outside quoted values, an attribute's first
value counts, character references in it are decoded (the five of XML and numeric ones), a refresh may
leave out ``url=``, and targets are resolved against the page's URL or its first ``<base href>``. Comments
and elements whose content is text or inert (:data:`RAW`) hold no links. A target that isn't relative and
has no ``://`` is none.

URLs are compared as aliases without user names, default ports, dot segments and escapes of characters that
need none; an empty path is ``/``.

Everything is DataFrame functions: rules become a literal map from host to its rules, which is looked
up for each suffix of the page's host, and classes come from distributed connected components. Only
URLs are shuffled, never page texts.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and no aliases,
and is allowed; null html has no links; html of any length is read whole; of rules of one length that
fit, the one greatest in text counts; every one of several equal rows is returned; an empty table
gives an empty table; only the named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable
from sparkloom.llm.components import connected_components

#: Elements in which a browser with scripts finds no links.
RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "noembed", "noframes", "xmp")

_S = r"\t\n\f\r "
_SPACE = f"[{_S}]"
#: Comments and such elements; what isn't closed goes on to the end.
_NO_LINKS = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{name}[{_S}/>].*?(?:</{name}(?:[{_S}/][^>]*)?>|\\z)" for name in RAW)
#: The inside of a tag, and ``>``, or nothing if the text ends first. Quotes count only where a value begins.
#: Groups of attributes are matched one after another, so that the stack stays shallow.
_TAG = f"""(?i)<((?:link|meta|base)[{_S}/](?>(?:[^>=]++|={_SPACE}*+(?:"[^"]*+(?:"|\\z)|'[^']*+(?:'|\\z)|[^{_S}"'>])){{1,64}}+)*+(?:={_SPACE}*+)?+)(>|\\z)"""
_ATTRIBUTE = f"""([^{_S}/>=]+){_SPACE}*(?:={_SPACE}*(?:"([^"]*)"|'([^']*)'|([^{_S}"'>][^{_S}>]*)))?"""
#: What any page with a link holds: the word that marks it, or a character reference in the attribute that would.
_MARKED = f"""(?i)canonical|refresh|(?:rel|http-equiv){_SPACE}*={_SPACE}*(?:"[^"]*&|'[^']*&|[^{_S}"'>]*&)"""
_REFRESH = f"(?s)^{_SPACE}*(?:[0-9]+|[.])[0-9.]*(?:{_SPACE}*[;,]{_SPACE}*|{_SPACE}+)(.*)$"

_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; one that ends in such a segment ends in a slash."""
    parts = F.split(path, "/")
    last_is_dot = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda seen, x: F.when(x == ".", seen).when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(x))),
    )
    joined = F.concat(F.lit("/"), F.array_join(F.when(last_is_dot, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), joined).otherwise(path)


def unescaped(text: Column) -> Column:
    """Percent escapes of letters, digits and ``-._~`` as themselves, all others in capitals."""

    def part(p: Column) -> Column:
        digits = F.upper(F.regexp_extract(p, r"^[0-9a-fA-F]{2}", 0))
        character, rest = F.char(F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long")), F.substr(p, F.lit(3))
        return F.when(digits == "", F.concat(F.lit("%"), p)).when(character.rlike(r"^[A-Za-z0-9._~-]$"), F.concat(character, rest)).otherwise(F.concat(F.lit("%"), digits, rest))

    parts = F.split(text, "%")
    return F.when(F.contains(text, F.lit("%")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), part), ""))).otherwise(text)


def node_of(url: Column) -> Column:
    """What stands for a URL among aliases: host, path and query, each in one spelling; null where there is no ``://``."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A(.*?)://", 1))
    host = F.regexp_replace(host_of(url), r"^.*@", "")
    host = F.regexp_replace(host, F.when(scheme == "http", r":(80)?$").when(scheme == "https", r":(443)?$").otherwise(r":$"), F.lit(""))
    path = F.coalesce(F.nullif(without_dots(unescaped(path_of(url))), F.lit("")), F.lit("/"))
    query = unescaped(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3))
    return F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("://")), F.concat(host, path, query))


def _character(code: Column) -> Column:
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD).cast("long"))), 8, "0")), "UTF-32")


def decoded(c: Column) -> Column:
    """Character references of an attribute's value as the characters they stand for."""

    def part(p: Column) -> Column:
        named, decimal, hexadecimal = F.regexp_extract(p, r"^(amp|lt|gt|quot|apos);", 1), F.regexp_extract(p, r"^#([0-9]{1,7});", 1), F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        rest = F.substr(p, F.locate(";", p) + 1)
        character = F.when(named == "amp", "&").when(named == "lt", "<").when(named == "gt", ">").when(named == "quot", '"').when(named == "apos", "'")
        character = character.when(decimal != "", _character(decimal.cast("long"))).when(hexadecimal != "", _character(F.conv(hexadecimal, 16, 10).cast("long")))
        return F.coalesce(F.concat(character, rest), F.concat(F.lit("&"), p))

    parts = F.split(c, "&")
    return F.when(F.contains(c, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), part), ""))).otherwise(c)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def attribute(tag: Column, name: str) -> Column:
    """The value that a tag (its inside) first gives an attribute, quoted or not; empty where there is none."""
    names, *values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), k) for k in (1, 2, 3, 4))
    at = F.array_position(F.transform(names, F.lower), name).cast("int")
    return F.when(at > 0, trimmed(decoded(F.concat(*(F.element_at(v, F.greatest(at, F.lit(1))) for v in values))))).otherwise("")


def refresh_target(content: Column) -> Column:
    """The URL of a refresh's content: a time, a separator, and the URL, perhaps after ``url=`` and in quotes."""
    rest = F.regexp_replace(F.regexp_extract(content, _REFRESH, 1), f"(?i)^url{_SPACE}*={_SPACE}*", "")
    quoted = F.regexp_extract(rest, r"""(?s)^(?:"([^"]*)|'([^']*))""", 1), F.regexp_extract(rest, r"""(?s)^(?:"([^"]*)|'([^']*))""", 2)
    return trimmed(F.when(rest.rlike("""^["']"""), F.concat(*quoted)).otherwise(rest))


def resolved(target: Column, base: Column) -> Column:
    """The URL that ``target`` names on a page at ``base``; null if it names none."""
    scheme = F.regexp_extract(base, r"(?s)\A(.*?):", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)\A(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") | (target == ""), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(base), target))
        .when(F.startswith(target, F.lit("#")), base)
        .otherwise(F.concat(site, folder, target))
    )


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(length, rule, verdict)``, null if none fits.

    ``rules``: pairs of a rule like ``example.net/en/`` and its verdict.
    """
    by_host: dict[str, list[Column]] = {}
    for rule, verdict in sorted(rules):
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append(F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(slash + rest).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    lookup = F.create_map(*(x for name, found in by_host.items() for x in (F.lit(name), F.array(*found))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(suffixes, lambda s: s.isin(*by_host))
    hits = F.filter(F.flatten(F.transform(known, lambda s: F.try_element_at(lookup, s))), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: a page's node and that of the URL it names as canonical or refreshes to."""
    html = F.regexp_replace(F.col(html_col), _NO_LINKS, "")
    inside, end = (F.regexp_extract_all(html, F.lit(_TAG), k) for k in (1, 2))
    tags = F.filter(F.transform(F.arrays_zip(inside.alias("tag"), end.alias("end")), lambda t: F.when(t["end"] == ">", t["tag"])), lambda t: t.isNotNull())
    found = pages.where(F.col(html_col).rlike(_MARKED)).select(F.col(url_col).alias("url"), tags.alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^base")), lambda t: attribute(t, "href")), lambda h: h != "")
    found = found.withColumn("base", F.coalesce(resolved(F.try_element_at(bases, F.lit(1)), F.col("url")), F.col("url")))
    canonical = F.filter("tags", lambda t: t.rlike("(?i)^link") & F.lower(attribute(t, "rel")).rlike(f"(^|{_SPACE})canonical({_SPACE}|$)"))
    refresh = F.filter("tags", lambda t: t.rlike("(?i)^meta") & (F.lower(attribute(t, "http-equiv")) == "refresh"))
    targets = F.concat(F.transform(canonical, lambda t: attribute(t, "href")), F.transform(refresh, lambda t: refresh_target(attribute(t, "content"))))
    links = found.select("url", "base", F.explode(targets).alias("to")).where("to <> ''")
    return links.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("to"), F.col("base"))).alias("b"))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, path, rule, verdict, alias_of`` of every page.

    ``redirects(from_url, to_url)`` adds edges to those found in the pages. ``alias_of`` is the least
    node of the page's class, null if it has no aliases.
    """
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    # A node is host || path || query, and a host holds no slash, so rules can be judged on the node.
    classes = durable(connected_components(links), "aliases")
    as_url = F.concat(F.lit("u://"), F.col("node"))
    ruled = classes.select("component", longest_rule(host_of(as_url), path_of(as_url), rules)["verdict"].alias("v"))
    verdicts = ruled.groupBy("component").agg(F.when(F.bool_or(F.col("v") == "allow"), "allow").when(F.bool_or(F.col("v") == "block"), "block").alias("__alias_verdict"))
    aliases = classes.join(verdicts, "component").select(F.col("node").alias("__node"), F.col("component").alias("alias_of"), "__alias_verdict")
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("__node"))
    judged = judged.withColumn("__best", longest_rule(F.col("host"), F.col("path"), rules))
    return judged.join(aliases, "__node", "left").select(
        id_col, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", "__alias_verdict", F.lit("allow")).alias("verdict"), "alias_of"
    )
