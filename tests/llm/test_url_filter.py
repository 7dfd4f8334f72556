import random
import re
import string
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import duckdb
import pytest

from sparkloom.llm import queries, url_filter
from sparkloom.llm.components import connected_components

PAGES = [
    (1, "http://a.example.io/x", '<link rel="canonical" href="http://spam.net/p">'),
    (2, "http://b.io/y", "<LINK HREF=/z REL=canonical>"),
    (3, "http://b.io/z#f", '<meta http-equiv="refresh" content="0; url=http://a.example.io/x">'),
    (4, "http://c.io/q?x=1", '<link rel=canonical href="http://www.example.org/fr/1">'),
    (5, "http://c.io/d/e", '<link rel=canonical href="q?x=1"><link rel=canonical href="../k">'),
    (6, None, None),
    (7, "nourl", None),
    (8, "HTTP://NET", ""),
    (9, "http://NET/", ""),
    (9, "http://NET/", ""),
    (10, "http://www.example.org/fr/1", "<link rel=canonical href=//foo.net/>"),
    (11, "http://xnet/", "<!--<link rel=canonical href=//foo.net/>-->"),
    (12, "http://q.io?://a.net/", ""),
    (13, "https://sub.example.net/en/a", ""),
    (14, "https://sub.example.net/de/a", ""),
]


def test_verdicts_equal_sql_and_spread_over_aliases(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, verdict string")
    got = url_filter.judge_pages(pages, queries.RULES)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(queries.ORACLE_SQL["op2_url_filter"]).fetchall(), key=str)
    verdicts = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert verdicts[1] == (None, "block") and verdicts[2] == (None, "block")  # aliases of a blocked page
    assert verdicts[4] == (None, "allow") and verdicts[10] == ("org/fr/", "allow")  # an allow rule comes first
    assert verdicts[13] == ("example.net/en/", "allow") and verdicts[14] == ("net/", "block")
    assert url_filter.judge_pages(pages.limit(0), queries.RULES).count() == 0


def test_given_redirects_join_aliases(spark):
    pages = spark.createDataFrame([(1, "http://x.io/a", None), (2, "http://y.io/b", None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://x.io/a", "http://z.net/"), ("http://y.io/b", None)], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(pages, queries.RULES, redirects).collect()}
    assert got == {1: "block", 2: "allow"}


def test_plan_is_native(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    plan = url_filter.judge_pages(pages, queries.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


class Links(HTMLParser):
    """What a page names as canonical or refreshes to, read by an HTML parser; refreshes by the HTML standard's steps."""

    def __init__(self, url):
        super().__init__()
        self.url, self.base, self.targets, self.inert = url, None, [], None

    def handle_starttag(self, tag, attributes):
        if self.inert:
            return
        if tag in url_filter.RAW:
            self.inert = tag
        a = {k: (v or "").strip() for k, v in reversed(attributes)}
        if tag == "base" and a.get("href") and self.base is None:
            self.base = a["href"]
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.targets.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            self.targets.append(self.refresh(a.get("content", "")))

    def handle_endtag(self, tag):
        if tag == self.inert:
            self.inert = None

    @staticmethod
    def refresh(text):
        rest = text.lstrip()
        time = re.match(r"[0-9]*", rest)[0]
        if not time and not rest.startswith("."):
            return ""
        rest = rest.lstrip("0123456789.")
        if not rest or rest[0] not in ";, \t\n\f\r":
            return ""
        rest = rest.lstrip()
        rest = (rest[1:] if rest[:1] in (";", ",") else rest).lstrip()
        if rest[:3].lower() == "url" and rest[3:].lstrip().startswith("="):
            rest = rest[3:].lstrip()[1:].lstrip()
        if rest[:1] in ("'", '"'):
            rest = rest[1:].split(rest[0])[0]
        return rest.strip()

    def links(self):
        base = urljoin(self.url, self.base) if self.base else self.url
        base = base if "://" in base else self.url
        return [urljoin(unescaped(base), t) for t in self.targets if t]  # escaped dots are dots in a base too


def unescaped(text):
    """Escapes of unreserved characters undone, as URL libraries do before they compare."""
    return re.sub("%[0-9a-fA-F]{2}", lambda m: unquote(m[0]) if unquote(m[0]) in f"{string.ascii_letters}{string.digits}-._~" else m[0].upper(), text)


def name(url):
    """Host, path and query of a URL as a URL library tells them."""
    if not url or "://" not in url:
        return None
    parts = urlsplit(url)
    port = "" if parts.port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{parts.port}"
    path = unescaped(parts.path)
    if re.search(r"/\.\.?(/|$)", path):
        path = urlsplit(urljoin("http://h/", "http:" + path)).path
    tail = url.split("://", 1)[1].partition("#")[0].partition("?")
    return parts.hostname + port + (path or "/") + tail[1] + unescaped(tail[2])


def rule_of(host, path):
    fits = [r for r in queries.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def judged_by_rules(pages):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, url, html in pages:
        reader = Links(url or "")
        if url and "://" in url and html:
            reader.feed(html)
            for to in reader.links():
                if name(to) and name(url) and name(to) != name(url):
                    a, b = find(name(url)), find(name(to))
                    parent[max(a, b)] = min(a, b)
    classes = {}
    for x in parent:
        host = re.match(r"[^/?]*", x)[0]
        classes.setdefault(find(x), set()).add(rule_of(host, x[len(host) :].split("?")[0])[1])
    out = []
    for page, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        rule, verdict = rule_of(host, path)
        found = classes.get(find(name(url)), set()) if name(url) in parent else set()
        alias = find(name(url)) if name(url) in parent else None
        out.append((page, host, path, rule, verdict or next((v for v in ("allow", "block") if v in found), "allow"), alias))
    return out


def made_pages(seed):
    r = random.Random(seed)
    hosts = ["a.io", "b.io", "www.example.org", "foo.net", "sub.example.net", "example.com", "C.io", "a.io:80", "b.io:443", "c.io:8080", "me:pw@foo.net", "a.io:"]
    paths = ["/%7Eu/%64", "/~u/d", "/%2fx?%41=%zz", "/%2Fx?A=%zz", "/d/%2e%2E/k", "/", "/en/", "/fr/1", "/de/x", "/q?a=1&b=2", "/q?a=1", "/d/e/f", "/d/k", "", "/d/./k", "/d/e/../k", "/d/e/.."]

    def url():
        return f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}"

    def escaped(text):
        return "".join(r.choice({"&": ["&amp;", "&#38;", "&#x26;"], "/": ["/", "/", "&#47;", "&#x2F;"]}.get(c, [c])) for c in text)

    def target():
        return escaped(r.choice([url(), url(), "//foo.net/de/x", "../k", "./k", "k", "?a=1&b=2", "#top", "/d/e/../k", "../../fr/1", "mailto:x@y", "q?u=http://a.io/"]))

    def quoted(value):
        return r.choice([f'"{value}"', f"'{value}'", f'" {value} "', value])

    def tag():
        t = target()
        return r.choice(
            [f"<link rel=canonical href={quoted(t)}>", f"<LINK HREF = {quoted(t)} REL='nofollow CANONICAL'>", f'<meta http-equiv="refresh" content="0; url={t}">', f"<META content=\"5;URL='{t}'\" HTTP-EQUIV=Refresh>"]
            + [f"<base href={quoted(target())}>", f"<link rel=stylesheet href={quoted(t)}>", f"<!-- <link rel=canonical href={quoted(t)}> -->", f"<script>'<link rel=canonical href=x>'</script>", f"<link rel=canonical data-href={quoted(t)}>", "<p>canonical</p>"]
            + [f'<link title="a>b href=x" rel="canonical" href={quoted(t)}>', f"<link rel=&#99;anonical href={quoted(t)}>", f'<link rel=canonical href={quoted(t)} href="http://other.io/">', f"<link data-x=a\"b rel=canonical href={quoted(t)}>", f"<link rel=canonical href=>"]
            + [f'<meta http-equiv=refresh content="{r.choice(["0; ", "5,", ".5 ", "1.2;  URL = ", "x;", "0", "3;url=&quot;", "7; url"])}{t}">' for _ in range(3)]
            + [f"<{e}><link rel=canonical href={quoted(t)}></{e}>" for e in ("textarea", "style", "title", "noscript", "template")]
        )

    return [(k, r.choice([url(), url(), url(), url(), None, "plain"]), "".join(tag() for _ in range(r.choice([0, 0, 1, 1, 2])))) for k in range(200)]


@pytest.mark.parametrize("seed", range(4))
def test_links_and_verdicts_of_made_pages_follow_the_rules(spark, seed):
    pages = made_pages(seed)
    want = sorted(judged_by_rules(pages), key=str)
    got = url_filter.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.RULES).collect()
    assert sorted(map(tuple, got), key=str) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert sorted(con.execute(queries.ORACLE_SQL["op2_url_filter"]).fetchall(), key=str) == want
    assert sum(x[5] is not None for x in want) > 10


def test_each_spelling_of_a_blocked_page_blocks_its_alias(spark):
    links = ['<link rel=canonical href="http://bad.net">', '<link title="a>b" rel="canonical" href="http://bad.net/p">', '<meta http-equiv=refresh content="0; http://bad.net/p">', "<link rel=canonical href=http://bad.net:80/p>", "<link rel=&#x63;anonical href=//bad.net/p>"]
    pages = [(k, f"http://x{k}.io/", html) for k, html in enumerate(links)] + [(50, "http://a.io", "<link rel=canonical href=http://b.io/%7Ex>"), (51, "http://b.io/~x", "<link rel=canonical href=http://bad.net/>"), (52, "http://a.io/", None)]
    pages += [(60, "http://c.io/", "<textarea><link rel=canonical href=http://bad.net/></textarea>"), (61, "http://d.io/", '<link rel=canonical href="http://bad.net/'), (62, "http://e.io/", "<link " * 50_000), (63, "http://f.io/", "<link " + "a=b " * 50_000 + "rel=canonical href='http://bad.net/'>")]
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.RULES).collect()}
    assert {k for k, v in got.items() if v == "allow"} == {60, 61, 62} and len(got) == len(pages)


def test_long_html_and_rules_of_one_length(spark):
    long = "<p>x</p>" * 200_000 + '<link rel=canonical href="http://b.org/ab">' + "<" * 100_000
    pages = spark.createDataFrame([(1, "http://x.io/", long), (2, "http://a.b.org/abc", None)], "page_id long, url string, html string")
    rules = [("b.org/ab", "block"), ("a.b.org/", "allow")]
    assert len(rules[0][0]) == len(rules[1][0])
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_pages(pages, rules).collect()}
    assert got == {1: (None, "block"), 2: ("b.org/ab", "block")}


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    import random

    r = random.Random(4)
    edges = {"path": [(k, k + 1) for k in range(60)], "star": [(k, 1000) for k in range(60)], "random": [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(3, 3), (None, 4)], "empty": []}[shape]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {row.node: row.component for row in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
