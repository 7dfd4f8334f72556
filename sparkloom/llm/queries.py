"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bagminhash, byte_bpe, language, packing, pii, pivot_index, quality, secrets, segment_topk, tiered_search, token_files, url_filter
from sparkloom.llm.common import crc_bucket, shared_dir

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), RULES)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return secrets.digests(found, ("assign", "access", "hex"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(pii.find_pii(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))


def op5_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


#: A document is kept as good if its score reaches this.
LEAST_QUALITY = 0.3


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 5) == 0
    weights = quality.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(documents, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, keep_ids=False)


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicate(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    return language.predict(documents, language.learn(documents, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search.search(tiered_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_documents(spark, path, keep_ids=False)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_secrets": op3_secrets,
    "op4_pii": op4_pii,
    "op5_segment_topk": op5_segment_topk,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_pivot_index": op8_pivot_index,
    "op9_bagminhash": op9_bagminhash,
    "op10_language": op10_language,
    "op11_tiered_search": op11_tiered_search,
    "op12_token_files": op12_token_files,
}

#: SQL of what op2's links are made of; ``p``, ``v``, ``t``, ``u`` and ``path`` are columns or lambdas' names.
_PATH = r"""CASE WHEN regexp_matches(path, '/\.\.?(/|$)') THEN '/' || array_to_string(list_concat(list_reduce(list_transform(string_split(path, '/')[2:], lambda x: [x]), lambda seen, x: CASE WHEN x = ['.'] THEN seen WHEN x = ['..'] THEN seen[:greatest(len(seen) - 1, 0)] ELSE list_concat(seen, x) END, CAST([] AS VARCHAR[])), CASE WHEN string_split(path, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') ELSE path END"""
_RESOLVED = r"""CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR t = '' THEN NULL
    WHEN t LIKE '//%' THEN regexp_extract(u, '(?s)^(.*?):', 1) || ':' || t WHEN t LIKE '#%' THEN u
    ELSE regexp_extract(u, '(?s)^(.*?):', 1) || '://' || regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1) || CASE WHEN t LIKE '/%' THEN '' WHEN t LIKE '?%' THEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE coalesce(nullif(regexp_extract(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)', 1), ''), '/') END || t END"""


_W = r"[\t\n\f\r ]"
_ATTRIBUTES = r"""([^\t\n\f\r />=]+)[\t\n\f\r ]*(?:=[\t\n\f\r ]*(?:"([^"]*)"|''([^'']*)''|([^\t\n\f\r "''>][^\t\n\f\r >]*)))?"""
_TAGS = r"""(?i)<((?:link|meta|base)[\t\n\f\r /](?:[^>=]|=[\t\n\f\r ]*(?:"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|[^\t\n\f\r "''>]))*(?:=[\t\n\f\r ]*)?)(>|\z)"""


def _trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _attribute(name: str) -> str:
    raw = " || ".join(f"coalesce(regexp_extract_all(t, '{_ATTRIBUTES}', {k})[list_position(list_transform(regexp_extract_all(t, '{_ATTRIBUTES}', 1), lambda n: lower(n)), '{name}')], '')" for k in (2, 3, 4))
    named = " ".join(f"WHEN regexp_matches(p, '^{name};') THEN '{c}' || p[{len(name) + 2}:]" for name, c in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''")))
    numeric = ""
    for pattern, prefix in (("#([0-9]{1,7});", ""), ("#[xX]([0-9a-fA-F]{1,6});", "0x")):
        code = f"CAST('{prefix}' || regexp_extract(p, '^{pattern}', 1) AS BIGINT)"
        numeric += f" WHEN regexp_matches(p, '^{pattern}') THEN chr(CAST(CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {code} ELSE 65533 END AS INTEGER)) || substr(p, strpos(p, ';') + 1)"
    decoded = f"list_transform([{raw}], lambda v: string_split(v, '&')[1] || array_to_string(list_transform(string_split(v, '&')[2:], lambda p: CASE {named}{numeric} ELSE '&' || p END), ''))[1]"
    return _trimmed(decoded)


def _refresh(content: str) -> str:
    rest = f"regexp_replace(regexp_extract({content}, '(?s)^{_W}*(?:[0-9]+|[.])[0-9.]*(?:{_W}*[;,]{_W}*|{_W}+)(.*)$', 1), '(?i)^url{_W}*={_W}*', '')"
    quotes = """(?s)^(?:"([^"]*)|''([^'']*))"""
    return _trimmed(f"""list_transform([{rest}], lambda r: CASE WHEN regexp_matches(r, '^["'']') THEN regexp_extract(r, '{quotes}', 1) || regexp_extract(r, '{quotes}', 2) ELSE r END)[1]""")


def _unescaped(c: str) -> str:
    digits, code = "upper(regexp_extract(p, '^[0-9a-fA-F]{2}'))", "CAST('0x' || regexp_extract(p, '^[0-9a-fA-F]{2}') AS INTEGER)"
    part = f"CASE WHEN {digits} = '' THEN '%' || p WHEN ({code} BETWEEN 48 AND 57 OR {code} BETWEEN 65 AND 90 OR {code} BETWEEN 97 AND 122 OR {code} IN (45, 46, 95, 126)) THEN chr({code}) || p[3:] ELSE '%' || {digits} || p[3:] END"
    return f"(string_split({c}, '%')[1] || array_to_string(list_transform(string_split({c}, '%')[2:], lambda p: {part}), ''))"


def _node() -> str:
    """The node of ``host``, ``path`` and ``rest`` of a URL ``u``."""
    scheme = "lower(regexp_extract(u, '(?s)^(.*?)://', 1))"
    host = "regexp_replace(host, '^.*@', '')"
    host = f"CASE {scheme} WHEN 'http' THEN regexp_replace({host}, ':(80)?$', '') WHEN 'https' THEN regexp_replace({host}, ':(443)?$', '') ELSE regexp_replace({host}, ':$', '') END"
    path = f"list_transform([{_unescaped('path')}], lambda path: {_PATH})[1]"
    return f"CASE WHEN contains(u, '://') THEN {host} || coalesce(nullif({path}, ''), '/') || {_unescaped('rest')} END"


_NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{name}[\t\n\f\r />].*?(?:</{name}(?:[\t\n\f\r /][^>]*)?>|\z)" for name in url_filter.RAW)

ORACLE_SQL: dict[str, str] = {
    "op5_segment_topk": """
WITH usable AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
floored AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM floored q JOIN floored c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
    "op8_pivot_index": """
WITH RECURSIVE every AS (
  SELECT vec_id, min(CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding END) AS e FROM embeddings GROUP BY vec_id),
usable AS (SELECT vec_id, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS v FROM every WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a AS vec_id, a AS other FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(l.component_id, e.vec_id), true) AS kept
FROM every e LEFT JOIN counts c USING (vec_id) LEFT JOIN least l USING (vec_id)
""",
    "op11_tiered_search": r"""
WITH words AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sized AS (SELECT *, len(t) AS n FROM words WHERE len(t) > 0),
figures AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
asked AS (SELECT DISTINCT item_row, item_id, unnest(t) AS term FROM (
  SELECT row_number() OVER () AS item_row, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
counted AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, figures GROUP BY term, n_docs),
impacts AS (SELECT row_id, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)) AS impact FROM counted, figures),
scored AS (SELECT item_row, item_id, row_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL HAVING sum(w * impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) <= 50
""",
    "op2_url_filter": r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 3) AS rest
  FROM pages),
named AS (SELECT *, {node} AS node FROM (SELECT *, url AS u FROM parts)),
cleaned AS (SELECT url, node, regexp_replace(html, '{no_links}', '', 'g') AS h FROM named WHERE regexp_matches(html, '(?i)<(?:link|meta)')),
tags AS (SELECT url, node, list_filter(list_transform(list_zip(regexp_extract_all(h, '{tags}', 1), regexp_extract_all(h, '{tags}', 2)), lambda z: CASE WHEN z[2] = '>' THEN z[1] END), lambda t: t IS NOT NULL) AS tags FROM cleaned),
bases AS (SELECT url, node, tags, list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^base')), lambda t: {href}), lambda h: h <> '')[1] AS t, url AS u FROM tags),
based AS (SELECT node, tags, coalesce({resolved}, url) AS u FROM bases),
raw AS (
  SELECT node, u, unnest(list_concat(
    list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^link') AND regexp_matches(lower({rel}), '(^|{w})canonical({w}|$)')), lambda t: {href}),
    list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^meta') AND lower({equiv}) = 'refresh'), lambda t: {refresh}))) AS t
  FROM based),
urls AS (SELECT node, {resolved} AS u FROM raw WHERE t <> ''),
targets AS (
  SELECT node, u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 3) AS rest
  FROM urls),
links AS (SELECT node AS a, {node} AS b FROM targets),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
rules(rule, verdict, rule_host, rule_path) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
all_nodes AS (SELECT DISTINCT other AS node, split_part(other, '/', 1) AS host FROM reach),
node_rules AS (
  SELECT n.node, arg_max(r.verdict, (length(r.rule), r.rule)) AS verdict
  FROM all_nodes n JOIN rules r ON (regexp_extract(n.host, '^[^?]*') = r.rule_host OR ends_with(regexp_extract(n.host, '^[^?]*'), '.' || r.rule_host)) AND starts_with(substr(n.node, length(n.host) + 1), r.rule_path)
  GROUP BY n.node),
alias AS (
  SELECT reach.node, min(reach.other) AS alias_of, CASE WHEN bool_or(v.verdict = 'allow') THEN 'allow' WHEN bool_or(v.verdict = 'block') THEN 'block' END AS verdict
  FROM reach LEFT JOIN node_rules v ON reach.other = v.node GROUP BY reach.node),
best AS (
  SELECT h.host, h.path, arg_max(r.rule, (length(r.rule), r.rule)) AS rule, arg_max(r.verdict, (length(r.rule), r.rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM named) h JOIN rules r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
  GROUP BY h.host, h.path)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, a.verdict, 'allow') AS verdict, a.alias_of
FROM named n LEFT JOIN best b ON n.host = b.host AND n.path = b.path LEFT JOIN alias a ON n.node = a.node
""",
}
for _name, _sql in {"node": _node(), "no_links": _NO_LINKS, "tags": _TAGS, "resolved": _RESOLVED, "href": _attribute("href"), "rel": _attribute("rel"), "equiv": _attribute("http-equiv"), "refresh": _refresh(_attribute("content")), "w": _W}.items():
    ORACLE_SQL["op2_url_filter"] = ORACLE_SQL["op2_url_filter"].replace("{" + _name + "}", _sql)
