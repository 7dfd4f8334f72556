"""Text retrieval: BM25 over an inverted index, cosine, pattern counts, merging and reranking."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.functions.text import SPACE
from sparkloom.operators.reconcile import max_merge
from sparkloom.operators.topk import top_by_score
from sparkloom.sources.workspace import workspace

#: Rows of a block of documents and of queries (expected; rows are dealt by a hash of their id).
BLOCK, QUERY_BLOCK = 8192, 1024
#: Queries of a block that are compared at once.
TOGETHER = 256
#: Most rows of a query and a term that are broadcast; beyond, parts that a term's documents are dealt over.
ASKED, SALTS = 200_000, 16
#: Products of a document's terms and queries that a task holds at once.
PRODUCTS = 1 << 20


def tokens(c: str | Column) -> Column:
    """Lower-cased words split at Unicode white space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), SPACE), lambda t: t != "")


class Bm25Index:
    """Okapi BM25 over whole texts (Q01): one pass counts in how many documents each term occurs, written once.

    A query set takes one more pass over the texts, which keeps only the terms that are asked for.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25):
        self.id, self.k1, self.b, self.floor = id_col, k1, b, floor
        self.words = docs.select(id_col, tokens(F.coalesce(text_col, F.lit(""))).alias("__t")).withColumn("length", F.size("__t"))
        # A NULL term stands for the document itself, so corpus figures come from the same pass.
        terms = F.explode(F.concat(F.array_distinct("__t"), F.array(F.lit(None).cast("string"))))
        path = workspace(docs.sparkSession, "bm25")
        self.words.select(terms.alias("term"), "length").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("words")).write.parquet(path)
        counted = docs.sparkSession.read.schema("term string, df long, words long").parquet(path)
        total = counted.where("term IS NULL").first()
        self.docs, self.mean_length = (total.df, total.words / total.df) if total else (0, 0.0)
        self.frequencies = counted.where("term IS NOT NULL").select("term", "df")
        self.mean_idf = self.frequencies.agg(F.avg(self._idf())).first()[0] or 0.0

    def _idf(self) -> Column:
        return F.log((self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def _weighted(self, queries: DataFrame, query_id: str, text: str) -> tuple[DataFrame, list | None]:
        """``query, term, weight`` of what is asked, also as rows if there are at most ASKED."""
        asked = queries.select(query_id, F.explode(tokens(text)).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("asked"))
        idf = F.when(self._idf() < 0, self.floor * self.mean_idf).otherwise(self._idf())
        weighted = asked.join(self.frequencies, "term").select(query_id, "term", (F.col("asked") * idf * (self.k1 + 1)).alias("weight"))
        path = workspace(queries.sparkSession, "asked")
        weighted.write.parquet(path)
        weighted = queries.sparkSession.read.schema(weighted.schema).parquet(path)
        rows = weighted.limit(ASKED + 1).collect()
        return weighted, rows if len(rows) <= ASKED else None

    def _local(self, queries: DataFrame, query_id: str, rows: list, k: int = 0, digits: int | None = None, merged: bool = False) -> DataFrame:
        """Scores from each document's own row, without a shuffle: each query's ``k`` best of a batch, or each document's best."""
        asked = list(dict.fromkeys(r[0] for r in rows))
        number = {q: n for n, q in enumerate(asked)}
        rows = sorted(rows, key=lambda r: r.term)
        terms = list(dict.fromkeys(r.term for r in rows))
        ends = np.cumsum(np.bincount(np.searchsorted(terms, [r.term for r in rows]), minlength=len(terms))) if rows else np.zeros(0, np.int64)
        kinds = [(query_id, queries.schema[query_id].dataType), (self.id, self.words.schema[self.id].dataType)][merged:]
        result = pa.schema([*(pa.field(name, to_arrow_type(kind)) for name, kind in kinds), ("score", pa.float64())])
        names = pa.array(asked, to_arrow_type(queries.schema[query_id].dataType))
        shared = queries.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), np.concatenate([[0], ends]).astype(np.int64), np.array([number[r[0]] for r in rows], np.int64), np.array([r.weight for r in rows], np.float64), names))
        k1, b, mean = self.k1, self.b, self.mean_length or 1.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, ends, query, weight, names = shared.value
            together = max(1, PRODUCTS // max(1, len(weight)))
            for batch in batches:
                order = pc.sort_indices(batch.column(0)).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))  # of equal scores the smaller id comes first
                found = []
                for start in range(0, batch.num_rows if len(weight) else 0, together):
                    part = batch.slice(start, together)
                    q, x, scores = products(part.column(2), k1 * (1 - b + b * part.column(1).to_numpy() / mean), terms, ends, query, weight, len(names), merged)
                    x, scores = x + start, scores if digits is None else scores.round(digits)
                    found.append((q, x, scores) if merged else best_rows(q, x, scores, place, k))
                if not found:
                    continue
                q, x, scores = (np.concatenate(c) for c in zip(*found, strict=True))
                if not merged:
                    q, x, scores = best_rows(q, x, scores, place, k)
                columns = [names.take(pa.array(q)), batch.column(0).take(pa.array(x)), pa.array(scores)][merged:]
                yield pa.RecordBatch.from_arrays(columns, schema=result)

        fields = ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in kinds)
        return self.words.select(self.id, F.col("length"), "__t").mapInArrow(run, f"{fields}, score double")

    def scores(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        """``query, id, score`` of documents that share a term with a query (Q02, Q03).

        Negative weights of very common terms are lifted to a share of the mean weight. A query set of up
        to ASKED rows of a query and a term is broadcast; a larger one is joined by term, the documents'
        side dealt over SALTS parts, so that no task gets all of a common term. This makes a row for each
        query and document; where the best will do, :meth:`search` and :meth:`best_scores` make far fewer.
        """
        weighted, rows = self._weighted(queries, query_id, text)
        return self._joined(weighted, query_id, rows is not None)

    def _joined(self, weighted: DataFrame, query_id: str, small: bool) -> DataFrame:
        wanted = weighted.select("term").distinct()
        exploded = self.words.select(self.id, "length", F.explode("__t").alias("term")).join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
        counts = exploded.groupBy(self.id, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        if small:
            hits = counts.join(F.broadcast(weighted), "term")
        else:
            salted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            hits = counts.withColumn("salt", F.pmod(F.xxhash64(self.id), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
        norm = self.k1 * (1 - self.b + self.b * F.col("length") / self.mean_length)
        return hits.groupBy(query_id, self.id).agg(F.sum(F.col("weight") * F.col("tf") / (F.col("tf") + norm)).alias("score"))

    def search(self, queries: DataFrame, query_id: str, text: str, k: int, digits: int | None = None) -> DataFrame:
        """The k best documents of each query, ties by id; blank queries find nothing (Q02, Q03, Q11).

        With ``digits`` scores are rounded before ranking, so that equal documents tie whatever the order of
        their sums. Each document, which is given once, is scored from its own row, and a batch of documents
        passes on its k best of each query; a query set of more than ASKED rows is joined as in :meth:`scores`.
        """
        weighted, rows = self._weighted(queries, query_id, text)
        if rows is None:
            scores = self._joined(weighted, query_id, False)
            scores = scores if digits is None else scores.withColumn("score", F.round("score", digits))
        else:
            scores = self._local(queries, query_id, rows, k, digits)
        return top_by_score(scores, [query_id], "score", [self.id], k)

    def best_scores(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        """``id, score``: each document's best score over the queries that it shares a term with."""
        weighted, rows = self._weighted(queries, query_id, text)
        if rows is None:
            return self._joined(weighted, query_id, False).groupBy(self.id).agg(F.max("score").alias("score"))
        return self._local(queries, query_id, rows, merged=True)


def products(words: pa.ListArray, norm: np.ndarray, terms: pa.Array, ends: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, merged: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and BM25 of the rows of words that share a term with a query; if ``merged`` each row's best alone.

    ``query`` and ``weight`` of a term stand between its two ``ends``.
    """
    at = pc.index_in(words.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    cells, tf = np.unique((row * len(terms) + at)[at >= 0], return_counts=True)
    row, at = np.divmod(cells, len(terms))
    n = ends[at + 1] - ends[at]
    asked = np.arange(n.sum()) + np.repeat(ends[at] - np.cumsum(n) + n, n)
    share = weight[asked] * np.repeat(tf, n) / np.repeat(tf + norm[row], n)
    cells = np.repeat(row, n) * queries + query[asked]
    hit = np.bincount(cells, minlength=len(words) * queries).reshape(len(words), queries) > 0
    scores = np.bincount(cells, share, minlength=len(words) * queries).reshape(len(words), queries)
    if merged:
        x = np.flatnonzero(hit.any(axis=1))
        return np.zeros(len(x), np.int64), x, np.where(hit, scores, -np.inf)[x].max(axis=1)
    x, q = np.nonzero(hit)
    return q, x, scores[x, q]


def best_rows(q: np.ndarray, x: np.ndarray, scores: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, of equal scores those that come first by ``place``."""
    order = np.lexsort((place[x], -scores, q))
    q, x, scores = q[order], x[order], scores[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[kept], x[kept], scores[kept]


def unit(v: str | Column) -> Column:
    """A vector over its length, itself if that is 0 (Q06)."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_search(docs: DataFrame, id_col: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k nearest rows to one vector, ties by id (Q04): a literal, so no join and one top-k."""
    length = sum(x * x for x in query) ** 0.5 or 1.0
    given = F.array(*(F.lit(x / length) for x in query))
    return docs.select(id_col, dot(unit(vector), given).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def best_of_block(queries: np.ndarray, vectors: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors and cosines of each query's k best; of equal scores the first rows."""
    found = []
    for start in range(0, len(queries), TOGETHER):
        scores = queries[start : start + TOGETHER] @ vectors.T
        scores = scores if digits is None else scores.round(digits)
        top = min(k, len(vectors))
        least = np.partition(scores, len(vectors) - top, axis=1)[:, len(vectors) - top]
        q, x = np.nonzero(scores >= least[:, None])
        order = np.lexsort((x, -scores[q, x], q))
        q, x = q[order], x[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < top
        q, x = q[kept], x[kept]
        found.append((q + start, x, scores[q, x]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def cosine_batch(docs: DataFrame, id_col: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, digits: int | None = None) -> DataFrame:
    """The k nearest rows to each query (Q05, Q11), of any number of queries.

    Both sides are dealt in blocks by their ids, and each pair of blocks is one product of matrices that
    yields at most k rows for each query; neither side is broadcast. With ``digits`` scores are rounded
    before ranking, so that equal rows tie. Only vectors of equal length are compared; those that are
    NULL or hold NULL, NaN or infinity have no score and take no part.
    """
    blocks, query_blocks = max(1, math.ceil(docs.count() / BLOCK)), max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def numbered(df: DataFrame, key: str, v: str, own: str, n: int, other: str, others: int) -> DataFrame:
        usable = df.select(F.col(key).alias("id"), F.col(v).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        number = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own)
        return usable.select(number, F.size("v").alias("d"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    asked = numbered(queries, query_id, query_vector, "q", query_blocks, "x", blocks)
    rows = numbered(docs, id_col, vector, "x", blocks, "q", query_blocks)
    kinds = [(query_id, queries.schema[query_id].dataType), (id_col, docs.schema[id_col].dataType)]
    result = pa.schema([*(pa.field(name, to_arrow_type(kind)) for name, kind in kinds), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result.empty_table()
        right = right.sort_by("id")  # so of equal scores the smaller id comes first
        sides = [side["v"].combine_chunks().flatten().to_numpy().reshape(side.num_rows, side["d"][0].as_py()) for side in (left, right)]
        norms = [np.linalg.norm(v, axis=1, keepdims=True) for v in sides]
        q, x, scores = best_of_block(*(v / np.where(norm == 0, 1.0, norm) for v, norm in zip(sides, norms, strict=True)), k, digits)
        return pa.Table.from_arrays([left["id"].take(q), right["id"].take(x), pa.array(scores)], schema=result)

    fields = ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in kinds)
    best = asked.groupBy("q", "x", "d").cogroup(rows.groupBy("q", "x", "d")).applyInArrow(run, f"{fields}, score double")
    return top_by_score(best, [query_id], "score", [id_col], k)


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A pattern for Spark; one that isn't valid is taken literally (Q07)."""
    try:
        re.compile(pattern)
        body = re.sub(r"\(\?P<", "(?<", pattern)
    except re.error:
        body = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    return ("(?i)" if ignore_case else "") + body


def grep_scores(docs: DataFrame, id_col: str, text_col: str, pattern: str, ignore_case: bool = True) -> DataFrame:
    """How often a pattern matches in each document that it matches in (Q07), in no order."""
    scored = docs.select(id_col, F.regexp_count(text_col, F.lit(java_pattern(pattern, ignore_case))).cast("double").alias("score"))
    return scored.where("score > 0")


def grep(docs: DataFrame, id_col: str, text_col: str, pattern: str, k: int, ignore_case: bool = True) -> DataFrame:
    """Documents by how often a pattern matches, if at all, ties by id (Q07)."""
    return grep_scores(docs, id_col, text_col, pattern, ignore_case).orderBy(F.desc("score"), id_col).limit(k)


def hybrid(results: list[DataFrame], keys: list[str], k: int, query: list[str] | None = None) -> DataFrame:
    """Best score over several retrievers, then top k."""
    merged = max_merge(results, keys, "score")
    if query:
        return top_by_score(merged, query, "score", [c for c in keys if c not in query], k)
    return merged.orderBy(F.desc("score"), *keys).limit(k)


def rerank(results: DataFrame, scorer: Callable[[DataFrame], DataFrame], keys: list[str], least: float, k: int) -> DataFrame:
    """Score anew with a pluggable scorer, drop failures and low scores, sort (Q13-Q15)."""
    return scorer(results).where(F.col("score").isNotNull() & (F.col("score") >= least)).orderBy(F.desc("score"), *keys).limit(k)


def cache_key(id_col: str, text_col: str, config: str) -> Column:
    """The key of a cached embedding: its document's content and the embedder's configuration (Q16)."""
    return F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit(""))), F.md5(F.lit(config))), 256)


def cache_split(docs: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a cached result (Q09, Q17)."""
    return docs.join(cache, key), docs.join(cache.select(key), key, "left_anti")


def to_markdown(docs: DataFrame, id_col: str, title: str, text: str, by: list[str] | None = None) -> DataFrame:
    """All documents, or those of each group, as one Markdown text in order of id (Q19): for small corpora only."""
    section = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(text))
    return docs.groupBy(*(by or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), section.alias("s")))), lambda x: x["s"]), "\n\n").alias("markdown"))


class Pipeline:
    """Preprocess, retrieve with several retrievers, merge, rerank.

    ``config`` names one ``retriever`` or a list of ``retrievers``, not both; an empty corpus raises.
    """

    def __init__(self, docs: DataFrame, id_col: str, config: dict, preprocessors: list[Callable[[DataFrame], DataFrame]] | None = None):
        if ("retriever" in config) == ("retrievers" in config):
            raise ValueError("give exactly one of retriever and retrievers")
        for step in preprocessors or []:
            docs = step(docs)
        if docs.isEmpty():
            raise ValueError("the corpus is empty")
        self.docs, self.id, self.config = docs, id_col, config

    def search(self, queries: DataFrame, query_id: str, k: int | None = None) -> DataFrame:
        """The k best documents of each query; ``k`` overrides the configuration's."""
        from sparkloom.functions.registry import retrievers

        names = self.config.get("retrievers") or [self.config["retriever"]]
        results = [retrievers.get(name)(self.docs, queries) for name in names]
        return hybrid(results, [query_id, self.id], k or self.config.get("top_k", 10), [query_id])


def required_documents(asked: DataFrame, docs: DataFrame, wanted: str, id_col: str, title: str) -> DataFrame:
    """Documents by title, else by id (Q18); what is neither is NULL. Of equal titles the smallest id is found."""
    by_title = docs.groupBy(F.col(title).alias(wanted)).agg(F.min(id_col).alias("__t"))
    by_id = docs.select(F.col(id_col).cast("string").alias(wanted), F.col(id_col).alias("__i"))
    return asked.join(by_title, wanted, "left").join(by_id, wanted, "left").withColumn("found", F.coalesce("__t", "__i")).drop("__t", "__i")


def cache_figures(cache: DataFrame, embedder: str, vector: str) -> DataFrame:
    """Entries and numbers held for each embedder."""
    return cache.groupBy(embedder).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size(vector)).cast("long").alias("numbers"))
