"""Registries of operators, tools and detectors, and their Column forms."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("read", "write", "think", "generic")


class Registry:
    """Names to functions (U01-U04, U09); a name is given once."""

    def __init__(self, what: str):
        self.what, self._known = what, {}

    def register(self, name: str) -> Callable:
        def keep(fn: Callable) -> Callable:
            if name in self._known:
                raise ValueError(f"{self.what} {name} is registered twice")
            self._known[name] = fn
            return fn

        return keep

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"unknown {self.what} {name}; known: {', '.join(sorted(self._known))}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


retrievers, scorers, embedders, detectors = Registry("retriever"), Registry("scorer"), Registry("embedder"), Registry("detector")


@dataclass(frozen=True)
class Tool:
    """A function with what it does to state."""

    name: str
    kind: str
    returns: str
    fn: Callable[..., Any]
    hidden: bool = False

    @property
    def mutates(self) -> bool:
        return self.kind == "write"


class ToolCatalog:
    """Tools by name; hidden ones must be unlocked before they are listed."""

    def __init__(self):
        self._tools: dict[str, Tool] = {}
        self._open: set[str] = set()

    def tool(self, kind: str, returns: str = "string", hidden: bool = False) -> Callable:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")

        def keep(fn: Callable) -> Callable:
            self._tools[fn.__name__] = Tool(fn.__name__, kind, returns, fn, hidden)
            return fn

        return keep

    def unlock(self, name: str) -> None:
        self._open.add(self._tools[name].name)

    def listed(self) -> list[Tool]:
        return [t for _, t in sorted(self._tools.items()) if not t.hidden or t.name in self._open]

    def writes(self) -> list[str]:
        """Names of the tools that change state."""
        return [t.name for t in self.listed() if t.mutates]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table."""
        return spark.createDataFrame([(t.name, t.kind, t.returns, t.mutates) for t in self.listed()], "name string, kind string, returns string, mutates boolean")

    def register_sql(self, spark: SparkSession) -> None:
        """Make the listed tools callable from SQL (U07); rows go to Python as Arrow batches."""
        for t in self.listed():
            spark.udf.register(t.name, F.udf(t.fn, t.returns, useArrow=True))


def batched(detector: Callable[[], Callable[[list[str]], list[str | None]]]) -> Callable[[str | Column], Column]:
    """A detector over batches of texts as a Column function.

    ``detector`` makes the model and is called once for each task's stream of batches (U11); blank texts give NULL.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = detector()
        for texts in batches:
            flat = [None if t is None or not t.strip() else t.replace("\n", " ") for t in texts]
            asked = [t for t in flat if t is not None]
            answers = iter(found(asked) if asked else [])
            yield pd.Series([None if t is None else next(answers) for t in flat], dtype=object)

    return F.pandas_udf(run, "string")


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], name: str = "embedding") -> DataFrame:
    """Attach vectors by a batch function (U12, Q08); NULL texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder([t or "" for t in texts])))

    return df.withColumn(name, run(text))


def respond(df: DataFrame, catalog: ToolCatalog, name: str, arguments: str) -> DataFrame:
    """Each call's response as JSON text, and whether it failed (V35): an exception gives ``Error: ...``.

    ``arguments`` is a JSON object; an unknown or hidden tool fails as well.
    """
    tools = {t.name: t.fn for t in catalog.listed()}

    @F.pandas_udf("struct<response:string,error:boolean>")
    def run(names: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = []
        for tool, text in zip(names, given, strict=True):
            try:
                if tool not in tools:
                    raise ValueError(f"no tool {tool}")
                rows.append((json.dumps(tools[tool](**json.loads(text or "{}")), default=str), False))
            except Exception as e:  # whatever a tool raises is its response
                rows.append((json.dumps(f"Error: {e}"), True))
        return pd.DataFrame(rows, columns=["response", "error"])

    return df.withColumn("__r", run(name, arguments)).select(*df.columns, "__r.response", "__r.error")


def encoded(queries: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], name: str = "vector") -> DataFrame:
    """Queries with their vectors (V40): each distinct text is encoded once, in batches; a blank query raises."""
    blank = F.raise_error(F.lit("a blank query has no vector")).cast("string")
    checked = queries.withColumn(text, F.when(F.trim(F.coalesce(text, F.lit(""))) == "", blank).otherwise(F.col(text)))
    return checked.join(embed(checked.select(text).distinct(), text, embedder, name), text)
