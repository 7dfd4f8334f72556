"""Protected terms: cut them out as numbered marks and put them back (X20-X23), and safe arithmetic."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def term_pattern(terms: Iterable[str]) -> str:
    """Longest terms first; identifiers only as whole words."""
    parts = [rf"\b{re.escape(t)}\b" if re.fullmatch(r"\w+", t) else re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)) if t]
    return "|".join(parts) or r"(?!)"


def mask_text(text: str, pattern: str) -> tuple[str, list[str]]:
    """The text with marks ``[[0]]``, ``[[1]]``, ... and what they stand for."""
    found: list[str] = []

    def mark(m: re.Match) -> str:
        found.append(m.group())
        return f"[[{len(found) - 1}]]"

    return re.sub(pattern, mark, text), found


def unmask_text(text: str, found: list[str]) -> str:
    """The text with its marks filled in again; a lost mark raises."""
    for k in range(len(found)):
        if f"[[{k}]]" not in text:
            raise ValueError(f"mark {k} was lost")
    return re.sub(r"\[\[(\d+)\]\]", lambda m: found[int(m[1])] if int(m[1]) < len(found) else m[0], text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _java_terms(terms: Iterable[str]) -> str:
    """:func:`term_pattern` for Spark, words being of letters and digits of any script."""
    word = r"[\p{L}\p{N}_]"
    bounded = [rf"(?<!{word}){re.escape(t)}(?!{word})" if re.fullmatch(r"\w+", t) else re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)) if t]
    return "|".join(bounded) or r"(?!)"


def mask(c: str | Column, terms: Iterable[str]) -> Column:
    """``struct<text, terms>`` of each text; NULL stays NULL. No text passes through Python."""
    c, pattern = F.col(c) if isinstance(c, str) else c, F.lit(_java_terms(terms))
    marked = F.transform(F.split(c, pattern, -1), lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit("[["), (i - 1).cast("string"), F.lit("]]"), part)))
    return F.struct(F.array_join(marked, "").alias("text"), F.regexp_extract_all(c, pattern, F.lit(0)).alias("terms"))


def unmask(text: str | Column, terms: str | Column) -> Column:
    """The text with its marks filled in again, NULL stays NULL; a lost mark raises."""
    text, terms = (F.col(c) if isinstance(c, str) else c for c in (text, terms))
    mark = r"\[\[([0-9]+)\]\]"
    parts = F.struct(F.split(text, F.lit(mark), -1).alias("parts"), F.regexp_extract_all(text, F.lit(mark), F.lit(1)).alias("marks"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))

    def filled(s: Column) -> Column:
        def one(part: Column, number: Column) -> Column:
            at = number.try_cast("int")
            return F.when(number.isNull(), part).otherwise(F.concat(F.when(at < F.size(s["terms"]), F.get(s["terms"], at)).otherwise(F.concat(F.lit("[["), number, F.lit("]]"))), part))

        lost = F.array_except(F.transform(s["terms"], lambda x, i: i.cast("string")), s["marks"])
        whole = F.array_join(F.zip_with(s["parts"], F.concat(F.array(F.lit(None).cast("string")), s["marks"]), one), "")
        return F.when(F.size(lost) > 0, F.raise_error(F.concat(F.lit("mark "), F.get(lost, F.lit(0)), F.lit(" was lost")))).otherwise(whole)

    return F.when(text.isNotNull(), _once(parts, filled))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def calculate_text(expression: str) -> float:
    """Arithmetic on numbers with + - * / and brackets, rounded to cents; anything else raises."""
    if len(expression) > 1000 or not re.fullmatch(r"[0-9+\-*/(). ]+", expression):
        raise ValueError("only numbers and + - * / ( ) are allowed")

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        raise ValueError("only numbers and + - * / ( ) are allowed")

    return round(float(value(ast.parse(expression.strip(), mode="eval").body)), 2)


def calculate(c: str | Column) -> Column:
    """Each text's value, NULL where it can't be calculated."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return calculate_text(t)
            except (ValueError, SyntaxError, ZeroDivisionError, TypeError, OverflowError):
                return None

        return pd.Series([one(t) for t in texts], dtype="float64")

    return run(c)


def set_json_values(c: str | Column, paths: str | Column, values: str | Column) -> Column:
    """A JSON text with values set at paths like ``a/0/b`` (X38); paths that it lacks change nothing."""
    import json

    @F.pandas_udf("string")
    def run(texts: pd.Series, where: pd.Series, what: pd.Series) -> pd.Series:
        out = []
        for text, keys, new in zip(texts, where, what, strict=True):
            if text is None:
                out.append(None)
                continue
            record = json.loads(text)
            for key, value in zip([] if keys is None else keys, [] if new is None else new, strict=False):
                *parents, last = key.split("/")
                node = record
                try:
                    for part in parents:
                        node = node[int(part)] if isinstance(node, list) else node[part]
                    at = int(last) if isinstance(node, list) else last
                    node[at]  # only what is there
                    node[at] = value
                except (KeyError, IndexError, ValueError, TypeError):
                    continue
            out.append(json.dumps(record, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return run(c, paths, values)
