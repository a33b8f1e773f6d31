"""Lookups: filtered scans that take the place of an index. Each gives rows of ``nodes``; filters reach the Parquet scan.

``nodes`` may hold several deliveries of an id; the rows found then do too. Take ``distinct`` of the columns you need, after the filter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TERM = re.compile(r'\s*(?P<key>[A-Za-z_]+)\s*:\s*(?:"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<bare>\S+))\s*(?P<op>AND|$)')


def whole(pattern: str) -> str:
    """A pattern that must match from the first to the last character."""
    return f"^(?s:{pattern})$"


def wildcard(column: str, value: str) -> Column:
    """Equality, or with ``*`` and ``?`` in the value a match of any run or of any one character."""
    if not re.search(r"(?<!\\)[*?]", value):
        return F.col(column) == value.replace("\\*", "*").replace("\\?", "?")
    like = re.sub(r"([%_])", r"\\\1", value)
    return F.col(column).like(like.replace("*", "%").replace("?", "_"))


def query(nodes: DataFrame, text: str) -> DataFrame:
    """Rows that meet ``key:value AND key:"quoted value" ...``, with ``*`` as wildcard. What can't be read as such a query gives no rows."""
    kinds, found, at = dict(nodes.dtypes), [], 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m or m["key"] not in kinds or m["op"] == "AND" and m.end() == len(text):
            return nodes.limit(0)
        value = m["quoted"] if m["quoted"] is not None else m["bare"]
        if kinds[m["key"]] == "string":
            found.append(wildcard(m["key"], value))
        else:
            found.append(F.col(m["key"]) == F.lit(value).try_cast(kinds[m["key"]]))
        at = m.end()
    if not found:
        return nodes.limit(0)
    for condition in found:
        nodes = nodes.where(condition)
    return nodes


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def by_type_and_code(nodes: DataFrame, kind: str, code: str) -> DataFrame:
    return by_type(nodes, kind).where(wildcard("code", code))


def by_type_and_name(nodes: DataFrame, kind: str, name: str) -> DataFrame:
    return by_type(nodes, kind).where(wildcard("name", name))


def functions_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return by_type_and_name(nodes, "Function", name)


def functions_by_parameter(nodes: DataFrame, code: str) -> DataFrame:
    """Functions with a parameter of this code."""
    owners = by_type_and_code(nodes, "Parameter", code).select(F.col("function_id").alias("id"))
    return by_type(nodes, "Function").join(owners, "id", "left_semi")


def functions_by_file(nodes: DataFrame, path: str, name: str = "*") -> DataFrame:
    """Functions of the files whose path fits; ``*`` stands for any run of characters."""
    return functions_by_name(nodes, name).where(wildcard("filepath", path))


def files_by_name(nodes: DataFrame, path: str) -> DataFrame:
    """``(filepath)`` of the files whose path fits."""
    return nodes.where(wildcard("filepath", path)).select("filepath").distinct()


def statements(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_cfg")


def conditions(nodes: DataFrame) -> DataFrame:
    return by_type(nodes, "Condition")


def calls(nodes: DataFrame) -> DataFrame:
    """Call nodes of a graph with syntax trees; in one without, ``slices.text_calls`` finds calls in the text of statements."""
    return by_type(nodes, "CallExpression")


def calls_to(nodes: DataFrame, edges: DataFrame, callee: str) -> DataFrame:
    """Calls of ``callee``, of which the last blank-separated part without stars counts."""
    name = callee.split(" ")[-1].replace("*", "")
    found = by_type(nodes, "Callee").where(F.col("code") == name).select(F.col("id").alias("dst"))
    up = edges.where("etype = 'IS_AST_PARENT'").join(found, "dst", "left_semi").select(F.col("src").alias("id"))
    return nodes.join(up, "id", "left_semi")


def calls_with_prefix(nodes: DataFrame, source: str, function_id: int | None = None) -> DataFrame:
    """Call nodes, or statements, whose code starts with the source and a blank."""
    found = nodes.where(F.col("code").startswith(source + " "))
    return found if function_id is None else found.where(F.col("function_id") == function_id)


def conditions_of(nodes: DataFrame, function: str, pattern: str, path: str | None = None) -> DataFrame:
    """Conditions whose whole code matches, of the functions with this name, and of this file if given."""
    owners = functions_by_name(nodes, function)
    owners = owners if path is None else owners.where(wildcard("filepath", path))
    return conditions(nodes).where(F.col("code").rlike(whole(pattern))).join(owners.select(F.col("id").alias("function_id")), "function_id", "left_semi")


def in_functions_of(found: DataFrame, pipe: DataFrame) -> DataFrame:
    """Those of ``found`` that stand in a function of some node of ``pipe``: chained lookups meet in functions."""
    return found.join(pipe.select("function_id").where("function_id is not null").distinct(), "function_id", "left_semi")


def not_in_functions_of(pipe: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``pipe`` in whose function nothing of ``found`` stands; nodes without a function stay."""
    return pipe.join(found.select("function_id").where("function_id is not null").distinct(), "function_id", "left_anti")


def of_function(nodes: DataFrame, function_id: int) -> DataFrame:
    return nodes.where(F.col("function_id") == function_id)


def find(nodes: DataFrame, kind: str | None = None, limit: int | None = None, **properties) -> DataFrame:
    """Nodes with this type and these properties; ``limit`` is the caller's own."""
    for k, v in ({"type": kind} if kind else {}).items() | properties.items():
        nodes = nodes.where(F.col(k).eqNullSafe(F.lit(v)))
    return nodes if limit is None else nodes.orderBy("id").limit(limit)


def ranked(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """``(id, score)``: how many of the terms a code holds as blank-separated tokens, best first, ties by id; codes with none are left out."""
    tokens = F.split("code", " ")
    score = sum((F.array_contains(tokens, t).cast("int") for t in dict.fromkeys(terms)), F.lit(0))
    return nodes.where("code is not null").select("id", score.alias("score")).distinct().where("score > 0").orderBy(F.desc("score"), "id")
