"""Predicates on trees and symbols, symbol filters, and what taints a call's arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators import lookup, steps
from weftgraph.operators.taint import argument_links


def code_matches(pattern: str, symbol: str) -> Column:
    """Whether a whole code matches a pattern in which ``%s`` stands for the symbol as it is; a null code doesn't."""
    return F.coalesce(F.col("code").rlike(lookup.whole(pattern.replace("%s", re.escape(symbol)))), F.lit(False))


def of_ids(g: CodeGraph, ids: list[int]) -> DataFrame:
    """Nodes by id."""
    return g.nodes.where(F.col("id").isin(ids))


def edges_of_ids(g: CodeGraph, pairs: DataFrame) -> DataFrame:
    """Edges between the given ``(src, dst)``."""
    return g.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def check_expressions(g: CodeGraph, pipe: DataFrame, symbol: str) -> DataFrame:
    """Comparisons in the pipe's trees one side of which is the symbol."""
    compared = steps.match(g, pipe, F.col("type").isin("EqualityExpression", "RelationalExpression"), "type")
    sides = g.edge("IS_AST_PARENT").join(g.node(where=F.col("code") == symbol).withColumnRenamed("id", "dst"), "dst", "left_semi")
    return compared.join(sides.select(F.col("src").alias("id")), "id", "left_semi")


def checks(g: CodeGraph, pipe: DataFrame, pattern: str) -> DataFrame:
    """Conditions of the pipe that use a symbol matching the pattern."""
    symbols = g.node(where=(F.col("type") == "Symbol") & F.col("code").rlike(lookup.whole(pattern)))
    using = g.edge("USE").join(symbols.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    conditions = pipe.join(g.node(where="type = 'Condition'"), "id", "left_semi")
    return conditions.join(using, "id", "left_semi")


def calls_within(g: CodeGraph, pipe: DataFrame, pattern: str) -> DataFrame:
    """Calls in the pipe's trees whose whole code matches."""
    return steps.match(g, pipe, (F.col("type") == "CallExpression") & F.col("code").rlike(lookup.whole(pattern)), "type", "code")


def arguments_of(g: CodeGraph, pipe: DataFrame, callee: str, place: int) -> DataFrame:
    """The argument at a place of the calls in the pipe's trees whose code starts with the callee's name."""
    calls = steps.match(g, pipe, (F.col("type") == "CallExpression") & F.startswith("code", F.lit(callee)), "type", "code")
    return steps.ith_arguments(g, calls.distinct(), place)


def parameters_matching(g: CodeGraph, pipe: DataFrame, pattern: str) -> DataFrame:
    """Parameters in the pipe's trees whose whole code matches."""
    return steps.match(g, pipe, (F.col("type") == "Parameter") & F.col("code").rlike(lookup.whole(pattern)), "type", "code")


def api_symbols(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(top, symbol)``: names called, and types declared or taken as parameters, in the pipe's trees."""
    named = g.node("code", where=F.col("type").isin("Callee", "IdentifierDeclType", "Parameter") & F.col("code").isNotNull())
    return steps.below(g, pipe).join(named, "id").select("top", F.col("code").alias("symbol"))


def longest_uses(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(id, symbol)``: the symbols each node uses without those that stand inside a longer one of the same node."""
    symbol = g.node("code", where="type = 'Symbol'").select(F.col("id").alias("dst"), F.col("code").alias("symbol"))
    used = pipe.select(F.col("id").alias("src")).join(g.edge("USE"), "src").join(symbol, "dst").select(F.col("src").alias("id"), "symbol").distinct()
    longer = used.select("id", F.col("symbol").alias("other"))
    inside = used.join(longer, "id").where((F.length("other") > F.length("symbol")) & F.contains("other", F.col("symbol")))
    return used.join(inside.select("id", "symbol").distinct(), ["id", "symbol"], "left_anti")


def tree_sinks(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(id, sink)``: for nodes of trees that define a symbol, the statements this symbol reaches from theirs."""
    return _through_trees(g, pipe, "DEF", "src", "dst")


def tree_sources(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(id, sink)``: for nodes of trees that use a symbol, the statements it reaches theirs from."""
    return _through_trees(g, pipe, "USE", "dst", "src")


def _through_trees(g: CodeGraph, pipe: DataFrame, kind: str, here: str, there: str) -> DataFrame:
    symbol = g.node("code", where="type = 'Symbol'").select(F.col("id").alias("s"), F.col("code").alias("var"))
    own = pipe.select("id").join(g.edge(kind).select(F.col("src").alias("id"), F.col("dst").alias("s")), "id").join(symbol, "s").select("id", "var").distinct()
    at = own.join(steps.statement_of(g, pipe.select("id").distinct()), "id").withColumnRenamed("statement", here)
    return at.join(g.edge("REACHES", columns=("src", "dst", "var")), [here, "var"]).select("id", F.col(there).alias("sink")).distinct()


def argument_tainters(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(argument, id)``: statements that, in the function called, define what reaches its exit through the parameter of an argument."""
    links = argument_links(g).join(pipe.select(F.col("id").alias("argument")).distinct(), "argument", "left_semi")
    named = links.join(g.node("function_id").withColumnRenamed("id", "parameter"), "parameter")
    name = g.edge("IS_AST_PARENT").select(F.col("src").alias("parameter"), F.col("dst").alias("i")).join(g.node("code", where="type = 'Identifier'").withColumnRenamed("id", "i"), "i")
    wanted = named.join(name, "parameter").select("argument", "function_id", F.concat(F.lit("* "), F.col("code")).alias("var"))
    leave = g.node("function_id", where="type = 'CFGExitNode'").withColumnRenamed("id", "dst")
    return wanted.join(leave, "function_id").join(g.edge("REACHES", columns=("src", "dst", "var")), ["dst", "var"]).select("argument", F.col("src").alias("id")).distinct()


def new_edges(before: DataFrame, after: DataFrame, *kinds: str) -> DataFrame:
    """``(src, dst, etype, var)`` of ``after`` that ``before`` lacks, as after tainting arguments."""
    columns = ["src", "dst", "etype", "var"]
    of = lambda e: e.where(F.col("etype").isin(*kinds)).select(*columns) if kinds else e.select(*columns)
    return of(after).subtract(of(before))


def normalized_code(code: Column, argument: Column) -> Column:
    """A condition's code as a template: the argument, numbers and texts by placeholders."""
    parts = F.split(code, " ")
    one = lambda t: F.when(t.rlike(r"^[0-9]"), "NUM").when(t.rlike("^[\"']"), "TEXT").otherwise(t)
    return F.array_join(F.transform(F.split(F.replace(F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" ")), F.concat(F.lit(" "), argument, F.lit(" ")), F.lit(" ARG ")), " "), one), " ")
