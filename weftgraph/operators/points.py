"""Points of interest in code: calls of sensitive functions, pointers, arrays and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph

# Functions that often stand at the root of memory errors; give your own list where another is wanted.
SENSITIVE = [
    "strcpy", "strncpy", "strcat", "strncat", "sprintf", "snprintf", "vsprintf", "gets", "fgets", "scanf", "fscanf", "sscanf", "memcpy", "memmove", "memset", "malloc", "calloc", "realloc",
    "free", "read", "recv", "system", "execl", "popen", "printf", "fprintf", "alloca",
]

STATEMENTS = ["IdentifierDeclStatement", "ExpressionStatement", "Condition", "ReturnStatement", "Parameter", "Statement"]


def called_names(code: Column) -> Column:
    """The names before an opening bracket, in order, without words of the language."""
    found = F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z0-9_]*) ?\("), F.lit(1))
    return F.filter(found, lambda x: ~x.isin("if", "for", "while", "switch", "return", "sizeof", "case"))


def _declared(code: Column) -> Column:
    """What stands before the first assignment."""
    return F.get(F.split(code, " = "), F.lit(0))


def is_pointer(code: Column) -> Column:
    return F.contains(_declared(code), F.lit("*"))


def is_array(code: Column) -> Column:
    return F.contains(_declared(code), F.lit(" [ "))


def is_arithmetic(code: Column) -> Column:
    """Whether the last assigned value, or a division by a name, computes something."""
    right = F.element_at(F.split(code, " = "), -1)
    return (F.contains(code, F.lit(" = ")) & right.rlike(r"[A-Za-z0-9_\])] (\+|-|\*|%) [A-Za-z0-9_(]")) | code.rlike(r" / [A-Za-z_]")


def call_points(g: CodeGraph, sensitive: list[str] | None = None) -> DataFrame:
    """``(id, function_id, test_id, name)``: statements that call a sensitive function, a row for each such name."""
    names = g.nodes.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(sensitive or SENSITIVE)], "name string")
    code = g.node("type", "code", "function_id", "test_id", where=F.col("type").isin(STATEMENTS) & F.col("code").isNotNull())
    called = code.select("id", "function_id", "test_id", F.explode(F.array_distinct(called_names(F.col("code")))).alias("name"))
    return called.join(F.broadcast(names), "name", "left_semi").select("id", "function_id", "test_id", "name")


def declaration_points(g: CodeGraph, kind: str) -> DataFrame:
    """``(id, function_id, test_id, code)``: declarations and parameters of a ``pointer`` or an ``array``."""
    test = {"pointer": is_pointer, "array": is_array}[kind](F.col("code"))
    return g.node("type", "code", "function_id", "test_id", where=F.col("type").isin("IdentifierDeclStatement", "Parameter") & test).drop("type")


def arithmetic_points(g: CodeGraph) -> DataFrame:
    """``(id, function_id, test_id, code)``: expression statements that compute."""
    return g.node("type", "code", "function_id", "test_id", where=(F.col("type") == "ExpressionStatement") & is_arithmetic(F.col("code"))).drop("type")


def last_uses(g: CodeGraph, kind: str) -> DataFrame:
    """``(id, use)``: of each pointer or array declaration the use in the latest line, of several there the one with the least id."""
    decl = declaration_points(g, kind).select("id")
    uses = decl.join(g.edge("REACHES").withColumnRenamed("src", "id"), "id").withColumnRenamed("dst", "use")
    line = g.node("line").select(F.col("id").alias("use"), "line")
    return uses.join(line, "use").groupBy("id").agg(F.max(F.struct("line", (-F.col("use")).alias("k"))).alias("m")).select("id", (-F.col("m.k")).alias("use"))


def points_by_case(points: DataFrame) -> DataFrame:
    """``(test_id, n, ids)``: the points of each test case in order of ids."""
    return points.groupBy("test_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("id")).alias("ids"))
