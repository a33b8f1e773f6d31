"""Syntax trees and symbols for graphs that were delivered without: what the text of statements and the data edges tell, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.io import cut

#: The ids of a statement's tree begin at its own id times this; each of its calls has ``CALL`` of them, so that a statement may hold 8,192 calls of
#: 1,000 arguments; symbols of a function lie in the upper half of the function's.
STRIDE, CALL = 1 << 24, 1 << 10

# Words before a bracket that call nothing.
NO_CALLEES = ["if", "for", "while", "switch", "return", "sizeof", "case"]


def flat_calls(g: CodeGraph) -> DataFrame:
    """``(at, first, place, code, name, inside, args, function_id, test_id)``: the calls inside each statement's code whose arguments hold no brackets;
    ``first`` is the id that those of the call's tree begin behind."""
    code = g.node("code", "function_id", "test_id", where="is_cfg and code is not null and function_id is not null")
    found = F.regexp_extract_all("code", F.lit(r"[A-Za-z_][A-Za-z0-9_]* \([^()]*\)"), F.lit(0))
    calls = code.select(F.col("id").alias("at"), "function_id", "test_id", F.posexplode(found).alias("place", "code"))
    open_ = F.instr("code", "(")
    inside = F.trim(F.substring("code", open_ + 1, F.length("code") - open_ - 1))
    calls = calls.select("*", F.substring_index("code", " (", 1).alias("name"), inside.alias("inside")).where(~F.col("name").isin(NO_CALLEES))
    args = F.when(F.col("inside") == "", F.array().cast("array<string>")).otherwise(F.split("inside", " , "))
    return calls.withColumns({"args": args, "first": F.col("at") * STRIDE + F.col("place") * CALL})


def _tree(kind: str, id_: Column, code: Column, place: Column | int, above: Column) -> Column:
    place = F.lit(place) if isinstance(place, int) else place
    return F.struct(id_.alias("id"), F.lit(kind).alias("type"), code.alias("code"), place.cast("int").alias("child_num"), above.alias("above"))


def trees(g: CodeGraph) -> DataFrame:
    """``(id, type, code, child_num, above, function_id, test_id)``: the nodes of the trees below statements, parameters and functions.

    A call is a ``CallExpression`` of a ``Callee`` and an ``ArgumentList`` of ``Argument``; a condition that compares two names or numbers, or joins
    two operands without brackets by ``&&``, is the expression of these; a parameter has a ``ParameterType`` and an ``Identifier``; a function has a
    ``FunctionDef``.
    """
    calls = flat_calls(g)
    k = F.col("first")
    args = F.transform("args", lambda a, i: _tree("Argument", k + 4 + i, a, i, k + 3))
    own = F.array(_tree("CallExpression", k + 1, F.col("code"), F.col("place"), F.col("at")), _tree("Callee", k + 2, F.col("name"), 0, k + 1), _tree("ArgumentList", k + 3, F.col("inside"), 1, k + 1))
    parts = [calls.select(F.inline(F.concat(own, args)), "function_id", "test_id")]
    k, t = F.col("id") * STRIDE, F.col("id")
    plain = g.node("code", "function_id", "test_id", where="type = 'Condition' and function_id is not null and instr(code, '(') = 0")
    operand = lambda n: F.regexp_extract("code", r"^(\w+) (<|>|<=|>=|==|!=) (\w+)$", n)
    compared = plain.where(operand(2) != "")
    for kind, equal in (("EqualityExpression", True), ("RelationalExpression", False)):
        rows = compared.where(operand(2).isin("==", "!=") if equal else ~operand(2).isin("==", "!="))
        made = F.array(_tree(kind, k + 1, F.col("code"), 0, t), _tree("Identifier", k + 2, operand(1), 0, k + 1), _tree("Identifier", k + 3, operand(3), 1, k + 1))
        parts.append(rows.select(F.inline(made), "function_id", "test_id"))
    side = F.split("code", " && ")
    joined = F.array(_tree("AndExpression", k + 1, F.col("code"), 0, t), *(_tree("Expression", k + 2 + i, F.get(side, F.lit(i)), i, k + 1) for i in (0, 1)))
    parts.append(plain.where(F.size(side) == 2).select(F.inline(joined), "function_id", "test_id"))
    params = g.node("base_type", "identifier", "function_id", "test_id", where="type = 'Parameter' and function_id is not null")
    made = F.array(_tree("ParameterType", k + 1, F.col("base_type"), 0, t), _tree("Identifier", k + 2, F.col("identifier"), 1, t))
    parts.append(params.select(F.inline(made), "function_id", "test_id"))
    defs = g.node("name", "test_id", where="type = 'Function'")
    parts.append(defs.select(F.inline(F.array(_tree("FunctionDef", k + 1, F.col("name"), 0, t))), F.col("id").alias("function_id"), "test_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_callees(g: CodeGraph) -> CodeGraph:
    """The graph with the callees of its calls alone, for what asks only who calls whom: nothing is written."""
    made = flat_calls(g).select(F.inline(F.array(_tree("Callee", F.col("first") + 2, F.col("name"), 0, F.col("first") + 1))), "function_id", "test_id").drop("above")
    return CodeGraph(g.nodes.unionByName(made, allowMissingColumns=True), g.edges)


def symbols(g: CodeGraph) -> DataFrame:
    """``(symbol, id, is_def, code, function_id)``: each symbol that data edges carry, with the statements that define and that use it."""
    data = g.edge("REACHES", columns=("src", "dst", "var", "function_id")).where("function_id is not null and var is not null")
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("is_def")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("is_def")))
    rows = data.select("function_id", F.col("var").alias("code"), F.inline(ends)).distinct()
    rank = F.dense_rank().over(Window.partitionBy("function_id").orderBy("code"))
    return rows.select((F.col("function_id") * STRIDE + STRIDE // 2 + rank).alias("symbol"), "id", "is_def", "code", "function_id")


def with_trees(g: CodeGraph) -> CodeGraph:
    """The graph with its trees and symbols: IS_AST_PARENT, IS_FUNCTION_OF_AST, USE and DEF edges. Arguments use the symbols of their function that they
    name. Trees and symbols are made once and lie in the shared folder, for every step joins with them."""
    tree, known = cut(trees(g)), cut(symbols(g))
    names = known.select("symbol", "code", "function_id").distinct()
    node = tree.select("id", "type", "code", "child_num", "function_id", "test_id")
    node = node.unionByName(names.select(F.col("symbol").alias("id"), F.lit("Symbol").alias("type"), "code", "function_id"), allowMissingColumns=True)
    nodes = g.nodes.unionByName(node, allowMissingColumns=True)
    up = F.when(F.col("type") == "FunctionDef", "IS_FUNCTION_OF_AST").otherwise("IS_AST_PARENT")
    parts = [tree.select(F.col("above").alias("src"), F.col("id").alias("dst"), up.alias("etype"), "function_id")]
    body = g.node("function_id", where="is_cfg and function_id is not null")
    parts.append(body.select((F.col("function_id") * STRIDE + 1).alias("src"), F.col("id").alias("dst"), F.lit("IS_AST_PARENT").alias("etype"), "function_id"))
    parts.append(known.select(F.col("id").alias("src"), F.col("symbol").alias("dst"), F.when(F.col("is_def"), "DEF").otherwise("USE").alias("etype"), "function_id"))
    args = tree.where("type = 'Argument'").select("id", "code", "function_id").join(names, ["code", "function_id"])
    parts.append(args.select(F.col("id").alias("src"), F.col("symbol").alias("dst"), F.lit("USE").alias("etype"), "function_id"))
    edges = g.edges
    for p in parts:
        edges = edges.unionByName(p, allowMissingColumns=True)
    return CodeGraph(nodes, edges)
