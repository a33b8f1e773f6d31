"""What calls rest on: definitions and conditions for each argument, the graph of all that leads to a call, and calls of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.io import cut
from weftgraph.operators import steps
from weftgraph.operators.checks import normalized_code
from weftgraph.operators.taint import argument_links, controlling_conditions, local_definition_tree


def functions_named(g: CodeGraph, name: str, test_id: str | None = None) -> DataFrame:
    """``(id)``: of each test case the function of a name, of several the one with the least id."""
    where = (F.col("type") == "Function") & (F.col("name") == name)
    found = g.node("test_id", where=where if test_id is None else where & (F.col("test_id") == test_id))
    return found.groupBy("test_id").agg(F.min("id").alias("id")).select("id")


def call_arguments(g: CodeGraph, calls: DataFrame) -> DataFrame:
    """``(call, place, argument, statement)``: the arguments of calls, and the statement each call stands in."""
    tree = g.edge("IS_AST_PARENT")
    lists = calls.select(F.col("id").alias("call")).distinct().join(tree.withColumnRenamed("src", "call"), "call").withColumnRenamed("dst", "list")
    args = lists.join(tree.select(F.col("src").alias("list"), F.col("dst").alias("argument")), "list")
    args = args.join(g.node("child_num", where="type = 'Argument'").select(F.col("id").alias("argument"), F.col("child_num").alias("place")), "argument")
    at = steps.statement_of(g, calls.select("id").distinct()).withColumnRenamed("id", "call")
    return args.join(at, "call").select("call", "place", "argument", "statement")


def argument_symbols(g: CodeGraph, arguments: DataFrame) -> DataFrame:
    """The arguments with each ``var`` they use."""
    symbol = g.node("code", where="type = 'Symbol'").select(F.col("id").alias("s"), F.col("code").alias("var"))
    used = g.edge("USE").select(F.col("src").alias("argument"), F.col("dst").alias("s")).join(symbol, "s").select("argument", "var")
    return arguments.join(used, "argument").distinct()


def definitions_per_argument(g: CodeGraph, calls: DataFrame) -> DataFrame:
    """``(call, place, var, definition)``: the statements whose definition of a symbol of an argument reaches the call."""
    named = argument_symbols(g, call_arguments(g, calls))
    reaches = g.edge("REACHES", columns=("src", "dst", "var")).select(F.col("src").alias("definition"), F.col("dst").alias("statement"), "var")
    return named.join(reaches, ["statement", "var"]).select("call", "place", "var", "definition").distinct()


def conditions_per_argument(g: CodeGraph, calls: DataFrame, order: int = 1) -> DataFrame:
    """``(call, place, var, condition, template)``: conditions within ``order`` control steps of a call that use a symbol of an argument, with their code
    as a template in which the symbol, numbers and texts are replaced."""
    named = argument_symbols(g, call_arguments(g, calls))
    held = controlling_conditions(g, named.select(F.col("statement").alias("id")).distinct(), order).select(F.col("root").alias("statement"), F.col("id").alias("condition"))
    symbol = g.node("code", where="type = 'Symbol'").select(F.col("id").alias("s"), F.col("code").alias("var"))
    used = g.edge("USE").select(F.col("src").alias("condition"), F.col("dst").alias("s")).join(symbol, "s").select("condition", "var")
    code = g.node("code", where="type = 'Condition'").withColumnRenamed("id", "condition")
    found = named.join(held, "statement").join(used, ["condition", "var"]).join(code, "condition")
    return found.select("call", "place", "var", "condition", F.trim(normalized_code(F.col("code"), F.col("var"))).alias("template")).distinct()


def call_graphlets(g: CodeGraph, calls: DataFrame, depth: int = 4) -> DataFrame:
    """``(root, level, graphlet, src, dst, kind)``: for each call the definitions and conditions its statement rests on, and through parameters those of
    the statements that call its function, ``depth`` calls up.

    ``kind`` is ``data``, ``condition`` or ``call``; a ``call`` edge leads from the calling statement to the parameter. Recursion ends where a
    statement was looked at before.
    """
    at = steps.statement_of(g, calls.select("id").distinct())
    links = argument_links(g)
    holder = steps.statement_of(g, links.select(F.col("argument").alias("id")).distinct()).withColumnRenamed("id", "argument")
    up = cut(links.join(holder, "argument").select(F.col("parameter").alias("src"), F.col("statement").alias("caller")).distinct())
    level = cut(at.select(F.col("id").alias("root"), F.col("statement").alias("graphlet")))
    seen, found = level, None
    for k in range(depth):
        tree = local_definition_tree(g, level.select(F.col("graphlet").alias("id")).distinct())
        own = cut(level.join(tree, "graphlet").withColumn("level", F.lit(k)))
        calls_up = own.where("kind = 'data'").join(up, "src")
        links_up = calls_up.select("root", "level", "graphlet", F.col("caller").alias("src"), F.col("src").alias("dst"), F.lit("call").alias("kind"))
        part = own.select("root", "level", "graphlet", "src", "dst", "kind").unionByName(links_up).distinct()
        found = part if found is None else found.unionByName(part)
        level = cut(calls_up.select("root", F.col("caller").alias("graphlet")).distinct().join(seen, ["root", "graphlet"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return found


def method_calls(g: CodeGraph) -> DataFrame:
    """``(callee, id, caller)``: calls of methods through objects, and of destructors by ``delete``.

    The class of an object is that of its declaration or parameter in the function; its method is the function ``C :: m`` of the same test case.
    """
    declared = g.node("code", "function_id", where=F.col("type").isin("IdentifierDeclStatement", "Parameter") & F.col("code").isNotNull())
    pattern = r"^(?:const )?(?:struct |class )?([A-Za-z_]\w*) (?:[*&] )*([A-Za-z_]\w*)"
    objects = declared.select("function_id", F.regexp_extract("code", pattern, 1).alias("class"), F.regexp_extract("code", pattern, 2).alias("object")).where("object <> ''").distinct()
    code = g.node("code", "function_id", "test_id", where="is_cfg and code is not null")
    uses = F.transform(F.regexp_extract_all("code", F.lit(r"([A-Za-z_]\w* (?:->|\.) [A-Za-z_]\w*) \("), F.lit(1)), lambda x: F.split(x, " "))
    through = code.select("id", "function_id", "test_id", F.explode(uses).alias("u")).select("id", "function_id", "test_id", F.get("u", F.lit(0)).alias("object"), F.get("u", F.lit(2)).alias("method"))
    gone = F.regexp_extract_all("code", F.lit(r"(?:^| )delete (?:\[ \] )?([A-Za-z_]\w*)"), F.lit(1))
    deleted = code.select("id", "function_id", "test_id", F.explode(gone).alias("object")).withColumn("method", F.lit("~"))
    calls = through.unionByName(deleted).join(objects, ["function_id", "object"])
    method = F.when(F.col("method") == "~", F.concat(F.lit("~"), F.col("class"))).otherwise(F.col("method"))
    calls = calls.withColumn("name", F.concat_ws(" :: ", "class", method))
    named = g.node("name", "test_id", where="type = 'Function' and name like '% :: %'").groupBy("test_id", "name").agg(F.min("id").alias("callee"))
    same = [calls["name"] == named["name"], calls["test_id"].eqNullSafe(named["test_id"])]
    return calls.join(named, same).select("callee", "id", F.col("function_id").alias("caller")).distinct()


def nearest_condition(scopes: DataFrame) -> DataFrame:
    """``(id, test)``: of the conditions in whose arms a node stands, from ``scopes(test, branch, id)``, the one with the smallest arm, ties by id."""
    size = scopes.groupBy("test", "branch").agg(F.count(F.lit(1)).alias("n"))
    sized = scopes.join(size, ["test", "branch"])
    return sized.groupBy("id").agg(F.min(F.struct("n", "test")).getField("test").alias("test"))
