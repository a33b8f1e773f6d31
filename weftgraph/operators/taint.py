"""Source to sink: unsanitised paths within functions, and bounded tracking across calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.io import cut
from weftgraph.operators import lookup, steps
from weftgraph.operators.reach import hops, paths, reach


def unsanitized_paths(g: CodeGraph, starts: DataFrame, targets: DataFrame, sanitizer: Column | None = None, most_nodes: int = 20) -> DataFrame:
    """``(start, end, var, path)``: a control flow path on which a definition gets to its use, not defined again and not sanitised.

    ``starts`` and ``targets`` are pipes; a pair is looked at where a definition of ``var`` at the start reaches the target. ``sanitizer`` is a
    predicate on the code of a statement. A target that defines the symbol itself, or is a sanitiser, ends no path; a start may be either. Only definitions and sanitisers of the start's own function count.
    """
    reaches = g.edge("REACHES", columns=("src", "dst", "var")).where("var is not null")
    pairs = reaches.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    owner = g.node("function_id", where="function_id is not null")
    defining = reaches.select(F.col("src").alias("id"), "var").distinct().join(owner, "id")
    # A start and a symbol are one root of the search, for another symbol has other ends and stops.
    roots = pairs.select(F.xxhash64("src", "var").alias("root"), "src", "var").distinct()
    of_root = roots.join(owner.withColumnRenamed("id", "src"), "src")
    stops = of_root.join(defining, ["function_id", "var"]).where("id <> src").select(F.col("root").alias("start"), "id")
    if sanitizer is not None:
        clean = g.node("code", "function_id", where=sanitizer).select("id", "function_id")
        stops = stops.unionByName(of_root.join(clean, "function_id").where("id <> src").select(F.col("root").alias("start"), "id"))
    entry = roots.select(F.col("root").alias("src"), F.col("src").alias("dst"))
    edges = g.edge("FLOWS_TO").unionByName(entry)
    ends = pairs.select(F.xxhash64("src", "var").alias("start"), F.col("dst").alias("end"))
    found = paths(edges, roots.select(F.col("root").alias("start")), ends, most_nodes + 1, 2, stops)
    named = found.join(roots.withColumnRenamed("root", "start"), "start")
    return named.select(F.col("src").alias("start"), "end", "var", F.slice("path", 2, F.size("path")).alias("path"))


def controlling_conditions(g: CodeGraph, pipe: DataFrame, order: int | None = 1) -> DataFrame:
    """``(root, id)``: conditions that control the pipe's nodes within ``order`` steps, or at any distance."""
    return hops(g.edge("CONTROLS", columns=("src", "dst", "function_id")), pipe, order, F.lit(True), g.node("type", where="type = 'Condition'"))


def sub_conditions(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """The expressions of conditions and the operands of every ``&&`` and ``||`` in them."""
    first = steps.ith_children(g, pipe, 0)
    logical = steps.match(g, pipe, F.col("type").isin("AndExpression", "OrExpression"), "type")
    return steps.set_union(first, steps.children(g, logical))


def argument_links(g: CodeGraph) -> DataFrame:
    """``(argument, parameter)``: arguments and the parameters they become, by name of the callee within its test case and by place, where their numbers
    agree. Calls and functions without a test case go together."""
    kinds = ["Callee", "ArgumentList", "Argument", "Function", "Parameter"]
    nodes = g.node("type", "code", "name", "child_num", "function_id", "test_id", where=F.col("type").isin(kinds))
    nodes = nodes.withColumn("case", F.coalesce("test_id", F.lit("")))
    tree = g.edge("IS_AST_PARENT")
    child = lambda top, kind, key: tree.select(F.col("src").alias(top), F.col("dst").alias("id")).join(nodes.where(F.col("type") == kind), "id").withColumnRenamed("id", key)
    callee = child("call", "Callee", "callee").select("call", "case", F.element_at(F.split("code", " "), -1).alias("name"))
    lists = child("call", "ArgumentList", "list").select("call", "list")
    args = child("list", "Argument", "argument").select("list", "argument", F.col("child_num").alias("place"))
    args = args.join(lists, "list").select("call", "argument", "place")
    n_args = args.groupBy("call").agg(F.count(F.lit(1)).alias("n"))
    functions = nodes.where("type = 'Function'").select(F.col("id").alias("function_id"), "name", "case")
    params = nodes.where("type = 'Parameter'").select(F.col("id").alias("parameter"), "function_id", F.col("child_num").alias("place"))
    n_params = params.groupBy("function_id").agg(F.count(F.lit(1)).alias("n"))
    resolved = callee.join(functions, ["name", "case"]).join(n_args, "call").join(n_params, ["function_id", "n"]).select("call", "function_id")
    return args.join(resolved, "call").join(params, ["function_id", "place"]).select("argument", "parameter")


def expand_parameters(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """Parameters become the arguments of their callers, if there are any; other nodes stay."""
    links = argument_links(g).select(F.col("parameter").alias("id"), "argument")
    return pipe.select("id").join(links, "id", "left").select(F.coalesce("argument", "id").alias("id"))


def expand_arguments(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """Arguments become the parameters of their callees, if these are known; other nodes stay."""
    links = argument_links(g).select(F.col("argument").alias("id"), "parameter")
    return pipe.select("id").join(links, "id", "left").select(F.coalesce("parameter", "id").alias("id"))


def interprocedural_edges(g: CodeGraph) -> DataFrame:
    """IS_ARG edges ``(src, dst, etype)`` from arguments to parameters."""
    return argument_links(g).select(F.col("argument").alias("src"), F.col("parameter").alias("dst"), F.lit("IS_ARG").alias("etype")).distinct()


def tainted_by(g: CodeGraph, pipe: DataFrame, loops: int = 4, sanitizer: Column | None = None) -> DataFrame:
    """``(root, id, hops)``: statements that data flows from to the pipe's, within functions and from callers' arguments, in ``loops`` steps.

    A step goes from a use to a definition that reaches it, or from a parameter to the statements that hold an argument for it. Nothing flows through
    a statement whose code meets ``sanitizer``.
    """
    back = g.edge("REACHES").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if not g.nodes.where("type = 'Argument'").isEmpty():
        links = argument_links(g)
        holder = steps.statement_of(g, links.select(F.col("argument").alias("id"))).select(F.col("id").alias("argument"), "statement")
        up = links.join(holder, "argument").select(F.col("parameter").alias("src"), F.col("statement").alias("dst"))
        back = back.unionByName(up)
    if sanitizer is not None:
        back = back.join(g.node(where=sanitizer).withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    return reach(back, pipe.select(F.col("id").alias("root"), "id"), loops)


def tainted_arguments(g: CodeGraph, callee: str, source: str, loops: int = 4) -> DataFrame:
    """Calls of ``callee`` some argument of which data flows to from a statement whose whole code matches ``source``.

    What no statement of its function can feed is dropped by a semi-join before the search.
    """
    calls = lookup.calls_to(g.nodes, g.edges, callee).select("id")
    at = steps.statement_of(g, calls)
    fed = at.join(g.edge("REACHES").select(F.col("dst").alias("statement")), "statement", "left_semi")
    reached = tainted_by(g, fed.select(F.col("statement").alias("id")).distinct(), loops)
    hit = g.node("code", where=F.col("code").rlike(lookup.whole(source))).select("id")
    roots = reached.join(hit, "id", "left_semi").select(F.col("root").alias("statement")).distinct()
    return at.join(roots, "statement", "left_semi").select("id")


def unchecked(g: CodeGraph, pipe: DataFrame, symbol: str, check: str) -> DataFrame:
    """Nodes of the pipe that no condition whose whole code matches ``check`` controls, at any distance; ``%s`` in it stands for the symbol, quoted."""
    import re

    pattern = lookup.whole(check.replace("%s", re.escape(symbol)))
    checked = controlling_conditions(g, pipe, None).join(g.node("code", where=F.col("code").rlike(pattern)).select("id"), "id", "left_semi")
    return pipe.join(checked.select(F.col("root").alias("id")), "id", "left_anti")


def local_definition_tree(g: CodeGraph, pipe: DataFrame, depth: int = 1) -> DataFrame:
    """``(graphlet, src, dst, kind)``: the definitions each node rests on, ``depth`` steps deep, and the conditions that control it."""
    data = g.edge("REACHES").where("src <> dst")
    level = pipe.select(F.col("id").alias("graphlet"), "id").distinct()
    found = None
    for _ in range(depth + 1):
        step = level.select("graphlet", F.col("id").alias("dst")).join(data, "dst").select("graphlet", "src", "dst")
        found = step if found is None else found.unionByName(step)
        level = step.select("graphlet", F.col("src").alias("id")).distinct()
    rules = controlling_conditions(g, pipe).select(F.col("root").alias("graphlet"), F.col("id").alias("src"), F.col("root").alias("dst"))
    return found.distinct().withColumn("kind", F.lit("data")).unionByName(rules.withColumn("kind", F.lit("condition")))


def invocations(g: CodeGraph, pipe: DataFrame, depth: int = 4, calls: DataFrame | None = None) -> DataFrame:
    """``(root, chain)``: call chains that lead to each node's function: functions from the node's own up to a caller without callers, at most ``depth``.

    Recursive calls end a chain. ``calls(callee, caller)`` are those of the graph if they aren't given.
    """
    own = pipe.select("id").distinct().join(g.node_of(pipe, "function_id"), "id").groupBy(F.col("function_id").alias("top")).agg(F.collect_list("id").alias("roots"))
    level = own.select("roots", "top", F.array("top").alias("chain"))
    calls = cut((call_edges(g) if calls is None else calls).select(F.col("callee").alias("top"), F.col("caller").alias("up")).distinct())
    # Callers of each function in one row; a function without callers has none.
    callers = calls.groupBy("top").agg(F.collect_list("up").alias("ups"))
    grown = lambda up: F.concat("chain", F.array(up))
    parts = []
    # Nodes of one function share its chains, and each chain is made once: what was found is neither copied for each node nor compared again.
    for _ in range(depth - 2):
        step = level.join(callers, "top", "left")
        parts.append(step.where("ups is null").select("roots", "chain"))
        step = step.select("roots", "chain", F.explode("ups").alias("up")).where(~F.array_contains("chain", F.col("up")))
        level = step.select("roots", F.col("up").alias("top"), grown(F.col("up")).alias("chain"))
    # The last two calls are made in one join with what lies above each function, so that chains of the last two lengths, by far the most, go from
    # there to the result and are in no shuffle.
    if depth >= 2:
        above = calls.join(callers.withColumnRenamed("top", "up"), "up", "left").select("top", "up", "ups")
        step = level.join(above, "top", "left")
        fresh = F.when(F.array_contains("chain", F.col("up")), F.array().cast("array<array<bigint>>"))
        fresh = fresh.when(F.col("ups").isNull(), F.array(grown(F.col("up"))))
        longest = F.transform(F.filter("ups", lambda x: (x != F.col("up")) & ~F.array_contains("chain", x)), lambda x: F.concat("chain", F.array("up", x)))
        chains = F.when(F.col("up").isNull(), F.array("chain")).otherwise(fresh.otherwise(longest))
        found = step.select("roots", F.explode(chains).alias("chain"))
    elif depth == 1:
        step = level.join(callers, "top", "left")
        chains = F.when(F.col("ups").isNull(), F.array("chain")).otherwise(F.transform(F.filter("ups", lambda x: ~F.array_contains("chain", x)), lambda x: grown(x)))
        found = step.select("roots", F.explode(chains).alias("chain"))
    else:
        found = level.select("roots", "chain")
    for p in parts:
        found = found.unionByName(p)
    return found.select(F.explode("roots").alias("root"), "chain")


def call_edges(g: CodeGraph) -> DataFrame:
    """``(callee, call, caller)`` by name, from Callee nodes where the graph has syntax trees, else from the text of statements."""
    functions = g.node("type", "name", "test_id", where="type = 'Function' and name is not null").select(F.col("id").alias("callee"), "name", F.col("test_id").alias("t"))
    callees = g.node("type", "code", "function_id", "test_id", where="type = 'Callee'")
    named = callees.select(F.element_at(F.split("code", " "), -1).alias("name"), F.col("id").alias("call"), F.col("function_id").alias("caller"), "test_id")
    same = [named["name"] == functions["name"], named["test_id"].eqNullSafe(functions["t"])]
    return named.join(functions, same).select("callee", "call", "caller")


def neighborhood_hash(edges: DataFrame, labels: DataFrame, rounds: int = 2) -> DataFrame:
    """``(id, label)``: 16-bit labels of trees: each round a node's label is turned left by one bit and combined with those of its children.

    ``edges(src, dst)`` lead from a node to its children, ``labels(id, label)`` has a string for each node, hashed as 31-adic number first.
    """
    code = F.aggregate(F.transform(F.split("label", ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    state = labels.select("id", F.coalesce(code, F.lit(0)).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("label"))
    for _ in range(rounds):
        below = edges.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.bit_xor("label").alias("x"))
        turned = F.shiftleft("label", 1).bitwiseOR(F.shiftright("label", 15)).bitwiseAND(F.lit(0xFFFF))
        state = state.join(below, "id", "left").select("id", turned.bitwiseXOR(F.coalesce("x", F.lit(0))).alias("label"))
    return state


def label_histogram(state: DataFrame, owner: DataFrame) -> DataFrame:
    """``(owner, vector)``: how often each label occurs in each ``owner(id, owner)``, as ``label:count`` pairs in order of labels."""
    counts = state.join(owner, "id").groupBy("owner", "label").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("label", "n"))), lambda p: F.concat_ws(":", p["label"], p["n"]))
    return counts.groupBy("owner").agg(F.array_join(pairs, " ").alias("vector"))
