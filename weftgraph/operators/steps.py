"""Steps along edges: each hop is one equi-join, and what follows is pruned by Catalyst.

A pipe is a DataFrame with a column ``id``; a step gives a pipe again, with one row for each path unless it says otherwise. Use ``dedup`` where
paths don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators.reach import closure, reach, turned


def out(g: CodeGraph, pipe: DataFrame, kind: str, key: str | None = None, values=None) -> DataFrame:
    """Targets of the edges of a type that leave the pipe's nodes, of those only with ``key`` among ``values`` if given (one value or several)."""
    return _hop(g, pipe, kind, "src", "dst", key, values)


def into(g: CodeGraph, pipe: DataFrame, kind: str, key: str | None = None, values=None) -> DataFrame:
    """Sources of the edges of a type that arrive at the pipe's nodes."""
    return _hop(g, pipe, kind, "dst", "src", key, values)


def _hop(g: CodeGraph, pipe: DataFrame, kind: str, here: str, there: str, key: str | None, values) -> DataFrame:
    columns = ("src", "dst") + ((key,) if key else ())
    edges = g.edge(kind, columns=columns)
    if key:
        edges = edges.where(F.col(key).isin([values] if isinstance(values, str) else list(values)))
    return pipe.select(F.col("id").alias(here)).join(edges, here).select(F.col(there).alias("id"))


def both(g: CodeGraph, pipe: DataFrame, kind: str) -> DataFrame:
    """Neighbours along a type in either direction."""
    return out(g, pipe, kind).unionByName(into(g, pipe, kind))


def children(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return out(g, pipe, "IS_AST_PARENT")


def parents(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return into(g, pipe, "IS_AST_PARENT")


def ith_children(g: CodeGraph, pipe: DataFrame, i: int) -> DataFrame:
    """Children at place ``i``; a child without a place stands at 0."""
    placed = g.node("child_num", where=F.coalesce("child_num", F.lit(0)) == i).select("id")
    return children(g, pipe).join(placed, "id", "left_semi")


def num_children(g: CodeGraph, pipe: DataFrame, kind: str = "IS_AST_PARENT") -> DataFrame:
    """``(id, n)``: how many children each node has along a type of edges, 0 for leaves."""
    counts = g.edge(kind).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return pipe.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def lval(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return ith_children(g, pipe, 0)


def rval(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return ith_children(g, pipe, 1)


def uses(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return out(g, pipe, "USE")


def defines(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return out(g, pipe, "DEF")


def set_by(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """Nodes that define the pipe's symbols."""
    return into(g, pipe, "DEF")


def definitions(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """Declarations and parameters that define what the pipe's nodes use."""
    kinds = g.node("type", where=F.col("type").isin("IdentifierDecl", "Parameter", "IdentifierDeclStatement")).select("id")
    return set_by(g, uses(g, pipe)).join(kinds, "id", "left_semi")


def producers(g: CodeGraph, pipe: DataFrame, symbols) -> DataFrame:
    """Statements whose definition of one of the symbols reaches the pipe's statements."""
    return into(g, pipe, "REACHES", "var", symbols)


def users(g: CodeGraph, pipe: DataFrame, symbols) -> DataFrame:
    """Statements that one of the symbols reaches from the pipe's statements."""
    return out(g, pipe, "REACHES", "var", symbols)


def sources(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return into(g, pipe, "REACHES")


def sinks(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return out(g, pipe, "REACHES")


def syntax_closure(g: CodeGraph) -> DataFrame:
    """``(top, id)``: each node of a tree with all nodes below it and itself: as many rows as nodes times their depth. Of some nodes alone take
    ``below``."""
    tree = g.edge("IS_AST_PARENT")
    ids = tree.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    pairs = closure(tree.select("src", "dst"))
    return pairs.select(F.col("src").alias("top"), F.col("dst").alias("id")).unionByName(ids.select(F.col("id").alias("top"), "id"))


def _tree(g: CodeGraph) -> DataFrame:
    return g.edge("IS_AST_PARENT", columns=("src", "dst", "function_id"))


def below(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(top, id)``: what stands in the trees of the pipe's nodes, themselves among them. Only these trees are searched."""
    return reach(_tree(g), pipe.select(F.col("id").alias("root"), "id")).select(F.col("root").alias("top"), "id")


def above(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(id, top, hops)``: what stands above the pipe's nodes, themselves among them, and how many steps up."""
    return reach(turned(_tree(g)), pipe.select(F.col("id").alias("root"), "id")).select(F.col("root").alias("id"), F.col("id").alias("top"), "hops")


def match(g: CodeGraph, pipe: DataFrame, predicate: Column, *columns: str) -> DataFrame:
    """Nodes of the pipe's trees, themselves among them, that meet the predicate on the named node columns."""
    return below(g, pipe).select("id").join(g.node(*columns, where=predicate).select("id"), "id", "left_semi")


def match_parents(g: CodeGraph, pipe: DataFrame, predicate: Column, *columns: str) -> DataFrame:
    """Nodes above the pipe's that meet the predicate, themselves among them, up to the nearest statement at or above each; without a statement above,
    all of them."""
    up = above(g, pipe)
    stop = up.join(g.node(where="is_cfg").withColumnRenamed("id", "top"), "top", "left_semi").groupBy("id").agg(F.min("hops").alias("last"))
    within = up.join(stop, "id", "left").where("last is null or hops <= last").select(F.col("top").alias("id"))
    return within.join(g.node(*columns, where=predicate).select("id"), "id", "left_semi")


def statement_of(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(id, statement)``: the nearest node of the control flow graph at or above each node, ties by id."""
    up = above(g, pipe).join(g.node(where="is_cfg").withColumnRenamed("id", "top"), "top", "left_semi")
    return up.groupBy("id").agg(F.min(F.struct("hops", "top")).getField("top").alias("statement"))


def call_to_arguments(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return children(g, ith_children(g, pipe, 1))


def ith_arguments(g: CodeGraph, pipe: DataFrame, i: int) -> DataFrame:
    return ith_children(g, ith_children(g, pipe, 1), i)


def call_to_callee(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return ith_children(g, pipe, 0)


def argument_to_call(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return parents(g, parents(g, pipe))


def callee_to_call(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return parents(g, pipe)


def call_to_assignments(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    return match_parents(g, pipe, F.col("type") == "AssignmentExpr", "type")


def parameter_parts(g: CodeGraph, pipe: DataFrame, kind: str) -> DataFrame:
    """``Identifier`` or ``ParameterType`` of parameters."""
    return children(g, pipe).join(g.node("type", where=F.col("type") == kind).select("id"), "id", "left_semi")


def to_exit(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """The exit node of each node's function."""
    owner = pipe.select("id").join(g.node_of(pipe, "function_id"), "id").select("function_id")
    return owner.join(g.node("type", "function_id", where="type = 'CFGExitNode'").select("id", "function_id"), "function_id").select("id")


def functions(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """The function of each node."""
    return pipe.select("id").join(g.node_of(pipe, "function_id"), "id").where("function_id is not null").select(F.col("function_id").alias("id"))


def function_nodes(g: CodeGraph, pipe: DataFrame, kind: str | None = None, statements_only: bool = False) -> DataFrame:
    """Nodes of the pipe's functions, of a type or of the control flow graph only if asked."""
    wanted = F.col("function_id").isNotNull()
    wanted = wanted if kind is None else wanted & (F.col("type") == kind)
    nodes = g.node("function_id", where=wanted & F.col("is_cfg") if statements_only else wanted)
    return pipe.select(F.col("id").alias("function_id")).join(nodes, "function_id").select("id")


def function_to_callers(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """Callee nodes that name the pipe's functions, within their own test case; functions and calls without one go together."""
    names = pipe.select("id").join(g.node_of(pipe, "name", "test_id"), "id").select(F.col("name").alias("code"), F.coalesce("test_id", F.lit("")).alias("case"))
    callees = g.node("type", "code", "test_id", where="type = 'Callee'").select("id", "code", F.coalesce("test_id", F.lit("")).alias("case"))
    return names.join(callees, ["code", "case"]).select("id")


def locations(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """``(id, code, function, filepath)``."""
    nodes = g.node_of(pipe, "code", "function_id", "filepath")
    names = g.node("type", "name", where="type = 'Function'").select(F.col("id").alias("function_id"), F.col("name").alias("function"))
    return pipe.select("id").join(nodes, "id").join(names, "function_id", "left").select("id", "code", "function", "filepath")


def visible(g: CodeGraph, pipe: DataFrame) -> DataFrame:
    """Nodes that are hidden neither themselves nor by their function nor by their file: a file is hidden if its node, of type File, is."""
    hidden = g.node("type", "filepath", where="hidden")
    gone = hidden.select("id")
    files = hidden.where("type = 'File' and filepath is not null").select("filepath").distinct()
    placed = pipe.select("id").join(g.node_of(pipe, "function_id", "filepath"), "id", "left").join(gone, "id", "left_anti")
    placed = placed.join(gone.withColumnRenamed("id", "function_id"), "function_id", "left_anti")
    return placed.join(files, "filepath", "left_anti").select("id")


def degree(g: CodeGraph, *kinds: str) -> DataFrame:
    """``(id, n)``: edges at each node that has any, a loop counting twice."""
    edges = g.edge(*kinds, columns=("src", "dst", "etype", "var", "flow_label"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def pattern(g: CodeGraph, kind: str | None = None, starts: DataFrame | None = None, ends: DataFrame | None = None, bidirectional: bool = False, limit: int | None = None) -> DataFrame:
    """``(src, dst, etype)`` of the edges of a type between some nodes and others; ``bidirectional`` takes them either way."""
    edges = g.edge(*([kind] if kind else []), columns=("src", "dst", "etype"))
    ways = [edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "etype")] if bidirectional else [edges]
    found = None
    for way in ways:
        way = way if starts is None else way.join(starts.select(F.col("id").alias("src")), "src", "left_semi")
        way = way if ends is None else way.join(ends.select(F.col("id").alias("dst")), "dst", "left_semi")
        found = way if found is None else found.unionByName(way)
    found = found.select("src", "dst", "etype").distinct()
    return found if limit is None else found.orderBy("src", "dst", "etype").limit(limit)


def dedup(pipe: DataFrame) -> DataFrame:
    return pipe.distinct()


def bag_union(*pipes: DataFrame) -> DataFrame:
    """All rows of all pipes, repeated ones too."""
    found = pipes[0]
    for p in pipes[1:]:
        found = found.unionByName(p)
    return found


def set_union(*pipes: DataFrame) -> DataFrame:
    return bag_union(*pipes).distinct()


def minus(pipe: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of a pipe without those nodes that are in another, repeated ones too."""
    return pipe.join(other.select("id").distinct(), "id", "left_anti")
