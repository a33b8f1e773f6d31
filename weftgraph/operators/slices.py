"""Program dependence graphs and slices: completion, backward and forward slices, expansion across calls, rendering and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.io import cut
from weftgraph.operators.points import called_names
from weftgraph.operators.reach import MOST_ROUNDS, reach, turned

SEPARATOR = "-" * 30


def dependence_edges(g: CodeGraph, *more: str) -> DataFrame:
    """``(src, dst, var)`` of the dependence graph: data edges with their symbol, control edges with null, each once, and ``more`` columns of theirs.
    Entry nodes stand for their function, exit and error nodes are left out."""
    edges = g.edge("REACHES", "CONTROLS", columns=("src", "dst", "var", *more))
    special = g.node("type", "function_id", where=F.col("type").isin("CFGEntryNode", "CFGExitNode", "CFGErrorNode"))
    entry = special.where("type = 'CFGEntryNode'")
    gone = special.where("type <> 'CFGEntryNode'").select("id")
    edges = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    edges = edges.join(entry.select(F.col("id").alias("src"), F.col("function_id").alias("owner")), "src", "left")
    return edges.select(F.coalesce("owner", "src").alias("src"), "dst", "var", *more).distinct()


def flow_edges(g: CodeGraph) -> DataFrame:
    """``(src, dst, flow_label)`` of the control flow graph without error nodes."""
    gone = g.node("type", where="type = 'CFGErrorNode'").select("id")
    edges = g.edge("FLOWS_TO", columns=("src", "dst", "flow_label"))
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "flow_label")


def without_control(edges: DataFrame) -> DataFrame:
    return edges.where("var is not null")


def bare_symbols(edges: DataFrame) -> DataFrame:
    """Symbols without stars and the blanks beside them."""
    return edges.withColumn("var", F.trim(F.regexp_replace("var", r"\*\s*", ""))).distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The edges and those of ``more`` that are not among them."""
    return edges.select("src", "dst", "var").unionByName(more.select("src", "dst", "var")).distinct()


def merge_lines(nodes: DataFrame) -> DataFrame:
    """``(function_id, line, code)``: what stands in one line of a function, from left to right, joined by blanks."""
    cell = F.sort_array(F.collect_list(F.struct(F.coalesce("col", F.lit(-1)).alias("c"), "id", "code")))
    rows = nodes.where("line >= 0 and code is not null and function_id is not null")
    return rows.groupBy("function_id", "line").agg(F.array_join(F.transform(cell, lambda x: x["code"]), " ").alias("code"))


def merge_runs(lines: DataFrame) -> DataFrame:
    """``(function_id, first_line, last_line, code)``: lines that follow one another without a gap, joined by line feeds."""
    island = F.col("line") - F.row_number().over(Window.partitionBy("function_id").orderBy("line"))
    cell = F.sort_array(F.collect_list(F.struct("line", "code")))
    runs = lines.withColumn("island", island).groupBy("function_id", "island")
    return runs.agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.array_join(F.transform(cell, lambda x: x["code"]), "\n").alias("code")).drop("island")


def if_scopes(g: CodeGraph) -> DataFrame:
    """``(test, branch, id)``: what each condition's true and false arm holds: what it controls that one arm reaches and the other doesn't."""
    flow = g.edge("FLOWS_TO", columns=("src", "dst", "flow_label"))
    arms = flow.where(F.col("flow_label").isin("True", "False")).select(F.xxhash64("src", "flow_label").alias("root"), "src", "flow_label", F.col("dst").alias("id"))
    down = reach(without_back_edges(g), arms.select("root", "id"))
    held = down.join(arms.select("root", "src", "flow_label"), "root").select(F.col("src").alias("test"), "flow_label", "id").distinct()
    one = held.groupBy("test", "id").agg(F.collect_set("flow_label").alias("b")).where(F.size("b") == 1)
    return one.where("id <> test").select("test", (F.get("b", F.lit(0)) == "True").alias("branch"), "id")


def without_back_edges(g: CodeGraph) -> DataFrame:
    """Flow edges to a later place in the text, so that a loop ends where it goes back."""
    place = g.node("start_idx")
    flow = g.edge("FLOWS_TO", columns=("src", "dst", "function_id"))
    flow = flow.join(place.select(F.col("id").alias("src"), F.col("start_idx").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("start_idx").alias("b")), "dst")
    return flow.where("b > a").select("src", "dst", "function_id")


def scopes_of(scopes: DataFrame) -> DataFrame:
    """``(id, tests)``: the conditions in whose arms a node stands, in order."""
    return scopes.groupBy("id").agg(F.sort_array(F.collect_set("test")).alias("tests"))


def common_to_arms(flow: DataFrame) -> DataFrame:
    """``(test, branch, id)`` of ``flow(test, branch, id)`` without what both arms of a condition hold."""
    arms = flow.groupBy("test", "id").agg(F.min("branch").alias("low"), F.max("branch").alias("high"))
    return arms.where("low = high").select("test", F.col("low").alias("branch"), "id")


def complete_data_edges(symbols: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """``(src, dst, var)`` from each definition to the later uses of its symbol up to the next definition, in order of place.

    ``symbols(id, function_id, pos, symbol, is_def)``; at one place uses come before definitions. Opposite arms of a condition, from ``scopes(test,
    branch, id)``, give no edge.
    """
    w = Window.partitionBy("function_id", "symbol").orderBy("pos", F.col("is_def").cast("int"), "id")
    latest = F.last(F.when(F.col("is_def"), F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    edges = symbols.select("*", latest.alias("src")).where("not is_def and src is not null and src <> id").select("src", F.col("id").alias("dst"), F.col("symbol").alias("var")).distinct()
    if scopes is None:
        return edges
    a = scopes.select("test", F.col("branch").alias("x"), F.col("id").alias("src"))
    b = scopes.select("test", F.col("branch").alias("y"), F.col("id").alias("dst"))
    apart = edges.select("src", "dst").distinct().join(a, "src").join(b, ["dst", "test"]).where("x <> y").select("src", "dst").distinct()
    return edges.join(apart, ["src", "dst"], "left_anti")


#: How an object is made: its name, then ``new``; and by the functions that allocate, with or without a cast.
BY_NEW, BY_ALLOCATION = r"([A-Za-z_]\w*) = new ", r"([A-Za-z_]\w*) = (?:\( [^()]* \) )?(?:malloc|calloc|realloc) \("


def object_edges(g: CodeGraph, made: str = BY_NEW) -> DataFrame:
    """``(src, dst, var)`` from where an object is made, by ``new`` unless told otherwise, to the places of its function that use or delete it, further
    down. Where a statement makes several, each counts."""
    code = g.node("code", "function_id", "line", where="code is not null and function_id is not null")
    makers = code.select("id", "function_id", "line", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(made), F.lit(1)))).alias("var"))
    used = F.array_distinct(F.concat(F.regexp_extract_all("code", F.lit(r"(?:^| )([A-Za-z_]\w*) -> "), F.lit(1)), F.regexp_extract_all("code", F.lit(r"(?:^| )delete (?:\[ \] )?([A-Za-z_]\w*)"), F.lit(1))))
    users = code.select(F.col("id").alias("dst"), "function_id", F.col("line").alias("at"), F.explode(used).alias("var"))
    return makers.withColumnRenamed("id", "src").join(users, ["function_id", "var"]).where("src <> dst and at >= line").select("src", "dst", "var").distinct()


def repaired(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    """``(id, now)`` of ``nodes(id, function_id, code, line)``: nodes that are not among ``flow(id, function_id, code, line)`` take the id of the one there
    with the same function, code and line, of several the least; what has none keeps its own."""
    there = flow.groupBy("function_id", "code", "line").agg(F.min("id").alias("other"))
    lost = nodes.join(flow.select("id").distinct(), "id", "left_anti")
    found = lost.join(there, ["function_id", "code", "line"], "left").select("id", F.coalesce("other", "id").alias("now"))
    return found.unionByName(nodes.join(flow.select("id").distinct(), "id", "left_semi").select("id", F.col("id").alias("now")))


def points_of(slice_points: DataFrame) -> DataFrame:
    """``(slice_id, kind, function_id, id)``: a row for each node of each point; equal points are one."""
    key = F.xxhash64("kind", "test_id", "function_id", F.sort_array("node_ids"))
    return slice_points.where("node_ids is not null").select(key.alias("slice_id"), "kind", "function_id", F.explode("node_ids").alias("id")).distinct()


def backward_slice(g: CodeGraph, points: DataFrame, most_hops: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``(slice_id, id)``: what the points depend on by data and control, and the points. ``edges`` are those of the dependence graph where they are
    known."""
    edges = turned(dependence_edges(g, "function_id") if edges is None else edges)
    return reach(edges, points.select(F.col("slice_id").alias("root"), "id"), most_hops).select(F.col("root").alias("slice_id"), "id")


def forward_slice(g: CodeGraph, points: DataFrame, most_hops: int | None = None) -> DataFrame:
    """``(slice_id, id)``: what depends on the points by data, and the points."""
    edges = without_control(dependence_edges(g, "function_id")).select("src", "dst", "function_id")
    return reach(edges, points.select(F.col("slice_id").alias("root"), "id"), most_hops).select(F.col("root").alias("slice_id"), "id")


def whole_slice(g: CodeGraph, points: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(slice_id, id)``: backward and forward slice together, in one search: the forward one runs on a copy of the graph with ids turned bit by bit."""
    edges = cut(dependence_edges(g, "function_id")) if edges is None else edges
    flip = lambda df: df.select(*(F.bitwise_not(c).alias(c) if c != "slice_id" else F.col(c) for c in df.columns))
    ahead = flip(without_control(edges).select("src", "dst", "function_id"))
    seeds = points.select("slice_id", "id")
    seeds = seeds.unionByName(flip(seeds)).withColumnRenamed("slice_id", "root")
    found = reach(turned(edges).unionByName(ahead), seeds)
    return found.select(F.col("root").alias("slice_id"), F.greatest("id", F.bitwise_not("id")).alias("id")).distinct()


def program_slice(g: CodeGraph, points: DataFrame, call_hops: int = 0) -> DataFrame:
    """``(slice_id, id)``: backward and forward slice together; with ``call_hops`` the functions that its statements call, and those that call the
    function of a slice that takes in a parameter, so many calls away."""
    found = whole_slice(g, points)
    for _ in range(call_hops):
        calls = text_calls(g)
        down = found.join(calls, "id").select("slice_id", F.col("callee").alias("function_id"))
        param = found.join(g.node("type", "function_id", where="type = 'Parameter'"), "id").select("slice_id", F.col("function_id").alias("callee")).distinct()
        up = param.join(calls, "callee").select("slice_id", "id")
        inside = down.distinct().join(g.node("function_id", "is_cfg", where="is_cfg").select("id", "function_id"), "function_id").select("slice_id", "id")
        found = found.unionByName(inside).unionByName(backward_slice(g, up)).distinct()
    return found


def crossing_slice(g: CodeGraph, points: DataFrame, caller_hops: int = 3) -> DataFrame:
    """``(slice_id, id)``: backward and forward slice, what it depends on in callers up to ``caller_hops`` calls away, and all statements of functions
    that any of this calls, directly or through others.

    Callers count as long as the slice takes in a parameter of the function called. Called functions are taken whole.
    """
    calls = cut(text_calls(g))
    found = _with_callers(g, points, calls, caller_hops)
    seeds = found.join(calls, "id").select(F.col("slice_id").alias("root"), F.col("callee").alias("id"))
    down = reach(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), seeds).select(F.col("root").alias("slice_id"), F.col("id").alias("function_id"))
    inside = down.join(g.node("function_id", "is_cfg", where="is_cfg").select("id", "function_id"), "function_id").select("slice_id", "id")
    return found.unionByName(inside).distinct()


def _with_callers(g: CodeGraph, points: DataFrame, calls: DataFrame, caller_hops: int) -> DataFrame:
    """``(slice_id, id)``: backward and forward slice, and what it depends on in callers."""
    edges = cut(dependence_edges(g, "function_id"))
    params = g.node("type", "function_id", where="type = 'Parameter'").select("id", F.col("function_id").alias("callee"))
    found = fresh = cut(whole_slice(g, points, edges))
    for _ in range(caller_hops):
        up = fresh.join(params, "id").select("slice_id", "callee").distinct().join(calls, "callee").select("slice_id", "id").distinct()
        fresh = cut(backward_slice(g, up, edges=edges).join(found, ["slice_id", "id"], "left_anti"))
        if fresh.isEmpty():
            break
        found = cut(found.unionByName(fresh))
    return found


def crossing_labels(g: CodeGraph, points: DataFrame, vul_lines: DataFrame, caller_hops: int = 3) -> DataFrame:
    """``(slice_id, label, n_hits)``: what ``label_slices`` says of the lines of ``crossing_slice``, without listing these.

    Of the functions called only those with vulnerable lines matter: they are led to their callers until a slice is met. All that a slice calls is
    searched only where the slice itself has no line.
    """
    calls = cut(text_calls(g))
    found = _with_callers(g, points, calls, caller_hops)
    bad = vul_lines.where("path is not null and line is not null").select("path", "line").distinct()
    place = g.node("filepath", "line", "function_id", "is_cfg", where="line >= 0 and code is not null").withColumnRenamed("filepath", "path")
    inside = place.where("is_cfg and function_id is not null").select("function_id", "path", "line").distinct()
    flawed = cut(inside.join(bad, ["path", "line"], "left_semi"))
    own = cut(found.join(place, "id").select("slice_id", "path", "line").distinct())
    entered = cut(found.join(calls, "id").select("slice_id", F.col("callee").alias("id")).distinct())
    edges = calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    led = reach(edges, flawed.select(F.col("function_id").alias("root"), F.col("function_id").alias("id")))
    through = entered.join(led, "id").select("slice_id", F.col("root").alias("function_id")).distinct().join(flawed, "function_id").select("slice_id", "path", "line")
    hits = own.join(bad, ["path", "line"], "left_semi").select("slice_id", "path", "line").unionByName(through).distinct()
    hits = hits.groupBy("slice_id").agg(F.count(F.lit(1)).alias("n"))
    placed = own.select("slice_id").distinct()
    bare = cut(entered.join(placed, "slice_id", "left_anti"))
    if not bare.isEmpty():
        down = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), bare.withColumnRenamed("slice_id", "root"))
        placed = placed.unionByName(down.select("root", F.col("id").alias("function_id")).join(inside, "function_id", "left_semi").select(F.col("root").alias("slice_id")).distinct())
    n = F.coalesce("n", F.lit(0))
    return placed.join(hits, "slice_id", "left").select("slice_id", (n > 0).cast("int").alias("label"), n.alias("n_hits"))


def text_calls(g: CodeGraph) -> DataFrame:
    """``(callee, id, caller)``: statements that name a function of their own test case before a bracket; of several functions of a name the least id
    counts. ``new C`` calls ``C :: C``."""
    named = g.node("type", "name", "test_id", where="type = 'Function' and name is not null").groupBy("test_id", "name").agg(F.min("id").alias("callee"))
    made = F.transform(F.regexp_extract_all("code", F.lit(r"new ([A-Za-z_]\w*)"), F.lit(1)), lambda c: F.concat(c, F.lit(" :: "), c))
    names = F.array_distinct(F.concat(called_names(F.col("code")), made))
    statements = g.node("code", "function_id", "test_id", where="is_cfg and code is not null")
    code = statements.select("id", F.col("function_id").alias("caller"), "test_id", F.explode(names).alias("name"))
    return code.join(named, ["test_id", "name"]).where("callee <> caller").select("callee", "id", "caller")


def callers_within(g: CodeGraph, functions: DataFrame, most_hops: int = 3) -> DataFrame:
    """``(root, id, hops)``: functions that call the given ones directly or through others, at most so many calls away."""
    edges = text_calls(g).select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    return reach(edges, functions.select(F.col("id").alias("root"), "id"), most_hops)


def sorted_by_place(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("line").asc_nulls_last(), F.col("col").asc_nulls_last(), "id")


def slice_lines(g: CodeGraph, members: DataFrame) -> DataFrame:
    """``(slice_id, path, line, code)``: the lines of each slice; nodes without a place are left out."""
    where = g.node("code", "line", "col", "filepath", where="line >= 0 and code is not null")
    cell = F.sort_array(F.collect_set(F.struct(F.coalesce("col", F.lit(-1)).alias("c"), "id", "code")))
    rows = members.join(where, "id").groupBy("slice_id", F.col("filepath").alias("path"), "line")
    return rows.agg(F.array_join(F.transform(cell, lambda x: x["code"]), " ").alias("code"))


def rendered(lines: DataFrame) -> DataFrame:
    """``(slice_id, path, start_line, lines, text)``: a block for each slice and file: its lines with their numbers in order, and these as one text."""
    cell = F.sort_array(F.collect_list(F.struct("line", "code")))
    each = F.transform(cell, lambda x: F.concat_ws(" ", x["code"], x["line"]))
    blocks = lines.groupBy("slice_id", "path").agg(F.min("line").alias("start_line"), each.alias("lines"))
    return blocks.withColumn("text", F.array_join("lines", "\n"))


def label_slices(lines: DataFrame, vul_lines: DataFrame) -> DataFrame:
    """``(slice_id, label, n_hits)``: 1 if a line of the slice is vulnerable in its file, else 0."""
    bad = vul_lines.where("path is not null and line is not null").select("path", "line").distinct().withColumn("hit", F.lit(1))
    rows = lines.select("slice_id", "path", "line").distinct().join(bad, ["path", "line"], "left")
    hits = F.coalesce(F.sum("hit"), F.lit(0))
    return rows.groupBy("slice_id").agg((hits > 0).cast("int").alias("label"), hits.alias("n_hits"))


def flawed_lines_by_file(vul_lines: DataFrame, shared: str = "/shared/") -> DataFrame:
    """``(path, lines)``: the flawed lines of each file as a sorted set; files whose path holds ``shared`` are left out."""
    return vul_lines.where(~F.contains("path", F.lit(shared))).groupBy("path").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def split_of_case(test_id: Column, train_percent: int = 80) -> Column:
    """``train`` or ``test`` by hash of the test case, the same at every time and place."""
    return F.when(F.pmod(F.conv(F.substring(F.md5(test_id), 1, 8), 16, 10).cast("long"), F.lit(100)) < train_percent, "train").otherwise("test")


# Words that the parser leaves as statements of their own in front of a declaration.
MODIFIERS = ["static", "inline", "virtual", "explicit", "friend"]


def fold_modifiers(nodes: DataFrame) -> DataFrame:
    """``nodes(id, function_id, start_idx, code, ...)`` without modifiers that stand alone; they lead the code of the node behind them instead."""
    w = Window.partitionBy("function_id").orderBy(F.col("start_idx").asc_nulls_first(), "id")
    lone = F.col("code").isin(MODIFIERS)
    run = nodes.withColumn("_lone", F.coalesce(lone, F.lit(False)))
    run = run.withColumn("_run", F.sum(F.when(F.col("_lone"), 0).otherwise(1)).over(w) - F.when(F.col("_lone"), 0).otherwise(1))
    before = F.collect_list(F.when(F.col("_lone"), F.col("code"))).over(Window.partitionBy("function_id", "_run").orderBy(F.col("start_idx").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, -1))
    led = run.withColumn("code", F.when(F.size(before) > 0, F.concat_ws(" ", F.array_join(before, " "), "code")).otherwise(F.col("code")))
    return led.where("not _lone").drop("_lone", "_run")


def inlined_lines(g: CodeGraph, members: DataFrame, points: DataFrame, hops: int | None = None) -> DataFrame:
    """``(slice_id, place, path, line, code)``: the lines of each slice with those of called functions behind the line that calls them.

    ``place`` is what to sort by: the lines of the calls that lead to a function, and the line. Functions of the points come first in their own
    order; a function that is called in several places stands at the first; what no call leads to, or none within ``hops``, follows at the end, as callers do.
    """
    where = g.node("code", "line", "col", "filepath", "function_id", where="line >= 0 and code is not null")
    rows = members.join(where, "id")
    placed = points.select("slice_id", "id").join(rows.select("slice_id", "id", "function_id"), ["slice_id", "id"]).select("slice_id", "function_id").distinct().withColumn("lead", F.array().cast("array<int>"))
    calls = cut(rows.select("slice_id", "id", F.col("function_id").alias("caller"), "line").join(text_calls(g).select("id", "callee"), "id"))
    placed = fresh = cut(placed)
    for _ in range(hops if hops is not None else MOST_ROUNDS):
        step = calls.join(fresh.withColumnRenamed("function_id", "caller"), ["slice_id", "caller"])
        step = step.groupBy("slice_id", F.col("callee").alias("function_id")).agg(F.min(F.concat("lead", F.array("line"))).alias("lead"))
        fresh = cut(step.join(placed.select("slice_id", "function_id"), ["slice_id", "function_id"], "left_anti"))
        if fresh.isEmpty():
            break
        placed = placed.unionByName(fresh)
    last = F.array(F.lit(2**31 - 1))
    cell = F.sort_array(F.collect_set(F.struct(F.coalesce("col", F.lit(-1)).alias("c"), "id", "code")))
    lines = rows.groupBy("slice_id", "function_id", F.col("filepath").alias("path"), "line").agg(F.array_join(F.transform(cell, lambda x: x["code"]), " ").alias("code"))
    lines = lines.join(placed, ["slice_id", "function_id"], "left")
    return lines.select("slice_id", F.concat(F.coalesce("lead", last), F.array("line")).alias("place"), "path", "line", "code")


def crossing_lines(g: CodeGraph, points: DataFrame, caller_hops: int = 3) -> DataFrame:
    """``(slice_id, place, path, line, code)``: what ``inlined_lines`` gives of ``crossing_slice``, without a row for each slice and statement.

    Functions that are called are taken whole, so that their lines and calls are the same in every slice: they are made once for a function, and a slice
    lists functions. Only what a slice holds by itself, its own lines and its callers', is made slice by slice, and the few functions that it holds both ways.
    """
    calls = cut(text_calls(g))
    found = _with_callers(g, points, calls, caller_hops)
    seeds = found.join(calls, "id").select(F.col("slice_id").alias("root"), F.col("callee").alias("id"))
    down = reach(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), seeds)
    down = cut(down.select(F.col("root").alias("slice_id"), F.col("id").alias("function_id")))
    where = g.node("code", "line", "col", "filepath", "function_id", "is_cfg", where="line >= 0 and code is not null")
    where = cut(where.select("id", "function_id", F.col("filepath").alias("path"), "line", "is_cfg", F.struct(F.coalesce("col", F.lit(-1)).alias("c"), "id", "code").alias("cell")))
    whole = where.where("is_cfg and function_id is not null")
    pair = ["slice_id", "function_id"]
    own = found.join(where, "id")
    both = cut(own.select(*pair).distinct().join(down, pair, "left_semi"))
    joined = lambda rows, *by: rows.groupBy(*by, "path", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_set("cell")), lambda x: x["code"]), " ").alias("code"))
    own_lines = joined(own.select(*pair, "path", "line", "cell").unionByName(both.join(whole, "function_id").select(*pair, "path", "line", "cell")), *pair)

    placed_calls = where.select("id", "line").join(calls, "id")
    of_whole = cut(placed_calls.groupBy("caller", "callee").agg(F.min("line").alias("line")))
    starts = cut(points.select("slice_id", "id").join(own.select("slice_id", "id", "function_id"), ["slice_id", "id"]).select(*pair).distinct())
    first = found.join(placed_calls, "id").select("slice_id", F.col("caller").alias("function_id"), "callee", "line").join(starts, pair, "left_semi").join(both, pair, "left_anti")
    again = starts.join(both, pair, "left_semi").join(of_whole.withColumnRenamed("caller", "function_id"), "function_id").select(*pair, "callee", "line")
    step = first.unionByName(again).select("slice_id", "callee", F.array("line").alias("lead"))
    placed = starts.withColumn("lead", F.array().cast("array<int>"))
    for _ in range(MOST_ROUNDS):
        step = step.groupBy("slice_id", F.col("callee").alias("function_id")).agg(F.min("lead").alias("lead"))
        fresh = cut(step.join(placed.select(*pair), pair, "left_anti"))
        if fresh.isEmpty():
            break
        placed = placed.unionByName(fresh)
        step = fresh.withColumnRenamed("function_id", "caller").join(of_whole, "caller").select("slice_id", "callee", F.concat("lead", F.array("line")).alias("lead"))
    called = down.join(both, pair, "left_anti").join(placed, pair, "left").join(joined(whole, "function_id"), "function_id")
    lines = called.unionByName(own_lines.join(placed, pair, "left"), allowMissingColumns=False)
    return lines.select("slice_id", F.concat(F.coalesce("lead", F.array(F.lit(2**31 - 1))), F.array("line")).alias("place"), "path", "line", "code")
