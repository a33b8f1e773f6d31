"""Lookups, steps, fixpoints, taint and slices on a graph built from source, and on awkward tables."""

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators import lookup, points, reach, slices, steps, taint, windows
from weftgraph.parse.build import build_graph
from weftgraph.schema import EDGES, NODES

SOURCE = """
int helper(char *dst, int size) { int n = read_input(dst, size); return n; }
int asink(int v, char *p);
int work(char *in) {
    char buf[10];
    int len = source(in);
    int safe = 1;
    if (len < 10) { memcpy(buf, in, len); }
    helper(buf, len);
    len = 3;
    asink(len, buf);
    delete in;
    return len;
}
"""


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([("/src/t1/a.c", SOURCE, "t1"), ("/src/t1/empty.c", "", "t1"), ("/src/t1/null.c", None, None)], "path string, text string, test_id string")
    nodes, edges = build_graph(files, {"read_input": [0]})
    return CodeGraph(nodes.cache(), edges.cache())


@pytest.fixture
def empty(spark):
    return CodeGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def codes(g, pipe):
    return sorted(r.code or "" for r in pipe.select("id").join(g.node("code"), "id").collect())


def one(g, code, kind=None):
    found = g.nodes.where(F.col("code") == code)
    return found if kind is None else found.where(F.col("type") == kind)


def test_lookups(graph):
    n = graph.nodes
    assert [r.name for r in lookup.functions_by_name(n, "work").collect()] == ["work"]
    assert {r.name for r in lookup.query(n, "type:Function AND name:*e*").collect()} == {"helper"}
    assert lookup.query(n, 'type:Callee AND code:"memcpy"').count() == 1
    assert lookup.query(n, "no such syntax ::").count() == 0 and lookup.query(n, "absent:x").count() == 0 and lookup.query(n, "").count() == 0
    assert codes(graph, lookup.calls_to(n, graph.edges, "int * memcpy")) == ["memcpy ( buf , in , len )"]
    assert {r.name for r in lookup.functions_by_parameter(n, "char * in").collect()} == {"work"}
    assert lookup.conditions_of(n, "work", "len <.*").count() == 1 and lookup.conditions_of(n, "work", "len").count() == 0
    assert lookup.find(n, "Function", name="nobody").count() == 0
    assert lookup.files_by_name(n, "/src/*").count() == 3


def test_functions_meet_and_part(graph):
    n = graph.nodes
    conditions = lookup.conditions(n)
    assert lookup.in_functions_of(lookup.statements(n), conditions).select("function_id").distinct().count() == 1
    kept = lookup.not_in_functions_of(n.where("type in ('Function', 'ReturnStatement')"), conditions)
    assert {r.type for r in kept.collect()} == {"Function", "ReturnStatement"} and kept.where("type = 'ReturnStatement'").count() == 1


def test_steps_over_syntax(graph):
    g = graph
    call = lookup.calls_to(g.nodes, g.edges, "memcpy")
    assert codes(g, steps.ith_arguments(g, call, 1)) == ["in"] and codes(g, steps.call_to_callee(g, call)) == ["memcpy"]
    assert codes(g, steps.call_to_arguments(g, call)) == ["buf", "in", "len"]
    assert codes(g, steps.argument_to_call(g, steps.ith_arguments(g, call, 0))) == ["memcpy ( buf , in , len )"]
    assert [r.n for r in steps.num_children(g, call.select("id")).collect()] == [2]
    assign = one(g, "len = 3", "AssignmentExpr")
    assert codes(g, steps.lval(g, assign)) == ["len"] and codes(g, steps.rval(g, assign)) == ["3"]
    whole = one(g, "len = 3 ;", "ExpressionStatement")
    assert codes(g, steps.match(g, whole, F.col("type") == "AssignmentExpr", "type")) == ["len = 3"]
    assert codes(g, steps.match_parents(g, assign, F.col("type") == "ExpressionStatement", "type")) == ["len = 3 ;"]
    at = steps.statement_of(g, assign.select("id")).select(F.col("statement").alias("id"))
    assert codes(g, at) == ["len = 3 ;"]
    assert "len" in codes(g, steps.uses(g, one(g, "len < 10", "Condition")))
    assert codes(g, steps.defines(g, whole)) == ["len"]


def test_data_flows_to_uses(graph):
    g = graph
    end = one(g, "asink ( len , buf ) ;", "ExpressionStatement")
    assert codes(g, steps.producers(g, end, "len")) == ["len = 3 ;"]
    start = one(g, "int len = source ( in ) ;", "IdentifierDeclStatement")
    assert codes(g, steps.users(g, start, ["len"])) == ["helper ( buf , len ) ;", "len < 10", "memcpy ( buf , in , len ) ;"]


def test_calls_link_arguments_to_parameters(graph):
    g = graph
    links = taint.argument_links(g)
    assert codes(g, links.select(F.col("parameter").alias("id"))) == ["char * dst", "int size"]
    params = one(g, "int size", "Parameter")
    assert codes(g, taint.expand_parameters(g, params)) == ["len"] and codes(g, taint.expand_parameters(g, one(g, "char * in", "Parameter"))) == ["char * in"]
    assert codes(g, taint.expand_arguments(g, taint.expand_parameters(g, params))) == ["int size"]
    assert taint.interprocedural_edges(g).count() == 2
    up = taint.tainted_by(g, one(g, "return n ;", "ReturnStatement"))
    assert "int n = read_input ( dst , size ) ;" in codes(g, up) and "helper ( buf , len ) ;" in codes(g, up)
    assert codes(g, taint.tainted_arguments(g, "memcpy", ".*source.*")) == ["memcpy ( buf , in , len )"]
    assert taint.tainted_arguments(g, "asink", ".*source.*").count() == 0


def test_unsanitized_paths(graph):
    g = graph
    starts, ends = one(g, "int len = source ( in ) ;"), g.nodes.where("is_cfg")
    found = {codes(g, taint_row) [0]: n for taint_row, n in [(ends.where(F.col("id") == r.end), len(r.path)) for r in taint.unsanitized_paths(g, starts, ends).where("var = 'len'").collect()]}
    assert found["len < 10"] == 3 and "memcpy ( buf , in , len ) ;" in found and "helper ( buf , len ) ;" in found
    clean = taint.unsanitized_paths(g, starts, ends, F.col("code").rlike("^len < 10$")).where("var = 'len'")
    assert clean.count() == 0


def test_unchecked_calls(graph):
    g = graph
    calls = g.nodes.where("is_cfg").where(F.col("code").rlike("^(memcpy|helper) "))
    assert codes(g, taint.unchecked(g, calls, "len", "%s < .*")) == ["helper ( buf , len ) ;"]


def test_invocations_and_definition_trees(graph):
    g = graph
    chains = [r.chain for r in taint.invocations(g, one(g, "return n ;", "ReturnStatement")).collect()]
    assert len(chains) == 1 and len(chains[0]) == 2
    tree = taint.local_definition_tree(g, one(g, "memcpy ( buf , in , len ) ;"))
    assert {r.kind for r in tree.collect()} == {"data", "condition"}


def test_slices_follow_data_and_control(spark, graph):
    g = graph
    fid = g.nodes.where("name = 'work'").first().id
    seed = one(g, "memcpy ( buf , in , len ) ;").first().id
    given = spark.createDataFrame([("api", "t1", fid, [seed], ["memcpy"]), ("api", "t1", fid, [seed], None), ("x", None, None, None, None)], "kind string, test_id string, function_id long, node_ids array<long>, names array<string>")
    pts = slices.points_of(given)
    assert pts.count() == 1
    back = codes(g, slices.backward_slice(g, pts))
    assert "int len = source ( in ) ;" in back and "len < 10" in back and "len = 3 ;" not in back
    ahead = codes(g, slices.forward_slice(g, slices.points_of(given.withColumn("node_ids", F.array(F.lit(one(g, "len = 3 ;", "ExpressionStatement").first().id))))))
    assert sorted(set(ahead)) == ["asink ( len , buf ) ;", "len = 3 ;", "return len ;"]
    lines = slices.slice_lines(g, slices.program_slice(g, pts))
    text = slices.rendered(lines).first()
    assert text.text.splitlines()[0].startswith("char * in") and text.lines[-1].split(" ")[-1] == "8"
    bad = spark.createDataFrame([("/src/t1/a.c", 8), ("/src/t1/a.c", 8), ("/other", 8), (None, None)], "path string, line int")
    labels = [tuple(r)[1:] for r in slices.label_slices(lines, bad).collect()]
    assert labels == [(1, 1)]
    assert slices.label_slices(lines, bad.limit(0)).first().label == 0
    inside = codes(g, slices.program_slice(g, slices.points_of(given.withColumn("node_ids", F.array(F.lit(one(g, "helper ( buf , len ) ;").first().id)))), call_hops=1))
    assert "return n ;" in inside


def test_points(graph):
    g = graph
    assert {r.name for r in points.call_points(g).collect()} == {"memcpy"}
    assert codes(g, points.declaration_points(g, "pointer")) == ["char * dst", "char * in"]
    assert codes(g, points.declaration_points(g, "array")) == ["char buf [ 10 ] ;"]


def test_completion_stops_at_the_next_definition(spark):
    rows = [(1, 1, 10, "x", True), (2, 1, 20, "x", False), (3, 1, 30, "x", True), (4, 1, 40, "x", False), (4, 1, 40, "x", True), (5, 1, 50, "x", False), (6, 2, 60, "x", False)]
    table = spark.createDataFrame(rows, "id long, function_id long, pos int, symbol string, is_def boolean")
    assert sorted(tuple(r) for r in slices.complete_data_edges(table).collect()) == [(1, 2, "x"), (3, 4, "x"), (4, 5, "x")]
    scopes = spark.createDataFrame([(9, True, 3), (9, False, 4)], "test long, branch boolean, id long")
    assert sorted(tuple(r) for r in slices.complete_data_edges(table, scopes).collect()) == [(1, 2, "x"), (4, 5, "x")]


def test_scopes_of_conditions(graph):
    g = graph
    held = slices.if_scopes(g)
    assert [(r.branch, c) for r in held.collect() for c in codes(g, g.nodes.where(F.col("id") == r.id))] == [(True, "memcpy ( buf , in , len ) ;")]


def test_reach_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (3, 4), (2, 3), (None, 4), (5, None)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1), (4, 4), (1, 1)], "root long, id long")
    got = sorted(tuple(r) for r in reach.reach(edges, seeds).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (4, 4, 0)]
    assert reach.reach(edges, seeds, 1).count() == 3 and reach.reach(edges.limit(0), seeds).count() == 2
    assert reach.closure(edges).count() == 12


def test_paths_are_bounded(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 4), (4, 3)], "src long, dst long")
    starts, ends = spark.createDataFrame([(1,)], "start long"), spark.createDataFrame([(1, 3), (1, 9)], "start long, end long")
    assert [tuple(r) for r in reach.paths(edges, starts, ends).collect()] == [(1, 3, [1, 2, 3])]
    stops = spark.createDataFrame([(1, 2)], "start long, id long")
    assert [r.path for r in reach.paths(edges, starts, ends, stops=stops).collect()] == [[1, 4, 3]]
    assert reach.paths(edges, starts, ends, most_nodes=2).count() == 0
    assert reach.paths(edges.limit(0), starts, ends).count() == 0


def test_relational_and_local_reaching_definitions_agree(graph):
    g = graph
    symbol = g.node("type", "code").where("type = 'Symbol'").select(F.col("id").alias("dst"), F.col("code").alias("symbol"))
    cfg = g.node("is_cfg").where("is_cfg").select(F.col("id").alias("src"))
    rows = g.edge("USE", "DEF", columns=("src", "dst", "etype")).join(symbol, "dst").join(cfg, "src", "left_semi").select(F.col("src").alias("id"), "symbol", (F.col("etype") == "DEF").alias("is_def"))
    got = {tuple(r) for r in reach.reaching_definitions(g.edge("FLOWS_TO"), rows).collect()}
    want = {tuple(r) for r in g.edge("REACHES", columns=("src", "dst", "var")).collect()}
    exits = {r.id for r in g.node("type").where("type = 'CFGExitNode'").collect()}
    assert {x for x in got if x[1] not in exits} == {x for x in want if x[1] not in exits} and want


def test_graph_is_written_appended_and_cut(spark, graph, tmp_path):
    graph.write(str(tmp_path / "g"))
    again = CodeGraph.read(spark, str(tmp_path / "g"))
    assert again.nodes.count() == graph.nodes.count() and again.edges.count() == graph.edges.count()
    both = graph.append_new(CodeGraph(graph.nodes, graph.edges))
    assert both.nodes.count() == graph.nodes.count() and both.edges.count() == graph.edges.count()
    gone = graph.without(graph.nodes.where("type = 'Symbol'"))
    assert gone.edges.where("etype in ('USE', 'DEF')").count() == 0


def test_awkward_graphs(spark, empty):
    g = empty
    pipe = g.nodes.select("id")
    for df in (steps.out(g, pipe, "FLOWS_TO"), steps.degree(g), steps.locations(g, pipe), slices.dependence_edges(g), slices.merge_lines(g.nodes), slices.text_calls(g), points.call_points(g), slices.object_edges(g), taint.argument_links(g), steps.syntax_closure(g)):
        assert df.count() == 0
    nodes = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "y"), (2, "Condition", None)], "id long, type string, code string")
    odd = CodeGraph(nodes, spark.createDataFrame([(1, None, "REACHES", None, None), (1, 2, None, None, None)], "src long, dst long, etype string, var string, flow_label string"))
    assert odd.node("type").count() == 2 and odd.edge("REACHES").count() == 0 and odd.edge().count() == 1
    assert lookup.query(nodes, "code:*").count() == 1


def test_windows(spark):
    a = spark.createDataFrame([("k", 1), ("k", 3), ("j", 5)], "key string, id long")
    b = spark.createDataFrame([("k", 2), ("j", 4), ("j", 6)], "key string, id long")
    assert sorted(tuple(r) for r in windows.pairs(a, b, "key", "id").collect()) == [("j", 1, 5, 4), ("k", 1, 1, 2)]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["diff", "@@ -1 +1 @@", "-a", "+b", "@@ -9,2 +9 @@", "-c"])], "file string, pos int, value string")
    got = [(r.hunk, r.place) for r in windows.hunks(lines).orderBy("pos").collect()]
    assert got == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_neighbourhood_labels(spark):
    labels = spark.createDataFrame([(1, "ab"), (2, "c"), (3, None)], "id long, label string")
    got = {r.id: r.label for r in taint.neighborhood_hash(spark.createDataFrame([(1, 2)], "src long, dst long"), labels, 1).collect()}
    assert got == {1: ((97 * 31 + 98) * 2) ^ 99, 2: 198, 3: 0}


def test_filters_and_columns_reach_the_scan(spark, graph, tmp_path):
    graph.nodes.write.parquet(str(tmp_path / "nodes.parquet"))
    g = CodeGraph(spark.read.parquet(str(tmp_path / "nodes.parquet")), graph.edges)
    plan = g.node("code", where="type = 'Condition'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,Condition)" in plan
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "code" in scan and "operator" not in scan and "filepath" not in scan
    text = lookup.query(g.nodes, "type:Callee AND code:mem*").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(code,mem)" in text


def test_called_lines_follow_the_call(spark, graph):
    g = graph
    seed = one(g, "helper ( buf , len ) ;").first().id
    given = spark.createDataFrame([("api", "t1", 1, [seed])], "kind string, test_id string, function_id long, node_ids array<long>")
    pts = slices.points_of(given)
    lines = slices.inlined_lines(g, slices.program_slice(g, pts, call_hops=1), pts).orderBy("place").collect()
    order = [r.line for r in lines]
    at = order.index(9)
    assert order[at + 1 : at + 2] == [2] and order[:at] == sorted(order[:at]) and min(order[:at]) == 4


def test_slices_cross_calls(spark, tmp_path):
    from weftgraph.plans.queries import QUERIES

    chain = [f"int f{i}(int a) {{\n  int b = f{i + 1}(a);\n  return b;\n}}" for i in range(8)] + ["int f8(int a) {\n  return a;\n}"]
    g = CodeGraph(*build_graph(spark.createDataFrame([("/k/t/m.c", "\n".join(reversed(chain)), "t")], "path string, text string, test_id string")))
    g.nodes.write.parquet(str(tmp_path / "nodes.parquet"))
    g.edges.write.parquet(str(tmp_path / "edges.parquet"))
    g = CodeGraph.read(spark, str(tmp_path))
    nodes, edges = g.nodes.collect(), slices.dependence_edges(g).collect()
    name = {r.id: r.name for r in nodes if r.type == "Function"}
    seed = next(r for r in nodes if r.is_cfg and r.code == "int b = f5 ( a ) ;")
    given = spark.createDataFrame([("api", "t", seed.function_id, [seed.id])], "kind string, test_id string, function_id long, node_ids array<long>")
    given.coalesce(1).write.parquet(str(tmp_path / "slice_points.parquet"))

    def follow(start, back):
        seen, todo = set(), list(start)
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [e.src for e in edges if back and e.dst == i] + [e.dst for e in edges if not back and e.src == i and e.var is not None]
        return seen

    calls = [(r.id, name[r.function_id], f"f{i}") for r in nodes if r.is_cfg and r.code for i in range(9) if f"f{i} (" in r.code and name.get(r.function_id, f"f{i}") != f"f{i}"]
    found = follow([seed.id], True) | follow([seed.id], False)
    for _ in range(3):
        taken = {name[r.function_id] for r in nodes if r.id in found and r.type == "Parameter"}
        found |= follow([i for i, _, callee in calls if callee in taken], True)
    whole = set()
    while more := {c for i, f, c in calls if i in found or f in whole} - whole:
        whole |= more
    want = found | {r.id for r in nodes if r.is_cfg and name.get(r.function_id) in whole}
    got = {r.id for r in slices.crossing_slice(g, slices.points_of(given)).collect()}
    assert got == want, [(r.type, r.code, name.get(r.function_id), r.id in got) for r in nodes if r.id in got ^ want]
    lines = {r.id: r.line for r in nodes}
    got = {r.line for r in QUERIES["inlined_slices"](spark, str(tmp_path)).collect()}
    assert got == {r.line for r in nodes if r.id in want and r.line is not None and r.line >= 0 and r.code is not None}
    touched = {name[r.function_id] for r in nodes if r.id in want and name.get(r.function_id)}
    assert touched == {f"f{i}" for i in range(1, 9)} and lines[seed.id] in got


def test_modifiers_lead_what_follows(spark):
    rows = [(1, 7, 0, "static"), (2, 7, 5, "inline"), (3, 7, 9, "int x ;"), (4, 7, 12, "y ;"), (5, 8, 0, "static"), (6, 8, None, None)]
    got = {r.id: r.code for r in slices.fold_modifiers(spark.createDataFrame(rows, "id long, function_id long, start_idx int, code string")).collect()}
    assert got == {3: "static inline int x ;", 4: "y ;", 6: None}


def test_what_arguments_rest_on(graph):
    from weftgraph.operators import arguments

    g = graph
    call = g.nodes.where("type = 'CallExpression' and code = 'memcpy ( buf , in , len )'")
    named = {(r.place, r.var): r.definition for r in arguments.definitions_per_argument(g, call).collect()}
    assert set(named) == {(0, "buf"), (1, "in"), (2, "len")}
    assert codes(g, arguments.definitions_per_argument(g, call).where("var = 'len'").select(F.col("definition").alias("id"))) == ["int len = source ( in ) ;"]
    assert [(r.place, r.template) for r in arguments.conditions_per_argument(g, call).collect()] == [(2, "ARG < NUM")]
    read = g.nodes.where("type = 'CallExpression' and code = 'read_input ( dst , size )'")
    rows = arguments.call_graphlets(g, read).collect()
    assert {r.kind for r in rows} == {"data", "call"} and max(r.level for r in rows) == 1
    found = codes(g, arguments.call_graphlets(g, read).where("level = 1").select(F.col("src").alias("id")))
    assert "int len = source ( in ) ;" in found


def test_parts_of_a_graph(graph):
    from weftgraph.operators import arguments

    part = graph.of_functions(arguments.functions_named(graph, "helper", "t1"))
    assert {r.name for r in part.nodes.where("type = 'Function'").collect()} == {"helper"}
    ids = {r.id for r in part.nodes.collect()}
    assert part.edges.count() and all(r.src in ids and r.dst in ids for r in part.edges.collect())
    assert arguments.functions_named(graph, "nobody").count() == 0


def test_methods_and_destructors(spark):
    from weftgraph.operators import arguments

    text = "int C::run(int x) { return x; }\nC::~C() { free(p); }\nC::C(int a) { p = a; }\nint main(void) { C *c = new C(1); c->run(2); delete c; D d; d.run(3); return 0; }"
    g = CodeGraph(*build_graph(spark.createDataFrame([("/k/t/m.cpp", text, "t")], "path string, text string, test_id string")))
    name = {r.id: r.name for r in g.nodes.where("type = 'Function'").collect()}
    assert set(name.values()) == {"C :: run", "C :: ~C", "C :: C", "main"}
    assert {name[r.callee] for r in arguments.method_calls(g).collect()} >= {"C :: run"}
    assert {name[r.callee] for r in slices.text_calls(g).collect()} == {"C :: C"}


def test_nearest_conditions(spark):
    from weftgraph.operators import arguments

    scopes = spark.createDataFrame([(1, True, 2), (1, True, 3), (1, True, 4), (2, False, 4)], "test long, branch boolean, id long")
    assert {r.id: r.test for r in arguments.nearest_condition(scopes).collect()} == {2: 1, 3: 1, 4: 2}


def test_sanitisers_stop_taint(graph):
    g = graph
    end = one(g, "return n ;", "ReturnStatement")
    up = codes(g, taint.tainted_by(g, end, sanitizer=F.col("code").rlike("^helper ")))
    assert "int n = read_input ( dst , size ) ;" in up and "helper ( buf , len ) ;" not in up
