"""Scalar functions on code, and predicates on trees."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import code as C
from weftgraph.graph import CodeGraph
from weftgraph.operators import checks, steps
from weftgraph.parse.build import build_graph


def values(spark, rows, column, schema="x string"):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_arguments_and_what_they_write(spark):
    rows = [("memcpy ( & p -> q . r , f ( a , b ) , 4 ) ;",), ("sscanf ( s , \"%d\" , & n , x [ 2 ] ) ;",), ("( void ) strcpy ( ( char * ) dst + 1 , src ) ;",), ("mymemcpy ( a , b ) ;",), ("",), (None,)]
    assert values(spark, rows, C.arguments(F.col("x"), "memcpy")) == [["& p -> q . r", "f ( a , b )", "4"], None, None, None, None, None]
    got = values(spark, rows, C.written_by_call(F.col("x")))
    assert got[:5] == [["p", "p -> q", "p -> q . r"], ["n", "x"], ["dst"], [], []]


def test_declarators(spark):
    rows = [("int a = 1 , * b , c [ 10 ] ;",), ("char * s ;",), ("struct x y = z ;",), ("",)]
    assert values(spark, rows, C.declared_names(F.col("x"))) == [["a", "b", "c"], ["s"], ["y"], []]
    assert values(spark, [("C * c = new C ( 1 ) ;",), ("delete [ ] c ;",), ("x",)], C.object_calls(F.col("x"))) == [["C :: C"], ["delete c"], []]


def test_focus_and_labels(spark):
    rows = [(["a", "b", "c"], "c"), (["a", "b", "c"], "z"), ([], "z")]
    frame = spark.createDataFrame(rows, "t array<string>, f string")
    assert [r.v for r in frame.select(C.focus_index(F.col("t"), F.col("f")).alias("v")).collect()] == [3, 2, 1]
    assert values(spark, [(["good1", "x"],), (["x"],)], C.good_or_bad(F.col("x")), "x array<string>") == [["good1"], ["main"]]
    assert values(spark, [(0,), (3,), (None,)], C.two_classes(F.col("x")), "x int") == [0, 1, None]
    flips = sum(values(spark, [(i,) for i in range(2000)], C.noisy(F.lit(0), F.col("x"), 10), "x long"))
    assert 120 < flips < 280


def test_properties_and_places(spark):
    assert values(spark, [("True",), ("false",), ("x",), (None,)], C.property_value(F.col("x"), "boolean")) == [True, False, None, None]
    assert values(spark, [("7",), ("x",)], C.property_value(F.col("x"), "integer")) == [7, None]
    row = spark.createDataFrame([(52.5, 13.4)], "a double, b double")
    assert row.select(C.distance_km(F.col("a"), F.col("b"), (48.1, 11.6)).alias("v")).first().v == pytest.approx(505, abs=5)
    assert row.select(C.within_box(F.col("a"), F.col("b"), (50, 10), (60, 20)).alias("v")).first().v
    assert values(spark, [("2041-03-04",)], C.calendar_path(F.col("x").cast("date"))) == ["2041/03/04"]


SOURCE = """
void taints(char *p) { *p = source12(); }
int f(char *a, int n) {
    taints(a);
    if (n == 3 && n < limit(a)) { memcpy(a, b, n); }
    return g->h.i + n;
}
"""


@pytest.fixture(scope="module")
def graphs(spark):
    files = spark.createDataFrame([("/t/x.c", SOURCE)], "path string, text string")
    made = [CodeGraph(*(df.cache() for df in build_graph(files, t))) for t in (None, {"taints": [0], "memcpy": [0]})]
    return made


def codes(g, pipe, key="id"):
    return sorted(r.code for r in pipe.select(F.col(key).alias("id")).join(g.node("code"), "id").collect())


def test_predicates_on_trees(graphs):
    g = graphs[0]
    condition = g.nodes.where("type = 'Condition'")
    assert codes(g, checks.check_expressions(g, condition, "n")) == ["n < limit ( a )", "n == 3"]
    assert codes(g, checks.checks(g, condition, "a|zzz")) == ["n == 3 && n < limit ( a )"] and checks.checks(g, condition, "zzz").count() == 0
    assert codes(g, checks.calls_within(g, condition, "limit .*")) == ["limit ( a )"]
    tops = g.nodes.where("type = 'FunctionDef'")
    assert codes(g, checks.arguments_of(g, tops, "memcpy", 2)) == ["n"]
    assert codes(g, checks.parameters_matching(g, tops, "char .*")) == ["char * a", "char * p"]
    assert {r.symbol for r in checks.api_symbols(g, tops).collect()} >= {"memcpy", "limit", "char * a"}
    assert {r.symbol for r in checks.longest_uses(g, g.nodes.where("type = 'ReturnStatement'")).collect()} == {"n", "* g", "g -> h . i"}
    assert condition.where(checks.code_matches("%s == .*", "n")).count() == 1 and condition.where(checks.code_matches("%s", "n")).count() == 0


def test_symbols_reach_through_trees(graphs):
    g = graphs[1]
    argument = steps.ith_arguments(g, g.nodes.where("code = 'taints ( a )' and type = 'CallExpression'"), 0)
    assert codes(g, checks.tree_sinks(g, argument), "sink") == ["EXIT", "memcpy ( a , b , n ) ;", "n == 3 && n < limit ( a )"]
    assert codes(g, checks.tree_sources(g, argument), "sink") == ["char * a"]
    assert codes(g, checks.argument_tainters(g, argument)) == ["* p = source12 ( ) ;"]


def test_tainting_adds_edges(graphs):
    before, after = graphs
    new = checks.new_edges(before.edges, after.edges, "REACHES")
    assert {r.var for r in new.collect()} == {"a", "* a"}
    assert checks.new_edges(after.edges, after.edges).count() == 0


def test_templates(spark):
    got = values(spark, [('len < 10 && len != "x"',)], checks.normalized_code(F.col("x"), F.lit("len")))
    assert got[0].strip() == "ARG < NUM && ARG != TEXT"


def test_similar_functions_and_a_baseline(spark):
    from weftgraph.functions.embed import api_vectors, baseline_scores, nearest

    rows = [(1, ["memcpy", "free"]), (2, ["memcpy", "free"]), (3, ["printf"]), (4, [])]
    v = api_vectors(spark.createDataFrame(rows, "id long, words array<string>"), "id")
    got = {r.qid: r.vid for r in nearest(v.withColumnRenamed("id", "vid"), v.where("id = 1").select(F.col("id").alias("qid"), F.col("vec").alias("q")), 1).collect()}
    assert got == {1: 2}
    samples = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(40)], "sample_id long, vec array<double>, label int")
    scored = {r.sample_id: r.p for r in baseline_scores(samples, samples).collect()}
    assert len(scored) == 40 and scored[1] > 0.5 > scored[2]
