"""Lines across calls: the same as of all statements of a slice, without a row for each of these."""

from weftgraph.graph import CodeGraph
from weftgraph.operators import slices
from weftgraph.parse.build import build_graph


def test_lines_of_functions_are_made_once(spark, monkeypatch):
    chain = [f"int f{i}(int a) {{\n  int b = f{i + 1}(a);\n  f{max(0, i - 3)}(b); f{i + 1}(b);\n  return b;\n}}" for i in range(6)] + ["int f6(int a) {\n  return a;\n}", "int lone(int z) {\n  return z;\n}"]
    g = CodeGraph(*build_graph(spark.createDataFrame([("/k/t/m.c", "\n".join(chain), "t")], "path string, text string, test_id string")))
    nodes = g.nodes.where("is_cfg and line >= 0").collect()
    # A call at a place that no line has leads nowhere, but what it calls is in the slice.
    hidden = {r.id for r in nodes if r.code in ("int b = f5 ( a ) ;", "f6 ( b ) ;", "int b = f6 ( a ) ;")}
    kept = g.nodes.drop("line").join(spark.createDataFrame([(r.id, r.line) for r in g.nodes.collect() if r.id not in hidden], "id long, line int"), "id", "left")
    g = CodeGraph(kept, g.edges)
    given = spark.createDataFrame([("api", "t", r.function_id, [r.id]) for r in nodes], "kind string, test_id string, function_id long, node_ids array<long>")
    points = slices.points_of(given)
    rows = lambda df: sorted((r.slice_id, tuple(r.place), r.path, r.line, r.code) for r in df.collect())
    want = rows(slices.inlined_lines(g, slices.crossing_slice(g, points), points))
    assert len({len(r[1]) for r in want}) > 3 and any(r[1][0] == 2**31 - 1 for r in want)
    for name in ("inlined_lines", "crossing_slice"):
        monkeypatch.setattr(slices, name, None)
    assert rows(slices.crossing_lines(g, points)) == want
