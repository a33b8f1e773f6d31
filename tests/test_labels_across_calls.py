"""Labels across calls: the same as of all lines, without listing these."""

from weftgraph.graph import CodeGraph
from weftgraph.operators import slices
from weftgraph.parse.build import build_graph


def test_labels_without_listing_lines(spark, monkeypatch):
    chain = [f"int f{i}(int a) {{\n  int b = f{i + 1}(a);\n  f{max(0, i - 3)}(b);\n  return b;\n}}" for i in range(6)] + ["int f6(int a) {\n  return a;\n}", "int lone(int z) {\n  return z;\n}"]
    g = CodeGraph(*build_graph(spark.createDataFrame([("/k/t/m.c", "\n".join(chain), "t")], "path string, text string, test_id string")))
    nodes = g.nodes.where("is_cfg and line >= 0").collect()
    # Statements at a place that no line has are in slices too: one slice has lines in called functions alone.
    hidden = next(r.id for r in nodes if r.code == "int b = f5 ( a ) ;")
    kept = g.nodes.drop("line").join(spark.createDataFrame([(r.id, r.line) for r in g.nodes.collect() if r.id != hidden], "id long, line int"), "id", "left")
    g = CodeGraph(kept, g.edges)
    given = spark.createDataFrame([("api", "t", r.function_id, [r.id]) for r in nodes], "kind string, test_id string, function_id long, node_ids array<long>")
    points = slices.points_of(given)
    bad = spark.createDataFrame([("/k/t/m.c", n) for n in (2, 2, 12, 27, 28, 32, 900)] + [("/k/x.c", 2), (None, 3)], "path string, line int")
    lines = slices.slice_lines(g, slices.crossing_slice(g, points))
    want = sorted(tuple(r) for r in slices.label_slices(lines, bad).select("slice_id", "label", "n_hits").collect())
    assert len({n for _, _, n in want}) > 1
    monkeypatch.setattr(slices, "slice_lines", None)
    got = sorted(tuple(r) for r in slices.crossing_labels(g, points, bad).collect())
    assert got == want
    only = points.where("id = %d" % hidden)
    monkeypatch.setattr(slices, "whole_slice", lambda g, p, edges=None: p.select("slice_id", "id"))
    assert slices.crossing_labels(g, only, bad, 0).count() == 1
