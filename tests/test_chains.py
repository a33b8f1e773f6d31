"""Chains of calls: what they write on the way to their result."""

from pathlib import Path

from weftgraph.plans import trees
from weftgraph.schema import EDGES, NODES


def test_chains_write_no_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "with_trees", lambda g: (_ for _ in ()).throw(AssertionError("chains need no trees")))
    row = lambda i, kind, code=None, name=None, f=None, cfg=None: (i, kind, code, name, f, cfg, "t")
    # a calls b twice, b calls c, c calls b, and c has two nodes that return.
    rows = [row(1, "Function", name="a"), row(2, "Function", name="b"), row(3, "Function", name="c")]
    rows += [row(11, "ExpressionStatement", "b ( 1 ) ; b ( 2 ) ;", f=1, cfg=True), row(12, "ExpressionStatement", "c ( ) ;", f=2, cfg=True), row(13, "ExpressionStatement", "b ( ) ;", f=3, cfg=True)]
    rows += [row(21, "ReturnStatement", "return 1 ;", f=3, cfg=True), row(22, "ReturnStatement", "return 2 ;", f=3, cfg=True), row(23, "ReturnStatement", "return ;", f=1, cfg=True), row(24, "ReturnStatement", "return ;")]
    nodes = spark.createDataFrame(rows, "id long, type string, code string, name string, function_id long, is_cfg boolean, test_id string")
    from pyspark.sql import functions as F

    columns = [(x.split()[0], x.split()[1]) for x in NODES.split(",")]
    nodes.select(*(F.col(n) if n in nodes.columns else F.lit(None).cast(k).alias(n) for n, k in columns)).write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([], EDGES).write.parquet(f"{tmp_path}/edges.parquet")
    got = sorted((r.root, r.chain) for r in trees.chains_of_calls(spark, str(tmp_path)).collect() if r.chain != [None])
    assert got == [(21, [3, 2, 1]), (22, [3, 2, 1]), (23, [1])]
