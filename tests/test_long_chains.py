"""Chains of calls: what is shuffled on the way to the longest ones."""

from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators import taint
from weftgraph.schema import EDGES, NODES


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def graph(spark, calls, returning):
    rows = [(f, "Function", None) for f in sorted({f for c in calls for f in c})] + [(f + 1000, "ReturnStatement", f) for f in returning]
    columns = [(x.split()[0], x.split()[1]) for x in NODES.split(",")]
    nodes = spark.createDataFrame(rows, "id long, type string, function_id long")
    nodes = nodes.select(*(F.col(n) if n in nodes.columns else F.lit(None).cast(k).alias(n) for n, k in columns))
    return CodeGraph(nodes, spark.createDataFrame([], EDGES)), spark.createDataFrame(calls, "callee long, caller long")


def chains(calls, top, depth):
    ups = sorted({b for a, b in calls if a == top[-1]})
    if not ups or depth == 0:
        return [top]
    return [c for u in ups if u not in top for c in chains(calls, [*top, u], depth - 1)]


def test_chains_of_any_depth(spark):
    calls = [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (2, 2), (4, 8), (9, 4), (10, 11), (11, 10)]
    g, known = graph(spark, calls, [1, 2, 4, 7, 8, 9, 10])
    pipe = g.nodes.where("type = 'ReturnStatement'").select("id")
    for depth in range(6):
        got = sorted((r.root, list(r.chain)) for r in taint.invocations(g, pipe, depth, known).collect())
        assert got == sorted((f + 1000, c) for f in [1, 2, 4, 7, 8, 9, 10] for c in chains(calls, [f], depth))


def test_the_longest_chains_are_not_shuffled(spark):
    wide = 9
    g, known = graph(spark, [(k * 100 + i, k * 100 + 100 + j) for k in range(4) for i in range(wide) for j in range(wide)], range(wide))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        found = taint.invocations(g, g.nodes.where("type = 'ReturnStatement'").select("id"), calls=known)
        assert found.selectExpr("size(chain) AS n").rdd.map(lambda r: r.n).filter(lambda n: n == 5).count() == wide**5
        assert sum(n for k, n in shuffled(spark).items() if k not in before) < wide**4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
