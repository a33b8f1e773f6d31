"""Functions put together again from their statements."""

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators.snippets import rebuilt
from weftgraph.parse.build import graph_rows
from weftgraph.schema import EDGES, NODES


def graph(spark, first, second):
    rows = [(f, "Function", None, "f", None, None) for f in (first, second)]
    rows += [(f + 1, "ExpressionStatement", "x = y ;", None, f, 1) for f in (first, second)]
    nodes = spark.createDataFrame(rows, "id long, type string, code string, name string, function_id long, start_idx int")
    columns = [(x.split()[0], x.split()[1]) for x in NODES.split(",")]
    nodes = nodes.select(*(F.col(n) if n in nodes.columns else F.lit(None).cast(k).alias(n) for n, k in columns))
    return CodeGraph(nodes, spark.createDataFrame([], EDGES))


@pytest.mark.parametrize("second", [10, 1 << 40, 1 << 61])
def test_function_ids_far_apart(spark, second):
    built = rebuilt(graph(spark, 1, second))
    assert built.nodes.where("type = 'Function'").count() == 2
    assert built.nodes.count() == built.nodes.select("id").distinct().count()
    assert built.edges.where("etype = 'IS_FUNCTION_OF_AST'").count() == 2


@pytest.mark.parametrize("odd", ["for ;", "for", "struct s : t", "class c : b ;", "for [ 1 ] ;"])
def test_odd_statements_are_no_error(spark, odd):
    """A bracket that is looked for where there is none raised KeyError, which ended the job."""
    g = graph(spark, 1, 10)
    odd_one = g.nodes.withColumn("code", F.when(F.col("id") == 2, odd).otherwise(F.col("code")))
    built = rebuilt(CodeGraph(odd_one, g.edges))
    assert built.nodes.where("type = 'Function'").count() == 2
    assert built.edges.where("etype = 'IS_FUNCTION_OF_AST'").count() == 2


def test_deep_declaration_outside_functions_is_no_error():
    text = "int x = " + "( " * 30_000 + "1" + " )" * 30_000 + " ; int f ( ) { return 1 ; }"
    assert [n["type"] for n in graph_rows("/x.c", text).nodes].count("Function") == 1
