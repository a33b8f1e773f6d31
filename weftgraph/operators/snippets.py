"""Syntax of code that comes in pieces: calls in statements, and whole functions put together from their statements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import numbered_rows
from weftgraph.graph import CodeGraph
from weftgraph.parse.build import graph_table, nodes_and_edges
from weftgraph.parse.syntax import parse_statements


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import sys

    sys.setrecursionlimit(20_000)
    for b in batches:
        rows = []
        for i, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                _, block = parse_statements(code if code.rstrip().endswith((";", "}")) else code + ";")
            except RecursionError:
                continue
            for n in block.walk():
                if n.type == "CallExpression":
                    args = n.children[1].children if len(n.children) > 1 and n.children[1].type == "ArgumentList" else []
                    rows.append((i, n.children[0].code, len(args), [a.code for a in args]))
        cols = zip(*rows) if rows else [()] * 4
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "callee", "n_args", "args"])


def calls_in_code(g: CodeGraph) -> DataFrame:
    """``(id, callee, n_args, args)``: the calls inside each node's code, outer ones first; code nested too deep to be read has none."""
    code = g.node("code", "is_cfg", where="is_cfg and code is not null and instr(code, '(') > 0").select("id", "code")
    return code.mapInArrow(_calls, "id long, callee string, n_args int, args array<string>")


def function_sources(g: CodeGraph) -> DataFrame:
    """``(path, text, test_id, file_no)``: each function as one small file, its statements in order of place. Files are numbered from 0 in order of the
    ids of their functions, however far these lie apart."""
    code = g.node("type", "code", "function_id", "start_idx", where="function_id is not null and code is not null")
    lines = lambda kinds, mark: F.array_join(F.transform(F.filter("cell", lambda x: x["kind"].isin(kinds)), lambda x: x["code"]), mark)
    cell = F.sort_array(F.collect_list(F.struct(F.coalesce("start_idx", F.lit(-1)).alias("at"), "id", "code", F.col("type").alias("kind"))))
    bodies = code.where(~F.col("type").isin("CFGEntryNode", "CFGExitNode", "CFGErrorNode")).groupBy("function_id").agg(cell.alias("cell"))
    names = g.node("type", "name", "test_id", where="type = 'Function'").select(F.col("id").alias("function_id"), "name", "test_id")
    inside = F.filter("cell", lambda x: x["kind"] != "Parameter")
    one = lambda x: F.when(x["kind"] == "Condition", F.concat(F.lit("if ( "), x["code"], F.lit(" ) { }"))).when(x["code"].rlike(r"[;}]\s*$"), x["code"]).otherwise(F.concat(x["code"], F.lit(" ;")))
    text = F.concat(F.lit("void "), F.coalesce("name", F.lit("f")), F.lit(" ( "), lines(["Parameter"], " , "), F.lit(" ) {\n"), F.array_join(F.transform(inside, one), "\n"), F.lit("\n}\n"))
    path = F.concat(F.lit("/functions/"), F.col("function_id").cast("string"), F.lit(".c"))
    numbers = numbered_rows(names.select("function_id"), "function_id").select("function_id", (F.col("no") - 1).alias("file_no"))
    return bodies.join(names, "function_id").join(numbers, "function_id").select(path.alias("path"), text.alias("text"), "test_id", "file_no")


def rebuilt(g: CodeGraph, tainted: dict[str, list[int]] | None = None) -> CodeGraph:
    """The graph built anew, with syntax trees, from the functions' own statements. Its nodes and its edges are lazy, each with a pass of its own that
    makes nothing of the other."""
    spark = g.nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # parsing is work for the CPUs: small inputs must not end up in few tasks
    files = function_sources(g).repartition(parts)
    return CodeGraph(*(nodes_and_edges(graph_table(files, tainted, (kind,)))[i] for i, kind in enumerate(("node", "edge"))))
