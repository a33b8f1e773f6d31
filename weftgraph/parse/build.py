"""Code property graphs of many files: one pass over the files, each parsed on its own.

Ids are made of the number of the file and a running number within it, so that no two nodes share one. Files are numbered in order of their paths
unless they bring a number. A function that can't be analysed gives one ``Function`` node of type ``Corrupt`` instead of failing the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import numbered_rows
from weftgraph.io import cut
from weftgraph.parse import flow
from weftgraph.parse.lexer import Token
from weftgraph.parse.syntax import Node, parse
from weftgraph.schema import EDGES, NODES

# Fixed value: names of files that are read by default.
SOURCE_FILES = ["*.c", "*.cpp", "*.h", "*.cc", "*.hpp", "*.java"]

_NODE = [x.strip().split(" ")[0] for x in NODES.split(",")]
_EDGE = [x.strip().split(" ")[0] for x in EDGES.split(",")]
#: Bits of an id that number the rows of a file; the others number the files.
ROW_BITS = 32
#: Rows of a graph that are sent on together; a file's rows are never parted.
ROWS_AT_ONCE = 5_000
ROW = "kind string, " + NODES + ", " + ", ".join(f"e_{x.strip()}" for x in EDGES.split(","))


class FileGraph:
    """Rows of one file."""

    def __init__(self, path: str, test_id: str | None, tainted: dict[str, set[int]], file_no: int) -> None:
        self.path, self.test_id, self.tainted = path, test_id, tainted
        if not 0 <= file_no < 1 << (63 - ROW_BITS):
            raise ValueError(f"{file_no} is no number of a file")
        self.base = file_no << ROW_BITS
        self.node_rows: list[tuple] = []
        self.edge_rows: list[tuple] = []
        self.ids: dict[int, int] = {}

    @property
    def nodes(self) -> list[dict]:
        return [dict(zip(_NODE, r)) for r in self.node_rows]

    @property
    def edges(self) -> list[dict]:
        return [dict(zip(_EDGE, r)) for r in self.edge_rows]

    def node(self, kind: str, code=None, name=None, function_id=None, is_cfg=None, child_num=None, operator=None, line=None, col=None, start_idx=None, stop_idx=None, base_type=None, complete_type=None, identifier=None) -> int:
        k = self.base + len(self.node_rows)
        if len(self.node_rows) >> ROW_BITS:
            raise OverflowError(f"{self.path} has too many nodes")
        self.node_rows.append((k, kind, code, name, function_id, is_cfg, child_num, operator, line, col, start_idx, stop_idx, self.path, base_type, complete_type, identifier, self.test_id, None))
        return k

    def edge(self, src: int, dst: int, kind: str, function: int | None = None, var: str | None = None, flow_label: str | None = None) -> None:
        self.edge_rows.append((src, dst, kind, var, flow_label, function, self.test_id))

    def tree(self, toks: list[Token], n: Node, function: int | None, place: int | None = None) -> int:
        """The rows of a tree; a node that stands in it twice has one row."""
        if id(n) in self.ids:
            return self.ids[id(n)]
        kind, code, operator = n.type, n.code, n.operator or None
        where = (None,) * 4
        if toks:
            stop = toks[n.last - 1].stop if n.last > n.first else -1
            where = (*toks[min(n.first, len(toks) - 1)][2:5], stop)
        extra = ()
        if kind == "IdentifierDecl":
            base = n.children[0]
            extra = (base.code, f"{base.code} {base.operator}".strip(), n.children[1].code)
        elif kind == "IdentifierDeclType":
            code, operator = f"{code} {operator}".strip() if operator else code, None
        elif kind == "ForStatement":
            operator = None
        k = self.node(kind, code, None, function, n.is_cfg or None, place, operator, *where, *extra)
        self.ids[id(n)] = k
        for i, c in enumerate(n.children):
            self.edge(k, self.tree(toks, c, function, i), "IS_AST_PARENT", function)
        return k

    def function(self, toks: list[Token], n: Node, file_id: int) -> None:
        name = next(c for c in n.children if c.type == "Identifier")
        at = toks[n.first]
        k = self.node("Function", name=name.code, line=at.line, col=at.col, start_idx=at.start, stop_idx=toks[n.last - 1].stop)
        self.edge(file_id, k, "IS_FILE_OF")
        mark = len(self.node_rows), len(self.edge_rows)
        try:
            self._analyse(toks, n, k)
        except (RecursionError, IndexError, KeyError, StopIteration) as error:
            del self.node_rows[mark[0] :], self.edge_rows[mark[1] :]
            row = self.node_rows[k - self.base]
            self.node_rows[k - self.base] = (k, "Corrupt", type(error).__name__, *row[3:])

    def _analyse(self, toks: list[Token], n: Node, k: int) -> None:
        g = flow.control_flow(n)
        analyser = flow.UseDef(self.tainted)
        seen = [analyser.statement(x) for x in g.nodes]
        symbols = flow.use_def(g, self.tainted, seen)
        reaches = flow.reaching(g, symbols)
        above = flow.post_dominators(g)
        controls = flow.control_dependence(g, above)
        self.edge(k, self.tree(toks, n, k), "IS_FUNCTION_OF_AST", k)
        ids = [self.tree(toks, x, k) for x in g.nodes]
        self.edge(k, ids[0], "IS_FUNCTION_OF_CFG", k)
        for a, b, label in g.edges:
            self.edge(ids[a], ids[b], "FLOWS_TO", k, flow_label=label)
        known: dict[str, int] = {}

        def symbol(s: str) -> int:
            if s not in known:
                known[s] = self.node("Symbol", code=s, function_id=k)
            return known[s]

        links: set[tuple[int, int, str]] = set()
        for i, parts in enumerate(seen):
            links |= {(ids[i], symbol(s), "USE") for s in sorted(symbols[i]["use"])} | {(ids[i], symbol(s), "DEF") for s in sorted(symbols[i]["def"])}
            for part, s, is_def in parts:
                links.add((self.ids[id(part)], symbol(s), "DEF" if is_def else "USE"))
        for a, b, kind in sorted(links):
            self.edge(a, b, kind, k)
        for a, b, s in reaches:
            self.edge(ids[a], ids[b], "REACHES", k, var=s)
        for a, b in enumerate(above):
            if b >= 0:
                self.edge(ids[b], ids[a], "POST_DOM", k)
        for a, b in controls:
            self.edge(ids[a], ids[b], "CONTROLS", k)

    def file(self, text: str) -> None:
        file_id = self.node("File", code=self.path)
        toks, items = parse(text)
        for n in items:
            if n.type == "FunctionDef":
                self.function(toks, n, file_id)
            elif n.type == "ClassDefStatement":
                at = toks[n.first]
                k = self.node("Class", name=n.children[0].code if n.children else None, code=n.code, line=at.line, col=at.col)
                self.edge(file_id, k, "IS_FILE_OF")
                self.edge(k, self.tree(toks, n, None), "IS_CLASS_OF")
            else:
                k = self.node("DeclStmt", code=n.code, line=toks[n.first].line, col=toks[n.first].col)
                self.edge(file_id, k, "IS_FILE_OF")
                for d in n.children:
                    base, ident = d.children[0], d.children[1]
                    made = self.node("Decl", code=d.code, base_type=base.code, complete_type=f"{base.code} {base.operator}".strip(), identifier=ident.code)
                    self.edge(k, made, "DECLARES")


def graph_rows(path: str, text: str, test_id: str | None = None, tainted: dict[str, set[int]] | None = None, file_no: int = 0) -> FileGraph:
    """The graph of one file, in memory."""
    g = FileGraph(path, test_id, tainted or {}, file_no)
    g.file(text)
    return g


def _run(tainted: dict[str, list[int]], kinds: tuple[str, ...] = ("node", "edge")):
    marks = {k: set(v) for k, v in tainted.items()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import sys

        sys.setrecursionlimit(20_000)
        schema = _arrow()
        nodes: list[tuple] = []
        edges: list[tuple] = []

        def batch() -> pa.RecordBatch:
            n, e = len(nodes), len(edges)
            columns = [["node"] * n + ["edge"] * e]
            columns += [[*c, *[None] * e] for c in zip(*nodes)] if n else [None] * len(_NODE)
            columns += [[*[None] * n, *c] for c in zip(*edges)] if e else [None] * len(_EDGE)
            nodes.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) if c else pa.nulls(n + e, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            cols = b.to_pydict()
            for path, text, test_id, file_no in zip(cols["path"], cols["text"], cols["test_id"], cols["file_no"]):
                gc.disable()  # trees have no cycles, and their many nodes would be gone over again and again
                try:
                    g = graph_rows(path, text or "", test_id, marks, file_no)
                finally:
                    gc.enable()
                if "node" in kinds:
                    nodes += g.node_rows
                if "edge" in kinds:
                    edges += g.edge_rows
                if len(nodes) + len(edges) >= ROWS_AT_ONCE:
                    yield batch()
        if nodes or edges:
            yield batch()

    return build


def _arrow() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(x.strip().split(" ")[0], kinds[x.strip().split(" ")[1]]) for x in ROW.split(",")])


def numbered_files(files: DataFrame, first: int = 0) -> DataFrame:
    """``files`` with ``file_no``, numbered from ``first`` in order of their paths; a path has one number wherever it occurs."""
    numbers = numbered_rows(files.select("path").where("path is not null").distinct(), "path")
    return files.join(numbers.select("path", (F.col("no") - 1 + first).alias("file_no")), "path")


def graph_table(files: DataFrame, tainted: dict[str, list[int]] | None = None, kinds: tuple[str, ...] = ("node", "edge")) -> DataFrame:
    """Nodes and edges of ``files(path, text, file_no)`` in one table, told apart by ``kind``, so that each file is parsed once for both; with ``kinds``
    one of the two alone."""
    test_id = F.col("test_id") if "test_id" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", "text", test_id.alias("test_id"), F.col("file_no").cast("long").alias("file_no"))
    return rows.mapInArrow(_run(json.loads(json.dumps(tainted or {})), kinds), ROW)


def nodes_and_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of a graph out of the one that holds both."""
    return rows.where("kind = 'node'").select(*_NODE), rows.where("kind = 'edge'").select(*(F.col(f"e_{x}").alias(x) for x in _EDGE))


def build_graph(files: DataFrame, tainted: dict[str, list[int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of ``files(path, text)``, with ``test_id`` if the files have one.

    ``tainted`` names the arguments that callees define, by number from 0. Null texts are empty files, rows without a path none; a path that occurs
    twice is an error. A column ``file_no`` numbers the files, as when a graph is added to another; without it they are numbered here. Files are
    parsed once: their rows lie in the shared folder from then on.
    """
    given = files.where("path is not null")
    if "file_no" not in files.columns:
        if not given.groupBy("path").count().where("count > 1").isEmpty():
            raise ValueError("a path occurs twice")
        given = numbered_files(given)
    elif not given.groupBy("file_no").count().where("count > 1").isEmpty():
        raise ValueError("a number of a file occurs twice")
    return nodes_and_edges(cut(graph_table(given, tainted)))


def is_source(path: str, patterns: list[str] | None = None) -> bool:
    """Whether the last part of a path is the name of a source file."""
    return any(fnmatch(path.rsplit("/", 1)[-1], p) for p in patterns or SOURCE_FILES)
