"""A code property graph: nodes and typed edges as DataFrames, read once and pruned by every query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.io import table


def latest(nodes: DataFrame, *columns: str) -> DataFrame:
    """``id`` and the named columns of each id's latest delivery; equal times are settled by the columns themselves. Rows without id are left out."""
    if not columns:
        return nodes.where("id is not null").select("id").distinct()
    if "loaded_at" not in nodes.columns:
        return nodes.where("id is not null").select("id", *columns).dropDuplicates(["id"])
    row = F.max(F.struct("loaded_at", *columns))
    return nodes.where("id is not null").groupBy("id").agg(row.alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in columns))


@dataclass(frozen=True)
class CodeGraph:
    """``nodes`` and ``edges`` as stored: nodes may be delivered several times, edges may be repeated."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> CodeGraph:
        return cls(table(spark, folder, "nodes"), table(spark, folder, "edges"))

    def node(self, *columns: str, where: Column | str | None = None) -> DataFrame:
        """``id`` and the named columns, one row for each id; with ``where`` only nodes that meet it.

        Deliveries of an id differ in their time alone, so that the condition is put to the rows as they are stored: it reaches the scan, and only
        what meets it is shuffled.
        """
        return latest(self.nodes if where is None else self.nodes.where(where), *columns)

    def node_of(self, pipe: DataFrame, *columns: str) -> DataFrame:
        """``id`` and the named columns of the nodes in a pipe, one row for each id: others are dropped before the deduplication."""
        return latest(self.nodes.join(pipe.select("id").distinct(), "id", "left_semi"), *columns)

    def edge(self, *kinds: str, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
        """The named columns of the edges of these types, each combination once; without types, of all edges."""
        edges = self.edges.where(F.col("etype").isin(*kinds)) if kinds else self.edges
        return edges.where("src is not null and dst is not null").select(*columns).distinct()

    def of_functions(self, functions: DataFrame) -> CodeGraph:
        """The part of the graph that belongs to ``functions(id)``: their nodes, and the edges among these."""
        wanted = functions.select("id").distinct()
        own = self.nodes.join(wanted.withColumnRenamed("id", "function_id"), "function_id", "left_semi")
        nodes = own.unionByName(self.nodes.join(wanted, "id", "left_semi").select(*own.columns)).select(*self.nodes.columns)
        ids = nodes.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return CodeGraph(nodes, edges.select(*self.edges.columns))

    def write(self, folder: str, append: bool = False) -> None:
        """Parquet with a folder for each type, so that lookups and hops read their types alone. ``append`` adds to what is there."""
        mode = "append" if append else "overwrite"
        self.nodes.write.mode(mode).partitionBy("type").parquet(f"{folder}/nodes.parquet")
        self.edges.write.mode(mode).partitionBy("etype").parquet(f"{folder}/edges.parquet")

    def append_new(self, other: CodeGraph) -> CodeGraph:
        """This graph and what the other one has besides: ids and edges already here are not added again."""
        new = other.nodes.join(self.nodes.select("id"), "id", "left_anti").select(*self.nodes.columns)
        keys = ["src", "dst", "etype", "var", "flow_label"]
        here = self.edges.select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        edges = other.edges.join(here, same, "left_anti").select(*self.edges.columns)
        return CodeGraph(self.nodes.unionByName(new), self.edges.unionByName(edges))

    def without(self, ids: DataFrame) -> CodeGraph:
        """The graph without the nodes ``ids(id)`` and their edges."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return CodeGraph(self.nodes.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))
