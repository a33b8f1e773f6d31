"""Fixpoints: reachability, bounded hops and bounded paths.

Edges of trees, flow and dependence stay inside a function. Where edges say to which one they belong, and none leaves it, each function is searched
whole in one pass over the edges sorted by function, without rounds. Other edges, and functions too large for that, take deduplicating semi-naive
loops: each round joins the new rows with the edges, drops what is known, and cuts the lineage by a checkpoint in the shared folder; only counts come
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.io import cut

#: Rounds after which a fixpoint gives up with an error rather than run on.
MOST_ROUNDS = 10_000


#: Edges and seeds of the largest function that is searched in one piece, and rows that a task searches.
LARGEST, ROWS_A_TASK = 1_000_000, 2_000_000


def reach(edges: DataFrame, seeds: DataFrame, most_hops: int | None = None) -> DataFrame:
    """``(root, id, hops)``: what each root reaches along ``edges(src, dst)``, itself at 0 hops, with the least number of hops.

    ``seeds(root, id)``. Cycles, loops and repeated edges are harmless; without ``most_hops`` it runs to the fixpoint. If the edges have a
    ``function_id`` too, functions that no edge leaves are searched each on its own.
    """
    edges = edges.where("src is not null and dst is not null")
    if "function_id" in edges.columns:
        return _reach_within(edges.select("src", "dst", "function_id"), seeds, most_hops)
    return _reach_in_rounds(edges, seeds, most_hops)


def _reach_within(edges: DataFrame, seeds: DataFrame, most_hops: int | None) -> DataFrame:
    edges = cut(edges.distinct())
    owner = edges.select(F.explode(F.array("src", "dst")).alias("id"), F.col("function_id").alias("f"))
    owner = owner.groupBy("id").agg(F.min("f").alias("f"), F.max("f").alias("g"), F.max(F.col("f").isNull()).alias("lone"))
    # What leaves its function, or belongs to none, makes all be searched in rounds; so does a function beyond the bound.
    leaves = owner.agg(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("most"), F.max(F.col("lone") | (F.col("f") != F.col("g"))).alias("leaves"))
    sizes = edges.groupBy("function_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.lit(False).alias("leaves"))
    size = sizes.unionByName(leaves).agg(F.max("all").alias("all"), F.max("most").alias("most"), F.max("leaves").alias("leaves")).first()
    if size["leaves"] or size["most"] > LARGEST:
        return _reach_in_rounds(edges, seeds, most_hops)
    placed = seeds.select("root", "id").distinct().join(owner.select("id", F.col("f").alias("function_id")), "id", "left")
    rows = edges.select("function_id", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    # Seeds on no edge reach themselves alone; they are spread by their id.
    rows = rows.unionByName(placed.select(F.coalesce("function_id", F.xxhash64("id")).alias("function_id"), F.lit(1).alias("kind"), F.col("root").alias("a"), F.col("id").alias("b")))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["all"] // ROWS_A_TASK)
    rows = rows.repartition(parts, "function_id").sortWithinPartitions("function_id", "kind")
    return rows.mapInArrow(_search(most_hops), "root long, id long, hops int")


def _search(most_hops: int | None):
    """Breadth-first search of each function's edges from its seeds; rows come sorted by function, edges first."""

    def found(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        after: dict[int, set[int]] = {}
        seeds: dict[int, set[int]] = {}
        cut = int(np.searchsorted(kind, 1))
        for x, y in zip(a[:cut].tolist(), b[:cut].tolist()):
            after.setdefault(x, set()).add(y)
        for r, x in zip(a[cut:].tolist(), b[cut:].tolist()):
            seeds.setdefault(r, set()).add(x)
        roots, ids, hops = [], [], []
        for r, level in seeds.items():
            seen, n = set(level), 0
            while level:
                roots += [r] * len(level)
                ids += level
                hops += [n] * len(level)
                if n == most_hops:
                    break
                level = {y for x in level for y in after.get(x, ())} - seen
                seen |= level
                n += 1
        return roots, ids, hops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            f = cols[0]
            starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            out: tuple[list[int], list[int], list[int]] = ([], [], [])
            for low, high in zip(starts, [*starts[1:], len(f)]):
                if cols[1][high - 1] == 1:
                    for all_, part in zip(out, found(*(c[low:high] for c in cols[1:]))):
                        all_ += part
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["root", "id", "hops"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            f = cols[0]
            last = int(np.searchsorted(f, f[-1]))
            if not last and (not held or held[0][0][0] == f[0]):
                held.append(cols)
                continue
            yield work([np.concatenate(p) for p in zip(*held, [c[:last] for c in cols])])
            held = [[c[last:] for c in cols]]
        if held:
            yield work([np.concatenate(p) for p in zip(*held)])

    return run


def _reach_in_rounds(edges: DataFrame, seeds: DataFrame, most_hops: int | None) -> DataFrame:
    edges = edges.select("src", "dst").distinct()
    edges = cut(edges)
    known = frontier = cut(seeds.select("root", "id").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, (most_hops if most_hops is not None else MOST_ROUNDS) + 1):
        step = frontier.select("root", F.col("id").alias("src")).join(edges, "src").select("root", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(known, ["root", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        if hop % 8 == 0:
            known = cut(known)
    if most_hops is None:
        raise RuntimeError(f"no fixpoint after {MOST_ROUNDS} rounds")
    return known


def closure(edges: DataFrame) -> DataFrame:
    """``(src, dst)``: all pairs joined by one or more edges, for trees and other shallow graphs: from hubs of a cyclic graph use ``reach`` with seeds.

    Paths are doubled each round, so that rounds grow with the logarithm of the depth.
    """
    pairs = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    count = pairs.count()
    for _ in range(MOST_ROUNDS):
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        pairs = cut(pairs.unionByName(longer).distinct())
        now = pairs.count()
        if now == count:
            return pairs
        count = now
    raise RuntimeError(f"no fixpoint after {MOST_ROUNDS} rounds")


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, most_nodes: int = 20, most_visits: int = 2, stops: DataFrame | None = None) -> DataFrame:
    """``(start, end, path)``: one path for each start and end that has one, the shortest, of these the least in order of ids.

    ``starts(start)``, ``ends(start, end)`` says which ends count for a start. A path holds a node ``most_visits`` times at most and ``most_nodes``
    nodes; it doesn't go through or end at a node of ``stops(start, id)``, save its own start. Of the paths that get from a start to a node in the
    same number of steps only the least goes on, so that a round holds a row for each start and node.
    """
    wanted = cut(ends.select("start", F.col("end").alias("at")).distinct())
    return _paths(edges, starts, lambda step: step.join(wanted, ["start", "at"], "left_semi"), most_nodes, most_visits, stops)


def paths_to_any(edges: DataFrame, starts: DataFrame, ends: DataFrame, most_nodes: int = 20, most_visits: int = 2) -> DataFrame:
    """The same where every end of ``ends(end)`` counts for every start."""
    wanted = cut(ends.select(F.col("end").alias("at")).distinct())
    return _paths(edges, starts, lambda step: step.join(wanted, "at", "left_semi"), most_nodes, most_visits, None)


def _paths(edges: DataFrame, starts: DataFrame, arrived, most_nodes: int, most_visits: int, stops: DataFrame | None) -> DataFrame:
    edges = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    frontier = starts.select("start", F.col("start").alias("at"), F.array("start").alias("path")).distinct()
    found = arrived(frontier)
    for _ in range(most_nodes - 1):
        step = frontier.withColumnRenamed("at", "src").join(edges, "src").withColumnRenamed("dst", "at")
        step = step.where(F.size(F.filter("path", lambda x: x == F.col("at"))) < most_visits)
        if stops is not None:
            step = step.join(stops.select("start", F.col("id").alias("at")), ["start", "at"], "left_anti")
        frontier = cut(step.select("start", "at", F.concat("path", F.array("at")).alias("path")).groupBy("start", "at").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        found = found.unionByName(arrived(frontier))
    best = F.min(F.struct(F.size("path").alias("n"), "path")).getField("path").alias("path")
    return found.groupBy("start", F.col("at").alias("end")).agg(best)


def reaching_definitions(flow: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(src, dst, var)``: definitions that reach a use, over ``flow(src, dst)`` and ``symbols(id, symbol, is_def)``.

    The relational form of what ``parse.flow`` does for one function, for functions too large for one task: a definition moves on unless it is
    defined again, by exactly the same symbol.
    """
    flow = cut(flow.select("src", "dst").distinct())
    defs = cut(symbols.where("is_def").select("id", "symbol").distinct())
    frontier = cut(defs.join(flow.withColumnRenamed("src", "id"), "id").select(F.col("id").alias("src"), "symbol", F.col("dst").alias("at")).distinct())
    known = frontier
    for hop in range(MOST_ROUNDS):
        moving = frontier.join(defs.withColumnRenamed("id", "at"), ["at", "symbol"], "left_anti")
        step = moving.join(flow.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").select("src", "symbol", F.col("next").alias("at")).distinct()
        frontier = cut(step.join(known, ["src", "symbol", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if hop % 8 == 7:
            known = cut(known)
    else:
        raise RuntimeError(f"no fixpoint after {MOST_ROUNDS} rounds")
    used = symbols.where("not is_def").select(F.col("id").alias("at"), "symbol").distinct()
    return known.join(used, ["at", "symbol"]).select("src", F.col("at").alias("dst"), F.col("symbol").alias("var"))


def turned(edges: DataFrame) -> DataFrame:
    """Edges the other way round, with their function if they have one."""
    kept = [c for c in edges.columns if c == "function_id"]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *kept)


def hops(edges: DataFrame, pipe: DataFrame, order: int | None, keep: Column | None = None, columns: DataFrame | None = None) -> DataFrame:
    """``(root, id)``: what lies within ``order`` hops against the direction of ``edges``, at any distance if it is None, the roots not among them,
    each once.

    With ``keep`` only nodes that meet it, on ``columns(id, ...)``; others are passed through.
    """
    back = turned(edges)
    seeds = pipe.select(F.col("id").alias("root"), "id")
    found = reach(back, seeds, order).where("hops > 0").select("root", "id")
    return found if keep is None else found.join(columns.where(keep).select("id"), "id", "left_semi")
