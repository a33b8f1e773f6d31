"""Exact similarity join of sets as a blocked sparse matrix product.

The matrix has a row for each distinct set and a column for each word key. Columns are ordered from rare to common, and of each set only the
entries of a prefix take part: two sets with similarity t or more share at least ``ceil(t / (1 + t) * (|a| + |b|))`` keys, so that one of the first
``|a| - ceil(t * |a|) + 1`` of either is shared, whatever the order of columns. The product is formed column by column, in blocks of bounded
height, and a pair is dropped inside its block as soon as a bound from the sizes, from the positions of the shared key, or from two profiles of the
sets, of 128 bits and for large sets of up to 1,024, shows that the overlap can't suffice. What remains is counted exactly on the full rows.

The order of columns comes from a sketch of fixed width that holds how many rows fall on each counter. The order steers the cost alone; any order
gives the same result. A column is cut into blocks by its exact height: only columns whose counter is high enough to be hot are counted, so that
neither a rare column on a full counter is cut, nor a hot one left whole. Words are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import kept, only_long

#: Counters of the sketch as a power of two: 4 bytes each, 16 MB sent to every executor at any size of input.
SKETCH_BITS = 22
#: Entries of a column that meet in one block; a column with more is cut into blocks, and each pair of blocks is a group of its own.
BLOCK_ROWS = 4096
#: Hot columns whose heights are sent to the executors, 16 bytes each; of more, entries meet them in a join.
MOST_HOT = 1_000_000
#: Entries that a task multiplies, about; more entries take more tasks.
ENTRIES_A_TASK = 4_000_000
#: Sets whose entries are made at a time.
SETS_AT_ONCE = 1000
#: Pairs held in memory at a time while a block is multiplied, and pairs whose wide profiles are compared at a time.
PAIRS_AT_ONCE, WIDE_AT_ONCE = 2_000_000, 100_000
#: Sets of more keys than this fill the 128 bits, so that all look alike; their entries bring a wide profile too, of that many longs at most.
NARROW, WIDE = 128, 16

LEFT, RIGHT = 1, 2


def long_sets(nodes: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(id, loaded_at, sid, h)`` of the long codes as delivered, ``members(id, sid)`` and ``sets(sid, h)`` of the long records.

    Records with the same words share a set. Rows without id are left out; of several deliveries the one with the latest ``loaded_at`` counts. The
    rows are kept, so that codes are cut into words once, until ``similar_sets`` lets go of them; members are kept from here on.
    """
    rows = only_long(nodes.where(F.col("id").isNotNull()).select("id", "loaded_at", "code"), "code", least_words)
    rows = kept(rows.select("id", "loaded_at", F.xxhash64("h").alias("sid"), "h"))
    members = kept(rows.groupBy("id").agg(F.max(F.struct("loaded_at", "sid")).getField("sid").alias("sid")))
    members.count()  # now, while the rows are there
    sets = rows.groupBy("sid").agg(F.first("h").alias("h"))
    return rows, members, sets


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def sketch(rows: DataFrame) -> np.ndarray:
    """How many entries of ``h`` fall on each counter, over all rows: an array of fixed width. Counts combine before the shuffle, and what reaches
    the driver is no more than 6 bytes for each counter in use."""
    width = 1 << SKETCH_BITS
    at = F.col("h").bitwiseAND(F.lit(width - 1)).cast("int")
    counts = rows.select(F.explode("h").alias("h")).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    cell = F.struct((F.col("at").bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short").alias("low"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))
    packed = counts.groupBy(F.shiftright("at", 16).alias("part")).agg(F.collect_list(cell).alias("cells")).toArrow()
    total = np.zeros(width, dtype=np.uint32)
    for part, cells in zip(packed.column("part").to_pylist(), packed.column("cells")):
        low, n = (cells.values.field(x).to_numpy() for x in ("low", "n"))
        total[(part << 16) + low.astype(np.int32) + 0x8000] = n
    return total


def _tall(counts, most: int):
    """From sets to ``(key, n)`` of the entries on counters above ``most``, counted in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for b in batches:
            h, _ = _lists(b.column(0))
            keys, n = np.unique(h[table[h & (len(table) - 1)] > most], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return run


def hot_columns(sets: DataFrame, counts, most: int) -> DataFrame:
    """``(key, n)``: the exact heights of the columns with more than ``most`` entries."""
    tall = sets.select("h").mapInArrow(_tall(counts, most), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return tall.where(F.col("n") > most)


def _longs(n: np.ndarray) -> np.ndarray:
    """How many longs the wide profiles of sets of ``n`` keys have: a power of two that gives each key a bit, up to ``WIDE``, none for small sets."""
    return np.where(n <= NARROW, 0, np.minimum(WIDE, 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).astype(np.int64)))


def _wide(h: np.ndarray, row: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """The wide profiles of all rows, one behind the other."""
    own = longs[row]
    h, row, own = h[own > 0], row[own > 0], own[own > 0]
    at = (np.cumsum(longs) - longs)[row] + ((h >> 6) & (own - 1))
    out = np.zeros(int(longs.sum()), np.uint64)
    if len(h):
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        out[at[order][starts]] = np.bitwise_or.reduceat(np.uint64(1) << (h[order] & 63).astype(np.uint64), starts)
    return out.view(np.int64)


def _entries(counts, num: int, den: int, hot=None):
    """From sets to the matrix entries of their prefixes, each sent to every block pair that needs it.

    ``hot`` holds the sorted keys of the hot columns and their heights. Without it, entries on counters high enough to be hot are left whole, as block
    -1, for ``cut_blocks``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        hot_keys, heights = hot.value if hot is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        mask = len(table) - 1
        for b in (b.slice(low, SETS_AT_ONCE) for b in batches for low in range(0, b.num_rows, SETS_AT_ONCE)):
            h, at = _lists(b.column(1))
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            count = table[h & mask].astype(np.int64)
            lanes = []
            for lane in (0, 1):
                bits = np.where((h >> 6) & 1 == lane, np.uint64(1) << (h & 63).astype(np.uint64), np.uint64(0))
                lanes.append(np.bitwise_or.reduceat(bits, at[:-1]).view(np.int64))
            longs = _longs(n)
            wide, wide_at = _wide(h, row, longs), np.cumsum(longs) - longs
            order = np.lexsort((h, count, row))
            pos = np.arange(len(h)) - np.repeat(at[:-1], n)
            prefix = n - (num * n + den - 1) // den + 1
            key, count = h[order], count[order]
            take = (pos < np.repeat(prefix, n)) & (count > 1)
            key, count, pos, row = key[take], count[take], pos[take], row[take]
            sid, k = b.column(0).to_numpy()[row], longs[row]
            side = b.column(2).to_numpy()[row].astype(np.int64)
            blocks = np.ones(len(key), np.int64)
            if len(hot_keys):
                near = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                blocks = np.where(hot_keys[near] == key, 1 + heights[near] // BLOCK_ROWS, 1)
            own = (sid.view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(key)), blocks)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            low, high = np.minimum(own[rep], other), np.maximum(own[rep], other)
            block = (low << 31) | high
            if hot is None:
                block = np.where(count > BLOCK_ROWS, -1, block)
            upper = (own[rep] == high).astype(np.int64)  # of the two blocks that meet, the one an entry is from
            meta = (pos.astype(np.int64) << 3) | side
            cols = [key[rep], block, n[row][rep].astype(np.int32), sid[rep], meta[rep] | (upper << 2), lanes[0][row][rep], lanes[1][row][rep]]
            k, first = k[rep], wide_at[row][rep]
            ends = np.r_[0, np.cumsum(k)]
            flat = wide[np.arange(ends[-1]) - np.repeat(ends[:-1], k) + np.repeat(first, k)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), lists], ["key", "block", "n", "sid", "meta", "s0", "s1", "wide"])

    return run


def cut_blocks(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries whose block is -1 sent to the block pairs of their column by a join with the heights ``hot(key, n)``; others as they are."""
    blocks = 1 + F.floor(F.coalesce("height", F.lit(0)) / F.lit(BLOCK_ROWS))
    tall = entries.where("block = -1").join(hot.withColumnRenamed("n", "height"), "key", "left").withColumn("own", F.pmod("sid", blocks))
    tall = tall.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    upper = F.col("meta").bitwiseAND(F.lit(~4)).bitwiseOR(F.when(F.col("own") == high, 4).otherwise(0))
    tall = tall.withColumns({"block": F.shiftleft(low, 31).bitwiseOR(high), "meta": upper})
    return entries.where("block <> -1").unionByName(tall.select(*entries.columns))


ENTRY = "key long, block long, n int, sid long, meta long, s0 long, s1 long, wide array<long>"


def _rows_of(column: pa.Array) -> np.ndarray:
    """Wide profiles as a matrix, shorter ones filled up with zeros."""
    values, at = _lists(column)
    k = np.diff(at)
    out = np.zeros((len(k), WIDE), np.int64)
    out[np.repeat(np.arange(len(k)), k), np.arange(len(values)) - np.repeat(at[:-1], k)] = values
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At least how many keys of the one set are not in the other, and the other way round, by their profiles."""
    return tuple(np.bitwise_count(p.view(np.uint64)).astype(np.int64).sum(axis=1) for p in (x & ~y, y & ~x))


def _by_wide(x: np.ndarray, y: np.ndarray, n: np.ndarray, wide: np.ndarray, num: int, whole: int) -> np.ndarray:
    """Which pairs of large sets may still have the overlap, by profiles folded to the width of the smaller set; pairs with a small set may."""
    may = np.ones(len(x), bool)
    size = np.minimum(_longs(n[x]), _longs(n[y]))
    for k in np.unique(size[size > 0]):
        of_k = np.flatnonzero(size == k)
        for low in range(0, len(of_k), WIDE_AT_ONCE):
            some = of_k[low : low + WIDE_AT_ONCE]
            folded = (np.bitwise_or.reduce(wide[z[some]].reshape(len(some), -1, k), axis=1) for z in (x, y))
            only_x, only_y = _apart(*folded)
            n_x, n_y = n[x[some]].astype(np.int64), n[y[some]].astype(np.int64)
            may[some] = np.minimum(n_x - only_x, n_y - only_y) * whole >= num * (n_x + n_y)
    return may


def _multiply(num: int, den: int, both: bool):
    """Pairs of each block, smaller set second; rows come sorted by column, block and size."""
    whole = num + den

    def pairs_of(key, block, n, sid, meta, s0, s1, wide) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pos, upper, side = meta >> 3, (meta >> 2) & 1, meta & 3
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        group = np.zeros(len(key), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        rank = (group << 32) + n
        fit = np.flatnonzero((n - pos) * whole >= 2 * num * n)  # only these can be the smaller one of a pair
        low = np.searchsorted(rank[fit], (group << 32) + (num * n + den - 1) // den)
        high = np.searchsorted(fit, np.arange(len(key)))
        high = np.maximum(high, low)
        todo = np.cumsum(high - low)
        begin = 0
        while begin < len(key):
            done = todo[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(todo, done + PAIRS_AT_ONCE, side="right")))
            k = (high - low)[begin:end]
            x = np.repeat(np.arange(begin, end), k)
            y = fit[np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[begin:end], k)]
            begin = end
            best = 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
            ok = best * whole >= num * (n[x].astype(np.int64) + n[y])
            if not both:
                ok &= ((side[x] & LEFT) & ((side[y] & RIGHT) >> 1)) | (((side[x] & RIGHT) >> 1) & (side[y] & LEFT)) > 0
            x, y = x[ok], y[ok]
            first, last = block[x] >> 31, block[x] & ((1 << 31) - 1)
            apart = first != last
            if apart.any():  # two blocks meet: pairs within one of them belong to its own group
                same = upper[x] == upper[y]
                x, y = x[~(apart & same)], y[~(apart & same)]
            n_x, n_y = n[x].astype(np.int64), n[y].astype(np.int64)
            only_x, only_y = (sum(np.bitwise_count((s[p] & ~s[q]).view(np.uint64)).astype(np.int64) for s in (s0, s1)) for p, q in ((x, y), (y, x)))
            ok = np.minimum(n_x - only_x, n_y - only_y) * whole >= num * (n_x + n_y)
            x, y = x[ok], y[ok]
            ok = _by_wide(x, y, n, wide, num, whole)
            x, y = x[ok], y[ok]
            turn = (n[x] == n[y]) & (sid[x] < sid[y])
            yield np.where(turn, sid[y], sid[x]), np.where(turn, sid[x], sid[y])

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        both_ = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both_[:, 0]), pa.array(both_[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        found_a, found_b, size = [], [], 0

        def work(cols):
            nonlocal size
            for a, b in pairs_of(*cols):
                if len(a):
                    found_a.append(a)
                    found_b.append(b)
                    size += len(a)

        for batch in batches:
            cols = [*(c.to_numpy() for c in batch.columns[:-1]), _rows_of(batch.columns[-1])]
            cols = cols if held is None else [np.concatenate([p, q]) for p, q in zip(held, cols)]
            key, block = cols[0], cols[1]
            if len(key) < 50_000:
                held = cols
                continue
            ends = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))
            if not len(ends):
                held = cols
                continue
            cutoff = ends[-1] + 1
            work([c[:cutoff] for c in cols])
            held = [c[cutoff:] for c in cols]
            if size > PAIRS_AT_ONCE:
                yield out(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, size = [], [], 0
        if held is not None and len(held[0]):
            work(held)
        if found_a:
            yield out(np.concatenate(found_a), np.concatenate(found_b))

    return run


def similar_sets(rows: DataFrame, sets: DataFrame, num: int, den: int, both: bool = True) -> DataFrame:
    """``(a, b, n_a, n_b, overlap)``: pairs of different sets whose overlap is at least ``num / den`` of their union, each once.

    ``sets(sid, h)`` has distinct ``sid`` and sorted distinct keys; the ``rows`` they are from are let go of as soon as the sets are kept, so that not
    both lie on the executors' disks beside what the join writes. With ``both=False`` a third column ``side`` says on which sides of the join a
    set stands (1 left, 2 right, 3 both), and only pairs across are given, the larger set as ``a`` as else.
    """
    spark = sets.sparkSession
    if both:
        sets = sets.select("sid", "h", F.lit(LEFT | RIGHT).cast("byte").alias("side"))
    sets = kept(sets.select("sid", "h", F.col("side").cast("byte").alias("side")))
    table = sketch(sets)
    rows.unpersist()
    counts = spark.sparkContext.broadcast(table)
    hot = (np.zeros(0, np.int64),) * 2
    if table.max(initial=0) > BLOCK_ROWS:
        heights = hot_columns(sets, counts, BLOCK_ROWS)
        found = heights.limit(MOST_HOT + 1).toArrow()
        hot = tuple(found.column(c).to_numpy() for c in ("key", "n"))
    if len(hot[0]) <= MOST_HOT:
        order = np.argsort(hot[0])
        shared = spark.sparkContext.broadcast((hot[0][order], hot[1][order]))
        entries = sets.mapInArrow(_entries(counts, num, den, shared), ENTRY)
    else:
        entries = cut_blocks(sets.mapInArrow(_entries(counts, num, den), ENTRY), heights)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(table.sum(dtype=np.int64)) // ENTRIES_A_TASK)
    entries = entries.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "n")
    pairs = entries.mapInArrow(_multiply(num, den, both), "a long, b long").distinct()
    rows = sets.select("sid", "h")
    pairs = pairs.join(rows.select(F.col("sid").alias("b"), F.col("h").alias("h_b")), "b")  # the smaller set goes to the larger one
    pairs = pairs.join(rows.select(F.col("sid").alias("a"), F.col("h").alias("h_a")), "a")
    counted = pairs.select("a", "b", F.size("h_a").alias("n_a"), F.size("h_b").alias("n_b"), F.size(F.array_intersect("h_a", "h_b")).alias("overlap"))
    return counted.where(F.col("overlap") * (num + den) >= num * (F.col("n_a") + F.col("n_b")))
