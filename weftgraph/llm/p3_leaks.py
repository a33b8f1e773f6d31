"""Problem 3: the same or nearly the same records across splits.

Fingerprints of a record are the keys of its words, and selected are the minima of its sequence in rare-first order: as many as it takes that every
pair with the required similarity shares one, whatever was inserted, dropped or moved (see ``setjoin``). Positional winnowing of word k-grams gives
no such guarantee, so its seeds serve the coverage report alone: there the minima of the windows of k-grams are joined, each seed is extended along
its diagonal, and collinear runs are chained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cases import case_key, case_splits
from weftgraph.llm.common import kept, records, words
from weftgraph.llm.p1_near import DEN, LEAST_WORDS, NUM
from weftgraph.llm.p8_eval import SEEDS_AT_ONCE, _chunks, _ranges, selected
from weftgraph.llm.setjoin import LEFT, RIGHT, long_sets, similar_sets

#: Words of a fingerprint's k-gram and k-grams of a window in the coverage report.
K, WINDOW = 3, 4


def _placed(nodes: DataFrame, members: DataFrame, dataset_splits: DataFrame) -> DataFrame:
    """``(id, sid, case, split)`` of the long records in a split. A record's ``test_id`` is that of its latest delivery."""
    case = nodes.where(F.col("code").isNotNull()).select("id", "loaded_at", case_key(F.col("test_id")).alias("case"))
    case = case.groupBy("id").agg(F.max(F.struct("loaded_at", "case")).getField("case").alias("case"))
    return members.join(case, "id").join(case_splits(dataset_splits), "case")


def _links(nodes: DataFrame, dataset_splits: DataFrame, num: int, den: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """The placed records, and ``(sid, train_sid)`` with a pair for each held-out set and each similar train set, itself among them."""
    rows, members, sets = long_sets(nodes, least_words)
    placed = _placed(nodes, members, dataset_splits)
    is_train = F.col("split") == "train"
    sides = placed.groupBy("sid").agg((F.max(F.when(is_train, RIGHT).otherwise(0)) + F.max(F.when(is_train, 0).otherwise(LEFT))).cast("byte").alias("side"))
    near = similar_sets(rows, sets.join(sides, "sid").select("sid", "h", "side"), num, den, both=False).select("a", "b")
    ways = F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("train_sid")), F.struct(F.col("b").alias("sid"), F.col("a").alias("train_sid")))
    either = near.select(F.inline(ways))
    same = sides.where(F.col("side") == (LEFT | RIGHT)).select("sid", F.col("sid").alias("train_sid"))
    held = sides.where(F.col("side").bitwiseAND(F.lit(LEFT)) != 0).select("sid")
    train = sides.where(F.col("side").bitwiseAND(F.lit(RIGHT)) != 0).select(F.col("sid").alias("train_sid"))
    links = either.join(held, "sid", "left_semi").join(train, "train_sid", "left_semi")
    return placed, links.unionByName(same).select("sid", "train_sid")


def leaked(nodes: DataFrame, test_cases: DataFrame, dataset_splits: DataFrame, num: int = NUM, den: int = DEN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(split, source, node_id)``: each long record of a held-out split that is similar to a train record, once.

    Records without a split, with null or short code are no cases; a test case without a row in ``test_cases`` or with a null source has the source
    ``unknown``. Empty tables give no rows.
    """
    placed, links = _links(nodes, dataset_splits, num, den, least_words)
    held = placed.where("split <> 'train'").join(links.select("sid").distinct(), "sid", "left_semi")
    named = test_cases.select(case_key(F.col("test_id")).alias("case"), F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"))
    named = named.groupBy("case").agg(F.min("source").alias("source"))
    found = held.join(named, "case", "left")
    return found.select("split", F.coalesce("source", F.lit("unknown")).alias("source"), F.col("id").alias("node_id"))


def _spans(held: np.ndarray, train: np.ndarray, k: int, window: int) -> np.ndarray:
    """Rows ``(start in held, start in train, words)``: the runs of at least ``k`` equal words on every diagonal that has a seed, in order."""
    i, f = selected(held, np.array([0, len(held)]), k, window)
    j, g = selected(train, np.array([0, len(train)]), k, window)
    order = np.argsort(g, kind="stable")
    low, high = np.searchsorted(g[order], f, side="left"), np.searchsorted(g[order], f, side="right")
    shift = np.unique(np.repeat(i, high - low) - j[order[_ranges(low, high - low)]])
    begin = np.maximum(0, shift)
    size = np.minimum(len(held), len(train) + shift) - begin
    out = [np.zeros((0, 3), np.int64)]
    for some in _chunks(size, SEEDS_AT_ONCE):
        where, of = _ranges(begin[some], size[some]), np.repeat(shift[some], size[some])
        same = np.r_[False, held[where] == train[where - of], False]
        edge = np.zeros(len(where) + 1, bool)
        edge[np.cumsum(size[some]) - size[some]] = True  # a run ends with its diagonal
        first = np.flatnonzero(same[1:-1] & (~same[:-2] | edge[:-1]))
        last = np.flatnonzero(same[1:-1] & (~same[2:] | edge[1:]))
        n = last - first + 1
        out.append(np.stack([where[first], where[first] - of[first], n], 1)[n >= k])
    spans = np.concatenate(out)
    return spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]


def chained(held: np.ndarray, train: np.ndarray, k: int = K, window: int = WINDOW) -> int:
    """How many words of ``held`` a chain of collinear seeds, each extended to both sides, covers in ``train``; words come as 64-bit hashes.

    Spans that overlap count their common words once.
    """
    spans = _spans(held.view(np.uint64), train.view(np.uint64), k, window)
    ends = np.zeros((3, len(spans)), np.int64)  # end in held, end in train, words covered by the best chain that ends so
    for m, (a, b, n) in enumerate(spans.tolist()):
        cut = np.maximum(0, np.maximum(ends[0, :m] - a, ends[1, :m] - b))
        before = np.where(cut < n, ends[2, :m] - cut, 0).max(initial=0)
        ends[:, m] = a + n, b + n, before + n
    return int(ends[2].max(initial=0))


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(1), b.column(3))]
        words = [[v[low:high] for low, high in zip(at, at[1:])] for v, at in lists]
        covered = [chained(x, y) for x, y in zip(*words)]
        cols = [b.column(0), b.column(2), pa.array([len(x) for x in words[0]], pa.int64()), pa.array(covered, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["held", "train_id", "n_words", "n_covered"])


def coverage(nodes: DataFrame, test_cases: DataFrame, dataset_splits: DataFrame) -> DataFrame:
    """``(node_id, split, source, train_id, n_words, n_covered)``: how much of each leaked record the closest train record holds in order.

    Each is aligned with all train records whose set is similar to its own; the closest is the one that covers the most words, of several the one
    with the smallest id. Records with the same words in the same order are aligned once.
    """
    placed, links = _links(nodes, dataset_splits, NUM, DEN, LEAST_WORDS)
    links = kept(links.distinct())
    is_train = F.col("split") == "train"
    placed = placed.join(links.select("sid").distinct(), "sid", "left_semi").where(~is_train).unionByName(placed.join(links.select(F.col("train_sid").alias("sid")).distinct(), "sid", "left_semi").where(is_train))
    placed = kept(placed.select("id", "sid", "case", "split"))
    text = records(nodes.select("id", "loaded_at", "code").join(placed.select("id").distinct(), "id", "left_semi")).select("id", F.transform(words(F.col("code")), lambda w: F.xxhash64(w)).alias("w"))
    placed = kept(placed.join(text, "id").select("id", "sid", "case", "split", F.xxhash64("w").alias("seq"), "w"))
    held = placed.where("split <> 'train'")
    one = F.min(F.struct("id", "w"))
    held_texts = held.groupBy("sid", F.col("seq").alias("held")).agg(one.alias("t")).select("sid", "held", F.col("t.w").alias("held_words"))
    train = placed.where("split = 'train'").groupBy(F.col("sid").alias("train_sid"), "seq").agg(one.alias("t")).select("train_sid", F.col("t.id").alias("train_id"), F.col("t.w").alias("train_words"))
    pairs = links.join(held_texts, "sid").join(train, "train_sid").select("held", "held_words", "train_id", "train_words")
    aligned = pairs.mapInArrow(_cover, "held long, train_id long, n_words long, n_covered long")
    best = F.max(F.struct("n_covered", (-F.col("train_id")).alias("last"), "n_words")).alias("best")
    best = aligned.groupBy(F.col("held").alias("seq")).agg(best).select("seq", (-F.col("best.last")).alias("train_id"), "best.n_words", "best.n_covered")
    out = held.select(F.col("id").alias("node_id"), "split", "case", "seq").join(best, "seq")
    named = test_cases.select(case_key(F.col("test_id")).alias("case"), F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"))
    named = named.groupBy("case").agg(F.min("source").alias("source"))
    out = out.join(named, "case", "left")
    return out.select("node_id", "split", F.coalesce("source", F.lit("unknown")).alias("source"), "train_id", "n_words", "n_covered")


def coverage_report(nodes: DataFrame, test_cases: DataFrame, dataset_splits: DataFrame) -> DataFrame:
    """``(split, source, n_records, n_words, n_covered)``: the coverage of leaked records by split and source."""
    each = coverage(nodes, test_cases, dataset_splits)
    return each.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_words").alias("n_words"), F.sum("n_covered").alias("n_covered"))
