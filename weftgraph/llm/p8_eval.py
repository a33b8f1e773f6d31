"""Problem 8: evaluation texts inside training text.

Method: winnowing. Of each window of k-grams the rightmost one with the least hash is selected; with ``K + WINDOW - 1`` words every shared run of
that length has a selected k-gram in common. The selected k-grams of the items go to the executors in blocks of bounded size and meet those of the
documents where these are read, so that the corpus is never shuffled; a hit is extended along its diagonal at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a case, and words of a k-gram.
LEAST_RUN, K = 12, 6
#: Characters of the items of a block, which bound what is sent to the executors at a time: some 20 bytes for each word. More items take more scans.
BLOCK_CHARS = 16_000_000
#: Bytes of text that are cut into words at a time, and seeds or compared words held at a time.
BYTES_AT_ONCE, SEEDS_AT_ONCE = 4_000_000, 2_000_000

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True


class _Powers:
    """Powers of the base of the word hash and of its inverse, as many as a block of text has bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            one = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)])
            self.up, self.down = one(np.uint64(_BASE)), one(np.uint64(pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def word_hashes(texts: pa.Array, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts in order, and where each text's begin; words are runs of ASCII letters, digits and underscores in
    lower case. The hash is a polynomial over the bytes, cut out of one running sum."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = _IN_WORD[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    first = np.flatnonzero(inside & (~before | begins[:-1]))
    last = np.flatnonzero(np.r_[before & (~inside | begins[:-1]), inside[-1:]])
    up, down = powers.of(len(data) + 1)
    running = np.r_[np.uint64(0), np.cumsum(np.where(inside, (_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], np.uint64(0)), dtype=np.uint64)]
    h = (running[last] - running[first]) * down[first]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), np.searchsorted(first, at)


def selected(h: np.ndarray, at: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the selected k-grams of all texts begin, and their hashes."""
    size = len(h) - k + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(size, np.uint64)
    for j in range(k):
        g += h[j : j + size] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    windows = np.maximum(np.diff(at) - (k + window - 1) + 1, 0)  # of each text
    begin = np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    best, least = begin.copy(), g[begin] if len(begin) else g[:0]
    for j in range(1, window):
        other = g[begin + j]
        better = other <= least
        best[better] = begin[better] + j
        least = np.where(better, other, least)
    best = np.unique(best)
    return best, g[best]


@dataclass(frozen=True)
class Items:
    """A block of items: their ids and words, and their selected k-grams in order of hash."""

    ids: np.ndarray
    h: np.ndarray
    at: np.ndarray
    fp: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, texts: pa.Array, k: int, window: int) -> Items:
        h, at = word_hashes(texts, _Powers())
        place, fp = selected(h, at, k, window)
        order = np.argsort(fp, kind="stable")
        return cls(ids, h, at, fp[order], place[order])


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _chunks(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that make at most so many each, or one row."""
    total, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
        yield slice(begin, end)
        begin = end


def longest_runs(h: np.ndarray, at: np.ndarray, items: Items, k: int, least_run: int) -> np.ndarray:
    """Rows ``(text, item, words)``: the longest run of words that a text and an item share, if it has ``least_run`` or more."""
    place, fp = selected(h, at, k, least_run - k + 1)
    low, high = np.searchsorted(items.fp, fp, side="left"), np.searchsorted(items.fp, fp, side="right")
    hit = high > low
    place, low, n = place[hit], low[hit], (high - low)[hit]
    out = np.zeros((0, 3), np.int64)
    for part in _chunks(n, SEEDS_AT_ONCE):
        i, j = np.repeat(place[part], n[part]), items.place[_ranges(low[part], n[part])]
        text, item = np.searchsorted(at, i, side="right") - 1, np.searchsorted(items.at, j, side="right") - 1
        diagonals = np.unique(np.stack([text, item, i - j], 1), axis=0)
        text, item, shift = diagonals.T
        begin = np.maximum(at[text], items.at[item] + shift)
        size = np.minimum(at[text + 1], items.at[item + 1] + shift) - begin
        for some in _chunks(size, SEEDS_AT_ONCE):
            s = size[some]
            where = _ranges(begin[some], s)
            same = h[where] == items.h[where - np.repeat(shift[some], s)]
            so_far = np.cumsum(same)
            reset, starts = np.where(same, 0, so_far), np.cumsum(s) - s
            reset[starts] = np.maximum(reset[starts], so_far[starts] - same[starts])
            run = np.maximum.reduceat(so_far - np.maximum.accumulate(reset), starts)
            long = run >= least_run
            out = np.concatenate([out, np.stack([text[some][long], item[some][long], run[long]], 1)])
    out = out[np.lexsort((-out[:, 2], out[:, 1], out[:, 0]))]
    return out[np.flatnonzero(np.r_[True, (np.diff(out[:, :2], axis=0) != 0).any(1)])] if len(out) else out


def _scan(shared, k: int, least_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, powers = shared.value, _Powers()
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset : batch.column(1).offset + batch.num_rows + 1])
            for part in _chunks(sizes, BYTES_AT_ONCE):
                b = batch.slice(part.start, part.stop - part.start)
                h, at = word_hashes(b.column(1), powers)
                found = longest_runs(h, at, items, k, least_run)
                ids = b.column(0).to_numpy()[found[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items.ids[found[:, 1]], pa.int64()), pa.array(found[:, 2].astype(np.int32))], ["doc_id", "item_id", "n_words"])

    return run


def leaked_items(documents: DataFrame, eval_items: DataFrame, least_run: int = LEAST_RUN, k: int = K) -> DataFrame:
    """``(doc_id, item_id, n_words)``: the document holds ``n_words >= least_run`` consecutive words of the item, the longest such run.

    Words are compared by 64-bit hash. Null and empty texts, and texts with fewer words, hold and leak nothing; rows without id neither. Repeated rows
    of a document or an item count once. Items of more than ``BLOCK_CHARS`` characters in all go in several blocks, each with a scan of its own.
    """
    spark = documents.sparkSession
    docs = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = eval_items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    found = None
    for i in range(blocks):
        block = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)).toArrow()
        texts = block.column("text").combine_chunks().cast(pa.string())
        shared = spark.sparkContext.broadcast(Items.of(block.column("item_id").to_numpy(), texts, k, least_run - k + 1))
        part = docs.mapInArrow(_scan(shared, k, least_run), "doc_id long, item_id long, n_words int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
