"""Skip-gram vectors of vocabularies of any size: no process holds more than the words of its own documents.

The most frequent words, a bounded number, are trained first, against each other: in each round every task passes over its documents with a copy of
their vectors, and the copies are averaged, as Spark's trainer does with those of all words. Then each task trains all its other words against these,
for as many rounds, and words that several tasks have are averaged by how often they occur there: they are comparable, for the frequent words they were
trained against stand still. So each pair of words in a window is learned from in each round. Windows weigh a pair by its distance, which is what a
window of random width does on average; negative words come from the counts to the power of 0.75; steps are those of AdaGrad, a rate for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.io import cut
from weftgraph.llm.common import kept

#: Words trained first, by all tasks: two vectors of each go to every executor.
MOST_FREQUENT = 16_384
#: Words of documents that a task trains, about; more take more tasks.
WORDS_A_TASK = 6_000_000
#: Positions that are learned from at a time, the centers that share a block of them, negative words drawn for them, and how many each counts as.
AT_ONCE, BLOCK, NOISE, NEGATIVES = 2_048, 16, 32, 5
RATE = 0.1
_ROWS = 1_024


def _first(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Where the vectors of words begin: drawn by their hash, the same in every task."""
    x = h.view(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)


class Trainer:
    """Vectors of words, as centers and as contexts, and the squares of their steps so far."""

    def __init__(self, at: np.ndarray, context: np.ndarray, noise: np.ndarray, window: int, seed: int, still: int = 0) -> None:
        """The first ``still`` words don't move, and no two of them are learned from; ``noise`` are the weights of words as negatives."""
        self.rows, self.window, self.still = (at, context), window, still
        self.squares = np.full((2, len(at)), 1e-8, np.float32)
        self.random = np.random.default_rng(seed)
        self.noise = np.cumsum(noise, dtype=float)
        away = np.abs(np.arange(BLOCK)[:, None] + window - np.arange(BLOCK + 2 * window)[None, :])
        self.weight = np.where((away > 0) & (away <= window), (window + 1 - away) / np.float32(window), 0).astype(np.float32)

    def learn(self, words: np.ndarray, docs: np.ndarray) -> None:
        """One pass over positions with their word, -1 for one that isn't trained, and their document."""
        with np.errstate(over="ignore"):
            for low in range(0, len(words), AT_ONCE):
                self._step(words[low : low + AT_ONCE], docs[low : low + AT_ONCE])

    def _step(self, words: np.ndarray, docs: np.ndarray) -> None:
        at, context = self.rows
        n, w, size = -(-len(words) // BLOCK), self.window, at.shape[1]
        wide = np.full(n * BLOCK + 2 * w, -1, np.int32)
        wide[w : w + len(words)] = words
        doc = np.full(len(wide), -1, np.int32)
        doc[w : w + len(words)] = docs
        known = wide >= 0
        # What is no word takes the last row's vector: its pairs weigh nothing.
        v = at.take(wide[w:-w], axis=0, mode="wrap").reshape(n, BLOCK, size)
        spots = np.arange(n)[:, None] * BLOCK + np.arange(BLOCK + 2 * w)[None, :]
        u = context.take(wide[spots], axis=0, mode="wrap")
        pair = self.weight * (doc[w:-w].reshape(n, BLOCK, 1) == doc[spots][:, None, :])
        pair *= known[w:-w].reshape(n, BLOCK, 1)
        pair *= known[spots][:, None, :]
        if self.still:
            moves = wide >= self.still
            pair *= moves[w:-w].reshape(n, BLOCK, 1) | moves[spots][:, None, :]
        g = v @ u.transpose(0, 2, 1)
        np.exp(g, out=g)
        g += 1
        np.divide(pair, g, out=g)
        dv = g @ u
        part = g.transpose(0, 2, 1) @ v
        # Parts of neighbouring blocks overlap by less than a block on either side.
        du = np.zeros((len(wide), size), np.float32)
        du[w:-w] = part[:, w:-w].reshape(-1, size)
        du[: n * BLOCK].reshape(n, BLOCK, size)[:, :w] += part[:, :w]
        du[2 * w :].reshape(n, BLOCK, size)[:, -w:] += part[:, -w:]
        drawn = np.searchsorted(self.noise, self.random.random(NOISE) * self.noise[-1], side="right").clip(0, len(at) - 1).astype(np.int32)
        un = context[drawn]
        # Small products: a large one would take all CPUs of the machine for itself.
        gn = v @ un.T
        np.negative(gn, out=gn)
        np.exp(gn, out=gn)
        gn += 1
        np.divide(pair.sum(2, keepdims=True) * np.float32(-NEGATIVES / NOISE), gn, out=gn)
        gn[wide[w:-w].reshape(n, BLOCK, 1) == drawn] = 0
        dv += gn @ un
        dn = (gn.transpose(0, 2, 1) @ v).sum(0)
        self._move(0, wide[w:-w], dv.reshape(-1, size))
        self._move(1, np.concatenate([wide, drawn]), np.concatenate([du, dn]))

    def _move(self, which: int, words: np.ndarray, by: np.ndarray) -> None:
        take = np.flatnonzero(words >= self.still)
        if not len(take):
            return
        take = take[np.argsort(words[take], kind="stable")]
        word = words[take]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        word, total = word[starts], np.add.reduceat(by[take], starts, axis=0)
        self.squares[which, word] += (total * total).mean(1)
        self.rows[which][word] += RATE / np.sqrt(self.squares[which, word])[:, None] * total


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a batch's documents and the number of each one's document in the batch."""
    lists = b.column(0)
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))


def _place(known: np.ndarray, order: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where words stand among ``known``, which is sorted and stood in ``order`` before; -1 for others."""
    if not len(known):
        return np.full(len(h), -1, np.int32)
    near = np.searchsorted(known, h).clip(0, len(known) - 1)
    return np.where(known[near] == h, order[near], -1).astype(np.int32)


def _around(words: np.ndarray, docs: np.ndarray, still: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions that a word from ``still`` on has in its window; each run of them is a document of its own."""
    moves = np.r_[0, np.cumsum(words >= still)]
    place = np.arange(len(words))
    near = moves[np.minimum(place + window + 1, len(words))] > moves[np.maximum(place - window, 0)]
    begins = near & np.r_[True, ~near[:-1] | (docs[1:] != docs[:-1])][: len(words)]
    return words[near], np.cumsum(begins, dtype=np.int32)[near]


def _round(frequent, shared, window: int, seed: int):
    """From documents to the moved vectors of the frequent words, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = frequent.value
        order = np.argsort(h)
        at, context = (x.copy() for x in shared.value)
        seen = np.zeros(len(h), np.int64)
        trainer = None
        for b in batches:
            words, docs = _cells(b)
            words = _place(h[order], order, words)
            if trainer is None:
                trainer = Trainer(at, context, n**0.75, window, seed)
            trainer.learn(words, docs)
            seen += np.bincount(words[words >= 0], minlength=len(h))
        if trainer is None:
            return
        for no, low in enumerate(range(0, len(h), _ROWS)):
            part = np.concatenate([at[low : low + _ROWS], context[low : low + _ROWS], seen[low : low + _ROWS, None]], 1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["no", "rows"])

    return run


def _mean(width: int):
    """Blocks of rows of all tasks to their means, weighted by how often a task has the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for no, rows in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(rows.as_buffer(), np.float32).reshape(-1, width).astype(float)
                part[:, :-1] *= part[:, -1:]
                total[no] = total.get(no, 0) + part
        means = [(x[:, :-1] / np.maximum(x[:, -1:], 1)).astype(np.float32).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(means, pa.binary())], ["no", "rows"])

    return run


def _others(frequent, shared, window: int, rounds: int, seed: int):
    """From documents to the vectors of their words that aren't frequent, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, _ = frequent.value
        at, context = shared.value
        texts = [_cells(b) for b in batches if b.num_rows]
        if not texts:
            return
        own, n = np.unique(np.concatenate([x for x, _ in texts]), return_counts=True)
        new = ~np.isin(own, h)
        every = np.concatenate([h, own[new]])
        order = np.argsort(every)
        texts = [_around(_place(every[order], order, x), docs, len(h), window) for x, docs in texts]
        counts = np.zeros(len(every))
        counts[_place(every[order], order, own)] = n
        at = np.concatenate([at, _first(own[new], at.shape[1], seed)])
        context = np.concatenate([context, np.zeros((int(new.sum()), at.shape[1]), np.float32)])
        trainer = Trainer(at, context, counts**0.75, window, seed + crc32(own.tobytes()), len(h))
        for _ in range(rounds):
            for words, docs in texts:
                trainer.learn(words, docs)
        for low in range(len(h), len(every), 10_000):
            rows = at[low : low + 10_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * at.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(every[low : low + 10_000]), pa.array(counts[low : low + 10_000].astype(np.int64)), lists], ["h", "n", "vec"])

    return run


def skip_gram(docs: DataFrame, size: int = 30, window: int = 5, rounds: int = 5, seed: int = 1) -> DataFrame:
    """``(token, vec)``: skip-gram vectors of every word of ``docs(words)``; null words and null documents are none. Words are told apart by 64-bit hash.

    The documents' hashes are kept in executor memory or on disk until ``spark.catalog.clearCache()``.
    """
    sc = docs.sparkSession.sparkContext
    words = docs.where("words is not null").select(F.array_compact("words").alias("words"))
    cells = kept(words.select(F.transform("words", lambda w: F.xxhash64(w)).alias("cells")))
    names = cut(words.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", F.xxhash64("token").alias("h"), "n"))
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    tasks = max(sc.defaultParallelism, -(-total // WORDS_A_TASK))
    top = names.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    frequent = sc.broadcast((h, n))
    at, context = _first(h, size, seed), np.zeros((len(h), size), np.float32)
    for k in range(rounds if len(h) else 0):
        shared = sc.broadcast((at, context))
        moved = cells.coalesce(tasks).mapInArrow(_round(frequent, shared, window, seed + k), "no int, rows binary")
        blocks = moved.repartition(sc.defaultParallelism, "no").mapInArrow(_mean(2 * size + 1), "no int, rows binary").toArrow()
        both = np.concatenate([np.frombuffer(x.as_buffer(), np.float32).reshape(-1, 2 * size) for x in blocks.sort_by("no").column("rows").combine_chunks()])
        at, context = both[:, :size].copy(), both[:, size:].copy()
        shared.destroy()
    shared = sc.broadcast((at, context))
    found = cells.coalesce(tasks).mapInArrow(_others(frequent, shared, window, rounds, seed), "h long, n long, vec array<float>")
    rows = found.select("h", F.lit(None).cast("string").alias("token"), "n", "vec").unionByName(names.select("h", "token", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<float>").alias("vec")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    rows = rows.repartition(parts, "h").sortWithinPartitions("h", F.asc_nulls_first("token"))
    return rows.mapInArrow(_named(frequent, shared, size), "token string, vec array<float>")


def _named(frequent, shared, size: int):
    """From the vectors of each task and the words behind them, in order of hash, to words with the mean of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, _ = frequent.value
        order = np.argsort(h)
        last, total = None, (np.zeros(size), 0)
        for b in batches:
            own, n, named = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            lists = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
            sums = np.zeros((b.num_rows + 1, size))
            sums[1:][~named] = lists * n[~named, None]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if b.num_rows else np.zeros(0, np.int64)
            if not len(starts):
                continue
            sums, count = np.add.reduceat(sums[1:], starts, axis=0), np.add.reduceat(n, starts)
            if own[0] == last:
                sums[0] += total[0]
                count[0] += total[1]
            last, total = own[-1], (sums[-1], count[-1])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, b.num_rows]))[named]
            place = _place(h[order], order, own[named])
            vec = np.where((place >= 0)[:, None], shared.value[0][place] if len(h) else 0.0, sums[group] / np.maximum(count[group], 1)[:, None])
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * size), pa.array(vec.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(named)), column], ["token", "vec"])

    return run
