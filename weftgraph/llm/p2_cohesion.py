"""Problem 2, the general form: splitting oversized texts where their subject changes.

Method: lexical cohesion. Two blocks of words slide over the text, one before and one behind each gap between words; how alike they are is their
cohesion, and a valley between two peaks of it marks a boundary, the deeper the surer. Within the window that the size limit leaves for the end of a
piece, the deepest valley is taken, and the next piece begins up to ``overlap`` characters before it. ``p2_pieces`` has the rule of TESTDATA.md, where
ends follow from statement ends and blanks alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import records
from weftgraph.llm.p2_pieces import LIMIT, OVERLAP

#: Words of a block, and how many parts of a hundred of the limit a piece must have at least, so that there is a window to choose in.
BLOCK, LEAST_PERCENT = 20, 50

_WORD = re.compile(r"[A-Za-z0-9_]+")


def cohesion(words: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each gap between words, given as numbers, the cosine of the word counts of the blocks before and behind it, which are shorter at both ends.

    Sliding by one word changes three counts, so that all gaps take one pass whatever the size of the blocks.
    """
    kinds = int(words.max(initial=-1)) + 1
    left, right = [0] * kinds, [0] * kinds
    w, n = words.tolist(), len(words)
    dot = a = b = 0

    def move(side: list[int], other: list[int], x: int, by: int) -> tuple[int, int]:
        """The changes of the product and of the own square."""
        change = by * other[x], 2 * by * side[x] + 1
        side[x] += by
        return change

    for x in w[:block]:
        _, s = move(right, left, x, 1)
        b += s
    out = np.zeros(max(n - 1, 0))
    for i in range(1, n):
        for side, other, x, by in ((right, left, w[i - 1], -1), (left, right, w[i - 1], 1), (right, left, w[i + block - 1] if i + block <= n else -1, 1), (left, right, w[i - block - 1] if i > block else -1, -1)):
            if x < 0:
                continue
            d, s = move(side, other, x, by)
            dot += d
            if side is left:
                a += s
            else:
                b += s
        out[i - 1] = dot / (a * b) ** 0.5 if a and b else 0.0
    return out


def smoothed(score: np.ndarray, reach: int) -> np.ndarray:
    """The mean of each value and those up to ``reach`` places away, so that no ripple cuts a climb short."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    at = np.arange(len(score))
    low, high = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(score))
    return (total[high] - total[low]) / (high - low)


def depths(score: np.ndarray) -> np.ndarray:
    """How deep the valley of each gap is: the climb to the nearest peak before it and to the nearest behind it, together."""
    both = np.zeros(len(score))
    for s, out in ((score, both), (score[::-1], both[::-1])):
        peak = last = 0.0
        for i, x in enumerate(s.tolist()):
            peak = peak if i and last >= x else x
            last = x
            out[i] += peak - x
    return both


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int, float]]:
    """Start, end and depth of the valley at the end of each piece; the last piece, and one that no gap ends, has depth 0.

    A piece ends behind a word, at the deepest valley of its window, of equals the last; where the window has no gap, as in a word without end, at the
    limit.
    """
    if not text:
        return []
    found = [(m.group().lower(), m.end()) for m in _WORD.finditer(text)] if len(text) > limit else []
    numbers: dict[str, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for w, _ in found], np.int64)
    ends = np.array([e for _, e in found][:-1], np.int64)
    depth = depths(smoothed(cohesion(words, block), block // 4))
    out, s = [], 0
    while len(text) - s > limit:
        low, high = np.searchsorted(ends, [s + max(overlap + 1, limit * LEAST_PERCENT // 100), s + limit + 1])
        if low < high:
            k = high - 1 - int(np.argmax(depth[low:high][::-1]))
            e, d = int(ends[k]), float(depth[k])
        else:
            e, d = s + limit, 0.0
        out.append((s, e, d))
        k = int(np.searchsorted(ends, e - overlap))
        s = int(ends[k]) if k < len(ends) and ends[k] < e else e - overlap
    out.append((s, len(text), 0.0))
    return out


def _cut(limit: int, overlap: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, no, s, e, d) for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for no, (s, e, d) in enumerate(pieces(c, limit, overlap, block), 1)]
            cols = zip(*rows) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["node_id", "piece_no", "start_at", "end_at", "depth"])

    return run


def cohesive_pieces(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """``(node_id, piece_no, start_at, end_at, depth)``: the pieces of each record whose code has more than ``limit`` characters, cut at the deepest
    valleys of lexical cohesion.

    Null, empty and short codes have no pieces; repeated deliveries count once; pieces are no longer than ``limit``, cover the code, overlap by up to
    ``overlap`` characters, and depend on the whole code alone. Only oversized codes are moved.
    """
    if not 0 <= overlap < limit * LEAST_PERCENT // 100:
        raise ValueError("overlap must be less than the least size of a piece")
    long = records(nodes.where(F.length("code") > limit).select("id", "loaded_at", "code"))
    return long.mapInArrow(_cut(limit, overlap, block), "node_id long, piece_no int, start_at long, end_at long, depth double")
