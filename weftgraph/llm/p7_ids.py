"""Problem 7: the corpus as token ids of a public byte-level BPE.

Method: in each partition the distinct pieces of text go to DuckDB as token-position rows. A recursive query joins neighbours with the merge table,
contracts each piece's leftmost pair of least rank, and ends when no pair is left; an ordered aggregation gives the ids of each piece. Pieces of
more than ``LONGEST`` bytes, for which one contraction a round is too slow, take the same merges from a heap.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The tokenizer by default; any byte-level BPE file of this form may be given.
DEFAULT = "byte_bpe_50k.json"
#: Bytes of the longest piece that DuckDB contracts, rows that one recursive query may make (a piece of n bytes makes n * n / 2 at most), and pieces
#: that a partition remembers.
LONGEST, ROWS_AT_ONCE, REMEMBERED = 128, 2_000_000, 400_000

# Fixed value: how byte-level BPE cuts text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CONTRACT = f"""
WITH RECURSIVE state AS (
    SELECT word, pos, tok, 0 AS round FROM start
    UNION ALL
    SELECT word, pos, CASE WHEN pos = best % {LONGEST} THEN made ELSE tok END, round + 1
    FROM (
        SELECT s.*, m.made, min(m.rank * {LONGEST} + s.pos) OVER (PARTITION BY s.word) AS best
        FROM (
            SELECT *, lead(tok) OVER w AS after, lag(pos) OVER w AS prior FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
        ) s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.after
    )
    WHERE best IS NOT NULL AND (prior IS NULL OR prior <> best % {LONGEST})
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(round) AS round FROM state GROUP BY word) USING (word, round)
GROUP BY word ORDER BY word
"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be printed, else the next one from 256."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """The ids of pieces of text; holds a DuckDB connection, so one is made in each task."""

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in _byte_names()], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = ([vocab[x] for x in xs] for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.merges = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(zip(left, right, made))}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        table = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(range(len(left)), pa.int64()), "made": pa.array(made, pa.int32())})
        self.db.register("merges_given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_given")
        self.known: dict[str, np.ndarray] = {}

    def learn(self, pieces: list[str]) -> None:
        """Have the ids of all these pieces in ``known``."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        coded = [p.encode("utf-8", "surrogatepass") for p in new]
        short = [k for k, c in enumerate(coded) if len(c) <= LONGEST]
        for k, c in enumerate(coded):
            if len(c) > LONGEST:
                self.known[new[k]] = np.array(self._heap(c), dtype=np.int32)
        made = np.cumsum([len(coded[k]) * (len(coded[k]) + 1) // 2 for k in short])
        bounds = [0, *np.searchsorted(made, range(ROWS_AT_ONCE, int(made[-1]) if len(made) else 0, ROWS_AT_ONCE)), len(short)]
        for low, high in zip(bounds, bounds[1:]):
            part = short[low:high]
            if not part:
                continue
            size = np.array([len(coded[k]) for k in part])
            tok = self.byte_ids[np.frombuffer(b"".join(coded[k] for k in part), np.uint8)]
            word = np.repeat(np.arange(len(part), dtype=np.int32), size)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
            start = pa.table({"word": pa.array(word), "pos": pa.array(pos.astype(np.int32)), "tok": pa.array(tok)})
            self.db.register("start", start)
            ids = self.db.sql(_CONTRACT).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("start")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            for n, k in enumerate(part):
                self.known[new[k]] = flat[at[n] : at[n + 1]]

    def _heap(self, coded: bytes) -> list[int]:
        """Ids of one piece: the leftmost pair of least rank is merged, until none is left."""
        tok = [int(self.byte_ids[b]) for b in coded]
        after, prior = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(tok) and (m := self.merges.get((tok[i], tok[j]))):
                heapq.heappush(heap, (m[0], i, tok[i], tok[j]))

        for i in range(len(tok)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= len(tok) or tok[j] != b:
                continue
            tok[i], tok[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < len(tok):
                prior[after[j]] = i
            offer(i)
            if prior[i] >= 0:
                offer(prior[i])
        return [t for t in tok if t >= 0]


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PIECES)


def encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = Encoder(path), _splitter()
        for b in batches:
            texts = b.column(1).to_pylist()
            cut = [split.findall(t) if t else [] for t in texts]
            encoder.learn([p for c in cut for p in c])
            parts = [encoder.known[p] for c in cut for p in c]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut)])]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the ids of each document's text as stored, without special tokens; one row for each row of ``documents``.

    An empty or null text gives an empty list. Strings that look like special tokens are ordinary text. ``path`` names the tokenizer's file, which
    must lie at the same place on every executor.
    """
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(encode_batches(path or default_path()), "doc_id long, ids array<int>")
