"""Problem 2: splitting oversized codes at natural boundaries.

The boundaries are those of TESTDATA.md: statement ends, else blanks, else the limit, with an overlap that starts behind a blank. They follow from
the text alone, so that valleys of lexical cohesion have no say in them; see the README.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import records

LIMIT, OVERLAP = 1000, 100

_TOKEN = re.compile(r'"(?:[^"\\]+|\\.)*"?|\'(?:[^\'\\]+|\\.)*\'?|/\*.*?(?:\*/|\Z)|//[^\n]*|[(){};]', re.DOTALL)
_BLANK = re.compile(r"[ \t\r\n]")


def statement_ends(code: str) -> list[int]:
    """Positions directly behind ``;``, ``{`` and ``}`` outside literals, comments and round brackets; what is not closed runs to the end."""
    ends, depth = [], 0
    for m in _TOKEN.finditer(code):
        t = m.group()
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif depth == 0 and t in ("{", "}", ";"):
            ends.append(m.end())
    return ends


def pieces(code: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece of a text, in code points; a text within the limit is one piece, an empty one none."""
    if not code:
        return []
    if len(code) <= limit:
        return [(0, len(code))]
    ends, blanks = statement_ends(code), [m.end() for m in _BLANK.finditer(code)]
    out, s = [], 0
    while len(code) - s > limit:
        for places in (ends, blanks):
            k = bisect_right(places, s + limit)
            if k and places[k - 1] > s + overlap:
                e = places[k - 1]
                break
        else:
            e = s + limit
        out.append((s, e))
        k = bisect_left(blanks, e - overlap)
        s = blanks[k] if k < len(blanks) and blanks[k] < e else e - overlap
    out.append((s, len(code)))
    return out


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node_id", "piece_no", "start_at", "end_at", "text"]
        for b in batches:
            rows = [(i, no, s, e, c[s:e]) for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for no, (s, e) in enumerate(pieces(c, limit, overlap), 1)]
            cols = zip(*rows) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def oversized_pieces(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(node_id, piece_no, start_at, end_at, text)``: the pieces of each record whose code has more than ``limit`` characters.

    Null, empty and short codes have no pieces; repeated deliveries count once; pieces are no longer than ``limit``, cover the code, and depend on
    the code alone, however long it is. Only oversized codes are moved.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    long = records(nodes.where(F.length("code") > limit).select("id", "loaded_at", "code"))
    return long.mapInArrow(_cut(limit, overlap), "node_id long, piece_no int, start_at long, end_at long, text string")
