"""What the similarity join sends to the count: few false candidates of large sets."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from weftgraph.llm import setjoin


def test_large_sets_that_differ_are_no_candidates():
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**62), 2**62, 3000)
    sets = [np.unique(np.r_[base[:3], rng.choice(base, n, replace=False)]) for n in rng.integers(15, 900, 150)]
    sets += [np.unique(np.r_[s[rng.random(len(s)) < keep], rng.integers(-(2**62), 2**62, len(s) // 12)]) for s in sets for keep in (0.95, 0.75)]
    flat = np.concatenate(sets)
    width = 1 << 12
    counts = SimpleNamespace(value=np.bincount(flat & (width - 1), minlength=width).astype(np.uint32))
    at = np.r_[0, np.cumsum([len(s) for s in sets])]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)), pa.array(np.full(len(sets), 3, np.int8))], ["sid", "h", "side"])
    entries = pa.Table.from_batches(setjoin._entries(counts, 3, 5)(iter([batch]))).sort_by([("key", "ascending"), ("block", "ascending"), ("n", "ascending")])
    out = pa.Table.from_batches(setjoin._multiply(3, 5, True)(iter(entries.combine_chunks().to_batches(5000)))).to_pydict()
    found = {tuple(sorted(p)) for p in zip(out["a"], out["b"])}
    overlap = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    true = {(i, j) for i, j in every if overlap(i, j) * 8 >= 3 * (len(sets[i]) + len(sets[j]))}
    assert len(true) > 150 and true <= found
    assert len(found - true) < len(every) // 40
