"""Each operator against brute force, with nulls, empty and very long texts, ties, repeated rows and empty tables."""

import random
import re
from datetime import datetime
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import common, p1_near, p2_cohesion, p2_pieces, p3_leaks, p4_terms, p5_layout, p6_kin, p7_ids, p8_eval, p9_subjects, setjoin


def word_set(code):
    return {w.lower() for w in re.findall(r"[A-Za-z0-9_]+", code or "")}


def similar(a, b):
    return 5 * len(a & b) >= 3 * len(a | b)


def mixed_rows(seed=5, n=160):
    """Families of codes with edits, on top of words that all share, and awkward rows."""
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(n // 8):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(18, 60))] + ["if", "return", "int"]
        for _ in range(8):
            k += 1
            own = [w for w in base if rng.random() > 0.12] + [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(6))]
            rng.shuffle(own)
            rows.append((k, rng.choice([" ", " ; ", "\t"]).join(own), rng.choice(["T-1", "t1", "002", "2", "v3", "e4", None])))
    rows += [(1001, None), (1002, ""), (1003, "   "), (1004, "ſ K İ é 中文"), (1005, "x"), (None, rows[0][1])]
    rows += [(1006, rows[0][1]), (1007, rows[0][1].upper()), (1008, " ".join(f"long{i}" for i in range(30_000)))]
    return rows + rows[:20]


def test_pairs_are_those_of_brute_force(nodes):
    rows = mixed_rows()
    long = {r[0]: word_set(r[1]) for r in rows if r[0] is not None and len(word_set(r[1])) >= 20}
    want = {(a, b) for a, b in combinations(sorted(long), 2) if similar(long[a], long[b])}
    got = [tuple(r) for r in p1_near.similar_pairs(nodes(rows)).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_pairs_do_not_depend_on_blocks(nodes, monkeypatch):
    rows = mixed_rows(6, 80)
    want = {tuple(r) for r in p1_near.similar_pairs(nodes(rows)).collect()}
    monkeypatch.setattr(setjoin, "PAIRS_AT_ONCE", 7)
    table = nodes(rows)
    source, members, sets = setjoin.long_sets(table, 20)
    got_sets = {tuple(r)[:2] for r in setjoin.similar_sets(source, sets, 3, 5).collect()}
    held = {r.id: r.sid for r in members.collect()}
    expanded = {(a, b) for a, b in combinations(sorted(held), 2) if held[a] == held[b] or (held[a], held[b]) in got_sets or (held[b], held[a]) in got_sets}
    assert expanded == want


class Shared:
    """What a broadcast variable holds, without a cluster."""

    def __init__(self, value):
        self.value = value


def multiplied(sets, height, bits=10):
    """The pairs that the blocks of some sets give, every column being as high as told."""
    import numpy as np
    import pyarrow as pa

    keys = np.unique(np.concatenate([np.array(s, np.int64) for s in sets.values()]))
    hot = Shared((keys, np.full(len(keys), height)))
    given = [pa.array(list(sets)), pa.array([sorted(s) for s in sets.values()], pa.list_(pa.int64())), pa.array([3] * len(sets), pa.int8())]
    made = setjoin._entries(Shared(np.full(1 << bits, 2, np.uint32)), 3, 5, hot)([pa.RecordBatch.from_arrays(given, ["sid", "h", "side"])])
    entries = pa.Table.from_batches(list(made)).sort_by([("key", "ascending"), ("block", "ascending"), ("n", "ascending")]).combine_chunks()
    found = {frozenset(p.values()) for b in setjoin._multiply(3, 5, True)(iter(entries.to_batches())) for p in b.to_pylist()}
    return found, len(set(entries.column("block").to_pylist())), entries.num_rows


def test_a_hot_column_is_cut_into_blocks():
    rng = random.Random(1)
    common = [rng.randrange(-(2**62), 2**62) for _ in range(22)]
    sets = {i: common + [rng.randrange(-(2**62), 2**62) for _ in range(2)] for i in range(60)}
    found, blocks, _ = multiplied(sets, 3 * setjoin.BLOCK_ROWS)
    assert blocks > 4 and found == {frozenset(p) for p in combinations(range(60), 2)}


@pytest.mark.parametrize("height", [3, 4_000_000, 4_194_303, 4_194_304, 5_000_000, 40_000_000])
def test_pairs_of_columns_of_any_height(height):
    rng = random.Random(3)
    sets = {1024 * i + 7: rng.sample(range(1 << 40, 1 << 62, (1 << 62) // 10), 8) for i in range(1, 13)}  # all in one block of 1024
    want = {frozenset((x, y)) for x, y in combinations(sets, 2) if 5 * len({*sets[x]} & {*sets[y]}) >= 3 * len({*sets[x]} | {*sets[y]})}
    assert want and want <= multiplied(sets, height)[0]


@pytest.mark.parametrize("most_hot", [1_000_000, 0])
def test_columns_are_cut_by_their_exact_heights(nodes, monkeypatch, most_hot):
    rows = mixed_rows(7, 120)
    want = {tuple(r) for r in p1_near.similar_pairs(nodes(rows)).collect()}
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 3)
    monkeypatch.setattr(setjoin, "MOST_HOT", most_hot)
    monkeypatch.setattr(setjoin, "SKETCH_BITS", 6)  # every counter is full
    assert {tuple(r) for r in p1_near.similar_pairs(nodes(rows)).collect()} == want


def test_sketch_counts_all_entries(spark):
    rows = [([1, 2, 1 << 22, -1],), ([1, -1, 3 << 30],), ([],)]
    counts = setjoin.sketch(spark.createDataFrame(rows, "h array<long>"))
    assert len(counts) == 1 << 22 and counts.sum() == 7 and counts[1] == 2 and counts[0] == 2 and counts[(1 << 22) - 1] == 2


def test_members_of_a_large_set_stand_in_parts(nodes, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(25))) for i in range(40)] + [(100 + i, " ".join(f"w{j}" for j in range(1, 27))) for i in range(9)]
    monkeypatch.setattr(p1_near, "PART_ROWS", 4)
    got = [tuple(r) for r in p1_near.similar_pairs(nodes(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(sorted(r[0] for r in rows), 2))


def test_classes_have_one_row_for_each_record(nodes):
    rows = mixed_rows()
    got = {r.id: r for r in p1_near.similar_classes(nodes(rows)).collect()}
    long = {r[0] for r in rows if r[0] is not None and len(word_set(r[1])) >= 20}
    assert set(got) == long and got[1007].class_id == got[1].class_id == 1 and got[1].n_copies == 3


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(None, "a b c")]])
def test_tables_without_long_records_give_no_rows(nodes, rows):
    assert p1_near.similar_pairs(nodes(rows)).count() == 0
    assert p2_pieces.oversized_pieces(nodes(rows)).count() == 0
    assert p5_layout.copies(nodes(rows)).count() == 0
    assert p5_layout.copy_counts(nodes(rows)).count() == 0


# ---- pieces


def slow_pieces(code, limit=1000, overlap=100):
    ends, depth, i = set(), 0, 0
    while i < len(code):
        c = code[i]
        if c in "\"'":
            j = i + 1
            while j < len(code) and code[j] != c:
                j += 2 if code[j] == "\\" else 1
            i = j + 1
            continue
        if code.startswith("/*", i):
            j = code.find("*/", i + 2)
            i = len(code) if j < 0 else j + 2
            continue
        if code.startswith("//", i):
            j = code.find("\n", i)
            i = len(code) if j < 0 else j
            continue
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        if c in ";{}" and not depth:
            ends.add(i + 1)
        i += 1
    out, s = [], 0
    while len(code) - s > limit:
        range_ = range(s + limit, s + overlap, -1)
        blank = lambda p: code[p - 1] in " \t\r\n"
        e = next((p for p in range_ if p in ends), None) or next((p for p in range_ if blank(p)), None) or s + limit
        out.append((s, e))
        s = next((p for p in range(e - overlap, e) if blank(p)), e - overlap)
    return [*out, (s, len(code))] if code else []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t;{}()\"'\\/*abc中👩", max_size=400), st.integers(5, 40))
def test_pieces_are_those_of_the_rule(code, limit):
    assert p2_pieces.pieces(code, limit, limit // 4) == slow_pieces(code, limit, limit // 4)


def test_pieces_of_records(nodes):
    long = ("x = f ( a ; b ) ; " * 90) + '"' + "y" * 3000
    got = p2_pieces.oversized_pieces(nodes([(1, long), (1, long), (2, "a" * 1000), (3, "a" * 2001), (4, "é" * 1001), (5, None)])).collect()
    assert {r.node_id for r in got} == {1, 3, 4}
    for k, code in ((1, long), (3, "a" * 2001), (4, "é" * 1001)):
        mine = sorted((r.piece_no, r.start_at, r.end_at, r.text) for r in got if r.node_id == k)
        assert [(s, e) for _, s, e, _ in mine] == slow_pieces(code) and [no for no, *_ in mine] == [*range(1, len(mine) + 1)]
        assert all(t == code[s:e] and len(t) <= 1000 for _, s, e, t in mine)


# ---- pieces by cohesion


def slow_cohesion(w, b):
    rows = [np.bincount(w[max(0, i - b) : i], minlength=max(w) + 1) for i in range(1, len(w))], [np.bincount(w[i : i + b], minlength=max(w) + 1) for i in range(1, len(w))]
    return [x @ y / np.sqrt((x @ x) * (y @ y)) for x, y in zip(*rows)]


def slow_depths(s):
    out = []
    for i in range(len(s)):
        low = high = i
        while low and s[low - 1] >= s[low]:
            low -= 1
        while high + 1 < len(s) and s[high + 1] >= s[high]:
            high += 1
        out.append(s[low] + s[high] - 2 * s[i])
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=40), st.integers(1, 9), st.lists(st.integers(0, 4), max_size=15))
def test_cohesion_and_valleys_are_those_of_the_definition(words, block, score):
    assert np.allclose(p2_cohesion.cohesion(np.array(words), block), slow_cohesion(words, block))
    assert np.allclose(p2_cohesion.depths(np.array(score, float)), slow_depths(score))


def test_pieces_end_where_the_subject_changes(nodes):
    rng = random.Random(7)
    topics = [" ".join(rng.choice([f"{t}{i}" for i in range(12)]) for _ in range(120)) for t in ("cat", "dog", "owl", "elk", "fox")]
    ends, at = [], 0
    for t in topics[:-1]:
        at += len(t)
        ends.append(at)
        at += 1
    text = " ".join(topics)
    got = p2_cohesion.pieces(text)
    assert sum(any(abs(e - x) <= 40 for x in ends) for _, e, _ in got[:-1]) >= 3
    rows = [(1, text), (1, text), (2, "a" * 2001), (3, "short"), (4, None), (5, ""), (6, "; " * 800)]
    found = p2_cohesion.cohesive_pieces(nodes(rows)).collect()
    assert {r.node_id for r in found} == {1, 2, 6}
    for k in (1, 2, 6):
        mine = sorted((r.piece_no, r.start_at, r.end_at) for r in found if r.node_id == k)
        assert mine[0][1] == 0 and mine[-1][2] == len(dict(rows)[k]) and all(0 < e - s <= 1000 for _, s, e in mine)
        assert all(0 < e - s <= 100 for (_, _, e), (_, s, _) in zip(mine, mine[1:]))


# ---- leaks


def slow_chain(x, y, least):
    """The best chain of runs of at least so many equal words, tried pair by pair."""
    runs = []
    for i in range(len(x)):
        for j in range(len(y)):
            if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                runs += [(i, j, n)] if n >= least else []
    best = []
    for a, b, n in sorted(runs):
        before = max((c - cut for e, f, c in best if (cut := max(0, e - a, f - b)) < n), default=0)
        best.append((a + n, b + n, max(before, 0) + n))
    return max((c for *_, c in best), default=0)


def test_leaks_are_those_of_brute_force(spark, nodes):
    rows = mixed_rows()
    splits = spark.createDataFrame(
        [("t1", "Training ", datetime(2040, 1, 1)), ("T.1", "test", datetime(2039, 1, 1)), ("0002", " DEV", datetime(2040, 1, 1)), ("v3", "train", datetime(2040, 1, 1)), ("e4", "TEST", datetime(2040, 1, 1)), ("e4", "TEST", datetime(2040, 1, 1)), (None, "train", None), ("q", "other", None)],
        "test_id string, split string, assigned_at timestamp",
    )
    cases = spark.createDataFrame([("2", " SARD "), ("E4", None)], "test_id string, source string")
    key = lambda t: re.sub("^0+", "", re.sub("[^a-z0-9]", "", t.lower())) if t else None
    split = {"t1": "train", "2": "validation", "v3": "train", "e4": "test"}
    where = {r[0]: split.get(key(r[2] if len(r) > 2 else None)) for r in rows}
    long = {r[0]: word_set(r[1]) for r in rows if r[0] is not None and len(word_set(r[1])) >= 20}
    train = [w for i, w in long.items() if where[i] == "train"]
    want = {(where[i], "sard" if where[i] == "validation" else "unknown", i) for i, w in long.items() if where[i] in ("validation", "test") and any(similar(w, t) for t in train)}
    got = [tuple(r) for r in p3_leaks.leaked(nodes(rows), cases, splits).collect()]
    assert want and set(got) == want and len(got) == len(want)
    shown = p3_leaks.coverage(nodes(rows), cases, splits).collect()
    assert {r.node_id for r in shown} == {i for _, _, i in want} and all(0 <= r.n_covered <= r.n_words for r in shown)


def test_coverage_is_that_of_the_closest_record(spark, nodes):
    rng = random.Random(9)
    rows = []
    for k in range(0, 400, 10):
        base = [f"w{k}_{i}" for i in range(30)]
        for j in range(10):
            own = [w for w in base if rng.random() > 0.1] + [f"n{rng.randrange(9)}" for _ in range(rng.randrange(4))]
            cut = rng.randrange(len(own))
            rows.append((1000 - k - j, " ".join(own[cut:] + own[:cut]), "h1" if j % 3 else "t1"))
        rows += [(2000 + k, rows[-1][1], "t1"), (2001 + k, rows[-2][1], "h1"), (2002 + k, rows[-10][1], "h1")]
    splits = spark.createDataFrame([("t1", "train", datetime(2040, 1, 1)), ("h1", "test", datetime(2040, 1, 1))], "test_id string, split string, assigned_at timestamp")
    cases = spark.createDataFrame([("h1", "sard")], "test_id string, source string")
    seq = {i: code.split(" ") for i, code, _ in rows}
    sets = {i: word_set(code) for i, code, _ in rows}
    pairs = [(i, j) for i, _, c in rows for j, _, d in rows if c == "h1" and d == "t1" and similar(sets[i], sets[j])]
    codes = {w: i for i, w in enumerate({w for ws in seq.values() for w in ws})}
    words_of = {i: np.array([codes[w] for w in ws]) for i, ws in seq.items()}
    fast = {(i, j): p3_leaks.chained(words_of[i], words_of[j]) for i, j in pairs[:300]}
    sure = p3_leaks.K + p3_leaks.WINDOW - 1
    assert all(slow_chain(seq[i], seq[j], sure) <= n <= slow_chain(seq[i], seq[j], p3_leaks.K) for (i, j), n in fast.items())
    hashed = spark.createDataFrame(sorted(seq.items()), "id long, w array<string>").selectExpr("id", "transform(w, x -> xxhash64(x)) AS h").collect()
    hashed = {r.id: np.array(r.h) for r in hashed}
    tried = [(i, -p3_leaks.chained(hashed[i], hashed[j]), j) for i, j in pairs]
    want = {i: min((n, j) for k, n, j in tried if k == i) for i, _, _ in tried}
    got = {r.node_id: (-r.n_covered, r.train_id) for r in p3_leaks.coverage(nodes(rows), cases, splits).collect()}
    assert len(want) > 100 and got == want


def test_chains_follow_both_texts():
    def chained(x, y):
        codes = {w: i * 7919 for i, w in enumerate(dict.fromkeys(x + y))}
        return p3_leaks.chained(*(np.array([codes[w] for w in t], np.int64) for t in (x, y)))

    a = "the quick brown fox jumps over the lazy dog and runs far away".split()
    assert chained(a, a) == len(a)
    assert chained(a, a[:6] + ["x", "y"] + a[6:]) == len(a)
    assert chained(a, [w + "s" for w in a]) == 0 and chained([], a) == 0
    assert chained(a * 300, a * 300) == 300 * len(a)


# ---- terms


@pytest.mark.parametrize("sigma", [1, 3])
def test_counts_of_all_ngrams(spark, sigma):
    rng = random.Random(3)
    docs = [[rng.choice("abc") + rng.choice(["", "0", "_"]) for _ in range(rng.randrange(12))] for _ in range(60)] + [[], [""], None, ["if"] * 50]
    n, recs = {}, {}
    for k, d in enumerate(docs):
        w = [x for x in d or [] if x]
        for size in range(1, sigma + 1):
            for i in range(len(w) - size + 1):
                g = " ".join(w[i : i + size])
                n[g] = n.get(g, 0) + 1
                recs.setdefault(g, set()).add(k)
    got = p4_terms.ngram_counts(spark.createDataFrame([(d,) for d in docs], "w array<string>"), sigma).collect()
    assert {r.gram: (r.n, r.n_records) for r in got} == {g: (n[g], len(recs[g])) for g in n} and len(got) == len(n)


def test_marks(nodes):
    rows = [(i, "every Every") for i in range(1, 101)] + [(1, "every"), (101, "twice 2nd"), (102, "twice"), (103, ""), (104, None)] + [(200 + i, "Some") for i in range(3)]
    got = {r.term: r.mark for r in p4_terms.marked_terms(nodes(rows)).collect()}
    assert got == {"every": "common", "twice": "rare", "some": "common"}
    assert p4_terms.marked_terms(nodes([])).count() == 0


# ---- layout


def test_copies_by_layout(nodes):
    body = " , ".join(f". f{i} = v{i}" for i in range(12))
    turned = ",".join(f".F{i}=v{i}" for i in reversed(range(12)))
    call = " , ".join(f"a{i}" for i in range(20))
    back = " , ".join(f"a{i}" for i in reversed(range(20)))
    rows = [(9, f"struct s x = {{ {body} }} ;"), (4, f"STRUCT s x={{{turned},}};"), (7, f"struct s x = {{ {body} }} ;"), (7, f"struct s x = {{ {body} }} ;"), (1, f"f ( {call} )"), (2, f"f ( {back} )"), (3, f"f({call})"), (5, None), (6, "")]
    got = sorted(tuple(r) for r in p5_layout.copies(nodes(rows)).collect())
    assert got == [(1, 3), (4, 7), (4, 9)]
    assert sorted(tuple(r) for r in p5_layout.copy_counts(nodes(rows)).collect()) == [(1, 2), (2, 1), (4, 3)]


def test_a_hot_key_takes_the_same_result(spark, monkeypatch):
    rows = [(i, "hot") for i in range(3000)] + [(i, f"k{i // 2}") for i in range(3000, 6000)] + [(9999, None)]
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    got = {r.id: (r.keep_id, r.n_copies) for r in p5_layout.collapse(spark.createDataFrame(rows, "id long, key string")).collect()}
    want = {i: (0, 3000) for i in range(3000)} | {i: (i // 2 * 2, 2) for i in range(3000, 6000)}
    assert got == want


# ---- kin

CASES = "test_id string, source string, author string, project string, advisory string"


def test_groups_and_splits(spark):
    rng = random.Random(4)
    rows = [(f"c{i:04}", rng.choice(["sard", "NVD ", None]), f"{rng.choice(['Ann', 'ANN.', 'bo', 'unknown', None, 'TBD'])}-{i // 3}" if i % 4 else rng.choice(["n/a", None, "-", "x-1 ; y-2" if i < 8 else "z"]), f"lib-{i}" if i % 7 else "Lib 0", None) for i in range(400)]
    cases = spark.createDataFrame(rows, CASES)
    bare = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for t, _, author, project, advisory in rows:
        for v in [("a", bare(x)) for x in (author or "").split(";")] + [("p", bare(project or "")), ("v", bare(advisory or ""))]:
            if v[1] not in p6_kin.STAND_INS:
                a, b = top(t), top(first.setdefault(v, t))
                up[max(a, b)] = min(a, b)
    sizes = {}
    for t in up:
        sizes[top(t)] = sizes.get(top(t), 0) + 1
    want = {(t, top(t)) for t in up if sizes[top(t)] > 1}
    assert {tuple(r) for r in p6_kin.kin_groups(cases).collect()} == want
    assert {tuple(r) for r in p6_kin.kept_together(cases).collect()} == want
    rows_of_splits = p6_kin.kin_splits(cases.unionByName(cases.limit(50))).collect()
    split = {r.test_id: r.split for r in rows_of_splits}
    assert len(rows_of_splits) == len(rows)
    assert set(split) == set(up) and all(split[t] == split[top(t)] for t in up)
    biggest = max(sizes.values())
    for name, share in p6_kin.SPLITS:
        assert abs(sum(s == name for s in split.values()) - 4 * share) <= biggest


@pytest.mark.parametrize("n_labels", [1, 40, 3000])
def test_allocations_meet_quotas(n_labels):
    rng = random.Random(n_labels)
    sizes = [[rng.choice([1, 1, 1, 2, 3, 8, 50]) for _ in range(rng.randrange(1, 60))] for _ in range(n_labels)] + [[1] * 4000]
    count = {}
    for own in sizes:
        for s in own:
            count[s, sum(own)] = count.get((s, sum(own)), 0) + 1
    plan = p6_kin.allocate([(s, p, n) for (s, p), n in count.items()])
    assert all(sum(plan[k].values()) == n and min(plan[k].values()) >= 0 for k, n in count.items()) and set(plan) == set(count)
    total = sum(map(sum, sizes))
    for name, share in p6_kin.SPLITS:
        assert abs(sum(k[0] * got[name] for k, got in plan.items()) - total * share / 100) <= 100
        alone = sum(k[0] * got[name] for k, got in plan.items() if k[1] == 4000)
        assert list(map(sum, sizes)).count(4000) > 1 or abs(alone - 40 * share) <= 100


def test_a_flow_costs_no_more_than_any_other():
    shares = (("train", 80), ("validation", 10), ("test", 10))
    for profiles in ({1: 7}, {3: 9, 5: 5}, {1: 2, 2: 4, 7: 7}):
        total = sum(profiles.values())
        quota = lambda n, w: -(-n * w // 100)

        def cost(flow):
            over = sum(10 * max(0, sum(f[x] for f in flow.values()) - quota(total, w)) for x, w in shares)
            return over + sum(max(0, f[x] - quota(n, w) * (profiles[n] // n)) for n, f in flow.items() for x, w in shares)

        ways = [[{"train": a, "validation": b, "test": c - a - b} for a in range(c + 1) for b in range(c + 1 - a)] for c in profiles.values()]
        least = min(cost(dict(zip(profiles, way))) for way in product(*ways))
        got = p6_kin._flow(profiles, shares)
        assert cost(got) == least and all(sum(f.values()) == profiles[n] for n, f in got.items())


def test_kin_of_nothing(spark):
    empty = spark.createDataFrame([], CASES)
    assert p6_kin.kin_groups(empty).count() == 0 and p6_kin.kin_splits(empty).count() == 0


def test_a_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(f"n{i:05}", f"n{i + 1:05}") for i in range(500)], "u string, v string")
    got = p6_kin.components(edges).collect()
    assert len(got) == 500 and {r.root for r in got} == {"n00000"}


# ---- ids


def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(p7_ids.default_path())
    tok.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = [chr(c) for c in (9, 10, 13, 28, 32, 0x85, 0xA0, 0x2028, 0x3000, 0xFEFF)] + list("aAé中١²'’s!<|") + ["<|endoftext|>", "👩‍💻", "'ll"]
    long_words = ["".join(rng.choices("abcdefghij", k=120)) for _ in range(600)]
    texts = [" ".join(long_words), "", None, " ", "I'LL say: we'll", "a" * 3000, " " * 2000, "ab" * 700, "<|endoftext|>"] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)]
    got = {r.doc_id: r.ids for r in p7_ids.token_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert p7_ids.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- evaluation texts


def test_leaked_items_are_those_of_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(60)}" for _ in range(rng.randrange(8, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "too few words here")]
    docs = []
    for k in range(120):
        w = [f"d{rng.randrange(60)}" for _ in range(rng.randrange(30))]
        if k % 2:
            src = (items[rng.randrange(20)][1]).split()
            a = rng.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randrange(5, 30)]
        docs.append((k, rng.choice([" ", ", ", "\n> "]).join(w).title()))
    docs += [(900, None), (901, ""), (902, items[0][1] + " " + items[0][1])]
    runs = lambda t: {tuple(x[i : i + 12]) for x in [re.findall("[a-z0-9_]+", (t or "").lower())] for i in range(len(x) - 11)}
    want = {(d, i) for d, t in docs for i, q in items if runs(t) & runs(q)}
    found = p8_eval.leaked_items(spark.createDataFrame(docs + docs[:60], "doc_id long, text string"), spark.createDataFrame(items + items[:5], "item_id long, text string")).collect()
    assert len(want) > 10 and {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) and min(r.n_words for r in found) >= 12
    assert p8_eval.leaked_items(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---- subjects


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(9)
    terms = {"law": ["patent grant", "legal entity", "copyright notice"], "media": ["luma sample", "keyframe", "pixel stride"], "disk": ["hard link", "inode table", "superblock"]}
    spell = [str, str.upper, str.title, lambda x: x.replace(" ", "_"), lambda x: x.replace(" ", "-"), lambda x: x + "s", lambda x: x.title().replace(" ", "")]
    frames = ["The {} is not checked before use.", "We saw the {} grow without limit!", "Could the {} be shared instead?"]
    plain = ["No change in behaviour is intended.", "This was reported before.", "I can reproduce this on two machines."]
    docs, labels, want = [], [], set()
    for k in range(240):
        mine = rng.sample(sorted(terms), 1 + (k % 5 == 0))
        own = [rng.choice(frames).format(rng.choice(spell)(rng.choice(terms[s]))) for s in mine for _ in range(4)]
        own += [rng.choice(plain) for _ in range(3)]
        rng.shuffle(own)
        docs.append((k, rng.choice([" ", "\n"]).join(own)))
        want |= {(k, s) for s in mine}
        if k < 160:
            labels += [(k, s) for s in mine]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "Too short"), (904, plain[0] + " " + plain[1])]
    documents = spark.createDataFrame(docs + docs[200:220], "doc_id long, text string")
    given_labels = spark.createDataFrame(labels + [(5, "no such subject"), (7777, "law")], "doc_id long, subject string")
    subjects = spark.createDataFrame([(s, "") for s in terms], "subject string, description string")
    rows_found = [tuple(r) for r in p9_subjects.subjects_of(documents, given_labels, subjects).collect()]
    got = set(rows_found)
    assert len(rows_found) == len(got)
    held = {x for x in got if x[0] >= 160}
    truth = {x for x in want if x[0] >= 160}
    assert len(held & truth) >= 0.95 * len(truth) and len(held & truth) >= 0.95 * len(held)
    assert not {d for d, _ in got} & {900, 901, 902, 903, 904}
    none = given_labels.where("doc_id < 0")
    assert p9_subjects.subjects_of(documents, none, subjects).count() == 0


def test_rules_of_weak_terms_and_calibration():
    share = {("a", "x"): 0.4, ("b", "x"): 0.4, ("c", "x"): 0.95, ("ab", "x"): 0.96, ("ac", "x"): 0.99, ("abc", "y"): 0.9, ("abc", "x"): 1.0}
    rules = p9_subjects._rules({(frozenset(k), s): v for (k, s), v in share.items()}, frozenset("abc"))
    found = {("".join(sorted(t)), s) for rows in rules.by_term.values() for t, s, _ in rows}
    assert found == {("ab", "x"), ("c", "x"), ("abc", "y")}  # two weak terms, one sure one, three for another subject
    assert set(rules.evidence(["a", "b", "c"])) == {"x", "y"} and not rules.evidence(["a"]) and not rules.evidence([])
    counts = {"a": {"": 100, "x": 40}, "b": {"": 90, "x": 80}, "a b": {"": 90, "x": 80}, "c": {"": 90, "x": 81}, "d": {"": 50, "x": 8}}
    assert list(p9_subjects._items(counts, {"x": 100}, 1000, {"a": 1, "b": 2, "a b": 2, "c": 2, "d": 3})) == ["a", "b"]
    likely = p9_subjects.calibrated({13: (1000, 200), 14: (1000, 100), 19: (1000, 990)})
    assert len(likely) == p9_subjects.STEPS and list(likely) == sorted(likely) and likely[14] < 0.2 and likely[19] > 0.98
    assert p9_subjects.grams("a b x c".split(), {"a", "b", "c"}) == {"a", "b", "a b", "c"}


def test_sentences():
    text = 'ADVISORY X-1 / low\r\n\r\nFirst one. Second "one." Third?\n* Fourth!\nfor ( i = 0 ; i < n ; i ++ ) { x [ i ] = 1 ; }\nint x = f(a) ? 1 : 2;\n错误 848：无法读取。 Last'
    assert [s.split()[0] for s in p9_subjects.sentences(text)] == ["First", "Second", "Third?", "*", "错误"]
