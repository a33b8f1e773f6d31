"""Problem 6: splits that keep related test cases together.

Groups are the connected components of test cases and what they share, found by alternating large-star and small-star rounds on the cluster. The
allocation is a min-cost flow: components of equal size and equal label profile are one bundle, bundles send their cases to the splits at the price
of deviating from the quotas, the flow is rounded to whole components, and within a bundle components take the splits in the order of their hash.

The profile of a component is the number of cases under its label. Labels with equal numbers have equal quotas, so that the flow treats them as one;
bundles of one profile meet in one node of the flow, for they send their cases at the same prices. Both leave the optimum as it is, and keep the flow
small: profiles and sizes each add up to no more than all cases, so that there are fewer of them than the root of twice that number.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.io import cut
from weftgraph.llm.common import HOT_ROWS, with_least

# Stand-ins that relate nothing.
STAND_INS = ["", "unknown", "none", "na", "anonymous", "tbd"]

SPLITS = (("train", 80), ("validation", 10), ("test", 10))
#: Hash ranges by which the components of a bundle are ranked, so that none of them is ranked in one task.
RANGES = 256


def shared_values(test_cases: DataFrame) -> DataFrame:
    """``(test_id, value)``: what relates each test case to others, the column's name in front of the value."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))
    names = F.transform(F.split("author", ";"), lambda x: F.concat(F.lit("author:"), bare(x)))
    one = lambda c: F.array(F.concat(F.lit(f"{c}:"), bare(F.col(c))))
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (names, one("project"), one("advisory"))])
    rows = test_cases.where("test_id is not null").select("test_id", F.explode(F.array_distinct(every)).alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.substring_index("value", ":", -1).isin(STAND_INS))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(v, root)``: each vertex of ``edges(u, v)`` that is not the smallest of its component, with that smallest.

    Loops and repeated edges don't count. The number of rounds grows with the logarithm of the number of vertices; should it reach
    ``most_rounds``, an error says so.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        end = lambda c, down: F.struct(F.col(c).alias("x"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
        ends = edges.select(F.inline(F.array(end("u", 1), end("v", 0)))).groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
        linked = (F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)
        more, most = ends.agg(F.max(linked), F.max(F.col("down") + F.col("up"))).first()
        if not more:  # each vertex is the root of a star or linked to one root alone
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = with_least if most > HOT_ROWS else _least_by_join  # in neither step a vertex has more edges than here
        large = least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")).where("u <> v").distinct()
        down = least(cut(large) if most > HOT_ROWS else large, "u", "v")
        small = down.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = cut(small.unionByName(down.select("u", F.col("least").alias("v"))).distinct())
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def _least_by_join(rows: DataFrame, key: str, value: str) -> DataFrame:
    """What ``with_least`` gives, where no key is hot."""
    return rows.join(rows.groupBy(key).agg(F.min(value).alias("least")), key)


def kin_groups(test_cases: DataFrame) -> DataFrame:
    """``(test_id, group_key)``: each test case that shares a value with another, directly or through others.

    Null, blank and stand-in values relate nothing. The cases of a value are linked to the smallest of them alone; a value that a third of all share,
    and a component as large, is split among tasks, see ``common.with_least``.
    """
    values = with_least(shared_values(test_cases), "value", "test_id")
    edges = values.select(F.col("test_id").alias("u"), F.col("least").alias("v"))
    found = components(edges)
    roots = found.select(F.col("root").alias("test_id")).distinct()
    return found.select(F.col("v").alias("test_id"), F.col("root").alias("group_key")).unionByName(roots.withColumn("group_key", F.col("test_id")))


@dataclass
class _Flow:
    """A min-cost flow by shortest augmenting paths, from one supply at a time."""

    arcs: list[list[int]] = field(default_factory=list)  # to, capacity left, cost; each is followed by its reverse
    out: dict[object, list[int]] = field(default_factory=dict)

    def arc(self, a: object, b: object, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def push(self, path: list[int], amount: int) -> None:
        for k in path:
            self.arcs[k][1] -= amount
            self.arcs[k ^ 1][1] += amount

    def send(self, source: object, sink: object, amount: int) -> None:
        """Send so much along paths of least cost; there must be room for it."""
        while amount:
            dist, via, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for k in self.out[x]:
                    y, left, cost = self.arcs[k]
                    if left and dist[x] + cost < dist.get(y, 1 << 60):
                        dist[y], via[y] = dist[x] + cost, k
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.arcs[via[x] ^ 1][0]
            part = min(amount, *(self.arcs[k][1] for k in path))
            self.push(path, part)
            amount -= part


def _flow(profiles: dict[int, int], shares) -> dict[int, dict[str, int]]:
    """How many cases of each profile go to each split: ``profiles`` has the cases of all labels with so many cases each.

    Quotas hold for all cases and for the cases of each label; a case beyond a label's quota costs 1, one beyond a split's quota 10.
    """
    total, whole = sum(profiles.values()), sum(w for _, w in shares)
    quota = lambda n, w: -(-n * w // whole)
    flow, used = _Flow(), {}
    for name, w in shares:
        free, beyond = flow.arc(name, "to", quota(total, w), 0), flow.arc(name, "to", total, 10)
        for n, cases in profiles.items():
            used[n, name] = [flow.arc(n, name, quota(n, w) * (cases // n), 0), flow.arc(n, name, cases, 1), free, beyond]
    rest = dict(profiles)
    for n, cases in profiles.items():  # what fits every quota whatever the others send costs nothing
        for name, w in shares:
            part = min(cases * w // whole, rest[n])
            flow.push([used[n, name][0], used[n, name][2]], part)
            rest[n] -= part
    for n in profiles:
        for name, _ in shares:  # nor does what still fits
            within, _, free, _ = used[n, name]
            part = min(rest[n], flow.arcs[within][1], flow.arcs[free][1])
            flow.push([within, free], part)
            rest[n] -= part
        flow.send(n, "to", rest[n])
    return {n: {name: sum(flow.arcs[k ^ 1][1] for k in used[n, name][:2]) for name, _ in shares} for n in profiles}


def allocate(bundles: list[tuple[int, int, int]], shares=SPLITS) -> dict[tuple[int, int], dict[str, int]]:
    """How many components of each bundle ``(size, profile, count)`` go to each split.

    Each profile's cases flow to the splits at least cost; its bundles, large components first, take up what flows in proportion, as many whole
    components as fit, and the few that fit nowhere go where most is left. What rounding leaves over is carried on to the next profile.
    """
    profiles: dict[int, int] = {}
    for s, profile, n in bundles:
        profiles[profile] = profiles.get(profile, 0) + s * n
    flows = _flow(profiles, shares)
    names, carry = [name for name, _ in shares], dict.fromkeys((name for name, _ in shares), 0)
    out, last = {}, None
    for s, profile, n in sorted(bundles, key=lambda x: (-x[1], -x[0])):
        if profile != last:
            need, last = {name: flows[profile][name] + carry[name] for name in names}, profile
            carry = need
        wanted = sum(max(need[x], 0) for x in names) or 1
        got = {x: min(max(need[x], 0) // s, n * max(need[x], 0) // wanted) for x in names}
        left = n - sum(got.values())
        for x in names:
            need[x] -= got[x] * s
        for x in sorted(names, key=lambda x: -need[x]):  # whole components that still fit
            more = min(max(need[x], 0) // s, left)
            got[x], need[x], left = got[x] + more, need[x] - more * s, left - more
        while left:
            x = max(names, key=lambda x: need[x])
            got[x], need[x], left = got[x] + 1, need[x] - s, left - 1
        out[s, profile] = got
    return out


def kin_splits(test_cases: DataFrame, shares=SPLITS) -> DataFrame:
    """``(test_id, group_key, size, split)``: for each test case its group, how many cases this has, and a split, such that related ones stay together
    and the shares are met as nearly as components allow.

    ``group_key`` is the smallest ``test_id`` of the group, its own for a case without relatives. The label of a component is the most frequent source
    of its cases (trimmed, in lower case; ``unknown`` for null), so that sources spread evenly. A test case that stands in several rows has one
    split. Only counts of bundles reach the driver, a row for each size and profile.
    """
    spark = test_cases.sparkSession
    source = F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))
    cases = test_cases.where("test_id is not null").groupBy("test_id").agg(F.min(source).alias("label"))
    cases = cut(cases.join(kin_groups(test_cases), "test_id", "left").withColumn("group_key", F.coalesce("group_key", "test_id")))
    by_label = cases.groupBy("group_key", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = by_label.groupBy("group_key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).getField("label").alias("label"))
    sizes = groups.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    labels = sizes.groupBy("label").agg(F.sum(F.col("size") * F.col("n")).alias("profile"))
    named = cut(groups.join(labels, "label"))
    counts = named.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n"))
    plan = allocate([(r["size"], r["profile"], r["n"]) for r in counts.collect()], shares)
    rows, order = [], [name for name, _ in shares]
    for (size_, profile_), got in plan.items():
        upto = 0
        for name in order:
            rows.append((size_, profile_, upto, upto + got[name], name))
            upto += got[name]
    ranges = spark.createDataFrame(rows or [(0, 0, 0, 0, "")], "size long, profile long, low long, high long, split string")
    spread = named.withColumn("h", F.xxhash64("group_key")).withColumn("range", F.shiftrightunsigned("h", 56))
    upto = Window.partitionBy("size", "profile").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("size", "profile", "range").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0))).drop("k")
    rank = F.row_number().over(Window.partitionBy("size", "profile", "range").orderBy("h", "group_key")) - 1 + F.col("before")
    ranked = spread.join(before, ["size", "profile", "range"]).withColumn("rank", rank)
    placed = ranked.join(ranges, ["size", "profile"]).where("rank >= low and rank < high")
    return cases.join(placed.select("group_key", "size", "split"), "group_key").select("test_id", "group_key", "size", "split")


def kept_together(test_cases: DataFrame) -> DataFrame:
    """``(test_id, group_key)`` of the test cases that the splits keep together with others."""
    return kin_splits(test_cases).where("size > 1").select("test_id", "group_key")
