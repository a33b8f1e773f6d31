"""Problem 1: near-duplicate records with small edits.

Method: blocked sparse matrix product of records by words, see ``setjoin``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import HOT_SHARE, with_least
from weftgraph.llm.setjoin import long_sets, similar_sets

#: Similarity as a fraction, and the least number of distinct words of a long record.
NUM, DEN, LEAST_WORDS = 3, 5, 20
#: Members of a set that meet those of another in one task, of a set that holds more than its share of all.
PART_ROWS = 4096


def similar_pairs(nodes: DataFrame, num: int = NUM, den: int = DEN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(id_a, id_b)``: every pair of long records with similarity of at least ``num / den``, smaller id first.

    Null and empty codes, and codes with fewer words, are in no pair; an empty table gives no rows; repeated deliveries count once; records with
    equal words are pairs of similarity 1.
    """
    rows, members, sets = long_sets(nodes, least_words)
    near = similar_sets(rows, sets, num, den).select("a", "b")
    limit = members.agg(F.greatest(F.floor(F.count(F.lit(1)) / F.lit(HOT_SHARE)), F.lit(PART_ROWS)).alias("n")).scalar()
    sizes = members.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    many = F.broadcast(sizes.select("sid", (1 + F.floor(F.col("n") / F.lit(PART_ROWS))).cast("int").alias("parts")))
    # The members of a set with many stand in parts, so that no task forms all of their pairs; fewer than HOT_SHARE sets have several parts.
    parts = F.coalesce("parts", F.lit(1))
    members = members.join(many, "sid", "left").select("id", "sid", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), parts.alias("parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    for side in ("a", "b"):
        near = near.join(many.withColumnsRenamed({"sid": side, "parts": f"n_{side}"}), side, "left").withColumn(f"p_{side}", every(F.col(f"n_{side}"))).drop(f"n_{side}")
    left = members.select(F.col("id").alias("id_x"), F.col("sid").alias("a"), F.col("part").alias("p_a"))
    right = members.select(F.col("id").alias("id_y"), F.col("sid").alias("b"), F.col("part").alias("p_b"))
    across = near.join(left, ["a", "p_a"]).join(right, ["b", "p_b"]).select("id_x", "id_y")
    other = members.select(F.col("id").alias("id_y"), F.col("sid").alias("a"), every(F.col("parts")).alias("p_a"))
    within = left.join(other, ["a", "p_a"]).where("id_x < id_y").select("id_x", "id_y")
    pairs = across.unionByName(within)
    return pairs.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))


def similar_classes(nodes: DataFrame, num: int = NUM, den: int = DEN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(id, class_id, n_copies, n_links)``: one row for each long record.

    ``class_id`` is the smallest id with exactly the same words, ``n_copies`` the size of that class, ``n_links`` to how many other classes the
    record's class is similar. No group is expanded into its pairs.
    """
    rows, members, sets = long_sets(nodes, least_words)
    near = similar_sets(rows, sets, num, den)
    ends = near.select(F.explode(F.array("a", "b")).alias("sid"))
    links = ends.groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    classes = with_least(members, "sid", "id").select("id", "sid", F.col("least").alias("class_id"), F.col("n").alias("n_copies"))
    return classes.join(links, "sid", "left").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
