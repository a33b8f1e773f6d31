"""Analytics in order: pairing, neighbours, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.io import cut


def kept_once(df: DataFrame) -> DataFrame:
    """Rows frozen in the shared folder, for where two uses must see the same partitions."""
    return cut(df)


def pairs(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, no, x, y)``: within each key the n-th of one side with the n-th of the other; what has no partner is left out."""
    w = Window.partitionBy(key).orderBy(order)
    a = left.select(key, F.row_number().over(w).alias("no"), F.col(order).alias("x"))
    b = right.select(key, F.row_number().over(w).alias("no"), F.col(order).alias("y"))
    return a.join(b, [key, "no"])


def siblings(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with the id of the one before and behind within their key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"prior_id": F.lag("id").over(w), "next_id": F.lead("id").over(w)})


def hunks(lines: DataFrame) -> DataFrame:
    """Lines of diffs with their hunk and place in it: ``lines(file, pos, value)``; a hunk begins with ``@@``."""
    w = Window.partitionBy("file").orderBy("pos")
    numbered = lines.withColumn("hunk", F.sum(F.when(F.startswith("value", F.lit("@@")), 1).otherwise(0)).over(w))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("file", "hunk").orderBy("pos")) - 1)


def text_order(rows: DataFrame) -> DataFrame:
    """``(src, dst)`` from each of ``rows(id, function_id, start_idx)`` to the next in its function's text: the flow of a function whose own is lost."""
    return siblings(rows, "function_id", "start_idx", "id").where("next_id is not null").select(F.col("id").alias("src"), F.col("next_id").alias("dst"))
