"""Test cases: spellings of their ids, and the split each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings of each split.
SPLITS = {
    "train": ["train", "training"],
    "validation": ["validation", "val", "valid", "dev"],
    "test": ["test", "testing"],
}


def case_key(test_id: Column) -> Column:
    """What all spellings of a test case share: ASCII letters and digits in lower case, without leading zeros; null for null."""
    return F.regexp_replace(F.lower(F.regexp_replace(test_id, "[^A-Za-z0-9]+", "")), "^0+", "")


def split_name(split: Column) -> Column:
    """The split a spelling stands for; null for any other."""
    bare = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    name = F.lit(None).cast("string")
    for known, spellings in SPLITS.items():
        name = F.when(bare.isin(spellings), F.lit(known)).otherwise(name)
    return name


def case_splits(dataset_splits: DataFrame) -> DataFrame:
    """``(case, split)``: the split of the row with the latest ``assigned_at`` of each test case, among equals the greatest name.

    Rows without a test case or with an unknown split's name count with split null, which is left out at the end.
    """
    rows = dataset_splits.select(case_key(F.col("test_id")).alias("case"), split_name(F.col("split")).alias("split"), "assigned_at")
    last = rows.where("case is not null").groupBy("case").agg(F.max(F.struct("assigned_at", "split")).getField("split").alias("split"))
    return last.where("split is not null")
