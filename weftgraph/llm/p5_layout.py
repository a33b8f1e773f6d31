"""Problem 5: duplicates hidden by layout.

Method: partial counts of canonical keys tell exactly which are hot; these are salted into a two-level aggregation, whose few results are sent to the
rows; all other keys take one shuffle of their rows by key. The smallest identifier stands for its copies. See ``common.with_least``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import only_long, with_least


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", ""))


def _sorted_entries(part: Column) -> Column:
    """The inside of a pair of braces, its entries sorted if all begin with a dot; blank entries, as after a last comma, don't count."""
    entries = F.filter(F.transform(F.split(part, ","), lambda e: F.regexp_replace(e, r"^\s+", "")), lambda e: e != "")
    fields = F.filter(F.array(entries), lambda e: (F.size(e) >= 2) & F.forall(e, lambda x: F.startswith(x, F.lit("."))))
    ordered = F.transform(fields, lambda e: F.array_join(F.sort_array(F.transform(e, _bare)), ","))
    return F.coalesce(F.get(ordered, F.lit(0)), part)


def canonical(code: Column) -> Column:
    """The text that all copies of a code share: ASCII letters and digits in lower case, initialiser fields in sorted order."""
    parts = F.regexp_extract_all(code, F.lit(r"[{}]|[^{}]+"), F.lit(0))

    def inner(p: Column) -> Column:
        enclosed = lambda x, i: (i > 0) & (F.get(p, i - 1) == "{") & (F.get(p, i + 1) == "}")
        return F.array_join(F.transform(p, lambda x, i: F.when(enclosed(x, i), _sorted_entries(x)).otherwise(x)), "")

    ordered = F.get(F.transform(F.array(parts), inner), F.lit(0))
    return _bare(F.when(code.rlike(r"\{\s*\."), ordered).otherwise(code))


def keyed(nodes: DataFrame, least_words: int = 20) -> DataFrame:
    """``(id, key)`` of the long records; the latest delivery of an id counts."""
    rows = only_long(nodes.where(F.col("id").isNotNull()).select("id", "loaded_at", "code"), "code", least_words)
    rows = rows.select("id", "loaded_at", F.md5(canonical(F.col("code"))).alias("key"))
    return rows.groupBy("id").agg(F.max(F.struct("loaded_at", "key")).getField("key").alias("key"))


def collapse(rows: DataFrame) -> DataFrame:
    """``(id, keep_id, n_copies)`` for ``rows(id, key)``: the smallest id with the key, and how many rows hold it, the row itself among them.

    Null keys are left out. Every id should stand in one row.
    """
    found = with_least(rows.select("id", "key"), "key", "id")
    return found.select("id", F.col("least").alias("keep_id"), F.col("n").alias("n_copies"))


def copies(nodes: DataFrame) -> DataFrame:
    """``(keep_id, copy_id)``: a row for each long record that is a copy, with the record that is kept for it.

    Null, empty and short codes are copies of nothing; repeated deliveries count once; a record without copies has no row.
    """
    found = collapse(keyed(nodes)).where("id <> keep_id")
    return found.select("keep_id", F.col("id").alias("copy_id"))


def copy_counts(nodes: DataFrame) -> DataFrame:
    """``(keep_id, n_copies)``: a row for each kept long record, the number of copies with itself."""
    return collapse(keyed(nodes)).where("id = keep_id").select("keep_id", "n_copies")
