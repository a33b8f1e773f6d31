"""What several of the operators share: words, records, long records."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Everything that is not part of a word.
NO_WORD = "[^A-Za-z0-9_]+"


def words(text: Column) -> Column:
    """The words of a text in order: runs of ASCII letters, digits and underscores, in lower case.

    Other characters are blanked before lower-casing, for some of them have an ASCII letter as lower case. A text without words gives ``[""]``,
    a null text null.
    """
    return F.split(F.lower(F.trim(F.regexp_replace(text, NO_WORD, " "))), " ")


def records(nodes: DataFrame) -> DataFrame:
    """``(id, code)``: one row for each id with non-null code.

    Of several deliveries of an id the one with the latest ``loaded_at`` counts, among equals the one with the greatest code. Rows without id are
    no records.
    """
    latest = F.max(F.struct("loaded_at", "code")).getField("code").alias("code")
    return nodes.where(F.col("code").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(latest)


def only_long(rows: DataFrame, code: str, least_words: int) -> DataFrame:
    """``rows`` with at least so many distinct words in ``code``; the distinct words' keys come as ``h``, sorted.

    A key is the 64-bit hash of a word. The test stands inside one generator expression, so that each code is split once; codes too short to hold
    so many words are left out before.
    """
    shortest = 2 * least_words - 1
    keys = F.array_distinct(F.transform(words(F.col(code)), lambda w: F.xxhash64(w)))
    kept = F.filter(F.array(keys), lambda k: F.size(k) >= least_words)
    return (
        rows.where(F.length(code) >= shortest)
        .select("*", F.explode(kept).alias("_k"))
        .withColumn("h", F.sort_array("_k"))
        .drop("_k")
    )


def kept(df: DataFrame) -> DataFrame:
    """``df`` kept in executor memory, or on their disks where that is short; a lost part is computed again from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: A key is hot if it holds more rows than this share of all and than this number; so there are fewer hot keys than the share says.
HOT_SHARE, HOT_ROWS = 10_000, 10_000
#: Parts that the rows of a hot key are split into before they are aggregated.
SALTS = 256


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``least``, the least ``value`` among those of the same ``key``, and ``n``, how many these are. Rows with a null key are left out.

    Partial counts, one row for each key of a task, tell exactly which keys are hot. These are salted into two levels of aggregation, and what comes
    out, fewer than ``HOT_SHARE`` rows, is sent to the rows, which stay where they are. All other keys take one shuffle of their rows by key.
    """
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = rows.agg(F.greatest(F.floor(F.count(F.lit(1)) / F.lit(HOT_SHARE)), F.lit(HOT_ROWS)).alias("n")).scalar()
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key))
    of_hot = rows.join(hot, key)
    salted = of_hot.groupBy(key, F.pmod(F.xxhash64(value), F.lit(SALTS)).alias("_salt")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"))
    firsts = salted.groupBy(key).agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    of_hot = of_hot.join(F.broadcast(firsts), key)
    w = Window.partitionBy(key)
    others = rows.join(hot, key, "left_anti").withColumns({"least": F.min(value).over(w), "n": F.count(F.lit(1)).over(w)})
    return of_hot.unionByName(others)
