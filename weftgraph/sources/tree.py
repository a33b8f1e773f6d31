"""Source trees: files below a folder, and the folders as nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.parse.build import SOURCE_FILES


def test_case_of(path: Column) -> Column:
    """The last folder of a path, which names the test case."""
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)


def read_sources(spark: SparkSession, root: str, patterns: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """``(path, text, test_id)`` of the source files below ``root``; files that vanish or can't be read are passed over.
    ``ordered`` sorts by path."""
    globs = "{" + ",".join(patterns or SOURCE_FILES) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs)
    files = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    out = files.select(path.alias("path"), F.col("content").cast("string").alias("text"), test_case_of(path).alias("test_id"))
    return out.orderBy("path") if ordered else out


def folders(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directory and file nodes ``(path, type)`` of ``paths(path)``, and ``(parent, child)`` between them. A null or empty path gives nothing."""
    parts = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), F.array_join(F.slice(parts, 1, n), "/").alias("child")))
    steps = paths.where("path is not null and instr(path, '/') > 0").select("path", F.explode(prefix).alias("s")).select("path", "s.parent", "s.child")
    links = steps.where("parent <> ''").select("parent", "child").distinct()
    files = paths.where("path <> ''").select("path").distinct().withColumn("type", F.lit("File"))
    dirs = steps.where("parent <> ''").select(F.col("parent").alias("path")).distinct().withColumn("type", F.lit("Directory"))
    return dirs.unionByName(files), links
