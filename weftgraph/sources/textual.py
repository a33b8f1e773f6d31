"""Readers and writers of line-based files: slices, diffs, flaw lists, keyword lists, graph text, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.slices import SEPARATOR


def write_slices(blocks: DataFrame, folder: str, append: bool = False) -> None:
    """Blocks of ``(slice_id, path, focus, start_line, text)`` as text: a header, the lines, a line of dashes."""
    header = F.concat_ws(" ", "slice_id", "path", "focus", "start_line")
    blocks.select(F.concat_ws("\n", header, "text", F.lit(SEPARATOR)).alias("value")).write.mode("append" if append else "overwrite").text(folder)


def read_slices(spark: SparkSession, folder: str) -> DataFrame:
    """``(slice_id, path, focus, start_line, lines)`` of such files; blank blocks don't count."""
    raw = spark.read.text(folder, lineSep=SEPARATOR)
    block = raw.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value")).where("value <> ''")
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), " ")
    return block.select(
        F.get(head, F.lit(0)).try_cast("long").alias("slice_id"), F.get(head, F.lit(1)).alias("path"), F.get(head, F.lit(2)).alias("focus"),
        F.get(head, F.lit(3)).try_cast("int").alias("start_line"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))).alias("lines"),
    )


def read_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, pos, value)``: the lines of diff files in order; ``pos`` grows within a file."""
    text = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "value"))


def removed_lines(hunks: DataFrame) -> DataFrame:
    """``(file, path, hunk, line, code)``: what diffs take away, with its line number in the old file; blank lines and lone brackets don't count.

    ``hunks(file, pos, value, hunk, place)`` comes from ``windows.hunks``. ``path`` is that of the old file, as the line ``---`` above names it without
    a leading ``a/``; where there is none, the name of the diff without its ending.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file", "hunk").orderBy("pos")
    start = F.regexp_extract("value", r"^@@ -(\d+)", 1)
    first = F.max(F.when(start != "", start.cast("int"))).over(Window.partitionBy("file", "hunk"))
    skip = F.startswith("value", F.lit("@@")) | F.startswith("value", F.lit("+")) | F.startswith("value", F.lit("\\"))
    old = F.sum(F.when(skip, 0).otherwise(1)).over(w)
    named = F.regexp_extract("value", r"^--- (?:a/)?([^\t\r\n]+)", 1)
    above = F.last(F.when(named != "", F.trim(named)), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    path = F.coalesce(above, F.regexp_replace(F.substring_index("file", "/", -1), r"\.(diff|patch|txt)$", ""))
    rows = hunks.withColumn("path", path).where("hunk > 0").withColumns({"line": first + old - 1, "code": F.trim(F.expr("substring(value, 2)"))})
    gone = rows.where(F.startswith("value", F.lit("-")) & (named == ""))
    return gone.where(~F.col("code").isin("", ",", ";", "{", "}")).select("file", "path", "hunk", "line", "code")


def lines_of_source(removed: DataFrame, source: DataFrame) -> DataFrame:
    """``(path, line)``: removed lines that stand in ``source(path, line, code)`` in the same file with the same number and, apart from outer blanks,
    the same text. The path of a source may have folders in front of that of the diff."""
    here = source.select("path", "line", F.trim("code").alias("code"))
    gone = removed.select(F.col("path").alias("old"), F.col("line").alias("at"), F.col("code").alias("text")).distinct()
    same_file = (F.col("path") == F.col("old")) | F.endswith("path", F.concat(F.lit("/"), "old"))
    return here.join(gone, (F.col("line") == F.col("at")) & (F.col("code") == F.col("text")) & same_file, "left_semi").select("path", "line")


def flaws(lines: DataFrame) -> DataFrame:
    """``(path, line, name)`` from ``lines(file, pos, value)`` of an XML list: each ``flaw`` and ``mixed`` with the ``file`` above it."""
    from pyspark.sql import Window

    attr = lambda name: F.regexp_extract("value", rf'\b{name}="([^"]*)"', 1)
    path = F.when(F.col("value").rlike(r"<file\b"), attr("path"))
    above = F.last(path, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    rows = lines.withColumn("path", above).where(F.col("value").rlike(r"<(flaw|mixed)\b"))
    return rows.select("path", attr("line").cast("int").alias("line"), attr("name").alias("name"))


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """``(keyword)``: the first column of a CSV file with a header, or of all such files of a folder, as the sheets of a book are."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.trim(F.col(f"`{rows.columns[0]}`")).alias("keyword")).where("keyword <> ''").distinct()


def case_folders(number: Column) -> Column:
    """A number as three folders of three digits: ``1575`` is ``000/001/575``."""
    full = F.lpad(number.cast("string"), 9, "0")
    return F.concat_ws("/", F.substring(full, 1, 3), F.substring(full, 4, 3), F.substring(full, 7, 3))


def case_of_folders(path: Column) -> Column:
    """The three folders before the file's name joined again."""
    parts = F.split(path, "/")
    return F.concat_ws("", F.slice(parts, F.size(parts) - 3, 3))


def graph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(value)``: ``(id {properties})`` for each node and ``(src)-[:TYPE {properties}]->(dst)`` for each edge; null properties are left out."""
    skip = {"id", "src", "dst", "etype"}
    some = lambda df: F.to_json(F.struct(*[c for c in df.columns if c not in skip]))
    a = nodes.select(F.format_string("(%s %s)", F.col("id"), some(nodes)).alias("value"))
    b = edges.select(F.format_string("(%s)-[:%s %s]->(%s)", F.col("src"), F.col("etype"), some(edges), F.col("dst")).alias("value"))
    return a.unionByName(b)


def from_graph_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(id, properties)`` and ``edges(src, dst, etype, properties)`` of such text, properties as JSON; other lines are left out."""
    node, edge = r"^\((\d+) (\{.*\})\)$", r"^\((\d+)\)-\[:(\w+) (\{.*\})\]->\((\d+)\)$"
    part = lambda p, i: F.regexp_extract("value", p, i)
    nodes = lines.where(F.col("value").rlike(node)).select(part(node, 1).cast("long").alias("id"), part(node, 2).alias("properties"))
    edges = lines.where(F.col("value").rlike(edge)).select(part(edge, 1).cast("long").alias("src"), part(edge, 4).cast("long").alias("dst"), part(edge, 2).alias("etype"), part(edge, 3).alias("properties"))
    return nodes, edges


def append_report(metrics: DataFrame, folder: str) -> None:
    """Rows of metrics as JSON lines beside those that are there, on whatever file system the folder names."""
    metrics.write.mode("append").json(folder)
