"""Problem 4: the frequency of every distinct term.

Method: suffix-sorted n-gram counting. Every position of a record gives its truncated suffix of up to ``sigma`` words; equal suffixes are counted
where they stand, routed by their first term, sorted in reverse lexicographic order, and one pass with a stack gives the counts of all their
prefixes, that is of all n-grams. For the number of records an n-gram occurs in, each suffix carries the lengths up to which its prefix was seen at
an earlier position of its record; so record sets become sums, which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import records, words

#: A word in fewer records is rare; one in more than this share of all records, as a fraction, is common.
RARE_BELOW, COMMON_NUM, COMMON_DEN = 3, 2, 100


def _suffixes(docs: DataFrame, sigma: int) -> DataFrame:
    """``(suffix, new)``: a row for each position; ``new`` is the least length at which the prefix is new in its record, ``sigma + 1`` if none is."""
    if sigma == 1:
        seq = docs.select(F.sort_array("w").alias("w"))
        each = F.transform("w", lambda x, i: F.struct(x.alias("suffix"), F.when((i > 0) & (F.get("w", i - 1) == x), 2).otherwise(1).alias("new")))
        return seq.select(F.inline(each))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, new = [], []
            for w in b.column(0).to_pylist():
                seen: set[str] = set()
                for i in range(len(w)):
                    part, least = "", sigma + 1
                    for n in range(min(sigma, len(w) - i)):
                        part = f"{part} {w[i + n]}" if n else w[i]
                        if part not in seen:
                            seen.add(part)
                            least = min(least, n + 1)
                    out.append(part)
                    new.append(least)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(new, pa.int32())], ["suffix", "new"])

    return docs.select("w").mapInArrow(cut, "suffix string, new int")


def _stack(sigma: int):
    """One pass over suffixes in descending order: an n-gram is complete when the first suffix without it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [term, occurrences, records], the n-th for the prefix of n terms
        grams: list[str] = []
        n_all: list[int] = []
        n_rec: list[int] = []

        def pop(depth: int) -> None:
            while len(stack) > depth:
                grams.append(" ".join(x[0] for x in stack))
                _, n, r = stack.pop()
                n_all.append(n)
                n_rec.append(r)
                if stack:
                    stack[-1][1] += n

        for b in batches:
            cols = b.to_pydict()
            new = [cols[f"new_{k}"] for k in range(1, sigma + 1)]
            for i, (suffix, n) in enumerate(zip(cols["suffix"], cols["n"])):
                terms = suffix.split(" ") if sigma > 1 else [suffix]
                same = 0
                while same < len(stack) and same < len(terms) and stack[same][0] == terms[same]:
                    same += 1
                pop(same)
                for t in terms[same:]:
                    stack.append([t, 0, 0])
                stack[-1][1] += n
                for k in range(len(terms)):
                    stack[k][2] += new[k][i]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n_all, pa.int64()), pa.array(n_rec, pa.int64())], ["gram", "n", "n_records"])
            grams.clear(), n_all.clear(), n_rec.clear()
        pop(0)
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n_all, pa.int64()), pa.array(n_rec, pa.int64())], ["gram", "n", "n_records"])

    return run


def ngram_counts(docs: DataFrame, sigma: int = 1, salts: int = 16) -> DataFrame:
    """``(gram, n, n_records)`` of every n-gram of up to ``sigma`` words; ``docs`` has the word list ``w`` of each record.

    Words are joined by one blank. Null and empty lists count nothing. For ``sigma`` above 1 suffixes are routed by first term and a salt from the
    second, so that a term before a third of all others is shared by ``salts`` tasks; counts of the first terms are then added up.
    """
    rows = _suffixes(docs.where("w is not null"), sigma).where("suffix <> ''")
    sums = [F.sum(F.when(F.col("new") <= k, 1).otherwise(0)).alias(f"new_{k}") for k in range(1, sigma + 1)]
    counted = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), *sums)
    if sigma > 1:
        term = F.split("suffix", " ")
        counted = counted.withColumns({"_first": F.get(term, F.lit(0)), "_salt": F.pmod(F.xxhash64(F.get(term, F.lit(1))), F.lit(salts))})
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = counted.repartition(parts, "_first", "_salt").drop("_first", "_salt")
    grams = counted.sortWithinPartitions(F.desc("suffix")).mapInArrow(_stack(sigma), "gram string, n long, n_records long")
    if sigma > 1:
        grams = grams.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))
    return grams


def term_counts(nodes: DataFrame, sigma: int = 1) -> DataFrame:
    """``(gram, n, n_records, mark)`` over all records; ``mark`` is ``rare``, ``common`` or null.

    The share is of all records, those with an empty code among them. Without records there are no rows.
    """
    all_records = nodes.where("code is not null and id is not null").agg(F.count_distinct("id").alias("n"))
    docs = records(nodes).select(words(F.col("code")).alias("w"))
    common = F.col("n_records") * COMMON_DEN > all_records.scalar() * COMMON_NUM
    mark = F.when(F.col("n_records") < RARE_BELOW, "rare").when(common, "common")
    return ngram_counts(docs, sigma).withColumn("mark", mark)


def marked_terms(nodes: DataFrame) -> DataFrame:
    """``(term, mark)``: the rare and the common words that don't start with a digit."""
    found = term_counts(nodes).where("mark is not null").where(~F.col("gram").rlike("^[0-9]"))
    return found.select(F.col("gram").alias("term"), "mark")
