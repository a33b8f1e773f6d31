"""The registered queries of the nine problems and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.io import table
from weftgraph.llm import p1_near, p2_cohesion, p2_pieces, p3_leaks, p4_terms, p5_layout, p6_kin, p7_ids, p8_eval, p9_subjects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_near.similar_pairs(table(spark, d, "nodes"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return p1_near.similar_classes(table(spark, d, "nodes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces.oversized_pieces(table(spark, d, "nodes")).drop("text")


def p2_cohesive(spark: SparkSession, d: str) -> DataFrame:
    return p2_cohesion.cohesive_pieces(table(spark, d, "nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_leaks.leaked(table(spark, d, "nodes"), table(spark, d, "test_cases"), table(spark, d, "dataset_splits"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return p3_leaks.coverage_report(table(spark, d, "nodes"), table(spark, d, "test_cases"), table(spark, d, "dataset_splits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms.marked_terms(table(spark, d, "nodes"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms.term_counts(table(spark, d, "nodes"))


def p4_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms.term_counts(table(spark, d, "nodes"), sigma=2)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_layout.copies(table(spark, d, "nodes"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return p5_layout.copy_counts(table(spark, d, "nodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_kin.kept_together(table(spark, d, "test_cases"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return p6_kin.kin_splits(table(spark, d, "test_cases")).select("test_id", "split")


def p6_quotas(spark: SparkSession, d: str) -> DataFrame:
    """For each split, whether its share is met up to the largest group, and whether every group is whole."""
    rows = p6_kin.kin_splits(table(spark, d, "test_cases"))
    whole = rows.groupBy("group_key").agg(F.count_distinct("split").alias("k"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    broken = whole.where("k > 1 or n <> size").agg(F.count(F.lit(1))).scalar()
    total, most = rows.agg(F.count(F.lit(1))).scalar(), rows.agg(F.max("size")).scalar()
    share = F.create_map(*[F.lit(x) for pair in p6_kin.SPLITS for x in pair])[F.col("split")]
    met = F.abs(F.count(F.lit(1)) - total * F.first(share) / 100) <= most
    return rows.groupBy("split").agg(met.alias("met"), (broken == 0).alias("whole"))


def p7_ids_query(spark: SparkSession, d: str) -> DataFrame:
    return p7_ids.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_eval.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).drop("n_words")


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    return p8_eval.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects.subjects_of(*_labelled(spark, d))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects.composition(*_labelled(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_classes, p2_found, p2_cohesive, p3_found, p3_coverage, p4_found, p4_counts, p4_bigrams, p5_found, p5_counts, p6_found, p6_splits, p6_quotas]
    named = {f.__name__: f for f in found}
    return named | {"p7_ids": p7_ids_query, "p8_found": p8_found, "p8_runs": p8_runs, "p9_found": p9_found, "p9_composition": p9_composition}


def oracle_sql() -> dict[str, str]:
    from weftgraph.llm import oracle

    return oracle.SQL
