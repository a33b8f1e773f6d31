"""What calls write: statements without such a call are left out before any pattern cuts them apart."""

from pyspark.sql import functions as F

from weftgraph.functions import code as C
from weftgraph.plans.queries import QUERIES


def test_written_variables_leave_out_other_statements(spark, tmp_path, capsys):
    rows = [(1, "f ( a ) ; memcpyx ( b , c ) ;"), (2, "memcpy ( & p , q , 4 ) ;"), (3, "xscanf ( s , & n ) ; sscanf ( s , t , & n , m ) ;"), (4, "scanf(s,  & k)"), (5, "gets x ;")]
    nodes = spark.createDataFrame(rows, "id long, code string").withColumn("is_cfg", F.lit(True)).withColumn("loaded_at", F.lit("2020-01-01").cast("timestamp"))
    nodes.write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([], "src long, dst long, etype string").write.parquet(f"{tmp_path}/edges.parquet")
    found = QUERIES["written_variables"](spark, str(tmp_path))
    assert sorted((r.id, r.name) for r in found.collect()) == [(2, "p"), (3, "m"), (3, "n"), (4, "k")]
    found.explain()
    assert "(?:strcpy|" in capsys.readouterr().out


def test_blanks_of_unicode_before_an_argument(spark):
    row = spark.createDataFrame([("strcpy (  dst , src ) ;",)], "x string").select(C.written_by_call(F.col("x")).alias("v")).first()
    assert row.v == ["dst"]
