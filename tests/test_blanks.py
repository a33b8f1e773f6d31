"""Symbols of statements that hold blanks beyond ASCII: as SQL's trim, all that Unicode has are taken from the ends."""

from weftgraph.functions import code as C


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, code string")
    return [r.v for r in rows.select("i", column(rows["code"]).alias("v")).orderBy("i").collect()]


def test_definitions_without_blanks_of_unicode(spark):
    got = values(spark, C.defined_in_text, "int   x　 = 1 ;", " * p  = q ;", "\ta = b ;", "　a [ i ]  = b ;")
    assert got == [["int", "x"], ["p"], ["\ta"], ["a"]]


def test_uses_without_blanks_of_unicode(spark):
    got = values(spark, C.used_in_text, "f (   ,  b  ) ;", "x = 　y  + &  z ;", "g \n  ;")
    assert got == [["f", "b"], ["y", "z"], ["g", "\n"]]
