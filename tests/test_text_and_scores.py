"""Text preparation, scores, the recurrent classifier, sources, streaming and the driver's contract."""

import math
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scores, text
from weftgraph.functions.embed import embedded, nearest, train_vectors, vector_table
from weftgraph.functions.recurrent import Cell, Classifier, predict
from weftgraph.operators import windows
from weftgraph.sources import textual
from weftgraph.sources.tree import folders, read_sources
from weftgraph.streaming.dedup import first_seen, run_once, windowed_counts


def values(spark, rows, column, schema="x string"):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_tokens(spark):
    got = values(spark, [('if (p->x >= 10) s = "a \\" b" ; y',), ("",), (None,), ('"' + "x" * 50_000 + '"',), ("'open",)], text.c_tokens(F.col("x")))
    assert got[0] == ["if", "(", "p", "->", "x", ">=", "10", ")", "s", "=", '"a \\" b"', ";", "y"]
    assert got[1] == [] and got[2] is None and len(got[3]) == 1 and got[4] == ["'", "open"]


def test_canonical_names(spark):
    code = "int len = get ( buf ) ; get ( len ) ; memcpy ( buf , len ) ;"
    got = values(spark, [(code,), ("",), (None,)], text.canonical(F.split("x", " "), ["memcpy"]))
    assert " ".join(got[0]) == "int variable_0 = func_0 ( variable_1 ) ; func_0 ( variable_0 ) ; memcpy ( variable_1 , variable_0 ) ;"
    assert got[1] == [""] and got[2] is None


def test_numbers(spark):
    assert values(spark, [("10",), ("1e3",), ("x",), ("",), (None,)], text.is_number(F.col("x"))) == [True, True, False, False, False]


def test_hashes_ignore_line_numbers(spark):
    rows = [(["a ; 1", "b ; 2"],), (["a ; 7", "b ; 9", "no number"],), (["b ; 2", "a ; 1"],), ([],)]
    got = values(spark, rows, text.slice_hash(F.col("x")), "x array<string>")
    assert got[0] == got[1] != got[2] and got[3] == "d41d8cd98f00b204e9800998ecf8427e"


def test_padding(spark):
    rows = [([1, 2, 3],), ([],), ([1, 2, 3, 4, 5, 6],)]
    assert values(spark, rows, text.pad_ids(F.col("x"), 4), "x array<long>") == [[0, 1, 2, 3], [0, 0, 0, 0], [3, 4, 5, 6]]
    assert values(spark, rows, text.pad_ids(F.col("x"), 4, False, False), "x array<long>") == [[1, 2, 3, 0], [0, 0, 0, 0], [1, 2, 3, 4]]
    words = [(list("abcdefgh"), 8), (list("abcdefgh"), 1), (list("abcdefgh"), 4), (list("ab"), 1)]
    got = [r.v for r in spark.createDataFrame(words, "x array<string>, f int").select(text.pad(F.col("x"), 4, F.col("f")).alias("v")).collect()]
    assert ["".join(g) for g in got] == ["efgh", "abcd", "bcde", "ab"] and len(got[3]) == 4


def test_vocabulary_and_weights(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "doc_id long, words array<string>")
    assert {r.word: (r.n, r.n_docs) for r in text.vocabulary(docs).collect()} == {"a": (2, 1), "b": (2, 2)}
    weights = {(r.doc_id, r.word): r.weight for r in text.tfidf(docs).collect()}
    assert weights[1, "a"] == pytest.approx((1 + math.log(2)) * math.log(1 + 3 / 2))
    grams = Counter((r.word, r.context) for r in text.skipgrams(docs, 1).collect())
    assert grams == {("a", "b"): 2, ("b", "a"): 2}
    assert {(r.word, r.doc_id): r.places for r in text.reverse_index(docs).collect()}["a", 1] == [0, 2]


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_numbering_in_order(spark, n):
    rows = spark.createDataFrame([((i * 37) % 1009,) for i in range(n)], "k long").repartition(5)
    got = sorted((r.no, r.k) for r in text.numbered_rows(rows, "k").collect())
    assert got == [*enumerate(sorted((i * 37) % 1009 for i in range(n)), 1)]
    assert text.whole_batches(rows, "k", 8).count() == n - n % 8
    assert Counter(r.chunk for r in text.chunks(rows, "k", 8).collect()) == Counter(i // 8 for i in range(n))


def test_later_copies(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "a"), (4, "b"), (5, None)], "id long, key string")
    assert sorted(r.id for r in text.later_copies(rows, "key", "id").collect()) == [2, 3]


def test_rates_and_outcomes(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.2), (None, 0.4), (1, None)], "y int, p double")
    got = scores.rates(scores.confusion(rows, "y", "p")).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (2, 1, 1, 1) and got.precision == pytest.approx(2 / 3) and got.f1 == pytest.approx(2 / 3)
    assert scores.f_beta(scores.confusion(rows, "y", "p"), 1.0).first().f_beta == pytest.approx(2 / 3, abs=1e-6)
    none = scores.rates(scores.confusion(rows.limit(0), "y", "p")).first()
    assert none.tp == 0 and none.precision == 0
    assert [r.outcome for r in scores.outcomes(rows.limit(5), "y", "p").collect()] == ["tp", "tp", "fp", "tn", "fn"]
    assert scores.weighted_mean(spark.createDataFrame([(1.0, 3), (5.0, 1)], "v double, n int"), "v", "n").first().mean == 2


def test_vector_scores(spark):
    row = spark.createDataFrame([([0.0, 1.0, 0.0], [0.2, 0.5, 0.3], 1)], "y array<double>, p array<double>, k int")
    got = row.select(*(f(F.col("k") if "sparse" in n else F.col("y"), F.col("p")).alias(n) for n, f in scores.VECTOR_LOSSES.items())).first()
    assert got.categorical_crossentropy == pytest.approx(-math.log(0.5)) == pytest.approx(got.sparse_categorical_crossentropy)
    assert got.categorical_hinge == pytest.approx(0.8) and got.cosine_proximity == pytest.approx(-0.5 / math.sqrt(0.38))
    assert row.select(scores.in_top_k(F.col("p"), F.col("k"), 1).alias("v")).first().v
    soft = row.select(scores.softmax(F.col("p")).alias("v")).first().v
    assert sum(soft) == pytest.approx(1) and soft[1] == max(soft)
    assert row.select(scores.normalized(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first().v == [0, 0]


def test_recurrent_cell_by_hand():
    cell = Cell(np.array([[0.5, -0.2, 1.0]]), np.array([[0.1, 0.3, -0.4]]), np.array([0.1, 0.0, 0.2]))
    gate, h = (lambda x: min(1, max(0, 0.2 * x + 0.5))), 0.0
    for x in (1.0, -2.0, 0.5):
        z, r = gate(0.5 * x + 0.1 + 0.1 * h), gate(-0.2 * x + 0.3 * h)
        h = z * h + (1 - z) * math.tanh(x + 0.2 - 0.4 * (r * h))
    got = cell.run(np.array([[[1.0], [-2.0], [0.5]]]), np.ones((1, 3), bool))
    assert got[0, -1, 0] == pytest.approx(h)


def test_masked_times_do_not_count(spark):
    model = Classifier.seeded(2, 4)
    x = [[0.3, 0.1], [0.2, -0.5]]
    rows = spark.createDataFrame([(1, [[0.0, 0.0]] + x), (2, x + [[0.0, 0.0]]), (3, [[0.0, 0.0]] * 3)], "sample_id long, x array<array<double>>")
    p = {r.sample_id: r.p for r in predict(rows, model).collect()}
    assert p[1] == pytest.approx(p[2]) and 0 < p[1] < 1 and p[3] == pytest.approx(0.5)


def test_vectors_and_neighbours(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "a"]), (3, ["zz"])], "doc_id long, words array<string>")
    table = vector_table(train_vectors(docs, size=4, rounds=1))
    assert {r.token for r in table.collect()} == {"a", "b", "c", "zz"}
    assert {r.doc_id: len(r.x) for r in embedded(docs, table.where("token <> 'c'")).collect()} == {1: 2, 2: 2, 3: 1}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.1])], "vid long, vec array<double>")
    q = v.select(F.col("vid").alias("qid"), F.col("vec").alias("q"))
    got = {r.qid: [] for r in q.collect()}
    for r in nearest(v, q, 2).orderBy("qid", F.desc("cos"), "vid").collect():
        got[r.qid].append(r.vid)
    assert got[1] == [2, 6] and got[2] == [6, 1] and got[5] == [] and got[4] == [1, 2]


def test_slices_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "/a.c", "memcpy", 3, "x ; 3\ny ; 4"), (2, "/b.c", "p", 1, "z ; 1")], "slice_id long, path string, focus string, start_line int, text string")
    textual.write_slices(rows, str(tmp_path / "s"))
    got = sorted(tuple(r) for r in textual.read_slices(spark, str(tmp_path / "s")).collect())
    assert got == [(1, "/a.c", "memcpy", 3, ["x ; 3", "y ; 4"]), (2, "/b.c", "p", 1, ["z ; 1"])]


def test_removed_lines_of_a_diff(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.diff").write_text("--- a/src/x.c\n+++ b/src/x.c\n@@ -10,3 +10,3 @@\n keep\n-gone ( ) ;\n+new\n-}\n@@ -40 +40 @@\n-last\n")
    lines = textual.read_diffs(spark, str(tmp_path / "d"))
    gone = textual.removed_lines(windows.hunks(lines))
    assert sorted((r.line, r.code) for r in gone.collect()) == [(11, "gone ( ) ;"), (40, "last")]
    rows = [("/old/src/x.c", 11, "  gone ( ) ; "), ("/old/src/x.c", 12, "gone ( ) ;"), ("/old/src/y.c", 11, "gone ( ) ;"), ("/old/osrc/x.c", 40, "last"), ("src/x.c", 40, "last")]
    source = spark.createDataFrame(rows, "path string, line int, code string")
    assert sorted(tuple(r) for r in textual.lines_of_source(gone, source).collect()) == [("/old/src/x.c", 11), ("src/x.c", 40)]


def test_flaws_and_keywords(spark, tmp_path):
    xml = ['<file path="a.c" language="c">', '<flaw line="7" name="CWE-1"/>', "</file>", '<file path="b.c">', '<mixed line="9" name="CWE-2"/>']
    got = textual.flaws(spark.createDataFrame([("f", i, v) for i, v in enumerate(xml)], "file string, pos int, value string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a.c", 7, "CWE-1"), ("b.c", 9, "CWE-2")]
    (tmp_path / "k.csv").write_text("name,x\nmemcpy,1\n memcpy,2\n,3\n")
    assert [r.keyword for r in textual.keywords(spark, str(tmp_path / "k.csv")).collect()] == ["memcpy"]


def test_folders_of_cases(spark):
    rows = spark.createDataFrame([(1575,), (None,)], "n long").select(textual.case_folders(F.col("n")).alias("v")).collect()
    assert rows[0].v == "000/001/575"
    assert values(spark, [("/x/000/001/575/a.c",)], textual.case_of_folders(F.col("x"))) == ["000001575"]
    nodes, links = folders(spark.createDataFrame([("/a/b/c.c",), ("/a/d.c",), (None,), ("",)], "path string"))
    assert sorted((r.path, r.type) for r in nodes.collect()) == [("/a", "Directory"), ("/a/b", "Directory"), ("/a/b/c.c", "File"), ("/a/d.c", "File")]
    assert sorted(tuple(r) for r in links.collect()) == [("/a", "/a/b"), ("/a", "/a/d.c"), ("/a/b", "/a/b/c.c")]


def test_source_trees(spark, tmp_path):
    (tmp_path / "case1").mkdir()
    (tmp_path / "case1/a.c").write_text("int f() { return 1; }")
    (tmp_path / "case1/readme.txt").write_text("no")
    (tmp_path / "b.hpp").write_text("int g;")
    got = read_sources(spark, str(tmp_path), ordered=True).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.test_id) for r in got] == [("b.hpp", tmp_path.name), ("a.c", "case1")]


def test_graph_text_round_trip(spark):
    nodes = spark.createDataFrame([(1, "a ) { \" \n"), (2, None)], "id long, code string")
    edges = spark.createDataFrame([(1, 2, "REACHES", "x")], "src long, dst long, etype string, var string")
    back, links = textual.from_graph_text(textual.graph_text(nodes, edges))
    again = back.select("id", F.get_json_object("properties", "$.code").alias("code"))
    assert sorted(again.collect()) == sorted(nodes.collect()) and links.first().etype == "REACHES"


def test_reports_are_appended(spark, tmp_path):
    for k in (1, 2):
        textual.append_report(spark.range(1).select((F.col("id") + k).alias("f1")), str(tmp_path / "r"))
    assert sorted(r.f1 for r in spark.read.json(str(tmp_path / "r")).collect()) == [1, 2]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("A  b", datetime(2040, 1, 1, 0, 1)), ("a b", datetime(2040, 1, 1, 0, 2)), ("c", datetime(2040, 1, 1, 0, 3)), (None, datetime(2040, 1, 1, 9)), ("d", datetime(2040, 1, 2))], "text string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run_once(first_seen(stream(), F.col("text"), "ts"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    run_once(windowed_counts(stream(), "ts", "text"), str(tmp_path / "w"), str(tmp_path / "c2"))
    done = spark.read.schema("start timestamp, text string, n long").parquet(str(tmp_path / "w"))
    assert done.where("n = 1").count() == 4


def test_driver_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(callable(f) for f in queries.values())


def test_verdicts_and_similar_words(spark):
    from weftgraph.functions.embed import similar_words

    rows = spark.createDataFrame([("t", 2, ["f", "g"], "fp"), ("t", 1, ["f"], "tp"), ("u", 3, [], "tn")], "case_id string, sample_id long, functions array<string>, outcome string")
    assert {(r.case_id, r.function): r.outcomes for r in scores.verdicts(rows).collect()} == {("t", "f"): ["tp", "fp"], ("t", "g"): ["fp"]}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0])], "token string, vec array<double>")
    assert [r.token for r in similar_words(v, "a", 1).collect()] == ["b"] and similar_words(v, "zz").count() == 0
