"""Skip-gram vectors made by many tasks, and documents as their words' vectors."""

import numpy as np
import pytest
from pyspark.ml.feature import Word2Vec

from weftgraph.functions import skipgram
from weftgraph.functions.embed import embedded, mean_vectors
from weftgraph.functions.skipgram import skip_gram


def cos(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("most", [16_384, 8])
def test_words_with_the_same_neighbours_are_near(spark, monkeypatch, most):
    """Without Spark's trainer, which holds all words on the driver; also where few words count as frequent and others occur in several tasks."""
    monkeypatch.setattr(skipgram, "MOST_FREQUENT", most)
    monkeypatch.setattr(Word2Vec, "fit", None)
    pick = np.random.default_rng(3)
    say = {"cat": ["fur", "paw", "purr", "milk"], "dog": ["fur", "paw", "purr", "milk"], "car": ["wheel", "road", "fuel", "brake"]}
    docs = [(k, [str(pick.choice(say[w])), w, str(pick.choice(say[w])), str(pick.choice(say[w]))]) for k, w in enumerate(["cat", "dog", "car"] * 400)]
    docs += [(5000, ["alone"]), (5001, []), (5002, None), (5003, ["fur", None, "rare"])]
    rows = skip_gram(spark.createDataFrame(docs, "doc_id long, words array<string>").repartition(4), size=8, rounds=20).collect()
    v = {r.token: np.array(r.vec) for r in rows}
    assert len(rows) == len(v) == 13 and all(np.isfinite(x).all() and len(x) == 8 for x in v.values())
    assert cos(v["cat"], v["dog"]) > cos(v["cat"], v["car"]) + 0.1


def test_no_words(spark):
    assert skip_gram(spark.createDataFrame([(1, []), (2, None)], "doc_id long, words array<string>")).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 10_000])
def test_documents_as_vectors(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    docs = spark.createDataFrame([(1, ["a", "b", None, "a"]), (2, ["zz"]), (3, ["zz", "b"]), (4, None), (5, [])], "doc_id long, words array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0]), ("c", [9.0, 9.0])], "token string, vec array<double>")
    assert {r.doc_id: r.x for r in embedded(docs, vectors).collect()} == {1: [[1.0, 0.0], [0.0, 3.0], [1.0, 0.0]], 3: [[0.0, 3.0]]}
    assert {r.doc_id: r.vec for r in mean_vectors(docs, vectors).collect()} == {1: [pytest.approx(2 / 3), 1.0], 3: [0.0, 3.0]}
    assert mean_vectors(docs, vectors.limit(0)).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
