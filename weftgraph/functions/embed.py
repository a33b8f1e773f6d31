"""Word vectors and samples made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def train_vectors(docs: DataFrame, size: int = 30, window: int = 5, rounds: int = 5, least: int = 0, seed: int = 1) -> Word2VecModel:
    """Skip-gram vectors of ``docs(words)``; save and load the model with its own methods."""
    return Word2Vec(vectorSize=size, windowSize=window, maxIter=rounds, minCount=least, seed=seed, inputCol="words", outputCol="vector").fit(docs)


def vector_table(model: Word2VecModel) -> DataFrame:
    """``(token, vec)``."""
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec"))


#: Vectors that are put into a batch of documents at a time, about.
VECTORS_AT_ONCE = 100_000


def _looked_up(docs: DataFrame, vectors: DataFrame, key: str, made, schema: str) -> DataFrame:
    """``made(x, n)`` of the documents that have a word with a vector: the vectors of their words in order, and how many each has. Only hashes of words
    and, once for each part of the documents, the vectors of its words are shuffled; documents with the same key stay apart."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = docs.where("words is not null").select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), key, F.transform(F.array_compact("words"), lambda w: F.xxhash64(w)).alias("cells"))
    wanted = cells.select("part", F.explode(F.array_distinct("cells")).alias("h")).distinct()
    found = wanted.join(vectors.where("token is not null and vec is not null").select(F.xxhash64("token").alias("h"), "vec"), "h")
    kind, kinds = dict(cells.dtypes)[key], dict(found.dtypes)["vec"]
    rows = found.select("part", F.lit(None).cast(kind).alias(key), "h", "vec", F.lit(None).cast("array<bigint>").alias("cells"))
    rows = rows.unionByName(cells.select("part", key, F.lit(None).cast("long").alias("h"), F.lit(None).cast(kinds).alias("vec"), "cells"))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions(F.asc_nulls_last("h"))

    def run(batches):
        h, vec, at = [], [], None
        for b in batches:
            words = b.column(2)
            n = len(words) - words.null_count  # these come first
            if n:
                h.append(words.slice(0, n).to_numpy())
                vec.append(b.column(3).slice(0, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
            if n == b.num_rows or not len(h):
                continue
            at = at or (np.concatenate(h), np.concatenate(vec))
            keys, lists = b.column(1).slice(n), b.column(4).slice(n)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            low = 0
            while low < len(keys):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + VECTORS_AT_ONCE, side="right")) - 1)
                own = flat[offsets[low] : offsets[high]]
                near = np.searchsorted(at[0], own).clip(0, len(at[0]) - 1)
                known = at[0][near] == own
                count = np.diff(np.r_[0, np.cumsum(known)][offsets[low : high + 1] - offsets[low]])
                some = count > 0
                yield pa.RecordBatch.from_arrays([keys.slice(low, high - low).filter(pa.array(some)), made(at[1][near[known]].astype(float), count[some])], [key, "made"])
                low = high

    return rows.mapInArrow(run, f"`{key}` {kind}, made {schema}")


def _lists(flat: pa.Array, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), flat)


def embedded(docs: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, x)``: the vectors of each document's words in order; words without a vector are left out."""
    made = lambda x, n: _lists(_lists(pa.array(x.ravel()), np.full(len(x), x.shape[1])), n)
    return _looked_up(docs, vectors, key, made, "array<array<double>>").withColumnRenamed("made", "x")


#: Query rows that are sent to the executors at a time; of more, as many blocks are run as it takes.
QUERY_BLOCK = 20_000


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """``(qid, vid, cos)``: the ``k`` nearest of ``vectors(vid, vec)`` to each of ``query(qid, q)`` by cosine, ties by id, the row itself left out.

    Queries go to the executors in blocks of bounded size and meet parts of batches there; for each query only ``k`` rows leave a task. Null vectors
    are left out; a zero vector is at cosine 0 to all.
    """
    query = query.where("q is not null")
    blocks = max(1, -(-query.count() // QUERY_BLOCK))
    parts = [_nearest(vectors, query.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i), k) for i in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


#: Cosines that a task holds at a time.
CELLS = 2_000_000


def _first(cos: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ``k`` greatest cosines and their ids, ties by id, in no order unless there are ties at the edge."""
    if cos.shape[1] <= k:
        return cos, vid
    edge = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
    keep = cos >= edge[:, None]
    row = np.flatnonzero(keep.sum(1) > k)
    if len(row):
        # More stand at the edge than fit: of these the least ids count.
        order = np.lexsort((vid[row], -cos[row]), axis=1)[:, :k]
        keep[row] = False
        keep[row[:, None], order] = True
    return cos[keep].reshape(len(cos), k), vid[keep].reshape(len(cos), k)


def _nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    rows = query.select("qid", "q").collect()
    ids = np.array([r.qid for r in rows], dtype=np.int64)
    q = np.array([r.q for r in rows], dtype=float)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12) if len(q) else q
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = shared.value
        best = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            if not len(ids):
                continue
            vid = b.column(0).to_numpy()
            flat = b.column(1).values.to_numpy(zero_copy_only=False)
            at = b.column(1).offsets.to_numpy()
            v = flat[at[0] : at[-1]].reshape(len(vid), -1) if len(vid) else np.zeros((0, q.shape[1]))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            # As many rows meet all queries at a time as make a table of bounded size.
            step = max(1, CELLS // len(ids))
            for low in range(0, len(vid), step):
                cos = q @ v[low : low + step].T
                near = np.broadcast_to(vid[low : low + step], cos.shape)
                cos[ids[:, None] == near] = -2.0
                best = _first(np.concatenate([best[0], cos], 1), np.concatenate([best[1], near], 1), k)
        if best[0].shape[1]:
            a = np.repeat(ids, best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best[1].ravel()), pa.array(best[0].ravel())], ["qid", "vid", "cos"])

    best = vectors.where("vec is not null").select("vid", "vec").mapInArrow(run, "qid long, vid long, cos double").where("cos > -2")
    w = Window.partitionBy("qid").orderBy(F.desc("cos"), "vid")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def api_vectors(rows: DataFrame, key: str, size: int = 256) -> DataFrame:
    """``(key, vec)``: hashed counts of ``rows(key, words)`` weighted by how few rows hold a word."""
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=size).transform(rows.where("words is not null").select(key, "words"))
    return IDF(inputCol="tf", outputCol="weighted").fit(counted).transform(counted).select(key, vector_to_array("weighted").alias("vec"))


def mean_vectors(docs: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, vec)``: the mean of the vectors of each document's words; documents without any have no row."""

    def made(x, n):
        means = np.add.reduceat(x, np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None] if len(n) else x
        return _lists(pa.array(means.ravel()), np.full(len(n), x.shape[1]))

    return _looked_up(docs, vectors, key, made, "array<double>").withColumnRenamed("made", "vec")


def baseline_scores(train: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """``(key, p)`` of ``samples(key, vec)`` by logistic regression on ``train(vec, label)``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fit = LogisticRegression(maxIter=50, regParam=0.001).fit(train.select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label")))
    scored = fit.transform(samples.select(key, array_to_vector("vec").alias("features")))
    return scored.select(key, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def similar_words(vectors: DataFrame, word: str, k: int = 10) -> DataFrame:
    """``(token, cos)``: the ``k`` words whose vectors are nearest to that of a word, itself left out; none for an unknown word."""
    found = vectors.where(F.col("token") == word).select("vec").head(1)
    if not found:
        return vectors.limit(0).select("token", F.lit(0.0).alias("cos"))
    q = np.array(found[0].vec)
    q = q / max(float(np.linalg.norm(q)), 1e-12)
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    dot = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    near = vectors.where(F.col("token") != word).select("token", (dot / F.greatest(size, F.lit(1e-12))).alias("cos"))
    return near.orderBy(F.desc("cos"), "token").limit(k)
