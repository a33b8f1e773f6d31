"""Metrics, losses and activations as SQL expressions; ``p`` is a prediction between 0 and 1, ``y`` the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-8
EPS = 1e-7


def confusion(rows: DataFrame, y: str, p: str, *by: str, threshold: float = 0.5) -> DataFrame:
    """``(by..., tp, fp, fn, tn)``; a prediction counts as positive from the threshold on. Rows with a null on either side are left out."""
    guess, truth = F.col(p) >= threshold, F.col(y) == 1
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    counts = [one(truth & guess).alias("tp"), one(~truth & guess).alias("fp"), one(truth & ~guess).alias("fn"), one(~truth & ~guess).alias("tn")]
    return rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(*counts)


def rates(counts: DataFrame) -> DataFrame:
    """The counts with false positive and negative rate, accuracy, precision, recall, F1 and the correlation of Matthews; 0 where nothing counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    named = {"fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp), "accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn)}
    named |= {"f1": share(2 * tp, 2 * tp + fp + fn), "mcc": share(tp * tn - fp * fn, spread)}
    return counts.withColumns({k: F.round(v, 9) for k, v in named.items()})


def f_beta(counts: DataFrame, beta: float) -> DataFrame:
    """The counts with ``f_beta``; with no true positive it is 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r, b = tp / (tp + fp + TINY), tp / (tp + fn + TINY), beta * beta
    return counts.withColumn("f_beta", F.round((1 + b) * p * r / (b * p + r + TINY), 9))


def outcomes(rows: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Rows with their ``outcome``: tp, fp, fn or tn."""
    guess, truth = F.col(p) >= threshold, F.col(y) == 1
    return rows.withColumn("outcome", F.when(truth & guess, "tp").when(guess, "fp").when(truth, "fn").otherwise("tn"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """``(mean, n)`` over batches: means weighted by size, sizes added up."""
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("n"))


def _clip(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


# Losses of one sample with one value; average them for a batch.
LOSSES = {
    "mean_squared_error": lambda y, p: F.pow(p - y, F.lit(2.0)),
    "mean_absolute_error": lambda y, p: F.abs(p - y),
    "mean_absolute_percentage_error": lambda y, p: 100 * F.abs((y - p) / F.greatest(F.abs(y), F.lit(EPS))),
    "mean_squared_logarithmic_error": lambda y, p: F.pow(F.log1p(F.greatest(p, F.lit(EPS))) - F.log1p(F.greatest(y, F.lit(EPS))), F.lit(2.0)),
    "squared_hinge": lambda y, p: F.pow(F.greatest(1 - y * p, F.lit(0.0)), F.lit(2.0)),
    "hinge": lambda y, p: F.greatest(1 - y * p, F.lit(0.0)),
    "logcosh": lambda y, p: (p - y) + F.log1p(F.exp(-2 * (p - y))) - F.log(F.lit(2.0)),
    "binary_crossentropy": lambda y, p: -(y * F.log(_clip(p)) + (1 - y) * F.log(1 - _clip(p))),
    "kullback_leibler_divergence": lambda y, p: _clip(y) * F.log(_clip(y) / _clip(p)),
    "poisson": lambda y, p: p - y * F.log(p + EPS),
}

# Losses of one sample with a vector of values.
VECTOR_LOSSES = {
    "categorical_crossentropy": lambda y, p: -F.aggregate(F.zip_with(y, p, lambda a, b: a * F.log(_clip(b))), F.lit(0.0), lambda s, x: s + x),
    "sparse_categorical_crossentropy": lambda y, p: -F.log(_clip(F.get(p, y))),
    "categorical_hinge": lambda y, p: F.greatest(
        F.lit(0.0),
        F.array_max(F.zip_with(y, p, lambda a, b: (1 - a) * b)) - F.aggregate(F.zip_with(y, p, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + 1,
    ),
    "cosine_proximity": lambda y, p: -dot(normalized(y), normalized(p)),
}

ACTIVATIONS = {
    "linear": lambda x: x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)),
    "selu": lambda x: 1.0507009873554805 * F.when(x > 0, x).otherwise(1.6732632423543772 * F.expm1(x)),
    "softplus": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
    "softsign": lambda x: x / (1 + F.abs(x)),
    "tanh": lambda x: F.tanh(x),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "hard_sigmoid": lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 * x + 0.5)),
}


def softmax(x: Column) -> Column:
    """The softmax of an array, shifted by its greatest value."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(x: Column) -> Column:
    """An array of length 1; a null vector stays as it is."""
    size = F.sqrt(dot(x, x))
    return F.transform(x, lambda v: v.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))


def one_hot(label: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == label).cast("int"))


def in_top_k(p: Column, y: Column, k: int) -> Column:
    """Whether fewer than ``k`` values are greater than that of the true class."""
    return F.size(F.filter(p, lambda v: v > F.get(p, y))) < k


def verdicts(rows: DataFrame) -> DataFrame:
    """``(case_id, function, outcomes)`` from ``rows(case_id, sample_id, functions, outcome)``: the verdicts on each function in order of samples."""
    each = rows.select("case_id", "sample_id", F.explode("functions").alias("function"), "outcome")
    cell = F.sort_array(F.collect_list(F.struct("sample_id", "outcome")))
    return each.groupBy("case_id", "function").agg(F.transform(cell, lambda x: x["outcome"]).alias("outcomes"))
