"""Learned parts: reward regressors and linear heads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .em import SLICES, added, sliced
from .vectors import matrix


#: Rows that a task of a regressor's fit holds on average.
FIT_ROWS = 50_000


def gate(rows: DataFrame, features: list[str], target: str, fit_split: str = "ct", seed: int = 42) -> DataFrame:
    """Rows with ``predicted``: a boosted-tree regressor of the target fitted on one split.

    Features and target are standardised; a constant feature keeps its value. The rows are made once, and the fit, about a hundred
    jobs whose every task reports to the driver, runs in as many tasks as its rows need, not as many as the tables were read in.
    """
    rows = rows.persist()
    rows = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows.where(F.col("split") == fit_split)).transform(rows).drop("_raw")
    s = scaled.where(F.col("split") == fit_split).agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s"), F.count(F.lit(1)).alias("n")).first()
    spread = s["s"] if s["s"] and s["s"] >= 1e-8 else 1.0
    fit = scaled.where(F.col("split") == fit_split).withColumn("_y", (F.col(target) - s["m"]) / spread).select("_x", "_y")
    fit = fit.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-s["n"] // FIT_ROWS)))
    model = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_z", maxIter=20, maxDepth=4, seed=seed).fit(fit)
    return model.transform(scaled).withColumn("predicted", F.col("_z") * spread + s["m"]).drop("_x", "_z")


def softmax_head(train: DataFrame, rows: DataFrame, label: str = "y", x: str = "x", steps: int = 60, ridge: float = 1e-3) -> DataFrame:
    """Rows with ``p_head``: a bias-free multinomial head's probability of the true token."""
    to = lambda d: d.withColumn("_x", array_to_vector(F.col(x))).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", fitIntercept=False, maxIter=steps, regParam=ridge).fit(to(train))
    got = model.transform(to(rows))
    p = vector_to_array("probability")
    return got.withColumn("p_head", F.coalesce(F.try_element_at(p, (F.col(label) + 1).cast("int")), F.lit(0.0))).drop("_x", "_y", "rawPrediction", "probability", "prediction")


def trained_head(
    train: DataFrame, tune: DataFrame, rows: DataFrame, label: str = "y", x: str = "x", epochs: int = 30, rate: float = 0.05, patience: int = 5, gain: float = 1e-5
) -> tuple[DataFrame, list[dict]]:
    """Rows with ``p_head``, and the history, of a bias-free head trained by Adam on whole-table gradients.

    The state with the least cross-entropy on ``tune`` is kept, and training ends after ``patience`` epochs without a gain of
    ``gain``. An epoch is one scan of both tables in which tasks add up losses and gradients; only the head (classes
    times dimensions) passes through the driver. A class is a label of ``train``; another label, or a null one, has
    probability 0 and counts in ``tune`` as a probability of 1e-12. Rows of ``train`` with a null label aren't learnt from.
    """
    spark = train.sparkSession
    classes = np.array([r[0] for r in train.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("c")).distinct().orderBy("c").collect()], np.int64)
    none = rows.withColumn("p_head", F.lit(0.0))
    width = train.select(F.size(x).alias("d")).limit(1).collect()
    if not len(classes) or not width:
        return none, []
    b, d = len(classes), width[0]["d"]
    both = train.select(F.lit(True).alias("t"), F.col(label).cast("long").alias("c"), F.col(x).alias("x"))
    both = both.unionByName(tune.select(F.lit(False).alias("t"), F.col(label).cast("long").alias("c"), F.col(x).alias("x")))
    head, first, second = np.zeros((b, d)), np.zeros((b, d)), np.zeros((b, d))
    best, least, still, history = head, np.inf, 0, []
    for epoch in range(epochs + 1):  # the last pass only scores the last step
        shared = spark.sparkContext.broadcast((head, classes))
        got = added(both.mapInArrow(lambda batches, s=shared: _gradient(batches, *s.value), SLICES), b * d + 4)
        shared.unpersist()
        (loss, n, tuned, m), grad = got[-4:], got[:-4].reshape(b, d) / max(1.0, got[-3])
        loss, tuned = loss / max(1.0, n), tuned / max(1.0, m)
        history.append({"epoch": epoch, "train_nll": float(loss), "ct_nll": float(tuned)})
        if tuned < least - gain:
            best, least, still = head, tuned, 0
        else:
            still += 1
        if still >= patience or epoch == epochs:
            break
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        head = head - rate * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    shared = spark.sparkContext.broadcast((best, classes))

    def score(batches):
        head, classes = shared.value
        for batch in batches:
            if batch.num_rows:
                p, known, _ = _own(matrix(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1), head, classes)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.where(known, p, 0.0))], names=[*batch.schema.names[:-2], "p_head"])

    fed = rows.withColumns({"_x": F.col(x), "_c": F.col(label).cast("long")})
    return fed.mapInArrow(score, none.schema), history


def _own(v: np.ndarray, labels: pa.Array, head: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Probability of each row's own class, whether it is a class, and all probabilities with the class numbers."""
    c = labels.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(classes, c), len(classes) - 1)
    known = (classes[at] == c) & labels.is_valid().to_numpy(zero_copy_only=False)
    z = v @ head.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p[np.arange(len(p)), at], known, (p, at)


def _gradient(batches, head: np.ndarray, classes: np.ndarray):
    grad, sums = np.zeros(head.shape), np.zeros(4)
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            v = matrix(part.column(2))
            own, known, (p, at) = _own(v, part.column(1), head, classes)
            train = part.column(0).to_numpy(zero_copy_only=False)
            learn = train & known
            sums += [-np.log(own[learn]).sum(), learn.sum(), -np.log(np.where(known, np.maximum(own, 1e-12), 1e-12)[~train]).sum(), (~train).sum()]
            p[np.arange(len(p)), at] -= 1
            grad += p[learn].T @ v[learn]
    yield from sliced(np.concatenate([grad.ravel(), sums]))
