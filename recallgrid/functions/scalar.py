"""Column functions: softmax weights, mixing, losses, entropies, byte formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def nll(p: Column, mode: str = "add", eps: float = EPS) -> Column:
    """Negative log-likelihood: ``add`` puts eps inside the log, ``clamp`` bounds p from below."""
    return -F.ln(p + eps) if mode == "add" else -F.ln(F.greatest(p, F.lit(eps)))


def nll_or_null(p: Column) -> Column:
    """-ln p, null where p is zero: an infinite loss is no number here."""
    return F.when(p > 0, -F.ln(p))


def interpolate(p: Column, p_lm: Column, alpha: Column | float) -> Column:
    """alpha is the weight of retrieval."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return a * p + (1 - a) * p_lm


def softmax_weights(nbr: DataFrame, tau: Column | float, by: list[str], out: str = "w", dist: str = "dist") -> DataFrame:
    """Add exp(-(d - dmin) / tau) normalised over ``by``."""
    t = F.lit(float(tau)) if isinstance(tau, (int, float)) else tau
    group = Window.partitionBy(*by)
    e = F.exp(-(F.col(dist) - F.min(dist).over(group)) / t)
    return nbr.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(group)).drop("_e")


def weights_of(kernel: Column, nbr: DataFrame, by: list[str], out: str) -> DataFrame:
    """Add a kernel normalised over ``by``."""
    return nbr.withColumn("_e", kernel).withColumn(out, F.col("_e") / F.sum("_e").over(Window.partitionBy(*by))).drop("_e")


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def unrolled_sq_dist(a: str, b: str, dims: int) -> Column:
    """The same as one sum of ``dims`` terms, which stays inside generated code."""
    return reduce(lambda p, q: p + q, [(F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(dims)])


def cosine(a: str, b: str) -> Column:
    norm = lambda c: F.greatest(F.sqrt(dot(c, c)), F.lit(1e-12))
    return dot(a, b) / (norm(a) * norm(b))


def raw_bytes(n: Column, d: Column | int) -> Column:
    """N entries of a float32 key and an int64 value."""
    return n * (4 * d + 8)


def compressed_bytes(b: Column, nnz: Column, d: Column | int) -> Column:
    """Sparse layout: float32 keys, 8 bytes a non-zero count, int32 row offsets."""
    return b * 4 * d + nnz * 8 + (b + 1) * 4


def guarded_ratio(num: Column, den: Column, least: float = 0.0) -> Column:
    return F.when(den > least, num / den)


def signature(ids: Column) -> Column:
    """SHA-256 of sorted ids."""
    return F.sha2(F.concat_ws(",", F.transform(F.array_sort(ids), lambda v: v.cast("string"))), 256)
