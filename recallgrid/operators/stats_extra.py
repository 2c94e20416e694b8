"""Divergences, information measures and clusterings compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import entropy_term


def align(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both distributions over the union of their support: pa and pb, zero-filled."""
    rows = a.withColumnRenamed("p", "pa").join(b.withColumnRenamed("p", "pb"), keys, "full_outer")
    return rows.withColumn("pa", F.coalesce("pa", F.lit(0.0))).withColumn("pb", F.coalesce("pb", F.lit(0.0)))


def js_divergence(a: DataFrame, b: DataFrame, group: str = "query_id", token: str = "token") -> DataFrame:
    """Jensen-Shannon divergence in nats of two long distributions."""
    rows = align(a.select(group, token, "p"), b.select(group, token, "p"), [group, token])
    m = (F.col("pa") + F.col("pb")) / 2
    half = lambda p: F.when(F.col(p) > 0, F.col(p) * F.ln(F.col(p) / m)).otherwise(0.0)
    return rows.groupBy(group).agg((F.sum(half("pa")) / 2 + F.sum(half("pb")) / 2).alias("js"))


def shape(dist: DataFrame, group: str, p: str = "p", token: str = "token") -> DataFrame:
    """Entropy, effective support, purity, support size, top token (ties to the lower)."""
    h = F.sum(entropy_term(F.col(p)))
    top = F.min_by(token, F.struct((-F.col(p)).alias("o"), F.col(token).alias("t")))
    return dist.groupBy(group).agg(h.alias("entropy"), F.exp(h).alias("effective"), F.max(p).alias("purity"), F.count(F.when(F.col(p) > 0, 1)).alias("support"), top.alias("top1"))


def entropies(counts: DataFrame, given: list[str], token: str = "token") -> DataFrame:
    """H(token | given) from joint counts, as one row (h, n)."""
    per = Window.partitionBy(*given) if given else Window.partitionBy()
    joint = counts.groupBy(*given, token).agg(F.sum("cnt").cast("double").alias("c"))
    rows = joint.withColumn("g", F.sum("c").over(per))
    return rows.agg((-F.sum(F.col("c") * F.ln(F.col("c") / F.col("g"))) / F.sum("c")).alias("h"), F.sum("c").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def ari_nmi(cells: DataFrame) -> DataFrame:
    """Adjusted Rand index and mutual information (arithmetic mean) from contingency cells."""
    pairs = lambda c: c * (c - 1) / 2
    rows = cells.groupBy("a").agg(F.sum("n").cast("double").alias("m")).agg(F.sum(pairs(F.col("m"))).alias("pa"), F.sum(F.col("m") * F.ln("m")).alias("la"))
    cols = cells.groupBy("b").agg(F.sum("n").cast("double").alias("m")).agg(F.sum(pairs(F.col("m"))).alias("pb"), F.sum(F.col("m") * F.ln("m")).alias("lb"))
    both = cells.agg(F.sum("n").cast("double").alias("t"), F.sum(pairs(F.col("n"))).alias("pc"), F.sum(F.col("n") * F.ln("n")).alias("lc"))
    x = both.crossJoin(rows).crossJoin(cols)
    expected = F.col("pa") * F.col("pb") / pairs(F.col("t"))
    t = F.col("t")
    ha, hb = F.ln(t) - F.col("la") / t, F.ln(t) - F.col("lb") / t
    mi = F.col("lc") / t - F.col("la") / t - F.col("lb") / t + F.ln(t)
    return x.select(((F.col("pc") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)).alias("ari"), (2 * mi / (ha + hb)).alias("nmi"))


def share_of(cond: Column) -> Column:
    return F.avg(cond.cast("int").cast("double"))
