"""Building stores: partitions of raw entries, their prototypes and token distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import draw, pick
from .ranking import with_rank
from .vectors import closest, matrix, nearest, nearest_sums, vector_sums

#: Prototypes (rows times dimensions) that the driver may hold between two Lloyd steps: 512 MB.
CENTROID_NUMBERS = 64_000_000


def frame(spark: SparkSession, ids, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(ids, centres)], "cluster_id long, x array<double>")


def assign_nearest(rows: DataFrame, proto: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(pos_id, cluster_id, dist)``: nearest prototype, ties to the lower id; ``carry`` names columns kept.

    The prototypes are the broadcast side: one pass over the rows and no shuffle of them.
    """
    spark = rows.sparkSession
    carry = carry or []
    if (proto.agg(F.sum(F.size("x"))).first()[0] or 0) > CENTROID_NUMBERS:  # counted before any of them moves
        near = nearest(rows, proto.select(F.col("cluster_id").alias("pos_id"), "x"), 1)
        near = near.select(F.col("query_id").alias("pos_id"), F.col("entry_id").alias("cluster_id"), "dist")
        return near.join(rows.select("pos_id", *carry), "pos_id") if carry else near
    got = proto.select("cluster_id", "x").toArrow()
    ids, m = got["cluster_id"].to_numpy(), matrix(got["x"])
    order = np.argsort(ids)
    shared = spark.sparkContext.broadcast((ids[order], m[order] if len(ids) else m))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                best, d = closest(matrix(b.column(1)), *shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(d), *b.columns[2:]], names=["pos_id", "cluster_id", "dist", *carry])

    read = rows.select(F.col("pos_id").cast("long"), "x", *carry)
    fields = [T.StructField("pos_id", T.LongType()), T.StructField("cluster_id", T.LongType()), T.StructField("dist", T.DoubleType()), *(rows.schema[c] for c in carry)]
    return read.mapInArrow(run, T.StructType(fields))


def lloyd(rows: DataFrame, clusters: int, steps: int = 3, order: Column | None = None) -> DataFrame:
    """Prototypes ``(cluster_id, x)`` after a fixed number of Lloyd steps from the first ids, or the first in ``order``.

    A step is one scan that assigns and adds up in the same task, so vectors are never shuffled; only
    the prototypes pass through the driver and the plan doesn't grow. An empty cluster keeps its centre. More than
    ``CENTROID_NUMBERS`` numbers of prototypes are refused before they are read.
    """
    wide = rows.select(F.size("x").alias("n")).limit(1).collect()
    if wide and clusters * wide[0]["n"] > CENTROID_NUMBERS:
        raise ValueError(f"{clusters} prototypes of {wide[0]['n']} dimensions are over {CENTROID_NUMBERS} numbers")
    first = rows.select("pos_id", "x").orderBy(*([] if order is None else [order]), "pos_id").limit(clusters).toArrow()
    ids, m = np.arange(first.num_rows), matrix(first["x"]).copy()
    for _ in range(steps):
        for r in nearest_sums(rows, ids, m).collect() if len(ids) else []:
            m[r["cluster_id"]] = np.array(r["s"]) / r["n"]
    return frame(rows.sparkSession, ids, m)


def distribution(assigned: DataFrame, weight: Column | None = None) -> DataFrame:
    """``(cluster_id, token, cnt)`` of rows with ``cluster_id`` and ``y``; weights make fractional counts."""
    cnt = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    return assigned.groupBy("cluster_id", F.col("y").alias("token")).agg(cnt.alias("cnt"))


def with_totals(proto: DataFrame, dist: DataFrame) -> DataFrame:
    """Prototypes and their total counts; an empty cluster stays with total 0."""
    totals = dist.groupBy("cluster_id").agg(F.sum("cnt").alias("total"))
    return proto.join(totals, "cluster_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def random_clusters(rows: DataFrame, clusters: int, salt: int = 0) -> DataFrame:
    return rows.withColumn("cluster_id", pick(F.col("pos_id"), clusters, salt))


def means(assigned: DataFrame, clusters: int, dims: int) -> DataFrame:
    """Mean vectors of all cluster numbers; an empty one is the zero vector."""
    got = vector_sums(assigned, "cluster_id").select("cluster_id", F.transform("s", lambda v: v / F.col("n")).alias("x"))
    every = assigned.sparkSession.range(clusters).withColumnRenamed("id", "cluster_id")
    return every.join(got, "cluster_id", "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), dims)))


def medoids(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """The entry nearest its prototype in each cluster: ``(cluster_id, pos_id, dist)``."""
    best = F.min(F.struct("dist", "pos_id"))
    return assigned.groupBy("cluster_id").agg(best.alias("b")).select("cluster_id", F.col("b.pos_id").alias("pos_id"), F.col("b.dist").alias("dist"))


def unigram(rows: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``(token, p)``: share of each token; tokens of ``vocab`` never seen have 0."""
    counts = rows.groupBy(F.col("y").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    if vocab is not None:
        counts = vocab.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_tokens(dist: DataFrame, n: int) -> DataFrame:
    """The n largest counts of each cluster, ties to the lower token."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("cnt").desc(), "token")
    return dist.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def conditional_counts(rows: DataFrame, *given: str) -> DataFrame:
    """Joint counts of tokens given one to three cluster ids."""
    return rows.groupBy(*given, F.col("y").alias("token")).agg(F.count(F.lit(1)).alias("cnt"))


def shuffled_contents(dist: DataFrame) -> DataFrame:
    """Tokens dealt out anew over all (cluster, count) cells: rows numbered by id meet rows numbered by hash."""
    a = with_rank(dist, "cluster_id", ["token"], "i").select("i", "cluster_id", "cnt")
    keyed = dist.select("cluster_id", "token", draw(F.col("cluster_id") * 1000 + F.col("token")).alias("_key"))
    b = with_rank(keyed, "_key", ["cluster_id", "token"], "i").select("i", "token")
    return a.join(b, "i").groupBy("cluster_id", "token").agg(F.sum("cnt").alias("cnt"))
