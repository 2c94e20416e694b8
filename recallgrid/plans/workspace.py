"""The retrieval plan shared by the queries of one dataset: retrieve once, slice many times."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import interpolate, nll
from ..operators import read, store
from ..operators.vectors import nearest
from ..session import ship
from ..sources import ingest

CLUSTERS, STEPS, K_MAX = 16, 3, 50
#: Parameters used where a query doesn't tune them.
RAW_K, RAW_TAU, RAW_ALPHA = 20, 0.1, 0.25
STATE_K, STATE_TAU, STATE_ALPHA = 8, 0.1, 0.25
#: Grids, in the order that breaks ties.
GRID_K, GRID_TAU, GRID_ALPHA = (1, 5, 10, 20, 50), (0.02, 0.05, 0.1, 0.25, 0.5), (0.01, 0.05, 0.1, 0.25, 0.5)
STATE_GRID_K = (1, 4, 8, 16)


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def pos(self) -> DataFrame:
        return ingest.positions(self.spark, self.dir)

    @cached_property
    def ds(self) -> DataFrame:
        return self.pos.where("split = 'ds'")

    @cached_property
    def lm(self) -> DataFrame:
        """Token probabilities of the surrogate model at every position."""
        return ingest.surrogate_model(self.pos).persist()

    @cached_property
    def p_lm(self) -> DataFrame:
        rows = self.lm.join(self.pos.select("pos_id", F.col("y").cast("long").alias("y")), "pos_id")
        return rows.groupBy("pos_id").agg(
            F.sum(F.when(F.col("token") == F.col("y"), F.col("p")).otherwise(0.0)).alias("p_lm"), (-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("entropy")
        )

    @cached_property
    def q(self) -> DataFrame:
        """Tuning and evaluation queries with their base-model columns."""
        rows = self.pos.where("split <> 'ds'").join(self.p_lm, "pos_id")
        return rows.select(F.col("pos_id").alias("query_id"), "split", "chunk_id", "x", "y", "p_lm", "entropy").persist()

    @cached_property
    def keys(self) -> DataFrame:
        """Keys of the queries alone."""
        return self.pos.where("split <> 'ds'").select("pos_id", "x")

    @cached_property
    def truth(self) -> DataFrame:
        return self.q.drop("x")

    @cached_property
    def nbr(self) -> DataFrame:
        """The K_MAX nearest raw entries of every query, with their tokens."""
        got = nearest(self.keys, self.ds, K_MAX)
        return got.join(self.ds.select(F.col("pos_id").alias("entry_id"), F.col("y").alias("token")), "entry_id").persist()

    @cached_property
    def centres(self) -> DataFrame:
        return store.lloyd(self.ds, CLUSTERS, STEPS)

    @cached_property
    def assigned(self) -> DataFrame:
        """``(pos_id, cluster_id, dist, y)`` of every raw entry."""
        return store.assign_nearest(self.ds, self.centres, ["y"]).persist()

    @cached_property
    def dist(self) -> DataFrame:
        return store.distribution(self.assigned).persist()

    @cached_property
    def proto(self) -> DataFrame:
        return store.with_totals(self.centres, self.dist).persist()

    @cached_property
    def snbr(self) -> DataFrame:
        """All prototypes of every query in order of distance."""
        return self.state_nbr(self.centres).persist()

    def state_nbr(self, centres: DataFrame, k: int = CLUSTERS, queries: DataFrame | None = None) -> DataFrame:
        queries = self.keys if queries is None else queries.select(F.col("query_id").alias("pos_id"), "x")
        got = nearest(queries, centres.select(F.col("cluster_id").alias("pos_id"), "x"), k)
        return got.withColumnRenamed("entry_id", "cluster_id")

    @cached_property
    def unigram(self) -> DataFrame:
        return store.unigram(self.ds)

    @cached_property
    def raw_w(self) -> DataFrame:
        return read.first_k(self.nbr, RAW_K, RAW_TAU)

    @cached_property
    def state_w(self) -> DataFrame:
        return read.first_k(self.snbr, STATE_K, STATE_TAU)

    @cached_property
    def perq(self) -> DataFrame:
        """One row per query: standalone and mixed results of both stores."""
        raw = read.raw_prob(self.raw_w, self.truth).withColumnRenamed("p", "p_raw")
        state = read.state_prob(self.state_w, self.truth.select("query_id", "y"), self.dist, self.proto).select("query_id", F.col("p").alias("p_state"))
        d_raw = self.nbr.where("rank = 1").select("query_id", F.col("dist").alias("d_raw"))
        d_state = self.snbr.where("rank = 1").select("query_id", F.col("dist").alias("d_state"), F.col("cluster_id").alias("top1"))
        rows = raw.join(state, "query_id").join(d_raw, "query_id").join(d_state, "query_id")
        rows = rows.withColumn("nll_lm", nll(F.col("p_lm")))
        rows = rows.withColumn("nll_raw", nll(interpolate(F.col("p_raw"), F.col("p_lm"), RAW_ALPHA)))
        rows = rows.withColumn("nll_state", nll(interpolate(F.col("p_state"), F.col("p_lm"), STATE_ALPHA)))
        rows = rows.withColumn("delta_d", F.col("d_state") - F.col("d_raw")).withColumn("delta_l", F.round(F.col("nll_state") - F.col("nll_raw"), 9))
        return rows.persist()

    @cached_property
    def val(self) -> DataFrame:
        return self.perq.where("split = 'val'")


@lru_cache(maxsize=4)
def _workspace(app: str, sf_dir: str, spark: SparkSession) -> Workspace:
    return Workspace(spark, sf_dir)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of a dataset, kept for the session's next queries."""
    ship(spark)
    return _workspace(spark.sparkContext.applicationId, sf_dir, spark)


def forget() -> None:
    """Start anew: later queries build their own workspaces."""
    _workspace.cache_clear()
