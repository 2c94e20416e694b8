"""Keeping a compressed store's contents up to date from a stream of positions.

An addition of this engine: counts of (cluster, token) are plain additive state, so a stream of new
positions is assigned to fixed prototypes and counted with a watermark-free aggregation, or appended
batch by batch to a table whose sums are the distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import assign_nearest, distribution
from ..schema import POSITIONS


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """A stream of position files of the cache's schema."""
    return spark.readStream.schema(POSITIONS).parquet(path)


def running_sizes(stream: DataFrame, proto: DataFrame) -> DataFrame:
    """``(cluster_id, cnt)`` over all positions so far (update or complete output)."""
    return assign_nearest(stream, proto).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cnt"))


def append_counts(stream: DataFrame, proto: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch adds its counts under its number; a batch run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        rows = assign_nearest(batch, proto, ["y"])
        distribution(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_so_far(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cluster_id long, token int, cnt double, batch int").parquet(path).groupBy("cluster_id", "token").agg(F.sum("cnt").alias("cnt"))
