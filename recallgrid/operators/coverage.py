"""Sequential selections: one pass over the store for each entry chosen."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def farthest_first(rows: DataFrame, count: int) -> DataFrame:
    """``(step, pos_id, dist)`` from the lowest id on; ties to the lower id.

    Each task keeps nothing: the chosen vectors (``count`` of them at most) are broadcast, a scan
    computes every entry's distance to the nearest of them, and one aggregate finds the farthest.
    """
    spark = rows.sparkSession
    first = rows.orderBy("pos_id").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "step int, pos_id long, dist double")
    chosen = [(0, first[0]["pos_id"], 0.0)]
    vectors = [np.array(first[0]["x"], float)]
    for step in range(1, count):
        shared = spark.sparkContext.broadcast(np.array(vectors))

        def far(batches, shared=shared):
            import pyarrow as pa

            from .vectors import matrix

            c = shared.value
            for b in batches:
                if b.num_rows:
                    m = matrix(b.column(1))
                    d = np.sqrt(np.min([((m - v) ** 2).sum(1) for v in c], axis=0))
                    ids = b.column(0).to_numpy()
                    i = int(np.lexsort((ids, -d))[0])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1]), pa.array(d[i : i + 1]), b.column(1).slice(i, 1)], names=["pos_id", "dist", "x"])

        found = rows.select("pos_id", "x").mapInArrow(far, "pos_id long, dist double, x array<double>")
        best = found.orderBy(F.col("dist").desc(), "pos_id").limit(1).collect()
        if not best or best[0]["dist"] == 0:
            break
        chosen.append((step, best[0]["pos_id"], best[0]["dist"]))
        vectors.append(np.array(best[0]["x"], float))
    return spark.createDataFrame(chosen, "step int, pos_id long, dist double")
