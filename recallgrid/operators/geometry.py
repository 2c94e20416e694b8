"""Distances inside groups, group by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .vectors import NEAR, matrix

STEP = 1024


def _pairs(x: np.ndarray, a: int) -> np.ndarray:
    part = x[a : a + STEP]
    d = (part * part).sum(1)[:, None] - 2 * part @ x.T + (x * x).sum(1)[None, :]
    return np.maximum(d, 0)


def cluster_neighbours(rows: DataFrame, k: int) -> DataFrame:
    """``(pos_id, other)``: the k nearest other members of each member's cluster, ties to the lower id.

    One task per cluster, distances in blocks of ``STEP`` rows; clusters are as small as the store's
    compression makes them.
    """

    def near(t: pa.Table) -> pa.Table:
        ids, x = t["pos_id"].to_numpy(), matrix(t["x"].combine_chunks())
        own, other = [], []
        for a in range(0, len(ids), STEP):
            d = _pairs(x, a)
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            for i in range(len(d)):
                edge = np.partition(d[i], k - 1)[k - 1] if k < len(ids) else np.inf
                near = np.flatnonzero(d[i] <= edge + NEAR * NEAR * (edge + (x[a + i] ** 2).sum()))  # all that may tie with the last
                near = near[near != a + i]
                exact = np.sqrt(((x[near] - x[a + i]) ** 2).sum(1))
                near = near[np.lexsort((ids[near], exact))][:k]
                own += [ids[a + i]] * len(near)
                other += ids[near].tolist()
        return pa.table({"pos_id": pa.array(own, pa.int64()), "other": pa.array(other, pa.int64())})

    return rows.select("cluster_id", "pos_id", "x").groupBy("cluster_id").applyInArrow(near, "pos_id long, other long")


def mean_pair_distance(rows: DataFrame) -> DataFrame:
    """``(pairs, total)`` of distances between members of each (cluster, token) group."""

    def total(t: pa.Table) -> pa.Table:
        x = matrix(t["x"].combine_chunks())
        n = len(x)
        s = sum(float(np.sqrt(((x[i + 1 :] - x[i]) ** 2).sum(1)).sum()) for i in range(n - 1))
        return pa.table({"pairs": pa.array([n * (n - 1) // 2], pa.int64()), "total": pa.array([s], pa.float64())})

    return rows.select("cluster_id", "y", "x").groupBy("cluster_id", "y").applyInArrow(total, "pairs long, total double")
