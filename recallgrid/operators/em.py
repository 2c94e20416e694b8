"""Gaussian mixtures by EM: spherical, diagonal and tied diagonal covariances.

The parameters (components times dimensions) pass through the driver; a step is one scan in which
each task adds up sufficient statistics, so responsibilities are never stored while fitting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix

FLOOR = 1e-6
STEP = 4096
#: Numbers of one row of a task's sums.
SLICE = 8192
SLICES = "slice int, s binary"
_COMPONENTS = "component int, kind string, weight double, mean array<double>, var array<double>"


@dataclass(frozen=True)
class Mixture:
    kind: str
    weights: np.ndarray
    means: np.ndarray
    var: np.ndarray  # a row per component

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        inv = 1 / self.var
        gap = (x * x) @ inv.T - 2 * x @ (self.means * inv).T + (self.means**2 * inv).sum(1)
        const = np.log(np.maximum(self.weights, 1e-300)) - 0.5 * np.log(self.var).sum(1) - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return const - 0.5 * gap

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.log_joint(x)
        top = z.max(1, keepdims=True)
        total = top + np.log(np.exp(z - top).sum(1, keepdims=True))
        return np.exp(z - total), total[:, 0]


def start(rows: DataFrame, proto: DataFrame, assigned: DataFrame, kind: str) -> Mixture:
    """From hard clusters: their shares and centres, and one variance, the mean squared gap a dimension."""
    got = {r["cluster_id"]: np.array(r["x"], float) for r in proto.select("cluster_id", "x").collect()}
    ids = sorted(got)
    means = np.array([got[i] for i in ids])
    n = {r["cluster_id"]: r["n"] for r in assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    gap = assigned.agg(F.avg(F.col("dist") * F.col("dist")).alias("g")).first()["g"] or 1.0
    weights = np.array([n.get(i, 0) for i in ids], float)
    return Mixture(kind, weights / max(1.0, weights.sum()), means, np.full(means.shape, max(FLOOR, gap / means.shape[1])))


def statistics(rows: DataFrame, mix: Mixture, before: Mixture | None = None) -> tuple[np.ndarray, float, int, int]:
    """Sums of responsibilities, of x and of x squared for each component; log-likelihood, rows, changed."""
    shared = rows.sparkSession.sparkContext.broadcast((mix, before))
    b, d = mix.means.shape

    def run(batches):
        mix, before = shared.value
        out = np.zeros((b, 1 + 2 * d))
        ll, n, changed = 0.0, 0, 0
        for batch in batches:
            x = matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d))
            for a in range(0, len(x), STEP):
                part = x[a : a + STEP]
                g, total = mix.responsibilities(part)
                out[:, 0] += g.sum(0)
                out[:, 1 : 1 + d] += g.T @ part
                out[:, 1 + d :] += g.T @ (part * part)
                ll, n = ll + float(total.sum()), n + len(part)
                if before is not None:
                    changed += int((before.log_joint(part).argmax(1) != g.argmax(1)).sum())
        yield from sliced(np.concatenate([out.ravel(), [ll, float(n), float(changed)]]))

    flat = added(rows.select("x").mapInArrow(run, SLICES), b * (1 + 2 * d) + 3)
    return flat[:-3].reshape(b, -1), flat[-3], int(flat[-2]), int(flat[-1])


def sliced(flat: np.ndarray):
    """A task's sums as rows of raw numbers, a slice each, so that no row is made for a number."""
    cuts = range(0, len(flat), SLICE)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([flat[a : a + SLICE].astype("<f8").tobytes() for a in cuts], pa.binary())], names=["slice", "s"])


def added(parts: DataFrame, size: int) -> np.ndarray:
    """Slices of all tasks added up, each slice in a task of its own; ``size`` numbers come to the driver."""

    def add(t: pa.Table) -> pa.Table:
        # Sums of doubles depend on their order: sorted, so that a lost task's rerun changes nothing.
        rows = sorted(v.as_py() for v in t["s"])
        total = np.sum([np.frombuffer(v, "<f8") for v in rows], axis=0)
        return pa.table({"slice": t["slice"].slice(0, 1), "s": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    got = parts.groupBy("slice").applyInArrow(add, SLICES).toArrow()
    flat = np.zeros(size)
    for i, v in zip(got["slice"].to_pylist(), got["s"]):
        part = np.frombuffer(v.as_buffer(), "<f8")
        flat[i * SLICE : i * SLICE + len(part)] = part
    return flat


def save(mix: Mixture, spark, path: str, iteration: int) -> None:
    """A mixture as Parquet, a row a component, under ``path/iteration=...``."""
    rows = [(i, mix.kind, float(p), m.tolist(), v.tolist()) for i, (p, m, v) in enumerate(zip(mix.weights, mix.means, mix.var))]
    spark.createDataFrame(rows, _COMPONENTS).write.mode("overwrite").parquet(f"{path}/iteration={iteration}")


def load(spark, path: str, iteration: int) -> Mixture:
    """A mixture saved before."""
    got = spark.read.schema(_COMPONENTS).parquet(f"{path}/iteration={iteration}").orderBy("component").toArrow()
    return Mixture(got["kind"][0].as_py(), got["weight"].to_numpy(), matrix(got["mean"]), matrix(got["var"]))


def maximise(stats: np.ndarray, mix: Mixture, n: int) -> Mixture:
    """New parameters; a component without mass keeps its mean and variance."""
    d = mix.means.shape[1]
    mass = stats[:, 0]
    live = mass > 1e-9
    safe = np.where(live, mass, 1.0)[:, None]
    means = np.where(live[:, None], stats[:, 1 : 1 + d] / safe, mix.means)
    var = np.where(live[:, None], stats[:, 1 + d :] / safe - means**2, mix.var)
    if mix.kind == "spherical":
        var = np.broadcast_to(var.mean(1, keepdims=True), var.shape)
    elif mix.kind == "tied":
        var = np.broadcast_to((var * mass[:, None]).sum(0) / max(mass.sum(), 1e-300), var.shape)
    return Mixture(mix.kind, mass / max(1, n), means, np.maximum(var, FLOOR))


def fit(
    rows: DataFrame, mix: Mixture, steps: int, tol: float = 0.0, patience: int = 1, every: int = 0, path: str | None = None
) -> tuple[Mixture, list[dict]]:
    """EM for ``steps`` at most; stops after ``patience`` steps of relative gain below ``tol``.

    With ``every`` and ``path`` the mixture after each such number of steps, and the last, is saved; ``load`` gives it back to go on from.
    """
    history, before, still, last = [], None, 0, None
    keep = lambda done: path is not None and every > 0 and save(mix, rows.sparkSession, path, done)
    for i in range(steps):
        stats, ll, n, changed = statistics(rows, mix, before)
        mean = ll / max(1, n)
        history.append({"iteration": i, "mean_ll": float(mean), "dead": int((stats[:, 0] < 1e-9).sum()), "changed": changed / max(1, n) if before else None})
        before, mix = mix, maximise(stats, mix, n)
        if every and (i + 1) % every == 0:
            keep(i + 1)
        if last is not None:
            still = still + 1 if abs(mean - last) <= tol * max(abs(last), 1e-12) else 0
            if still >= patience:
                break
        last = mean
    if every and len(history) % every:
        keep(len(history))
    return mix, history


def responsibilities(rows: DataFrame, mix: Mixture, keep: float = 1e-12) -> DataFrame:
    """``(pos_id, y, cluster_id, gamma)`` for responsibilities of at least ``keep``."""
    shared = rows.sparkSession.sparkContext.broadcast(mix)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                g, _ = shared.value.responsibilities(matrix(batch.column(2)))
                i, c = np.nonzero(g >= keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(c.astype(np.int64)), pa.array(g[i, c])], names=["pos_id", "y", "cluster_id", "gamma"]
                )

    return rows.select("pos_id", "y", "x").mapInArrow(run, "pos_id long, y int, cluster_id long, gamma double")


def counterfactual(rows: DataFrame, mix: Mixture) -> DataFrame:
    """Components chosen by four nested rules: distance, + weight, + one variance each, + all variances."""
    shared = rows.sparkSession.sparkContext.broadcast(mix)

    def run(batches):
        mix = shared.value
        d = mix.means.shape[1]
        one = mix.var.mean(1)
        pooled = float((one * mix.weights).sum())
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                sq = (x * x).sum(1)[:, None] - 2 * x @ mix.means.T + (mix.means**2).sum(1)
                w = np.log(np.maximum(mix.weights, 1e-300))
                rules = [-sq, w - sq / (2 * pooled), w - 0.5 * d * np.log(one) - sq / (2 * one), mix.log_joint(x)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r.argmax(1)) for r in rules)], names=["pos_id", "near", "weighted", "spherical", "full"])

    return rows.select("pos_id", "x").mapInArrow(run, "pos_id long, near long, weighted long, spherical long, full long")


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row of a square matrix in the assignment of least total cost."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, prev, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]] = now[better]
            prev[free[better]] = j0
            j1 = free[int(np.argmin(least[free]))]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[prev[j0]]
            j0 = prev[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def agreement(cells: DataFrame, most: int = 4096) -> DataFrame:
    """``(n, agreed, agreement, size_corr)`` of two clusterings from their contingency ``cells(a, b, n)``.

    Clusters are matched one to one so that the rows both put together are as many as can be; ``size_corr`` is the
    correlation of the matched clusters' sizes, null where a side has no variance. The matrix of clusters is on the
    driver and bounded: more than ``most`` clusters on a side are refused before it is read.
    """
    spark = cells.sparkSession
    sides = [[r[0] for r in cells.select(c).distinct().orderBy(c).limit(most + 1).collect()] for c in ("a", "b")]
    if max(map(len, sides)) > most:
        raise ValueError(f"more than {most} clusters to match")
    schema = "n long, agreed long, agreement double, size_corr double"
    if not sides[0]:
        return spark.createDataFrame([], schema)
    size = max(map(len, sides))
    table = np.zeros((size, size))
    got = cells.toArrow()
    at = [{k: i for i, k in enumerate(side)} for side in sides]
    for a, b, n in zip(got["a"].to_pylist(), got["b"].to_pylist(), got["n"].to_pylist()):
        table[at[0][a], at[1][b]] += n
    match = hungarian(-table)
    agreed = float(sum(table[i, j] for i, j in enumerate(match)))
    one, two = table.sum(1), table.sum(0)[match]
    corr = float(np.corrcoef(one, two)[0, 1]) if size > 1 and one.std() > 0 and two.std() > 0 else None
    return spark.createDataFrame([(int(table.sum()), int(agreed), agreed / float(table.sum()), corr)], schema)


def principal(rows: DataFrame, dims: int = 2) -> DataFrame:
    """``(pos_id, pc)``: leading principal coordinates; a direction's largest entry is positive.

    The covariance is summed in the tasks; only a dimensions-squared matrix reaches the driver.
    """

    def run(batches):
        s = None
        for b in batches:
            if b.num_rows:
                x = np.hstack([np.ones((b.num_rows, 1)), matrix(b.column(0))])
                s = x.T @ x if s is None else s + x.T @ x
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = rows.select("x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    size = int(round(len(sums) ** 0.5))
    m = np.array([r["v"] for r in sums]).reshape(size, size)
    mean = m[0, 1:] / m[0, 0]
    _, vec = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    axes = vec[:, ::-1][:, :dims]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    shared = rows.sparkSession.sparkContext.broadcast((mean, axes))

    def project(batches):
        mean, axes = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((matrix(b.column(1)) - mean) @ axes).tolist(), pa.list_(pa.float64()))], names=["pos_id", "pc"])

    return rows.select("pos_id", "x").mapInArrow(project, "pos_id long, pc array<double>")


def two_means(rows: DataFrame, steps: int = 10) -> DataFrame:
    """Two halves of every cluster by Lloyd from its first member and the one farthest from it."""

    def run(t: pa.Table) -> pa.Table:
        o = np.argsort(t["pos_id"].to_numpy(), kind="stable")
        x = matrix(t["x"].combine_chunks())[o]
        c = np.array([x[0], x[((x - x[0]) ** 2).sum(1).argmax()]])
        side = np.zeros(len(x), int)
        for _ in range(steps):
            new = ((x - c[1]) ** 2).sum(1) < ((x - c[0]) ** 2).sum(1)
            if (new == side).all():
                break
            side = new.astype(int)
            c = np.array([x[side == s].mean(0) if (side == s).any() else c[s] for s in (0, 1)])
        cluster = t["cluster_id"][0].as_py()
        gap = float(np.sqrt(((c[0] - c[1]) ** 2).sum()))
        return pa.table({"cluster_id": [cluster], "n0": pa.array([int((side == 0).sum())], pa.int64()), "n1": pa.array([int((side == 1).sum())], pa.int64()), "gap": pa.array([gap], pa.float64())})

    return rows.select("cluster_id", "pos_id", "x").groupBy("cluster_id").applyInArrow(run, "cluster_id long, n0 long, n1 long, gap double")
