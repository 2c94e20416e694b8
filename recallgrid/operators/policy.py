"""Tuning, read policies, ablations, retention budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import interpolate, nll, softmax_weights


def grid_frame(spark, ks, taus) -> DataFrame:
    """(k, tau) pairs with their place in loop order."""
    rows = [(i * len(taus) + j, int(k), float(t)) for i, k in enumerate(ks) for j, t in enumerate(taus)]
    return spark.createDataFrame(rows, "place int, k int, tau double")


def raw_grid_probs(nbr: DataFrame, truth: DataFrame, grid: DataFrame) -> DataFrame:
    """True-token probability for every (k, tau) from one retrieval.

    The grid is a fixed small table: each neighbour row meets those pairs whose k reaches it, and
    one aggregate per query and pair gives numerator and denominator; no softmax window is needed.
    """
    near = nbr.groupBy("query_id").agg(F.min("dist").alias("d0"))
    rows = nbr.join(near, "query_id").join(truth, "query_id").join(F.broadcast(grid), F.col("rank") <= F.col("k"))
    e = F.exp(-(F.col("dist") - F.col("d0")) / F.col("tau"))
    keys = ["query_id", "split", "p_lm", "place", "k", "tau"]
    got = rows.groupBy(*keys).agg(F.sum(F.when(F.col("token") == F.col("y"), e).otherwise(0.0)).alias("a"), F.sum(e).alias("b"))
    return got.select(*keys, (F.col("a") / F.col("b")).alias("p"))


def state_grid_probs(snbr: DataFrame, truth: DataFrame, dist: DataFrame, proto: DataFrame, grid: DataFrame) -> DataFrame:
    """The same for the compressed store."""
    near = snbr.groupBy("query_id").agg(F.min("dist").alias("d0"))
    rows = snbr.join(near, "query_id").join(truth, "query_id").join(proto.select("cluster_id", "total"), "cluster_id")
    rows = rows.join(dist.select("cluster_id", F.col("token").alias("y"), "cnt"), ["cluster_id", "y"], "left")
    rows = rows.withColumn("ps", F.when(F.col("total") > 0, F.coalesce("cnt", F.lit(0.0)) / F.col("total")).otherwise(0.0))
    rows = rows.join(F.broadcast(grid), F.col("rank") <= F.col("k"))
    e = F.exp(-(F.col("dist") - F.col("d0")) / F.col("tau"))
    keys = ["query_id", "split", "p_lm", "place", "k", "tau"]
    got = rows.groupBy(*keys).agg(F.sum(e * F.col("ps")).alias("a"), F.sum(e).alias("b"))
    return got.select(*keys, (F.col("a") / F.col("b")).alias("p"))


def grid_losses(probs: DataFrame, alphas: DataFrame) -> DataFrame:
    """Mean loss of each (split, k, tau, alpha)."""
    rows = probs.crossJoin(F.broadcast(alphas)).withColumn("loss", nll(interpolate(F.col("p"), F.col("p_lm"), F.col("alpha"))))
    return rows.groupBy("split", "place", "k", "tau", "alpha").agg(F.avg("loss").alias("mean_nll"))


def best(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The least loss (at 9 digits) in loop order, of each group."""
    key = F.struct(F.round("mean_nll", 9).alias("m"), "place", "alpha")
    return losses.groupBy(*(by or [])).agg(F.min_by(F.struct("k", "tau", "alpha", "mean_nll"), key).alias("b")).select(*(by or []), "b.*")


def retained_members(assigned: DataFrame, m: int) -> DataFrame:
    """The m members nearest their prototype in each cluster."""
    order = Window.partitionBy("cluster_id").orderBy("dist", "pos_id")
    return assigned.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= m)


def allocate(assigned: DataFrame, priority: DataFrame, budget: int, cap: int | None = None, base: int = 0) -> DataFrame:
    """Members kept under a budget: clusters by priority, nearest members first.

    ``priority(cluster_id, score)``; higher first, ties to the lower id. ``cap`` bounds a cluster's
    take. ``base`` members of every cluster are kept beside the budget's rest, whatever the budget.
    A cluster is cut where the budget ends. Returns ``(cluster_id, take)`` for clusters taking any.
    """
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).join(priority, "cluster_id")
    sizes = sizes.withColumn("base", F.least(F.lit(base), F.col("n")))
    room = F.greatest(F.lit(0), F.lit(budget) - F.sum("base").over(Window.partitionBy()))
    want = F.col("n") - F.col("base")
    sizes = sizes.withColumn("room", room).withColumn("want", want if cap is None else F.greatest(F.lit(0), F.least(want, F.lit(cap) - F.col("base"))))
    order = Window.orderBy(F.col("score").desc(), "cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("want").over(order), F.lit(0)))
    take = F.col("base") + F.greatest(F.lit(0), F.least(F.col("want"), F.col("room") - F.col("before")))
    return sizes.withColumn("take", take.cast("long")).where("take > 0").select("cluster_id", "take")


def take_members(assigned: DataFrame, takes: DataFrame) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy("dist", "pos_id")
    return assigned.withColumn("rk", F.row_number().over(order)).join(takes, "cluster_id").where("rk <= take").select("pos_id", "cluster_id")


def action_grid(spark, ks, taus, alphas, betas) -> DataFrame:
    """Every (k, tau, alpha, beta) and the action of not reading at all, number 0."""
    rows = [(0, "base_only", 0, 1.0, 0.0, 0.0)]
    for k in ks:
        for t in taus:
            for a in alphas:
                for b in betas:
                    rows.append((len(rows), f"k{k}_t{t}_a{a}_b{b}", int(k), float(t), float(a), float(b)))
    return spark.createDataFrame(rows, "action int, name string, k int, tau double, alpha double, beta double")


def rewards(snbr: DataFrame, truth: DataFrame, dist: DataFrame, proto: DataFrame, prior: DataFrame, actions: DataFrame) -> DataFrame:
    """``(query_id, split, action, reward)``: base loss minus the action's loss, clamped form.

    Each neighbour meets the read part of the grid (k, tau, beta) once; alphas come after the sums.
    """
    reads = actions.where("action > 0").select("k", "tau", "beta").distinct()
    near = snbr.groupBy("query_id").agg(F.min("dist").alias("d0"))
    rows = snbr.join(near, "query_id").join(truth, "query_id").join(proto.select("cluster_id", "total"), "cluster_id")
    rows = rows.join(dist.select("cluster_id", F.col("token").alias("y"), "cnt"), ["cluster_id", "y"], "left")
    rows = rows.join(prior.select(F.col("token").alias("y"), F.col("p").alias("g")), "y", "left")
    rows = rows.join(F.broadcast(reads), F.col("rank") <= F.col("k"))
    e = F.exp(-(F.col("dist") - F.col("d0")) / F.col("tau"))
    term = (F.coalesce("cnt", F.lit(0.0)) + F.col("beta") * F.coalesce("g", F.lit(0.0))) / (F.col("total") + F.col("beta") + 1e-12)
    p = rows.groupBy("query_id", "split", "p_lm", "k", "tau", "beta").agg((F.sum(e * term) / F.sum(e)).alias("p"))
    acted = p.join(F.broadcast(actions.where("action > 0")), ["k", "tau", "beta"])
    gain = nll(F.col("p_lm"), "clamp") - nll(interpolate(F.col("p"), F.col("p_lm"), F.col("alpha")), "clamp")
    none = truth.select("query_id", "split", F.lit(0).alias("action"), F.lit(0.0).alias("reward"))
    return acted.select("query_id", "split", "action", gain.alias("reward")).unionByName(none)


def observations(truth: DataFrame, snbr: DataFrame, dist: DataFrame, proto: DataFrame, tau: float) -> DataFrame:
    """Eleven label-free features of a query."""
    shape = dist.join(proto.select("cluster_id", "total"), "cluster_id").withColumn("pt", F.col("cnt") / F.col("total"))
    shape = shape.groupBy("cluster_id").agg((-F.sum(F.col("pt") * F.ln(F.col("pt") + 1e-12))).alias("h"), F.max("pt").alias("pur"), F.max("total").alias("total"), F.count(F.lit(1)).alias("support"))
    w = softmax_weights(snbr.where("rank <= 8"), tau, ["query_id"]).join(shape, "cluster_id")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    got = w.groupBy("query_id").agg(
        at(1, "dist").alias("d1"), (at(2, "dist") - at(1, "dist")).alias("gap"), F.avg(F.when(F.col("rank") <= 4, F.col("dist"))).alias("d4"), F.avg("dist").alias("d8"),
        at(1, "h").alias("h1"), at(1, "pur").alias("pur1"), F.sum(F.col("w") * F.col("h")).alias("hw"), F.sum(F.col("w") * F.col("pur")).alias("purw"),
        F.log1p(at(1, "total")).alias("size1"), F.max("w").alias("wmax"),
    )
    return truth.select("query_id", "split", "entropy").join(got, "query_id")
