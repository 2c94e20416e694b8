"""Reading a store: weights of neighbours, probabilities of tokens, mixing with the base model.

Frames: ``nbr(query_id, rank, entry_id, dist)`` from ``vectors.nearest``; ``truth(query_id, y, p_lm)``;
``dist(cluster_id, token, cnt)`` and ``proto(cluster_id, x, total)`` from ``store``. A neighbour frame
over prototypes names them ``cluster_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import interpolate, nll, softmax_weights, sq_dist, unrolled_sq_dist, weights_of
from .vectors import NEAR, matrix

#: Queries and members of a cluster that meet in one task at most, and distances held at a time.
PART_QUERIES, PART_MEMBERS, HELD = 8192, 16_384, 1_000_000
#: Longest vectors whose distance is written out term by term.
UNROLL = 128


def first_k(nbr: DataFrame, k: int, tau: float) -> DataFrame:
    """The k nearest of a longer retrieval with softmax weights."""
    return softmax_weights(nbr.where(F.col("rank") <= k), tau, ["query_id"])


def raw_prob(weighted: DataFrame, truth: DataFrame) -> DataFrame:
    """``truth`` plus ``p``: weight of the neighbours holding the true token; exactly 0 without one.

    ``weighted`` has the neighbours' ``token``.
    """
    hit = weighted.join(truth.select("query_id", "y"), "query_id").groupBy("query_id").agg(F.sum(F.when(F.col("token") == F.col("y"), F.col("w")).otherwise(0.0)).alias("p"))
    return truth.join(hit, "query_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def state_terms(weighted: DataFrame, truth: DataFrame, dist: DataFrame, proto: DataFrame) -> DataFrame:
    """One row per query and retrieved cluster: weight, count of the true token, total of the cluster."""
    rows = weighted.join(truth.select("query_id", "y"), "query_id").join(proto.select("cluster_id", "total"), "cluster_id")
    own = dist.select("cluster_id", F.col("token").alias("y"), "cnt")
    return rows.join(own, ["cluster_id", "y"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0.0)))


def state_prob(weighted: DataFrame, truth: DataFrame, dist: DataFrame, proto: DataFrame, beta: float = 0.0, prior: DataFrame | None = None) -> DataFrame:
    """``truth`` plus ``p`` of the true token, with counts shrunk by ``beta`` towards ``prior(token, p)``.

    An empty cluster gives nothing at beta 0 and the prior otherwise; weights aren't renormalised.
    """
    rows = state_terms(weighted, truth, dist, proto)
    if beta > 0 and prior is not None:
        rows = rows.join(prior.select(F.col("token").alias("y"), F.col("p").alias("g")), "y", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
        term = (F.col("cnt") + beta * F.col("g")) / (F.col("total") + beta)
    else:
        term = F.when(F.col("total") > 0, F.col("cnt") / F.col("total")).otherwise(0.0)
    p = rows.groupBy("query_id").agg(F.sum(F.col("w") * term).alias("p"))
    return truth.join(p, "query_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def mix(probs: DataFrame, alpha: float, mode: str = "add", out: str = "nll") -> DataFrame:
    return probs.withColumn(out, nll(interpolate(F.col("p"), F.col("p_lm"), alpha), mode))


def raw_distribution(weighted: DataFrame) -> DataFrame:
    """``(query_id, token, p)`` over all tokens of the neighbours."""
    return weighted.groupBy("query_id", "token").agg(F.sum("w").alias("p"))


def state_distribution(weighted: DataFrame, dist: DataFrame, proto: DataFrame) -> DataFrame:
    rows = weighted.join(dist, "cluster_id").join(proto.where("total > 0").select("cluster_id", "total"), "cluster_id")
    return rows.groupBy("query_id", "token").agg(F.sum(F.col("w") * F.col("cnt") / F.col("total")).alias("p"))


def dense_prob(weighted: DataFrame, truth: DataFrame, top: DataFrame, proto: DataFrame, beta: float, prior: DataFrame) -> DataFrame:
    """The truncated form: counts of the top tokens only over the full total (+ beta + 1e-12)."""
    rows = state_terms(weighted, truth, top, proto)
    rows = rows.join(prior.select(F.col("token").alias("y"), F.col("p").alias("g")), "y", "left")
    term = (F.col("cnt") + beta * F.coalesce("g", F.lit(0.0))) / (F.col("total") + beta + 1e-12)
    return truth.join(rows.groupBy("query_id").agg(F.sum(F.col("w") * term).alias("p")), "query_id")


def triple_prob(nbr: DataFrame, truth: DataFrame, dist: DataFrame, tau: float) -> DataFrame:
    """A store of (cluster, token) pairs: weight count * exp(-(d - dmin) / tau) over what is retrieved."""
    rows = nbr.join(dist, "cluster_id")
    w = F.col("cnt") * F.exp(-(F.col("dist") - F.min("dist").over(Window.partitionBy("query_id"))) / tau)
    return raw_prob(weights_of(w, rows, ["query_id"], "w"), truth)


def member_terms(
    weighted: DataFrame, members: DataFrame, queries: DataFrame, kernel: str = "softmax", tau: float = 0.1, sigma: float = 1.0, project: Column | None = None, dims: int | None = None
) -> DataFrame:
    """Every member of every retrieved cluster with ``wm``, its inner weight within query and cluster.

    ``members(cluster_id, pos_id, mx, token)``, ``queries(query_id[, cluster_id], qx)``. Kernels: softmax of the distance,
    Gaussian of the squared distance, or uniform. ``project`` is a Column of qx and mx giving the squared
    distance, by default over the whole vectors; known ``dims`` keep that sum in generated code.
    """
    rows = weighted.select("query_id", "cluster_id", "w").join(members, "cluster_id")
    by = ["query_id", "cluster_id"]
    if kernel == "uniform":
        return weights_of(F.lit(1.0), rows, by, "wm")
    whole = unrolled_sq_dist("qx", "mx", dims) if dims and dims <= UNROLL else sq_dist("qx", "mx")
    on = ["query_id", "cluster_id"] if "cluster_id" in queries.columns else ["query_id"]
    rows = rows.join(queries, on).withColumn("sq", whole if project is None else project).drop("qx", "mx")
    group = Window.partitionBy(*by)
    if kernel == "gauss":
        return weights_of(F.exp(-(F.col("sq") - F.min("sq").over(group)) / (2 * sigma * sigma)), rows, by, "wm")
    return softmax_weights(rows.withColumn("dm", F.sqrt("sq")), tau, by, "wm", "dm")


def member_sums(
    weighted: DataFrame, members: DataFrame, queries: DataFrame, kernel: str = "softmax", tau: float = 0.1, sigma: float = 1.0,
    parts: tuple[int, int] = (PART_QUERIES, PART_MEMBERS),
) -> DataFrame:
    """``member_terms`` added up by token: ``(query_id, cluster_id, w, token, wm)``, which every reader of terms takes.

    A cluster's queries meet its members in one task, where distances are a matrix product, so a vector moves once
    for each cluster it is read in and no row is made for a pair. A cluster with more queries or members than ``parts`` is cut into parts whose
    pairs meet in tasks of their own; their sums, each relative to its own greatest score, then meet by query and token.
    The uniform kernel needs neither vectors nor pairs: its sums are the members' shares of each token.
    """
    if kernel == "uniform":
        return _uniform_sums(weighted, members)
    on = ["query_id", "cluster_id"] if "cluster_id" in queries.columns else ["query_id"]
    left = weighted.select("query_id", "cluster_id", "w").join(queries, on).select("cluster_id", "query_id", "w", "qx")
    right = members.select("cluster_id", "pos_id", "token", "mx")
    count = lambda d, name: d.groupBy("cluster_id").agg(F.count(F.lit(1)).alias(name))
    sizes = count(weighted, "nq").join(count(members, "nm"), "cluster_id")
    most = sizes.agg(F.max("nq").alias("q"), F.max("nm").alias("m")).first()
    cut = (most["q"] or 0) > parts[0] or (most["m"] or 0) > parts[1]
    keys = ["cluster_id"]
    if cut:
        many = sizes.select("cluster_id", F.ceil(F.col("nq") / parts[0]).alias("_nq"), F.ceil(F.col("nm") / parts[1]).alias("_nm"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = left.join(many, "cluster_id").withColumn("_q", F.pmod(F.xxhash64("query_id"), "_nq")).withColumn("_m", every("_nm")).drop("_nq", "_nm")
        right = right.join(many, "cluster_id").withColumn("_m", F.pmod(F.xxhash64("pos_id"), "_nm")).withColumn("_q", every("_nq")).drop("_nq", "_nm")
        keys = ["cluster_id", "_q", "_m"]
    token = members.schema["token"].dataType
    out = T.StructType([T.StructField("query_id", weighted.schema["query_id"].dataType), T.StructField("cluster_id", weighted.schema["cluster_id"].dataType), T.StructField("w", T.DoubleType()), T.StructField("token", token), T.StructField("top", T.DoubleType()), T.StructField("e", T.DoubleType())])

    def meet(q: pa.Table, m: pa.Table) -> pa.Table:
        names = ["query_id", "cluster_id", "w", "token", "top", "e"]
        coded = pc.dictionary_encode(m["token"].combine_chunks(), null_encoding="encode")
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        mx, qx = matrix(m["mx"])[order], matrix(q["qx"])
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary))) if len(code) else np.zeros(0, np.int64)
        tops, sums = [], []
        for a in range(0, len(qx) if len(mx) else 0, step := max(1, HELD // max(1, len(mx)))):
            z = _scores(qx[a : a + step], mx, kernel, tau, sigma)
            top = z.max(1)
            z -= top[:, None]
            e = np.add.reduceat(np.exp(z, out=z), starts, axis=1)
            tops.append(top)
            sums.append(e if cut else e / e.sum(1, keepdims=True))
        if not sums:
            return pa.table([q["query_id"].slice(0, 0), q["cluster_id"].slice(0, 0), q["w"].slice(0, 0), coded.dictionary.slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.float64())], names=names)
        who = pa.array(np.repeat(np.arange(len(qx)), len(starts)))
        what = pa.array(np.tile(np.arange(len(starts)), len(qx)))
        cells = [q["query_id"].take(who), q["cluster_id"].take(who), q["w"].take(who), coded.dictionary.take(what)]
        return pa.table([*cells, pa.array(np.repeat(np.concatenate(tops), len(starts))), pa.array(np.concatenate(sums).ravel())], names=names)

    got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out)
    if not cut:
        return got.select("query_id", "cluster_id", "w", "token", F.col("e").alias("wm"))
    by = Window.partitionBy("query_id", "cluster_id")
    got = got.withColumn("e", F.col("e") * F.exp(F.col("top") - F.max("top").over(by)))
    got = got.groupBy("query_id", "cluster_id", "token").agg(F.first("w").alias("w"), F.sum("e").alias("e"))
    return got.select("query_id", "cluster_id", "w", "token", (F.col("e") / F.sum("e").over(by)).alias("wm"))


def _uniform_sums(weighted: DataFrame, members: DataFrame) -> DataFrame:
    """``member_sums`` of the uniform kernel: members are counted by token before they meet a query."""
    counts = members.groupBy("cluster_id", "token").agg(F.count(F.lit(1)).alias("_n"))
    totals = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_all"))
    shares = counts.join(totals, "cluster_id").select("cluster_id", "token", (F.col("_n") / F.col("_all")).alias("wm"))
    return weighted.select("query_id", "cluster_id", "w").join(shares, "cluster_id").select("query_id", "cluster_id", "w", "token", "wm")


def _scores(q: np.ndarray, m: np.ndarray, kernel: str, tau: float, sigma: float) -> np.ndarray:
    """Exponents of the kernel for each pair; small distances by plain differences, which don't cancel."""
    scale = (q * q).sum(1)[:, None] + (m * m).sum(1)[None, :]
    sq = q @ m.T
    sq *= -2
    sq += scale
    r, c = np.nonzero(sq <= NEAR * scale)
    for a in range(0, len(r), 65_536):
        i, j = r[a : a + 65_536], c[a : a + 65_536]
        sq[i, j] = ((q[i] - m[j]) ** 2).sum(1)
    return -sq / (2 * sigma * sigma) if kernel == "gauss" else -np.sqrt(np.maximum(sq, 0)) / tau


def member_prob(terms: DataFrame, truth: DataFrame) -> DataFrame:
    rows = terms.join(truth.select("query_id", "y"), "query_id")
    p = rows.groupBy("query_id").agg(F.sum(F.when(F.col("token") == F.col("y"), F.col("w") * F.col("wm")).otherwise(0.0)).alias("p"))
    return truth.join(p, "query_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def member_distribution(terms: DataFrame) -> DataFrame:
    return terms.groupBy("query_id", "token").agg(F.sum(F.col("w") * F.col("wm")).alias("p"))


def regrouped_prob(raw_weighted: DataFrame, assigned: DataFrame, truth: DataFrame, dist: DataFrame, proto: DataFrame) -> DataFrame:
    """Raw routing with compressed contents: neighbours' weights summed by their cluster."""
    w = raw_weighted.join(assigned.select(F.col("pos_id").alias("entry_id"), "cluster_id"), "entry_id").groupBy("query_id", "cluster_id").agg(F.sum("w").alias("w"))
    return state_prob(w, truth, dist, proto)


def affine_parts(weighted: DataFrame, truth: DataFrame, dist: DataFrame, proto: DataFrame, retained_terms: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``w_ret`` with hybrid probability a + beta * b for every beta at once.

    ``retained_terms``: member terms over retained members only. A cluster without one keeps its counts.
    """
    base = state_terms(weighted, truth, dist, proto).withColumn("ps", F.when(F.col("total") > 0, F.col("cnt") / F.col("total")).otherwise(0.0))
    inner = (
        retained_terms.join(truth.select("query_id", "y"), "query_id")
        .groupBy("query_id", "cluster_id")
        .agg(F.sum(F.when(F.col("token") == F.col("y"), F.col("wm")).otherwise(0.0)).alias("pm"))
    )
    rows = base.join(inner, ["query_id", "cluster_id"], "left")
    agg = rows.groupBy("query_id").agg(
        F.sum(F.col("w") * F.col("ps")).alias("a"),
        F.sum(F.when(F.col("pm").isNotNull(), F.col("w") * (F.col("pm") - F.col("ps"))).otherwise(0.0)).alias("b"),
        F.sum(F.when(F.col("pm").isNotNull(), F.col("w")).otherwise(0.0)).alias("w_ret"),
    )
    return truth.join(agg, "query_id")


def conditional_prob(weighted: DataFrame, ranked: DataFrame, truth: DataFrame, dist: DataFrame, proto: DataFrame, joint: DataFrame, lam: float) -> DataFrame:
    """The nearest cluster's term replaced by its counts given the second nearest cluster too.

    ``ranked(query_id, c1, c2)``; ``joint(c1, c2, token, cnt)``; term (N(c1,c2,y) + lam p(y|c1)) / (N(c1,c2) + lam).
    """
    rows = state_terms(weighted, truth, dist, proto).withColumn("ps", F.when(F.col("total") > 0, F.col("cnt") / F.col("total")).otherwise(0.0)).drop("cnt")
    totals = joint.groupBy("c1", "c2").agg(F.sum("cnt").alias("n12"))
    near = ranked.join(totals, ["c1", "c2"], "left").select("query_id", "c1", "c2", F.coalesce("n12", F.lit(0)).alias("n12"))
    own = joint.select("c1", "c2", F.col("token").alias("y"), F.col("cnt").alias("n12y"))
    rows = rows.join(near, "query_id").join(own, ["c1", "c2", "y"], "left")
    term = F.when(F.col("cluster_id") == F.col("c1"), (F.coalesce("n12y", F.lit(0)) + lam * F.col("ps")) / (F.col("n12") + lam)).otherwise(F.col("ps"))
    return truth.join(rows.groupBy("query_id").agg(F.sum(F.col("w") * term).alias("p")), "query_id")


def anchor_terms(weighted: DataFrame, zq: DataFrame, dist: DataFrame, stats: DataFrame, tau_z: float, variance: bool = False) -> DataFrame:
    """Token posteriors inside each retrieved cluster: prior counts times a Gaussian of a feature.

    ``zq(query_id, cluster_id, z)``: the query's feature in that cluster; ``stats(cluster_id, token, mu, var)``.
    """
    rows = weighted.select("query_id", "cluster_id", "w").join(zq, ["query_id", "cluster_id"]).join(dist, "cluster_id").join(stats, ["cluster_id", "token"])
    gap = (F.col("z") - F.col("mu")) * (F.col("z") - F.col("mu"))
    score = F.ln("cnt") - (gap / (2 * F.col("var")) + 0.5 * F.ln("var") if variance else gap / (2 * tau_z * tau_z))
    rows = rows.withColumn("s", score)
    group = Window.partitionBy("query_id", "cluster_id")
    return weights_of(F.exp(F.col("s") - F.max("s").over(group)), rows, ["query_id", "cluster_id"], "wm")
