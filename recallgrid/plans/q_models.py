"""Mixtures, matchings, learned heads and other fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interpolate, nll
from ..operators import em, read, store
from ..operators.heads import softmax_head, trained_head
from ..operators.ranking import with_rank
from ..operators.stats_extra import ari_nmi, contingency
from ..schema import draw, lcg_sql, pick_sql
from .base_sql import with_base
from .catalog import n, query, r
from .q_read import K, TAU
from .workspace import CLUSTERS, Workspace

_LN2PI = "1.8378770664093453"
_P0 = ("p0", "SELECT p.cluster_id, p.total / t.n AS pi, p.x AS m, g.v FROM proto p, (SELECT count(*) AS n FROM ds) t, (SELECT greatest(1e-6, avg(dist * dist) / 64) AS v FROM asg) g")
_E0 = ("e0", f"SELECT d.pos_id, d.y, p.cluster_id, ln(greatest(p.pi, 1e-300)) - 32 * ln(p.v) - 32 * {_LN2PI} - pow(list_distance(d.x, p.m), 2) / (2 * p.v) AS z FROM ds d, p0 p")


def _resp(name: str, src: str) -> tuple[str, str]:
    return name, f"SELECT *, exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY pos_id) AS gamma FROM (SELECT *, max(z) OVER (PARTITION BY pos_id) AS zm FROM {src})"


_G0 = _resp("g0", "e0")
_M1 = ("m1", "SELECT g.cluster_id, u.i, sum(gamma) AS mass, sum(gamma * u.v) / sum(gamma) AS m, sum(gamma * u.v * u.v) / sum(gamma) - pow(sum(gamma * u.v) / sum(gamma), 2) AS v FROM g0 g JOIN (SELECT pos_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ds) u USING (pos_id) GROUP BY 1, 2")
_VAR = {
    "spherical": "avg(v) OVER (PARTITION BY cluster_id)",
    "diag": "v",
    "tied": "sum(v * mass) OVER (PARTITION BY i) / sum(mass) OVER (PARTITION BY i)",
}


def _p1(kind: str) -> tuple[str, str]:
    return "p1", f"SELECT cluster_id, i, mass / (SELECT count(*) FROM ds) AS pi, m, greatest(1e-6, {_VAR[kind]}) AS v FROM m1"


_E1 = ("e1", f"SELECT u.pos_id, any_value(u.y) AS y, p.cluster_id, ln(greatest(any_value(p.pi), 1e-300)) - 0.5 * sum(ln(p.v)) - 32 * {_LN2PI} - 0.5 * sum((u.v - p.m) * (u.v - p.m) / p.v) AS z FROM (SELECT pos_id, y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ds) u JOIN p1 p USING (i) GROUP BY 1, 3")
_G1 = _resp("g1", "e1")


def fitted(w: Workspace, kind: str, steps: int = 1) -> em.Mixture:
    return em.fit(w.ds, em.start(w.ds, w.proto, w.assigned, kind), steps)[0]


def _parameters(w: Workspace, kind: str) -> DataFrame:
    mix = fitted(w, kind)
    rows = [(int(c), i + 1, float(mix.weights[c]), float(mix.means[c, i]), float(mix.var[c, i])) for c in range(len(mix.weights)) for i in range(4)]
    return w.spark.createDataFrame(rows, "cluster_id long, i long, pi double, m double, v double").select("cluster_id", "i", r("pi"), r("m"), r("v"))


for _kind in _VAR:

    @query(with_base("SELECT cluster_id, i, round(pi, 6) AS pi, round(m, 6) AS m, round(v, 6) AS v FROM p1 WHERE i <= 4", _P0, _E0, _G0, _M1, _p1(_kind)), f"gmm_em_{_kind}")
    def _gmm_em(w: Workspace, kind: str = _kind) -> DataFrame:
        """Parameters after one EM step from the hard clusters."""
        return _parameters(w, kind)


@query(with_base("SELECT pos_id, cluster_id, round(gamma, 6) AS gamma FROM g0 WHERE gamma >= 0.0005", _P0, _E0, _G0))
def gmm_responsibilities(w: Workspace) -> DataFrame:
    got = em.responsibilities(w.ds, em.start(w.ds, w.proto, w.assigned, "spherical"))
    return got.where("gamma >= 0.0005").select("pos_id", "cluster_id", r("gamma"))


@query(with_base("SELECT cluster_id, y AS token, count(*) AS cnt FROM (SELECT pos_id, y, arg_min(cluster_id, (-round(z, 6), cluster_id)) AS cluster_id FROM e1 GROUP BY 1, 2) GROUP BY 1, 2", _P0, _E0, _G0, _M1, _p1("spherical"), _E1))
def gmm_hard(w: Workspace) -> DataFrame:
    """Contents by the most responsible component."""
    g = em.responsibilities(w.ds, fitted(w, "spherical"))
    hard = g.groupBy("pos_id", "y").agg(F.max_by("cluster_id", F.struct("gamma", -F.col("cluster_id"))).alias("cluster_id"))
    return store.distribution(hard).select("cluster_id", "token", n("cnt"))


@query(with_base("SELECT cluster_id, y AS token, round(sum(gamma), 6) AS cnt FROM g1 GROUP BY 1, 2 HAVING sum(gamma) >= 0.0005", _P0, _E0, _G0, _M1, _p1("spherical"), _E1, _G1))
def gmm_soft(w: Workspace) -> DataFrame:
    """Fractional contents."""
    g = em.responsibilities(w.ds, fitted(w, "spherical"))
    return store.distribution(g, F.col("gamma")).where("cnt >= 0.0005").select("cluster_id", "token", r("cnt"))


@query(with_base("SELECT pos_id, round(max(gamma), 6) AS top1, round(list(gamma ORDER BY gamma DESC)[2], 6) AS top2, round(-sum(CASE WHEN gamma > 0 THEN gamma * ln(gamma) ELSE 0 END), 6) AS entropy FROM g0 GROUP BY 1", _P0, _E0, _G0))
def gmm_gap(w: Workspace) -> DataFrame:
    """The two largest responsibilities and their entropy."""
    g = em.responsibilities(w.ds, em.start(w.ds, w.proto, w.assigned, "spherical"), keep=0.0)
    s = F.sort_array(F.collect_list("gamma"), asc=False)
    h = F.sum(F.when(F.col("gamma") > 0, -F.col("gamma") * F.ln("gamma")).otherwise(0.0))
    return g.groupBy("pos_id").agg(s.alias("s"), h.alias("h")).select("pos_id", r(F.col("s")[0]).alias("top1"), r(F.col("s")[1]).alias("top2"), r(F.col("h")).alias("entropy"))


@query(with_base("SELECT count(*) AS n, count(*) FILTER (abs(s - 1) < 1e-9) AS whole FROM (SELECT pos_id, sum(gamma) AS s FROM g0 GROUP BY 1)", _P0, _E0, _G0))
def gmm_mass(w: Workspace) -> DataFrame:
    """Responsibilities of an entry sum to one."""
    g = em.responsibilities(w.ds, em.start(w.ds, w.proto, w.assigned, "spherical"), keep=0.0)
    return g.groupBy("pos_id").agg(F.sum("gamma").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(F.col("s") - 1) < 1e-9, 1)).alias("whole"))


_POOL = ("one", "SELECT cluster_id, any_value(pi) AS pi, list(m ORDER BY i) AS m, avg(v) AS v FROM p1 GROUP BY 1")
_CF = """SELECT pos_id, arg_min(cluster_id, (round(sq, 9), cluster_id)) AS near, arg_min(cluster_id, (-round(ln(greatest(pi, 1e-300)) - sq / (2 * pool), 9), cluster_id)) AS weighted,
  arg_min(cluster_id, (-round(ln(greatest(pi, 1e-300)) - 32 * ln(v) - sq / (2 * v), 9), cluster_id)) AS spherical FROM (SELECT d.pos_id, o.*, pow(list_distance(d.x, o.m), 2) AS sq, (SELECT sum(v * pi) FROM one) AS pool FROM ds d, one o) GROUP BY pos_id"""


@query(with_base(f"SELECT c.*, f.cluster_id AS full FROM ({_CF}) c JOIN (SELECT pos_id, arg_min(cluster_id, (-round(z, 9), cluster_id)) AS cluster_id FROM e1 GROUP BY 1) f USING (pos_id)".replace("AS full", 'AS "full"'), _P0, _E0, _G0, _M1, _p1("diag"), _E1, _POOL))
def counterfactual(w: Workspace) -> DataFrame:
    """Components under four nested scoring rules."""
    return em.counterfactual(w.ds, fitted(w, "diag"))


@query()
def gmm_converged(w: Workspace) -> DataFrame:
    """EM to convergence with its history."""
    _, history = em.fit(w.ds, em.start(w.ds, w.proto, w.assigned, "diag"), 20, 1e-4, 2)
    rows = [(h["iteration"], h["mean_ll"], h["dead"], h["changed"]) for h in history]
    return w.spark.createDataFrame(rows, "iteration int, mean_ll double, dead int, changed double")


def matched(w: Workspace) -> DataFrame:
    """Optimal one-to-one pairs of hard prototypes and mixture means."""
    mix = fitted(w, "diag", 3)
    proto = w.proto.orderBy("cluster_id").select("cluster_id", "x").toPandas()
    x = np.array(proto["x"].tolist())
    cost = np.sqrt(((x[:, None, :] - mix.means[None, :, :]) ** 2).sum(2))
    pairs = em.hungarian(cost)
    rows = [(int(c), int(p), float(cost[i, p]), float(mix.weights[p])) for i, (c, p) in enumerate(zip(proto["cluster_id"], pairs))]
    return w.spark.createDataFrame(rows, "cluster_id long, component long, moved double, weight double")


@query()
def match_components(w: Workspace) -> DataFrame:
    return matched(w)


@query()
def assignment_agreement(w: Workspace) -> DataFrame:
    """Agreement of a clustering of the entries with one of their queries' clusters after matching, and the correlation of matched sizes."""
    centres = store.lloyd(w.q.select(F.col("query_id").alias("pos_id"), "x"), CLUSTERS, 2)
    other = store.assign_nearest(w.ds, centres).select("pos_id", F.col("cluster_id").alias("b"))
    cells = contingency(w.assigned.withColumnRenamed("cluster_id", "a").join(other, "pos_id"), "a", "b")
    return em.agreement(cells).select("n", "agreed", r("agreement"), r("size_corr"))


@query()
def component_report(w: Workspace) -> DataFrame:
    """Movement, mass and content divergence of matched components."""
    from ..operators.stats_extra import js_divergence

    pairs = matched(w).persist()
    soft = store.distribution(em.responsibilities(w.ds, fitted(w, "diag", 3)), F.col("gamma")).withColumnRenamed("cluster_id", "component").join(pairs.select("component", "cluster_id"), "component")
    share = lambda d: d.join(d.groupBy("cluster_id").agg(F.sum("cnt").alias("t")), "cluster_id").where("t > 0").select("cluster_id", "token", (F.col("cnt") / F.col("t")).alias("p"))
    js = js_divergence(share(w.dist), share(soft.select("cluster_id", "token", "cnt")), "cluster_id")
    return pairs.join(js, "cluster_id").select("cluster_id", "component", r("moved"), r("weight"), r("js"))


@query(with_base("""SELECT round((pc - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(2 * (lc / t - la / t - lb / t + ln(t)) / ((ln(t) - la / t) + (ln(t) - lb / t)), 6) AS nmi FROM
  (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS pc, sum(n * ln(n)) AS lc FROM cells), (SELECT sum(m * (m - 1) / 2) AS pa, sum(m * ln(m)) AS la FROM (SELECT a, sum(n) AS m FROM cells GROUP BY a)), (SELECT sum(m * (m - 1) / 2) AS pb, sum(m * ln(m)) AS lb FROM (SELECT b, sum(n) AS m FROM cells GROUP BY b))""",
  ("cells", f"SELECT a.cluster_id AS a, b.cluster_id AS b, count(*) AS n FROM asg a JOIN (SELECT pos_id, CAST({pick_sql('pos_id', CLUSTERS)} AS BIGINT) AS cluster_id FROM ds) b USING (pos_id) GROUP BY 1, 2")))
def assignment_similarity(w: Workspace) -> DataFrame:
    """Agreement of two clusterings of the same entries."""
    other = store.random_clusters(w.ds, CLUSTERS).select("pos_id", F.col("cluster_id").alias("b"))
    return ari_nmi(contingency(w.assigned.withColumnRenamed("cluster_id", "a").join(other, "pos_id"), "a", "b")).select(r("ari"), r("nmi"))


@query()
def ml_kmeans(w: Workspace) -> DataFrame:
    """The library's seeded k-means: sizes, and the squared distances of each cluster to its centre and in all."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = w.ds.select("pos_id", array_to_vector("x").alias("features")).persist()
    model = KMeans(k=CLUSTERS, seed=42, maxIter=10).fit(rows)
    centres = store.frame(w.spark, range(CLUSTERS), np.array(model.clusterCenters()))
    own = model.transform(rows).select("pos_id", F.col("prediction").cast("long").alias("cluster_id"))
    gap = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    got = own.join(w.ds.select("pos_id", "x"), "pos_id").join(centres.withColumnRenamed("x", "c"), "cluster_id").groupBy("cluster_id")
    got = got.agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("cost"))
    return got.select("cluster_id", "n", r("cost"), r(F.lit(float(model.summary.trainingCost))).alias("total"))


@query()
def pca_2d(w: Workspace) -> DataFrame:
    return em.principal(w.ds).select("pos_id", r(F.col("pc")[0], 5).alias("pc1"), r(F.col("pc")[1], 5).alias("pc2"))


@query()
def two_means(w: Workspace) -> DataFrame:
    return em.two_means(w.assigned.select("pos_id", "cluster_id").join(w.ds.select("pos_id", "x"), "pos_id")).select("cluster_id", "n0", "n1", r("gap"))


def _head_losses(w: Workspace, train: DataFrame, kind: str) -> DataFrame:
    got = softmax_head(train, w.q)
    loss = nll(interpolate(F.col("p_head"), F.col("p_lm"), 0.25))
    return got.where("split = 'val'").agg(F.lit(kind).alias("kind"), r(F.avg(nll(F.col("p_head")))).alias("standalone"), r(F.avg(loss)).alias("mixed"))


def shuffled_labels(w: Workspace) -> DataFrame:
    """Entries with the tokens dealt out anew, by two numberings of the same rows."""
    from ..sources.ingest import with_offsets

    one = lambda d, order: with_offsets(d.withColumn("_one", F.lit(1)), "_one", [], order).withColumnRenamed("offset", "i").drop("_one")
    a = one(w.ds.select("pos_id", "x"), "pos_id")
    b = one(w.ds.select("y", (draw(F.col("pos_id")) * 4096 + F.col("pos_id") % 4096).alias("key")), "key").select("y", "i")
    return a.join(b, "i").select("pos_id", "x", "y")


@query()
def softmax_heads(w: Workspace) -> DataFrame:
    """A linear head, the same on shuffled tokens, and the unigram, alone and mixed."""
    real = _head_losses(w, w.ds, "head")
    control = _head_losses(w, shuffled_labels(w), "shuffled")
    u = w.truth.where("split = 'val'").join(w.unigram.select(F.col("token").alias("y"), "p"), "y", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    uni = u.agg(F.lit("unigram").alias("kind"), r(F.avg(nll(F.col("p")))).alias("standalone"), r(F.avg(nll(interpolate(F.col("p"), F.col("p_lm"), 0.25)))).alias("mixed"))
    return real.unionByName(control).unionByName(uni)


@query()
def head_training(w: Workspace) -> DataFrame:
    """Epochs of a head trained with early stop on ct, and the loss on val of the state that was best there."""
    got, history = trained_head(w.ds, w.q.where("split = 'ct'"), w.q.where("split = 'val'"))
    val = got.agg(F.avg(nll(F.col("p_head"))).alias("val_nll"))
    epochs = w.spark.createDataFrame([(h["epoch"], h["train_nll"], h["ct_nll"]) for h in history], "epoch int, train_nll double, ct_nll double")
    return epochs.crossJoin(F.broadcast(val)).select("epoch", r("train_nll"), r("ct_nll"), r("val_nll"))


@query(with_base("SELECT round(avg(-ln(u.p + 1e-12)), 6) AS standalone, round(avg(-ln(0.25 * u.p + 0.75 * q.p_lm + 1e-12)), 6) AS mixed FROM q JOIN uni u ON u.token = q.y WHERE q.split = 'val'"))
def unigram_control(w: Workspace) -> DataFrame:
    u = w.truth.where("split = 'val'").join(w.unigram.select(F.col("token").alias("y"), "p"), "y")
    return u.agg(r(F.avg(nll(F.col("p")))).alias("standalone"), r(F.avg(nll(interpolate(F.col("p"), F.col("p_lm"), 0.25)))).alias("mixed"))


# Anchors of a cluster: other prototypes, by distance, at random, or spread out.
_AN = ("an", "SELECT cluster_id, other, ox, rk FROM (SELECT a.cluster_id, b.cluster_id AS other, b.x AS ox, row_number() OVER (PARTITION BY a.cluster_id ORDER BY list_distance(a.x, b.x), b.cluster_id) AS rk FROM proto a, proto b WHERE a.cluster_id <> b.cluster_id) WHERE rk <= 4")


@query(with_base("SELECT cluster_id, other, CAST(rk AS BIGINT) AS rk FROM an", _AN))
def anchors_nearest(w: Workspace, most: int = 4) -> DataFrame:
    from ..operators.vectors import nearest

    p = w.proto.select(F.col("cluster_id").alias("pos_id"), "x")
    got = nearest(p, p, most + 1).where("query_id <> entry_id")
    return got.select(F.col("query_id").alias("cluster_id"), F.col("entry_id").alias("other"), n(F.col("rank") - 1, "rk"))


@query(with_base("SELECT cluster_id, other, CAST(rk AS BIGINT) AS rk FROM (SELECT a.cluster_id, b.cluster_id AS other, row_number() OVER (PARTITION BY a.cluster_id ORDER BY ((a.cluster_id * 1000 + b.cluster_id) * 1103515245 + 12345) % 2147483648, b.cluster_id) AS rk FROM proto a, proto b WHERE a.cluster_id <> b.cluster_id) WHERE rk <= 4"))
def anchors_random(w: Workspace) -> DataFrame:
    from pyspark.sql import Window

    a, b = w.proto.select("cluster_id"), w.proto.select(F.col("cluster_id").alias("other"))
    rows = a.crossJoin(b).where("cluster_id <> other")
    key = draw(F.col("cluster_id") * 1000 + F.col("other"))
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy("cluster_id").orderBy(key, "other"))).where("rk <= 4").select("cluster_id", "other", n("rk"))


_DIVERSE = """WITH RECURSIVE div AS (SELECT cluster_id, 0 AS rk, cluster_id AS other, [cluster_id] AS chosen FROM proto
  UNION ALL SELECT f.cluster_id, f.rk + 1, f.next, list_append(f.chosen, f.next) FROM (SELECT d.cluster_id, d.rk, d.chosen, (SELECT arg_min(cluster_id, (-round(m, 9), cluster_id)) FROM (
    SELECT e.cluster_id, min(list_distance(e.x, c.x)) AS m FROM proto e, proto c WHERE list_contains(d.chosen, c.cluster_id) GROUP BY e.cluster_id)) AS next FROM div d WHERE d.rk < 4) f)
SELECT cluster_id, other, CAST(rk AS BIGINT) AS rk FROM div WHERE rk > 0"""


@query(with_base("SELECT * FROM (" + _DIVERSE + ")"))
def anchors_diverse(w: Workspace, most: int = 4) -> DataFrame:
    """From a prototype, each next anchor is the prototype farthest from all chosen."""
    p = w.proto.orderBy("cluster_id").select("cluster_id", "x").toPandas()  # the prototypes, as in a Lloyd step
    ids, x = p["cluster_id"].tolist(), np.array(p["x"].tolist())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rows = []
    for c in range(len(ids)):
        near = d[c].copy()
        for rk in range(1, min(most + 1, len(ids))):
            far = int(np.argmax(near))
            rows.append((int(ids[c]), int(ids[far]), rk))
            near = np.minimum(near, d[far])
    return w.spark.createDataFrame(rows, "cluster_id long, other long, rk long")


def _axes(w: Workspace, anchors: DataFrame) -> DataFrame:
    """``(cluster_id, px, axes)``: a prototype and the vectors of its anchors in their order."""
    x = w.proto.select("cluster_id", F.col("x").alias("px"))
    rows = anchors.join(x.select(F.col("cluster_id").alias("other"), F.col("px").alias("ox")), "other").join(x, "cluster_id")
    return rows.groupBy("cluster_id", "px").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "ox"))), lambda s: s["ox"]).alias("axes"))


def _inner(col: str, v: Column) -> Column:
    return F.aggregate(F.zip_with(F.col(col), v, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def _differences(col: str, k: int) -> Column:
    """Squared distances to the first k anchors less that to the prototype."""
    sq = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)
    return F.transform(F.slice("axes", 1, k), lambda o: -2 * (_inner(col, o) - _inner(col, F.col("px"))) + sq(o) - sq(F.col("px")))


def _dim_sql(k: int) -> str:
    z = "-2 * (list_inner_product({0}, a.ox) - list_inner_product({0}, p.x)) + list_inner_product(a.ox, a.ox) - list_inner_product(p.x, p.x)"
    return f"""SELECT {k} AS k, query_id, sum(CASE WHEN token = y THEN w * e / es ELSE 0 END) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY query_id, cluster_id) AS es FROM (
  SELECT *, exp(-(dm - min(dm) OVER (PARTITION BY query_id, cluster_id)) / 0.2) AS e FROM (
  SELECT s.query_id, s.cluster_id, s.w, m.pos_id, m.token, sqrt(sum((m.z - f.z) * (m.z - f.z))) AS dm FROM s4 s
  JOIN (SELECT g.pos_id, g.cluster_id, g.y AS token, a.rk, {z.format('d.x')} AS z FROM asg g JOIN ds d USING (pos_id) JOIN proto p USING (cluster_id) JOIN an a USING (cluster_id) WHERE a.rk <= {k}) m USING (cluster_id)
  JOIN (SELECT s.query_id, s.cluster_id, a.rk, {z.format('q.x')} AS z FROM s4 s JOIN q USING (query_id) JOIN proto p USING (cluster_id) JOIN an a USING (cluster_id) WHERE a.rk <= {k}) f ON f.query_id = s.query_id AND f.cluster_id = s.cluster_id AND f.rk = m.rk GROUP BY ALL))) JOIN q USING (query_id) GROUP BY query_id"""


@query(with_base("SELECT k, round(avg(-ln(0.25 * d.p + 0.75 * q.p_lm + 1e-12)), 6) AS val_nll FROM (" + " UNION ALL ".join(_dim_sql(k) for k in (1, 2, 4)) + ") d JOIN q USING (query_id) WHERE q.split = 'val' GROUP BY k",
  ("s4", f"SELECT *, exp(-(dist - dmin) / {TAU}) / sum(exp(-(dist - dmin) / {TAU})) OVER (PARTITION BY query_id) AS w FROM (SELECT *, min(dist) OVER (PARTITION BY query_id) AS dmin FROM snbr WHERE rank <= {K})"), _AN))
def anchor_dimensions(w: Workspace) -> DataFrame:
    """Member reads in the space of distance differences to the K nearest anchors, for several K."""
    anc = _axes(w, anchors_nearest(w)).persist()
    s4 = read.first_k(w.snbr, K, TAU)
    members = w.assigned.select("pos_id", "cluster_id", F.col("y").alias("token")).join(w.ds.select("pos_id", "x"), "pos_id").join(anc, "cluster_id")
    qs = s4.select("query_id", "cluster_id").join(w.q.select("query_id", "x"), "query_id").join(anc, "cluster_id")
    out = None
    for k in (1, 2, 4):
        m = members.select("cluster_id", "pos_id", "token", _differences("x", k).alias("mx"))
        zq = qs.select("query_id", "cluster_id", _differences("x", k).alias("qx"))
        p = read.member_prob(read.member_sums(s4, m, zq, tau=0.2), w.truth.where("split = 'val'"))
        one = read.mix(p, 0.25).agg(F.lit(k).alias("k"), r(F.avg("nll")).alias("val_nll"))
        out = one if out is None else out.unionByName(one)
    return out


#: Numbers of anchors, or of random directions, swept, and how many clusters the inner temperature is taken from.
SWEEP = {"nearest": (1, 4, 15), "diverse": (1, 4, 15), "projection": (1, 8, 32)}
SPREAD_CLUSTERS = 100
_MOST = 15
_DIFF = "-2 * (list_inner_product({0}, a.ox) - list_inner_product({0}, p.x)) + list_inner_product(a.ox, a.ox) - list_inner_product(p.x, p.x)"
_SWEEP = (
    ("s4", f"SELECT *, exp(-(dist - dmin) / {TAU}) / sum(exp(-(dist - dmin) / {TAU})) OVER (PARTITION BY query_id) AS w FROM (SELECT *, min(dist) OVER (PARTITION BY query_id) AS dmin FROM snbr WHERE rank <= {K}) JOIN (SELECT query_id FROM q WHERE split = 'val') USING (query_id)"),
    ("ks", "SELECT * FROM (VALUES " + ", ".join(f"('{kind}', {k})" for kind, ks in SWEEP.items() for k in ks) + ") t(kind, k)"),
    ("anx", f"SELECT 'nearest' AS kind, cluster_id, other, rk FROM ({_AN[1].replace('<= 4', f'<= {_MOST}')}) UNION ALL SELECT 'diverse', cluster_id, other, rk FROM ({_DIVERSE.replace('d.rk < 4', f'd.rk < {_MOST}')})"),
    ("ax", "SELECT a.kind, a.cluster_id, a.rk, o.x AS ox FROM anx a JOIN proto o ON o.cluster_id = a.other"),
    ("rd", "SELECT rk, list(v / n ORDER BY i) AS dir FROM (SELECT rk, i, v, sqrt(sum(v * v) OVER (PARTITION BY rk)) AS n FROM (SELECT rk, i, " + lcg_sql(lcg_sql("rk * 100000 + i")) + " / 2147483648.0 - 0.5 AS v FROM range(1, 33) t(rk), range(1, (SELECT max(len(x)) FROM ds) + 1) u(i))) GROUP BY rk"),
    ("mf", f"SELECT a.kind, g.cluster_id, g.pos_id, g.y AS token, a.rk, {_DIFF.format('d.x')} AS z FROM asg g JOIN ds d USING (pos_id) JOIN proto p USING (cluster_id) JOIN ax a USING (cluster_id) UNION ALL SELECT 'projection', g.cluster_id, g.pos_id, g.y, r.rk, list_inner_product(d.x, r.dir) FROM asg g JOIN ds d USING (pos_id), rd r"),
    ("qf", f"SELECT a.kind, s.query_id, s.cluster_id, s.w, a.rk, {_DIFF.format('q.x')} AS z FROM s4 s JOIN q USING (query_id) JOIN proto p USING (cluster_id) JOIN ax a USING (cluster_id) UNION ALL SELECT 'projection', s.query_id, s.cluster_id, s.w, r.rk, list_inner_product(q.x, r.dir) FROM s4 s JOIN q USING (query_id), rd r"),
    ("tk", f"SELECT m.kind, ks.k, greatest(stddev_pop(z), 1e-6) AS tau FROM mf m JOIN ks ON ks.kind = m.kind AND m.rk <= ks.k WHERE cluster_id < {SPREAD_CLUSTERS} GROUP BY ALL"),
    ("dk", "SELECT f.kind, ks.k, f.query_id, f.cluster_id, f.w, m.pos_id, m.token, sqrt(sum((m.z - f.z) * (m.z - f.z))) AS dm FROM qf f JOIN mf m ON m.kind = f.kind AND m.cluster_id = f.cluster_id AND m.rk = f.rk JOIN ks ON ks.kind = f.kind AND f.rk <= ks.k GROUP BY ALL"),
    ("ek", "SELECT kind, k, query_id, cluster_id, w, token, exp(-(dm - min(dm) OVER (PARTITION BY kind, k, query_id, cluster_id)) / tau) AS e FROM dk JOIN tk USING (kind, k)"),
    ("pk", "SELECT kind, k, query_id, sum(CASE WHEN token = y THEN w * e / es ELSE 0 END) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY kind, k, query_id, cluster_id) AS es FROM ek) JOIN q USING (query_id) GROUP BY kind, k, query_id"),
)


@query(with_base("SELECT kind, CAST(k AS INT) AS k, round(any_value(tau), 6) AS tau, round(avg(-ln(0.25 * p + 0.75 * p_lm + 1e-12)), 6) AS val_nll FROM pk JOIN tk USING (kind, k) JOIN q USING (query_id) GROUP BY kind, k", *_SWEEP))
def anchor_sweep(w: Workspace) -> DataFrame:
    """Member reads in spaces of nearest anchors, of anchors spread out and of random directions, for several dimensions each.

    The inner temperature is the spread of the members' features in the first clusters.
    """
    truth = w.truth.where("split = 'val'")
    s4 = read.first_k(w.snbr, K, TAU).join(truth.select("query_id"), "query_id", "left_semi")
    members = w.assigned.select("pos_id", "cluster_id", F.col("y").alias("token")).join(w.ds.select("pos_id", "x"), "pos_id")
    qs = s4.select("query_id", "cluster_id").join(w.q.select("query_id", "x"), "query_id")
    wide = w.ds.select(F.size("x").alias("d")).first()
    directions = _directions(w, max(SWEEP["projection"]), wide["d"] if wide else 0)
    axes = {"nearest": _axes(w, anchors_nearest(w, _MOST)), "diverse": _axes(w, anchors_diverse(w, _MOST)), "projection": w.proto.select("cluster_id").crossJoin(F.broadcast(directions))}
    feature = lambda kind, k: F.transform(F.slice("axes", 1, k), lambda o: _inner("x", o)) if kind == "projection" else _differences("x", k)
    out = []
    for kind, ks in SWEEP.items():
        # The features for fewer dimensions are the first of those for more: they are computed once.
        own = members.join(axes[kind], "cluster_id").select("cluster_id", "pos_id", "token", feature(kind, max(ks)).alias("z")).persist()
        asked = qs.join(axes[kind], "cluster_id").select("query_id", "cluster_id", feature(kind, max(ks)).alias("z")).persist()
        cells = own.where(F.col("cluster_id") < SPREAD_CLUSTERS).select(F.posexplode("z").alias("i", "v"))
        spread = cells.agg(*(F.stddev_pop(F.when(F.col("i") < k, F.col("v"))).alias(f"s{k}") for k in ks)).first()
        for k in ks:
            tau = max(spread[f"s{k}"] or 0.0, 1e-6)
            cut = lambda d, name, k=k: d.withColumn(name, F.slice("z", 1, k)).drop("z")
            p = read.member_prob(read.member_sums(s4, cut(own, "mx"), cut(asked, "qx"), tau=tau), truth)
            one = read.mix(p, 0.25).agg(F.lit(kind).alias("kind"), F.lit(k).alias("k"), r(F.lit(tau)).alias("tau"), r(F.avg("nll")).alias("val_nll")).first()
            out.append(tuple(one))
        own.unpersist()
        asked.unpersist()
    return w.spark.createDataFrame(out, "kind string, k int, tau double, val_nll double")


def _directions(w: Workspace, most: int, dims: int) -> DataFrame:
    """One row ``axes``: portable random directions of length 1."""
    spark = w.spark
    cells = spark.range(1, most + 1).withColumnRenamed("id", "rk").crossJoin(spark.range(1, dims + 1).withColumnRenamed("id", "i"))
    v = draw(draw(F.col("rk") * 100_000 + F.col("i"))) / 2147483648.0 - 0.5
    rows = cells.groupBy("rk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", v.alias("v")))), lambda s: s["v"]).alias("v"))
    unit = F.transform("v", lambda e: e / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", unit.alias("u")))), lambda s: s["u"]).alias("axes"))


@query(with_base("""SELECT kind, round(min(v), 6) AS ct_nll FROM (SELECT kind, i, j, avg(-ln(i * 0.1 * p_raw + j * 0.1 * b + (1 - i * 0.1 - j * 0.1) * p_lm + 1e-12)) AS v FROM (
  SELECT 'real' AS kind, p_raw, p_state AS b, p_lm FROM perq WHERE split = 'ct' UNION ALL SELECT 'shuffled', a.p_raw, b.p_state, a.p_lm FROM (SELECT *, row_number() OVER (ORDER BY query_id) AS k FROM perq WHERE split = 'ct') a
  JOIN (SELECT p_state, row_number() OVER (ORDER BY (query_id * 1103515245 + 12345) % 2147483648, query_id) AS k FROM perq WHERE split = 'ct') b USING (k)), range(0, 11) a(i), range(0, 11) c(j) WHERE i + j <= 10 GROUP BY ALL) GROUP BY kind"""))
def ensemble_control(w: Workspace) -> DataFrame:
    """Three-way ensemble against one whose compressed component is shuffled over queries."""
    ct = w.perq.where("split = 'ct'").select("query_id", "p_raw", "p_state", "p_lm")
    a = with_rank(ct, "query_id", [], "k")
    b = with_rank(ct.select("query_id", F.col("p_state").alias("b"), draw(F.col("query_id")).alias("key")), "key", ["query_id"], "k").select("b", "k")
    both = ct.select(F.lit("real").alias("kind"), "p_raw", F.col("p_state").alias("b"), "p_lm").unionByName(a.join(b, "k").select(F.lit("shuffled").alias("kind"), "p_raw", "b", "p_lm"))
    grid = w.spark.createDataFrame([(i, j) for i in range(11) for j in range(11 - i)], "i int, j int")
    x, y = F.col("i") * 0.1, F.col("j") * 0.1
    loss = both.crossJoin(F.broadcast(grid)).groupBy("kind", "i", "j").agg(F.avg(nll(x * F.col("p_raw") + y * F.col("b") + (1 - x - y) * F.col("p_lm"))).alias("v"))
    return loss.groupBy("kind").agg(r(F.min("v")).alias("ct_nll"))


@query(with_base("SELECT a.pos_id, round(list_inner_product(a.x, m.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(m.x, m.x))), 6) AS cosine FROM ds a JOIN mu m ON m.token = a.y"))
def cosine_to_mean(w: Workspace) -> DataFrame:
    """Cosine of every entry to the mean of its token, norms bounded from below."""
    from ..functions.scalar import cosine
    from ..operators.vectors import vector_sums

    mean = vector_sums(w.ds.withColumn("y", F.col("y").cast("long")), "y").select("y", F.transform("s", lambda v: v / F.col("n")).alias("m"))
    return w.ds.join(mean, "y").select("pos_id", r(cosine("x", "m")).alias("cosine"))


