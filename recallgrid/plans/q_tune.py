"""Tuning on the tuning split, policies, ablations, equal-budget baselines, retention budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import compressed_bytes, interpolate, nll, raw_bytes
from ..operators import policy, read, store
from ..operators.vectors import nearest
from ..schema import draw, lcg_sql, pick, pick_sql
from .base_sql import knn_sql, lloyd_sql, softmax_sql, state_p_sql, with_base
from .catalog import n, query, r
from .q_read import _HYB
from .workspace import CLUSTERS, GRID_ALPHA, GRID_K, GRID_TAU, RAW_ALPHA, RAW_K, RAW_TAU, STATE_ALPHA, STATE_GRID_K, STATE_K, STATE_TAU, STEPS, Workspace

_LCG = lcg_sql("{0}")


def _grid_sql(ks, taus) -> str:
    rows = ", ".join(f"({i * len(taus) + j}, {k}, {t}::DOUBLE)" for i, k in enumerate(ks) for j, t in enumerate(taus))
    return f"SELECT * FROM (VALUES {rows}) g(place, k, tau)"


_ALPHAS = f"SELECT unnest([{', '.join(str(a) for a in GRID_ALPHA)}])::DOUBLE AS alpha"
_GR = [
    ("gr", _grid_sql(GRID_K, GRID_TAU)),
    ("gp", "SELECT n.query_id, g.place, g.k, g.tau, sum(CASE WHEN n.token = q.y THEN exp(-(n.dist - m.d0) / g.tau) ELSE 0 END) / sum(exp(-(n.dist - m.d0) / g.tau)) AS p FROM nbr n JOIN q USING (query_id) JOIN (SELECT query_id, min(dist) AS d0 FROM nbr GROUP BY query_id) m USING (query_id) JOIN gr g ON n.rank <= g.k GROUP BY 1, 2, 3, 4"),
    ("gl", f"SELECT q.split, g.place, g.k, g.tau, a.alpha, avg(-ln(a.alpha * g.p + (1 - a.alpha) * q.p_lm + 1e-12)) AS mean_nll FROM gp g JOIN q USING (query_id), ({_ALPHAS}) a GROUP BY 1, 2, 3, 4, 5"),
]
_GS = [
    ("gr", _grid_sql(STATE_GRID_K, GRID_TAU)),
    ("gp", "SELECT n.query_id, g.place, g.k, g.tau, sum(exp(-(n.dist - m.d0) / g.tau) * CASE WHEN t.total > 0 THEN coalesce(d.cnt, 0) / t.total ELSE 0 END) / sum(exp(-(n.dist - m.d0) / g.tau)) AS p FROM snbr n JOIN q USING (query_id) JOIN (SELECT query_id, min(dist) AS d0 FROM snbr GROUP BY query_id) m USING (query_id) JOIN proto t USING (cluster_id) LEFT JOIN dist d ON d.cluster_id = n.cluster_id AND d.token = q.y JOIN gr g ON n.rank <= g.k GROUP BY 1, 2, 3, 4"),
    _GR[2],
]
_BEST = "SELECT k, tau, alpha FROM gl WHERE split = 'ct' ORDER BY round(mean_nll, 9), place, alpha LIMIT 1"


def _pick(gl: str) -> str:
    return f"SELECT v.k, v.tau, v.alpha, c.mean_nll AS ct_nll, v.mean_nll AS val_nll FROM {gl} v JOIN {gl} c USING (place, alpha), ({_BEST.replace('gl', gl)}) b WHERE v.split = 'val' AND c.split = 'ct' AND v.k = b.k AND v.tau = b.tau AND v.alpha = b.alpha"


def alphas(w: Workspace) -> DataFrame:
    return w.spark.createDataFrame([(float(a),) for a in GRID_ALPHA], "alpha double")


def raw_losses(w: Workspace, nbr: DataFrame | None = None, ks=GRID_K) -> DataFrame:
    grid = policy.grid_frame(w.spark, ks, GRID_TAU)
    return policy.grid_losses(policy.raw_grid_probs(w.nbr if nbr is None else nbr, w.truth.select("query_id", "split", "y", "p_lm"), grid), alphas(w))


def state_losses(w: Workspace, snbr=None, dist=None, proto=None) -> DataFrame:
    grid = policy.grid_frame(w.spark, STATE_GRID_K, GRID_TAU)
    truth = w.truth.select("query_id", "split", "y", "p_lm")
    return policy.grid_losses(policy.state_grid_probs(snbr or w.snbr, truth, dist or w.dist, proto or w.proto, grid), alphas(w))


def tuned(losses: DataFrame) -> DataFrame:
    """The configuration best on ct with both splits' losses."""
    losses = losses.persist()
    pick = policy.best(losses.where("split = 'ct'")).withColumnRenamed("mean_nll", "ct_nll")
    val = losses.where("split = 'val'").select("k", "tau", "alpha", F.col("mean_nll").alias("val_nll"))
    return pick.join(val, ["k", "tau", "alpha"])


_OUT = "SELECT split, k, tau, alpha, round(mean_nll, 6) AS mean_nll FROM gl"


@query(with_base(_OUT, *_GR))
def grid_raw(w: Workspace) -> DataFrame:
    return raw_losses(w).select("split", "k", "tau", "alpha", r("mean_nll"))


@query(with_base(_OUT, *_GS))
def grid_state(w: Workspace) -> DataFrame:
    return state_losses(w).select("split", "k", "tau", "alpha", r("mean_nll"))


@query(with_base(
    f"SELECT 'raw' AS store, k, tau, alpha, round(ct_nll, 6) AS ct_nll, round(val_nll, 6) AS val_nll FROM ({_pick('gl')}) UNION ALL SELECT 'state', k, tau, alpha, round(ct_nll, 6), round(val_nll, 6) FROM ({_pick('hl')})",
    *_GR, ("hr", _GS[0][1]), ("hp", _GS[1][1].replace("gr g", "hr g")), ("hl", _GS[2][1].replace("gp g", "hp g"))))
def best_config(w: Workspace) -> DataFrame:
    """Both stores tuned on ct and evaluated once on val."""
    out = None
    for name, losses in (("raw", raw_losses(w)), ("state", state_losses(w))):
        one = tuned(losses).select(F.lit(name).alias("store"), "k", "tau", "alpha", r("ct_nll"), r("val_nll"))
        out = one if out is None else out.unionByName(one)
    return out


def _sweep_sql(b: int) -> str:
    cte = [*lloyd_sql(f"b{b}_", "ds", b, STEPS), (f"a{b}", f"SELECT p.pos_id, p.y, arg_min(c.cluster_id, (list_distance(p.x, c.x), c.cluster_id)) AS cluster_id FROM ds p, b{b}_{STEPS} c GROUP BY p.pos_id, p.y"),
           (f"d{b}", f"SELECT cluster_id, y AS token, count(*)::DOUBLE AS cnt FROM a{b} GROUP BY 1, 2"), (f"p{b}", f"SELECT c.cluster_id, c.x, coalesce(t.total, 0) AS total FROM b{b}_{STEPS} c LEFT JOIN (SELECT cluster_id, sum(cnt) AS total FROM d{b} GROUP BY 1) t USING (cluster_id)"),
           (f"n{b}", knn_sql("q", f"p{b}", 8, "cluster_id", "cluster_id")), (f"w{b}", softmax_sql(f"n{b}", 8, STATE_TAU))]
    return cte, f"SELECT {b} AS b, round(avg(-ln({STATE_ALPHA} * s.p + (1 - {STATE_ALPHA}) * q.p_lm + 1e-12)), 6) AS val_nll, (SELECT count(*) FROM d{b}) AS nnz FROM ({state_p_sql(f'w{b}', f'd{b}', f'p{b}')}) s JOIN q USING (query_id) WHERE q.split = 'val'"


_SWEEP = [_sweep_sql(b) for b in (4, 8, 32)]


@query(with_base(" UNION ALL ".join(s for _, s in _SWEEP), *(c for cs, _ in _SWEEP for c in cs)))
def sweep_b(w: Workspace) -> DataFrame:
    """The compressed store at several sizes."""
    out = None
    for b in (4, 8, 32):
        proto = store.lloyd(w.ds, b, STEPS)
        rows = store.assign_nearest(w.ds, proto, ["y"])
        dist = store.distribution(rows).persist()
        full = store.with_totals(proto, dist)
        probs = read.state_prob(read.first_k(w.state_nbr(proto, 8), 8, STATE_TAU), w.truth.where("split = 'val'"), dist, full)
        one = read.mix(probs, STATE_ALPHA).agg(F.avg("nll").alias("m")).crossJoin(dist.agg(F.count(F.lit(1)).alias("nnz")))
        one = one.select(F.lit(b).alias("b"), r(F.col("m")).alias("val_nll"), "nnz")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_base("""SELECT i * 0.05::DOUBLE AS wa, j * 0.05::DOUBLE AS wb, round(avg(-ln(i * 0.05 * p_raw + j * 0.05 * p_state + (1 - i * 0.05 - j * 0.05) * p_lm + 1e-12)), 6) AS ct_nll
  FROM perq, (SELECT unnest(range(0, 21)) AS i) a, (SELECT unnest(range(0, 21)) AS j) b WHERE split = 'ct' AND i + j <= 20 GROUP BY i, j""".replace("i * 0.05::DOUBLE AS wa, j * 0.05::DOUBLE AS wb", "round(i * 0.05::DOUBLE, 2) AS wa, round(j * 0.05::DOUBLE, 2) AS wb")))
def simplex_weights(w: Workspace) -> DataFrame:
    """Three-way interpolation over the simplex in steps of 0.05."""
    grid = w.spark.createDataFrame([(i, j) for i in range(21) for j in range(21 - i)], "i int, j int")
    a, b = F.col("i") * 0.05, F.col("j") * 0.05
    rows = w.perq.where("split = 'ct'").crossJoin(F.broadcast(grid))
    loss = nll(a * F.col("p_raw") + b * F.col("p_state") + (1 - a - b) * F.col("p_lm"))
    return rows.groupBy("i", "j").agg(F.avg(loss).alias("m")).select(F.round(a, 2).alias("wa"), F.round(b, 2).alias("wb"), r(F.col("m")).alias("ct_nll"))


@query(with_base("""SELECT round(a.i * 0.05::DOUBLE, 2) AS alpha, round(a.ct, 6) AS ct_nll, round(b.v, 6) AS val_nll FROM
  (SELECT i, avg(-ln(i * 0.05 * p_raw + (1 - i * 0.05) * p_lm + 1e-12)) AS ct FROM perq, range(0, 21) t(i) WHERE split = 'ct' GROUP BY i ORDER BY round(ct, 9), i LIMIT 1) a
  JOIN (SELECT i, avg(-ln(i * 0.05 * p_raw + (1 - i * 0.05) * p_lm + 1e-12)) AS v FROM perq, range(0, 21) t(i) WHERE split = 'val' GROUP BY i) b USING (i)"""))
def two_way_interpolation(w: Workspace) -> DataFrame:
    """Tuned on ct (the first least wins), applied to val once."""
    grid = w.spark.range(21).withColumnRenamed("id", "i")
    rows = w.perq.crossJoin(F.broadcast(grid))
    loss = rows.groupBy("split", "i").agg(F.avg(nll(interpolate(F.col("p_raw"), F.col("p_lm"), F.col("i") * 0.05))).alias("m"))
    pick = loss.where("split = 'ct'").agg(F.min_by(F.struct("i", "m"), F.struct(F.round("m", 9), "i")).alias("b")).select("b.i", F.col("b.m").alias("ct"))
    got = pick.join(loss.where("split = 'val'").select("i", F.col("m").alias("v")), "i")
    return got.select(F.round(F.col("i") * 0.05, 2).alias("alpha"), r(F.col("ct")).alias("ct_nll"), r(F.col("v")).alias("val_nll"))


# Ablations of the compressed store's contents.
_RN = "(SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, token) AS rn FROM dist)"
_KS = (5, 3, 1)


def _ablation_sql(name: str, dist: str) -> tuple[tuple[tuple[str, str], tuple[str, str]], str]:
    d, p = f"d_{name}", f"p_{name}"
    ctes = ((d, dist), (p, f"SELECT c.cluster_id, coalesce(t.total, 0) AS total FROM proto c LEFT JOIN (SELECT cluster_id, sum(cnt) AS total FROM {d} GROUP BY 1) t USING (cluster_id)"))
    return ctes, f"SELECT '{name}' AS kind, round(avg(-ln({STATE_ALPHA} * s.p + (1 - {STATE_ALPHA}) * q.p_lm + 1e-12)), 6) AS val_nll FROM ({state_p_sql('sw', d, p)}) s JOIN q USING (query_id) WHERE q.split = 'val'"


_SHUF = f"""SELECT cluster_id, token, sum(cnt) AS cnt FROM (SELECT a.cluster_id, b.token, a.cnt FROM (SELECT *, row_number() OVER (ORDER BY cluster_id, token) AS i FROM dist) a
  JOIN (SELECT token, row_number() OVER (ORDER BY {_LCG.format('cluster_id * 1000 + token')}, cluster_id, token) AS i FROM dist) b USING (i)) GROUP BY 1, 2"""
_ABL = [
    _ablation_sql("full", "SELECT * FROM dist"),
    *(_ablation_sql(f"top{k}", f"SELECT cluster_id, token, cnt FROM {_RN} WHERE rn <= {k}") for k in _KS),
    _ablation_sql("unigram", "SELECT c.cluster_id, u.token, u.p AS cnt FROM proto c, uni u"),
    _ablation_sql("shuffled_dist", _SHUF),
    _ablation_sql("shuffled_proto", f"SELECT b.cluster_id, d.token, d.cnt FROM dist d JOIN (SELECT cluster_id AS c0, row_number() OVER (ORDER BY cluster_id) AS i FROM proto) a ON a.c0 = d.cluster_id JOIN (SELECT cluster_id, row_number() OVER (ORDER BY {_LCG.format('cluster_id')}, cluster_id) AS i FROM proto) b USING (i)"),
]


def reassigned(w: Workspace) -> DataFrame:
    """Contents dealt to other prototypes."""
    a = w.proto.select(F.col("cluster_id").alias("c0"), F.row_number().over(Window.orderBy("cluster_id")).alias("i"))
    b = w.proto.select("cluster_id", F.row_number().over(Window.orderBy(draw(F.col("cluster_id")), "cluster_id")).alias("i"))
    return w.dist.withColumnRenamed("cluster_id", "c0").join(a.join(b, "i"), "c0").select("cluster_id", "token", "cnt")


@query(with_base(" UNION ALL ".join(s for _, s in _ABL), *(c for cs, _ in _ABL for c in cs)))
def ablations(w: Workspace) -> DataFrame:
    """Contents truncated and renormalised, replaced by the unigram, and shuffled."""
    kinds = {"full": w.dist} | {f"top{k}": store.top_tokens(w.dist, k).drop("rn") for k in _KS}
    kinds["unigram"] = w.proto.select("cluster_id").crossJoin(w.unigram.select("token", F.col("p").alias("cnt")))
    kinds |= {"shuffled_dist": store.shuffled_contents(w.dist), "shuffled_proto": reassigned(w)}
    rows, truth = None, w.truth.where("split = 'val'")
    for kind, dist in kinds.items():
        one = dist.select(F.lit(kind).alias("kind"), "cluster_id", "token", F.col("cnt").cast("double").alias("cnt"))
        rows = one if rows is None else rows.unionByName(one)
    totals = rows.groupBy("kind", "cluster_id").agg(F.sum("cnt").alias("total"))
    base = w.state_w.join(truth.select("query_id", "y", "p_lm"), "query_id").join(totals, "cluster_id")
    got = base.join(rows.withColumnRenamed("token", "y"), ["kind", "cluster_id", "y"], "left")
    p = got.groupBy("kind", "query_id", "p_lm").agg(F.sum(F.col("w") * F.coalesce("cnt", F.lit(0.0)) / F.col("total")).alias("p"))
    return p.groupBy("kind").agg(F.avg(nll(interpolate(F.col("p"), F.col("p_lm"), STATE_ALPHA))).alias("m")).select("kind", r(F.col("m")).alias("val_nll"))


@query(with_base(f"SELECT query_id, round(sum(CASE WHEN m.token = q.y THEN a.w ELSE 0 END), 6) AS p FROM sw a JOIN {_RN} m ON m.cluster_id = a.cluster_id AND m.rn = 1 JOIN q USING (query_id) GROUP BY query_id".replace("SELECT query_id", "SELECT a.query_id").replace("GROUP BY query_id", "GROUP BY a.query_id").replace("JOIN q USING (query_id)", "JOIN q ON q.query_id = a.query_id")))
def ablate_majority(w: Workspace) -> DataFrame:
    """Each cluster speaks for its most frequent token only."""
    top = store.top_tokens(w.dist, 1).select("cluster_id", "token")
    return read.raw_prob(w.state_w.join(top, "cluster_id"), w.truth).select("query_id", r("p"))


# The compressed store built in other ways, read alike.
_CONS = {
    "kmeans": ("SELECT pos_id, y, cluster_id FROM asg", "SELECT cluster_id, x FROM proto", "count(*)::DOUBLE"),
    "random": (f"SELECT pos_id, y, CAST({pick_sql('pos_id', CLUSTERS)} AS BIGINT) AS cluster_id FROM ds", "", "count(*)::DOUBLE"),
    "utility": ("SELECT pos_id, y, cluster_id FROM asg", "SELECT cluster_id, x FROM proto", "sum(-ln(p_lm + 1e-12) + 0.1)"),
    "query_kmeans": (f"SELECT p.pos_id, p.y, arg_min(c.cluster_id, (list_distance(p.x, c.x), c.cluster_id)) AS cluster_id FROM ds p, kq{STEPS} c GROUP BY 1, 2", f"SELECT cluster_id, x FROM kq{STEPS}", "count(*)::DOUBLE"),
}


def _construction_sql(kind: str) -> tuple[list[tuple[str, str]], str]:
    rows, proto, cnt = _CONS[kind]
    k = f"k_{kind}"
    if kind == "random":
        proto = f"SELECT cluster_id, list(v ORDER BY i) AS x FROM (SELECT cluster_id, i, avg(v) AS v FROM (SELECT r.cluster_id, unnest(d.x) AS v, generate_subscripts(d.x, 1) AS i FROM r_random r JOIN ds d USING (pos_id)) GROUP BY 1, 2) GROUP BY 1"
    ctes = [
        (f"r_{kind}", rows), (f"x_{kind}", proto), (f"d{k}", f"SELECT cluster_id, y AS token, {cnt} AS cnt FROM r_{kind} JOIN plm USING (pos_id) GROUP BY 1, 2"),
        (f"p{k}", f"SELECT c.cluster_id, c.x, coalesce(t.total, 0) AS total FROM x_{kind} c LEFT JOIN (SELECT cluster_id, sum(cnt) AS total FROM d{k} GROUP BY 1) t USING (cluster_id)"),
        (f"n{k}", knn_sql("q", f"p{k}", STATE_K, "cluster_id", "cluster_id")), (f"w{k}", softmax_sql(f"n{k}", STATE_K, STATE_TAU)),
    ]
    return ctes, f"SELECT '{kind}' AS kind, round(avg(-ln({STATE_ALPHA} * s.p + (1 - {STATE_ALPHA}) * q.p_lm + 1e-12)), 6) AS val_nll FROM ({state_p_sql(f'w{k}', f'd{k}', f'p{k}')}) s JOIN q USING (query_id) WHERE q.split = 'val'"


_CON = [_construction_sql(k) for k in _CONS]


@query(with_base(" UNION ALL ".join(s for _, s in _CON), ("ctk", "SELECT * FROM pos WHERE split = 'ct'"), *lloyd_sql("kq", "ctk", CLUSTERS, STEPS), *(c for cs, _ in _CON for c in cs)))
def constructions(w: Workspace) -> DataFrame:
    """Loss of the store by k-means, random partition, utility weights and query-fitted k-means."""
    utility = w.assigned.join(w.p_lm, "pos_id")
    fitted = store.lloyd(w.pos.where("split = 'ct'"), CLUSTERS, STEPS)
    rand = store.random_clusters(w.ds, CLUSTERS)
    stores = {
        "kmeans": (w.centres, w.dist),
        "random": (store.means(rand, CLUSTERS, 64), store.distribution(rand)),
        "utility": (w.centres, store.distribution(utility, -F.ln(F.col("p_lm") + 1e-12) + 0.1)),
        "query_kmeans": (fitted, store.distribution(store.assign_nearest(w.ds, fitted, ["y"]))),
    }
    out, truth = None, w.truth.where("split = 'val'")
    for kind, (centres, dist) in stores.items():
        weights = read.first_k(w.state_nbr(centres, STATE_K), STATE_K, STATE_TAU)
        probs = read.state_prob(weights, truth, dist, store.with_totals(centres, dist))
        one = read.mix(probs, STATE_ALPHA).agg(F.lit(kind).alias("kind"), r(F.avg("nll")).alias("val_nll"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_base(f"""SELECT kind, count(*) AS n, round(avg(cnt), 6) AS mean_uses FROM (
  SELECT 'frequency' AS kind, entry_id, cnt FROM (SELECT entry_id, count(*) AS cnt FROM nbr JOIN q USING (query_id) WHERE rank <= 10 AND split = 'ct' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)
  UNION ALL SELECT 'random', pos_id, coalesce(cnt, 0) FROM (SELECT pos_id FROM ds ORDER BY {_LCG.format('pos_id')}, pos_id LIMIT 40) LEFT JOIN (SELECT entry_id, count(*) AS cnt FROM nbr JOIN q USING (query_id) WHERE rank <= 10 AND split = 'ct' GROUP BY 1) u ON u.entry_id = pos_id
  UNION ALL SELECT 'oracle', entry_id, cnt FROM (SELECT entry_id, count(*) AS cnt FROM nbr JOIN perq USING (query_id) WHERE rank <= 10 AND split = 'val' AND delta_l > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)) GROUP BY kind"""))
def fixed_budget_retention(w: Workspace) -> DataFrame:
    """Forty entries kept at random, by use in tuning, or by use of the queries that lose (an upper bound)."""
    uses = lambda ids: w.nbr.where("rank <= 10").join(ids, "query_id", "left_semi").groupBy("entry_id").agg(F.count(F.lit(1)).alias("cnt"))
    tuned_uses = uses(w.truth.where("split = 'ct'").select("query_id"))
    top = lambda d, kind: d.orderBy(F.col("cnt").desc(), "entry_id").limit(40).select(F.lit(kind).alias("kind"), "cnt")
    rand = w.ds.select("pos_id").orderBy(draw(F.col("pos_id")), "pos_id").limit(40).withColumnRenamed("pos_id", "entry_id")
    rows = top(tuned_uses, "frequency").unionByName(top(uses(w.val.where("delta_l > 0").select("query_id")), "oracle"))
    rows = rows.unionByName(rand.join(tuned_uses, "entry_id", "left").select(F.lit("random").alias("kind"), F.coalesce("cnt", F.lit(0)).alias("cnt")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r(F.avg("cnt")).alias("mean_uses"))


# Raw entries under the compressed store's budget.
_SEL = {
    "random": f"ORDER BY {_LCG.format('pos_id')}, pos_id",
    "high_loss": "ORDER BY round(-ln(p_lm + 1e-12), 9) DESC, pos_id",
    "low_loss": "ORDER BY round(-ln(p_lm + 1e-12), 9), pos_id",
    "high_entropy": "ORDER BY round(entropy, 9) DESC, pos_id",
    "low_entropy": "ORDER BY round(entropy, 9), pos_id",
    "rarity": "ORDER BY freq, pos_id",
}
_SELX = ("dsx", "SELECT ds.*, plm.p_lm, plm.entropy, count(*) OVER (PARTITION BY ds.y) AS freq FROM ds JOIN plm USING (pos_id)")
_MED = "SELECT arg_min(pos_id, (dist, pos_id)) AS pos_id FROM asg GROUP BY cluster_id"


def _budget_sql() -> str:
    parts = [f"SELECT '{k}' AS kind, pos_id FROM (SELECT pos_id FROM dsx {o} LIMIT {CLUSTERS})" for k, o in _SEL.items()]
    return " UNION ALL ".join([*parts, f"SELECT 'medoid', pos_id FROM ({_MED})"])


def selections(w: Workspace) -> dict[str, DataFrame]:
    rows = w.ds.join(w.p_lm, "pos_id").withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("y")))
    loss, h = F.round(-F.ln(F.col("p_lm") + 1e-12), 9), F.round("entropy", 9)
    orders = {"random": draw(F.col("pos_id")), "high_loss": loss.desc(), "low_loss": loss, "high_entropy": h.desc(), "low_entropy": h, "rarity": F.col("freq")}
    out = {k: rows.orderBy(o, "pos_id").limit(CLUSTERS).select("pos_id") for k, o in orders.items()}
    return out | {"medoid": store.medoids(w.ds, w.assigned).select("pos_id")}


@query(with_base(_budget_sql(), _SELX))
def budget_selections(w: Workspace) -> DataFrame:
    out = None
    for kind, ids in selections(w).items():
        one = ids.select(F.lit(kind).alias("kind"), "pos_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_base(f"""SELECT kind, round(avg(-ln({RAW_ALPHA} * p + (1 - {RAW_ALPHA}) * p_lm + 1e-12)) FILTER (split = 'ct'), 6) AS ct_nll, round(avg(-ln({RAW_ALPHA} * p + (1 - {RAW_ALPHA}) * p_lm + 1e-12)) FILTER (split = 'val'), 6) AS val_nll FROM (
  SELECT kind, query_id, split, p_lm, sum(CASE WHEN token = y THEN e ELSE 0 END) / sum(e) AS p FROM (
    SELECT s.kind, q.query_id, q.split, q.p_lm, q.y, d.y AS token, exp(-list_distance(q.x, d.x) / {RAW_TAU}) AS e FROM sel s JOIN ds d USING (pos_id), q) GROUP BY ALL) GROUP BY kind""", _SELX, ("sel", _budget_sql())))
def budget_baselines(w: Workspace) -> DataFrame:
    """Every selection read whole: k is clipped to its size."""
    ids = budget_selections(w)
    pairs = nearest(w.q.select(F.col("query_id").alias("pos_id"), "x"), w.ds.join(ids.select("pos_id").distinct(), "pos_id", "left_semi"), CLUSTERS * 7)
    rows = pairs.join(ids.withColumnRenamed("pos_id", "entry_id"), "entry_id").join(w.ds.select(F.col("pos_id").alias("entry_id"), F.col("y").alias("token")), "entry_id").join(w.truth, "query_id")
    e = F.exp(-F.col("dist") / RAW_TAU)
    p = rows.groupBy("kind", "query_id", "split", "p_lm").agg((F.sum(F.when(F.col("token") == F.col("y"), e).otherwise(0.0)) / F.sum(e)).alias("p"))
    loss = nll(interpolate(F.col("p"), F.col("p_lm"), RAW_ALPHA))
    at = lambda s: F.avg(F.when(F.col("split") == s, loss))
    return p.groupBy("kind").agg(at("ct").alias("a"), at("val").alias("b")).select("kind", r(F.col("a")).alias("ct_nll"), r(F.col("b")).alias("val_nll"))


_BASELINES = f"""SELECT kind, round(avg(-ln({RAW_ALPHA} * p + (1 - {RAW_ALPHA}) * p_lm + 1e-12)) FILTER (split = 'ct'), 6) AS ct_nll, round(avg(-ln({RAW_ALPHA} * p + (1 - {RAW_ALPHA}) * p_lm + 1e-12)) FILTER (split = 'val'), 6) AS val_nll FROM (
  SELECT kind, query_id, split, p_lm, sum(CASE WHEN token = y THEN e ELSE 0 END) / sum(e) AS p FROM (
    SELECT s.kind, q.query_id, q.split, q.p_lm, q.y, d.y AS token, exp(-list_distance(q.x, d.x) / {RAW_TAU}) AS e FROM sel s JOIN ds d USING (pos_id), q) GROUP BY ALL) GROUP BY kind"""


@query(with_base("SELECT b.kind AS kind, b.ct_nll AS ct_nll, b.val_nll AS val_nll FROM (SELECT arg_min({'kind': kind, 'ct_nll': ct_nll, 'val_nll': val_nll}, (ct_nll, kind)) AS b FROM (" + _BASELINES + "))", _SELX, ("sel", _budget_sql())))
def best_budget_strategy(w: Workspace) -> DataFrame:
    """Chosen on ct, never on val."""
    rows = budget_baselines(w)
    return rows.agg(F.min_by(F.struct("kind", "ct_nll", "val_nll"), F.struct("ct_nll", "kind")).alias("b")).select("b.*")


_FAR = """WITH RECURSIVE far AS (SELECT 0 AS step, pos_id, 0.0::DOUBLE AS dist, [pos_id] AS chosen FROM (SELECT min(pos_id) AS pos_id FROM ds)
  UNION ALL SELECT step + 1, b.pos_id, b.d, list_append(chosen, b.pos_id) FROM (SELECT f.step, f.chosen, (SELECT {{'pos_id': arg_min(pos_id, (-round(d, 9), pos_id)), 'd': max(d)}} FROM (
    SELECT e.pos_id, min(list_distance(e.x, c.x)) AS d FROM ds e, ds c WHERE list_contains(f.chosen, c.pos_id) GROUP BY e.pos_id)) AS b FROM far f WHERE f.step < {last}))
SELECT step, pos_id, round(dist, 6) AS dist FROM far"""


@query(with_base("SELECT * FROM (" + _FAR.format(last=CLUSTERS - 1) + ")"))
def farthest_first(w: Workspace) -> DataFrame:
    """Coverage selection: each next entry is the one farthest from those chosen.

    Inherently one step after another: a pass over the store for each of the few entries chosen.
    """
    from ..operators.coverage import farthest_first as run

    return run(w.ds, CLUSTERS).select("step", "pos_id", r("dist"))


_TAUS, _ALPHAS = (0.25, 0.5, 1.0), (0.1, 0.3, 0.5)
_RETUNED = f"""SELECT kind, tau, alpha, round(ct, 6) AS ct_nll, round(val, 6) AS val_nll FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(ct, 9), tau, alpha) AS rk FROM (
  SELECT kind, tau, alpha, avg(-ln(alpha * p + (1 - alpha) * p_lm + 1e-12)) FILTER (split = 'ct') AS ct, avg(-ln(alpha * p + (1 - alpha) * p_lm + 1e-12)) FILTER (split = 'val') AS val FROM (
    SELECT kind, tau, query_id, split, p_lm, sum(CASE WHEN token = y THEN exp(-(dist - dmin) / tau) ELSE 0 END) / sum(exp(-(dist - dmin) / tau)) AS p FROM (
      SELECT s.kind, q.query_id, q.split, q.p_lm, q.y, d.y AS token, list_distance(q.x, d.x) AS dist, min(list_distance(q.x, d.x)) OVER (PARTITION BY s.kind, q.query_id) AS dmin
      FROM (SELECT * FROM sel UNION ALL SELECT 'farthest', pos_id FROM far) s JOIN ds d USING (pos_id), q), (SELECT unnest({list(_TAUS)})::DOUBLE AS tau) GROUP BY ALL),
  (SELECT unnest({list(_ALPHAS)})::DOUBLE AS alpha) GROUP BY ALL)) WHERE rk = 1"""


@query(with_base(_RETUNED, _SELX, ("sel", _budget_sql()), ("far", _FAR.format(last=CLUSTERS - 1))))
def retuned_baselines(w: Workspace) -> DataFrame:
    """Every selection of equal size, farthest-first among them, read at the temperature and mixture that are best for it on ct."""
    ids = budget_selections(w).unionByName(farthest_first(w).select(F.lit("farthest").alias("kind"), "pos_id"))
    kept = w.ds.join(ids.select("pos_id").distinct(), "pos_id", "left_semi")
    pairs = nearest(w.q.select(F.col("query_id").alias("pos_id"), "x"), kept, CLUSTERS * 8)
    rows = pairs.join(ids.withColumnRenamed("pos_id", "entry_id"), "entry_id").join(w.ds.select(F.col("pos_id").alias("entry_id"), F.col("y").alias("token")), "entry_id").join(w.truth, "query_id")
    low = F.min("dist").over(Window.partitionBy("kind", "query_id"))
    rows = rows.withColumn("gap", F.col("dist") - low)
    e = lambda tau: F.exp(-F.col("gap") / tau)
    p = rows.groupBy("kind", "query_id", "split", "p_lm").agg(*((F.sum(F.when(F.col("token") == F.col("y"), e(t)).otherwise(0.0)) / F.sum(e(t))).alias(f"p{i}") for i, t in enumerate(_TAUS)))
    loss = lambda i, a: nll(interpolate(F.col(f"p{i}"), F.col("p_lm"), a))
    grid = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), F.lit(a).alias("alpha"), loss(i, a).alias("loss")) for i, t in enumerate(_TAUS) for a in _ALPHAS)))
    at = lambda s: F.avg(F.when(F.col("split") == s, F.col("g.loss")))
    means = p.select("kind", "split", grid.alias("g")).groupBy("kind", "g.tau", "g.alpha").agg(at("ct").alias("ct"), at("val").alias("val"))
    best = means.groupBy("kind").agg(F.min_by(F.struct("tau", "alpha", "ct", "val"), F.struct(F.round("ct", 9).alias("c"), "tau", "alpha")).alias("b"))
    return best.select("kind", "b.tau", "b.alpha", r(F.col("b.ct")).alias("ct_nll"), r(F.col("b.val")).alias("val_nll"))


#: Seeds of the rebuilding sweep, mixtures each is tuned over on ct, and the temperature of its small stores.
SEEDS, SEED_ALPHAS, SMALL_TAU = (0, 1, 2), (0.1, 0.3, 0.5), 0.5
_NEAR_OF = "SELECT *, exp(-(d - min(d) OVER (PARTITION BY {by})) / {tau}) AS e FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY d, id) AS rk FROM ({src})) WHERE rk <= {k}"
_REBUILT = (
    ("sd", f"SELECT unnest({list(SEEDS)}) AS seed"),
    ("hs", f"SELECT seed, pos_id, x, y FROM ds, sd WHERE {pick_sql('chunk_id + 1000 * seed', 2)} = 0"),
    ("h0", f"SELECT seed, rk - 1 AS cluster_id, x FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_LCG.format('pos_id + 1000 * seed')}, pos_id) AS rk FROM hs) WHERE rk <= {CLUSTERS}"),
    ("ha", "SELECT seed, pos_id, x, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (SELECT p.seed, p.pos_id, p.x, c.cluster_id, list_distance(p.x, c.x) AS d FROM hs p JOIN h0 c USING (seed)) GROUP BY ALL"),
    ("hm", "SELECT seed, cluster_id, list(v ORDER BY i) AS x FROM (SELECT seed, cluster_id, i, avg(v) AS v FROM (SELECT seed, cluster_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ha) GROUP BY ALL) GROUP BY ALL"),
    ("h1", "SELECT c.seed, c.cluster_id, coalesce(m.x, c.x) AS x FROM h0 c LEFT JOIN hm m USING (seed, cluster_id)"),
    ("hb", "SELECT seed, pos_id, y, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, min(d) AS dist FROM (SELECT p.seed, p.pos_id, p.y, c.cluster_id, list_distance(p.x, c.x) AS d FROM hs p JOIN h1 c USING (seed)) GROUP BY ALL"),
    ("hk", f"SELECT 'medoid' AS kind, seed, arg_min(pos_id, (dist, pos_id)) AS pos_id FROM hb GROUP BY seed, cluster_id UNION ALL SELECT 'random', seed, pos_id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_LCG.format('pos_id + 1000 * seed + 500')}, pos_id) AS rk FROM hs) WHERE rk <= {CLUSTERS}"),
    ("hr", _NEAR_OF.format(by="seed, query_id", tau=RAW_TAU, k=RAW_K, src="SELECT s.seed, q.query_id, q.y AS want, s.y AS token, s.pos_id AS id, list_distance(q.x, s.x) AS d FROM q, hs s")),
    ("hn", _NEAR_OF.format(by="seed, query_id", tau=STATE_TAU, k=STATE_K, src="SELECT c.seed, q.query_id, q.y AS want, c.cluster_id AS id, list_distance(q.x, c.x) AS d FROM q, h1 c")),
    ("hc", "SELECT seed, cluster_id AS id, y AS want, count(*) AS cnt FROM hb GROUP BY ALL"),
    ("ht", "SELECT seed, cluster_id AS id, count(*) AS total FROM hb GROUP BY ALL"),
    ("hx", _NEAR_OF.format(by="kind, seed, query_id", tau=SMALL_TAU, k=CLUSTERS, src="SELECT k.kind, s.seed, q.query_id, q.y AS want, s.y AS token, s.pos_id AS id, list_distance(q.x, s.x) AS d FROM q, hs s JOIN hk k USING (seed, pos_id)")),
    ("hp", """SELECT 'raw' AS kind, seed, query_id, sum(CASE WHEN token = want THEN e ELSE 0 END) / sum(e) AS p FROM hr GROUP BY ALL UNION ALL SELECT kind, seed, query_id, sum(CASE WHEN token = want THEN e ELSE 0 END) / sum(e) FROM hx GROUP BY ALL
      UNION ALL SELECT 'state', seed, query_id, sum(e * coalesce(cnt / total, 0)) / sum(e) FROM hn LEFT JOIN ht USING (seed, id) LEFT JOIN hc USING (seed, id, want) GROUP BY ALL"""),
    ("hl", f"SELECT kind, seed, alpha, avg(-ln(alpha * p + (1 - alpha) * p_lm + 1e-12)) FILTER (split = 'ct') AS ct, avg(-ln(alpha * p + (1 - alpha) * p_lm + 1e-12)) FILTER (split = 'val') AS val FROM hp JOIN q USING (query_id), (SELECT unnest({list(SEED_ALPHAS)})::DOUBLE AS alpha) GROUP BY ALL"),
    ("hv", "SELECT kind, seed, arg_min(val, (round(ct, 9), alpha)) AS v FROM hl GROUP BY ALL UNION ALL SELECT 'lm', seed, avg(-ln(p_lm + 1e-12)) FROM q, sd WHERE split = 'val' GROUP BY ALL"),
)


def rebuilt(w: Workspace, seed: int) -> list[tuple]:
    """``(seed, kind, val loss)`` of stores built anew from half of the chunks, each read at the mixture best for it on ct."""
    half = w.ds.where(pick(F.col("chunk_id") + 1000 * seed, 2) == 0).select("pos_id", "x", "y").persist()
    centres = store.lloyd(half, CLUSTERS, 1, draw(F.col("pos_id") + 1000 * seed))
    own = store.assign_nearest(half, centres, ["y"]).persist()
    dist = store.distribution(own)
    token = half.select(F.col("pos_id").alias("entry_id"), F.col("y").alias("token"))
    raw = lambda rows, k, tau: read.raw_prob(read.first_k(nearest(w.keys, rows, k).join(token, "entry_id"), k, tau), w.truth)
    kept = {"medoid": store.medoids(half, own).select("pos_id"), "random": half.orderBy(draw(F.col("pos_id") + 1000 * seed + 500), "pos_id").limit(CLUSTERS).select("pos_id")}
    reads = {"raw": raw(half, RAW_K, RAW_TAU), "state": read.state_prob(read.first_k(w.state_nbr(centres), STATE_K, STATE_TAU), w.truth, dist, store.with_totals(centres, dist))}
    reads |= {kind: raw(half.join(ids, "pos_id", "left_semi"), CLUSTERS, SMALL_TAU) for kind, ids in kept.items()}
    out = []
    for kind, p in reads.items():
        loss = {(s, a): F.avg(F.when(F.col("split") == s, nll(interpolate(F.col("p"), F.col("p_lm"), a)))) for s in ("ct", "val") for a in SEED_ALPHAS}
        got = p.agg(*(c.alias(f"{s}{a}") for (s, a), c in loss.items()), F.avg(F.when(F.col("split") == "val", nll(F.col("p_lm")))).alias("lm")).first()
        best = min(SEED_ALPHAS, key=lambda a: (round(got[f"ct{a}"] or 0.0, 9), a))
        out.append((seed, kind, got[f"val{best}"]))
        if kind == "raw":
            out.append((seed, "lm", got["lm"]))
    own.unpersist()
    half.unpersist()
    return out


@query(with_base("SELECT b.kind, count(*) AS seeds, round(avg(b.v), 6) AS mean, round(stddev_pop(b.v), 6) AS std, count(*) FILTER (s.v < b.v) AS wins, round(avg(b.v - s.v), 6) AS mean_diff FROM hv b JOIN hv s USING (seed) WHERE s.kind = 'state' GROUP BY b.kind", *_REBUILT))
def seed_rebuilds(w: Workspace) -> DataFrame:
    """Stores built and tuned anew for each seed: mean and spread over seeds, and how often the compressed one wins.

    Seeds are a few and run one after another; each leaves a handful of means.
    """
    rows = w.spark.createDataFrame([row for seed in SEEDS for row in rebuilt(w, seed)], "seed int, kind string, v double")
    state = rows.where("kind = 'state'").select("seed", F.col("v").alias("s"))
    gap = F.col("v") - F.col("s")
    got = rows.join(F.broadcast(state), "seed").groupBy("kind")
    return got.agg(F.count(F.lit(1)).alias("seeds"), r(F.avg("v")).alias("mean"), r(F.stddev_pop("v")).alias("std"), F.count(F.when(gap > 0, 1)).alias("wins"), r(F.avg(gap)).alias("mean_diff"))


_HALF = f"({_LCG.format('chunk_id')} // 65536 % 2)"
_RANKED = f"""SELECT cluster_id, row_number() OVER (PARTITION BY half ORDER BY s DESC, cluster_id) AS rk, half FROM (
  SELECT top1 AS cluster_id, {_HALF} AS half, round(avg(greatest(0, delta_l)), 9) AS s FROM perq WHERE split = 'ct' GROUP BY 1, 2)"""


@query(with_base(f"SELECT half, round(beta, 2) AS beta, round(loss, 6) AS other_half_nll, kept, shared FROM (SELECT half, max(kept) AS kept, max(shared) AS shared, arg_min(beta, (round(loss, 9), beta)) AS beta, min(loss) AS loss FROM (SELECT t.half, beta, avg(-ln({STATE_ALPHA} * (a + beta * b) + (1 - {STATE_ALPHA}) * p_lm + 1e-12)) AS loss, max(k.kept) AS kept, max(k.shared) AS shared FROM (SELECT 1 - {_HALF} AS half, a, b, q.p_lm FROM aff JOIN q USING (query_id) WHERE split = 'ct') t JOIN (SELECT x.half, count(*) AS kept, count(y.cluster_id) AS shared FROM (SELECT * FROM ranked WHERE rk <= 5) x LEFT JOIN (SELECT * FROM ranked WHERE rk <= 5) y ON y.cluster_id = x.cluster_id AND y.half = 1 - x.half GROUP BY 1) k ON k.half = t.half, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS beta) GROUP BY 1, 2) GROUP BY half)", *_HYB, ("ranked", _RANKED)))
def split_selection(w: Workspace) -> DataFrame:
    """Clusters ranked on one half of the tuning chunks, beta tuned on the other, and what both halves' best five share."""
    from .q_read import affine

    half = F.floor(draw(F.col("chunk_id")) / 65536) % 2
    ct = w.perq.where("split = 'ct'").withColumn("half", half)
    s = ct.groupBy("half", F.col("top1").alias("cluster_id")).agg(F.round(F.avg(F.greatest(F.lit(0.0), "delta_l")), 9).alias("s"))
    best = s.withColumn("rk", F.row_number().over(Window.partitionBy("half").orderBy(F.col("s").desc(), "cluster_id"))).where("rk <= 5")
    other = best.select((1 - F.col("half")).alias("half"), "cluster_id", F.lit(1).alias("too"))
    kept = best.join(other, ["half", "cluster_id"], "left").groupBy("half").agg(F.count(F.lit(1)).alias("kept"), F.count("too").alias("shared"))
    rows = affine(w).where("split = 'ct'").select("query_id", "a", "b", "p_lm").join(ct.select("query_id", (1 - F.col("half")).alias("half")), "query_id")
    betas = (0.0, 0.25, 0.5, 0.75, 1.0)
    grid = F.explode(F.array(*(F.struct(F.lit(b).alias("beta"), nll(interpolate(F.col("a") + b * F.col("b"), F.col("p_lm"), STATE_ALPHA)).alias("loss")) for b in betas)))
    means = rows.select("half", grid.alias("g")).groupBy("half", "g.beta").agg(F.avg("g.loss").alias("loss"))
    tuned = means.groupBy("half").agg(F.min_by("beta", F.struct(F.round("loss", 9).alias("l"), "beta")).alias("beta"), F.min("loss").alias("loss"))
    return tuned.join(kept, "half").select("half", r("beta", 2), r(F.col("loss")).alias("other_half_nll"), "kept", "shared")


# Retention budgets.
_PRI = ("pri", "SELECT c.cluster_id, coalesce(round(avg(greatest(0, v.delta_l)), 9), 0) AS score FROM proto c LEFT JOIN (SELECT * FROM perq WHERE split = 'ct') v ON v.top1 = c.cluster_id GROUP BY c.cluster_id")
_USE = ("use", "SELECT cluster_id, round(avg(greatest(0, delta_l)), 9) AS s, count(*) AS hits FROM (SELECT top1 AS cluster_id, delta_l FROM perq WHERE split = 'ct') GROUP BY cluster_id")


def _alloc_sql(score: str, budget: int, cap: int | None, base: int) -> str:
    want = "n - least(n, {b})" if cap is None else "greatest(0, least(n - least(n, {b}), {c} - least(n, {b})))"
    want = want.format(b=base, c=cap)
    return f"""SELECT cluster_id, take FROM (SELECT cluster_id, CAST(least(n, {base}) + greatest(0, least(want, greatest(0, {budget} - sum(least(n, {base})) OVER ()) - coalesce(sum(want) OVER (ORDER BY {score}, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take
      FROM (SELECT a.cluster_id, a.n, p.score, {want} AS want FROM (SELECT cluster_id, count(*) AS n FROM asg GROUP BY 1) a JOIN pri p USING (cluster_id))) WHERE take > 0"""


@query(with_base("SELECT cluster_id, score FROM pri", _PRI))
def sensitivity_priority(w: Workspace) -> DataFrame:
    return priority(w).select("cluster_id", F.col("score"))


def priority(w: Workspace) -> DataFrame:
    """Mean positive loss against the full store of the tuning queries a cluster is nearest to."""
    hit = w.perq.where("split = 'ct'").groupBy(F.col("top1").alias("cluster_id")).agg(F.avg(F.greatest(F.lit(0.0), "delta_l")).alias("s"))
    return w.proto.select("cluster_id").join(hit, "cluster_id", "left").select("cluster_id", F.coalesce(F.round("s", 9), F.lit(0.0)).alias("score"))


@query(with_base(" UNION ALL ".join(f"SELECT '{k}' AS kind, cluster_id, take FROM ({s})" for k, s in (("uniform", _alloc_sql("1", 60, None, 0).replace("ORDER BY 1, cluster_id", "ORDER BY cluster_id")), ("selective", _alloc_sql("score DESC", 60, 10, 0)), ("hybrid", _alloc_sql("score DESC", 60, 10, 1)))), _PRI))
def allocations(w: Workspace) -> DataFrame:
    """Members kept under a budget: by cluster order, by priority with a cap, and with one each first."""
    same = w.proto.select("cluster_id", F.lit(0.0).alias("score"))
    kinds = (("uniform", policy.allocate(w.assigned, same, 60)), ("selective", policy.allocate(w.assigned, priority(w), 60, 10)), ("hybrid", policy.allocate(w.assigned, priority(w), 60, 10, 1)))
    out = None
    for kind, takes in kinds:
        one = takes.select(F.lit(kind).alias("kind"), "cluster_id", "take")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_base(f"""SELECT count(DISTINCT a.pos_id) AS kept, count(DISTINCT a.cluster_id) AS clusters, count(*) - count(DISTINCT a.pos_id) AS duplicates, count(*) FILTER (d.pos_id IS NULL) AS unknown
  FROM (SELECT pos_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, pos_id) AS rk FROM asg) JOIN ({_alloc_sql('score DESC', 60, 10, 0)}) t USING (cluster_id) WHERE rk <= take) a LEFT JOIN ds d USING (pos_id)""", _PRI))
def verify_retained(w: Workspace) -> DataFrame:
    """Structural checks of a retention set."""
    kept = policy.take_members(w.assigned, policy.allocate(w.assigned, priority(w), 60, 10))
    rows = kept.join(w.ds.select("pos_id", F.lit(1).alias("known")), "pos_id", "left")
    return rows.agg(
        F.countDistinct("pos_id").alias("kept"), F.countDistinct("cluster_id").alias("clusters"),
        (F.count(F.lit(1)) - F.countDistinct("pos_id")).alias("duplicates"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"),
    )


@query(with_base("""SELECT entry_id, uses FROM (SELECT entry_id, count(*) AS uses FROM nbr JOIN (SELECT query_id FROM perq WHERE split = 'ct' ORDER BY delta_l DESC, query_id LIMIT 15) USING (query_id) WHERE rank <= 10 GROUP BY entry_id) ORDER BY uses DESC, entry_id LIMIT 30"""))
def worst_query_retention(w: Workspace) -> DataFrame:
    """The entries most used by the queries that lose most."""
    worst = w.perq.where("split = 'ct'").orderBy(F.col("delta_l").desc(), "query_id").limit(15).select("query_id")
    uses = w.nbr.where("rank <= 10").join(worst, "query_id", "left_semi").groupBy("entry_id").agg(F.count(F.lit(1)).alias("uses"))
    return uses.orderBy(F.col("uses").desc(), "entry_id").limit(30)


@query(with_base("SELECT half, count(*) AS n, round(avg(greatest(0, delta_l)), 6) AS mean_loss FROM (SELECT *, (chunk_id * 1103515245 + 12345) % 2147483648 // 65536 % 2 AS half FROM perq WHERE split = 'ct') GROUP BY half"))
def half_splits(w: Workspace) -> DataFrame:
    """Tuning queries in halves by chunk: one ranks, the other tunes."""
    half = F.floor(draw(F.col("chunk_id")) / 65536) % 2
    rows = w.perq.where("split = 'ct'").groupBy(half.alias("half")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest(F.lit(0.0), "delta_l")).alias("m"))
    return rows.select("half", "n", r(F.col("m")).alias("mean_loss"))


# Read policies.
_AK, _AT, _AA, _AB = (1, 4, 16), (0.05, 0.25), (0.05, 0.25), (0.0, 5.0)


def _action_sql() -> str:
    rows = ["(0, 'base_only', 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)"]
    for k in _AK:
        for t in _AT:
            for a in _AA:
                for b in _AB:
                    rows.append(f"({len(rows)}, 'k{k}_t{t}_a{a}_b{b}', {k}, {t}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(action, name, k, tau, alpha, beta)"


_REW = [
    ("act", _action_sql()),
    ("rwd", """SELECT query_id, split, action, -ln(greatest(p_lm, 1e-12)) + ln(greatest(alpha * p + (1 - alpha) * p_lm, 1e-12)) AS reward FROM (
      SELECT q.query_id, q.split, q.p_lm, a.action, a.alpha, sum(exp(-(n.dist - m.d0) / a.tau) * (coalesce(d.cnt, 0) + a.beta * coalesce(u.p, 0)) / (t.total + a.beta + 1e-12)) / sum(exp(-(n.dist - m.d0) / a.tau)) AS p
      FROM snbr n JOIN q USING (query_id) JOIN (SELECT query_id, min(dist) AS d0 FROM snbr GROUP BY 1) m USING (query_id) JOIN proto t USING (cluster_id) LEFT JOIN dist d ON d.cluster_id = n.cluster_id AND d.token = q.y LEFT JOIN uni u ON u.token = q.y JOIN act a ON a.action > 0 AND n.rank <= a.k GROUP BY ALL)
      UNION ALL SELECT query_id, split, 0, 0 FROM q"""),
]


def reward(w: Workspace) -> DataFrame:
    acts = policy.action_grid(w.spark, _AK, _AT, _AA, _AB)
    return policy.rewards(w.snbr, w.truth.select("query_id", "split", "y", "p_lm"), w.dist, w.proto, w.unigram, acts)


@query(with_base("SELECT action, name, k, tau, alpha, beta, k / 300 AS fk, tau / 5 AS ft, beta / 20 AS fb FROM act", *_REW))
def action_features(w: Workspace) -> DataFrame:
    acts = policy.action_grid(w.spark, _AK, _AT, _AA, _AB)
    return acts.select("action", "name", "k", "tau", "alpha", "beta", (F.col("k") / 300).alias("fk"), (F.col("tau") / 5).alias("ft"), (F.col("beta") / 20).alias("fb"))


@query(with_base("SELECT query_id, action, round(reward, 6) AS reward FROM rwd", *_REW))
def reward_matrix(w: Workspace) -> DataFrame:
    return reward(w).select("query_id", "action", r("reward"))


@query(with_base("SELECT action, round(max(m) FILTER (split = 'ct'), 6) AS ct, round(max(m) FILTER (split = 'val'), 6) AS val FROM (SELECT split, action, avg(reward) AS m FROM rwd GROUP BY 1, 2) WHERE action = (SELECT action FROM rwd WHERE split = 'ct' GROUP BY action ORDER BY round(avg(reward), 9) DESC, action LIMIT 1) GROUP BY action", *_REW))
def best_fixed_action(w: Workspace) -> DataFrame:
    m = reward(w).groupBy("action").agg(*(F.avg(F.when(F.col("split") == s, F.col("reward"))).alias(s) for s in ("ct", "val")))
    return m.agg(F.min_by(F.struct("action", "ct", "val"), F.struct(-F.round("ct", 9), "action")).alias("b")).select("b.action", F.round("b.ct", 6).alias("ct"), F.round("b.val", 6).alias("val"))


@query(with_base("SELECT query_id, arg_min(action, (-round(reward, 9), action)) AS action, round(max(reward), 6) AS reward FROM rwd WHERE split = 'val' GROUP BY query_id", *_REW))
def oracle_policy(w: Workspace) -> DataFrame:
    got = reward(w).where("split = 'val'").groupBy("query_id").agg(F.min_by("action", F.struct(-F.round("reward", 9), "action")).alias("action"), F.max("reward").alias("m"))
    return got.select("query_id", "action", r(F.col("m")).alias("reward"))


@query(with_base(f"""SELECT f.query_id, round(f.d1, 6) AS d1, round(f.gap, 6) AS gap, round(f.d4, 6) AS d4, round(f.d8, 6) AS d8, round(f.h1, 6) AS h1, round(f.pur1, 6) AS pur1, round(f.hw, 6) AS hw, round(f.purw, 6) AS purw, round(ln(1 + f.total1), 6) AS size1, round(f.wmax, 6) AS wmax, round(q.entropy, 6) AS entropy FROM (
  SELECT query_id, max(dist) FILTER (rank = 1) AS d1, max(dist) FILTER (rank = 2) - max(dist) FILTER (rank = 1) AS gap, avg(dist) FILTER (rank <= 4) AS d4, avg(dist) AS d8, max(h) FILTER (rank = 1) AS h1, max(pur) FILTER (rank = 1) AS pur1,
    sum(w * h) AS hw, sum(w * pur) AS purw, max(total) FILTER (rank = 1) AS total1, max(w) AS wmax
  FROM sw JOIN (SELECT d.cluster_id, -sum(d.cnt / p.total * ln(d.cnt / p.total + 1e-12)) AS h, max(d.cnt / p.total) AS pur, any_value(p.total) AS total FROM dist d JOIN proto p USING (cluster_id) GROUP BY 1) s USING (cluster_id) GROUP BY query_id) f JOIN q USING (query_id)"""))
def obs_features(w: Workspace) -> DataFrame:
    """Label-free features of a query."""
    got = policy.observations(w.truth, w.snbr, w.dist, w.proto, STATE_TAU)
    return got.select("query_id", *(r(c) for c in ("d1", "gap", "d4", "d8", "h1", "pur1", "hw", "purw", "size1", "wmax", "entropy")))


@query()
def binary_gate(w: Workspace) -> DataFrame:
    """Read only where a regressor on label-free features expects a gain; fitted on ct."""
    from ..operators.heads import gate

    obs = policy.observations(w.truth, w.snbr, w.dist, w.proto, STATE_TAU)
    rows = obs.join(w.perq.select("query_id", (F.col("nll_lm") - F.col("nll_state")).alias("reward"), "nll_lm", "nll_state"), "query_id")
    got = gate(rows, ["entropy", "d1", "hw", "purw"], "reward")
    loss = F.when(F.col("predicted") > 0, F.col("nll_state")).otherwise(F.col("nll_lm"))
    return got.where("split = 'val'").agg(F.count(F.lit(1)).alias("n"), r(F.avg(loss)).alias("gated"), r(F.avg("nll_state")).alias("always"), r(F.avg("nll_lm")).alias("never"))


@query()
def learned_policy(w: Workspace) -> DataFrame:
    """One regressor over query and action features; each query takes the action promised most."""
    from ..operators.heads import gate

    acts = policy.action_grid(w.spark, _AK, _AT, _AA, _AB)
    obs = policy.observations(w.truth, w.snbr, w.dist, w.proto, STATE_TAU)
    rows = obs.join(reward(w).drop("split"), "query_id").join(F.broadcast(acts.select("action", (F.col("k") / 300).alias("fk"), (F.col("tau") / 5).alias("ft"), "alpha", (F.col("beta") / 20).alias("fb"))), "action")
    got = gate(rows, ["entropy", "d1", "gap", "d4", "d8", "h1", "pur1", "hw", "purw", "size1", "wmax", "fk", "ft", "alpha", "fb"], "reward")
    pick = got.where("split = 'val'").groupBy("query_id").agg(F.min_by(F.struct("action", "reward"), F.struct(-F.col("predicted"), "action")).alias("b"))
    return pick.agg(F.count(F.lit(1)).alias("n"), r(F.avg("b.reward")).alias("mean_reward"))


@query(with_base("""SELECT kind, n, nnz, bytes FROM (
  SELECT 'raw' AS kind, count(*) AS n, 0 AS nnz, count(*) * (4 * 64 + 8) AS bytes FROM ds
  UNION ALL SELECT 'state', (SELECT count(*) FROM proto), count(*), (SELECT count(*) FROM proto) * 4 * 64 + count(*) * 8 + ((SELECT count(*) FROM proto) + 1) * 4 FROM dist
  UNION ALL SELECT 'hybrid', (SELECT count(*) FROM proto) + 60, count(*), (SELECT count(*) FROM proto) * 4 * 64 + count(*) * 8 + ((SELECT count(*) FROM proto) + 1) * 4 + 60 * (4 * 64 + 8) FROM dist
  UNION ALL SELECT 'triples', count(*), count(*), count(*) * (4 + 4 + 4) + (SELECT count(*) FROM proto) * 4 * 64 FROM dist)"""))
def storage(w: Workspace) -> DataFrame:
    """Bytes of each kind of store by formula."""
    raw = w.ds.agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw").alias("kind"), "n", F.lit(0).cast("long").alias("nnz"), n(raw_bytes(F.col("n"), 64), "bytes"))
    c = w.proto.agg(F.count(F.lit(1)).alias("b")).crossJoin(w.dist.agg(F.count(F.lit(1)).alias("nnz")))
    size = compressed_bytes(F.col("b"), F.col("nnz"), 64)
    state = c.select(F.lit("state").alias("kind"), F.col("b").alias("n"), "nnz", n(size, "bytes"))
    hybrid = c.select(F.lit("hybrid").alias("kind"), (F.col("b") + 60).alias("n"), "nnz", n(size + raw_bytes(F.lit(60), 64), "bytes"))
    trip = c.select(F.lit("triples").alias("kind"), F.col("nnz").alias("n"), "nnz", n(F.col("nnz") * 12 + F.col("b") * 256, "bytes"))
    return raw.unionByName(state).unionByName(hybrid).unionByName(trip)


@query()
def match_budget(w: Workspace) -> DataFrame:
    """The number of clusters whose count of (cluster, token) pairs comes nearest a target, by bisection up to one cluster an entry.

    No store has fewer pairs than distinct tokens, so a target below that can't be met. Within a hundredth of the
    target the search ends.
    """
    target = 100
    floor, size = w.ds.agg(F.countDistinct("y"), F.count(F.lit(1))).first()
    low, high, best = 1, size, None
    if target < floor:
        return w.spark.createDataFrame([(target, None, floor, False)], "target int, clusters int, pairs int, feasible boolean")
    while low <= high:
        c = max(low, min(high, int(round((low * high) ** 0.5))))
        rows = store.assign_nearest(w.ds, store.lloyd(w.ds, c, 2), ["y"])
        t = store.distribution(rows).count()
        if best is None or (abs(t - target), c) < (abs(best[1] - target), best[0]):
            best = (c, t)
        if t < target:
            low = c + 1
        elif t > target:
            high = c - 1
        if abs(t - target) <= 0.01 * target:
            break
    return w.spark.createDataFrame([(target, *best, True)], "target int, clusters int, pairs int, feasible boolean")


@query()
def best_beta(w: Workspace) -> DataFrame:
    """The beta of least mean loss on ct, by golden section over one aggregate (the loss is convex)."""
    from .q_read import affine

    rows = affine(w).where("split = 'ct'").select("a", "b", "p_lm").persist()

    def loss(beta: float) -> float:
        p = F.col("a") + beta * F.col("b")
        return rows.agg(F.avg(nll(interpolate(p, F.col("p_lm"), STATE_ALPHA)))).first()[0]

    g, lo, hi = (5**0.5 - 1) / 2, 0.0, 1.0
    x, y = hi - g * (hi - lo), lo + g * (hi - lo)
    fx, fy = loss(x), loss(y)
    while hi - lo > 1e-4:
        if fx <= fy:
            hi, y, fy = y, x, fx
            x = hi - g * (hi - lo)
            fx = loss(x)
        else:
            lo, x, fx = x, y, fy
            y = lo + g * (hi - lo)
            fy = loss(y)
    beta = (lo + hi) / 2
    return w.spark.createDataFrame([(round(beta, 4), round(loss(beta), 6))], "beta double, ct_nll double")

