"""Reads: mixing, standalone probabilities, full distributions, member kernels, hybrids, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dot, interpolate, nll_or_null, sq_dist
from ..operators import read, store
from ..operators.policy import retained_members
from ..operators.ranking import with_rank
from .base_sql import softmax_sql, state_p_sql, with_base
from .catalog import n, query, r
from .workspace import RAW_ALPHA, STATE_ALPHA, STATE_K, Workspace

K, TAU, TAU_IN, BETA = 4, 0.1, 0.1, 5.0
_S4 = ("s4", softmax_sql("snbr", K, TAU))
_MEM = ("mem", "SELECT s.query_id, s.cluster_id, s.w, a.pos_id, a.y AS token, list_distance(q.x, d.x) AS dm FROM s4 s JOIN asg a USING (cluster_id) JOIN ds d ON d.pos_id = a.pos_id JOIN q ON q.query_id = s.query_id")


def _inner(e: str, name: str = "inn", src: str = "mem") -> tuple[str, str]:
    return name, f"SELECT *, {e} / sum({e}) OVER (PARTITION BY query_id, cluster_id) AS wm FROM (SELECT *, min(dm) OVER (PARTITION BY query_id, cluster_id) AS m0 FROM {src})"


_SOFT, _GAUSS = f"exp(-(dm - m0) / {TAU_IN})", "exp(-(dm * dm - m0 * m0) / (2 * 0.5 * 0.5))"
_MP = "SELECT query_id, sum(CASE WHEN token = y THEN w * wm ELSE 0 END) AS p FROM inn JOIN q USING (query_id) GROUP BY query_id"


@query(with_base(f"SELECT query_id, round(p, 6) AS p, round(-ln({RAW_ALPHA} * p + (1 - {RAW_ALPHA}) * p_lm + 1e-12), 6) AS nll FROM pr JOIN q USING (query_id) WHERE split = 'val'"))
def knn_mix(w: Workspace) -> DataFrame:
    got = read.mix(read.raw_prob(w.raw_w, w.truth.where("split = 'val'")), RAW_ALPHA)
    return got.select("query_id", r("p"), r("nll"))


@query(with_base(f"SELECT query_id, round(p, 6) AS p, round(-ln({STATE_ALPHA} * p + (1 - {STATE_ALPHA}) * p_lm + 1e-12), 6) AS nll, round(-ln(greatest({STATE_ALPHA} * p + (1 - {STATE_ALPHA}) * p_lm, 1e-12)), 6) AS nll_clamp FROM ps JOIN q USING (query_id) WHERE split = 'val'"))
def state_mix(w: Workspace) -> DataFrame:
    got = read.state_prob(w.state_w, w.truth.where("split = 'val'"), w.dist, w.proto)
    got = read.mix(read.mix(got, STATE_ALPHA), STATE_ALPHA, "clamp", "nll_clamp")
    return got.select("query_id", r("p"), r("nll"), r("nll_clamp"))


@query(with_base(f"""SELECT q.query_id, round(sum(a.w * (coalesce(d.cnt, 0) + {BETA} * coalesce(u.p, 0)) / (p.total + {BETA})), 6) AS p
  FROM sw a JOIN q USING (query_id) JOIN proto p USING (cluster_id) LEFT JOIN dist d ON d.cluster_id = a.cluster_id AND d.token = q.y LEFT JOIN uni u ON u.token = q.y WHERE q.split = 'val' GROUP BY q.query_id"""))
def state_mix_beta(w: Workspace) -> DataFrame:
    got = read.state_prob(w.state_w, w.truth.where("split = 'val'"), w.dist, w.proto, BETA, w.unigram)
    return got.select("query_id", r("p"))


@query(with_base("SELECT query_id, round(p, 6) AS p, p > 0 AS is_finite, CASE WHEN p > 0 THEN round(-ln(p), 6) END AS nll FROM pr"))
def standalone_raw(w: Workspace) -> DataFrame:
    p = F.col("p")
    return read.raw_prob(w.raw_w, w.truth).select("query_id", r("p"), (p > 0).alias("is_finite"), r(nll_or_null(p)).alias("nll"))


@query(with_base("SELECT query_id, round(p, 6) AS p, p > 0 AS is_finite, CASE WHEN p > 0 THEN round(-ln(p), 6) END AS nll FROM ps"))
def standalone_state(w: Workspace) -> DataFrame:
    p = F.col("p")
    return read.state_prob(w.state_w, w.truth, w.dist, w.proto).select("query_id", r("p"), (p > 0).alias("is_finite"), r(nll_or_null(p)).alias("nll"))


@query(with_base("SELECT query_id, token, round(sum(w), 6) AS p FROM rw GROUP BY query_id, token"))
def full_dist_raw(w: Workspace) -> DataFrame:
    return read.raw_distribution(w.raw_w).select("query_id", "token", r("p"))


@query(with_base("SELECT a.query_id, d.token, round(sum(a.w * d.cnt / p.total), 6) AS p FROM sw a JOIN dist d USING (cluster_id) JOIN proto p USING (cluster_id) WHERE p.total > 0 GROUP BY a.query_id, d.token"))
def full_dist_state(w: Workspace) -> DataFrame:
    return read.state_distribution(w.state_w, w.dist, w.proto).select("query_id", "token", r("p"))


_TOP = ("top", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, token) AS rn FROM dist) WHERE rn <= 5")


@query(with_base(f"""SELECT q.query_id, round(sum(a.w * (coalesce(d.cnt, 0) + {BETA} * coalesce(u.p, 0)) / (p.total + {BETA} + 1e-12)), 6) AS p
  FROM sw a JOIN q USING (query_id) JOIN proto p USING (cluster_id) LEFT JOIN top d ON d.cluster_id = a.cluster_id AND d.token = q.y LEFT JOIN uni u ON u.token = q.y GROUP BY q.query_id""", _TOP))
def dense_state(w: Workspace) -> DataFrame:
    """Truncated counts over the full total."""
    return read.dense_prob(w.state_w, w.truth, store.top_tokens(w.dist, 5), w.proto, BETA, w.unigram).select("query_id", r("p"))


@query(with_base(f"""SELECT query_id, round(sum(CASE WHEN token = y THEN e ELSE 0 END) / sum(e), 6) AS p FROM (
  SELECT s.query_id, d.token, q.y, d.cnt * exp(-(s.dist - min(s.dist) OVER (PARTITION BY s.query_id)) / {TAU}) AS e FROM snbr s JOIN dist d USING (cluster_id) JOIN q USING (query_id) WHERE s.rank <= {K}) GROUP BY query_id"""))
def triple_mix(w: Workspace) -> DataFrame:
    return read.triple_prob(w.snbr.where(F.col("rank") <= K), w.truth, w.dist, TAU).select("query_id", r("p"))


def members(w: Workspace, kept: DataFrame | None = None) -> DataFrame:
    rows = w.assigned.select("pos_id", "cluster_id", F.col("y").alias("token")).join(w.ds.select("pos_id", F.col("x").alias("mx")), "pos_id")
    return rows if kept is None else rows.join(kept.select("pos_id"), "pos_id", "left_semi")


def qx(w: Workspace) -> DataFrame:
    return w.q.select("query_id", F.col("x").alias("qx"))


@query(with_base(_MP.replace("sum(CASE", "round(sum(CASE").replace("END) AS p", "END), 6) AS p"), _S4, _MEM, _inner(_SOFT)))
def s3_members(w: Workspace) -> DataFrame:
    """Compressed routing to all original members."""
    terms = read.member_sums(read.first_k(w.snbr, K, TAU), members(w), qx(w), tau=TAU_IN)
    return read.member_prob(terms, w.truth).select("query_id", r("p"))


@query(with_base(_MP.replace("sum(CASE", "round(sum(CASE").replace("END) AS p", "END), 6) AS p"), _S4, _MEM, _inner(_GAUSS)))
def kernel_gauss(w: Workspace) -> DataFrame:
    terms = read.member_sums(read.first_k(w.snbr, K, TAU), members(w), qx(w), "gauss", sigma=0.5)
    return read.member_prob(terms, w.truth).select("query_id", r("p"))


@query(with_base("SELECT query_id, round(p, 6) AS p FROM (" + state_p_sql("s4") + ")", _S4))
def kernel_uniform(w: Workspace) -> DataFrame:
    """A uniform inner kernel: must give the compressed store's own probability."""
    terms = read.member_sums(read.first_k(w.snbr, K, TAU), members(w), qx(w), "uniform")
    return read.member_prob(terms, w.truth).select("query_id", r("p"))


@query(with_base("SELECT query_id, token, round(sum(w * wm), 6) AS p FROM inn GROUP BY query_id, token", _S4, _MEM, _inner(_SOFT)))
def member_full_dist(w: Workspace) -> DataFrame:
    terms = read.member_sums(read.first_k(w.snbr, K, TAU), members(w), qx(w), tau=TAU_IN)
    return read.member_distribution(terms).select("query_id", "token", r("p"))


_MEMP = ("mem", "SELECT s.query_id, s.cluster_id, s.w, a.pos_id, a.y AS token, list_distance(q.x[1:8], d.x[1:8]) AS dm FROM s4 s JOIN asg a USING (cluster_id) JOIN ds d ON d.pos_id = a.pos_id JOIN q ON q.query_id = s.query_id")


@query(with_base(_MP.replace("sum(CASE", "round(sum(CASE").replace("END) AS p", "END), 6) AS p"), _S4, _MEMP, _inner("exp(-(dm - m0) / 0.05)")))
def projected_members(w: Workspace) -> DataFrame:
    """Inner distances in a projection, with a temperature of its own."""
    short = lambda d, c: d.withColumn(c, F.slice(c, 1, 8))
    terms = read.member_sums(read.first_k(w.snbr, K, TAU), short(members(w), "mx"), short(qx(w), "qx"), tau=0.05)
    return read.member_prob(terms, w.truth).select("query_id", r("p"))


_REG = ("rg", "SELECT r.query_id, a.cluster_id, sum(r.w) AS w FROM rw r JOIN asg a ON a.pos_id = r.entry_id GROUP BY r.query_id, a.cluster_id")


@query(with_base("SELECT query_id, round(p, 6) AS p FROM (" + state_p_sql("rg") + ")", _REG))
def s4_regroup(w: Workspace) -> DataFrame:
    return read.regrouped_prob(w.raw_w, w.assigned, w.truth, w.dist, w.proto).select("query_id", r("p"))


_RET = ("ret", "SELECT pos_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, pos_id) AS rk FROM asg) WHERE rk <= 3 AND cluster_id % 2 = 0")
_RMEM = ("rmem", "SELECT m.* FROM mem m JOIN ret t ON t.pos_id = m.pos_id")
_AFF = ("aff", """SELECT a.query_id, sum(a.w * b.ps) AS a, sum(CASE WHEN m.pm IS NOT NULL THEN a.w * (m.pm - b.ps) ELSE 0 END) AS b, sum(CASE WHEN m.pm IS NOT NULL THEN a.w ELSE 0 END) AS w_ret
  FROM s4 a JOIN (SELECT s.query_id, s.cluster_id, CASE WHEN p.total > 0 THEN coalesce(d.cnt, 0) / p.total ELSE 0 END AS ps FROM s4 s JOIN q USING (query_id) JOIN proto p USING (cluster_id) LEFT JOIN dist d ON d.cluster_id = s.cluster_id AND d.token = q.y) b USING (query_id, cluster_id)
  LEFT JOIN (SELECT query_id, cluster_id, sum(CASE WHEN token = y THEN wm ELSE 0 END) AS pm FROM rinn JOIN q USING (query_id) GROUP BY query_id, cluster_id) m USING (query_id, cluster_id) GROUP BY a.query_id""")
_HYB = (_S4, _MEM, _RET, _RMEM, _inner(_SOFT, "rinn", "rmem"), _AFF)


def affine(w: Workspace) -> DataFrame:
    kept = retained_members(w.assigned, 3).where("cluster_id % 2 = 0")
    s4 = read.first_k(w.snbr, K, TAU)
    terms = read.member_sums(s4, members(w, kept), qx(w), tau=TAU_IN)
    return read.affine_parts(s4, w.truth, w.dist, w.proto, terms)


@query(with_base("SELECT query_id, round(a, 6) AS a, round(b, 6) AS b, round(w_ret, 6) AS w_ret FROM aff", *_HYB))
def affine_parts(w: Workspace) -> DataFrame:
    return affine(w).select("query_id", r("a"), r("b"), r("w_ret"))


@query(with_base("SELECT query_id, beta, round(a + beta * b, 6) AS p FROM aff, (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS beta)", *_HYB))
def hybrid_beta(w: Workspace) -> DataFrame:
    """Every beta from one pass over the neighbours."""
    betas = w.spark.createDataFrame([(b,) for b in (0.0, 0.25, 0.5, 1.0)], "beta double")
    return affine(w).crossJoin(F.broadcast(betas)).select("query_id", "beta", r(F.col("a") + F.col("beta") * F.col("b")).alias("p"))


_J12 = ("j12", """SELECT a.cluster_id AS c1, b.cluster_id AS c2, a.y AS token, count(*) AS cnt FROM asg a JOIN
  (SELECT pos_id, cluster_id FROM (SELECT p.pos_id, c.cluster_id, row_number() OVER (PARTITION BY p.pos_id ORDER BY list_distance(p.x, c.x), c.cluster_id) AS rank FROM ds p, proto c) WHERE rank = 2) b USING (pos_id) GROUP BY 1, 2, 3""")
_NC = ("nc", """SELECT a.query_id, sum(a.w * CASE WHEN a.cluster_id = t.c1 THEN (coalesce(j.cnt, 0) + 5.0 * ps) / (coalesce(g.n12, 0) + 5.0) ELSE ps END) AS p
  FROM (SELECT s.*, q.y, CASE WHEN p.total > 0 THEN coalesce(d.cnt, 0) / p.total ELSE 0 END AS ps FROM s4 s JOIN q USING (query_id) JOIN proto p USING (cluster_id) LEFT JOIN dist d ON d.cluster_id = s.cluster_id AND d.token = q.y) a
  JOIN (SELECT s1.query_id, s1.cluster_id AS c1, s2.cluster_id AS c2 FROM snbr s1 JOIN snbr s2 USING (query_id) WHERE s1.rank = 1 AND s2.rank = 2) t USING (query_id)
  LEFT JOIN (SELECT c1, c2, sum(cnt) AS n12 FROM j12 GROUP BY c1, c2) g ON g.c1 = t.c1 AND g.c2 = t.c2 LEFT JOIN j12 j ON j.c1 = t.c1 AND j.c2 = t.c2 AND j.token = a.y GROUP BY a.query_id""")


def joint_counts(w: Workspace, depth: int = 2) -> DataFrame:
    """Tokens of raw entries by their nearest clusters."""
    own = w.state_nbr(w.centres, depth, w.ds.select(F.col("pos_id").alias("query_id"), "x"))
    ids = own.groupBy(F.col("query_id").alias("pos_id")).agg(*(F.max(F.when(F.col("rank") == i, F.col("cluster_id"))).alias(f"c{i}") for i in range(1, depth + 1)))
    return store.conditional_counts(ids.join(w.ds.select("pos_id", "y"), "pos_id"), *(f"c{i}" for i in range(1, depth + 1)))


def ranked(w: Workspace) -> DataFrame:
    return w.snbr.groupBy("query_id").agg(*(F.max(F.when(F.col("rank") == i, F.col("cluster_id"))).alias(f"c{i}") for i in (1, 2)))


@query(with_base("SELECT c1, c2, token, cnt FROM j12", _J12))
def joint_cluster_counts(w: Workspace) -> DataFrame:
    return joint_counts(w).select("c1", "c2", "token", "cnt")


@query(with_base("SELECT query_id, round(p, 6) AS p FROM nc", _S4, _J12, _NC))
def nc1(w: Workspace) -> DataFrame:
    got = read.conditional_prob(read.first_k(w.snbr, K, TAU), ranked(w), w.truth, w.dist, w.proto, joint_counts(w), 5.0)
    return got.select("query_id", r("p"))


@query(with_base("SELECT query_id, round(0.5 * s.p + 0.5 * nc.p, 6) AS p FROM nc JOIN (" + state_p_sql("s4") + ") s USING (query_id)", _S4, _J12, _NC))
def nc1_hybrid(w: Workspace) -> DataFrame:
    s4 = read.first_k(w.snbr, K, TAU)
    a = read.conditional_prob(s4, ranked(w), w.truth, w.dist, w.proto, joint_counts(w), 5.0).select("query_id", F.col("p").alias("pn"))
    b = read.state_prob(s4, w.truth, w.dist, w.proto).select("query_id", "p")
    return a.join(b, "query_id").select("query_id", r(interpolate(F.col("pn"), F.col("p"), 0.5)).alias("p"))


# Anchors: the feature of a point in a cluster is its distance difference to the nearest other prototype.
_ANC = ("anc", "SELECT cluster_id, ox, osq - sq AS dsq, x FROM (SELECT a.cluster_id, a.x, list_inner_product(a.x, a.x) AS sq, arg_min(b.x, (list_distance(a.x, b.x), b.cluster_id)) AS ox, list_inner_product(arg_min(b.x, (list_distance(a.x, b.x), b.cluster_id)), arg_min(b.x, (list_distance(a.x, b.x), b.cluster_id))) AS osq FROM proto a, proto b WHERE a.cluster_id <> b.cluster_id GROUP BY a.cluster_id, a.x)")
_Z = "-2 * (list_inner_product({0}, c.ox) - list_inner_product({0}, c.x)) + c.dsq"
_FS = ("fs", f"SELECT a.cluster_id, a.y AS token, {_Z.format('d.x')} AS z FROM asg a JOIN ds d USING (pos_id) JOIN anc c USING (cluster_id)")
_ST = ("st", """SELECT t.cluster_id, t.token, t.n, t.n / (t.n + 5.0) * t.m + 5.0 / (t.n + 5.0) * c.m AS mu, (CASE WHEN t.n < 2 THEN g.v ELSE t.n / (t.n + 5.0) * t.v + 5.0 / (t.n + 5.0) * c.v END) + 0.001 AS var
  FROM (SELECT cluster_id, token, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM fs GROUP BY 1, 2) t JOIN (SELECT cluster_id, avg(z) AS m, var_pop(z) AS v FROM fs GROUP BY 1) c USING (cluster_id), (SELECT var_pop(z) AS v FROM fs) g""")


def _at(score: str) -> tuple[str, str]:
    return "ath", f"""SELECT *, exp(s - smax) / sum(exp(s - smax)) OVER (PARTITION BY query_id, cluster_id) AS wm FROM (SELECT *, max(s) OVER (PARTITION BY query_id, cluster_id) AS smax FROM (
  SELECT a.query_id, a.cluster_id, a.w, d.token, ln(d.cnt) - ({score}) AS s FROM (SELECT s.query_id, s.cluster_id, s.w, {_Z.format('q.x')} AS z FROM s4 s JOIN q USING (query_id) JOIN anc c USING (cluster_id)) a JOIN dist d USING (cluster_id) JOIN st t ON t.cluster_id = d.cluster_id AND t.token = d.token))"""


def anchors(w: Workspace) -> DataFrame:
    """Each prototype with its nearest other one."""
    a = w.proto.select("cluster_id", F.col("x").alias("px"))
    b = w.proto.select(F.col("cluster_id").alias("other"), F.col("x").alias("ox"))
    near = F.min_by("ox", F.struct("d", "other"))
    rows = a.crossJoin(b).where("cluster_id <> other").withColumn("d", F.sqrt(sq_dist("px", "ox")))
    return rows.groupBy("cluster_id", "px").agg(near.alias("ox")).withColumn("dsq", dot("ox", "ox") - dot("px", "px"))


def feature(x: str):
    """Squared distance to the anchor minus that to the prototype, up to a constant, as a linear form."""
    return -2 * (dot(x, "ox") - dot(x, "px")) + F.col("dsq")


def anchor_stats(w: Workspace, anc: DataFrame, n0: float = 5.0, floor: float = 0.001) -> DataFrame:
    """Shrunk mean and variance of the feature for each cluster and token."""
    fs = w.assigned.select("pos_id", "cluster_id", F.col("y").alias("token")).join(w.ds.select("pos_id", "x"), "pos_id").join(anc, "cluster_id").select("cluster_id", "token", feature("x").alias("z"))
    t = fs.groupBy("cluster_id", "token").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    c = fs.groupBy("cluster_id").agg(F.avg("z").alias("cm"), F.var_pop("z").alias("cv"))
    g = fs.agg(F.var_pop("z").alias("gv"))
    lam = F.col("n") / (F.col("n") + n0)
    rows = t.join(c, "cluster_id").crossJoin(F.broadcast(g))
    var = F.when(F.col("n") < 2, F.col("gv")).otherwise(lam * F.col("v") + (1 - lam) * F.col("cv")) + floor
    return rows.select("cluster_id", "token", "n", (lam * F.col("m") + (1 - lam) * F.col("cm")).alias("mu"), var.alias("var"))


def anchor(w: Workspace, variance: bool) -> DataFrame:
    anc = anchors(w)
    s4 = read.first_k(w.snbr, K, TAU)
    zq = s4.select("query_id", "cluster_id").join(w.q.select("query_id", "x"), "query_id").join(anc, "cluster_id").select("query_id", "cluster_id", feature("x").alias("z"))
    return read.anchor_terms(s4, zq, w.dist, anchor_stats(w, anc), 0.2, variance)


@query(with_base("SELECT cluster_id, token, n, round(mu, 6) AS mu, round(var, 6) AS var FROM st", _ANC, _FS, _ST))
def cluster_token_stats(w: Workspace) -> DataFrame:
    return anchor_stats(w, anchors(w)).select("cluster_id", "token", "n", r("mu"), r("var"))


@query(with_base("SELECT query_id, round(sum(CASE WHEN token = y THEN w * wm ELSE 0 END), 6) AS p FROM ath JOIN q USING (query_id) GROUP BY query_id", _S4, _ANC, _FS, _ST, _at("(a.z - t.mu) * (a.z - t.mu) / (2 * 0.2 * 0.2)")))
def anchor_mean(w: Workspace) -> DataFrame:
    return read.member_prob(anchor(w, False), w.truth).select("query_id", r("p"))


@query(with_base("SELECT query_id, round(sum(CASE WHEN token = y THEN w * wm ELSE 0 END), 6) AS p FROM ath JOIN q USING (query_id) GROUP BY query_id", _S4, _ANC, _FS, _ST, _at("(a.z - t.mu) * (a.z - t.mu) / (2 * t.var) + 0.5 * ln(t.var)")))
def anchor_gauss(w: Workspace) -> DataFrame:
    return read.member_prob(anchor(w, True), w.truth).select("query_id", r("p"))


@query(with_base("SELECT query_id, token, round(sum(w * wm), 6) AS p FROM ath GROUP BY query_id, token", _S4, _ANC, _FS, _ST, _at("(a.z - t.mu) * (a.z - t.mu) / (2 * 0.2 * 0.2)")))
def anchor_full_dist(w: Workspace) -> DataFrame:
    return read.member_distribution(anchor(w, False)).select("query_id", "token", r("p"))


@query(with_base(f"""SELECT r.query_id, round(avg(CASE WHEN s.query_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share, round(sum(CASE WHEN s.query_id IS NOT NULL THEN r.w ELSE 0 END), 6) AS mass
  FROM rw r JOIN asg a ON a.pos_id = r.entry_id LEFT JOIN (SELECT query_id, cluster_id FROM snbr WHERE rank <= {STATE_K}) s ON s.query_id = r.query_id AND s.cluster_id = a.cluster_id GROUP BY r.query_id"""))
def neighbour_overlap(w: Workspace) -> DataFrame:
    """Raw neighbours, and their weight, that compressed routing reaches."""
    own = w.raw_w.join(w.assigned.select(F.col("pos_id").alias("entry_id"), "cluster_id"), "entry_id")
    sel = w.snbr.where(F.col("rank") <= STATE_K).select("query_id", "cluster_id", F.lit(1).alias("in"))
    rows = own.join(sel, ["query_id", "cluster_id"], "left")
    hit = F.col("in").isNotNull()
    return rows.groupBy("query_id").agg(F.avg(hit.cast("double")).alias("s"), F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("m")).select("query_id", r(F.col("s")).alias("share"), r(F.col("m")).alias("mass"))


@query(with_base("""SELECT query_id, len(list_filter(s, lambda t: NOT list_contains(v, t))) AS only_state, round(len(list_filter(s, lambda t: list_contains(v, t))) / len(s), 6) AS rebuilt FROM (
  SELECT r.query_id, list_sort(list_distinct(list(r.token))) AS v, any_value(b.s) AS s FROM rw r JOIN (SELECT x.query_id, list_distinct(list(d.token)) AS s FROM snbr x JOIN dist d USING (cluster_id) WHERE x.rank <= 2 GROUP BY x.query_id) b USING (query_id) GROUP BY r.query_id)"""))
def value_sets(w: Workspace) -> DataFrame:
    """Token sets of both reads: difference and share rebuilt."""
    raw = w.raw_w.groupBy("query_id").agg(F.collect_set("token").alias("v"))
    state = w.snbr.where("rank <= 2").join(w.dist, "cluster_id").groupBy("query_id").agg(F.collect_set("token").alias("s"))
    both = raw.join(state, "query_id")
    return both.select("query_id", n(F.size(F.array_except("s", "v")), "only_state"), r(F.size(F.array_intersect("s", "v")) / F.size("s")).alias("rebuilt"))


@query(with_base(f"""SELECT percent, round(avg(CASE WHEN rk <= nn * percent // 100 THEN nll_raw ELSE nll_state END), 6) AS nll FROM (
  SELECT *, row_number() OVER (ORDER BY delta_l DESC, query_id) AS rk, count(*) OVER () AS nn FROM val), (SELECT unnest([1, 5, 10, 25, 100]) AS percent) GROUP BY percent"""))
def oracle_switch(w: Workspace) -> DataFrame:
    """The worst queries read the full store, the rest the compressed one."""
    total = w.val.agg(F.count(F.lit(1)).alias("nn"))
    grid = w.spark.createDataFrame([(p,) for p in (1, 5, 10, 25, 100)], "percent int")
    rows = with_rank(w.val, "delta_l", ["query_id"], descending=True).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(grid))
    loss = F.when(F.col("rk") <= F.floor(F.col("nn") * F.col("percent") / 100), F.col("nll_raw")).otherwise(F.col("nll_state"))
    return rows.groupBy("percent").agg(F.avg(loss).alias("m")).select("percent", r(F.col("m")).alias("nll"))
