"""Diagnostics over per-query results: divergence, coverage, concentration, tests, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import guarded_ratio
from ..operators import read, stats, store
from ..operators import stats_extra as info
from ..operators.ranking import with_rank, with_running_sum
from ..schema import draw, lcg_sql
from .base_sql import with_base
from .catalog import n, query, r
from .q_read import _HYB, _J12, affine, anchors, feature, joint_counts  # noqa: F401
from .q_read import _ANC, _FS
from .workspace import RAW_K, Workspace

_LCG = lcg_sql("{0}")
_FR = ("fr", "SELECT query_id, token, sum(w) AS p FROM rw GROUP BY 1, 2")
_FST = ("fst", "SELECT a.query_id, d.token, sum(a.w * d.cnt / p.total) AS p FROM sw a JOIN dist d USING (cluster_id) JOIN proto p USING (cluster_id) WHERE p.total > 0 GROUP BY 1, 2")
_JS = ("js", """SELECT query_id, sum(CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END) / 2 AS js FROM (
  SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.p, 0) AS a, coalesce(y.p, 0) AS b FROM fr x FULL JOIN fst y ON x.query_id = y.query_id AND x.token = y.token) GROUP BY 1""")


def raw_dist(w: Workspace) -> DataFrame:
    return read.raw_distribution(w.raw_w)


def state_dist(w: Workspace) -> DataFrame:
    return read.state_distribution(w.state_w, w.dist, w.proto)


@query(with_base("SELECT query_id, round(js, 6) AS js FROM js", _FR, _FST, _JS))
def js_raw_state(w: Workspace) -> DataFrame:
    return info.js_divergence(raw_dist(w), state_dist(w)).select("query_id", r("js"))


@query(with_base("""SELECT a AS cluster_id, b AS other_id, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + s) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN s > 0 THEN s * ln(s / ((p + s) / 2)) ELSE 0 END) / 2, 6) AS js FROM (
  SELECT k.a, k.b, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS s FROM (SELECT a.cluster_id AS a, b.cluster_id AS b, t.token FROM proto a, proto b, (SELECT DISTINCT token FROM dist) t WHERE b.cluster_id = a.cluster_id + 1) k
  LEFT JOIN nd x ON x.cluster_id = k.a AND x.token = k.token LEFT JOIN nd y ON y.cluster_id = k.b AND y.token = k.token) GROUP BY 1, 2""", ("nd", "SELECT d.cluster_id, d.token, d.cnt / p.total AS p FROM dist d JOIN proto p USING (cluster_id)")))
def js_clusters(w: Workspace) -> DataFrame:
    """Counts normalised first; a pair with one empty side has no row."""
    nd = w.dist.join(w.proto.where("total > 0").select("cluster_id", "total"), "cluster_id").select("cluster_id", "token", (F.col("cnt") / F.col("total")).alias("p"))
    a = nd
    b = nd.withColumn("cluster_id", F.col("cluster_id") - 1)
    ids = a.select("cluster_id").distinct().join(b.select("cluster_id").distinct(), "cluster_id")
    js = info.js_divergence(a.join(ids, "cluster_id"), b.join(ids, "cluster_id"), "cluster_id")
    return js.select("cluster_id", (F.col("cluster_id") + 1).alias("other_id"), r("js"))


@query(with_base("""SELECT query_id, round(h, 6) AS entropy, round(exp(h), 6) AS effective, round(purity, 6) AS purity, support, top1 FROM (
  SELECT query_id, -sum(p * ln(p)) AS h, max(p) AS purity, count(*) AS support, arg_min(token, (-round(p, 9), token)) AS top1 FROM fr GROUP BY query_id)""", _FR))
def shape_stats(w: Workspace) -> DataFrame:
    d = raw_dist(w)
    top = d.groupBy("query_id").agg(F.min_by("token", F.struct((-F.round("p", 9)).alias("o"), "token")).alias("top1"))
    got = info.shape(d, "query_id").drop("top1").join(top, "query_id")
    return got.select("query_id", r("entropy"), r("effective"), r("purity"), "support", "top1")


@query(with_base("""SELECT cluster_id, round(-sum(p * ln(p + 1e-12)), 6) AS entropy, round(max(p), 6) AS purity FROM (
  SELECT d.cluster_id, d.cnt / p.total AS p FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, token) AS rn FROM dist) d JOIN proto p USING (cluster_id) WHERE rn <= 5) GROUP BY 1"""))
def dense_entropy_purity(w: Workspace) -> DataFrame:
    """Of truncated probabilities, not renormalised."""
    p = store.top_tokens(w.dist, 5).join(w.proto.select("cluster_id", "total"), "cluster_id").withColumn("p", F.col("cnt") / F.col("total"))
    return p.groupBy("cluster_id").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("h"), F.max("p").alias("m")).select("cluster_id", r(F.col("h")).alias("entropy"), r(F.col("m")).alias("purity"))


@query(with_base("SELECT p_raw > 0 AS raw_hit, p_state > 0 AS state_hit, count(*) AS n, round(avg(delta_l), 6) AS mean_delta_l, round(avg(nll_lm), 6) AS mean_lm FROM val GROUP BY 1, 2"))
def coverage_2x2(w: Workspace) -> DataFrame:
    got = w.val.groupBy((F.col("p_raw") > 0).alias("raw_hit"), (F.col("p_state") > 0).alias("state_hit"))
    return got.agg(F.count(F.lit(1)).alias("n"), r(F.avg("delta_l")).alias("mean_delta_l"), r(F.avg("nll_lm")).alias("mean_lm"))


@query(with_base("SELECT round(avg(CASE WHEN p_raw > 0 THEN 1.0 ELSE 0 END), 6) AS raw, round(avg(CASE WHEN p_state > 0 THEN 1.0 ELSE 0 END), 6) AS state, round(avg(CASE WHEN h THEN 1.0 ELSE 0 END), 6) AS hit4, (SELECT count(DISTINCT top1) FROM val) / (SELECT count(*) FROM proto) AS active FROM val JOIN (SELECT s.query_id, max(d.cnt) IS NOT NULL AS h FROM snbr s JOIN q USING (query_id) LEFT JOIN dist d ON d.cluster_id = s.cluster_id AND d.token = q.y WHERE s.rank <= 4 GROUP BY 1) USING (query_id)"))
def retrieval_coverage(w: Workspace) -> DataFrame:
    """Coverage of both stores, hits among the four nearest clusters, share of clusters in use."""
    own = w.dist.select("cluster_id", F.col("token").alias("y"), "cnt")
    hit = w.snbr.where("rank <= 4").join(w.truth.select("query_id", "y"), "query_id").join(own, ["cluster_id", "y"], "left").groupBy("query_id").agg(F.max("cnt").isNotNull().alias("h"))
    total = w.proto.agg(F.count(F.lit(1)).alias("b"))
    got = w.val.join(hit, "query_id").agg(info.share_of(F.col("p_raw") > 0).alias("raw"), info.share_of(F.col("p_state") > 0).alias("state"), info.share_of(F.col("h")).alias("hit4"), F.countDistinct("top1").alias("u"))
    return got.crossJoin(total).select(r("raw"), r("state"), r("hit4"), (F.col("u") / F.col("b")).alias("active"))


@query(with_base("SELECT top1 AS cluster_id, count(*) AS n, round(avg(nll_lm - nll_state), 6) AS mean_reward FROM perq GROUP BY 1 HAVING count(*) >= 3 ORDER BY round(avg(nll_lm - nll_state), 9) DESC, 1 LIMIT 10"))
def cluster_rewards(w: Workspace) -> DataFrame:
    """The ten clusters that help most, of those nearest to three queries at least."""
    got = w.perq.groupBy(F.col("top1").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("nll_lm") - F.col("nll_state")).alias("m")).where("n >= 3")
    return got.orderBy(F.round("m", 9).desc(), "cluster_id").limit(10).select("cluster_id", "n", r(F.col("m")).alias("mean_reward"))


@query(with_base("SELECT top1 AS cluster_id, count(*) AS n, round(avg(nll_lm - nll_state), 6) AS mean_reward FROM perq GROUP BY 1 HAVING count(*) >= 3 ORDER BY round(avg(nll_lm - nll_state), 9), 1 LIMIT 10"))
def cluster_rewards_bottom(w: Workspace) -> DataFrame:
    """The ten clusters that help least, of those nearest to three queries at least."""
    got = w.perq.groupBy(F.col("top1").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("nll_lm") - F.col("nll_state")).alias("m")).where("n >= 3")
    return got.orderBy(F.round("m", 9), "cluster_id").limit(10).select("cluster_id", "n", r(F.col("m")).alias("mean_reward"))


@query(with_base("SELECT p.cluster_id, count(s.query_id) AS uses FROM proto p LEFT JOIN (SELECT * FROM snbr WHERE rank <= 4) s USING (cluster_id) GROUP BY 1"))
def cluster_usage(w: Workspace) -> DataFrame:
    uses = w.snbr.where("rank <= 4").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("c"))
    return w.proto.select("cluster_id").join(uses, "cluster_id", "left").select("cluster_id", F.coalesce("c", F.lit(0)).alias("uses"))


_HY = "(SELECT -sum(c * ln(c / t)) / sum(c) FROM (SELECT token, sum(cnt) AS c, (SELECT sum(cnt) FROM dist) AS t FROM dist GROUP BY token))"
_HYC = "(SELECT -sum(d.cnt * ln(d.cnt / p.total)) / sum(d.cnt) FROM dist d JOIN proto p USING (cluster_id))"


@query(with_base(f"SELECT round({_HY}, 6) AS h, round({_HYC}, 6) AS h_given, round({_HY} - {_HYC}, 6) AS information"))
def cond_entropy(w: Workspace) -> DataFrame:
    h = info.entropies(w.dist, []).select(F.col("h"))
    hc = info.entropies(w.dist, ["cluster_id"]).select(F.col("h").alias("hc"))
    return h.crossJoin(hc).select(r("h"), r(F.col("hc")).alias("h_given"), r(F.col("h") - F.col("hc")).alias("information"))


@query(with_base("SELECT d.cluster_id, round(-sum(d.cnt / p.total * ln(d.cnt / p.total)), 6) AS entropy, round(max(d.cnt / p.total), 6) AS purity, count(*) AS tokens, CAST(max(p.total) AS BIGINT) AS size FROM dist d JOIN proto p USING (cluster_id) GROUP BY 1"))
def cluster_shapes(w: Workspace) -> DataFrame:
    p = w.dist.join(w.proto.select("cluster_id", "total"), "cluster_id").withColumn("p", F.col("cnt") / F.col("total"))
    sizes = w.proto.select("cluster_id", n("total", "size"))
    return info.shape(p, "cluster_id").join(sizes, "cluster_id").select("cluster_id", r("entropy"), r("purity"), F.col("support").alias("tokens"), "size")


@query(with_base("""SELECT round((SELECT -sum(cnt * ln(cnt / g)) / sum(cnt) FROM (SELECT c1, token, sum(cnt) AS cnt, sum(sum(cnt)) OVER (PARTITION BY c1) AS g FROM j12 GROUP BY 1, 2))
  - (SELECT -sum(cnt * ln(cnt / g)) / sum(cnt) FROM (SELECT cnt, sum(cnt) OVER (PARTITION BY c1, c2) AS g FROM j12)), 6) AS mi""", _J12))
def cond_mi(w: Workspace) -> DataFrame:
    """Plug-in information of the second nearest cluster about the token, given the nearest."""
    j = joint_counts(w).persist()
    a = info.entropies(j, ["c1"]).select(F.col("h").alias("a"))
    b = info.entropies(j, ["c1", "c2"]).select(F.col("h").alias("b"))
    return a.crossJoin(b).select(r(F.col("a") - F.col("b")).alias("mi"))


_HALF = f"floor({_LCG.format('pos_id')} / 65536)::BIGINT % 2"


@query(with_base(f"""SELECT round(avg(ln((coalesce(c.cnt, 0) + 1 * u.p) / (coalesce(t.tot, 0) + 1)) - ln(u.p)), 6) AS gain, count(*) AS n FROM (SELECT * FROM asg WHERE {_HALF} = 1) e
  JOIN (SELECT y, (count(*) + 0.5) / (sum(count(*)) OVER () + 5) AS p FROM asg WHERE {_HALF} = 0 GROUP BY y) u ON u.y = e.y
  LEFT JOIN (SELECT cluster_id, y, count(*) AS cnt FROM asg WHERE {_HALF} = 0 GROUP BY 1, 2) c ON c.cluster_id = e.cluster_id AND c.y = e.y
  LEFT JOIN (SELECT cluster_id, count(*) AS tot FROM asg WHERE {_HALF} = 0 GROUP BY 1) t ON t.cluster_id = e.cluster_id"""))
def heldout_ll(w: Workspace) -> DataFrame:
    """Held-out log-likelihood gain of conditioning on the cluster, smoothed to the marginal."""
    half = F.floor(draw(F.col("pos_id")) / 65536) % 2
    train, held = w.assigned.where(half == 0), w.assigned.where(half == 1)
    u = train.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    u = u.withColumn("p", (F.col("c") + 0.5) / (F.sum("c").over(Window.partitionBy()) + 5)).select("y", "p")
    c = store.conditional_counts(train, "cluster_id").withColumnRenamed("token", "y")
    t = train.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("tot"))
    rows = held.join(u, "y").join(c, ["cluster_id", "y"], "left").join(t, "cluster_id", "left")
    gain = F.ln((F.coalesce("cnt", F.lit(0)) + F.col("p")) / (F.coalesce("tot", F.lit(0)) + 1)) - F.ln("p")
    return rows.agg(r(F.avg(gain)).alias("gain"), F.count(F.lit(1)).alias("n"))


_QS = "count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.9), 6) AS p90, round(quantile_cont({x}, 0.95), 6) AS p95, round(quantile_cont({x}, 0.99), 6) AS p99"


@query(with_base(f"SELECT split, {_QS.format(x='delta_l')} FROM perq GROUP BY split"))
def quantiles(w: Workspace) -> DataFrame:
    got = stats.quantile_summary(w.perq, F.col("delta_l"), ["split"])
    return got.select("split", "n", *(r(c) for c in ("mean", "std", "median", "p90", "p95", "p99")))


@query(f"SELECT l_returnflag, {_QS.format(x='l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def quantiles_lineitem(w: Workspace) -> DataFrame:
    """The same summary at table scale."""
    got = stats.quantile_summary_wide(w.table("lineitem"), "l_extendedprice", ["l_returnflag"])
    return got.select("l_returnflag", "n", *(r(c) for c in ("mean", "std", "median", "p90", "p95", "p99")))


def _bins_sql(src: str, x: str, y: str, bins: int) -> str:
    edges = ", ".join(f"quantile_cont({x}, {i / bins}) AS e{i}" for i in range(1, bins))
    at = " + ".join(f"CASE WHEN {x} >= e{i} THEN 1 ELSE 0 END" for i in range(1, bins))
    return f"SELECT bin, count(*) AS n, round(avg({x}), 6) AS x_mean, round(avg({y}), 6) AS y_mean, round(quantile_cont({y}, 0.5), 6) AS y_median FROM (SELECT {x}, {y}, {at} AS bin FROM {src}, (SELECT {edges} FROM {src})) GROUP BY bin"


def _binned(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    return stats.binned(df, x, y, bins).select("bin", "n", r("x_mean"), r("y_mean"), r("y_median"))


@query(with_base(_bins_sql("perq", "delta_d", "delta_l", 5)))
def binned_stats(w: Workspace) -> DataFrame:
    return _binned(w.perq, "delta_d", "delta_l", 5)


@query(_bins_sql("lineitem", "l_quantity", "l_extendedprice", 10))
def binned_lineitem(w: Workspace) -> DataFrame:
    return _binned(w.table("lineitem"), "l_quantity", "l_extendedprice", 10)


@query(with_base("""SELECT round(avg(CASE WHEN delta_l > 0 THEN 1.0 ELSE 0 END), 6) AS worse, round(avg(CASE WHEN delta_l < 0 THEN 1.0 ELSE 0 END), 6) AS better, round(sum(greatest(delta_l, 0)), 6) AS lost, round(sum(least(delta_l, 0)), 6) AS gained,
  round(sum(CASE WHEN rk <= nn * 1 // 100 THEN greatest(delta_l, 0) ELSE 0 END) / sum(greatest(delta_l, 0)), 6) AS worst1, round(sum(CASE WHEN rk <= nn * 5 // 100 THEN greatest(delta_l, 0) ELSE 0 END) / sum(greatest(delta_l, 0)), 6) AS worst5, round(sum(CASE WHEN rk <= nn * 10 // 100 THEN greatest(delta_l, 0) ELSE 0 END) / sum(greatest(delta_l, 0)), 6) AS worst10
  FROM (SELECT *, row_number() OVER (ORDER BY delta_l DESC, query_id) AS rk, count(*) OVER () AS nn FROM perq)"""))
def loss_concentration(w: Workspace) -> DataFrame:
    total = w.perq.agg(F.count(F.lit(1)).alias("nn"))
    rows = with_rank(w.perq, "delta_l", ["query_id"], descending=True).crossJoin(F.broadcast(total))
    up, down = F.greatest("delta_l", F.lit(0.0)), F.least("delta_l", F.lit(0.0))
    part = lambda p: r(F.sum(F.when(F.col("rk") <= F.floor(F.col("nn") * p / 100), up).otherwise(0.0)) / F.sum(up)).alias(f"worst{p}")
    return rows.agg(r(info.share_of(F.col("delta_l") > 0)).alias("worse"), r(info.share_of(F.col("delta_l") < 0)).alias("better"), r(F.sum(up)).alias("lost"), r(F.sum(down)).alias("gained"), part(1), part(5), part(10))


@query(with_base("SELECT query_id, rk <= round_even(nn * 10 / 100.0, 0) AS worst FROM (SELECT *, row_number() OVER (ORDER BY delta_l DESC, query_id) AS rk, count(*) OVER () AS nn FROM val)"))
def worst_groups(w: Workspace) -> DataFrame:
    return stats.worst_flag(w.val.select("query_id", "delta_l"), "delta_l", 10).select("query_id", "worst")


_BANDS = (0, 1, 5, 10, 25, 50, 100)


@query(with_base("""SELECT band, count(*) AS n, round(avg(margin), 6) AS mean_margin, round(avg(nll_state), 6) AS mean_nll FROM (SELECT *, CASE """ + " ".join(f"WHEN rk <= nn * {b} // 100 THEN {b}" for b in _BANDS[1:]) + """ END AS band FROM (
  SELECT m.query_id, m.margin, v.nll_state, row_number() OVER (ORDER BY round(m.margin, 9), m.query_id) AS rk, count(*) OVER () AS nn FROM (SELECT query_id, max(dist) FILTER (rank = 2) - max(dist) FILTER (rank = 1) AS margin FROM snbr GROUP BY 1) m JOIN perq v USING (query_id))) GROUP BY band"""))
def boundary_bands(w: Workspace) -> DataFrame:
    """Queries by how near they lie to a boundary between clusters."""
    d = lambda k: F.max(F.when(F.col("rank") == k, F.col("dist")))
    rows = w.snbr.groupBy("query_id").agg((d(2) - d(1)).alias("margin")).join(w.perq.select("query_id", "nll_state"), "query_id")
    total = rows.agg(F.count(F.lit(1)).alias("nn"))
    rows = with_rank(rows.withColumn("_m", F.round("margin", 9)), "_m", ["query_id"]).crossJoin(F.broadcast(total))
    band = F.coalesce(*(F.when(F.col("rk") <= F.floor(F.col("nn") * b / 100), F.lit(b)) for b in _BANDS[1:]))
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("margin")).alias("mean_margin"), r(F.avg("nll_state")).alias("mean_nll"))


@query(with_base(f"""SELECT count(*) AS retrieved, count(DISTINCT entry_id) AS unique_entries, round(1 - count(DISTINCT entry_id) / count(*), 6) AS dedup,
  (SELECT round(sum(c) / max(t), 6) FROM (SELECT c, sum(c) OVER () AS t, row_number() OVER (ORDER BY c DESC, cluster_id) AS rk FROM (SELECT a.cluster_id, count(*) AS c FROM nbr n JOIN asg a ON a.pos_id = n.entry_id WHERE n.rank <= {RAW_K} GROUP BY 1)) WHERE rk <= 3) AS top3 FROM nbr WHERE rank <= {RAW_K}"""))
def neighbour_reuse(w: Workspace) -> DataFrame:
    rows = w.nbr.where(F.col("rank") <= RAW_K)
    per = rows.join(w.assigned.select(F.col("pos_id").alias("entry_id"), "cluster_id"), "entry_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("c"))
    per = per.withColumn("rk", F.row_number().over(Window.orderBy(F.col("c").desc(), "cluster_id")))
    top = per.agg(r(F.sum(F.when(F.col("rk") <= 3, F.col("c"))) / F.sum("c")).alias("top3"))
    u = F.countDistinct("entry_id")
    return rows.agg(F.count(F.lit(1)).alias("retrieved"), u.alias("unique_entries"), r(1 - u / F.count(F.lit(1))).alias("dedup")).crossJoin(top)


@query(with_base("SELECT i, entry_id, uses, round(sum(uses) OVER (ORDER BY i) / sum(uses) OVER (), 6) AS share FROM (SELECT row_number() OVER (ORDER BY uses DESC, entry_id) AS i, entry_id, uses FROM (SELECT entry_id, count(*) AS uses FROM nbr WHERE rank <= 5 GROUP BY 1))"))
def cumulative_reuse(w: Workspace) -> DataFrame:
    uses = w.nbr.where("rank <= 5").groupBy("entry_id").agg(F.count(F.lit(1)).alias("uses"))
    uses = uses.persist()
    total = uses.agg(F.sum("uses").alias("all"))
    rows = with_running_sum(with_rank(uses, "uses", ["entry_id"], "i", descending=True), "uses", ["entry_id"], F.col("uses"), "run", descending=True)
    return rows.crossJoin(F.broadcast(total)).select("i", "entry_id", "uses", r(F.col("run") / F.col("all")).alias("share"))


@query(with_base("SELECT round(sum(nll_lm - nll_state) FILTER (nll_lm > nll_raw), 6) AS kept, round(sum(nll_lm - nll_raw) FILTER (nll_lm > nll_raw), 6) AS whole, CASE WHEN sum(nll_lm - nll_raw) FILTER (nll_lm > nll_raw) > 0.01 THEN round(sum(nll_lm - nll_state) FILTER (nll_lm > nll_raw) / sum(nll_lm - nll_raw) FILTER (nll_lm > nll_raw), 6) END AS ratio FROM val"))
def gain_ratio(w: Workspace) -> DataFrame:
    up = F.col("nll_lm") > F.col("nll_raw")
    got = w.val.agg(F.sum(F.when(up, F.col("nll_lm") - F.col("nll_state"))).alias("kept"), F.sum(F.when(up, F.col("nll_lm") - F.col("nll_raw"))).alias("whole"))
    return got.select(r("kept"), r("whole"), r(guarded_ratio(F.col("kept"), F.col("whole"), 0.01)).alias("ratio"))


_S3V = ("h5", "SELECT v.query_id, v.delta_l, v.nll_raw, v.nll_state, round(-ln(0.25 * (a.a + a.b) + 0.75 * v.p_lm + 1e-12) - v.nll_raw, 9) AS dx FROM val v JOIN aff a USING (query_id)")


@query(with_base("""SELECT percent, round((sum(greatest(0, delta_l)) - sum(greatest(0, dx))) / sum(greatest(0, delta_l)), 6) AS repaired FROM (
  SELECT *, row_number() OVER (ORDER BY delta_l DESC, query_id) AS rk, count(*) OVER () AS nn FROM h5), (SELECT unnest([5, 10, 25, 100]) AS percent) WHERE rk <= round_even(nn * percent / 100.0, 0) GROUP BY percent""", *_HYB, _S3V))
def repaired_fraction(w: Workspace) -> DataFrame:
    """Positive loss that the hybrid with retained members wins back, on the worst queries."""
    a = affine(w).select("query_id", "a", "b")
    rows = w.val.join(a, "query_id")
    rows = rows.withColumn("dx", F.round(-F.ln(0.25 * (F.col("a") + F.col("b")) + 0.75 * F.col("p_lm") + 1e-12) - F.col("nll_raw"), 9))
    total = rows.agg(F.count(F.lit(1)).alias("nn"))
    grid = w.spark.createDataFrame([(p,) for p in (5, 10, 25, 100)], "percent int")
    rows = with_rank(rows, "delta_l", ["query_id"], descending=True).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(grid))
    rows = rows.where(F.col("rk") <= F.bround(F.col("nn") * F.col("percent") / 100.0))
    lost = F.sum(F.greatest(F.lit(0.0), "delta_l"))
    return rows.groupBy("percent").agg(r((lost - F.sum(F.greatest(F.lit(0.0), "dx"))) / lost).alias("repaired"))


@query(with_base("SELECT bin, count(*) AS n, round(avg(b), 6) AS mean_b FROM (SELECT b, CASE WHEN w_ret <= 0 THEN 0 WHEN w_ret <= 0.1 THEN 1 WHEN w_ret <= 0.3 THEN 2 WHEN w_ret <= 0.6 THEN 3 ELSE 4 END AS bin FROM aff) GROUP BY bin", *_HYB))
def effective_use(w: Workspace) -> DataFrame:
    """Weight that falls on clusters with retained members, in bins."""
    x = F.col("w_ret")
    at = F.when(x <= 0, 0).when(x <= 0.1, 1).when(x <= 0.3, 2).when(x <= 0.6, 3).otherwise(4)
    return affine(w).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("b")).alias("mean_b"))


@query(with_base("SELECT count(*) FILTER (delta_l >= cut) AS severe, count(*) FILTER (delta_l >= cut AND rk > k) AS beyond FROM (SELECT *, row_number() OVER (ORDER BY delta_l DESC, query_id) AS rk FROM val), (SELECT k, min(delta_l) AS cut FROM (SELECT delta_l, row_number() OVER (ORDER BY delta_l DESC, query_id) AS rk, round_even(count(*) OVER () * 10 / 100.0, 0) AS k FROM val) WHERE rk <= k GROUP BY k)"))
def severe_failures(w: Workspace) -> DataFrame:
    rows = stats.worst_flag(w.val.select("query_id", "delta_l"), "delta_l", 10)
    cut = rows.where("worst").agg(F.min("delta_l").alias("cut"))
    rows = rows.crossJoin(F.broadcast(cut))
    hit = F.col("delta_l") >= F.col("cut")
    return rows.agg(F.count(F.when(hit, 1)).alias("severe"), F.count(F.when(hit & ~F.col("worst"), 1)).alias("beyond"))


@query(with_base("SELECT round(avg(CASE WHEN nll_raw < nll_lm AND nll_state < nll_lm THEN 1.0 ELSE 0 END), 6) AS both_help, round(avg(CASE WHEN nll_raw < nll_lm AND nll_state >= nll_lm THEN 1.0 ELSE 0 END), 6) AS raw_only, round(avg(CASE WHEN nll_raw >= nll_lm AND nll_state < nll_lm THEN 1.0 ELSE 0 END), 6) AS state_only, round(avg(CASE WHEN nll_raw >= nll_lm AND nll_state >= nll_lm THEN 1.0 ELSE 0 END), 6) AS both_hurt, count(*) FILTER (nll_raw < nll_lm AND nll_state < nll_lm) / nullif(count(*) FILTER (nll_raw < nll_lm OR nll_state < nll_lm), 0) AS jaccard FROM val"))
def help_shares(w: Workspace) -> DataFrame:
    a, b = F.col("nll_raw") < F.col("nll_lm"), F.col("nll_state") < F.col("nll_lm")
    count = lambda c: F.count(F.when(c, 1))
    return w.val.agg(
        r(info.share_of(a & b)).alias("both_help"), r(info.share_of(a & ~b)).alias("raw_only"), r(info.share_of(~a & b)).alias("state_only"), r(info.share_of(~a & ~b)).alias("both_hurt"),
        F.try_divide(count(a & b), count(a | b)).alias("jaccard"),
    )


@query(with_base("SELECT quartile, count(*) AS n, round(avg(nll_lm - nll_state), 6) AS mean_gain FROM (SELECT v.*, CASE WHEN u.p >= e3 THEN 3 WHEN u.p >= e2 THEN 2 WHEN u.p >= e1 THEN 1 ELSE 0 END AS quartile FROM val v JOIN uni u ON u.token = v.y, (SELECT quantile_cont(p, 0.25) AS e1, quantile_cont(p, 0.5) AS e2, quantile_cont(p, 0.75) AS e3 FROM val JOIN uni ON token = y)) GROUP BY quartile"))
def frequency_quartiles(w: Workspace) -> DataFrame:
    rows = w.val.join(w.unigram.select(F.col("token").alias("y"), F.col("p").alias("freq")), "y")
    edges = rows.agg(F.percentile("freq", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    at = sum((F.when(F.col("freq") >= F.col("e")[i], 1).otherwise(0) for i in range(3)), F.lit(0))
    return rows.crossJoin(F.broadcast(edges)).groupBy(at.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("nll_lm") - F.col("nll_state"))).alias("mean_gain"))


_SEED = "CAST(floor(" + _LCG.format("(" + _LCG.format("query_id + 1000 * seed") + ") + 1") + " / 65536) AS BIGINT) % 2 = 0"


@query(with_base(f"""SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) FILTER (m < b) AS wins, count(*) AS seeds, round(avg(m - b) / (stddev_samp(m - b) / sqrt(count(*))), 4) AS t FROM (
  SELECT seed, avg(nll_state) AS m, avg(nll_lm) AS b FROM perq, (SELECT unnest(range(0, 20)) AS seed) WHERE {_SEED} GROUP BY seed)"""))
def seed_sweep(w: Workspace) -> DataFrame:
    """Half samples of the queries over many seeds: mean, spread, wins and paired t."""
    seeds = w.spark.range(20).withColumnRenamed("id", "seed")
    rows = w.perq.crossJoin(F.broadcast(seeds)).where(F.floor(draw(draw(F.col("query_id") + 1000 * F.col("seed")), 1) / 65536) % 2 == 0)
    per = rows.groupBy("seed").agg(F.avg("nll_state").alias("m"), F.avg("nll_lm").alias("b"))
    d = F.col("m") - F.col("b")
    t = F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1))))
    return per.agg(r(F.avg("m")).alias("mean"), r(F.stddev_pop("m")).alias("std"), F.count(F.when(d < 0, 1)).alias("wins"), F.count(F.lit(1)).alias("seeds"), r(t, 4).alias("t"))


# Tests and intervals.
@query(with_base("SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM (SELECT nll_lm - nll_state AS d FROM val)"))
def paired_t(w: Workspace) -> DataFrame:
    return stats.paired_t(w.val, "nll_lm", "nll_state").select("n", r("mean_diff"), r("se"), r("t", 4))


@query()
def paired_t_pvalue(w: Workspace) -> DataFrame:
    """With the two-sided p-value, computed from the one-row result."""
    row = stats.paired_t(w.val, "nll_lm", "nll_state").first()
    p = stats.t_sf2(row["t"], row["n"] - 1) if row["t"] is not None else None
    return w.spark.createDataFrame([(row["n"], row["t"], p)], "n long, t double, p double")


@query("SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM (SELECT l_extendedprice * (1 - l_discount) - l_extendedprice * (1 - l_tax) AS d FROM lineitem)")
def paired_t_lineitem(w: Workspace) -> DataFrame:
    x = w.table("lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("b"))
    return stats.paired_t(x, "a", "b").select("n", r("mean_diff"), r("se"), r("t", 4))


def _wilcoxon_sql(src: str) -> str:
    return f"""SELECT count(*) AS n, round(coalesce(sum(r) FILTER (d > 0), 0), 1) AS w_plus, round(coalesce(sum(r) FILTER (d < 0), 0), 1) AS w_minus FROM (
  SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM ({src}) WHERE d <> 0)"""


@query(with_base(_wilcoxon_sql("SELECT round(nll_lm - nll_state, 9) AS d FROM val")))
def wilcoxon(w: Workspace) -> DataFrame:
    return stats.wilcoxon(w.val, "nll_lm", "nll_state").select("n", r("w_plus", 1), r("w_minus", 1))


@query(_wilcoxon_sql("SELECT round(l_discount - l_tax, 9) AS d FROM lineitem"))
def wilcoxon_lineitem(w: Workspace) -> DataFrame:
    """Ranks come from counts of distinct values, so no task sorts the whole table."""
    return stats.wilcoxon(w.table("lineitem"), "l_discount", "l_tax").select("n", r("w_plus", 1), r("w_minus", 1))


def _boot_sql(src: str, draws: int) -> str:
    return f"""WITH per AS MATERIALIZED (SELECT * FROM ({src})), sums AS MATERIALIZED ({stats.poisson_sql("per", ["s", "c"], draws)}),
means AS (SELECT s / c AS mean FROM sums WHERE c <> 0)
SELECT (SELECT count(*) FROM per) AS groups, round((SELECT sum(s) / sum(c) FROM per), 6) AS point, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, round(stddev_pop(mean), 6) AS boot_se FROM means"""


def _boot(df: DataFrame, group: str, x, draws: int) -> DataFrame:
    return stats.group_bootstrap(df, group, x, draws).select("groups", *(r(c) for c in ("point", "lo", "hi", "boot_se")))


@query(with_base("SELECT * FROM (" + _boot_sql("SELECT chunk_id AS g, sum(delta_l) AS s, count(*) AS c FROM val GROUP BY 1", 500) + ")"))
def chunk_bootstrap(w: Workspace) -> DataFrame:
    """Resampling whole chunks."""
    return _boot(w.val, "chunk_id", F.col("delta_l"), 500)


@query(_boot_sql("SELECT source AS g, sum(n_chars) AS s, count(*) AS c FROM documents GROUP BY 1", 200))
def document_bootstrap(w: Workspace) -> DataFrame:
    return _boot(w.table("documents"), "source", F.col("n_chars"), 200)


@query(with_base("SELECT * FROM (" + _boot_sql("SELECT query_id AS g, sum(nll_lm - nll_state) AS s, count(*) AS c FROM val GROUP BY 1", 500) + ")"))
def paired_bootstrap(w: Workspace) -> DataFrame:
    """Resampling single queries."""
    return _boot(w.val, "query_id", F.col("nll_lm") - F.col("nll_state"), 500)


_RATIO = f"""WITH per AS MATERIALIZED (SELECT chunk_id AS g, sum(nll_lm - nll_state) AS s, sum(nll_lm - nll_raw) AS c FROM perq GROUP BY 1),
sums AS MATERIALIZED ({stats.poisson_sql("per", ["s", "c"], 500)}), means AS (SELECT s / c AS mean FROM sums WHERE abs(c) > 0.01)
SELECT point, lo, hi, stable, CASE WHEN stable < 475 THEN 'unstable' WHEN lo > 0 OR hi < 0 THEN 'stable' ELSE 'undecided' END AS label FROM (
  SELECT round((SELECT sum(s) / sum(c) FROM per), 6) AS point, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, count(*) AS stable FROM means)"""


@query(with_base("SELECT * FROM (" + _RATIO + ")"))
def recovery_ci(w: Workspace) -> DataFrame:
    """Ratio of total gains with a chunk interval; draws with a small denominator are left out, and too many of them make it unstable."""
    per = w.perq.groupBy(F.col("chunk_id").alias("g")).agg(F.sum(F.col("nll_lm") - F.col("nll_state")).alias("s"), F.sum(F.col("nll_lm") - F.col("nll_raw")).alias("c"))
    point = per.agg((F.sum("s") / F.sum("c")).alias("point"))
    means = stats.poisson_sums(per, "g", ["s", "c"], 500).where("abs(c) > 0.01").select((F.col("s") / F.col("c")).alias("x"))
    q = means.agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("stable"))
    got = point.crossJoin(q).select(r("point"), r(F.col("q")[0]).alias("lo"), r(F.col("q")[1]).alias("hi"), "stable")
    label = F.when(F.col("stable") < 475, "unstable").when((F.col("lo") > 0) | (F.col("hi") < 0), "stable").otherwise("undecided")
    return got.withColumn("label", label)


_JOINT = f"""WITH per AS MATERIALIZED (SELECT chunk_id AS g, sum(nll_lm - nll_state) AS s, sum(nll_lm - nll_raw) AS t, count(*) AS c FROM val GROUP BY 1),
sums AS MATERIALIZED ({stats.poisson_sql("per", ["s", "t", "c"], 500)}), means AS (SELECT s / c AS a, t / c AS b FROM sums WHERE c <> 0)
SELECT round(quantile_cont(a, 0.025), 6) AS state_lo, round(quantile_cont(a, 0.975), 6) AS state_hi, round(quantile_cont(b, 0.025), 6) AS raw_lo, round(quantile_cont(b, 0.975), 6) AS raw_hi,
  round(quantile_cont(a - b, 0.025), 6) AS diff_lo, round(quantile_cont(a - b, 0.975), 6) AS diff_hi, round(avg(CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 0.0 END), 6) AS both_help, count(*) AS draws FROM means"""


@query(with_base("SELECT * FROM (" + _JOINT + ")"))
def joint_bootstrap(w: Workspace) -> DataFrame:
    """Gains of both reads, their difference and their agreement over the same resampled chunks."""
    per = w.val.groupBy(F.col("chunk_id").alias("g")).agg(F.sum(F.col("nll_lm") - F.col("nll_state")).alias("s"), F.sum(F.col("nll_lm") - F.col("nll_raw")).alias("t"), F.count(F.lit(1)).alias("c"))
    means = stats.poisson_sums(per, "g", ["s", "t", "c"], 500).where("c <> 0").select((F.col("s") / F.col("c")).alias("a"), (F.col("t") / F.col("c")).alias("b"))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    got = means.agg(
        *(F.percentile(x, ends).alias(k) for k, x in (("state", F.col("a")), ("raw", F.col("b")), ("diff", F.col("a") - F.col("b")))),
        info.share_of((F.col("a") > 0) & (F.col("b") > 0)).alias("both_help"), F.count(F.lit(1)).alias("draws"),
    )
    return got.select(*(r(F.col(k)[i]).alias(f"{k}_{end}") for k in ("state", "raw", "diff") for i, end in enumerate(("lo", "hi"))), r("both_help"), "draws")


_MOMENTS = ["n", "a", "b", "aa", "bb", "ab"]
_CORR_OF = "(n * ab - a * b) / sqrt((n * aa - a * a) * (n * bb - b * b))"
_CORR_CI = f"""WITH ranked AS MATERIALIZED (SELECT query_id, chunk_id, delta_d AS x, delta_l AS y, rank() OVER (ORDER BY delta_d) + (count(*) OVER (PARTITION BY delta_d) - 1) / 2 AS rx, rank() OVER (ORDER BY delta_l) + (count(*) OVER (PARTITION BY delta_l) - 1) / 2 AS ry FROM perq),
vars AS (SELECT 'pearson' AS kind, chunk_id, x, y FROM ranked UNION ALL SELECT 'spearman', chunk_id, rx, ry FROM ranked),
mid AS (SELECT kind, avg(x) AS mx, avg(y) AS my, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 AND count(*) FILTER (y <> 0) >= 5 THEN corr(x, y) END AS point FROM vars GROUP BY kind),
per AS MATERIALIZED (SELECT kind, chunk_id AS g, count(*) AS n, sum(x - mx) AS a, sum(y - my) AS b, sum((x - mx) * (x - mx)) AS aa, sum((y - my) * (y - my)) AS bb, sum((x - mx) * (y - my)) AS ab FROM vars JOIN mid USING (kind) GROUP BY 1, 2),
draws AS (SELECT 'pearson' AS kind, * FROM ({stats.poisson_sql("(SELECT * FROM per WHERE kind = 'pearson')", _MOMENTS, 200)}) UNION ALL SELECT 'spearman', * FROM ({stats.poisson_sql("(SELECT * FROM per WHERE kind = 'spearman')", _MOMENTS, 200)}))
SELECT kind, round(max(point), 6) AS point, round(quantile_cont(c, 0.025), 6) AS lo, round(quantile_cont(c, 0.975), 6) AS hi, count(*) AS draws
FROM (SELECT kind, {_CORR_OF} AS c FROM draws WHERE (n * aa - a * a) > 1e-12 AND (n * bb - b * b) > 1e-12) JOIN mid USING (kind) WHERE point IS NOT NULL GROUP BY kind"""


@query(with_base("SELECT * FROM (" + _CORR_CI + ")"))
def correlation_interval(w: Workspace) -> DataFrame:
    """Pearson and Spearman correlations with chunk intervals; none where a side has no variance or fewer than five values differ from zero.

    Spearman's resamples correlate the ranks of the whole table. Draws are made of moments about the means, a
    row for each chunk, so nothing is sorted again.
    """
    both = stats.average_ranks(stats.average_ranks(w.perq.select("chunk_id", "delta_d", "delta_l"), F.col("delta_d"), "rx"), F.col("delta_l"), "ry")
    pairs = (("pearson", "delta_d", "delta_l"), ("spearman", "rx", "ry"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for k, x, y in pairs))
    rows = both.select("chunk_id", F.explode(each).alias("e")).select("chunk_id", "e.*")
    fair = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0) & (F.count(F.when(F.col("y") != 0, 1)) >= 5)
    mid = rows.groupBy("kind").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.when(fair, F.corr("x", "y")).alias("point"))
    c = rows.join(F.broadcast(mid), "kind").select("kind", "chunk_id", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"), "point")
    per = c.groupBy("kind", F.col("chunk_id").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("u").alias("a"), F.sum("v").alias("b"), F.sum(F.col("u") * F.col("u")).alias("aa"), F.sum(F.col("v") * F.col("v")).alias("bb"),
        F.sum(F.col("u") * F.col("v")).alias("ab"), F.max("point").alias("point"),
    )
    draws = stats.poisson_sums(per.where("point IS NOT NULL"), "g", _MOMENTS, 200, ["kind", "point"]).where("(n * aa - a * a) > 1e-12 AND (n * bb - b * b) > 1e-12")
    got = draws.groupBy("kind", "point").agg(F.percentile(F.expr(_CORR_OF), F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("draws"))
    return got.select("kind", r("point"), r(F.col("q")[0]).alias("lo"), r(F.col("q")[1]).alias("hi"), "draws")


@query(with_base("SELECT count(*) AS n, round(corr(delta_d, delta_l), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM (SELECT delta_d, delta_l, rank() OVER (ORDER BY delta_d) + (count(*) OVER (PARTITION BY delta_d) - 1) / 2 AS ra, rank() OVER (ORDER BY delta_l) + (count(*) OVER (PARTITION BY delta_l) - 1) / 2 AS rb FROM perq)"))
def spearman(w: Workspace) -> DataFrame:
    return stats.spearman(w.perq, "delta_d", "delta_l").select("n", r("pearson"), r("spearman"))


@query("SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem))")
def spearman_lineitem(w: Workspace) -> DataFrame:
    return stats.spearman(w.table("lineitem"), "l_quantity", "l_extendedprice").select("n", r("pearson"), r("spearman"))


@query(with_base("SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY round(d_raw, 9), query_id) AS ra, row_number() OVER (ORDER BY round(d_state, 9), query_id) AS rb FROM perq)"))
def rank_of_rank(w: Workspace) -> DataFrame:
    rows = w.perq.select("query_id", F.round("d_raw", 9).alias("x"), F.round("d_state", 9).alias("y"))
    rows = with_rank(with_rank(rows, "x", ["query_id"], "a"), "y", ["query_id"], "b")
    return rows.agg(r(F.corr("a", "b")).alias("rho"))


@query(with_base("SELECT flag, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT CASE WHEN lo > 0 THEN 'worse' WHEN hi < 0 THEN 'better' ELSE 'undecided' END AS flag, lo, hi FROM (" + _boot_sql("SELECT chunk_id AS g, sum(delta_l) AS s, count(*) AS c FROM val GROUP BY 1", 500) + "))"))
def decision_flags(w: Workspace) -> DataFrame:
    """Mechanical decision from an interval."""
    got = stats.group_bootstrap(w.val, "chunk_id", F.col("delta_l"), 500)
    lo, hi = F.round("lo", 6), F.round("hi", 6)
    return got.select(F.when(lo > 0, "worse").when(hi < 0, "better").otherwise("undecided").alias("flag"), lo.alias("lo"), hi.alias("hi"))


# Geometry within clusters.
_PAIR = ("pair", "SELECT a.cluster_id, a.pos_id, a.y, b.pos_id AS other, b.y AS oy, row_number() OVER (PARTITION BY a.pos_id ORDER BY list_distance(x.x, z.x), b.pos_id) AS rk FROM asg a JOIN asg b USING (cluster_id) JOIN ds x ON x.pos_id = a.pos_id JOIN ds z ON z.pos_id = b.pos_id WHERE a.pos_id <> b.pos_id")


@query(with_base("SELECT round(avg(CASE WHEN y = oy THEN 1.0 ELSE 0 END), 6) AS purity, round((SELECT sum(p.total * s) / sum(p.total) FROM proto p JOIN (SELECT d.cluster_id, sum((d.cnt / p.total) * (d.cnt / p.total)) AS s FROM dist d JOIN proto p USING (cluster_id) GROUP BY 1) USING (cluster_id)), 6) AS baseline FROM pair WHERE rk <= 3", _PAIR))
def local_purity(w: Workspace) -> DataFrame:
    """Same-token share among the nearest members, and what random mixing gives."""
    from ..operators.geometry import cluster_neighbours

    near = cluster_neighbours(w.assigned.join(w.ds.select("pos_id", "x"), "pos_id"), 3)
    y = w.assigned.select("pos_id", "y")
    rows = near.join(y, "pos_id").join(y.select(F.col("pos_id").alias("other"), F.col("y").alias("oy")), "other")
    p = w.dist.join(w.proto.select("cluster_id", "total"), "cluster_id").groupBy("cluster_id").agg(F.sum((F.col("cnt") / F.col("total")) * (F.col("cnt") / F.col("total"))).alias("s"), F.max("total").alias("t"))
    base = p.agg((F.sum(F.col("t") * F.col("s")) / F.sum("t")).alias("b"))
    return rows.agg(info.share_of(F.col("y") == F.col("oy")).alias("p")).crossJoin(base).select(r(F.col("p")).alias("purity"), r(F.col("b")).alias("baseline"))


_SH = ("sh", f"""SELECT a.cluster_id, a.pos_id, b.y FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos_id) AS i FROM asg) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_LCG.format('pos_id')}, pos_id) AS i FROM asg) b ON a.cluster_id = b.cluster_id AND a.i = b.i""")
_COH = "SELECT '{k}' AS kind, count(*) AS pairs, round(avg(list_distance(x.x, z.x)), 6) AS mean_dist FROM {s} a JOIN {s} b ON a.cluster_id = b.cluster_id AND a.y = b.y AND a.pos_id < b.pos_id JOIN ds x ON x.pos_id = a.pos_id JOIN ds z ON z.pos_id = b.pos_id"


@query(with_base(_COH.format(k="real", s="asg") + " UNION ALL " + _COH.format(k="shuffled", s="sh"), _SH))
def cohesion(w: Workspace) -> DataFrame:
    """Mean distance of same-token members of a cluster, against tokens shuffled within it.

    A group's mean pair distance is found inside the group; nothing is paired across groups.
    """
    from ..operators.geometry import mean_pair_distance

    x = w.assigned.join(w.ds.select("pos_id", "x"), "pos_id")
    a = x.withColumn("i", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos_id")))
    b = w.assigned.select("cluster_id", F.col("y").alias("sy"), F.row_number().over(Window.partitionBy("cluster_id").orderBy(draw(F.col("pos_id")), "pos_id")).alias("i"))
    shuffled = a.join(b, ["cluster_id", "i"]).select("cluster_id", "pos_id", "x", F.col("sy").alias("y"))
    out = None
    for kind, rows in (("real", x), ("shuffled", shuffled)):
        s = mean_pair_distance(rows).agg(n(F.sum("pairs"), "pairs"), (F.sum("total") / F.sum("pairs")).alias("m"))
        one = s.select(F.lit(kind).alias("kind"), "pairs", r(F.col("m")).alias("mean_dist"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_base("""SELECT cluster_id, round(avg(CASE WHEN y = best THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM (
  SELECT f.cluster_id, f.pos_id, f.y, arg_min(t.token, (round(abs(f.z - CASE WHEN t.token = f.y THEN (t.s - f.z) / (t.n - 1) ELSE t.s / t.n END), 9), t.token)) AS best FROM (SELECT a.pos_id, a.y, fs.* FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos_id) AS i FROM asg) a JOIN fz fs USING (pos_id)) f
  JOIN tz t ON t.cluster_id = f.cluster_id JOIN (SELECT cluster_id FROM tz GROUP BY 1 HAVING count(*) >= 2) k ON k.cluster_id = f.cluster_id WHERE f.y IN (SELECT token FROM tz u WHERE u.cluster_id = f.cluster_id) GROUP BY 1, 2, 3) GROUP BY cluster_id""",
  _ANC, ("fz", _FS[1].replace("SELECT a.cluster_id, a.y AS token,", "SELECT a.pos_id, a.cluster_id,")), ("tz", "SELECT f.cluster_id, a.y AS token, sum(f.z) AS s, count(*) AS n FROM fz f JOIN asg a USING (pos_id) GROUP BY 1, 2 HAVING count(*) >= 2")))
def loo_accuracy(w: Workspace) -> DataFrame:
    """Nearest class mean of the feature with the point's own contribution removed; no singletons."""
    fz = w.assigned.select("pos_id", "cluster_id", "y").join(w.ds.select("pos_id", "x"), "pos_id").join(anchors(w), "cluster_id").select("pos_id", "cluster_id", "y", feature("x").alias("z"))
    tz = fz.groupBy("cluster_id", F.col("y").alias("token")).agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 2").persist()
    many = tz.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("cluster_id")
    points = fz.join(tz.select("cluster_id", F.col("token").alias("y")), ["cluster_id", "y"]).join(many, "cluster_id")
    rows = points.join(tz, "cluster_id")
    mean = F.when(F.col("token") == F.col("y"), (F.col("s") - F.col("z")) / (F.col("n") - 1)).otherwise(F.col("s") / F.col("n"))
    best = rows.groupBy("cluster_id", "pos_id", "y").agg(F.min_by("token", F.struct(F.round(F.abs(F.col("z") - mean), 9).alias("d"), "token")).alias("best"))
    return best.groupBy("cluster_id").agg(r(info.share_of(F.col("y") == F.col("best"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


_CELLS = ("cells", "SELECT a.cluster_id AS a, a.y AS b, count(*) AS n FROM asg a GROUP BY 1, 2")


@query(with_base("""SELECT round((pc - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(2 * (lc / t - la / t - lb / t + ln(t)) / ((ln(t) - la / t) + (ln(t) - lb / t)), 6) AS nmi FROM
  (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS pc, sum(n * ln(n)) AS lc FROM cells), (SELECT sum(m * (m - 1) / 2) AS pa, sum(m * ln(m)) AS la FROM (SELECT a, sum(n) AS m FROM cells GROUP BY a)), (SELECT sum(m * (m - 1) / 2) AS pb, sum(m * ln(m)) AS lb FROM (SELECT b, sum(n) AS m FROM cells GROUP BY b))""", _CELLS))
def ari_nmi(w: Workspace) -> DataFrame:
    """Agreement of clusters with tokens from their contingency table."""
    return info.ari_nmi(info.contingency(w.assigned, "cluster_id", "y")).select(r("ari"), r("nmi"))


# Token means against store contents.
_TSIM = ("tsim", """SELECT a.token AS t1, b.token AS t2, list_cosine_similarity(a.x, b.x) AS emb, list_cosine_similarity(a.v, b.v) AS pred FROM tv a JOIN tv b ON a.token < b.token""")
_TV = ("tv", "SELECT m.token, m.x, v.v FROM mu m JOIN (SELECT token, list(coalesce(cnt, 0)::DOUBLE ORDER BY cluster_id) AS v FROM (SELECT t.token, p.cluster_id, d.cnt FROM (SELECT DISTINCT token FROM dist) t CROSS JOIN proto p LEFT JOIN dist d ON d.cluster_id = p.cluster_id AND d.token = t.token) GROUP BY 1) v USING (token)")


def token_pairs(w: Workspace) -> DataFrame:
    """Cosine of token mean vectors and of their cluster profiles, for every pair of tokens."""
    from ..functions.scalar import cosine
    from ..operators.vectors import vector_sums

    mean = vector_sums(w.ds.withColumn("token", F.col("y").cast("long")), "token").select("token", F.transform("s", lambda v: v / F.col("n")).alias("x"))
    grid = w.dist.select("token").distinct().crossJoin(w.proto.select("cluster_id")).join(w.dist, ["cluster_id", "token"], "left")
    prof = grid.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", F.coalesce("cnt", F.lit(0.0)).alias("c")))), lambda s: s["c"]).alias("v"))
    t = mean.join(prof, "token").persist()
    a = t.select(F.col("token").alias("t1"), F.col("x").alias("x1"), F.col("v").alias("v1"))
    b = t.select(F.col("token").alias("t2"), F.col("x").alias("x2"), F.col("v").alias("v2"))
    return a.join(b, F.col("t1") < F.col("t2")).select("t1", "t2", cosine("x1", "x2").alias("emb"), cosine("v1", "v2").alias("pred"))


@query(with_base("SELECT t1, t2, round(emb, 6) AS emb, round(pred, 6) AS pred FROM tsim", _TV, _TSIM))
def token_alignment(w: Workspace) -> DataFrame:
    return token_pairs(w).select(n("t1"), n("t2"), r("emb"), r("pred"))


@query(with_base("SELECT count(*) AS pairs, round(corr(emb, pred), 6) AS pearson, count(*) FILTER (emb > 0 AND pred < 0.7) AS discriminated FROM tsim", _TV, _TSIM))
def alignment_summary(w: Workspace) -> DataFrame:
    """Correlation of both similarities, and pairs near in one but not the other."""
    p = token_pairs(w)
    return p.agg(F.count(F.lit(1)).alias("pairs"), r(F.corr("emb", "pred")).alias("pearson"), F.count(F.when((F.col("emb") > 0) & (F.col("pred") < 0.7), 1)).alias("discriminated"))


_NEAR = ("near", """SELECT t1, t2, emb, pred, row_number() OVER (PARTITION BY t1 ORDER BY round(emb, 9) DESC, t2) AS re, row_number() OVER (PARTITION BY t1 ORDER BY round(pred, 9) DESC, t2) AS rp
  FROM (SELECT t1, t2, emb, pred FROM tsim UNION ALL SELECT t2, t1, emb, pred FROM tsim)""")


@query(with_base("""SELECT t1 AS token, count(*) FILTER (re <= 3 AND rp <= 3) / 3.0 AS overlap, round(3.0 / count(*), 6) AS by_chance,
  round(avg(CASE WHEN emb > pred THEN 1.0 ELSE 0.0 END), 6) AS prefers_embedding FROM near GROUP BY t1""", _TV, _TSIM, _NEAR))
def neighbour_preferences(w: Workspace) -> DataFrame:
    """Of each token: how many of its three nearest tokens by mean vector are so by cluster profile, against chance, and how often the former is the more alike."""
    p = token_pairs(w)
    both = p.unionByName(p.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "emb", "pred"))
    rank = lambda c: F.row_number().over(Window.partitionBy("t1").orderBy(F.round(c, 9).desc(), "t2"))
    rows = both.withColumn("re", rank("emb")).withColumn("rp", rank("pred"))
    got = rows.groupBy(F.col("t1").alias("token")).agg(F.count(F.when((F.col("re") <= 3) & (F.col("rp") <= 3), 1)).alias("k"), F.count(F.lit(1)).alias("n"), info.share_of(F.col("emb") > F.col("pred")).alias("e"))
    return got.select("token", (F.col("k") / 3.0).alias("overlap"), r(3.0 / F.col("n")).alias("by_chance"), r(F.col("e")).alias("prefers_embedding"))


@query(with_base("""SELECT c1 AS cluster_id, c2 AS other_id, common, CASE WHEN common >= 3 THEN round(rho, 6) END AS rho FROM (
  SELECT a.cluster_id AS c1, b.cluster_id AS c2, count(*) AS common, CASE WHEN stddev_pop(a.cnt) > 0 AND stddev_pop(b.cnt) > 0 THEN corr(a.cnt, b.cnt) END AS rho FROM dist a JOIN dist b ON a.token = b.token AND a.cluster_id < b.cluster_id GROUP BY 1, 2)"""))
def region_pairs(w: Workspace) -> DataFrame:
    """Correlation of token counts between any two clusters that share tokens, from three common ones on: as many rows as such pairs of clusters."""
    a = w.dist.select(F.col("cluster_id").alias("c1"), "token", F.col("cnt").alias("ca"))
    b = w.dist.select(F.col("cluster_id").alias("c2"), "token", F.col("cnt").alias("cb"))
    rho = F.when((F.stddev_pop("ca") > 0) & (F.stddev_pop("cb") > 0), F.corr("ca", "cb"))
    got = a.join(b, "token").where("c1 < c2").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("common"), rho.alias("rho"))
    return got.select(F.col("c1").alias("cluster_id"), F.col("c2").alias("other_id"), "common", F.when(F.col("common") >= 3, F.round("rho", 6)).alias("rho"))


@query(with_base("""SELECT query_id, raw_token, state_token, round(raw_margin, 6) AS raw_margin, round(state_margin, 6) AS state_margin FROM (
  SELECT a.query_id, a.t AS raw_token, b.t AS state_token, ln(a.p / x.p) AS raw_margin, ln(b.p / y.p) AS state_margin FROM
  (SELECT query_id, max_by(token, (round(p, 9), -token)) AS t, max(p) AS p FROM fr GROUP BY 1) a JOIN (SELECT query_id, max_by(token, (round(p, 9), -token)) AS t, max(p) AS p FROM fst GROUP BY 1) b USING (query_id)
  JOIN fr x ON x.query_id = a.query_id AND x.token = b.t JOIN fst y ON y.query_id = a.query_id AND y.token = a.t WHERE a.t <> b.t)""", _FR, _FST))
def preference_changes(w: Workspace) -> DataFrame:
    """Queries whose likeliest token changes between the reads, where both give either some mass: tokens and log margins."""
    tops = []
    for kind, d in (("r", raw_dist(w)), ("s", state_dist(w))):
        tops.append(d.groupBy("query_id").agg(F.max_by("token", F.struct(F.round("p", 9).alias("p"), (-F.col("token")).alias("t"))).alias(f"{kind}t"), F.max("p").alias(f"{kind}p")))
    rows = tops[0].join(tops[1], "query_id").where("rt <> st")
    x = raw_dist(w).select("query_id", F.col("token").alias("st"), F.col("p").alias("xp"))
    y = state_dist(w).select("query_id", F.col("token").alias("rt"), F.col("p").alias("yp"))
    got = rows.join(x, ["query_id", "st"]).join(y, ["query_id", "rt"])
    return got.select("query_id", F.col("rt").alias("raw_token"), F.col("st").alias("state_token"), r(F.ln(F.col("rp") / F.col("xp"))).alias("raw_margin"), r(F.ln(F.col("sp") / F.col("yp"))).alias("state_margin"))


@query(with_base("SELECT a.query_id, a.token AS t1, b.token AS t2, round(ln(a.p / b.p), 6) AS raw_margin, round(ln(c.p / d.p), 6) AS state_margin FROM fr a JOIN fr b ON a.query_id = b.query_id AND a.token < b.token JOIN fst c ON c.query_id = a.query_id AND c.token = a.token JOIN fst d ON d.query_id = a.query_id AND d.token = b.token WHERE round(ln(a.p / b.p), 9) * round(ln(c.p / d.p), 9) < 0", _FR, _FST))
def preference_reversals(w: Workspace) -> DataFrame:
    """Token pairs that both reads order the other way round."""
    both = raw_dist(w).withColumnRenamed("p", "pr").join(state_dist(w).withColumnRenamed("p", "ps"), ["query_id", "token"])
    both = both.persist()
    a = both.select("query_id", F.col("token").alias("t1"), F.col("pr").alias("r1"), F.col("ps").alias("s1"))
    b = both.select("query_id", F.col("token").alias("t2"), F.col("pr").alias("r2"), F.col("ps").alias("s2"))
    rows = a.join(b, "query_id").where("t1 < t2").withColumn("rm", F.ln(F.col("r1") / F.col("r2"))).withColumn("sm", F.ln(F.col("s1") / F.col("s2")))
    return rows.where(F.round("rm", 9) * F.round("sm", 9) < 0).select("query_id", "t1", "t2", r(F.col("rm")).alias("raw_margin"), r(F.col("sm")).alias("state_margin"))


_DEC = ("dec", "SELECT j.query_id, j.js, " + " + ".join(f"CASE WHEN js >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS decile FROM js j, (SELECT " + ", ".join(f"quantile_cont(js, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM js)")


@query(with_base(f"SELECT query_id, decile FROM (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY {_LCG.format('query_id')}, query_id) AS rk FROM dec) WHERE rk <= 3", _FR, _FST, _JS, _DEC))
def stratified_sample(w: Workspace) -> DataFrame:
    """The same number of queries from every divergence decile."""
    js = info.js_divergence(raw_dist(w), state_dist(w)).persist()
    edges = js.agg(F.percentile("js", F.array(*(F.lit(i / 10) for i in range(1, 10)))).alias("e"))
    at = sum((F.when(F.col("js") >= F.col("e")[i], 1).otherwise(0) for i in range(9)), F.lit(0))
    rows = js.crossJoin(F.broadcast(edges)).withColumn("decile", at)
    rk = F.row_number().over(Window.partitionBy("decile").orderBy(draw(F.col("query_id")), "query_id"))
    return rows.withColumn("rk", rk).where("rk <= 3").select("query_id", "decile")


@query(with_base("SELECT query_id, round(sum(p) FILTER (p > 0), 6) AS mass, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM (SELECT coalesce(x.query_id, y.query_id) AS query_id, greatest(0, 0.5 * coalesce(x.p, 0) + 0.5 * coalesce(y.p, 0)) AS p FROM fr x FULL JOIN fst y ON x.query_id = y.query_id AND x.token = y.token) GROUP BY 1", _FR, _FST))
def distribution_metrics(w: Workspace) -> DataFrame:
    """Mass and entropy of a blend of both reads over the union of their tokens."""
    rows = info.align(raw_dist(w), state_dist(w), ["query_id", "token"]).withColumn("p", F.greatest(F.lit(0.0), 0.5 * F.col("pa") + 0.5 * F.col("pb")))
    return rows.groupBy("query_id").agg(r(F.sum("p")).alias("mass"), r(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"))


@query("SELECT event_type, " + _QS.format(x="value") + " FROM events GROUP BY event_type")
def quantiles_events(w: Workspace) -> DataFrame:
    got = stats.quantile_summary_wide(w.table("events"), "value", ["event_type"])
    return got.select("event_type", "n", *(r(c) for c in ("mean", "std", "median", "p90", "p95", "p99")))


