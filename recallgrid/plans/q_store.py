"""Retrieval joins and the stores built from raw entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store
from ..operators.vectors import nearest, nearest_expr
from ..schema import lcg_sql, pick_sql
from .base_sql import knn_sql, lloyd_sql, with_base
from .catalog import n, query, r
from .workspace import CLUSTERS, STEPS, Workspace

_LCG = lcg_sql("{0}")
_RAND = f"SELECT pos_id, y, x, CAST({pick_sql('pos_id', CLUSTERS)} AS BIGINT) AS cluster_id FROM ds"
_KNN = "SELECT query_id, CAST(rank AS BIGINT) AS rank, entry_id, round(dist, 6) AS dist FROM nbr WHERE rank <= 10"


@query(with_base(_KNN))
def knn_topk(w: Workspace) -> DataFrame:
    return w.nbr.where("rank <= 10").select("query_id", n("rank"), "entry_id", r("dist"))


@query(with_base(_KNN))
def knn_topk_expr(w: Workspace) -> DataFrame:
    """The same join without Python."""
    got = nearest_expr(w.q.select(F.col("query_id").alias("pos_id"), "x"), w.ds, 10, 64)
    return got.select("query_id", n("rank"), "entry_id", r("dist"))


@query(with_base("SELECT query_id, CAST(rank AS BIGINT) AS rank, entry_id, round(dist, 6) AS dist FROM rk", ("kept", "SELECT * FROM ds WHERE pos_id % 3 = 0"), ("rk", knn_sql("q", "kept", 7))))
def knn_restricted(w: Workspace) -> DataFrame:
    """Retrieval from part of the store."""
    got = nearest(w.q.select(F.col("query_id").alias("pos_id"), "x"), w.ds.where("pos_id % 3 = 0"), 7)
    return got.select("query_id", n("rank"), "entry_id", r("dist"))


@query(with_base("SELECT query_id, CAST(rank AS BIGINT) AS rank, cluster_id, round(dist, 6) AS dist FROM snbr"))
def knn_prototypes(w: Workspace) -> DataFrame:
    return w.snbr.select("query_id", n("rank"), "cluster_id", r("dist"))


@query(with_base("SELECT pos_id, cluster_id, round(dist, 6) AS dist FROM asg"))
def lloyd_assign(w: Workspace) -> DataFrame:
    return w.assigned.select("pos_id", "cluster_id", r("dist"))


@query(with_base("SELECT d.cluster_id, d.token, CAST(d.cnt AS BIGINT) AS cnt, CAST(p.total AS BIGINT) AS total FROM dist d JOIN proto p USING (cluster_id)"))
def kmeans_dist(w: Workspace) -> DataFrame:
    return w.dist.join(w.proto.select("cluster_id", "total"), "cluster_id").select("cluster_id", "token", n("cnt"), n("total"))


@query(with_base("SELECT cluster_id, i, round(avg(v), 6) AS v FROM (SELECT cluster_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM rc) GROUP BY cluster_id, i HAVING i < 8", ("rc", _RAND)))
def random_partition(w: Workspace) -> DataFrame:
    got = store.means(store.random_clusters(w.ds, CLUSTERS), CLUSTERS, 64)
    return got.select("cluster_id", F.posexplode(F.slice("x", 1, 8)).alias("i", "v")).select("cluster_id", n("i"), r("v"))


@query(with_base("SELECT cluster_id, y AS token, count(*) AS cnt FROM rc GROUP BY cluster_id, y", ("rc", _RAND)))
def random_partition_dist(w: Workspace) -> DataFrame:
    return store.distribution(store.random_clusters(w.ds, CLUSTERS)).select("cluster_id", "token", n("cnt"))


@query(with_base("SELECT a.cluster_id, a.y AS token, round(sum(-ln(m.p_lm + 1e-12) + 0.1), 6) AS cnt FROM asg a JOIN plm m USING (pos_id) GROUP BY a.cluster_id, a.y"))
def utility_weighted(w: Workspace) -> DataFrame:
    rows = w.assigned.join(w.p_lm, "pos_id")
    return store.distribution(rows, -F.ln(F.col("p_lm") + 1e-12) + 0.1).select("cluster_id", "token", r("cnt"))


@query(with_base(
    f"SELECT cluster_id, y AS token, count(*) AS cnt FROM (SELECT p.pos_id, p.y, arg_min(c.cluster_id, (list_distance(p.x, c.x), c.cluster_id)) AS cluster_id FROM ds p, k{STEPS} c GROUP BY p.pos_id, p.y) GROUP BY cluster_id, y",
    ("ctp", "SELECT * FROM pos WHERE split = 'ct'"), *lloyd_sql("k", "ctp", CLUSTERS, STEPS)))
def query_kmeans(w: Workspace) -> DataFrame:
    """Prototypes fitted on tuning queries, raw entries assigned to them."""
    proto = store.lloyd(w.pos.where("split = 'ct'"), CLUSTERS, STEPS)
    rows = store.assign_nearest(w.ds, proto, ["y"])
    return store.distribution(rows).select("cluster_id", "token", n("cnt"))


@query(with_base("SELECT cluster_id, arg_min(pos_id, (dist, pos_id)) AS pos_id, round(min(dist), 6) AS dist FROM asg GROUP BY cluster_id"))
def medoids(w: Workspace) -> DataFrame:
    return store.medoids(w.ds, w.assigned).select("cluster_id", "pos_id", r("dist"))


@query(with_base("SELECT count(*) AS triples, count(DISTINCT cluster_id) AS clusters, CAST(sum(cnt) AS BIGINT) AS entries FROM dist"))
def triples(w: Workspace) -> DataFrame:
    return w.dist.agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("cluster_id").alias("clusters"), n(F.sum("cnt"), "entries"))


@query(with_base("SELECT cluster_id, token, CAST(rn AS BIGINT) AS rn, CAST(cnt AS BIGINT) AS cnt FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, token) AS rn FROM dist) WHERE rn <= 4"))
def dense_top_tokens(w: Workspace) -> DataFrame:
    return store.top_tokens(w.dist, 4).select("cluster_id", "token", n("rn"), n("cnt"))


@query(with_base(
    "SELECT a.cluster_id, b.cluster_id AS other_id, round(list_distance(a.x, b.x), 6) AS dist FROM proto a, proto b WHERE a.cluster_id <> b.cluster_id"))
def centroid_distances(w: Workspace) -> DataFrame:
    p = w.proto.select(F.col("cluster_id").alias("pos_id"), "x")
    got = nearest(p, p, CLUSTERS).where("query_id <> entry_id")
    return got.select(F.col("query_id").alias("cluster_id"), F.col("entry_id").alias("other_id"), r("dist"))


@query(with_base("""SELECT pos_id, CAST(cluster_id AS BIGINT) AS cluster_id, CAST(rk AS BIGINT) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, pos_id) AS rk FROM asg) WHERE rk <= 3"""))
def nearest_members(w: Workspace) -> DataFrame:
    from pyspark.sql import Window

    rk = F.row_number().over(Window.partitionBy("cluster_id").orderBy("dist", "pos_id"))
    return w.assigned.withColumn("rk", rk).where("rk <= 3").select("pos_id", "cluster_id", n("rk"))


@query(with_base("SELECT query_id, round(max(dist) FILTER (rank = 1), 6) AS d1, round(max(dist) FILTER (rank = 2), 6) AS d2, round(max(dist) FILTER (rank = 2) - max(dist) FILTER (rank = 1), 6) AS margin FROM snbr GROUP BY query_id"))
def boundary_margin(w: Workspace) -> DataFrame:
    d = lambda k: F.max(F.when(F.col("rank") == k, F.col("dist")))
    got = w.snbr.groupBy("query_id").agg(d(1).alias("d1"), d(2).alias("d2"))
    return got.select("query_id", r("d1"), r("d2"), r(F.col("d2") - F.col("d1")).alias("margin"))


@query(with_base("SELECT cluster_id, token, count(*) AS cnt FROM (SELECT s1.cluster_id, s2.cluster_id AS c2, q.y AS token FROM snbr s1 JOIN snbr s2 USING (query_id) JOIN q USING (query_id) WHERE s1.rank = 1 AND s2.rank = 2) GROUP BY cluster_id, token"))
def query_conditional_counts(w: Workspace) -> DataFrame:
    top = w.snbr.where("rank = 1").join(w.truth.select("query_id", "y"), "query_id")
    return store.conditional_counts(top, "cluster_id").select("cluster_id", "token", "cnt")


_SHUF = f"""SELECT a.cluster_id, b.token, a.cnt FROM (SELECT *, row_number() OVER (ORDER BY cluster_id, token) AS i FROM dist) a
  JOIN (SELECT token, row_number() OVER (ORDER BY {_LCG.format('cluster_id * 1000 + token')}, cluster_id, token) AS i FROM dist) b USING (i)"""


@query(with_base("SELECT cluster_id, token, CAST(sum(cnt) AS BIGINT) AS cnt FROM sh GROUP BY cluster_id, token", ("sh", _SHUF)))
def shuffled_contents(w: Workspace) -> DataFrame:
    """A portable permutation of the contents."""
    return store.shuffled_contents(w.dist).select("cluster_id", "token", n("cnt"))
