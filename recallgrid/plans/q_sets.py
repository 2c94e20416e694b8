"""Set operations over ids, memoised results, and what else combines earlier operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interpolate, nll
from ..operators import policy
from ..sources.memo import memoised
from .base_sql import with_base
from .catalog import query, r
from .q_data import scratch
from .q_tune import _PRI, _alloc_sql, priority
from .workspace import STATE_ALPHA, Workspace

_KEEP = ("keep", f"SELECT pos_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dist, pos_id) AS rk FROM asg) JOIN ({_alloc_sql('score DESC', 60, 10, 0)}) t USING (cluster_id) WHERE rk <= take")
_WORST = ("worst", "SELECT entry_id AS pos_id FROM (SELECT entry_id, count(*) AS uses FROM nbr JOIN (SELECT query_id FROM perq WHERE split = 'ct' ORDER BY delta_l DESC, query_id LIMIT 15) USING (query_id) WHERE rank <= 10 GROUP BY 1 ORDER BY uses DESC, entry_id LIMIT 30)")


def kept(w: Workspace) -> DataFrame:
    return policy.take_members(w.assigned, policy.allocate(w.assigned, priority(w), 60, 10)).select("pos_id")


def most_used(w: Workspace) -> DataFrame:
    worst = w.perq.where("split = 'ct'").orderBy(F.col("delta_l").desc(), "query_id").limit(15).select("query_id")
    uses = w.nbr.where("rank <= 10").join(worst, "query_id", "left_semi").groupBy("entry_id").agg(F.count(F.lit(1)).alias("uses"))
    return uses.orderBy(F.col("uses").desc(), "entry_id").limit(30).select(F.col("entry_id").alias("pos_id"))


@query(with_base("SELECT pos_id FROM keep UNION SELECT pos_id FROM worst", _PRI, _KEEP, _WORST))
def merged_retention(w: Workspace) -> DataFrame:
    """Union of two retention sets."""
    return kept(w).unionByName(most_used(w)).distinct()


@query(with_base("SELECT pos_id FROM keep EXCEPT SELECT pos_id FROM worst", _PRI, _KEEP, _WORST))
def retention_difference(w: Workspace) -> DataFrame:
    return kept(w).join(most_used(w), "pos_id", "left_anti")


@query(with_base("""SELECT round(i / (a + b - i), 6) AS jaccard, round(i / a, 6) AS shared, round(ci / (ca + cb - ci), 6) AS cluster_jaccard FROM
  (SELECT (SELECT count(*) FROM keep) AS a, (SELECT count(*) FROM worst) AS b, (SELECT count(*) FROM keep JOIN worst USING (pos_id)) AS i,
    (SELECT count(DISTINCT cluster_id) FROM keep JOIN asg USING (pos_id)) AS ca, (SELECT count(DISTINCT cluster_id) FROM worst JOIN asg USING (pos_id)) AS cb,
    (SELECT count(*) FROM (SELECT cluster_id FROM keep JOIN asg USING (pos_id) INTERSECT SELECT cluster_id FROM worst JOIN asg USING (pos_id))) AS ci)""", _PRI, _KEEP, _WORST))
def member_jaccard(w: Workspace) -> DataFrame:
    """Overlap of two retention sets, by members and by clusters."""
    rows = kept(w).withColumn("a", F.lit(1)).join(most_used(w).withColumn("b", F.lit(1)), "pos_id", "full_outer").join(w.assigned.select("pos_id", "cluster_id"), "pos_id").persist()
    per = rows.groupBy("cluster_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = lambda t: F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    m = rows.agg(both(0).alias("i"), F.count("a").alias("na"), F.count(F.lit(1)).alias("u"))
    c = per.agg(both(0).alias("ci"), F.count(F.lit(1)).alias("cu"))
    return m.crossJoin(c).select(r(F.col("i") / F.col("u")).alias("jaccard"), r(F.col("i") / F.col("na")).alias("shared"), r(F.col("ci") / F.col("cu")).alias("cluster_jaccard"))


@query(with_base("SELECT count(*) AS retrieved, count(DISTINCT entry_id) AS entries FROM nbr WHERE rank <= 20"))
def neighbour_union(w: Workspace) -> DataFrame:
    ids = w.nbr.where("rank <= 20").select("entry_id")
    return ids.agg(F.count(F.lit(1)).alias("retrieved")).crossJoin(ids.distinct().agg(F.count(F.lit(1)).alias("entries")))


@query(with_base("SELECT query_id, round(p_raw, 6) AS p FROM perq"))
def memoised_reads(w: Workspace) -> DataFrame:
    """A result kept under the signature of its inputs: the second call reads it back."""
    nbr = w.nbr.where("rank <= 20")
    plan = lambda: w.perq.select("query_id", F.col("p_raw").alias("p"))
    root = f"{scratch(w)}/memo"
    memoised(w.spark, root, "raw-reads", nbr.select("query_id", "entry_id"), plan)
    return memoised(w.spark, root, "raw-reads", nbr.select("query_id", "entry_id"), plan).select("query_id", r("p"))


@query(with_base("SELECT action, count(*) AS n FROM (SELECT CASE WHEN round(-ln(p_lm + 1e-12), 9) > (SELECT quantile_cont(round(-ln(p_lm + 1e-12), 9), 0.5) FROM val) THEN 'read' ELSE 'skip' END AS action FROM val) GROUP BY action"))
def threshold_policy(w: Workspace) -> DataFrame:
    """Read where the base model's loss is above its median."""
    loss = F.round(nll(F.col("p_lm")), 9)
    cut = w.val.agg(F.percentile(loss, F.lit(0.5)).alias("cut"))
    return w.val.crossJoin(F.broadcast(cut)).groupBy(F.when(loss > F.col("cut"), "read").otherwise("skip").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(with_base("SELECT c1 AS cluster_id, c2 AS other_id, common, CASE WHEN common >= 3 THEN round(rho, 6) END AS rho FROM (SELECT a.cluster_id AS c1, b.cluster_id AS c2, count(*) AS common, CASE WHEN stddev_pop(a.cnt) > 0 AND stddev_pop(b.cnt) > 0 THEN corr(a.cnt, b.cnt) END AS rho FROM dist a JOIN dist b ON a.token = b.token AND b.cluster_id = a.cluster_id + 1 GROUP BY 1, 2)"))
def region_consistency(w: Workspace) -> DataFrame:
    """Correlation of token counts between neighbouring clusters with three common tokens at least."""
    a = w.dist.select("cluster_id", "token", F.col("cnt").alias("ca"))
    b = w.dist.select((F.col("cluster_id") - 1).alias("cluster_id"), "token", F.col("cnt").alias("cb"))
    rows = a.join(b, ["cluster_id", "token"]).groupBy("cluster_id")
    rho = F.when((F.stddev_pop("ca") > 0) & (F.stddev_pop("cb") > 0), F.corr("ca", "cb"))
    got = rows.agg(F.count(F.lit(1)).alias("common"), rho.alias("rho"))
    return got.select("cluster_id", (F.col("cluster_id") + 1).alias("other_id"), "common", F.when(F.col("common") >= 3, F.round("rho", 6)).alias("rho"))


@query(with_base(f"SELECT round(avg(m), 6) AS mean_nll, round(stddev_samp(m) / sqrt(count(*)), 6) AS iid_se FROM (SELECT -ln({STATE_ALPHA} * p_state + (1 - {STATE_ALPHA}) * p_lm + 1e-12) AS m FROM val)"))
def iid_error(w: Workspace) -> DataFrame:
    """Mean loss with the standard error of independent rows."""
    m = nll(interpolate(F.col("p_state"), F.col("p_lm"), STATE_ALPHA))
    return w.val.agg(r(F.avg(m)).alias("mean_nll"), r(F.stddev_samp(m) / F.sqrt(F.count(F.lit(1)))).alias("iid_se"))


@query(with_base("SELECT cluster_id, CAST(mass AS BIGINT) AS size, round(share, 6) AS share FROM (SELECT cluster_id, total AS mass, total / sum(total) OVER () AS share FROM proto)"))
def cluster_mass(w: Workspace) -> DataFrame:
    total = w.proto.agg(F.sum("total").alias("t"))
    return w.proto.crossJoin(F.broadcast(total)).select("cluster_id", F.col("total").cast("long").alias("size"), r(F.col("total") / F.col("t")).alias("share"))


