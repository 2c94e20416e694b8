"""Statistics over per-query results: tests, intervals, bins, groups, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles, with_rank, with_running_sum


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference, its standard error and t, in one pass."""
    d = F.col(a) - F.col(b)
    out = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.select("n", "mean_diff", se.alias("se"), F.when(se > 0, F.col("mean_diff") / se).alias("t"))


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else float(x >= 1)

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if not 0 < x < 1:
        return front
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def average_ranks(df: DataFrame, x: Column, name: str = "r") -> DataFrame:
    """``df`` with average ranks of x: counts of distinct values are ranked, not rows."""
    df = df.withColumn("_x", x)
    counts = with_running_sum(df.groupBy("_x").agg(F.count(F.lit(1)).alias("_n")), "_x", [], F.col("_n"), "_upto")
    ranks = counts.select("_x", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, "_x").drop("_x")


def wilcoxon(df: DataFrame, a: str, b: str, scale: int = 9) -> DataFrame:
    """Signed ranks of non-zero differences (compared at ``scale`` digits): n, w_plus, w_minus, w, z."""
    d = df.select(F.round(F.col(a) - F.col(b), scale).alias("d")).where("d <> 0")
    r = average_ranks(d, F.abs("d"))
    out = r.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"),
    )
    n = F.col("n").cast("double")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return out.select("n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), F.when(n > 0, z).alias("z"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = average_ranks(average_ranks(df.select(F.col(a).alias("a"), F.col(b).alias("b")), F.col("a"), "ra"), F.col("b"), "rb")
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def quantile_summary(df: DataFrame, x: Column, by: list[str] | None = None) -> DataFrame:
    """n, mean, population deviation, median and upper quantiles, of each group."""
    q = F.percentile(x, F.array(*(F.lit(v) for v in QUANTILES)))
    out = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), q.alias("q"))
    return out.select(*(by or []), "n", "mean", "std", *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "p90", "p95", "p99"))))


def quantile_summary_wide(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """The same for whole tables: exact quantiles by ranges, no buffer of distinct values."""
    by = by or []
    plain = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    q = exact_quantiles(df.select(*by, x), x, list(QUANTILES), by)
    out = plain.join(q, by, "left") if by else plain.crossJoin(F.broadcast(q))
    return out.select(*by, "n", "mean", "std", *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "p90", "p95", "p99"))))


QUANTILES = (0.5, 0.9, 0.95, 0.99)


def binned(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Means of y in bins of x between exact quantile edges, right-open, the last closed."""
    edges = exact_quantiles(df.select(x), x, [i / bins for i in range(bins + 1)]).select(F.col("q").alias("e"))
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).crossJoin(F.broadcast(edges))
    at = sum((F.when(F.col("x") >= F.col("e")[i], 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return rows.withColumn("bin", at).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), F.percentile("y", F.lit(0.5)).alias("y_median")
    )


def worst_flag(df: DataFrame, by: str, percent: int, rounding: str = "round", id_col: str = "query_id") -> DataFrame:
    """Flag the worst percent of rows; their number is rounded (half to even) or cut off."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    k = F.bround(F.col("n") * percent / 100.0).cast("long") if rounding == "round" else F.floor(F.col("n") * percent / 100).cast("long")
    ranked = with_rank(df, by, [id_col], "_rk", descending=True).crossJoin(F.broadcast(n.select(k.alias("_k"))))
    return ranked.withColumn("worst", F.col("_rk") <= F.col("_k")).drop("_rk", "_k")


#: 2 ** 32 times the chance that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON_EDGES = tuple(int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(11))


def poisson_sums(per: DataFrame, group: str, sums: list[str], draws: int, by: list[str] | None = None) -> DataFrame:
    """``(by..., draw, sums...)``: sums over groups, each group counted a Poisson number of times in each draw.

    A group's count follows from the MD5 of its key and the draw's number, four draws from one digest, so groups are
    neither numbered nor joined: one scan, partially aggregated, however many groups there are.
    """
    by = by or []
    rows = per.select(*by, F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g"), *sums)
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // 4) - 1))))
    rows = rows.withColumn("_h", F.md5(F.concat("_g", F.lit(":"), F.col("_b").cast("string"))))
    weight = []
    for i in range(4):
        u = F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")
        weight.append(sum((F.when(u >= e, 1).otherwise(0) for e in POISSON_EDGES), F.lit(0)))
    rows = rows.select(*by, "_b", *sums, *(w.alias(f"_w{i}") for i, w in enumerate(weight)))
    got = rows.groupBy(*by, "_b").agg(*(F.sum(F.col(c) * F.col(f"_w{i}")).alias(f"{c}_{i}") for i in range(4) for c in sums))
    each = F.explode(F.array(*(F.struct((F.col("_b") * 4 + i).alias("draw"), *(F.col(f"{c}_{i}").alias(c) for c in sums)) for i in range(4))))
    return got.select(*by, each.alias("_e")).select(*by, "_e.*").where(F.col("draw") < draws)


def poisson_sql(per: str, sums: list[str], draws: int) -> str:
    """The same in SQL, of a table with ``g`` and the columns to add up."""
    w = " + ".join(f"CASE WHEN u >= {e} THEN 1 ELSE 0 END" for e in POISSON_EDGES)
    return f"""SELECT draw, {", ".join(f"sum({c} * w) AS {c}" for c in sums)} FROM (SELECT *, {w} AS w FROM (
  SELECT *, blk * 4 + part AS draw, CAST('0x' || substr(md5(coalesce(CAST(g AS VARCHAR), '') || ':' || blk), 1 + 8 * part, 8) AS BIGINT) AS u
  FROM {per}, (SELECT unnest(range(0, {-(-draws // 4)})) AS blk), (SELECT unnest(range(0, 4)) AS part))) WHERE draw < {draws} GROUP BY draw"""


def group_bootstrap(df: DataFrame, group: str, x: Column, draws: int) -> DataFrame:
    """Percentile interval of the mean, resampling whole groups by Poisson counts.

    Rows are first reduced to a sum and a count for each group. A draw that counts no group has no mean.
    """
    per = df.groupBy(F.col(group).alias("g")).agg(F.sum(x).alias("s"), F.count(x).alias("c"))
    means = poisson_sums(per, "g", ["s", "c"], draws).where("c <> 0").select((F.col("s") / F.col("c")).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    point = per.agg((F.sum("s") / F.sum("c")).alias("point"), F.count(F.lit(1)).alias("groups"))
    return point.crossJoin(means.agg(q.alias("q"), F.stddev_pop("mean").alias("boot_se"))).select(
        "groups", "point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "boot_se"
    )
