"""Inputs beyond the test tables: many groups, large ids, equal vectors, small stores under many queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import ranking, read, stats, store, vectors
from recallgrid.operators.ranking import with_rank
from recallgrid.schema import draw, pick


def test_bootstrap_draws_every_group(spark):
    n = 40_000  # all the mass is in the last fifth
    df = spark.range(n).select(F.col("id").alias("g"), F.when(F.col("id") >= 32_768, 1000.0).otherwise(0.0).alias("x"))
    got = stats.group_bootstrap(df, "g", F.col("x"), 200).first()
    assert got["groups"] == n and got["point"] == pytest.approx(180.8)
    assert got["lo"] < 180.8 < got["hi"] and got["boot_se"] == pytest.approx((1e6 * 0.1808 * 0.8192 / n) ** 0.5, rel=0.2)


def test_poisson_counts_have_mean_and_variance_one(spark):
    per = spark.range(2000).select(F.col("id").alias("g"), F.lit(1.0).alias("c"))
    means = np.array([r["c"] for r in stats.poisson_sums(per, "g", ["c"], 401).collect()]) / 2000
    assert len(means) == 401 and means.mean() == pytest.approx(1, abs=0.005) and means.std() == pytest.approx((1 / 2000) ** 0.5, rel=0.15)


def test_draws_take_any_id(spark):
    ids = [0, 1, 10_000_000_000, 2**63 - 1, -1, -(2**63)]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select(draw(F.col("id")).alias("d"), draw(F.col("id"), 77).alias("s")).collect()
    for i, r in zip(ids, got):
        assert r["d"] == (i % 2**31 * 1103515245 + 12345) % 2**31 and r["s"] == ((i + 77) % 2**31 * 1103515245 + 12345) % 2**31


def test_picks_reach_beyond_fifteen_bits(spark):
    got = spark.range(300_000).select(pick(F.col("id"), 100_000).alias("c")).groupBy().agg(F.countDistinct("c").alias("k"), F.max("c").alias("m")).first()
    assert got["k"] > 90_000 and got["m"] > 99_000
    assert store.random_clusters(spark.range(100_000).withColumnRenamed("id", "pos_id"), 50_000).agg(F.max("cluster_id")).first()[0] > 49_000


def points(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in x]) for i, x in enumerate(m)], "pos_id long, x array<double>")


def brute(q, m, k):
    d = np.sqrt(((q[:, None] - m[None]) ** 2).sum(2))
    return [[(int(j), round(d[i, j], 9)) for j in np.lexsort((np.arange(len(m)), np.round(d[i], 12)))[:k]] for i in range(len(q))]


def test_many_equal_vectors_and_every_join(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(600, 8))
    m[::3] = m[0]  # 200 equal entries
    q = np.concatenate([m[:1], m[:1] + 0.01, rng.normal(size=(6, 8))])
    want = brute(q, m, 3)
    for queries, blocks in ((8192, 8192), (2, 8192), (2, 2)):  # query side, store side, block join
        monkeypatch.setattr(vectors, "BROADCAST_ROWS", queries if queries == 8192 else 600 if blocks == 8192 else 2)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 64 if blocks == 2 else 8192)
        if queries == 2 and blocks == 8192:  # more queries than fit, a store that does
            big = np.r_[q, rng.normal(size=(700, 8))]
            rows = vectors.nearest(points(spark, big), points(spark, m), 3).where("query_id < 8")
        else:
            rows = vectors.nearest(points(spark, q), points(spark, m), 3)
        got = rows.orderBy("query_id", "rank").collect()
        assert [[(r["entry_id"], round(r["dist"], 9)) for r in got[3 * i : 3 * i + 3]] for i in range(len(q))] == want
    monkeypatch.undo()
    blocks = vectors.packed(points(spark, m).repartition(3), rows=50)
    for limit in (8192, 2):
        monkeypatch.setattr(vectors, "BROADCAST_ROWS", limit)
        got = vectors.nearest_packed(points(spark, q), blocks, 3).orderBy("query_id", "rank").collect()
        assert [[(r["entry_id"], round(r["dist"], 9)) for r in got[3 * i : 3 * i + 3]] for i in range(len(q))] == want
    assert vectors.nearest_packed(points(spark, q).limit(0), blocks, 3).count() == 0
    ids, d = vectors.closest(q, np.arange(600), m)
    assert ids.tolist() == [w[0][0] for w in want] and np.round(d, 9).tolist() == [w[0][1] for w in want]


def test_prototypes_are_counted_before_they_move(spark, monkeypatch):
    m = np.random.default_rng(1).normal(size=(50, 4))
    rows = points(spark, m).withColumn("y", F.lit(1))
    proto = points(spark, m[:5]).withColumnRenamed("pos_id", "cluster_id")
    want = sorted(map(tuple, store.assign_nearest(rows, proto, ["y"]).collect()))
    monkeypatch.setattr(store, "CENTROID_NUMBERS", 10)
    got = store.assign_nearest(rows, proto, ["y"]).select("pos_id", "cluster_id", "dist", "y").collect()
    assert [(a[0], a[1], round(a[2], 9), a[3]) for a in sorted(map(tuple, got))] == [(a[0], a[1], round(a[2], 9), a[3]) for a in want]
    with pytest.raises(ValueError):
        store.lloyd(rows, 5)


def test_ranks_do_not_depend_on_the_ranges(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") * 37 % 100).cast("double").alias("v"))
    one = sorted(map(tuple, with_rank(df, "v", ["id"], ranges=1).select("id", "rk").collect()))
    monkeypatch.setattr("recallgrid.operators.ranking.RANGE_ROWS", 10)
    assert sorted(map(tuple, with_rank(df, "v", ["id"]).select("id", "rk").collect())) == one


def test_agreement_is_the_best_of_all_matchings(spark):
    from itertools import permutations

    from recallgrid.operators import em

    rng = np.random.default_rng(3)
    for rows, cols in ((5, 5), (4, 6), (1, 1)):
        t = rng.integers(0, 20, (rows, cols))
        cells = spark.createDataFrame([(100 + i, j, int(t[i, j])) for i in range(rows) for j in range(cols) if t[i, j]] or [(100, 0, 1)], "a long, b long, n long")
        t = t if t.any() else np.ones((1, 1), int)
        full = np.zeros((max(t.shape), max(t.shape)), int)
        full[: t.shape[0], : t.shape[1]] = t
        got = em.agreement(cells).first()
        assert got["agreed"] == max(sum(full[i, p[i]] for i in range(len(full))) for p in permutations(range(len(full)))) and got["n"] == t.sum()
    assert em.agreement(cells.limit(0)).count() == 0
    with pytest.raises(ValueError):
        em.agreement(spark.range(9).selectExpr("id AS a", "id AS b", "1 AS n"), most=8)


@pytest.mark.parametrize("kernel", ["softmax", "gauss"])
def test_member_sums_of_cut_clusters(spark, kernel):
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(60, 5)), rng.normal(size=(20, 5))
    m[30:40] = q[0]  # many members equal to a query
    members = spark.createDataFrame([(i, i % 3, None if i % 7 == 0 else i % 5, x.tolist()) for i, x in enumerate(m)], "pos_id long, cluster_id long, token int, mx array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, qx array<double>")
    weighted = spark.createDataFrame([(i, c, 0.25 * (c + 1)) for i in range(20) for c in (0, 1, 3)], "query_id long, cluster_id long, w double")  # cluster 3 is empty
    one = lambda d: {(r["query_id"], r["cluster_id"], r["token"]): (r["w"], r["wm"]) for r in d.groupBy("query_id", "cluster_id", "token").agg(F.first("w").alias("w"), F.sum("wm").alias("wm")).collect()}
    want = one(read.member_terms(weighted, members, queries, kernel, 0.3, 0.4))
    for parts in ((8192, 65_536), (7, 65_536), (7, 4), (8192, 4)):
        got = read.member_sums(weighted, members, queries, kernel, 0.3, 0.4, parts=parts)
        assert got.count() == len(want) and {k: pytest.approx(v, abs=1e-12) for k, v in one(got).items()} == want
    assert read.member_sums(weighted, members.limit(0), queries, kernel).count() == 0
    assert read.member_sums(weighted.limit(0), members, queries, kernel).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_a_hot_value_is_ranked_in_many_tasks(spark, descending):
    rng = np.random.default_rng(3)
    values = [None if i % 50 == 0 else 1.0 if i % 3 else float(v) for i, v in enumerate(rng.normal(1, 1, 3000).round(1))]
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, values)], "id long, v double")
    got = {r["id"]: r["rk"] for r in with_rank(df, "v", ["id"], descending=descending).collect()}
    order = sorted(zip(ids.tolist(), values), key=lambda t: (t[1] is None, 0 if t[1] is None else -t[1] if descending else t[1], t[0]))
    assert [got[i] for i, _ in order] == list(range(1, 3001))
    at = ranking._split_ties(df, "v", ["id"], F.lit(1), [1.0], 64, descending)
    assert df.where("v = 1").select(at.alias("a")).distinct().count() > 32
