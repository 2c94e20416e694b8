"""Toy values worked out by hand, and identities that hold on any data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions.scalar import interpolate, nll
from recallgrid.operators import em, policy, read, stats, store
from recallgrid.operators.stats_extra import js_divergence
from recallgrid.operators.vectors import nearest, nearest_expr
from recallgrid.sources import ingest


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], y) for i, (x, y) in enumerate(rows)], "pos_id long, x array<double>, y int")


def queries(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], y, p) for i, (x, y, p) in enumerate(rows)], "query_id long, x array<double>, y int, p_lm double")


def raw_weights(q, p, k, tau):
    nbr = nearest(q.withColumnRenamed("query_id", "pos_id"), p, k).join(p.select(F.col("pos_id").alias("entry_id"), F.col("y").alias("token")), "entry_id")
    return read.first_k(nbr, k, tau)


def state_weights(q, proto, k, tau):
    nbr = nearest(q.withColumnRenamed("query_id", "pos_id"), proto.withColumnRenamed("cluster_id", "pos_id"), k).withColumnRenamed("entry_id", "cluster_id")
    return read.first_k(nbr, k, tau)


def test_mixed_loss_by_hand(spark):
    rows = [(0, 1, 0.1, 5), (0, 2, 5.0, 2), (0, 3, 6.0, 9), (1, 1, 0.1, 2), (1, 2, 5.0, 9), (1, 3, 6.0, 3)]
    nbr = spark.createDataFrame(rows, "query_id long, rank int, dist double, token int")
    truth = spark.createDataFrame([(0, 5, 0.3), (1, 7, 0.3)], "query_id long, y int, p_lm double")
    got = {r["query_id"]: r["nll"] for r in read.mix(read.raw_prob(read.first_k(nbr, 3, 1.0), truth), 0.25).collect()}
    assert got[0] == pytest.approx(0.750, abs=2e-3)
    assert got[1] == pytest.approx(1.492, abs=1e-3)


def test_distributions_sum_to_one(spark):
    p = points(spark, [((0, 0), 10), ((1, 0), 20), ((0, 1), 30)])
    q = queries(spark, [((0.1, 0.1), 10, 0.5)])
    w = raw_weights(q, p, 3, 1.0)
    assert read.raw_distribution(w).agg(F.sum("p")).first()[0] == pytest.approx(1, abs=1e-9)
    a = p.select("pos_id", F.col("pos_id").alias("cluster_id"), "y", F.lit(0.0).alias("dist"))
    dist = store.distribution(a)
    proto = store.with_totals(p.select(F.col("pos_id").alias("cluster_id"), "x"), dist)
    sw = state_weights(q, proto.select("cluster_id", "x"), 3, 1.0)
    assert read.state_distribution(sw, dist, proto).agg(F.sum("p")).first()[0] == pytest.approx(1, abs=1e-9)


def test_singleton_clusters_equal_raw(spark):
    p = points(spark, [((0, 0), 10), ((2, 0), 20), ((0, 2), 30)])
    q = queries(spark, [((0.3, 0.1), 20, 0.4)])
    dist = store.distribution(p.withColumn("cluster_id", F.col("pos_id")))
    proto = store.with_totals(p.select(F.col("pos_id").alias("cluster_id"), "x"), dist)
    raw = read.raw_prob(raw_weights(q, p, 3, 1.0), q).first()["p"]
    state = read.state_prob(state_weights(q, proto, 3, 1.0), q, dist, proto).first()["p"]
    assert raw == pytest.approx(state, abs=1e-9)


def test_equal_counts_are_even_and_empty_clusters_keep_their_weight(spark):
    q = queries(spark, [((0, 0), 10, 0.5)])
    dist = spark.createDataFrame([(0, 10, 5.0), (0, 20, 5.0)], "cluster_id long, token int, cnt double")
    proto = spark.createDataFrame([(0, [0.0, 0.0], 10.0), (1, [0.0, 0.0], 0.0)], "cluster_id long, x array<double>, total double")
    w = spark.createDataFrame([(0, 0, 0.6), (0, 1, 0.4)], "query_id long, cluster_id long, w double")
    assert read.state_prob(w, q, dist, proto).first()["p"] == pytest.approx(0.3)
    prior = spark.createDataFrame([(10, 0.25)], "token int, p double")
    assert read.state_prob(w, q, dist, proto, 5.0, prior).first()["p"] == pytest.approx(0.6 * (5 + 1.25) / 15 + 0.4 * 0.25)


def test_js_divergence(spark):
    d = lambda ps: spark.createDataFrame([(0, t, p) for t, p in ps.items()], "query_id long, token int, p double")
    p, q, r = d({1: 0.5, 2: 0.5}), d({3: 0.5, 4: 0.5}), d({1: 0.3, 2: 0.3, 5: 0.4})
    assert js_divergence(p, p).first()["js"] == pytest.approx(0, abs=1e-12)
    assert 0 < js_divergence(p, q).first()["js"] <= math.log(2) + 1e-9
    assert js_divergence(p, r).first()["js"] >= 0


def test_absent_token_is_exactly_zero(spark):
    p = points(spark, [((0, 0), 10), ((1, 0), 20)])
    assert read.raw_prob(raw_weights(queries(spark, [((0, 0), 99, 0.5)]), p, 2, 1.0), queries(spark, [((0, 0), 99, 0.5)])).first()["p"] == 0.0


def test_exact_match_loss(spark):
    row = spark.createDataFrame([(1.0, 0.5)], "p double, p_lm double").select(nll(interpolate(F.col("p"), F.col("p_lm"), 0.5)).alias("l")).first()
    assert row["l"] == pytest.approx(-math.log(0.75), abs=1e-9)


def test_next_tokens_are_aligned(spark):
    c = spark.createDataFrame([(0, ["100", "101", "102", "103"]), (1, ["200", "201", "202", "203"])], "chunk_id long, tokens array<string>")
    got = [(r["chunk_id"], r["token"], r["target"]) for r in ingest.next_tokens(c).orderBy("chunk_id", "pos").collect()]
    assert got == [(0, "100", "101"), (0, "101", "102"), (0, "102", "103"), (1, "200", "201"), (1, "201", "202"), (1, "202", "203")]


def test_merging_loses_what_depends_on_the_query(spark):
    p = points(spark, [((0, 0), 1), ((10, 0), 2)])
    q = queries(spark, [((0.5, 0), 1, 0.5), ((9.5, 0), 1, 0.5)])
    raw = [r["p"] for r in read.raw_prob(raw_weights(q, p, 2, 1.0), q).orderBy("query_id").collect()]
    assert abs(raw[0] - raw[1]) > 0.1
    dist = store.distribution(p.withColumn("cluster_id", F.lit(0).cast("long")))
    proto = spark.createDataFrame([(0, [5.0, 0.0], 2.0)], "cluster_id long, x array<double>, total double")
    state = [r["p"] for r in read.state_prob(state_weights(q, proto, 1, 1.0), q, dist, proto).collect()]
    assert state == [pytest.approx(0.5), pytest.approx(0.5)]


def test_both_retrieval_forms_and_the_block_join_agree(spark, monkeypatch):
    from recallgrid.operators import vectors

    rng = np.random.default_rng(3)
    p = points(spark, [(rng.normal(size=4), int(i % 3)) for i in range(60)])
    q = points(spark, [(rng.normal(size=4), 0) for _ in range(9)])
    want = sorted((r["query_id"], r["rank"], r["entry_id"], round(r["dist"], 9)) for r in nearest_expr(q, p, 5, 4).collect())
    assert sorted((r["query_id"], r["rank"], r["entry_id"], round(r["dist"], 9)) for r in nearest(q, p, 5).collect()) == want
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    assert sorted((r["query_id"], r["rank"], r["entry_id"], round(r["dist"], 9)) for r in nearest(q, p, 5).collect()) == want


def test_k_beyond_the_store_and_empty_sides(spark):
    p = points(spark, [((0, 0), 1), ((1, 0), 2)])
    assert nearest(p, p, 10).count() == 4
    assert nearest(p.limit(0), p, 3).count() == 0
    assert nearest(p, p.limit(0), 3).count() == 0


def test_equal_spherical_components_are_nearest_centroids(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    rows = points(spark, [(centres[i % 3] + rng.normal(size=2), 0) for i in range(90)])
    mix = em.Mixture("spherical", np.full(3, 1 / 3), centres.astype(float), np.ones((3, 2)))
    g = em.responsibilities(rows, mix).groupBy("pos_id").agg(F.max_by("cluster_id", "gamma").alias("c"))
    proto = store.frame(spark, range(3), centres.astype(float))
    near = store.assign_nearest(rows, proto).withColumnRenamed("cluster_id", "n")
    assert g.join(near, "pos_id").where("c <> n").count() == 0


def test_em_raises_the_likelihood(spark):
    rng = np.random.default_rng(6)
    rows = points(spark, [(np.array([4.0 * (i % 2), 0]) + rng.normal(size=2), 0) for i in range(80)])
    for kind in ("spherical", "diag", "tied"):
        mix = em.Mixture(kind, np.array([0.5, 0.5]), np.array([[1.0, 0], [2.0, 0]]), np.ones((2, 2)))
        _, h = em.fit(rows, mix, 6)
        lls = [x["mean_ll"] for x in h]
        assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:]))


def test_hungarian_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        c = rng.random((n, n))
        got = em.hungarian(c)
        assert sorted(got) == list(range(n))
        assert sum(c[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(n))))


def test_t_tail():
    assert stats.t_sf2(0.0, 10) == pytest.approx(1.0)
    assert stats.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_sf2(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert sorted(r["r"] for r in stats.average_ranks(df, F.col("x")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_budget_cuts_the_last_cluster(spark):
    a = spark.createDataFrame([(c * 10 + i, c, float(i)) for c in range(3) for i in range(5)], "pos_id long, cluster_id long, dist double")
    pri = spark.createDataFrame([(0, 0.1), (1, 0.9), (2, 0.5)], "cluster_id long, score double")
    take = {r["cluster_id"]: r["take"] for r in policy.allocate(a, pri, 7).collect()}
    assert take == {1: 5, 2: 2}
    assert {r["cluster_id"]: r["take"] for r in policy.allocate(a, pri, 7, cap=3).collect()} == {1: 3, 2: 3, 0: 1}
    assert {r["cluster_id"]: r["take"] for r in policy.allocate(a, pri, 2, base=1).collect()} == {0: 1, 1: 1, 2: 1}
    assert policy.take_members(a, policy.allocate(a, pri, 7)).count() == 7


def test_chunks_drop_the_short_tail_and_keep_order(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "d e")], "doc_id long, text string")
    got = [(r["chunk_id"], r["doc_id"], r["tokens"]) for r in ingest.chunks(docs, 4).orderBy("chunk_id").collect()]
    assert got == [(0, 1, ["a", "b", "c", "<eos>"]), (1, 4, ["<eos>", "<eos>", "d", "e"])]


def test_titles_split_articles(spark):
    docs = spark.createDataFrame([(0, " = One = "), (1, "a b c d e f g"), (2, " = = Sub = = "), (3, " = Two = "), (4, "h i")], "doc_id long, text string")
    assert [r["t"] for r in docs.orderBy("doc_id").select(ingest.is_title("text").alias("t")).collect()] == [True, False, False, True, False]
    parts = ingest.chunks_by_split(docs, 2, articles=True)
    assert parts.where("doc_id in (0, 1, 2)").select("split").distinct().count() == 1


def test_cache_prunes_other_splits(spark, tmp_path):
    pos = spark.createDataFrame([(1, "ds", 0, [1.0], 2), (2, "val", 0, [2.0], 3)], "pos_id long, split string, chunk_id long, x array<double>, y int")
    ingest.save_cache(pos, f"file://{tmp_path}/c")
    got = ingest.load_cache(spark, f"file://{tmp_path}/c", "val")
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().toString() and [r["pos_id"] for r in got.collect()] == [2]


def test_no_chunk_group_is_in_two_splits_of_documents(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    c = ingest.chunks_by_split(docs, 3).select("split", F.explode("tokens").alias("t")).where("t rlike '^[0-9]+$'").distinct()
    assert c.groupBy("t").count().where("count > 1").count() == 0
