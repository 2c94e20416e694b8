"""Steps whose rows, memory or traffic may not grow faster than the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from recallgrid.operators import read, vectors


def held(f, *args):
    """What a function gives, and the MB it held at most beside its arguments."""
    tracemalloc.start()
    try:
        out = f(*args)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def task(monkeypatch, plan):
    """The function that a plan's cogroup runs in a task."""
    got = []
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: got.append(f) or self._gd1._df.limit(0).selectExpr("0L query_id", "0L entry_id", "0L cluster_id", "0d dist", "0d w", "0 token", "0d top", "0d e"))
    plan()
    monkeypatch.undo()
    return got[0]


def lists(m):
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def test_uniform_kernel_makes_no_row_for_a_pair(spark):
    members = spark.range(3000).select(F.col("id").alias("pos_id"), (F.col("id") % 2).alias("cluster_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("token"), F.array(F.lit(0.0)).alias("mx"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("qx"))
    weighted = queries.select("query_id", F.explode(F.array(*(F.lit(c).cast("long") for c in (0, 1, 9)))).alias("cluster_id"), F.lit(0.25).alias("w"))  # cluster 9 is empty
    one = lambda d: {(r["query_id"], r["cluster_id"], r["token"]): (r["w"], r["wm"]) for r in d.groupBy("query_id", "cluster_id", "token").agg(F.first("w").alias("w"), F.sum("wm").alias("wm")).collect()}
    got = read.member_sums(weighted, members, queries, "uniform")
    want = one(read.member_terms(weighted, members, queries, "uniform"))
    assert got.count() == len(want) == 40 * 2 * 6 and {k: pytest.approx(v, abs=1e-12) for k, v in one(got).items()} == want
    assert read.member_sums(weighted, members.limit(0), queries, "uniform").count() == 0


def test_blocks_meet_within_few_megabytes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m, q = rng.normal(size=(20_000, 16)), rng.normal(size=(1500, 16))
    m[:900] = m[0]
    frame = spark.range(10).select(F.col("id").alias("q"), F.col("id").alias("e"), F.array(F.lit(0.0)).alias("x"))
    pair = task(monkeypatch, lambda: vectors._block_join(frame.select("q", "x"), frame.select("e", "x"), 50))
    order = rng.permutation(len(m))
    left = pa.table({"q": np.arange(len(q)), "x": lists(q)})
    right = pa.concat_tables([pa.table({"e": order[a : a + 7000], "x": lists(m[order[a : a + 7000]])}) for a in range(0, len(m), 7000)])
    got, mb = held(pair, left, right)
    assert mb < 60  # 138 MB where 8,192 entries at a time had their distances to 1,024 queries held
    near = got["entry_id"].to_numpy().reshape(len(q), 50)
    for r in (0, 700, 1499):
        d = ((m - q[r]) ** 2).sum(1)
        assert near[r].tolist() == np.lexsort((np.arange(len(m)), d))[:50].tolist()


def test_expressions_rank_only_what_may_be_near(spark):
    rng = np.random.default_rng(7)
    m = np.concatenate([rng.normal(size=(2500, 18)), np.repeat(rng.normal(size=(50, 18)), 10, axis=0)])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "pos_id long, x array<double>")
    asked = rows.where("pos_id % 50 = 0")
    got = vectors.nearest_expr(asked, rows, 5, 18)
    want = vectors.nearest(asked, rows, 5)
    one = lambda d: sorted((r["query_id"], r["rank"], r["entry_id"], round(r["dist"], 9)) for r in d.collect())
    assert one(got) == one(want) and len(one(got)) == 5 * 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "edge" in plan


def test_members_meet_queries_within_few_megabytes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m, q = rng.normal(size=(read.PART_MEMBERS, 16)), rng.normal(size=(2000, 16))
    members = spark.range(3).select("id", F.col("id").alias("pos_id"), F.lit(0).cast("long").alias("cluster_id"), F.lit(1).alias("token"), F.array(F.lit(0.0)).alias("mx"))
    queries = members.select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("qx"))
    meet = task(monkeypatch, lambda: read.member_sums(queries.selectExpr("query_id", "0L cluster_id", "1d w"), members, queries))
    zeros = np.zeros(len(q), np.int64)
    left = pa.table({"cluster_id": zeros, "query_id": np.arange(len(q)), "w": np.ones(len(q)), "qx": lists(q)})
    right = pa.table({"cluster_id": np.zeros(len(m), np.int64), "pos_id": np.arange(len(m)), "token": np.arange(len(m), dtype=np.int32) % 10, "mx": lists(m)})
    got, mb = held(meet, left, right)
    assert mb < 70  # 169 MB where 4,000,000 distances were held at a time, of four times the members
    z = -np.sqrt(((m - q[7]) ** 2).sum(1)) / 0.1
    e = np.exp(z - z.max())
    want = np.bincount(np.arange(len(m)) % 10, weights=e) / e.sum()
    assert got["e"].to_numpy()[70:80] == pytest.approx(want, abs=1e-9)


def test_a_regressor_is_fitted_in_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    from recallgrid.operators import heads

    seen = []
    fit = heads.GBTRegressor.fit
    monkeypatch.setattr(heads.GBTRegressor, "fit", lambda self, d: seen.append((d.rdd.getNumPartitions(), d.count())) or fit(self, d))
    rows = spark.range(600).select("id", F.when(F.col("id") % 2 == 0, "ct").otherwise("val").alias("split"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    got = heads.gate(rows.withColumn("t", F.col("a") * 2 + F.col("b")).repartition(90), ["a", "b"], "t")
    assert got.where("abs(predicted - t) < 3").count() > 500
    assert seen[0][0] <= spark.sparkContext.defaultParallelism and seen[0][1] == 300


def test_chunks_move_as_texts(spark):
    from recallgrid.sources import ingest

    docs = spark.createDataFrame([(i, "  a b\tc\n" * (i % 5) if i % 9 else None) for i in range(60)], "doc_id long, text string")
    got = ingest.chunks(docs, 7)
    tokens = [t for i in range(60) for t in ["a", "b", "c"] * (i % 5 if i % 9 else 0) + ["<eos>"]]
    rows = got.orderBy("chunk_id").collect()
    assert [r["tokens"] for r in rows] == [tokens[a : a + 7] for a in range(0, len(tokens) - 6, 7)]
    moved = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in line]
    assert moved and "array_join(slice" in got._jdf.queryExecution().optimizedPlan().toString()
