"""Ranks, memoised results, extractors, sinks and the stream of a store's contents."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.operators import store
from recallgrid.operators.ranking import exact_quantiles, with_rank, with_running_sum
from recallgrid.schema import POSITIONS
from recallgrid.sources import extract, ingest
from recallgrid.sources.memo import memoised, signature_of
from recallgrid.streaming import store as live


@pytest.mark.parametrize("ranges", [1, 3, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_equal_a_global_window(spark, ranges, descending):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(v), int(v)) for i, v in enumerate(rng.integers(0, 40, 300))], "id long, x double, s long").repartition(5)
    order = Window.orderBy(F.col("x").desc() if descending else F.col("x"), "id")
    want = df.withColumn("rk", F.row_number().over(order)).withColumn("run", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = with_running_sum(with_rank(df, "x", ["id"], "rk", descending, ranges), "x", ["id"], F.col("s"), "run", descending, ranges)
    cols = ["id", "rk", "run"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert with_rank(df.limit(0), "x", ["id"]).count() == 0


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_exact_quantiles_equal_numpy(spark, ranges):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500) / 7)] + [(9, 1.5), (1, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "x", qs, ["g"], ranges).collect()}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], qs).tolist())
    whole = exact_quantiles(df, "x", qs, ranges=ranges).first()["q"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], qs).tolist())


def test_offsets_equal_a_global_window(spark):
    df = spark.createDataFrame([(i * 37 % 5000, i % 7) for i in range(400)], "doc_id long, n long").dropDuplicates(["doc_id"])
    w = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    got = ingest.with_offsets(df, "n", [], "doc_id", buckets=100)
    assert sorted(map(tuple, got.select("doc_id", "offset").collect())) == sorted(map(tuple, want.select("doc_id", "offset").collect()))


def test_memo_reads_back_and_follows_its_inputs(spark, tmp_path):
    calls = []
    root = f"file://{tmp_path}"

    def plan():
        calls.append(1)
        return spark.range(3)

    one = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string")
    assert memoised(spark, root, "m", one, plan).count() == 3
    assert memoised(spark, root, "m", one.orderBy(F.desc("i")), plan).count() == 3 and len(calls) == 1
    memoised(spark, root, "m", one.limit(1), plan)
    assert len(calls) == 2
    assert signature_of(one) != signature_of(one.unionAll(one)) and signature_of(one.limit(0))


def test_extractor_pairs_positions_with_next_tokens(spark):
    def make():
        def model(tokens):
            keys = np.array([[t, t * 2] for t in tokens], float)
            return keys, np.full((len(tokens), 4), 0.25)

        return model

    c = spark.createDataFrame([(0, [1, 2, 3]), (1, [0, 1])], "chunk_id long, tokens array<int>")
    got = extract.extract(c, make, make).orderBy("chunk_id", "pos").collect()
    assert [(r["chunk_id"], r["pos"], r["y"], r["x"], r["x2"]) for r in got] == [(0, 0, 2, [1.0, 2.0], [1.0, 2.0]), (0, 1, 3, [2.0, 4.0], [2.0, 4.0]), (1, 0, 1, [0.0, 0.0], [0.0, 0.0])]
    assert got[0]["p_lm"] == 0.25 and got[0]["entropy"] == pytest.approx(np.log(4), abs=1e-6)
    assert extract.chunk_losses(extract.extract(c, make)).first()["mean_nll"] == pytest.approx(np.log(4), abs=1e-6)


def test_rows_of_unlike_frames(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2.0)], "i int, x double"), spark.createDataFrame([(2, "y")], "i int, s string")
    for kind in ("csv", "json", "parquet"):
        ingest.save_rows([a, b], f"file://{tmp_path}/{kind}", kind)
        reader = spark.read.schema("i int, x double, s string")
        got = reader.option("header", True).csv(f"file://{tmp_path}/csv") if kind == "csv" else reader.format(kind).load(f"file://{tmp_path}/{kind}")
        assert sorted(map(tuple, got.collect())) == [(1, 2.0, None), (2, None, "y")]


def test_streamed_contents_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, "ds", i // 10, rng.normal(size=3).tolist(), int(i % 4)) for i in range(60)]
    proto = store.frame(spark, range(3), rng.normal(size=(3, 3)))
    src, out, ck = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, POSITIONS).coalesce(1).write.mode("append").parquet(f"file://{src}")
        live.append_counts(live.read_positions(spark, f"file://{src}"), proto, f"file://{out}", f"file://{ck}").awaitTermination()
    batch = spark.createDataFrame(rows, POSITIONS)
    want = store.distribution(store.assign_nearest(batch, proto).join(batch.select("pos_id", "y"), "pos_id"))
    key = lambda d: sorted(map(tuple, d.select("cluster_id", "token", "cnt").collect()))
    assert key(live.counts_so_far(spark, f"file://{out}")) == key(want)
    q = live.running_sizes(live.read_positions(spark, f"file://{src}"), proto).writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sizes").agg(F.sum("cnt")).first()[0] == 60


def test_lloyd_and_vector_sums(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "pos_id long, x array<double>, y int").repartition(4)
    from recallgrid.operators.vectors import vector_sums

    got = {r["y"]: r for r in vector_sums(df.withColumn("w", F.col("pos_id") * 0.5), "y", weight="w").collect()}
    for y in (0, 1):
        w = np.arange(50) * 0.5
        assert got[y]["s"] == pytest.approx((x * w[:, None])[np.arange(50) % 2 == y].sum(0).tolist()) and got[y]["n"] == 25
    c = x[:4].copy()
    for _ in range(3):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(4)])
    have = {r["cluster_id"]: r["x"] for r in store.lloyd(df, 4, 3).collect()}
    assert all(have[k] == pytest.approx(c[k].tolist()) for k in range(4))
