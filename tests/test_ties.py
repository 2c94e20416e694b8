import numpy as np

from recallgrid.operators import geometry, vectors


def frame(spark, ids, m, parts):
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, m)], "pos_id long, x array<double>").repartition(parts)


def test_ties_beyond_the_spare_go_to_the_lower_id(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 24))
    m = np.concatenate([np.repeat(base[:1], 900, 0), np.repeat(base[1:2], 40, 0), base[2:], base[3:4]])
    ids = rng.permutation(len(m))
    q = np.concatenate([base + rng.normal(size=base.shape), base[:2]])
    exact = np.sqrt(((m[None] - q[:, None]) ** 2).sum(2))
    want = {(j, r + 1, int(ids[c])) for j in range(len(q)) for r, c in enumerate(np.lexsort((ids, exact[j]))[:17])}
    ask = frame(spark, range(len(q)), q, 2)
    for parts in (1, 5):
        got = vectors.nearest(ask, frame(spark, ids, m, parts), 17).collect()
        assert {(r["query_id"], r["rank"], r["entry_id"]) for r in got} == want
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    got = vectors.nearest(ask, frame(spark, ids, m, 3), 17).collect()
    assert {(r["query_id"], r["rank"], r["entry_id"]) for r in got} == want


def test_cluster_neighbours_give_ties_to_the_lower_id(spark):
    x = np.random.default_rng(1).normal(size=(1, 5))
    rows = [(0, int(i), x[0].tolist()) for i in np.random.default_rng(2).permutation(50)]
    got = geometry.cluster_neighbours(spark.createDataFrame(rows, "cluster_id long, pos_id long, x array<double>"), 3).collect()
    assert {(r["pos_id"], r["other"]) for r in got} == {(i, j) for i in range(50) for j in [j for j in range(5) if j != i][:3]}
