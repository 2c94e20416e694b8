"""Vector work that pays for BLAS: grouped sums, nearest neighbours, nearest centroids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A query side of at most so many rows and numbers (rows times dimensions, 64 MB) is broadcast.
BROADCAST_ROWS = 8192
BROADCAST_NUMBERS = 8_000_000
#: Queries of a block when neither side is small; it meets so many times four entries in a task.
BLOCK_ROWS = 8192
#: Queries and entries whose distances a task holds at a time: 8 MB.
TILE = (512, 2048)
#: One entry in so many tells, in generated code, how far the k nearest may be; and the coordinates that are compared first.
SHARE, FIRST = 16, 16
#: Candidates kept beyond k until ties are settled.
SPARE = 8
#: Gaps between squared distances below the square of this share of the squared norms are settled by exact distances.
NEAR = 1e-5


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    n = len(col)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False) if n else np.zeros(0)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def closest(v: np.ndarray, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and distance of the nearest row of ``m`` for each row of ``v``; exact, ties to the lower id."""
    best, dist = np.empty(len(v), np.int64), np.empty(len(v))
    order = np.argsort(ids, kind="stable")
    for a in range(0, len(v), 1024):
        part = v[a : a + 1024]
        none = (np.zeros((len(part), 0)), np.zeros((len(part), 0), np.int64))
        best[a : a + 1024] = top_k(part, ids, m, none, 1)[1][:, 0]
        at = order[np.searchsorted(ids, best[a : a + 1024], sorter=order)]
        dist[a : a + 1024] = np.sqrt(((part - m[at]) ** 2).sum(1))
    return best, dist


def vector_sums(df: DataFrame, key: str, x: str = "x", weight: str | None = None) -> DataFrame:
    """``(key, n, total, s)``: rows, sum of weights and weighted vector sum of each key.

    Each task first adds up its own rows, so the shuffle carries a vector per key and task.
    """

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return _sums(df.select(F.col(key).cast("long").alias("k"), x, w.alias("w")), lambda b: (b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)), key)


def nearest_sums(df: DataFrame, ids: np.ndarray, m: np.ndarray, x: str = "x") -> DataFrame:
    """The same keyed by the nearest row of ``m``: one pass over the vectors, which never move."""
    shared = df.sparkSession.sparkContext.broadcast((ids, m))

    def keyed(b: pa.RecordBatch):
        v = matrix(b.column(0))
        return closest(v, *shared.value)[0], v, np.ones(len(v))

    return _sums(df.select(x), keyed, "cluster_id")


def _sums(df: DataFrame, read, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, list[float]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys, m, w = read(b)
            uniq, at = np.unique(keys, return_inverse=True)
            part = np.zeros((len(uniq), m.shape[1]))
            np.add.at(part, at, m * w[:, None])
            n, t = np.bincount(at), np.bincount(at, weights=w)
            for i, k in enumerate(uniq.tolist()):
                if k in sums:
                    sums[k] += part[i]
                    counts[k][0] += n[i]
                    counts[k][1] += t[i]
                else:
                    sums[k], counts[k] = part[i], [n[i], t[i]]
        ks = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ks, pa.int64()), pa.array([int(counts[k][0]) for k in ks], pa.int64()), pa.array([counts[k][1] for k in ks], pa.float64()),
             pa.array([sums[k].tolist() for k in ks], pa.list_(pa.float64()))], names=["k", "n", "total", "s"],
        )

    part = df.mapInArrow(run, "k long, n long, total double, s array<double>")
    # One aggregation for counts and coordinates: they travel as coordinates -2 and -1 of the vector.
    coords = F.concat(F.array(F.col("n").cast("double"), F.col("total")), F.col("s"))
    dims = part.select("k", F.posexplode(coords).alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    vecs = dims.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("a"))
    return vecs.select(F.col("k").alias(key), F.col("a")[0].cast("long").alias("n"), F.col("a")[1].alias("total"), F.slice("a", F.lit(3), F.size("a") - 2).alias("s"))


def top_k(
    q: np.ndarray, ids: np.ndarray, m: np.ndarray, best: tuple[np.ndarray, np.ndarray], keep: int, own: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Merge a block of entries into the best ``keep`` squared distances and ids of each query.

    ``own``: ascending ids, and vectors, of the entries in ``best`` and in the block. Where more entries than fit lie at the edge, exact
    distances and then ids choose among them. Once ``best`` is full, only entries up to its edge, and what rounding may hide beyond, are merged.
    """
    scale = (q * q).sum(1)
    d = (-2 * q) @ m.T
    d += scale[:, None]
    d += (m * m).sum(1)[None, :]
    i = few = None
    if best[0].shape[1] == keep:
        edge = best[0].max(1)
        r, c = np.divmod(np.flatnonzero(~(d > (edge + NEAR * NEAR * (np.abs(edge) + scale))[:, None])), d.shape[1])
        many = np.bincount(r, minlength=len(q))
        if many.max(initial=0) <= d.shape[1] // 4:
            at = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            few, i = np.full((len(q), many.max(initial=0)), np.inf), np.zeros((len(q), many.max(initial=0)), np.int64)
            few[r, at], i[r, at] = d[r, c], ids[c]
    if few is None:  # the block alone is cut first: less to merge
        few, i = _cut(d, np.broadcast_to(ids, d.shape), keep, scale, lambda r, c: ((m[c] - q[r]) ** 2).sum(1))
    d, i = np.concatenate([best[0], few], axis=1), np.concatenate([best[1], i], axis=1)
    if d.shape[1] <= keep:
        return d, i
    if own is None:
        order = np.argsort(ids, kind="stable")
        own = ids[order], m[order]
    return _cut(d, i, keep, scale, lambda r, c: ((own[1][np.searchsorted(own[0], i[r, c])] - q[r]) ** 2).sum(1))


def _cut(d: np.ndarray, i: np.ndarray, keep: int, scale: np.ndarray, exact) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` least of each row; ``exact(row, columns)`` settles rows where others lie within rounding of the last."""
    if d.shape[1] <= keep:
        return d, i
    at = np.argpartition(d, keep, axis=1)[:, : keep + 1]
    after = np.take_along_axis(d, at[:, keep:], 1)[:, 0]
    at = at[:, :keep]
    edge = np.take_along_axis(d, at, 1).max(1)
    margin = NEAR * NEAR * (np.abs(edge) + scale)
    for r in np.flatnonzero(after <= edge + margin):
        c = np.flatnonzero(d[r] <= edge[r] + margin[r])
        sq = d[r, c]
        tied = sq >= edge[r] - margin[r]
        inside = c[~tied]
        c = c[tied]
        o = np.lexsort((i[r, c], exact(r, c)))[: keep - len(inside)]
        at[r] = np.concatenate([inside, c[o]])
    return np.take_along_axis(d, at, 1), np.take_along_axis(i, at, 1)


def nearest(queries: DataFrame, store: DataFrame, k: int, q_id: str = "pos_id", s_id: str = "pos_id", x: str = "x") -> DataFrame:
    """Exact Euclidean k nearest entries: ``(query_id, rank, entry_id, dist)``, ties to the lower id.

    The query side is broadcast if it is proven small; each task then scans its share of the store
    once and sends k rows a query. Otherwise the store is, if it is proven small: each task ranks its own queries
    whole, and nothing is shuffled. With neither small both sides are cut into blocks and every pair of blocks
    meets in one task. k beyond the store's size gives the whole store.
    """
    spark = store.sparkSession
    q = queries.select(F.col(q_id).cast("long").alias("q"), F.col(x).alias("x"))
    s = store.select(F.col(s_id).cast("long").alias("e"), F.col(x).alias("x"))
    head = q.limit(BROADCAST_ROWS + 1).toArrow()
    qi, qm = head["q"].to_numpy(), matrix(head["x"].combine_chunks())
    if not len(qi):
        part = spark.createDataFrame([], "query_id long, entry_id long, dist double")
    elif len(qi) <= BROADCAST_ROWS and qm.size <= BROADCAST_NUMBERS:
        shared = spark.sparkContext.broadcast((qi, qm))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qi, qm = shared.value
            yield from _ranked(qi, qm, ((b.column(0).to_numpy(), matrix(b.column(1))) for b in batches if b.num_rows), k)

        part = s.mapInArrow(scan, "query_id long, entry_id long, dist double")
    else:
        head = s.limit(BROADCAST_ROWS + 1).toArrow()
        if 0 < head.num_rows <= BROADCAST_ROWS and head["x"].combine_chunks().flatten().__len__() <= BROADCAST_NUMBERS:
            return _small_store(q, head, k)
        part = _block_join(q, s, k)
    order = Window.partitionBy("query_id").orderBy("dist", "entry_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "entry_id", "dist")


def _small_store(q: DataFrame, store: pa.Table, k: int) -> DataFrame:
    """``nearest`` with the whole store in each task: queries are ranked where they lie."""
    shared = q.sparkSession.sparkContext.broadcast(_ascending(store["e"].to_numpy(), matrix(store["x"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        for b in batches:
            for a in range(0, b.num_rows, TILE[0]):
                part = b.slice(a, TILE[0])
                for got in _ranked(part.column(0).to_numpy(), matrix(part.column(1)), [(ids, m)], k):
                    rank = np.tile(np.arange(1, min(k, len(ids)) + 1, dtype=np.int32), got.num_rows // min(k, len(ids)))
                    yield pa.RecordBatch.from_arrays([got.column(0), pa.array(rank), got.column(1), got.column(2)], names=["query_id", "rank", "entry_id", "dist"])

    return q.mapInArrow(run, "query_id long, rank int, entry_id long, dist double")


def packed(store: DataFrame, s_id: str = "pos_id", x: str = "x", rows: int = 512) -> DataFrame:
    """A store as blocks ``(ids, vectors, dims)`` of raw numbers, to be written or cached for many searches.

    A search then hands whole blocks to BLAS instead of reading lists number by number. Blocks keep to their
    input partition; vectors are doubles, or floats where the column holds floats.
    """
    kind = "<f4" if "float" in store.schema[x].dataType.simpleString() else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, rows):
                part = b.slice(a, rows)
                m = matrix(part.column(1))
                cells = [part.column(0).to_numpy().astype("<i8").tobytes()], [m.astype(kind).tobytes()], [m.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary()), pa.array(cells[2], pa.int32())], names=["ids", "vectors", "dims"])

    return store.select(F.col(s_id).cast("long"), F.col(x)).mapInArrow(run, "ids binary, vectors binary, dims int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of packed rows, several blocks at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        for ids, raw, dims in zip(b.column(0), b.column(1), b.column(2)):
            i = np.frombuffer(ids.as_buffer(), "<i8")
            v = np.frombuffer(raw.as_buffer(), "<f4" if raw.as_buffer().size == 4 * len(i) * dims.as_py() else "<f8")
            held.append((i, v.reshape(len(i), -1).astype(np.float64)))
            if sum(len(i) for i, _ in held) >= BLOCK_ROWS:
                yield np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
                held = []
    if held:
        yield np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])


def nearest_packed(queries: DataFrame, blocks: DataFrame, k: int, q_id: str = "pos_id", x: str = "x") -> DataFrame:
    """``nearest`` over a ``packed`` store, the same rows. Queries too many to broadcast meet the store unpacked."""
    spark = blocks.sparkSession
    head = queries.select(F.col(q_id).cast("long").alias("q"), F.col(x).alias("x")).limit(BROADCAST_ROWS + 1).toArrow()
    qi, qm = head["q"].to_numpy(), matrix(head["x"].combine_chunks())
    if len(qi) > BROADCAST_ROWS or qm.size > BROADCAST_NUMBERS:

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, m in _blocks(batches):
                offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))], names=["pos_id", "x"])

        return nearest(queries.select(F.col(q_id).alias("pos_id"), F.col(x).alias("x")), blocks.mapInArrow(unpack, "pos_id long, x array<double>"), k)
    shared = spark.sparkContext.broadcast((qi, qm))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shared.value[0]):
            yield from _ranked(*shared.value, _blocks(batches), k)

    part = blocks.mapInArrow(scan, "query_id long, entry_id long, dist double")
    order = Window.partitionBy("query_id").orderBy("dist", "entry_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "entry_id", "dist")


def _ascending(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order with their vectors; no copy where they are in order."""
    if (ids[1:] >= ids[:-1]).all():
        return ids, m
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _ranked(qi: np.ndarray, qm: np.ndarray, blocks, k: int) -> Iterator[pa.RecordBatch]:
    """Best k of a stream of entry blocks for each query, with exact distances.

    Candidates are kept by expanded squared distances, a few beyond k, ties at the edge by plain differences
    and ids; their vectors are kept too, and all returned distances are plain differences. Distances are held for a ``TILE`` at a time.
    """
    step, tile = TILE
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    own_ids, own = np.zeros(0, np.int64), np.zeros((0, qm.shape[1]))
    for ids, m in blocks:
        own_ids, own = _ascending(np.concatenate([own_ids, ids]), np.concatenate([own, m])) if len(own_ids) else _ascending(ids, m)
        for a in range(0, len(qi), step):
            q = qm[a : a + step]
            best = kept.get(a, (np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)))
            for b in range(0, len(ids), tile):
                best = top_k(q, ids[b : b + tile], m[b : b + tile], best, k + SPARE, (own_ids, own))
            kept[a] = best
        live = np.unique(np.concatenate([i.ravel() for _, i in kept.values()]))
        if 2 * len(live) <= len(own_ids):
            own_ids, own = live, own[np.searchsorted(own_ids, live)]
    for a, (sq, i) in kept.items():
        o = np.lexsort((i, sq), axis=1)
        i, sq = np.take_along_axis(i, o, 1), np.take_along_axis(sq, o, 1)
        q = qm[a : a + step]
        # Tasks meet in an order by distance and id: equal distances must be equal numbers in all of them.
        r, c = (x.ravel() for x in np.indices(sq.shape))
        for f in range(0, len(r), 65_536):
            rf, cf = r[f : f + 65_536], c[f : f + 65_536]
            sq[rf, cf] = ((own[np.searchsorted(own_ids, i[rf, cf])] - q[rf]) ** 2).sum(1)
        d = np.sqrt(np.maximum(sq, 0))
        o = np.lexsort((i, d), axis=1)[:, :k]
        near, dist = np.take_along_axis(i, o, 1), np.take_along_axis(d, o, 1)
        who = np.repeat(qi[a : a + step], near.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(near.ravel()), pa.array(dist.ravel())], names=["query_id", "entry_id", "dist"])


def _block_join(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
    """Blocks of both sides in one cogroup for each pair of blocks, whatever the size of the sides."""
    nq = max(1, -(-q.count() // BLOCK_ROWS))
    ns = max(1, -(-s.count() // (4 * BLOCK_ROWS)))
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(nq))).withColumn("sb", seq(ns))
    s = s.withColumn("sb", F.pmod(F.xxhash64("e"), F.lit(ns))).withColumn("qb", seq(nq))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("entry_id", pa.int64()), ("dist", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        # One copy of the entries, in the order of their ids; the queries are taken a part at a time.
        ids = right["e"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place, m, at = np.empty_like(order), None, 0
        place[order] = np.arange(len(ids))
        for part in (matrix(b) for b in right["x"].chunks if len(b)):
            m = np.empty((len(ids), part.shape[1])) if m is None else m
            m[place[at : at + len(part)]] = part
            at += len(part)
        parts = (left.slice(a, TILE[0]) for a in range(0, left.num_rows, TILE[0]))
        return pa.Table.from_batches([g for p in parts for g in _ranked(p["q"].to_numpy(), matrix(p["x"]), [(ids[order], m)], k)], schema)

    return q.groupBy("qb", "sb").cogroup(s.groupBy("qb", "sb")).applyInArrow(pair, "query_id long, entry_id long, dist double")


def nearest_expr(queries: DataFrame, store: DataFrame, k: int, dims: int, q_id: str = "pos_id", s_id: str = "pos_id", x: str = "x") -> DataFrame:
    """The same join as column expressions only, without Python.

    Blocks of both sides meet by their numbers, so no side passes through the driver. Of ``k`` groups of a share of the store's entries each has
    one within the greatest of their least distances, so no entry beyond that is among the k nearest: pairs beyond it are dropped in the join,
    many after their first coordinates, and only the rest is ranked. Where a group is empty everything is ranked.
    """
    flat = lambda name: [F.coalesce(F.col(x)[i].cast("double"), F.lit(float("nan"))).alias(f"{name}{i}") for i in range(dims)]
    q = queries.select(F.col(q_id).cast("long").alias("query_id"), *flat("q"))
    s = store.select(F.col(s_id).cast("long").alias("entry_id"), *flat("s"))
    many, cores = q.count(), q.sparkSession.sparkContext.defaultParallelism
    nq = max(1, -(-many // BLOCK_ROWS), min(4 * cores, many // 64))
    ns = max(1, -(-s.count() // (4 * BLOCK_ROWS)))
    dist = lambda n: F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"q{i}") - F.col(f"s{i}")) * (F.col(f"q{i}") - F.col(f"s{i}")) for i in range(n)]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def meet(q: DataFrame, s: DataFrame, ns: int) -> DataFrame:
        q = q.withColumn("qb", block("query_id", nq)).withColumn("sb", every(ns))
        s = s.withColumn("sb", block("entry_id", ns)).withColumn("qb", every(nq))
        return q.join(s.hint("shuffle_hash"), ["qb", "sb"])

    share = s.where(F.pmod(F.xxhash64(F.lit(1), "entry_id"), F.lit(SHARE)) == 0)
    group = F.pmod(F.xxhash64(F.lit(2), "entry_id"), F.lit(k))
    least = meet(q, share, max(1, -(-ns // SHARE))).select("query_id", group.alias("g"), dist(dims).alias("d")).groupBy("query_id", "g").agg(F.min("d").alias("d"))
    edge = least.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("edge"))
    q = q.join(edge, "query_id", "left").withColumn("edge", F.coalesce("edge", F.lit(float("nan"))))  # NaN is greater than any number
    pairs = meet(q, s, ns)
    for n in (*((FIRST,) if dims > FIRST else ()), dims):
        pairs = pairs.where(dist(n) <= F.col("edge"))
    pairs = pairs.select("query_id", "entry_id", dist(dims).alias("dist"))
    order = Window.partitionBy("query_id").orderBy("dist", "entry_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "entry_id", "dist")
