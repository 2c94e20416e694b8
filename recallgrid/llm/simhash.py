"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees, closed to components.

Fingerprints within 3 bits of each other agree wholly on at least ``blocks - 3`` of ``blocks``
equal bit ranges, so each distinct fingerprint is sent once to the shard of every such choice of
ranges. A shard's fingerprints form a BK-tree (a child hangs from its parent by their integer
Hamming distance); each member walks it along the edges within the radius only. Trees are built in
the task that holds the shard: a broadcast of all shard trees would gather every fingerprint on the
driver and grow with the data. Shards too large for a task are cut finer, and where that doesn't help, their trees
are broadcast in pieces of a counted size and walked by members that stay spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, Scratch, add_columns
from .components import connected_components

RADIUS = 3
SHINGLE = 3
#: Mean members of a shard above which one more block is used.
SHARD_MEAN = 256
#: Members above which a shard is cut finer, how often, and nodes of a tree that is broadcast (about 32 MB).
HOT_SHARD, LEVELS, TREE_NODES = 20_000, 2, 1 << 20
#: Queries walked between two looks at which subtrees have become one component.
WALK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles of a text, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxh64_intdigest(b" ".join(words), seed=42)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    parts = (zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)]) for at in range(0, len(starts), 1 << 15))  # bounded memory for any length
    return majority(np.array([xxh64_intdigest(joined[s:e], seed=42) for s, e in part], np.uint64) for part in parts)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the hashes, which come in parts."""
    counts, n = np.zeros(64, np.int64), 0
    for part in parts:
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text_col: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """Append the fingerprint as a signed 64-bit column."""

    def run(texts: list[bytes]) -> list[list]:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return add_columns(df, text_col, [T.StructField(name, T.LongType())], run)


def fingerprint_hex(col: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


class BKForest:
    """BK-trees of many shards at once, level by level.

    ``keys`` holds parent * 65 + distance of every child in ascending order and ``kids`` the child,
    so the children of a node over a range of distances are one slice.
    """

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        order = np.argsort(shard, kind="stable")
        self.fp, shard = fp[order], shard[order]
        n = len(fp)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        items = np.flatnonzero(~first)
        at = self.root[items]
        keys, kids = [], []
        while len(items):
            key = at * 65 + np.bitwise_count(self.fp[items] ^ self.fp[at])
            o = np.argsort(key, kind="stable")
            items, key, at = items[o], key[o], at[o]
            lead = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[lead])
            kids.append(items[lead])
            self.levels.append((at[lead], items[lead]))
            at = items[lead][np.cumsum(lead) - 1][~lead]
            items = items[~lead]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        o = np.argsort(keys, kind="stable")
        self.keys, self.kids = keys[o], kids[o]

    def components(self, radius: int, walk: int = WALK, used: list | None = None) -> np.ndarray:
        """The least member of each member's component within its shard.

        A subtree that is one component already, the query's own, is not walked again: that keeps
        a shard full of near copies from costing its square. ``used`` gets pairs within the radius that span the components.
        """
        n = len(self.fp)
        label = np.arange(n)
        low, high = label.copy(), label.copy()
        for begin in range(0, n, walk):
            q = np.arange(begin, min(n, begin + walk))
            v = self.root[q]
            found_q, found_v = [], []
            while len(q):
                d = np.bitwise_count(self.fp[q] ^ self.fp[v]).astype(np.int64)
                hit = (d <= radius) & (q != v)
                found_q.append(q[hit])
                found_v.append(v[hit])
                lo = np.searchsorted(self.keys, v * 65 + np.maximum(d - radius, 1))
                hi = np.searchsorted(self.keys, v * 65 + np.minimum(d + radius, 64), side="right")
                count = hi - lo
                q = np.repeat(q, count)
                v = self.kids[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(q))]
                own = label[q]
                todo = (low[v] != own) | (high[v] != own)
                q, v = q[todo], v[todo]
            a, b = np.concatenate(found_q), np.concatenate(found_v)
            if len(a):
                label = join(label, a, b, used)
                low, high = label.copy(), label.copy()
                for parent, kid in reversed(self.levels):
                    np.minimum.at(low, parent, low[kid])
                    np.maximum.at(high, parent, high[kid])
        return label


    def near(self, fps: np.ndarray, radius: int, walk: int = WALK) -> tuple[np.ndarray, np.ndarray]:
        """Links that span, with the tree's own members, what is within ``radius`` of each fingerprint.

        ``(i, v)``: fingerprint i and node v. A subtree that is one component already, that of a node the query
        has been linked to, isn't walked again, so a tree full of near copies costs no square.
        """
        n = len(self.fp)
        label = np.arange(n + len(fps))
        out_i, out_v = [], []
        low, high = label[:n].copy(), label[:n].copy()
        for begin in range(0, len(fps), walk):
            q = np.arange(begin, min(len(fps), begin + walk))
            v = np.zeros(len(q), np.int64)
            while len(q) and n:
                d = np.bitwise_count(fps[q] ^ self.fp[v]).astype(np.int64)
                hit = d <= radius
                out_i.append(q[hit])
                out_v.append(v[hit])
                label = join(label, n + q[hit], v[hit])
                lo = np.searchsorted(self.keys, v * 65 + np.maximum(d - radius, 1))
                hi = np.searchsorted(self.keys, v * 65 + np.minimum(d + radius, 64), side="right")
                count = hi - lo
                q = np.repeat(q, count)
                v = self.kids[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(q))]
                own = label[n + q]
                todo = (low[v] != own) | (high[v] != own)
                q, v = q[todo], v[todo]
            low, high = label[:n].copy(), label[:n].copy()
            for parent, kid in reversed(self.levels):
                np.minimum.at(low, parent, low[kid])
                np.maximum.at(high, parent, high[kid])
        i, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_v))
        return i, v


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray, used: list | None = None) -> np.ndarray:
    """Union the components of a[i] and b[i]; labels stay the least member. ``used`` gets the links that did it, one for each merger."""
    label = label.copy()
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        if used is not None:
            did = np.flatnonzero(label[high] == low)
            did = did[np.unique(high[did], return_index=True)[1]]
            used.append((a[did], b[did]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def bit_ranges(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` near-equal runs of the given bit numbers."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def first_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Each choice of ``blocks - radius`` of ``blocks`` bit ranges: links agree on one of these wholly."""
    return [sum(chosen) for chosen in combinations(bit_ranges(list(range(64)), blocks), blocks - radius)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks within a shard of ``mask``: it and one of ``radius + 1`` ranges of the other bits, as links in it agree on one."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | part for part in bit_ranges(rest, radius + 1)]


def shard_keys(fp: str, masks: list[int]) -> Column:
    """Array of a fingerprint's shards: a mask and the bits under it."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(m).cast("long").alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("m")) for m in signed))


def shard_links(
    prints: DataFrame, fp: str, count: int, radius: int = RADIUS, blocks: int | None = None, scratch: Scratch | None = None, direct: bool = False
) -> DataFrame:
    """Spanning links ``(a, b)`` of the distinct fingerprints within ``radius`` bits, by shard; ``direct``: each itself within the radius.

    A shard over ``HOT_SHARD`` members is cut finer, ``LEVELS`` times at most: by pigeonhole on the bits its
    members are free in, so no link is lost. What is over it even then agrees on 37 bits and more: such a
    shard's tree is broadcast, and its members walk it in the tasks where they lie.
    """
    spark = prints.sparkSession
    scratch = scratch or Scratch(spark)
    if blocks is None:
        blocks = radius + 1
        while blocks < radius + 4 and count / 2 ** (64 * (blocks - radius) / blocks) > SHARD_MEAN:
            blocks += 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def cut(rows: DataFrame, keys: Column) -> DataFrame:
        return rows.select(F.col(fp).alias("fp"), F.explode(keys).alias("s")).select("fp", F.col("s.t").alias("t"), F.col("s.m").alias("m"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        fps, t, m = (np.concatenate(x) for x in zip(*got))
        o = np.lexsort((fps, m, t))
        fps, t, m = fps[o], t[o], m[o]
        shard = np.cumsum(np.r_[True, (t[1:] != t[:-1]) | (m[1:] != m[:-1])])
        forest = BKForest(fps.view(np.uint64), shard)
        used: list | None = [] if direct else None
        label = forest.components(radius, used=used)
        yield spanning(forest, label) if used is None else direct_links(forest, used)

    masks, sent, links = first_masks(blocks, radius), cut(prints, shard_keys(fp, first_masks(blocks, radius))), None
    for level in range(LEVELS + 1):
        hot = scratch.table(sent.groupBy("t", "m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SHARD), "hot")
        crowded = not hot.isEmpty()
        cool = sent.join(hot, ["t", "m"], "left_anti") if crowded else sent
        found = cool.select("fp", "t", "m").repartition(tasks, "t", "m").mapInArrow(trees, "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not crowded:
            return links
        sent = scratch.table(sent.join(hot.select("t", "m"), ["t", "m"], "left_semi").select("fp", "t", "m"), "crowded")
        if level == LEVELS:
            return links.unionByName(broadcast_links(sent, hot, radius, tasks, scratch))
        finer = {m: finer_masks(m, radius) for m in masks}
        masks = [x for own in finer.values() for x in own]
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        keys = F.coalesce(*(F.when(F.col("t") == signed(m), shard_keys("fp", own)) for m, own in finer.items()))
        sent = sent.select("fp", F.explode(keys).alias("s")).select("fp", "s.t", "s.m")
    raise AssertionError("the last level returns")


def spanning(forest: BKForest, label: np.ndarray) -> pa.RecordBatch:
    apart = np.flatnonzero(label != np.arange(len(label)))
    own = forest.fp.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(own[apart]), pa.array(own[label[apart]])], names=["a", "b"])


def direct_links(forest: BKForest, used: list) -> pa.RecordBatch:
    own = forest.fp.view(np.int64)
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*used) if used else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], names=["a", "b"])


def broadcast_links(sent: DataFrame, hot: DataFrame, radius: int, tasks: int, scratch: Scratch) -> DataFrame:
    """Links in shards too large for a task: trees are broadcast in pieces of ``TREE_NODES`` nodes at most.

    A piece is a part of a shard, by a hash of the fingerprint into as many parts as its size, which was
    counted, asks for. Members of the shard lie spread over the tasks and each walks the piece's tree, so every pair
    within a shard meets. One piece at a time is on the driver.
    """
    spark = sent.sparkSession
    sized = sent.join(hot, ["t", "m"])
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / F.lit(TREE_NODES // 2)).cast("long"))
    members = scratch.table(sized.select("fp", "t", "m", part.alias("part")), "spread")
    links = None
    pieces = members.groupBy("t", "m", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("t", "m", "part")
    for piece in pieces.toLocalIterator():
        mine = members.where((F.col("t") == piece["t"]) & (F.col("m") == piece["m"]))
        nodes = mine.where(F.col("part") == piece["part"]).select("fp").toArrow()["fp"].to_numpy()
        tree = BKForest(np.sort(nodes).view(np.uint64), np.zeros(len(nodes), np.int64))
        shared = spark.sparkContext.broadcast(tree)

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy()
                a, b = shared.value.near(own.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(shared.value.fp.view(np.int64)[b])], names=["a", "b"])

        found = scratch.table(mine.select("fp").repartition(tasks, "fp").mapInArrow(walk, "a long, b long"), "walked")
        links = found if links is None else links.unionByName(found)
        shared.destroy()
    return links


def classify(
    df: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, shingle: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of every row, and ``(fp, root, component)`` of every distinct fingerprint."""
    scratch = Scratch(df.sparkSession)
    f, c = P + "fp", P + "component"
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = scratch.table(with_fingerprint(narrow, "text", f, shingle).select("id", f), "prints")
    prints = scratch.table(marked.groupBy(f).agg(F.min("id").alias("least")), "distinct")
    members = connected_components(shard_links(prints, f, prints.count(), radius, scratch=scratch), scratch)
    rooted = prints.join(members.withColumnRenamed("node", f), f, "left").select(
        f, "least", F.coalesce("root", f).alias("root")
    )
    least = scratch.table(rooted.groupBy("root").agg(F.min("least").alias(c)), "roots")
    return marked, scratch.table(rooted.join(least, "root").select(f, F.col("root").alias(P + "root"), c), "of-print")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """``(id, fingerprint, component)`` for every row: component is the least id reachable.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and links are followed to
    the end. Empty and null texts share fingerprint zero. Repeated rows each come back; a component
    of null ids only has component null, and a null id is never the least otherwise. An empty table
    gives no rows. Extra columns are ignored.
    """
    marked, of_print = classify(df, id_col, text_col, radius, shingle)
    return marked.join(of_print, P + "fp").select(
        F.col("id").alias(id_col), fingerprint_hex(P + "fp").alias("fingerprint"), F.col(P + "component").alias("component_id")
    )


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """One row of each component stays, whole: the one with the least id (of repeats, any one).

    Links are fingerprints within ``radius`` bits; with ``similarity`` (0.8 or more), texts whose sets of word shingles have
    that Jaccard similarity at least: the BK-trees' links are confirmed by it and those beyond ``radius`` are added (``jaccard.py``).
    Rows that share an id but not the text go or stay by their own component.
    Texts are shuffled once, by id and fingerprint: the semi join and the removal of repeats share that partitioning.
    Rows without an id stay only where their whole component has none, one for each such component.
    """
    if similarity is None:
        marked, of_print = classify(df, id_col, text_col, radius, shingle)
        stamp = with_fingerprint
    else:
        from .jaccard import classify_similar, with_set_print  # which builds on this module

        marked, of_print = classify_similar(df, id_col, text_col, similarity, shingle, radius)
        stamp = with_set_print
    own = F.col(f"`{id_col}`")
    keep = marked.join(of_print, P + "fp").where(F.col("id") == F.col(P + "component"))
    keep = keep.groupBy(P + "root").agg(F.min(P + "fp").alias(P + "fp"), F.min("id").alias(P + "keep"))
    named = stamp(df.where(own.isNotNull()), text_col, P + "fp", shingle).alias("d")
    same = (own == F.col(P + "keep")) & (F.col(f"d.{P}fp") == F.col(f"k.{P}fp"))
    kept = named.join(keep.alias("k"), same, "left_semi").dropDuplicates([id_col, P + "fp"]).drop(P + "fp")
    nameless = of_print.where(F.col(P + "component").isNull()).select(P + "fp", P + "root")
    rest = stamp(df.where(own.isNull()), text_col, P + "fp", shingle).join(nameless, P + "fp").dropDuplicates([P + "root"])
    return kept.unionByName(rest.select(*(f"`{c}`" for c in df.columns)))
