"""Near copies by exact Jaccard similarity of word shingles: BK-trees of SimHash fingerprints find them, sets confirm them, MinHash bands find the rest.

The links of the BK-trees (``simhash.shard_links`` over the SimHash of the same shingles) are compared exactly, and the components
of those that hold are where the bands start. Texts of similarity 0.8 differ in 10 of 64 SimHash bits on average and in up to 17, which no choice
of bit ranges carries, so bands add what lies beyond the radius. ``BANDS`` bands of ``ROWS`` minima miss a pair at 0.8 with probability 5e-5
(less above). Candidates are compared exactly. While buckets are large, what lies outside a bucket's largest component meets one
member of that component, another in each round; then whatever is still outside meets all it is apart from. So a
large group of near copies costs its rounds and its stragglers, not its square, and no candidate is left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, Scratch, add_columns
from .components import connected_components
from .simhash import RADIUS, majority, shard_links

BANDS, ROWS = 25, 5
#: Rounds at most in which a bucket's members meet one of its largest component only, and comparisons a
#: member below which everything still apart is compared at once.
STARS, FEW = 12, 4
_random = np.random.RandomState(20240517)
_A = _random.randint(0, 1 << 63, BANDS * ROWS).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_B = _random.randint(0, 1 << 63, BANDS * ROWS).astype(np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, A-Z in lower case, repeats included; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), seed=42)], np.uint64)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[s:e], seed=42) for s, e in zip(starts, ends)), np.uint64, len(starts))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def set_print(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes())


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):  # bounded memory for any length
        np.minimum(out, (s[a : a + 4096, None] * _A + _B).min(0), out=out)
    return out


def with_set_print(df: DataFrame, text_col: str, name: str, shingle: int) -> DataFrame:
    """Append the 64-bit hash of the shingle set: equal sets, equal numbers."""

    def run(texts: list[bytes]) -> list[list]:
        return [np.array([set_print(shingle_set(t, shingle)) for t in texts], np.uint64).view(np.int64)]

    return add_columns(df, text_col, [T.StructField(name, T.LongType())], run)


def with_signature(df: DataFrame, text_col: str, name: str, shingle: int) -> DataFrame:
    """Append the set's hash, ``sim`` (the text's SimHash), ``n`` (the set's size), ``s1``/``s2`` (a bit of each minimum) and ``bands``."""
    fields = [T.StructField(c, T.LongType()) for c in (name, "sim", "n", "s1", "s2")] + [T.StructField("bands", T.ArrayType(T.LongType()))]

    def run(texts: list[bytes]) -> list[list]:
        from xxhash import xxh3_64_intdigest

        fp, sim, n, bits, bands = [], [], [], [], []
        for t in texts:
            h = shingle_hashes(t, shingle)
            s = np.unique(h)
            low = minima(s)
            sim.append(majority(h[a : a + (1 << 15)] for a in range(0, len(h), 1 << 15)) if t.strip() else 0)
            fp.append(set_print(s))
            n.append(len(s))
            bits.append(np.packbits(np.r_[(low >> np.uint64(20) & np.uint64(1)).astype(np.uint8), np.zeros(128 - len(low), np.uint8)]).view(np.int64))
            raw = low.tobytes()
            bands.append(np.array([xxh3_64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], seed=b) for b in range(BANDS)], np.uint64).view(np.int64))
        both = np.array(bits, np.int64).reshape(-1, 2)
        return [np.array(fp, np.uint64).view(np.int64), np.array(sim, np.uint64).view(np.int64), n, both[:, 0], both[:, 1], bands]

    return add_columns(df, text_col, fields, run)


def near_links(marked: DataFrame, fp: str, radius: int, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of sets from the BK-trees: links that span the fingerprints within ``radius`` bits, and sets of one fingerprint.

    A fingerprint is held by its least set, which the others of that fingerprint meet. Equal sets may have several
    fingerprints, as those count repeats: each one is in the trees.
    """
    sims = scratch.table(marked.select(fp, "sim").distinct(), "fingerprints")
    heads = scratch.table(sims.groupBy("sim").agg(F.min(fp).alias("head")), "heads")
    a, b = (heads.select(F.col("sim").alias(c), F.col("head").alias(f"h{c}")) for c in "ab")
    linked = shard_links(heads, "sim", heads.count(), radius, scratch=scratch, direct=True).join(a, "a").join(b, "b").select("ha", "hb")
    alike = sims.join(heads, "sim").select(F.col("head").alias("ha"), F.col(fp).alias("hb"))
    pairs = linked.unionByName(alike).where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    near = scratch.table(pairs.distinct(), "near")
    scratch.drop(sims, heads)
    return near


def similar_links(docs: DataFrame, prints: DataFrame, near: DataFrame, fp: str, similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of the sets that some other is similar to; ``docs``: (id, text), ``prints``: one row per set, ``near``: pairs of sets to compare first."""
    if similarity < 0.8:
        raise ValueError("the bands are made for similarities from 0.8")
    buckets = prints.select("least", F.col(fp).alias("fp"), F.explode("bands").alias("g"))
    full = scratch.table(buckets.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"), "buckets")
    ends = near.select(F.explode(F.array("a", "b")).alias("fp"))
    ends = prints.select("least", F.col(fp).alias("fp")).join(ends, "fp", "left_semi")
    need = scratch.table(buckets.join(full, "g").select("least", "fp").unionByName(ends).distinct(), "members")
    ids = need.select(F.col("least").alias("own")).distinct()
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("own")), "left_semi").select("text")

    def sets(texts: list[bytes]) -> list[list]:
        found = [shingle_set(t, shingle) for t in texts]
        return [np.array([set_print(s) for s in found], np.uint64).view(np.int64), [s.view(np.int64) for s in found]]

    wide = [T.StructField("fp", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))]
    held = add_columns(texts, "text", wide, sets, batch_bytes=2 << 20).select("fp", "set")
    held = scratch.table(held.join(need.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    # A shingle in one set only can't be shared: what is left bounds every overlap the set can have.
    alone = held.select("fp", F.explode("set").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("m"), F.min("fp").alias("fp")).where("m = 1")
    alone = alone.groupBy("fp").agg(F.count(F.lit(1)).alias("u"))
    able = prints.withColumnRenamed(fp, "fp").join(need.select("fp"), "fp", "left_semi").join(alone, "fp", "left").withColumn("o", F.col("n") - F.coalesce("u", F.lit(0)))
    able = scratch.table(able.where(F.col("o") >= similarity * F.col("n") - 1e-6).select("fp", "n", "o", "s1", "s2", "bands"), "able")
    members = able.select("fp", "n", "o", "s1", "s2", F.explode("bands").alias("g")).join(full, "g").withColumn("label", F.col("fp"))
    # A bit of each of the minima differs with probability (1 - J) / 2: beyond 5.5 deviations the pair can't be similar.
    share, n = (1 - similarity) / 2, BANDS * ROWS
    most = int(n * share + 5.5 * (n * share * (1 - share)) ** 0.5)
    may = F.expr(
        f"a.label <> b.label AND least(a.o, b.o) >= {similarity / (1 + similarity)!r} * (a.n + b.n) - 1e-6"
        f" AND bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2) <= {most}"
    )

    def similar(pairs: DataFrame) -> DataFrame:
        one = pairs.join(held.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a")
        two = one.join(held.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
        same = F.size(F.array_intersect("sa", "sb"))
        return scratch.table(two.where(same / (F.size("sa") + F.size("sb") - same) >= similarity).select("a", "b"), "links")

    def confirmed(both: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs not compared before, and those of them that are similar."""
        pairs = both.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()
        pairs = scratch.table(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        return pairs, similar(pairs)

    tested, links, left = near, similar(near), None
    joined = scratch.table(connected_components(links, scratch), "joined")
    before: list[DataFrame] = []
    in_bucket = F.col("a.g") == F.col("b.g")
    for turn in range(STARS + 1):
        now = members.drop("label").join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")
        # The first member met has the fewest shingles of its own, so it is the text that the others are copies of, if any is.
        order = F.struct((F.lit(0) if turn else F.col("n") - F.col("o")).alias("own"), F.xxhash64("fp", F.lit(turn)).alias("draw"), "fp")
        sizes = now.groupBy("g", "label").agg(F.count(F.lit(1)).alias("m"), F.min(order).alias("first"))
        top = F.max(F.struct("m", F.negative("first.own").alias("own"), "label", "first")).alias("top")
        # Members outside the label with most members in their bucket; a bucket of one label is done.
        mains = sizes.groupBy("g").agg(top, F.sum("m").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        now = scratch.table(now.join(mains.select("g", F.col("top.label").alias("main"), F.col("top.first.fp").alias("hub"), "all"), "g"), "labelled")
        members = now.drop("main", "hub", "all")  # labels only merge, so a bucket that is done stays done
        outside = now.where("label <> main")
        count, would = outside.agg(F.count(F.lit(1)), F.coalesce(F.sum("all"), F.lit(0))).first()
        stuck = left is not None and would > 0.8 * left
        left = would
        if turn < STARS and would > FEW * count and not stuck:
            hub = now.where("fp = hub")
            pairs, good = confirmed(outside.alias("a").join(hub.alias("b"), in_bucket).where(may), tested)
        else:
            # A pair is compared in the first band that both share, so copies that share many bands meet once.
            bands = able.select("fp", "bands")
            a, b = outside.join(bands, "fp").alias("a"), now.join(bands, "fp").alias("b")
            first = F.expr("array_position(zip_with(a.bands, b.bands, (x, y) -> x = y), true) = array_position(a.bands, a.g)")
            once = (F.col("b.label") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp"))
            pairs, good = confirmed(a.join(b, in_bucket).where(may & once & first), tested)
            turn = STARS
        tested = tested.unionByName(pairs)
        links = links.unionByName(good)
        joined = scratch.table(connected_components(links, scratch), "joined")
        if turn == STARS:
            break
        scratch.drop(*before)
        before = [now]
    scratch.drop(*before, now, full, need, held, able)
    return joined


def classify_similar(
    df: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, radius: int = RADIUS
) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of every row, and ``(fp, root, component)`` of every distinct shingle set."""
    scratch = Scratch(df.sparkSession)
    f, c = P + "fp", P + "component"
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = scratch.table(with_signature(docs, "text", f, shingle).drop("text"), "signatures")
    first = [F.first(x).alias(x) for x in ("n", "s1", "s2", "bands")]
    prints = scratch.table(marked.groupBy(f).agg(F.min("id").alias("least"), *first), "distinct")
    near = near_links(marked, f, radius, scratch)
    members = similar_links(docs, prints, near, f, similarity, shingle, scratch)
    scratch.drop(near)
    rooted = prints.join(members.withColumnRenamed("node", f), f, "left").select(f, "least", F.coalesce("root", f).alias("root"))
    least = scratch.table(rooted.groupBy("root").agg(F.min("least").alias(c)), "roots")
    return marked.select("id", f), scratch.table(rooted.join(least, "root").select(f, F.col("root").alias(P + "root"), c), "of-print")
