"""Line dedup with two Bloom filters: once-seen and twice-seen line hashes.

1. Each scan task emits 8-byte hashes of the distinct keys of its documents, a hash at most twice.
2. The task owning a hash range tests and sets a once-seen filter; hashes already there go to the
   twice-seen filter. Once-seen filters never leave their task; twice-seen ones have at most
   ``TWICE_BITS`` bits a segment, 32 MB in all, and are the only thing broadcast.
3. A second scan sends just the keys the twice-seen filter suspects (with a 128-bit digest) to
   exact counting, which also picks the document that keeps the line. Where the broadcast filter would be over
   ``FULL``, it isn't used: filters of any size stay with their segments, and digests of all keys meet them there, spread by
   id within a segment. Results never depend on the filters' size or place.
4. Confirmed keys are broadcast if they are few, which is counted first, and lines go in a third scan.
   Otherwise each document's keys are joined to it by id, which shuffles the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, Scratch, slices, text_bytes

MIN_CHARS = 20
MIN_DOCS = 3
SEGMENTS = 4096
#: At most so many bits of the twice-seen filter for each segment: 4096 * 8 KB = 32 MB.
TWICE_BITS = 1 << 16
PROBES = 4
#: Share of bits set from which the broadcast filter suspects too much; hashes a segment may have where filters stay with them,
#: and over how many tasks the keys of a segment are spread there.
FULL, SEGMENT_HASHES, SPREAD = 0.5, 1 << 22, 8
#: Bytes of text that a worker has in hand at a time, a longer single text aside.
SLICE = 4 << 20
#: So many confirmed keys at most are broadcast (about 30 MB in a worker), and texts then stay where they are.
BROADCAST_KEYS = 200_000


def line_key(line: bytes) -> bytes:
    """The key of a line: ASCII white space stripped at both ends, A-Z in lower case."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def doc_keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if long_enough(k, least)}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash within its segment; ``bits`` is a power of two."""
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    at = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([((at + np.uint64(i) * step) >> np.uint64(7)) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def segment_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(52)).astype(np.int64)


class Blooms:
    """A dense filter for each of ``rows`` segments, as one array of bits."""

    def __init__(self, rows: int, bits: int):
        self.bits, self.data = bits, np.zeros(rows * bits // 8, np.uint8)

    def _at(self, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return row * self.bits + positions(hashes, self.bits)

    def test(self, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = self._at(row, hashes)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

    def set(self, row: np.ndarray, hashes: np.ndarray) -> None:
        at = self._at(row, hashes).ravel()
        np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _power(n: float) -> int:
    return 1 << max(6, int(np.ceil(np.log2(max(1.0, n)))))


def key_hashes(narrow: DataFrame, least: int) -> DataFrame:
    """``(segment, h)``: hashes of the keys of each document, a key at most twice from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        seen: dict[int, bool] = {}
        for batch in (part for b in batches for part in slices(b, 0, SLICE)):
            out: list[int] = []
            for text in batch.column(0).to_pylist():
                for h in map(xxh3_64_intdigest, doc_keys(text, least)):
                    more = seen.get(h)
                    if more is None:
                        seen[h] = True
                        out.append(h)
                    elif more:
                        seen[h] = False
                        out.append(h)
            if len(seen) > 500_000:  # bounded; a hash then may come again, which is harmless
                seen.clear()
            hashes = np.array(out, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment_of(hashes).astype(np.int32)), pa.array(hashes.view(np.int64))], names=["segment", "h"]
            )

    return narrow.select("t").mapInArrow(run, "segment int, h long")


def segment_filters(hashes: DataFrame, tasks: int, once_bits: int, bits: int) -> DataFrame:
    """``(segment, bits)``: the twice-seen filter of each segment; the once-seen ones end with their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, int] = {}
        once, twice = [], []
        for batch in batches:
            seg, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            h, back, n = np.unique(h, return_index=True, return_counts=True)
            seg = seg[back]
            for s in np.unique(seg).tolist():
                if s not in rows:
                    rows[s] = len(once)
                    once.append(Blooms(1, once_bits))
                    twice.append(Blooms(1, bits))
                of = seg == s
                own, zero = h[of], np.zeros(int(of.sum()), np.int64)
                again = once[rows[s]].test(zero, own) | (n[of] > 1)
                once[rows[s]].set(zero, own)
                twice[rows[s]].set(zero[again], own[again])
        for s, r in rows.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([twice[r].data.tobytes()], pa.binary())], names=["segment", "bits"]
            )

    return hashes.repartition(tasks, "segment").mapInArrow(run, "segment int, bits binary")


def n_tasks(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def twice_seen(hashes: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """The twice-seen filter of all segments and its bits a segment."""
    once_bits = _power(10 * count / SEGMENTS)
    bits = min(once_bits, TWICE_BITS)
    dense = np.zeros((SEGMENTS, bits // 8), np.uint8)
    for row in segment_filters(hashes, n_tasks(hashes.sparkSession), once_bits, bits).collect():  # 32 MB at most
        dense[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return dense.ravel(), bits


def suspected_by_segment(narrow: DataFrame, hashes: DataFrame, count: int, least: int, scratch: Scratch) -> DataFrame:
    """``(id, key)`` of every key that its segment's own twice-seen filter holds; nothing is broadcast."""
    spark = narrow.sparkSession
    digits = max(12, int(np.ceil(np.log2(max(1.0, count / SEGMENT_HASHES)))))
    once_bits = _power(10 * count / (1 << digits))
    segment = lambda: F.shiftrightunsigned("h", 64 - digits).cast("int").alias("segment")
    # A task holds the filters of its segments: as many tasks as keep that at about 64 MB.
    tasks = max(n_tasks(spark), (1 << digits) * once_bits // 4 // (64 << 20))
    filters = scratch.table(segment_filters(hashes.select(segment(), "h"), tasks, once_bits, once_bits), "filters")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        from xxhash import xxh3_64_intdigest

        for batch in (part for b in batches for part in slices(b, 0, SLICE)):
            owner: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = doc_keys(text, least)
                keys += own
                owner += [i] * len(own)
            h = np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys)).view(np.int64)
            digests = [blake2b(k, digest_size=16).digest() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(1).take(pa.array(owner, pa.int64())), pa.array(digests, pa.binary())], names=["h", "id", "key"])

    kind = narrow.schema["id"]
    keys = narrow.mapInArrow(keys_of, T.StructType([T.StructField("h", T.LongType()), kind, T.StructField("key", T.BinaryType())]))
    spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("spread")
    one = keys.select(segment(), spread, F.lit(None).cast("binary").alias("bits"), "h", "id", "key")
    two = filters.select("segment", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"), "bits", F.lit(0).cast("long").alias("h"), F.lit(None).cast(kind.dataType).alias("id"), F.lit(None).cast("binary").alias("key"))
    met = two.unionByName(one).repartition(tasks, "segment", "spread").sortWithinPartitions("segment", "spread", F.col("bits").isNull())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = Blooms(0, once_bits)
        for batch in batches:
            bits, h = batch.column(2), batch.column(3).to_numpy().view(np.uint64)
            leads = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))  # each filter comes before its segment's keys
            hit = []
            for begin, end in zip([0, *(leads + 1).tolist()], [*leads.tolist(), len(h)]):
                if begin and bits[begin - 1].is_valid:
                    filt.data = np.frombuffer(bits[begin - 1].as_py(), np.uint8)
                if end > begin:
                    hit.append(begin + np.flatnonzero(filt.test(np.zeros(end - begin, np.int64), h[begin:end])))
            at = pa.array(np.concatenate(hit) if hit else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(4).take(at), batch.column(5).take(at)], names=["id", "key"])

    return met.mapInArrow(test, T.StructType([kind, T.StructField("key", T.BinaryType())]))


def suspected(narrow: DataFrame, dense, bits: int, least: int) -> DataFrame:
    """``(id, key)`` with a 128-bit digest for every key the twice-seen filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        from xxhash import xxh3_64_intdigest

        filt = Blooms(0, bits)
        filt.data = dense.value
        for batch in (part for b in batches for part in slices(b, 0, SLICE)):
            owner: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = doc_keys(text, least)
                keys += own
                owner += [i] * len(own)
            h = np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))
            hit = np.flatnonzero(filt.test(segment_of(h), h)) if len(h) else np.zeros(0, np.int64)
            digests = [blake2b(keys[i], digest_size=16).digest() for i in hit.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(np.array(owner, np.int64)[hit])), pa.array(digests, pa.binary())], names=["id", "key"]
            )

    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("key", T.BinaryType())]))


def repeated_keys(
    df: DataFrame, id_col: str, text_col: str, least: int, min_docs: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """``(id, key)`` of suspected keys, and ``(key, last)`` of those that are repeated."""
    spark = df.sparkSession
    narrow = df.select(text_bytes(text_col).alias("t"), F.col(f"`{id_col}`").alias("id"))
    hashes = scratch.table(key_hashes(narrow, least), "hashes")
    count = hashes.count()
    dense, bits = twice_seen(hashes, count)
    if np.bitwise_count(dense).sum(dtype=np.int64) <= FULL * 8 * dense.size:
        suspects = suspected(narrow, spark.sparkContext.broadcast(dense), bits, least)
    else:
        suspects = suspected_by_segment(narrow, hashes, count, least, scratch)
    found = scratch.table(suspects.distinct(), "suspects")
    scratch.drop(hashes)
    repeated = scratch.table(
        found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).drop("n"),
        "repeated",
    )
    return found, repeated


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """All rows and columns, the text without its repeated lines, and both counts appended.

    A key of at least ``min_chars`` code points held by at least ``min_docs`` documents stays in
    the document with the largest id only (there: every line of it). Null and empty texts are one
    empty line and come back empty. Rows repeating an id are one document for the count; rows with
    a null id are together one document that is never the largest. Empty tables give no rows. A column of
    ``df`` named as one of the two counts gives way to it; the names are parameters, so that it can stay.
    """
    df = df.drop(*{n_lines, n_dropped} & set(df.columns))
    spark = df.sparkSession
    scratch = Scratch(spark)
    found, repeated = repeated_keys(df, id_col, text_col, min_chars, min_docs, scratch)
    names, at, iat, kat = df.columns, df.columns.index(text_col), df.columns.index(id_col), len(df.columns)
    shared, rows = None, df
    if repeated.count() <= BROADCAST_KEYS:
        few = repeated.toArrow()
        shared = spark.sparkContext.broadcast(dict(zip(few["key"].to_pylist(), few["last"].to_pylist())))
    else:
        gone = found.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id").agg(F.collect_list("key").alias("keys"))
        gone = gone.select(F.col("id").alias(P + "id"), F.col("keys").alias(P + "keys"))
        rows = df.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(P + "id")), "left").drop(P + "id")
    fields = [*df.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())]
    schema = T.StructType([T.StructField(text_col, T.StringType()) if i == at else f for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        last = shared.value if shared else {}
        for batch in (part for b in batches for part in slices(b, at, SLICE)):
            texts, counts, drops = [], [], []
            own = batch.column(iat).to_pylist() if shared else batch.column(kat).to_pylist()
            for text, mine in zip(batch.column(at).to_pylist(), own):
                lines = (text or "").split("\n")
                kept = lines
                gone_here = last if shared else set(mine or ())
                if gone_here:
                    kept = []
                    for line in lines:
                        key = line_key(line.encode())
                        if long_enough(key, min_chars):
                            digest = blake2b(key, digest_size=16).digest()
                            if digest in gone_here and not (shared and last[digest] == mine):
                                continue
                        kept.append(line)
                texts.append("\n".join(kept) if len(kept) < len(lines) else text or "")
                counts.append(len(lines))
                drops.append(len(lines) - len(kept))
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(kat)]
            cols += [pa.array(counts, pa.int64()), pa.array(drops, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, n_lines, n_dropped])

    return rows.mapInArrow(run, schema)
