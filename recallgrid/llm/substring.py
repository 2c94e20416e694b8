"""Substring dedup by content-defined chunking with a gear rolling hash.

A cut falls where the gear hash of the last 16 bytes has its mask bits zero, so cuts depend on what
is near them only: text inserted or removed elsewhere moves no other cut, and a passage shared by
two documents has the same chunks but for its edges. Chunks are deduplicated by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, Scratch, slices, text_bytes

#: Least and most bytes of a chunk, and the mask that makes a cut likely once in 16 bytes beyond the least: short, so that
#: chunks of a passage meet again soon after its edges.
LEAST, MOST, MASK = 16, 64, 0xF000
#: The gear table: 256 fixed pseudo-random 16-bit numbers.
GEAR = np.random.RandomState(20240229).randint(0, 1 << 16, 256).astype(np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: sum of gear[b] << age over the last 16 bytes, mod 2 ** 16."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint16(shift)
    return h


def cuts(text: bytes, least: int = LEAST, most: int = MOST, mask: int = MASK) -> list[int]:
    """Ends of the chunks of a text.

    Where no cut comes within ``most`` bytes, as in one word said over and over, the cut falls on the
    least hash there: that too depends on content, not on where the text began. A tail shorter than
    ``least`` belongs to the chunk before it; a text that short is one chunk.
    """
    n = len(text)
    if not n:
        return []
    h = gear_hash(np.frombuffer(text, np.uint8))
    marks = (np.flatnonzero((h & np.uint16(mask)) == 0) + 1).tolist()
    ends, last = [], 0

    def forced(last: int) -> int:
        span = h[last + least - 1 : last + most]
        return last + least + len(span) - 1 - int(np.argmin(span[::-1]))

    for m in marks:
        if m - last < least:
            continue
        while m - last > most:
            last = forced(last)
            ends.append(last)
        if m - last >= least:
            ends.append(m)
            last = m
    while n - last > most:
        last = forced(last)
        ends.append(last)
    if ends and n - last < least:
        ends[-1] = n
    elif last < n:
        ends.append(n)
    return ends


def chunk_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, d1, d2, starts, length)`` for each distinct chunk of each row: all its places, ascending."""
    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("length", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                owner, digests, starts, length = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    seen: dict[bytes, tuple[int, list[int]]] = {}
                    at = 0
                    for end in cuts(text):
                        d = xxh3_128_digest(text[at:end])
                        if d in seen:
                            seen[d][1].append(at)
                        else:
                            seen[d] = (end - at, [at])
                        at = end
                    owner += [i] * len(seen)
                    digests += seen
                    for a, b in seen.values():
                        length.append(a)
                        starts.append(b)
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64())), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(length, pa.int32())], names=schema.names,
                )

    return df.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("t")).mapInArrow(run, schema)


def repeated_chunks(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``(id, starts, length, shared, first_id, first)``: the chunks that occur more than once.

    ``shared``: some other row holds it; ``first_id``: the least id holding it; ``first``: ``starts`` begins
    with its first occurrence (least id, start).
    Occurrences of a digest are pre-aggregated in each scan task before they meet.
    """
    chunks = chunk_rows(df, id_col, text_col)  # cut twice from the texts: written, they would be most of the disk
    lead = F.element_at("starts", 1)
    owner = F.struct(F.col("id").isNull().alias("nul"), "id", lead.alias("start"))
    groups = chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("starts")).alias("all"), F.min(owner).alias("o"))
    groups = scratch.table(
        groups.where("all > 1").select("d1", "d2", (F.col("rows") > 1).alias("shared"), F.col("o.id").alias("first_id"), F.col("o.start").alias("first_start")),
        "repeated",
    )
    return chunks.join(groups, ["d1", "d2"]).select(
        "id", "starts", "length", "shared", "first_id", (F.col("id").eqNullSafe(F.col("first_id")) & (lead == F.col("first_start"))).alias("first")
    )


#: Bytes of adjoining repeated chunks that make a passage: what is left of about 50 words when the chunks
#: at either edge are lost (usually one or two, of 30 bytes on average).
PASSAGE = 96


def passages(found: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """``(id, kind, start, length, chunks, firsts)``: runs of adjoining chunks, of ``least`` bytes or of the whole text.

    ``kind`` 0: chunks that other rows hold too, 1: chunks that dedup may drop, as they have occurred
    before. Chunks don't overlap, so one sort by place and a running count of the breaks number the runs.
    """
    place = F.explode(F.transform("starts", lambda s, i: F.struct(s.cast("long").alias("start"), (~F.col("first") | (i > 0)).alias("gone"))))
    flat = found.select("id", "length", "shared", "first_id", place.alias("p")).select("id", "length", "shared", "first_id", "p.start", "p.gone")
    end = F.col("start") + F.col("length")
    w = Window.partitionBy("id").orderBy("start")
    before = F.lag(F.struct(end.alias("end"), "shared", "gone")).over(w)
    flat = flat.withColumn("before", before)
    for kind, flag in enumerate(("shared", "gone")):
        goes_on = F.coalesce(F.col("before.end") == F.col("start"), F.lit(False)) & F.coalesce(F.col(f"before.{flag}"), F.lit(False))
        flat = flat.withColumn(f"run{kind}", F.sum(F.when(F.col(flag) & ~goes_on, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = F.array_compact(F.array(*(F.when(F.col(flag), F.struct(F.lit(k).alias("kind"), F.col(f"run{k}").alias("run"))) for k, flag in enumerate(("shared", "gone")))))
    runs = flat.select("id", "start", "length", "first_id", F.explode(of).alias("r")).groupBy("id", "r.kind", "r.run")
    runs = runs.agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("chunks"), F.collect_set("first_id").alias("firsts"))
    runs = runs.where((F.col("length") >= least) | (F.col("start") == 0))
    runs = runs.join(sizes, runs["id"].eqNullSafe(sizes["own"]))
    return runs.where((F.col("length") >= least) | (F.col("length") == F.col("size"))).select("id", "kind", "start", "length", "chunks", "firsts")


def substring_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """One row per id: bytes, the repeated passages and what dedup drops of them.

    A passage is a run of adjoining chunks that other documents hold too, of ``passage`` bytes at least
    or a whole text: shorter runs are common phrases and count nowhere. ``spans`` are the passages as
    (start, length) byte ranges, ``n_passages`` and ``longest_passage`` their number and longest,
    ``n_shared`` the chunks in them and ``shared_bytes`` their bytes (first holders included),
    ``repeats`` whether there is any, ``first_doc_ids`` the least ids holding their chunks (a document that
    holds one first names itself). ``dropped_spans`` are the runs of that length that have all occurred
    before (in a lesser id, or earlier in the same text), ``n_dropped``/``dropped_bytes`` their chunks and bytes.
    Null and empty texts have none. Rows repeating an id are read as one document (with equal texts:
    nothing is shared between them, but their chunks count once more); so are rows without an id. Other columns
    are ignored; empty tables give no rows.
    """
    scratch = Scratch(df.sparkSession)
    found = repeated_chunks(df, id_col, text_col, scratch)
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long")
    sizes = scratch.table(df.select(F.col(f"`{id_col}`").alias("own"), size.alias("size")).groupBy("own").agg(F.max("size").alias("size")), "sizes")
    runs = passages(found, sizes, passage)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    span = F.struct("start", "length")
    per = runs.groupBy(F.col("id").alias(P + "id")).agg(
        *(F.array_sort(F.collect_list(of(k, span))).alias(c) for k, c in enumerate(("spans", "dropped_spans"))),
        *(F.coalesce(F.sum(of(k, F.col("chunks"))), F.lit(0)).alias(c) for k, c in enumerate(("n_shared", "n_dropped"))),
        *(F.coalesce(F.sum(of(k, F.col("length"))), F.lit(0)).alias(c) for k, c in enumerate(("shared_bytes", "dropped_bytes"))),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(of(0, F.col("firsts")))))).alias("firsts"),
    )
    out = sizes.join(per, F.col("own").eqNullSafe(F.col(P + "id")), "left")
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    longest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["length"])), F.lit(0)).cast("long")
    return out.select(
        F.col("own").alias(id_col), F.col("size").alias("n_bytes"), zero("n_shared"), zero("shared_bytes"), zero("n_dropped"), zero("dropped_bytes"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("firsts", F.array().cast(T.ArrayType(df.schema[id_col].dataType))).alias("first_doc_ids"),
        F.coalesce("dropped_spans", none).alias("dropped_spans"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_passages"),
        longest.alias("longest_passage"), (longest > 0).alias("repeats"),
    )
