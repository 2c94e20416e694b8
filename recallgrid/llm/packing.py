"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows, each a sequence of its own, and a rest. The rests of a
task are gathered into blocks of about ``BLOCK`` windows. In a block every piece starts as a partial
partition (its length and zeros); the two partial partitions with the largest spread are merged,
largest sums against smallest, until one is left, whose sums are near equal. If the largest exceeds
the window, the block is done again with one window more; what then still lies over the edge is cut
off, since documents may be cut freely and more windows would be padding.

A block lies within one input partition, so ids and pieces are never shuffled; a rest longer than
``PIECE`` is cut into near-equal parts, since a handful of large pieces cannot be balanced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .tokens import default_vocabulary, fast_encoder

WINDOW = 1024
PIECE = 512
BLOCK = 128
#: Windows beyond the fewest possible that a block may take before pieces are cut to fit.
SPARE = 1
END = 0


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k - 1) of each piece, by multiway Karmarkar-Karp."""
    n = len(sizes)
    heap: list[tuple[int, int]] = []
    sums: dict[int, np.ndarray] = {}
    for i, w in enumerate(sizes):
        sums[i] = np.zeros(k, np.int64)
        sums[i][0] = w
        heap.append((-w, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        merges.append((a, b, order))
        sums[n + len(merges) - 1] = both
        heapq.heappush(heap, (-int(both[0]), n + len(merges) - 1))
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)} if heap else {}
    for m in range(len(merges) - 1, -1, -1):
        a, b, order = merges[m]
        own = place.pop(n + m)
        place[a], place[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        place[a][order] = own
        place[b][k - 1 - order] = own
    return np.array([place[i][0] for i in range(n)], np.int64)


def pack_block(sizes: list[int], window: int = WINDOW, spare: int = SPARE) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Windows of pieces no longer than ``window``, each a list of ``(piece, from, length)``.

    The number of windows rises, up to ``spare`` beyond the fewest possible, while the largest sum
    exceeds the window. What then still lies over is cut off the window's last pieces and put where
    there is room; should room be short, the number rises again.
    """
    least = max(1, -(-sum(sizes) // window))
    for k in range(least, least + spare + 1):
        at = differencing(sizes, k)
        if np.bincount(at, weights=sizes, minlength=k).max() <= window:
            break
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    fill = [0] * k
    over = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        w = int(at[i])
        fits = min(sizes[i], window - fill[w])
        if fits:
            out[w].append((i, 0, fits))
            fill[w] += fits
        if fits < sizes[i]:
            over.append((i, fits, sizes[i] - fits))
    room = iter(sorted(range(k), key=lambda w: fill[w]))
    w = None
    for i, start, length in over:
        while length:
            while w is None or fill[w] == window:
                w = next(room, None)
                if w is None:
                    w = len(out)
                    out.append([])
                    fill.append(0)
            cut = min(length, window - fill[w])
            out[w].append((i, start, cut))
            fill[w] += cut
            start, length = start + cut, length - cut
    return out, len(out)


def rest_cuts(rest: int, piece: int) -> list[int]:
    parts = -(-rest // piece)
    return [rest // parts + (i < rest % parts) for i in range(parts)]


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    piece: int = PIECE,
    block: int = BLOCK,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    Every document, the empty and null ones too, ends with id 0, so it has a piece at least. A
    sequence's pieces lie without gaps from offset 0 and hold at most ``window`` ids; sequence ids
    are the input partition's number times 2 ** 32 plus a running number. Rows with a repeated or
    null id are packed as documents of their own. Empty tables give no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    fields = [T.StructField(id_col, df.schema[id_col].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(vocabulary)
        ctx = TaskContext.get()
        base = (ctx.partitionId() if ctx else 0) << 32
        used = 0
        rests: list[tuple] = []
        waiting = 0

        def piece_row(who, start: int, raw: bytes, n: int, sequence: int, offset: int) -> tuple:
            ids = [np.frombuffer(raw, "<u4").tolist()] if with_ids else []
            return (who, start, len(raw) // 4, crc32(raw), n, sequence, offset, *ids)

        def rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [()] * len(names)
            types = [kind, *[pa.int64()] * 6, pa.list_(pa.int32())][: len(names)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def close() -> list[tuple]:
            nonlocal used, rests, waiting
            windows, k = pack_block([len(r[2]) // 4 for r in rests], window)
            out = []
            for w, pieces in enumerate(windows):
                fill = 0
                for i, begin, length in pieces:
                    who, start, raw, n = rests[i]
                    out.append(piece_row(who, start + begin, raw[4 * begin : 4 * (begin + length)], n, base + used + w, fill))
                    fill += length
            used, rests, waiting = used + k, [], 0
            return out

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch, 1, 4 << 20):
                out = []
                for who, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text), END], "<u4")
                    n = len(ids)
                    raw = ids.tobytes()
                    for start in range(0, n - n % window, window):
                        out.append(piece_row(who, start, raw[4 * start : 4 * (start + window)], n, base + used, 0))
                        used += 1
                    start = n - n % window
                    for length in rest_cuts(n % window, piece):
                        rests.append((who, start, raw[4 * start : 4 * (start + length)], n))
                        start += length
                        waiting += length
                    if waiting >= block * window:
                        out += close()
                yield rows(out, kind)
        if rests:
            yield rows(close(), kind)

    narrow = df.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__rg_text"))
    return narrow.mapInArrow(run, T.StructType(fields))
