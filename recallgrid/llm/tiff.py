"""TIFF pages as rows: image directories are walked, strips or tiles decoded, predictors undone.

Reads classic and big TIFF in either byte order; no compression, PackBits, LZW and deflate; 1, 8, 16,
32 and 64 bit samples (32 and 64 bit floats too), chunky or planar; horizontal and floating-point
prediction. Every tag is validated before memory is taken for it, so a damaged or hostile file costs
its own row an error and nothing else. The writer makes what the tests and the text payloads need:
chunky pages in strips or tiles with any of those codings.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 262, 273, 277
ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 278, 279, 284, 317, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
#: Bytes of the field types.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
INT_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Default bound on the decoded bytes of a page, and of a strip or tile: a parameter of ``tiff_pages``.
MAX_PAGE = 1 << 30
#: No coding here makes more bytes than this of one stored byte (LZW, which comes closest, under 2,731).
MOST_OF_A_BYTE = 4096


class TiffError(ValueError):
    pass


def unpack_packbits(data: bytes, size: int) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits, widened one code early."""
    out = bytearray()
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, None
    hold = bits = 0
    for byte in data:
        hold = (hold << 8) | byte
        bits += 8
        while bits >= width:
            code = (hold >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            hold &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = list(base), 9, None
                continue
            if code < len(table):
                entry = table[code]
            elif last is not None and code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            out += entry
            if last is not None:
                table.append(last + entry[:1])
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
            if len(out) >= size:
                return bytes(out)
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out = bytearray()
    hold = bits = 0
    table: dict[bytes, int] = {}
    width, nxt = 9, 258

    def put(code: int) -> None:
        nonlocal hold, bits
        hold = (hold << width) | code
        bits += width
        while bits >= 8:
            out.append((hold >> (bits - 8)) & 255)
            bits -= 8
            hold &= (1 << bits) - 1

    def code_of(s: bytes) -> int:
        return s[0] if len(s) == 1 else table[s]

    put(256)
    cur = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if not cur or cur + c in table:
            cur += c
            continue
        put(code_of(cur))
        table[cur + c] = nxt
        nxt += 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
        if nxt >= 4094:
            put(256)
            table, width, nxt = {}, 9, 258
        cur = c
    if cur:
        put(code_of(cur))
        nxt += 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((hold << (8 - bits)) & 255)
    return bytes(out)


def decode_block(data: bytes, coding: int, size: int) -> bytes:
    if coding == NONE:
        return data
    if coding == PACKBITS:
        return unpack_packbits(data, size)
    if coding == LZW:
        return unpack_lzw(data, size)
    if coding in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise TiffError(f"compression {coding} isn't supported")


def encode_block(data: bytes, coding: int) -> bytes:
    return {NONE: lambda: data, PACKBITS: lambda: pack_packbits(data), LZW: lambda: pack_lzw(data), DEFLATE: lambda: zlib.compress(data, 6)}[coding]()


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and integer tags of each image directory, in file order; loops end the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        head, count, entry, inline, at = "I", "H", "HHI", 4, struct.unpack_from(order + "I", data, 4)[0]
    elif magic == 43 and len(data) >= 16:
        head, count, entry, inline, at = "Q", "Q", "HHQ", 8, struct.unpack_from(order + "Q", data, 8)[0]
    else:
        raise TiffError("not a TIFF file")
    seen = set()
    try:
        while at and at not in seen:
            seen.add(at)
            n = struct.unpack_from(order + count, data, at)[0]
            at += struct.calcsize(order + count)
            step = struct.calcsize(order + entry)
            tags = {}
            for _ in range(n):
                tag, kind, values = struct.unpack_from(order + entry, data, at)
                where = at + step
                size = TYPE_SIZE.get(kind, 0) * values
                if size > inline:
                    where = struct.unpack_from(order + head, data, where)[0]
                if kind in INT_CODE and 0 <= where and where + size <= len(data):
                    tags[tag] = list(struct.unpack_from(f"{order}{values}{INT_CODE[kind]}", data, where))
                at += step + inline
            yield order, tags
            at = struct.unpack_from(order + head, data, at)[0]
    except (struct.error, OverflowError) as e:  # an offset beyond the file, or beyond what an offset can be
        raise TiffError(f"cut short: {e}") from e


def page_pixels(data: bytes, order: str, tags: dict[int, list[int]], max_page: int = MAX_PAGE) -> np.ndarray:
    """Samples of a page as ``[height, width, samples]``, in the machine's byte order; 1-bit samples as bytes 0 and 1."""

    def one(tag: int, default: int | None = None) -> int | None:
        value = tags[tag][0] if tags.get(tag) else default
        if value is not None and not 0 <= value < 1 << 32:
            raise TiffError(f"tag {tag} is out of range")
        return value

    w, h, samples, coding = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE)
    if not w or not h:
        raise TiffError("a page without a size")
    bits, form = one(BITS, 1), one(SAMPLE_FORMAT, 1)
    if bits not in (1, 8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, [])):
        raise TiffError(f"{bits} bits a sample aren't supported")
    if form not in (1, 2, 3, 4) or form == 3 and bits < 32 or any(f != form for f in tags.get(SAMPLE_FORMAT, [])):
        raise TiffError(f"sample format {form} of {bits} bits isn't supported")
    if not samples or samples > 1 << 16 or one(FILL_ORDER, 1) != 1:
        raise TiffError("samples or bit order aren't supported")
    kind = np.dtype(f"{order}{'f' if form == 3 else 'i' if form == 2 else 'u'}{max(1, bits // 8)}")
    planar, predictor = one(PLANAR, 1), one(PREDICTOR, 1)
    if planar not in (1, 2) or predictor not in (1, 2, 3) or predictor == 3 and form != 3 or predictor == 2 and (form == 3 or bits == 1):
        raise TiffError(f"planes {planar}, predictor {predictor} aren't supported for these samples")
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
    elif STRIP_OFFSETS in tags:
        bw, bh, offsets, counts = w, min(one(ROWS_PER_STRIP, h), h), tags[STRIP_OFFSETS], tags.get(STRIP_COUNTS, [])
    else:
        raise TiffError("a page without strips or tiles")
    if not bw or not bh:
        raise TiffError("blocks without a size")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    row_bytes = -(-bw * deep * bits // 8)
    if w * h * samples * kind.itemsize > max_page or row_bytes * bh > max_page:
        raise TiffError("a page, strip or tile over the size limit")
    across, down = -(-w // bw), -(-h // bh)
    blocks = across * down * planes
    if len(offsets) < blocks or len(counts) < blocks:
        raise TiffError("too few strips or tiles")
    places = list(zip(offsets[:blocks], counts[:blocks]))
    if any(at < 0 or n < 0 or at + n > len(data) for at, n in places):
        raise TiffError("a strip or tile outside the file")
    if -(-w * samples * bits // 8) * h > MOST_OF_A_BYTE * sum(n for _, n in places):
        raise TiffError("strips or tiles too short for the page")
    out = np.zeros((h, w, samples), kind.newbyteorder("="))
    for n, (at, stored) in enumerate(places):
        plane, rest = divmod(n, across * down)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, h - y)
        size = rows * row_bytes
        raw = decode_block(data[at : at + stored], coding, size)
        if len(raw) < size:
            raise TiffError("a strip or tile is cut short")
        part = block_samples(raw[:size], kind, bits, rows, bw, deep, predictor)[: h - y, : w - x]
        to = slice(plane, plane + 1) if planar == 2 else slice(None)
        out[y : y + part.shape[0], x : x + part.shape[1], to] = part
    return out


def block_samples(raw: bytes, kind: np.dtype, bits: int, rows: int, width: int, deep: int, predictor: int) -> np.ndarray:
    """Samples of a decoded strip or tile, its prediction undone."""
    if bits == 1:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : width * deep].reshape(rows, width, deep)
    if predictor == 3:  # bytes of a row by significance, each the sum of those ``deep`` before it
        size = kind.itemsize
        flat = np.frombuffer(raw, np.uint8).reshape(rows, width * size, deep)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, width * deep)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").astype(f"f{size}").reshape(rows, width, deep)
    block = np.frombuffer(raw, kind).reshape(rows, width, deep).astype(kind.newbyteorder("="))
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def pages(data: bytes) -> Iterator[np.ndarray]:
    for order, tags in directories(data):
        yield page_pixels(data, order, tags)


def write_tiff(
    images: list[np.ndarray], coding: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024,
    tile: tuple[int, int] | None = None, order: str = "<",
) -> bytes:
    """A classic TIFF of ``[height, width]`` or ``[height, width, samples]`` pages of whole numbers or floats."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        h, w, samples = image.shape
        bits = image.dtype.itemsize * 8
        bh, bw = (tile[0], tile[1]) if tile else (min(rows_per_strip, h), w)
        offsets, counts = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = image[y : y + bh, x : x + bw]
                if tile and block.shape[:2] != tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), block.dtype))
                if predictor == 3:
                    size = image.dtype.itemsize
                    planes = np.ascontiguousarray(block.astype(f">f{size}")).view(np.uint8).reshape(len(block), -1, size).transpose(0, 2, 1)
                    flat = planes.reshape(len(block), -1, samples)
                    raw = np.diff(flat, axis=1, prepend=np.zeros((len(block), 1, samples), np.uint8)).tobytes()
                else:
                    raw = block.astype(image.dtype.newbyteorder(order)).tobytes()
                raw = encode_block(raw, coding)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        tags = [(WIDTH, [w], 4), (HEIGHT, [h], 4), (BITS, [bits] * samples, 3), (COMPRESSION, [coding], 3), (PHOTOMETRIC, [2 if samples >= 3 else 1], 3), (SAMPLES, [samples], 3), (PLANAR, [1], 3), (PREDICTOR, [predictor], 3)]
        if image.dtype.kind != "u":
            tags.append((SAMPLE_FORMAT, [{"i": 2, "f": 3}[image.dtype.kind]] * samples, 3))
        if tile:
            tags += [(TILE_WIDTH, [bw], 4), (TILE_HEIGHT, [bh], 4), (TILE_OFFSETS, offsets, 4), (TILE_COUNTS, counts, 4)]
        else:
            tags += [(STRIP_OFFSETS, offsets, 4), (ROWS_PER_STRIP, [bh], 4), (STRIP_COUNTS, counts, 4)]
        entries = bytearray()
        for tag, values, kind in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{INT_CODE[kind]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                where = struct.pack(order + "I", len(out))
                out += body
            else:
                where = body.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + where
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "samples", "bits", "compression", "predictor")]
    + [T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())]
)


def tiff_pages(df: DataFrame, id_col: str, media_col: str, max_page: int = MAX_PAGE) -> DataFrame:
    """One row per page: ``(id, page, width, height, samples, bits, compression, predictor, pixels, error)``.

    ``pixels`` are the samples row by row, little-endian (1-bit samples as bytes). A page that can't be
    decoded, one of more than ``max_page`` bytes among them, keeps its row with ``error`` set and null
    pixels; a null, empty or foreign file is one row with page null. Numbers in a row beyond 31 bits are
    null there. Pages come out as they are decoded, so memory holds one file and one page. Repeated rows
    and null ids are decoded like any other, other columns are ignored, an empty table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *PAGE_SCHEMA.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                for i, data in enumerate(part.column(1).to_pylist()):
                    n = None
                    try:
                        for n, (order, tags) in enumerate(directories(data or b"")):
                            one = lambda tag, default, tags=tags: tags[tag][0] if tags.get(tag) else default
                            head = [n, *map(small, [one(WIDTH, None), one(HEIGHT, None), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)])]
                            try:
                                px = page_pixels(data, order, tags, max_page)
                                tail = [px.astype(px.dtype.newbyteorder("<")).tobytes(), None]
                            except (TiffError, zlib.error, MemoryError) as e:
                                tail = [None, str(e)]
                            yield row(part.column(0).slice(i, 1), head + tail)
                        if n is None:
                            raise TiffError("no image directory")
                    except TiffError as e:
                        yield row(part.column(0).slice(i, 1), [None if n is None else n + 1, *[None] * 7, str(e)])

    def small(value: int | None) -> int | None:
        return value if value is not None and -(1 << 31) <= value < 1 << 31 else None

    def row(own: pa.Array, values: list) -> pa.RecordBatch:
        kinds = [*[pa.int32()] * 7, pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([own, *(pa.array([v], k) for v, k in zip(values, kinds))], names=names)

    return df.select(f"`{id_col}`", f"`{media_col}`").mapInArrow(run, schema)


#: Payload images: so many samples a row and rows a page.
ROW = 64
PAGE_ROWS = 1024


def payload_tiff(text: bytes, coding: int = DEFLATE) -> bytes:
    """A text's bytes, zero-padded to a positive multiple of 64, as 8-bit pages of 64 columns."""
    size = max(ROW, -(-len(text) // ROW) * ROW)
    image = np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, ROW)
    return write_tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], coding)


def average_hash(image: np.ndarray) -> int:
    """64 bits, one for each cell of an 8 x 8 grid: whether its mean is above the mean of all."""
    h, w = image.shape
    rows = np.linspace(0, h, 9).astype(int)
    cols = np.linspace(0, w, 9).astype(int)
    sums = np.concatenate([[np.zeros(w)], np.cumsum(image, axis=0, dtype=np.float64)])
    cells = np.array([sums[max(b, a + 1)] - sums[a] if a < h else sums[h] - sums[h - 1] for a, b in zip(rows[:-1], rows[1:])])
    heights = np.array([max(b, a + 1) - a if a < h else 1 for a, b in zip(rows[:-1], rows[1:])])
    means = np.add.reduceat(cells, cols[:-1], axis=1) / (heights[:, None] * np.diff(cols)[None, :])
    return int("".join("01"[int(x)] for x in (means > image.mean()).ravel()), 2)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts through TIFF and back: sizes and digests of what the pages hold, and a feature.

    Null is the empty text, 64 zero bytes. The feature names pages and rows, the mean sample and the
    average hash of all pages as one image. Rows are handled alone, so repeats give equal rows, null ids
    are kept, other columns are ignored and an empty table gives no rows.
    """
    import hashlib

    fields = [T.StructField(id_col, df.schema[id_col].dataType)]
    for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())):
        fields.append(T.StructField(n, t))
    names = [f.name for f in fields]

    def one(text: bytes) -> tuple:
        media = payload_tiff(text)
        found = [p[:, :, 0] for p in pages(media)]
        image = np.concatenate(found)
        payload = image.tobytes()
        feature = f"{len(found)}p{len(image)}r:{image.mean():.4f}:{average_hash(image):016x}"
        return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                got = list(zip(*(one(t.encode()) for t in part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(got, kinds))], names=names)

    return df.select(f"`{id_col}`", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__rg_text")).mapInArrow(run, T.StructType(fields))
