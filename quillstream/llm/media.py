"""TIFF columns: write payloads as TIFF, and read TIFF bytes back as one row per page.

The reader walks the chain of image directories in either byte order, decodes stored, PackBits, LZW and deflate strips
or tiles, undoes horizontal differencing for samples of 8, 16 and 32 bits, joins separate planes, and emits each page's samples row by row. Bits
within a byte are read most significant first.

Nulls and damage: null bytes and bytes that are no TIFF, or a page that can't be decoded, give a row with ``error`` and no
pixels (pages before it are kept); a directory chain that turns back on itself ends there with an error row. A null text is an empty payload. Repeated
rows stay repeated, ties need no order. An empty table gives an empty table. Columns of the input that the output names again are not kept; the
others pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: TIFF field types: struct code and size.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 16: ("Q", 8)}
#: Tags: the fields that matter here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325


def pack_bits(data: bytes) -> bytes:
    out, k, n = bytearray(), 0, len(data)
    while k < n:
        run = 1
        while run < 128 and k + run < n and data[k + run] == data[k]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[k]))
            k += run
            continue
        start = k
        while k < n and k - start < 128 and not (k + 1 < n and data[k + 1] == data[k]):
            k += 1
        out.append(k - start - 1)
        out += data[start:k]
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, k = [], 0
    while k < len(data):
        head = data[k]
        if head < 128:
            out.append(data[k + 1 : k + 2 + head])
            k += head + 2
        elif head > 128:
            out.append(data[k + 1 : k + 2] * (257 - head))
            k += 2
        else:
            k += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, that widen one code early."""
    bits, filled, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, filled
        bits, filled = bits << width | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(bits >> filled & 255)
        bits &= (1 << filled) - 1

    table = {bytes((k,)): k for k in range(256)}
    following, width, known = 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        longer = known + data[k : k + 1]
        if longer in table:
            known = longer
            continue
        put(table[known], width)
        table[longer] = following
        following += 1
        known = data[k : k + 1]
        if following == 4094:
            put(256, 12)
            table = {bytes((j,)): j for j in range(256)}
            following, width = 258, 9
        elif following >= 1 << width:
            width += 1
    if known:
        put(table[known], width)
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if filled:
        put(0, 8 - filled)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    singles = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, width, last = list(singles), [], 9, b""
    bits, filled, k = 0, 0, 0
    while True:
        while filled < width:
            if k == len(data):
                return b"".join(out)
            bits, filled, k = bits << 8 | data[k], filled + 8, k + 1
        filled -= width
        code, bits = bits >> filled, bits & (1 << filled) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = list(singles), 9, b""
            continue
        if not last:
            if code > 255:
                raise ValueError("LZW: a stream begins with an unknown code")
            last = table[code]
            out.append(last)
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table):
            now = last + last[:1]
        else:
            raise ValueError("LZW: code beyond the table")
        out.append(now)
        table.append(last + now[:1])
        last = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1


def encode(data: bytes, compression: int, level: int = 1) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, level)
    raise ValueError(f"compression {compression} is unknown")


def decode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression} is unknown")


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


def _differences(rows: np.ndarray) -> np.ndarray:
    """Along the row axis (rows, columns, samples), modulo the sample's range."""
    out = rows.copy()
    out[:, 1:] = rows[:, 1:] - rows[:, :-1]
    return out


def write_tiff(pages: list[Page], order: str = "<", rows_per_strip: int = 64, tile: tuple[int, int] | None = None, planar: int = 1) -> bytes:
    """A TIFF with these pages. tile: width and height of tiles in place of strips. Samples of 8, 16 or 32 bits."""
    body = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        kind = np.dtype(f"{order}u{page.bits // 8}")
        image = np.frombuffer(page.pixels, kind).reshape(page.height, page.width, page.samples)
        planes = [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(page.samples)]
        blocks: list[np.ndarray] = []
        for plane in planes:
            if tile:
                high, wide = -(-page.height // tile[1]) * tile[1], -(-page.width // tile[0]) * tile[0]
                full = np.zeros((high, wide, plane.shape[2]), kind)
                full[: page.height, : page.width] = plane
                blocks += [full[y : y + tile[1], x : x + tile[0]] for y in range(0, high, tile[1]) for x in range(0, wide, tile[0])]
            else:
                blocks += [plane[y : y + rows_per_strip] for y in range(0, page.height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            data = encode((_differences(block) if page.predictor == 2 else block).tobytes(), page.compression)
            offsets.append(len(body))
            counts.append(len(data))
            body += data + b"\0" * (len(data) % 2)
        fields: list[tuple[int, int, list[int]]] = [
            (WIDTH, 4, [page.width]), (HEIGHT, 4, [page.height]), (BITS, 3, [page.bits] * page.samples), (COMPRESSION, 3, [page.compression]),
            (PHOTOMETRIC, 3, [2 if page.samples == 3 else 1]), (SAMPLES, 3, [page.samples]), (PLANAR, 3, [planar]), (PREDICTOR, 3, [page.predictor]),
        ]
        fields += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(OFFSETS, 4, offsets), (ROWS, 4, [rows_per_strip]), (COUNTS, 4, counts)]
        entries = b""
        for tag, type_, values in sorted(fields):
            code, size = TYPES[type_]
            raw = struct.pack(order + code * len(values), *values)
            if len(raw) > 4:
                place = len(body)
                body += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, type_, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", body, link, len(body))
        body += struct.pack(order + "H", len(fields)) + entries
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (number,) = struct.unpack_from(order + "H", data, at)
    fields: dict[int, list[int]] = {}
    for k in range(number):
        tag, type_, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if type_ not in TYPES or type_ == 2:
            continue
        code, size = TYPES[type_]
        if size * count > len(data):
            raise ValueError(f"tag {tag} holds more values than the file")
        place = at + 10 + 12 * k
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        fields[tag] = list(struct.unpack_from(order + code * count, data, place))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * number)
    return fields, following


def _page(data: bytes, order: str, fields: dict[int, list[int]]) -> Page:
    one = lambda tag, usual=None: fields.get(tag, [usual])[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height:
        raise ValueError("a page without width or height")
    if any(b != bits for b in fields.get(BITS, [])) or bits not in (1, 2, 4, 8, 16, 32):
        raise ValueError("samples of mixed or unknown width")
    if predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"predictor {predictor} for {bits} bits is unknown")
    tiled = TILE_OFFSETS in fields
    offsets, counts = (fields[TILE_OFFSETS], fields[TILE_COUNTS]) if tiled else (fields[OFFSETS], fields.get(COUNTS))
    if counts is None:
        counts = [len(data) - offsets[0]]
    wide, high = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height) or height, height))
    each = samples if planar == 1 else 1
    per_plane = -(-width // wide) * -(-height // high)
    kind = np.dtype(f"{order}u{max(8, bits) // 8}")
    planes = []
    for plane in range(1 if planar == 1 else samples):
        image = np.zeros((height, width * each), kind) if bits >= 8 else np.zeros((height, -(-width * each * bits // 8)), np.uint8)
        for k in range(per_plane):
            y, x = k // -(-width // wide) * high, k % -(-width // wide) * wide
            rows = high if tiled else min(high, height - y)
            place, size = offsets[plane * per_plane + k], counts[plane * per_plane + k]
            raw = decode(data[place : place + size], compression)
            line = -(-wide * each * bits // 8)
            if len(raw) < rows * line:
                raise ValueError("a strip or tile is short")
            block = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
            if bits >= 8:
                block = block.view(kind).reshape(rows, wide, each)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=kind)
                block = block.reshape(rows, wide * each)
                keep = min(wide, width - x) * each
                image[y : y + rows, x * each : x * each + keep] = block[: height - y, :keep]
            elif tiled and x * each * bits % 8:
                raise ValueError("tiles that end within a byte")
            else:
                to = x * each * bits // 8
                image[y : y + rows, to : to + line] = block[: height - y, : image.shape[1] - to]
        planes.append(image)
    if len(planes) > 1:
        image = np.stack([p.reshape(height, width) for p in planes], axis=2).astype(kind).reshape(height, width * samples)
    else:
        image = planes[0]
    return Page(width, height, samples, bits, compression, predictor, image.tobytes())


def read_tiff(data: bytes | None) -> Iterator[Page | str]:
    """The pages in the order of their directories; a string, the last one, tells what went wrong."""
    try:
        if data is None:
            raise ValueError("no bytes")
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF")
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a circle")
            seen.add(at)
            fields, at = _directory(data, order, at)
            yield _page(data, order, fields)
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as why:
        yield f"{type(why).__name__}: {why}"


PAGE_COLUMNS = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def tiff_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """A row for each page of each file: the other columns and PAGE_COLUMNS."""
    names = PAGE_COLUMNS.replace(",", "").split()[::2]
    rest = [c for c in media.columns if c != column and c not in names]
    source = media.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`"))
    schema = source.drop(column).withColumns({n: F.lit(None).cast(t) for n, t in (x.split() for x in PAGE_COLUMNS.split(", "))}).schema
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                at, rows = [], []
                for k in range(part.num_rows):
                    for page, found in enumerate(read_tiff(part.column(len(rest))[k].as_py())):
                        at.append(k)
                        rows.append((page, None, None, None, None, None, None, found) if isinstance(found, str) else (page, found.width, found.height, found.samples, found.bits, found.compression, found.pixels, None))
                kept = part.take(pa.array(at, pa.int64())) if at else part.slice(0, 0)
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(rest)], *made], names=[*rest, *names])

    return source.mapInArrow(work, schema)


def texts_to_tiff(docs: DataFrame, width: int = 576, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, bytes 255 up to a positive multiple of ``width``, one page of 8-bit samples, one row of samples per ``width`` bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                sizes, made = [], []
                for x in part.column(1):
                    raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                    high = max(1, -(-len(raw) // width))
                    sizes.append(len(raw))
                    made.append(write_tiff([Page(width, high, 1, 8, compression, predictor, raw.ljust(high * width, b"\xff"))]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def features(pages: DataFrame, column: str = "pixels") -> DataFrame:
    """pages with ``feature``: mean, deviation and entropy of the 8-bit samples, and how many fall in each sixteenth of the range."""
    pages = pages.drop("feature")
    schema = pages.withColumn("feature", F.lit("")).schema
    names, at = pages.columns, pages.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(at):
                count = np.bincount(np.frombuffer(x.as_buffer() if x.is_valid else b"", np.uint8), minlength=256)
                n = int(count.sum())
                if not n:
                    out.append(None)
                    continue
                mean = float(count @ np.arange(256)) / n
                deviation = max(0.0, float(count @ np.arange(256) ** 2) / n - mean**2) ** 0.5
                p = count[count > 0] / n
                parts = ".".join(map(str, count.reshape(16, 16).sum(1).tolist()))
                out.append(f"mean={mean:.4f};sd={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};bins={parts}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "feature"])

    return pages.mapInArrow(work, schema)
