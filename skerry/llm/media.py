"""Media columns: bytes as grey PNG files in a binary column, read back with checks, and low-frequency hashes.

The writer makes signature, IHDR, IDAT and IEND chunks with their CRCs and picks for each row the filter with the least sum
of absolute differences; the reader tests the signature, every chunk's length and CRC, joins the IDAT chunks, inflates and
undoes the five row filters with numpy, many images at once. The feature is a hash of the lowest cosine-transform
coefficients of the image shrunk to a small square.

Defined results: null bytes are empty and make one row of zeros. Equal bytes give equal values. Rows are never dropped;
a stored form that fails a check raises ValueError, and so does a table that has the media column already. Of filters with
equal sums the first by number is taken. Empty table: empty result. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import batches, binary_column, small_batches, tidy

SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY_8 = (8, 0, 0, 0, 0)  # bit depth, colour type, compression, filter method, interlace


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predictions(rows: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """What filters 0 to 4 predict for each pixel; first: whether a row is the first of its image."""
    wide = rows.astype(np.int16)
    left, up = np.zeros_like(wide), np.zeros_like(wide)
    left[:, 1:] = wide[:, :-1]
    up[1:] = wide[:-1]
    up[first] = 0
    corner = np.zeros_like(wide)
    corner[:, 1:] = up[:, :-1]
    yield np.zeros_like(wide)
    yield left
    yield up
    yield (left + up) >> 1
    yield _paeth(left, up, corner)


def filter_rows(rows: np.ndarray, first: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Rows of images with their filter bytes: the kind given, or for each row that of the least sum of absolute differences."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint8)
    least = np.full(len(rows), np.iinfo(np.int64).max)
    for k, base in enumerate(_predictions(rows, first)):
        if kind not in (None, k):
            continue
        rest = (rows - base).astype(np.uint8)
        cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
        better = cost < least
        out[better, 0], out[better, 1:], least[better] = k, rest[better], cost[better]
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def _diagonals(images: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Filter bytes or pixels by anti-diagonal: [t, x, image] is column x of row t - x; zeros outside."""
    out = np.zeros((height + width - 1, width, len(images)), np.uint8)
    for k, image in enumerate(images):
        for x in range(width):
            out[x : x + len(image), x, k] = image[:, x]
    return out


def unfilter(raws: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Undo the row filters of images given as rows of a filter byte and pixels.

    A pixel needs the ones to its left, above and across, which lie on the two anti-diagonals before its own. So all
    pixels of an anti-diagonal go at once, of all images.
    """
    if any(raw[:, 0].max(initial=0) > 4 for raw in raws):
        raise ValueError("unknown row filter")
    height = max(map(len, raws))
    kinds = _diagonals([np.broadcast_to(raw[:, :1], (len(raw), width)) for raw in raws], height, width)
    pixels = _diagonals([raw[:, 1:] for raw in raws], height, width)
    before = across = np.zeros((width + 1, len(raws)), np.int16)  # the last two diagonals, after a column of zeros
    for t in range(len(pixels)):
        kind, left, up, corner = kinds[t], before[:-1], before[1:], across[:-1]
        base = np.where(kind == 1, left, 0)
        np.copyto(base, up, where=kind == 2)
        np.copyto(base, (left + up) >> 1, where=kind == 3)
        np.copyto(base, _paeth(left, up, corner), where=kind == 4)
        pixels[t] += base.astype(np.uint8)
        now = np.zeros((width + 1, len(raws)), np.int16)
        now[1:] = pixels[t]
        before, across = now, before
    out = [np.empty((len(raw), width), np.uint8) for raw in raws]
    for k, image in enumerate(out):
        for x in range(width):
            image[:, x] = pixels[x : x + len(image), x, k]
    return out


def write_pngs(images: list[np.ndarray], row_filter: int | None = None, level: int = 3, idat: int = 1 << 16) -> list[bytes]:
    """Grey 8-bit images of one width as PNG files."""
    if not images:
        return []
    first = np.zeros(sum(map(len, images)), bool)
    starts = np.cumsum([0, *map(len, images)])
    first[starts[:-1]] = True
    rows, out = filter_rows(np.concatenate(images), first, row_filter), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        body = zlib.compress(rows[a:b].tobytes(), level)
        parts = b"".join(_chunk(b"IDAT", body[k : k + idat]) for k in range(0, len(body), idat))
        out.append(SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1] - 1, b - a, *GREY_8)) + parts + _chunk(b"IEND", b""))
    return out


def write_png(image: np.ndarray, row_filter: int | None = None, level: int = 3, idat: int = 1 << 16) -> bytes:
    return write_pngs([image], row_filter, level, idat)[0]


def read_rows(stored: bytes) -> np.ndarray:
    """The filtered rows of a grey 8-bit PNG file, after all checks."""
    if not stored.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, head, body, ended = len(SIGNATURE), None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise ValueError("cut chunk")
        size, kind = struct.unpack_from(">I4s", stored, at)
        if at + 12 + size > len(stored):
            raise ValueError("cut chunk")
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r} differs")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first, and once")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
            if head[2:] != GREY_8:
                raise ValueError("only grey 8-bit images without interlace")
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if head is None or not ended or at != len(stored):
        raise ValueError("no IHDR, no IEND or bytes after it")
    width, height = head[:2]
    raw = zlib.decompress(b"".join(body))
    if len(raw) != height * (width + 1):
        raise ValueError("image data of another size")
    return np.frombuffer(raw, np.uint8).reshape(-1, width + 1)


#: Pixels, with those that pad smaller images, that are undone at once.
_AT_ONCE = 1 << 20


def read_pngs(stored: list[bytes]) -> list[np.ndarray]:
    """The images of grey 8-bit PNG files; those of like height and one width are undone together."""
    raws = [read_rows(x) for x in stored]
    out: list[np.ndarray] = [np.empty(0)] * len(raws)
    held: list[int] = []

    def undo() -> None:
        for k, image in zip(held, unfilter([raws[k] for k in held], raws[held[0]].shape[1] - 1), strict=True):
            out[k] = image
        held.clear()

    for k in sorted(range(len(raws)), key=lambda k: (raws[k].shape[1], len(raws[k]))):
        height, width = raws[k].shape
        if held and (raws[held[0]].shape[1] != width or (len(held) + 1) * (height + width) * width > _AT_ONCE):
            undo()
        held.append(k)
    if held:
        undo()
    return out


def read_png(stored: bytes) -> np.ndarray:
    return read_pngs([stored])[0]


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), np.arange(n) + 0.5) / n)


_SIDE, _LOW = 32, 8
_BASIS = _cosines(_SIDE, _LOW)


def low_frequency_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the lowest cosine coefficients of the shrunk image lie above their median."""
    cut = [np.linspace(0, n, _SIDE + 1).astype(np.int64) for n in image.shape]
    rows = np.maximum(cut[0][1:], cut[0][:-1] + 1), np.maximum(cut[1][1:], cut[1][:-1] + 1)
    sums = np.zeros((image.shape[0] + 2, image.shape[1] + 2))
    sums[1:-1, 1:-1] = np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1)
    sums[-1], sums[:, -1] = sums[-2], sums[:, -2]
    lo, hi = [np.minimum(c[:-1], n - 1) for c, n in zip(cut, image.shape, strict=True)], [np.minimum(r, n) for r, n in zip(rows, image.shape, strict=True)]
    area = np.outer(hi[0] - lo[0], hi[1] - lo[1])
    small = (sums[np.ix_(hi[0], hi[1])] - sums[np.ix_(lo[0], hi[1])] - sums[np.ix_(hi[0], lo[1])] + sums[np.ix_(lo[0], lo[1])]) / area
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    bits = np.packbits(low > np.median(low[1:]))
    return bits.tobytes().hex()


def payload_image(data: bytes, width: int) -> np.ndarray:
    """The bytes and then zeros up to a positive multiple of the width, row by row."""
    fill = -len(data) % width if data else width
    return np.frombuffer(data + bytes(fill), np.uint8).reshape(-1, width)


def _bounded(values: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The values in lists of so many bytes, or of one value."""
    held: list[bytes] = []
    weight = 0
    for x in values:
        if held and weight + len(x) > most:
            yield held
            held, weight = [], 0
        held.append(x)
        weight += len(x)
    if held:
        yield held


def to_media(rows: DataFrame, column: str = "text", width: int = 64, media: str = "media", row_filter: int | None = None) -> DataFrame:
    """rows with a binary column that holds each value of `column` as a PNG file. row_filter: one for all rows, else each row's best."""

    small_batches(rows.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            values: list[bytes] = []
            for some in _bounded(binary_column(b, column)):
                values += write_pngs([payload_image(x, width) for x in some], row_filter)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.binary())], [*b.schema.names, media])

    if media in rows.columns:
        raise ValueError(f"there is a column {media} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidy(run), f"{schema}, `{media}` binary")


_DIGEST = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_DIGEST_SQL = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(rows: DataFrame, keys: list[str], media: str = "media", tail: int = 64) -> DataFrame:
    """The key columns, and what the stored files hold when read back: digests and the low-frequency hash."""

    small_batches(rows.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = []
            files = binary_column(b, media)
            for stored, image in ((x, y) for some in _bounded(files) for x, y in zip(some, read_pngs(some), strict=True)):
                payload = image.tobytes()
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(stored), hashlib.sha256(stored).hexdigest(), low_frequency_hash(image)))
            made = next(batches(_DIGEST, found, len(found) + 1, 1 << 62), None)
            if made is not None:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), *made.columns], [*keys, *_DIGEST.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.select(*keys, F.col(media)).mapInArrow(tidy(run), f"{schema}, {_DIGEST_SQL}")
