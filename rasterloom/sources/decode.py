"""Decoders of tile bytes to two-dimensional arrays, and their registry.

TIFF: strips or tiles, no compression, deflate, LZW or PackBits, with either predictor, 8 to 64 bits,
one or more samples a pixel. PNG: 1 to 16 bits, grey, RGB, palette and alpha, interlaced or not. JPEG:
baseline (``jpeg``). Images on storage are also read by Spark's image source (``decode_images``). The
first band is returned.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import DecodeError
from ..model import Format
from .jpeg import decode_jpeg

Decoder = Callable[[bytes], np.ndarray]
_REGISTRY: dict[Format, Decoder] = {}


def register_decoder(fmt: Format | str, decoder: Decoder) -> None:
    """Use ``decoder`` (bytes to a 2-D array) for a format; it must be picklable, as tasks run it."""
    _REGISTRY[Format.of(fmt)] = decoder


def registered_decoder(fmt: Format | str) -> Decoder | None:
    """The decoder of a format, None if there is none or the format is unknown."""
    found = Format.of_or_none(fmt)
    return _REGISTRY.get(found) if found else None


def resolve_decoder(fmt: Format | str | None, explicit: Decoder | None = None) -> Decoder:
    """The explicit decoder, else the registered one; neither is an error, before any tile is fetched."""
    found = explicit or (registered_decoder(fmt) if fmt else None)
    if found is None:
        raise DecodeError(f"no decoder for {fmt}")
    return found


def cleaned(array: np.ndarray) -> np.ndarray:
    """float32, with NaN for what is not finite or beyond 1e20; copied only if something changes."""
    out = array.astype(np.float32, copy=False)
    with np.errstate(invalid="ignore"):
        bad = ~np.isfinite(out) | (np.abs(out) > 1e20)
    return np.where(bad, np.float32("nan"), out) if bad.any() else out


# TIFF field sizes by type, and sample kinds by sample format.
_FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KIND = {1: "u", 2: "i", 3: "f"}


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the longest bit first, that grow one code early."""
    out, table, last = [], [], b""
    held, n, width = 0, 0, 9
    for byte in raw:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([b]) for b in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table) or (code == len(table) and not last):
            raise DecodeError("damaged LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def _packbits(raw: bytes) -> bytes:
    """Runs of a byte, and stretches of bytes as they are."""
    out, at = [], 0
    while at + 1 < len(raw):
        n = raw[at]
        if n < 128:
            out.append(raw[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(raw[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


# TIFF compression schemes.
_UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def _block(data: bytes, dtype: np.dtype, rows: int, width: int, per: int, predictor: int) -> np.ndarray:
    """Samples of a strip or tile with its predictor undone."""
    if predictor == 3:  # differences of bytes; a row holds all samples' first bytes, then all second ones
        size = dtype.itemsize
        flat = np.frombuffer(data, np.uint8, rows * width * per * size).reshape(rows, -1, per)
        whole = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, width * per)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, width, per)
    block = np.frombuffer(data, dtype, rows * width * per).reshape(rows, width, per)
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
    if predictor != 1:
        raise DecodeError(f"TIFF predictor {predictor} is not supported")
    return block


def _fields(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise DecodeError("not a TIFF")
    at = struct.unpack(order + "I", raw[4:8])[0]
    fields = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind not in _FIELD:
            continue
        code = f"{order}{count}{_FIELD[kind]}"
        place = at + 10 + 12 * k
        if struct.calcsize(code) > 4:
            place = struct.unpack_from(order + "I", raw, place)[0]
        fields[tag] = struct.unpack_from(code, raw, place)
    return order, fields


def tiff_samples(raw: bytes) -> np.ndarray:
    """The first band of a TIFF, in its own type."""
    try:
        order, f = _fields(raw)
        width, height = f[256][0], f[257][0]
        bits, compression, samples = f.get(258, (1,))[0], f.get(259, (1,))[0], f.get(277, (1,))[0]
        dtype = np.dtype(f"{_KIND[f.get(339, (1,))[0]]}{bits // 8}").newbyteorder(order)
    except (KeyError, struct.error, IndexError, TypeError) as e:
        raise DecodeError(f"unreadable TIFF: {e}") from e
    if compression not in _UNPACK:
        raise DecodeError(f"TIFF compression {compression} is not supported")
    planar = f.get(284, (1,))[0] == 2
    per = 1 if planar else samples
    if 322 in f:
        bw, bh, offsets, sizes = f[322][0], f[323][0], f[324], f[325]
    else:
        bw, bh, offsets, sizes = width, min(f.get(278, (height,))[0], height), f[273], f[279]
    across, down = -(-width // bw), -(-height // bh)
    out = np.zeros((down * bh, across * bw), dtype)
    predictor = f.get(317, (1,))[0]
    for k in range(across * down):
        rows = bh if 322 in f else min(bh, height - k * bh)
        try:
            data = _UNPACK[compression](raw[offsets[k] : offsets[k] + sizes[k]])
            block = _block(data, dtype, rows, bw, per, predictor)
        except (zlib.error, ValueError) as e:
            raise DecodeError(f"damaged TIFF: {e}") from e
        y, x = k // across * bh, k % across * bw
        out[y : y + rows, x : x + bw] = block[:, :, 0]
    return out[:height, :width].astype(dtype.newbyteorder("="))


def decode_tiff(raw: bytes) -> np.ndarray:
    """First band as float32, fill values as NaN."""
    return cleaned(tiff_samples(raw))


def encode_tiff(array: np.ndarray, *, deflate: bool = False) -> bytes:
    """A one-band TIFF with one strip."""
    array = np.ascontiguousarray(array)
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    data = array.astype(array.dtype.newbyteorder("<")).tobytes()
    data = zlib.compress(data) if deflate else data
    height, width = array.shape
    fields = [(256, 4, width), (257, 4, height), (258, 3, array.dtype.itemsize * 8), (259, 3, 8 if deflate else 1), (262, 3, 1), (273, 4, 8 + 2 + 10 * 12 + 4), (277, 3, 1), (278, 4, height), (279, 4, len(data)), (339, 3, kind)]
    head = struct.pack("<2sHIH", b"II", 42, 8, len(fields))
    body = b"".join(struct.pack("<HHII", tag, t, 1, value) for tag, t, value in fields)
    return head + body + struct.pack("<I", 0) + data


# Samples a pixel by PNG colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """First channel as float32 (of a palette, the red of its colour); no fill values are taken out."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise DecodeError("not a PNG")
    at, data, palette, head = 8, [], None, None
    try:
        while at < len(raw):
            size, kind = struct.unpack_from(">I4s", raw, at)
            body = raw[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                data.append(body)
            at += 12 + size
        width, height, depth, colour, _, _, interlace = head
        flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except (struct.error, TypeError, zlib.error, ValueError) as e:
        raise DecodeError(f"unreadable PNG: {e}") from e
    if depth not in (1, 2, 4, 8, 16) or interlace > 1 or colour not in _CHANNELS:
        raise DecodeError("not a PNG of the standard")
    bits = _CHANNELS[colour] * depth
    first = np.zeros((height, width), np.uint16)
    at = 0
    try:
        for y0, x0, dy, dx in _ADAM7 if interlace else ((0, 0, 1, 1),):
            rows, cols = -(-max(0, height - y0) // dy), -(-max(0, width - x0) // dx)
            if not rows or not cols:
                continue
            stride = 1 + -(-cols * bits // 8)
            lines = flat[at : at + rows * stride].reshape(rows, stride)
            at += rows * stride
            first[y0::dy, x0::dx] = _first_samples(_lines(lines, max(1, bits // 8)), cols, depth, _CHANNELS[colour])
        if colour == 3:
            return palette[first][:, :, 0].astype(np.float32)
    except (ValueError, IndexError, TypeError) as e:
        raise DecodeError(f"damaged PNG: {e}") from e
    return (first * _SCALE.get(depth, 1)).astype(np.float32)


# First row, first column and steps of the passes of an interlaced PNG.
_ADAM7 = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
#: Grey of 2 and 4 bits is spread to 8; of 1 bit it stays 0 and 1.
_SCALE = {2: 85, 4: 17}


def _lines(lines: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(lines.shape[1] - 1, np.uint8)
    for y in range(len(lines)):
        out[y] = above = _unfiltered(lines[y, 0], lines[y, 1:], above, step)
    return out


def _first_samples(lines: np.ndarray, cols: int, depth: int, channels: int) -> np.ndarray:
    if depth < 8:
        spread = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, :cols]
        return spread @ (1 << np.arange(depth)[::-1])
    samples = lines.view(">u2") if depth == 16 else lines
    return samples.reshape(len(lines), cols, channels)[:, :, 0]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, up, src = [0] * len(line), above.tolist(), line.tolist()
    for i, v in enumerate(src):
        a = out[i - step] if i >= step else 0
        b, c = up[i], up[i - step] if i >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))
            guess = near[0][2]
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def decode_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, width, height, values`` of image files (JPEG and PNG, 8 bits) by Spark's image source.

    Its bytes are blue, green, red and alpha; the red of colour images is returned, as the first
    channel of the file is.
    """

    def first_channel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, width, height, channels, data = (batch.column(k) for k in range(5))
            flat = [np.frombuffer(d.as_buffer(), np.uint8)[2 if n >= 3 else 0 :: n].astype(np.float32) for d, n in zip(data, channels.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([path, width, height, pa.array(flat, pa.list_(pa.float32()))], ["path", "width", "height", "values"])

    image = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    return image.mapInArrow(first_channel, "path string, width int, height int, values array<float>")


register_decoder(Format.TIFF, decode_tiff)
register_decoder(Format.PNG, decode_png)
register_decoder(Format.JPEG, decode_jpeg)
