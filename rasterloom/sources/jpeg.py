"""Baseline JPEG: Huffman-coded sequential images of 8 bits, any subsampling, with restarts.

Blocks of coefficients are read one after another, which no array operation can do; all that
follows (scaling, inverse transform, colour) is on arrays of all blocks. Chroma is repeated to full
size. Progressive and arithmetic-coded images are an error.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

from ..errors import DecodeError

#: Places of a block's coefficients in the order in which they are coded: along its diagonals, up and down in turn.
_ZIGZAG = [8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]
_BASIS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_MARKER = re.compile(rb"\xff+([\x01-\xfe])")


@dataclass
class _Component:
    across: int
    down: int
    table: int
    blocks: np.ndarray | None = None  # coefficients, by block row and column
    coders: tuple[list, list] = field(default=([], []))
    last: int = 0


def _coder(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) for each value of the next 16 bits; length 0 where no code begins so."""
    found: list[tuple[int, int]] = [(0, 0)] * 65536
    code, at = 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first = code << (16 - length)
            found[first : first + (1 << (16 - length))] = [(length, symbol)] * (1 << (16 - length))
            code += 1
        at += n
        code <<= 1
    return found


class _Bits:
    """The bits of one stretch between restarts; zeros follow its end."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.n = raw.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def _fill(self) -> None:
        self.held = (self.held << 64) | int.from_bytes(self.raw[self.at : self.at + 8].ljust(8, b"\0"), "big")
        self.n += 64
        self.at += 8

    def symbol(self, coder: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self._fill()
        length, symbol = coder[(self.held >> (self.n - 16)) & 0xFFFF]
        if not length:
            raise DecodeError("damaged JPEG")
        self.n -= length
        self.held &= (1 << self.n) - 1
        return symbol

    def number(self, size: int) -> int:
        """A signed number of ``size`` bits: those that begin with 0 are negative."""
        if not size:
            return 0
        if self.n < size:
            self._fill()
        self.n -= size
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value if value >> (size - 1) else value - (1 << size) + 1

    def block(self, part: _Component, out: np.ndarray) -> None:
        if 8 * self.at - self.n >= 8 * len(self.raw):
            raise DecodeError("truncated JPEG")
        direct, rest = part.coders
        part.last += self.number(self.symbol(direct))
        out[0] = part.last
        k = 1
        while k < 64:
            run, size = divmod(self.symbol(rest), 16)
            if not size:
                if run < 15:
                    return
                k += 16
                continue
            k += run
            if k > 63:
                raise DecodeError("damaged JPEG")
            out[_ZIGZAG[k]] = self.number(size)
            k += 1


def _scan(raw: bytes, parts: list[_Component], size: tuple[int, int], most: tuple[int, int], restart: int) -> None:
    """Read the stretches of a scan into its components' blocks."""
    if len(parts) == 1:  # blocks alone, only those that the image reaches
        own = parts[0]
        shape = [-(-n * f // (8 * m)) for n, f, m in zip(size, (own.down, own.across), most, strict=True)]
        units = [[(own, y, x)] for y in range(shape[0]) for x in range(shape[1])]
    else:
        shape = [-(-n // (8 * m)) for n, m in zip(size, most, strict=True)]
        units = [[(p, y * p.down + v, x * p.across + h) for p in parts for v in range(p.down) for h in range(p.across)] for y in range(shape[0]) for x in range(shape[1])]
    step = restart or len(units)
    stretches = re.split(rb"\xff[\xd0-\xd7]", raw)
    for n, at in enumerate(range(0, len(units), step)):
        if n >= len(stretches):
            raise DecodeError("truncated JPEG")
        bits = _Bits(stretches[n])
        for part in parts:
            part.last = 0
        for unit in units[at : at + step]:
            for part, y, x in unit:
                bits.block(part, part.blocks[y, x])


def jpeg_channels(raw: bytes) -> list[np.ndarray]:
    """The components of an image as they are coded, each of the image's size, from 0 to 255."""
    if raw[:2] != b"\xff\xd8":
        raise DecodeError("not a JPEG")
    tables: dict[int, np.ndarray] = {}
    coders: dict[int, list] = {}
    parts: dict[int, _Component] = {}
    size, most, restart, at, scans = (0, 0), (1, 1), 0, 2, 0
    try:
        while at < len(raw):
            found = _MARKER.match(raw, at)
            if not found:
                raise DecodeError("damaged JPEG")
            kind, at = found[1][0], found.end()
            if kind == 0xD9:
                break
            (n,) = struct.unpack_from(">H", raw, at)
            body, at = raw[at + 2 : at + n], at + n
            if at > len(raw):
                raise DecodeError("truncated JPEG")
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    tables[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float64)
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    count = sum(body[1:17])
                    coders[body[0]] = _coder(body[1:17], body[17 : 17 + count])
                    body = body[17 + count :]
            elif kind in (0xC0, 0xC1):
                depth, height, width, count = struct.unpack_from(">BHHB", body)
                if depth != 8 or not height or not width:
                    raise DecodeError("JPEGs of other depths than 8 bits are not supported")
                size = height, width
                for k in range(count):
                    name, factors, table = body[6 + 3 * k : 9 + 3 * k]
                    parts[name] = _Component(factors >> 4, factors & 15, table)
                most = max(p.down for p in parts.values()), max(p.across for p in parts.values())
                for p in parts.values():
                    p.blocks = np.zeros((-(-height // (8 * most[0])) * p.down, -(-width // (8 * most[1])) * p.across, 64), np.int32)
            elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
                raise DecodeError("only baseline JPEGs are supported")
            elif kind == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif kind == 0xDA:
                scanned = []
                for k in range(body[0]):
                    part = parts[body[1 + 2 * k]]
                    part.coders = coders[body[2 + 2 * k] >> 4], coders[16 | body[2 + 2 * k] & 15]
                    scanned.append(part)
                end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(raw, at)
                stop = end.start() if end else len(raw)
                _scan(raw[at:stop], scanned, size, most, restart)
                at, scans = stop, scans + 1
        if not scans:
            raise DecodeError("a JPEG without an image")
        return [_samples(p, tables[p.table], size, most) for p in parts.values()]
    except (struct.error, KeyError, IndexError, ValueError) as e:
        raise DecodeError(f"unreadable JPEG: {e}") from e


def _samples(part: _Component, table: np.ndarray, size: tuple[int, int], most: tuple[int, int]) -> np.ndarray:
    scale = np.zeros(64)
    scale[_ZIGZAG] = table
    rows, cols = part.blocks.shape[:2]
    blocks = (part.blocks * scale).reshape(rows, cols, 8, 8)
    plane = (_BASIS.T @ blocks @ _BASIS).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
    plane = np.clip(np.rint(plane + 128), 0, 255)
    return plane.repeat(most[0] // part.down, axis=0).repeat(most[1] // part.across, axis=1)[: size[0], : size[1]]


def decode_jpeg(raw: bytes) -> np.ndarray:
    """First channel as float32: grey, or red where the image has three components."""
    planes = jpeg_channels(raw)
    if len(planes) != 3:
        return planes[0].astype(np.float32)
    luma, _, red = planes
    return np.clip(np.rint(luma + 1.402 * (red - 128)), 0, 255).astype(np.float32)
