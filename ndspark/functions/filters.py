"""Format 2 filters, which stand between a chunk's elements and its compressor."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..dtype import parse_v2
from ..errors import ArgumentError
from .codecs import ChecksumError, shuffle_bytes, unshuffle_bytes

FILTERS: dict[str, Callable[[dict], object]] = {}


def register_filter(name: str) -> Callable:
    def put(f):
        FILTERS[name] = f
        return f

    return put


def _raw(x) -> bytes:
    return bytes(x) if isinstance(x, (bytes, bytearray, memoryview)) else np.ascontiguousarray(x).tobytes()


def _elements(x, tag: str) -> np.ndarray:
    kind = parse_v2(tag).numpy
    return np.frombuffer(x, kind) if isinstance(x, (bytes, bytearray, memoryview)) else np.ascontiguousarray(x).reshape(-1).astype(kind, copy=False)


def _unpack_items(raw: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", raw)
    out, at = [], 4
    for _ in range(n):
        (size,) = struct.unpack_from("<I", raw, at)
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def _pack_items(items: list[bytes]) -> bytes:
    return struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(x)) + x for x in items)


@dataclass(frozen=True)
class VlenUtf8:
    """A count, then each text's length in bytes and its UTF-8."""

    def encode(self, x) -> bytes:
        return _pack_items([("" if v is None else v).encode() for v in np.asarray(x, object).reshape(-1)])

    def decode(self, raw) -> np.ndarray:
        return np.array([v.decode() for v in _unpack_items(bytes(raw))], object)

    def to_json(self) -> dict:
        return {"id": "vlen-utf8"}


@dataclass(frozen=True)
class VlenArray:
    """A count, then each item's length in bytes and its elements."""

    dtype: str

    def encode(self, x) -> bytes:
        kind = parse_v2(self.dtype).numpy
        return _pack_items([np.asarray([] if v is None else v).astype(kind).tobytes() for v in x.reshape(-1)])

    def decode(self, raw) -> np.ndarray:
        items, kind = _unpack_items(bytes(raw)), parse_v2(self.dtype).numpy
        out = np.empty(len(items), object)
        for i, v in enumerate(items):
            out[i] = np.frombuffer(v, kind)
        return out

    def to_json(self) -> dict:
        return {"id": "vlen-array", "dtype": self.dtype}


def fletcher32(raw: bytes) -> int:
    """Two sums over big-endian 16-bit words, folded every 360 words; an odd length adds its
    first byte as a high one."""
    words = np.frombuffer(raw[: len(raw) // 2 * 2], ">u2").astype(np.uint64)
    a = b = 0
    for i in range(0, len(words), 360):
        part = words[i : i + 360]
        sums = np.cumsum(part) + np.uint64(a)
        b += int(sums.sum())
        a = int(sums[-1])
        a, b = (a & 0xFFFF) + (a >> 16), (b & 0xFFFF) + (b >> 16)
    if len(raw) % 2:
        a += raw[0] << 8
        b += a
        a, b = (a & 0xFFFF) + (a >> 16), (b & 0xFFFF) + (b >> 16)
    while a >> 16 or b >> 16:
        a, b = (a & 0xFFFF) + (a >> 16), (b & 0xFFFF) + (b >> 16)
    return b << 16 | a


@dataclass(frozen=True)
class Fletcher32:
    def encode(self, x) -> bytes:
        raw = _raw(x)
        return raw + struct.pack("<I", fletcher32(raw))

    def decode(self, raw) -> bytes:
        raw = bytes(raw)
        if struct.pack("<I", fletcher32(raw[:-4])) != raw[-4:]:
            raise ChecksumError("fletcher32 does not match")
        return raw[:-4]

    def to_json(self) -> dict:
        return {"id": "fletcher32"}


@dataclass(frozen=True)
class FixedScaleOffset:
    """Stored as (x - offset) * scale, rounded for an integer type; read as x / scale + offset."""

    offset: float
    scale: float
    dtype: str
    astype: str

    def encode(self, x) -> np.ndarray:
        y = (_elements(x, self.dtype).astype("f8") - self.offset) * self.scale
        kind = parse_v2(self.astype).numpy
        return (np.rint(y) if kind.kind in "iu" else y).astype(kind)

    def decode(self, x) -> np.ndarray:
        y = _elements(x, self.astype).astype("f8") / self.scale + self.offset
        kind = parse_v2(self.dtype).numpy
        return (np.rint(y) if kind.kind in "iu" else y).astype(kind)

    def to_json(self) -> dict:
        return {"id": "fixedscaleoffset", "offset": self.offset, "scale": self.scale, "dtype": self.dtype, "astype": self.astype}


@dataclass(frozen=True)
class Shuffle:
    elementsize: int = 4

    def encode(self, x) -> bytes:
        return shuffle_bytes(_raw(x), self.elementsize)

    def decode(self, x) -> bytes:
        return unshuffle_bytes(_raw(x), self.elementsize)

    def to_json(self) -> dict:
        return {"id": "shuffle", "elementsize": self.elementsize}


def quantize_bits(digits: int) -> int:
    """Binary places that keep so many decimal ones."""
    e = math.log10(10.0**-digits)
    e = math.floor(e) if e < 0 else math.ceil(e)
    return math.ceil(math.log2(10.0**-e))


@dataclass(frozen=True)
class Quantize:
    digits: int
    dtype: str
    astype: str

    def encode(self, x) -> np.ndarray:
        scale = 2.0 ** quantize_bits(self.digits)
        return (np.rint(_elements(x, self.dtype).astype("f8") * scale) / scale).astype(parse_v2(self.astype).numpy)

    def decode(self, x) -> np.ndarray:
        return _elements(x, self.astype).astype(parse_v2(self.dtype).numpy)

    def to_json(self) -> dict:
        return {"id": "quantize", "digits": self.digits, "dtype": self.dtype, "astype": self.astype}


@dataclass(frozen=True)
class Delta:
    """The first element, then differences over the flat chunk; integers wrap."""

    dtype: str
    astype: str

    def encode(self, x) -> np.ndarray:
        flat = _elements(x, self.dtype)
        with np.errstate(over="ignore"):
            return np.concatenate([flat[:1], np.diff(flat)]).astype(parse_v2(self.astype).numpy)

    def decode(self, x) -> np.ndarray:
        kind = parse_v2(self.dtype).numpy
        with np.errstate(over="ignore"):
            return np.cumsum(_elements(x, self.astype).astype(kind), dtype=kind)

    def to_json(self) -> dict:
        return {"id": "delta", "dtype": self.dtype, "astype": self.astype}


register_filter("vlen-utf8")(lambda c: VlenUtf8())
register_filter("vlen-array")(lambda c: VlenArray(c["dtype"]))
register_filter("fletcher32")(lambda c: Fletcher32())
register_filter("fixedscaleoffset")(
    lambda c: FixedScaleOffset(c.get("offset", 0), c.get("scale", 1), c["dtype"], c.get("astype") or c["dtype"])
)
register_filter("shuffle")(lambda c: Shuffle(c.get("elementsize", 4)))
register_filter("quantize")(lambda c: Quantize(c["digits"], c["dtype"], c.get("astype") or c["dtype"]))
register_filter("delta")(lambda c: Delta(c["dtype"], c.get("astype") or c["dtype"]))


def make_filter(spec: dict):
    if spec.get("id") not in FILTERS:
        raise ArgumentError(f"filter {spec.get('id')!r} is not known")
    return FILTERS[spec["id"]](spec)
