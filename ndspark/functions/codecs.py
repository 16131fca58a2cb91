"""Byte codecs of chunks: compressors, checksums, endianness, transposition, and pipelines.

A codec is a frozen dataclass that encodes and decodes one value and gives its JSON; registries
by format let a caller add more. Pipelines hold them in encoding order.
"""

from __future__ import annotations

import gzip
import struct
import warnings
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

from ..dtype import DType
from ..errors import ArgumentError

COMPRESSORS: dict[str, Callable[[dict], object]] = {}
V3_CODECS: dict[str, Callable[[dict, DType], object]] = {}


def register_compressor(name: str) -> Callable:
    def put(f):
        COMPRESSORS[name] = f
        return f

    return put


def register_codec(name: str) -> Callable:
    def put(f):
        V3_CODECS[name] = f
        return f

    return put


class ChecksumError(ValueError):
    """Stored bytes that do not match their checksum."""


@dataclass(frozen=True)
class Zlib:
    level: int = -1

    def encode(self, raw: bytes) -> bytes:
        return zlib.compress(raw, self.level)

    def decode(self, raw: bytes) -> bytes:
        return zlib.decompress(raw)

    def to_json(self) -> dict:
        return {"id": "zlib", "level": self.level}


@dataclass(frozen=True)
class Gzip:
    level: int = 6

    def encode(self, raw: bytes) -> bytes:
        return gzip.compress(raw, self.level, mtime=0)

    def decode(self, raw: bytes) -> bytes:
        return gzip.decompress(raw)

    def to_json(self) -> dict:
        return {"id": "gzip", "level": self.level}

    def to_v3(self) -> dict:
        return {"name": "gzip", "configuration": {"level": self.level}}


@dataclass(frozen=True)
class Zstd:
    level: int = 0
    checksum: bool = False

    def encode(self, raw: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=self.level or 3, write_checksum=self.checksum).compress(raw)

    def decode(self, raw: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)

    def to_json(self) -> dict:
        return {"id": "zstd", "level": self.level} | ({"checksum": True} if self.checksum else {})

    def to_v3(self) -> dict:
        return {"name": "zstd", "configuration": {"level": self.level, "checksum": self.checksum}}


# Fixed values of the blosc container: names of inner codecs and their numbers in the flags.
BLOSC_NAMES = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
BLOSC_SHUFFLES = {"noshuffle": 0, "shuffle": 1, "bitshuffle": 2}
BLOSC_SHUFFLED, BLOSC_STORED, BLOSC_BITS, BLOSC_WHOLE = 0x1, 0x2, 0x4, 0x10
BLOSC_HEAD = 16
BLOSC_SPLIT_MAX, BLOSC_SPLIT_MIN_BLOCK = 16, 128
BLOSC_MIN_BUFFER = 128  # smaller buffers are stored as they are


def shuffle_bytes(raw: bytes, size: int) -> bytes:
    """All first bytes of the elements, then all second ones; a rest stays at the end."""
    n = len(raw) // size * size
    if size <= 1 or not n:
        return raw
    return np.frombuffer(raw[:n], "u1").reshape(-1, size).T.tobytes() + raw[n:]


def unshuffle_bytes(raw: bytes, size: int) -> bytes:
    n = len(raw) // size * size
    if size <= 1 or not n:
        return raw
    return np.frombuffer(raw[:n], "u1").reshape(size, -1).T.tobytes() + raw[n:]


def _swap_bits(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number as an 8 by 8 matrix of bits, transposed: blocks of 1, 2 and 4 bits
    change places."""
    for step, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        moved = (x ^ (x >> np.uint64(step))) & np.uint64(mask)
        x = x ^ moved ^ (moved << np.uint64(step))
    return x


def shuffle_bits(raw: bytes, size: int) -> bytes:
    """The same by bits, for a number of elements that 8 divides; the rest stays."""
    n = len(raw) // (8 * size) * 8 * size
    if not n:
        return raw
    planes = np.ascontiguousarray(np.frombuffer(raw[:n], "u1").reshape(-1, size).T)
    bits = _swap_bits(planes.view("<u8")).view("u1").reshape(size, -1, 8)
    return bits.transpose(0, 2, 1).tobytes() + raw[n:]


def unshuffle_bits(raw: bytes, size: int) -> bytes:
    n = len(raw) // (8 * size) * 8 * size
    if not n:
        return raw
    bits = np.frombuffer(raw[:n], "u1").reshape(size, 8, -1).transpose(0, 2, 1)
    planes = _swap_bits(np.ascontiguousarray(bits).reshape(size, -1).view("<u8")).view("u1")
    return planes.reshape(size, -1).T.tobytes() + raw[n:]


def _inner_encode(name: str, level: int, raw: bytes) -> bytes:
    if name == "zlib":
        return zlib.compress(raw, level)
    if name == "zstd":
        return zstandard.ZstdCompressor(level=max(1, level)).compress(raw)
    if name in ("lz4", "lz4hc"):
        return pa.Codec("lz4_raw").compress(raw, asbytes=True)
    if name == "snappy":
        return pa.Codec("snappy").compress(raw, asbytes=True)
    raise ArgumentError(f"blosc's inner codec {name!r} can't be written here")


def _inner_decode(number: int, raw: bytes, size: int) -> bytes:
    if number == 3:
        return zlib.decompress(raw)
    if number == 4:
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    if number == 1:
        return pa.Codec("lz4_raw").decompress(raw, size, asbytes=True)
    if number == 2:
        return pa.Codec("snappy").decompress(raw, size, asbytes=True)
    if number == 0:
        return _blosclz_decode(raw, size)
    raise ArgumentError(f"blosc's inner codec number {number} is not known")


def _blosclz_decode(raw: bytes, size: int) -> bytes:
    """The byte-oriented Lempel-Ziv code of the container's own inner codec."""
    out, at, ctrl, n = bytearray(), 1, raw[0] & 31, len(raw)
    while True:
        if ctrl >= 32:
            length, high = (ctrl >> 5) - 1, (ctrl & 31) << 8
            if length == 6:
                while True:
                    code = raw[at]
                    at += 1
                    length += code
                    if code != 255:
                        break
            code = raw[at]
            at += 1
            distance = high + code
            if code == 255 and high == 31 << 8:
                distance = (raw[at] << 8) + raw[at + 1] + 8191
                at += 2
            start = len(out) - distance - 1
            for i in range(length + 3):
                out.append(out[start + i])
        else:
            out += raw[at : at + ctrl + 1]
            at += ctrl + 1
        if at >= n or len(out) >= size:
            return bytes(out[:size])
        ctrl = raw[at]
        at += 1


@dataclass(frozen=True)
class Blosc:
    """The blosc container, version 1. shuffle: 0 none, 1 bytes, 2 bits, -1 by element size."""

    cname: str = "lz4"
    clevel: int = 5
    shuffle: int = 1
    blocksize: int = 0
    typesize: int = 1

    def __post_init__(self):
        if self.cname not in BLOSC_NAMES:
            raise ArgumentError(f"blosc's inner codec {self.cname!r} is not known")
        if self.shuffle not in (-1, 0, 1, 2):
            raise ArgumentError(f"shuffle {self.shuffle!r} must be -1, 0, 1 or 2")

    @property
    def _shuffle(self) -> int:
        return self.shuffle if self.shuffle >= 0 else 2 if self.typesize == 1 else 1

    def encode(self, raw: bytes) -> bytes:
        size, n = self.typesize if self.typesize < 256 else 1, len(raw)
        flags = BLOSC_NAMES[self.cname] << 5 | BLOSC_WHOLE
        mode = self._shuffle
        if mode == 1 and size > 1:
            flags |= BLOSC_SHUFFLED
        elif mode == 2:
            flags |= BLOSC_BITS
        block = self.blocksize or 1 << 18
        block = min(max(size, block // size * size), max(1, n))
        parts, starts = [], []
        at = BLOSC_HEAD + 4 * (-(-n // block) if n else 0)
        for lo in range(0, n, block):
            plain = raw[lo : lo + block]
            if flags & BLOSC_SHUFFLED:
                plain = shuffle_bytes(plain, size)
            elif flags & BLOSC_BITS:
                plain = shuffle_bits(plain, size)
            packed = _inner_encode(self.cname, self.clevel, plain) if self.clevel else plain
            packed = packed if len(packed) < len(plain) else plain
            starts.append(at)
            parts.append(struct.pack("<i", len(packed)) + packed)
            at += 4 + len(packed)
        if n < BLOSC_MIN_BUFFER or at >= n + BLOSC_HEAD:  # stored as it is
            head = struct.pack("<BBBBIII", 2, 1, flags | BLOSC_STORED, size, n, block, n + BLOSC_HEAD)
            return head + raw
        head = struct.pack("<BBBBIII", 2, 1, flags, size, n, block, at)
        return head + struct.pack(f"<{len(starts)}i", *starts) + b"".join(parts)

    def decode(self, raw: bytes) -> bytes:
        _, _, flags, size, n, block, total = struct.unpack("<BBBBIII", raw[:BLOSC_HEAD])
        if flags & BLOSC_STORED:
            return raw[BLOSC_HEAD : BLOSC_HEAD + n]
        out, count = [], -(-n // block) if n else 0
        starts = struct.unpack(f"<{count}i", raw[BLOSC_HEAD : BLOSC_HEAD + 4 * count])
        for i, at in enumerate(starts):
            length = min(block, n - i * block)
            whole = flags & BLOSC_WHOLE or size > BLOSC_SPLIT_MAX or block // size < BLOSC_SPLIT_MIN_BLOCK or length < block
            splits = 1 if whole else size
            plain = []
            for _ in range(splits):
                (packed,) = struct.unpack("<i", raw[at : at + 4])
                at += 4
                want = length // splits
                piece = raw[at : at + packed]
                plain.append(piece if packed == want else _inner_decode(flags >> 5, piece, want))
                at += packed
            got = b"".join(plain)
            if flags & BLOSC_SHUFFLED:
                got = unshuffle_bytes(got, size)
            elif flags & BLOSC_BITS:
                got = unshuffle_bits(got, size)
            out.append(got)
        return b"".join(out)

    def to_json(self) -> dict:
        return {"id": "blosc", "cname": self.cname, "clevel": self.clevel, "shuffle": self.shuffle, "blocksize": self.blocksize}

    def to_v3(self) -> dict:
        name = {v: k for k, v in BLOSC_SHUFFLES.items()}[self._shuffle]
        conf = {"cname": self.cname, "clevel": self.clevel, "shuffle": name, "typesize": self.typesize, "blocksize": self.blocksize}
        return {"name": "blosc", "configuration": conf}


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """Eight tables of the Castagnoli polynomial, for eight bytes at a time."""
    table = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        table[0, i] = c
    for k in range(1, 8):
        table[k] = table[0][table[k - 1] & 0xFF] ^ table[k - 1] >> 8
    return table


def _crc_step(raw: bytes, c: int) -> int:
    """The register after some bytes, eight at a time."""
    t, n = [x.tolist() for x in _crc_table()], len(raw)
    for low, high in struct.iter_unpack("<II", raw[: n - n % 8]):
        low ^= c
        c = (
            t[7][low & 255] ^ t[6][low >> 8 & 255] ^ t[5][low >> 16 & 255] ^ t[4][low >> 24]
            ^ t[3][high & 255] ^ t[2][high >> 8 & 255] ^ t[1][high >> 16 & 255] ^ t[0][high >> 24]
        )
    for b in raw[n - n % 8 :]:
        c = t[0][(c ^ b) & 255] ^ c >> 8
    return c


def _linear(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A map of 32-bit numbers that is linear by bits, given by the images of single bits."""
    out = np.zeros_like(x)
    for k in range(32):
        out ^= images[k] * (x >> np.uint32(k) & np.uint32(1))
    return out


@lru_cache(maxsize=256)
def _crc_shift(n: int) -> np.ndarray:
    """What n zero bytes make of the register, as the images of its bits."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n == 0:
        return images
    if n == 1:
        return _crc_table()[0][images & 255] ^ images >> np.uint32(8)
    half = _crc_shift(n // 2)
    images = _linear(half, half)
    return _linear(_crc_shift(1), images) if n % 2 else images


CRC_LANE = 1024  # bytes of a lane at least


def crc32c(raw: bytes) -> int:
    """Many lanes of bytes at once; their registers are then put together in pairs, as the
    register after two strings is that after the first, moved by the second's length, and that of
    the second."""
    n = len(raw)
    lanes = 1 << min(12, max(0, (n // CRC_LANE).bit_length() - 1))
    if lanes < 16:
        return _crc_step(raw, 0xFFFFFFFF) ^ 0xFFFFFFFF
    size = n // lanes // 8 * 8
    words = np.ascontiguousarray(np.frombuffer(raw, "<u4", lanes * size // 4).reshape(lanes, -1).T)
    t, c = _crc_table(), np.zeros(lanes, np.uint32)
    c[0] = 0xFFFFFFFF
    at = lambda x, k: x >> np.uint32(k) & np.uint32(255)
    for i in range(0, len(words), 2):
        low, high = words[i] ^ c, words[i + 1]
        c = (
            t[7][at(low, 0)] ^ t[6][at(low, 8)] ^ t[5][at(low, 16)] ^ t[4][low >> np.uint32(24)]
            ^ t[3][at(high, 0)] ^ t[2][at(high, 8)] ^ t[1][at(high, 16)] ^ t[0][high >> np.uint32(24)]
        )
    span = size
    while len(c) > 1:
        c = _linear(_crc_shift(span), c[0::2]) ^ c[1::2]
        span *= 2
    return _crc_step(raw[lanes * size :], int(c[0])) ^ 0xFFFFFFFF


@dataclass(frozen=True)
class Crc32c:
    fixed_extra = 4

    def encode(self, raw: bytes) -> bytes:
        return raw + struct.pack("<I", crc32c(raw))

    def decode(self, raw: bytes) -> bytes:
        body = raw[:-4]
        if struct.pack("<I", crc32c(body)) != raw[-4:]:
            raise ChecksumError("crc32c does not match")
        return body

    def to_v3(self) -> dict:
        return {"name": "crc32c"}


@dataclass(frozen=True)
class Bytes:
    """Array to bytes in C order."""

    endian: str = "little"

    def __post_init__(self):
        if self.endian not in ("little", "big"):
            raise ArgumentError(f"endian {self.endian!r} must be little or big")

    def _layout(self, kind: DType) -> np.dtype:
        return kind.numpy.newbyteorder("<" if self.endian == "little" else ">")

    def encode(self, x: np.ndarray, kind: DType) -> bytes:
        return np.ascontiguousarray(x).astype(self._layout(kind)).tobytes()

    def decode(self, raw: bytes, kind: DType, shape: tuple[int, ...]) -> np.ndarray:
        return np.frombuffer(raw, self._layout(kind)).reshape(shape).astype(kind.numpy, copy=False)

    def size(self, kind: DType, shape: tuple[int, ...]) -> int:
        return kind.itemsize * int(np.prod(shape, dtype=np.int64))

    def to_v3(self) -> dict:
        return {"name": "bytes", "configuration": {"endian": self.endian}}


@dataclass(frozen=True)
class Transpose:
    """Axis i of the stored array is axis order[i] of the array."""

    order: tuple[int, ...]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.transpose(x, self.order)

    def decode(self, x: np.ndarray) -> np.ndarray:
        return np.transpose(x, np.argsort(self.order))

    def shape(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(shape[i] for i in self.order)

    def to_v3(self) -> dict:
        return {"name": "transpose", "configuration": {"order": list(self.order)}}


def layout_order(transposes: list[Transpose], rank: int) -> str:
    """C or F, for a chain that leaves the axes as they are or reverses them."""
    axes = list(range(rank))
    for t in transposes:
        axes = [axes[i] for i in t.order]
    if axes == list(range(rank)):
        return "C"
    if axes == list(range(rank))[::-1]:
        return "F"
    raise ArgumentError(f"axes {axes} are neither in C nor in F order")


register_compressor("zlib")(lambda c: Zlib(c.get("level", -1)))
register_compressor("gzip")(lambda c: Gzip(c.get("level", 6)))
register_compressor("zstd")(lambda c: Zstd(c.get("level", 0), bool(c.get("checksum", False))))
register_compressor("blosc")(
    lambda c: Blosc(c.get("cname", "lz4"), c.get("clevel", 5), c.get("shuffle", 1), c.get("blocksize", 0))
)
register_codec("gzip")(lambda c, _: Gzip(c.get("level", 6)))
register_codec("zstd")(lambda c, _: Zstd(c.get("level", 3), bool(c.get("checksum", False))))
register_codec("crc32c")(lambda c, _: Crc32c())
register_codec("bytes")(lambda c, _: Bytes(c.get("endian", "little")))


@register_codec("blosc")
def _v3_blosc(c: dict, kind: DType) -> Blosc:
    mode = c.get("shuffle", "shuffle" if kind.itemsize > 1 else "bitshuffle")
    if isinstance(mode, str):
        if mode not in BLOSC_SHUFFLES:
            raise ArgumentError(f"shuffle {mode!r} is not known")
        mode = BLOSC_SHUFFLES[mode]
    elif mode not in (0, 1, 2):
        raise ArgumentError(f"shuffle {mode!r} is not known")
    size = c.get("typesize") or max(1, kind.itemsize)
    return Blosc(c.get("cname", "lz4"), c.get("clevel", 5), mode, c.get("blocksize", 0), size)


@register_codec("transpose")
def _v3_transpose(c: dict, _) -> Transpose | str:
    order = c.get("order")
    if isinstance(order, str):
        if order not in ("C", "F"):
            raise ArgumentError(f"transpose order {order!r} is not known")
        warnings.warn(f"transpose order {order!r} is out of date; give the axes", stacklevel=2)
        return order
    if sorted(order) != list(range(len(order))):
        raise ArgumentError(f"{order} is not an order of axes")
    return Transpose(tuple(order))


def make_compressor(spec: dict | None, kind: DType):
    """A format 2 compressor from its JSON."""
    if spec is None:
        return None
    name = spec.get("id") or spec.get("name")
    if name not in COMPRESSORS:
        raise ArgumentError(f"compressor {name!r} is not known")
    made = COMPRESSORS[name](spec.get("configuration") or spec)
    if isinstance(made, Blosc) and not kind.is_object:
        made = Blosc(made.cname, made.clevel, made.shuffle, made.blocksize, max(1, kind.itemsize))
    return made


@dataclass(frozen=True)
class V2Pipeline:
    """Filters from left to right, then the compressor."""

    kind: DType
    chunks: tuple[int, ...]
    filters: tuple = ()
    compressor: object = None

    def encode(self, x: np.ndarray) -> bytes:
        for f in self.filters:
            x = f.encode(x)
        raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
        return self.compressor.encode(raw) if self.compressor else raw

    def decode(self, raw: bytes) -> np.ndarray:
        raw = self.compressor.decode(raw) if self.compressor else raw
        x = raw
        for f in reversed(self.filters):
            x = f.decode(x)
        if isinstance(x, (bytes, bytearray, memoryview)):
            x = np.frombuffer(x, self.kind.numpy)
        want = int(np.prod(self.chunks, dtype=np.int64))
        if x.size != want:
            raise ArgumentError(f"a chunk has {x.size} elements, not {want}")
        return x.reshape(self.chunks)


@dataclass(frozen=True)
class V3Pipeline:
    """Array to array codecs, one array to bytes codec, bytes to bytes codecs."""

    kind: DType
    chunks: tuple[int, ...]
    before: tuple = ()
    middle: object = field(default_factory=Bytes)
    after: tuple = ()

    def stored_shape(self) -> tuple[int, ...]:
        shape = self.chunks
        for c in self.before:
            shape = c.shape(shape)
        return shape

    def encode(self, x: np.ndarray) -> bytes | None:
        for c in self.before:
            x = c.encode(x)
        raw = self.middle.encode(x, self.kind)
        for c in self.after:
            raw = c.encode(raw)
        return raw

    @property
    def reads_ranges(self) -> bool:
        """Whether a part of a chunk can be decoded from a part of its bytes."""
        return not self.before and not self.after and hasattr(self.middle, "decode_ranges")

    def decode_ranges(self, read, box: list[tuple[int, int]]) -> np.ndarray | None:
        """The chunk with the box filled in; read(offset, n) gives bytes of the stored chunk,
        from the end for a negative offset, None if it is not stored."""
        return self.middle.decode_ranges(read, self.kind, self.chunks, box)

    def decode(self, raw: bytes, box: list[tuple[int, int]] | None = None) -> np.ndarray:
        """box: the part of the chunk that is wanted, for codecs that can leave out others."""
        for c in reversed(self.after):
            raw = c.decode(raw)
        shape = self.stored_shape()
        if box is not None and not self.before and hasattr(self.middle, "decode_box"):
            x = self.middle.decode_box(raw, self.kind, shape, box)
        else:
            x = self.middle.decode(raw, self.kind, shape)
        for c in reversed(self.before):
            x = c.decode(x)
        return x

    def encoded_size(self) -> int:
        """Bytes of any encoded chunk; an error if that depends on the content."""
        n = self.middle.size(self.kind, self.stored_shape())
        for c in self.after:
            if not hasattr(c, "fixed_extra"):
                raise ArgumentError(f"{type(c).__name__} has no fixed size")
            n += c.fixed_extra
        return n

    def to_json(self) -> list[dict]:
        return [c.to_v3() for c in (*self.before, self.middle, *self.after)]


def make_v3_pipeline(specs: list[dict], kind: DType, chunks: tuple[int, ...], fill=None) -> V3Pipeline:
    """Codecs from their JSON, which must be array to array, one array to bytes, bytes to bytes."""
    before, middle, after = [], None, []
    shape = chunks
    for spec in specs:
        spec = {"name": spec} if isinstance(spec, str) else spec
        name = str(spec.get("name", "")).removeprefix("numcodecs.")
        if name not in V3_CODECS:
            raise ArgumentError(f"codec {name!r} is not known")
        conf = spec.get("configuration") or {}
        if name == "sharding_indexed":
            made = V3_CODECS[name](conf | {"_shape": shape, "_fill": fill}, kind)
        else:
            made = V3_CODECS[name](conf, kind)
        if made == "C":
            continue
        if made == "F":
            made = Transpose(tuple(range(len(chunks)))[::-1])
        if isinstance(made, Transpose):
            if middle is not None:
                raise ArgumentError("an array codec can't follow the one that makes bytes")
            if len(made.order) != len(chunks):
                raise ArgumentError(f"{made.order} does not order {len(chunks)} axes")
            shape = made.shape(shape)
            before.append(made)
        elif hasattr(made, "size"):
            if middle is not None:
                raise ArgumentError("only one codec can make bytes of an array")
            middle = made
        else:
            if middle is None:
                raise ArgumentError("a bytes codec needs one before it that makes bytes of an array")
            after.append(made)
    if middle is None:
        raise ArgumentError("a codec that makes bytes of an array is missing")
    return V3Pipeline(kind, chunks, tuple(before), middle, tuple(after))


def to_v3_compressor(compressor) -> list[dict]:
    """The v3 codecs for a v2 compressor."""
    if compressor is None:
        return []
    if isinstance(compressor, Zlib):
        return [Gzip(6 if compressor.level == -1 else compressor.level).to_v3()]
    if hasattr(compressor, "to_v3"):
        return [compressor.to_v3()]
    raise ArgumentError(f"{type(compressor).__name__} has no codec in format 3")


from . import sharding  # noqa: E402, F401  registers its codec
