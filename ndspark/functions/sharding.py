"""Shards: an outer chunk that holds inner chunks and an index of their byte ranges."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np

from .. import formats
from ..dtype import DType, parse_v2
from ..errors import ArgumentError
from .codecs import V3Pipeline, make_v3_pipeline, register_codec

U64 = parse_v2("<u8")
GAP_BYTES = 4096  # between inner chunks that are still fetched together


def _together(wanted: list[tuple]) -> list[tuple[int, int, list]]:
    """(from, to, chunks) of sorted byte ranges, those that lie near each other in one."""
    out: list[tuple[int, int, list]] = []
    for x in wanted:
        if out and x[0] - out[-1][1] <= GAP_BYTES:
            lo, hi, group = out.pop()
            out.append((lo, max(hi, x[0] + x[1]), [*group, x]))
        else:
            out.append((x[0], x[0] + x[1], [x]))
    return out


@dataclass(frozen=True)
class Sharding:
    inner: tuple[int, ...]
    pipeline: V3Pipeline
    index: V3Pipeline
    at_start: bool
    specs: tuple
    index_specs: tuple
    fill: object = None

    def _grid(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(shape, self.inner, strict=True))

    def size(self, kind: DType, shape: tuple[int, ...]) -> int:
        raise ArgumentError("a shard has no fixed size")

    def _empty(self, kind: DType, shape: tuple[int, ...]) -> np.ndarray:
        out = np.empty(shape, kind.numpy)
        out[...] = kind.scalar(kind.zero() if self.fill is None else self.fill)[0]
        return out

    def encode(self, x: np.ndarray, kind: DType) -> bytes:
        """Inner chunks in C order, each padded to full shape; those that are all fill are left
        out, and a shard without any has no bytes."""
        grid = self._grid(x.shape)
        pairs = np.full((*grid, 2), formats.EMPTY_INNER, np.uint64)
        blank = self._empty(kind, self.inner)
        parts, at = [], 0
        for place in itertools.product(*map(range, grid)):
            cut = x[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, self.inner, strict=True))]
            whole = blank.copy()
            whole[tuple(slice(0, n) for n in cut.shape)] = cut
            if whole.tobytes() == blank.tobytes():
                continue
            raw = self.pipeline.encode(whole)
            pairs[place] = (at, len(raw))
            parts.append(raw)
            at += len(raw)
        if not parts:
            return b""
        if self.at_start:
            stored = pairs[..., 0] != np.uint64(formats.EMPTY_INNER)
            pairs[..., 0][stored] += np.uint64(self.index.encoded_size())
            return self.index.encode(pairs) + b"".join(parts)
        return b"".join(parts) + self.index.encode(pairs)

    def decode(self, raw: bytes, kind: DType, shape: tuple[int, ...]) -> np.ndarray:
        return self.decode_box(raw, kind, shape, [(0, n) for n in shape])

    def decode_box(self, raw: bytes, kind: DType, shape: tuple[int, ...], box: list[tuple[int, int]]) -> np.ndarray:
        """The shard, with only those inner chunks decoded that touch the box."""
        if not raw:
            return self._empty(kind, shape)
        return self.decode_ranges(lambda at, n: raw[at : at + n] if at >= 0 else raw[at:], kind, shape, box)

    def decode_ranges(self, read, kind: DType, shape: tuple[int, ...], box: list[tuple[int, int]]) -> np.ndarray | None:
        """The same, where read(offset, n) fetches bytes: the index, then what the box touches,
        neighbours together. None if there is no shard."""
        size = self.index.encoded_size()
        raw = read(0, size) if self.at_start else read(-size, size)
        if raw is None:
            return None
        out = self._empty(kind, shape)
        if not raw:
            return out
        pairs, wanted = self.index.decode(raw), []
        ranges = [range(lo // c, -(-hi // c)) for (lo, hi), c in zip(box, self.inner, strict=True)]
        for place in itertools.product(*ranges):
            offset, n = (int(v) for v in pairs[place])
            if offset != formats.EMPTY_INNER or n != formats.EMPTY_INNER:
                wanted.append((offset, n, place))
        for lo, hi, group in _together(sorted(wanted)):
            raw = read(lo, hi - lo)
            for offset, n, place in group:
                part = self.pipeline.decode(raw[offset - lo : offset - lo + n])
                at = tuple(slice(p * c, min((p + 1) * c, s)) for p, c, s in zip(place, self.inner, shape, strict=True))
                out[at] = part[tuple(slice(0, a.stop - a.start) for a in at)]
        return out

    def to_v3(self) -> dict:
        conf = {
            "chunk_shape": list(self.inner), "codecs": list(self.specs), "index_codecs": list(self.index_specs),
            "index_location": "start" if self.at_start else "end",
        }
        return {"name": "sharding_indexed", "configuration": conf}


@register_codec("sharding_indexed")
def make_sharding(conf: dict, kind: DType) -> Sharding:
    shape, inner = conf["_shape"], tuple(conf["chunk_shape"])
    if len(inner) != len(shape) or any(c < 1 for c in inner):
        raise ArgumentError(f"inner chunks {inner} do not fit a shard of {shape}")
    location = conf.get("index_location", "end")
    if location not in ("start", "end"):
        raise ArgumentError(f"index location {location!r} must be start or end")
    specs = conf.get("codecs") or [{"name": "bytes"}]
    index_specs = conf.get("index_codecs") or [{"name": "bytes"}, {"name": "crc32c"}]
    grid = tuple(-(-s // c) for s, c in zip(shape, inner, strict=True))
    index = make_v3_pipeline(index_specs, U64, (*grid, 2))
    index.encoded_size()  # an error unless fixed
    pipeline = make_v3_pipeline(specs, kind, inner, conf.get("_fill"))
    return Sharding(inner, pipeline, index, location == "start", tuple(specs), tuple(index_specs), conf.get("_fill"))
