"""Array and group metadata of both formats."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from functools import cached_property

from . import formats, keys
from .dtype import DType, decode_fill, encode_fill, parse_v2, parse_v3
from .errors import ArgumentError, DimensionMismatch
from .functions.codecs import Bytes, V2Pipeline, V3Pipeline, make_compressor, make_v3_pipeline
from .functions.filters import make_filter


@dataclass(frozen=True)
class ArrayMeta:
    """Everything that is needed to find and read the chunks of an array. Axis 0 is the slowest
    and indices start at 0. filters and compressor belong to format 2, codecs to format 3."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: DType
    fill_value: object = None
    format: int = formats.DEFAULT_FORMAT
    compressor: dict | None = None
    filters: tuple = ()
    codecs: tuple = ({"name": "bytes", "configuration": {"endian": "little"}},)
    encoding: keys.KeyEncoding | None = None
    attrs: dict = field(default_factory=dict)
    dimension_names: tuple | None = None

    def __post_init__(self):
        if self.format not in (2, 3):
            raise ArgumentError(f"format {self.format!r} is not known")
        if len(self.shape) != len(self.chunks):
            raise DimensionMismatch(f"shape {self.shape} and chunks {self.chunks} differ in rank")
        if any(n < 0 for n in self.shape):
            raise ArgumentError(f"shape {self.shape} is negative")
        if any(c < 1 for c in self.chunks):
            raise ArgumentError(f"chunks {self.chunks} must be at least 1")
        if self.encoding is None:
            object.__setattr__(self, "encoding", keys.parse("v2" if self.format == 2 else "default"))
        if self.format == 3 and self.filters:
            raise ArgumentError("format 3 has codecs, not filters")
        if self.format == 3 and self.dtype.is_object:
            raise ArgumentError("texts and ragged arrays are stored in format 2 only")
        if self.format == 3 and self.fill_value is None:
            object.__setattr__(self, "fill_value", self.dtype.zero())
        if self.format == 2 and self.dtype.is_object and not self.filters:
            raise ArgumentError("an object type needs a filter that stores items")
        self.pipeline  # noqa: B018  an error now rather than at the first chunk

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    @property
    def n_chunks(self) -> int:
        return math.prod(self.grid)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @cached_property
    def pipeline(self) -> V2Pipeline | V3Pipeline:
        if self.format == 3:
            return make_v3_pipeline(list(self.codecs), self.dtype, self.chunks, self.fill_value)
        made = tuple(make_filter(f) for f in self.filters)
        return V2Pipeline(self.dtype, self.chunks, made, make_compressor(self.compressor, self.dtype))

    def key(self, place: tuple[int, ...]) -> str:
        return self.encoding.key(place)

    def resized(self, shape: tuple[int, ...]) -> ArrayMeta:
        if any(n < 0 for n in shape):
            raise ArgumentError(f"shape {shape} is negative")
        if len(shape) != self.rank:
            raise DimensionMismatch(f"{shape} has not {self.rank} axes")
        return replace(self, shape=tuple(shape))

    # ---- JSON

    def to_json(self) -> dict:
        fill = encode_fill(self.fill_value, self.dtype)
        if self.format == 2:
            return {
                "chunks": list(self.chunks), "compressor": self.compressor, "dtype": self.dtype.tag,
                "fill_value": fill, "filters": list(self.filters) or None, "node_type": "array", "order": "C",
                "shape": list(self.shape), formats.FORMAT_KEY: 2, "dimension_separator": self.encoding.separator,
            }
        out = {
            formats.FORMAT_KEY: 3, "node_type": "array", "shape": list(self.shape), "data_type": self.dtype.v3_name,
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.chunks)}},
            "chunk_key_encoding": self.encoding.to_json(), "fill_value": fill, "codecs": self.pipeline.to_json(),
            "attributes": self.attrs,
        }
        return out | ({"dimension_names": list(self.dimension_names)} if self.dimension_names else {})

    @classmethod
    def from_v2(cls, d: dict, attrs: dict | None = None) -> ArrayMeta:
        if d.get(formats.FORMAT_KEY) != 2:
            raise ArgumentError(f"format {d.get(formats.FORMAT_KEY)!r} is not 2")
        if d.get("order", "C") != "C":
            raise ArgumentError("only C order is stored in format 2")
        filters, compressor = list(d.get("filters") or ()), d.get("compressor")
        from .functions.codecs import COMPRESSORS
        from .functions.filters import FILTERS

        # older writers put the compressor last among the filters
        if compressor is None and filters and filters[-1].get("id") in COMPRESSORS and filters[-1].get("id") not in FILTERS:
            compressor = filters.pop()
        if not isinstance(d["dtype"], str):
            raise ArgumentError("structured types are not supported")
        kind = parse_v2(d["dtype"], bool(filters))
        if kind.is_object:
            item = next((f["dtype"] for f in filters if f.get("id") == "vlen-array"), "")
            kind = DType("|", "O", 0, item=item)
        return cls(
            tuple(d["shape"]), tuple(d["chunks"]), kind, decode_fill(d.get("fill_value"), kind), 2, compressor,
            tuple(filters), encoding=keys.parse({"name": "v2", "configuration": {"separator": d.get("dimension_separator") or "."}}),
            attrs=attrs or {},
        )

    @classmethod
    def from_v3(cls, d: dict) -> ArrayMeta:
        if d.get(formats.FORMAT_KEY) != 3:
            raise ArgumentError(f"format {d.get(formats.FORMAT_KEY)!r} is not 3")
        if d.get("node_type") != "array":
            raise ArgumentError(f"node type {d.get('node_type')!r} is not array")
        for k in formats.V3_ARRAY_REQUIRED:
            if k not in d:
                raise ArgumentError(f"{k} is missing")
        for k in d:
            if k not in formats.V3_ARRAY_REQUIRED + formats.V3_ARRAY_OPTIONAL:
                extra = d[k]
                if not (isinstance(extra, dict) and extra.get("must_understand") is False):
                    raise ArgumentError(f"{k} is not known")
        if d.get("storage_transformers"):
            raise ArgumentError("storage transformers are not supported")
        grid = d["chunk_grid"]
        if grid.get("name") != "regular":
            raise ArgumentError(f"chunk grid {grid.get('name')!r} is not known")
        shape, chunks = tuple(d["shape"]), tuple(grid["configuration"]["chunk_shape"])
        if len(shape) != len(chunks):
            raise DimensionMismatch(f"shape {shape} and chunks {chunks} differ in rank")
        names = d.get("dimension_names")
        if names is not None and len(names) != len(shape):
            raise DimensionMismatch(f"{names} does not name {len(shape)} axes")
        kind = parse_v3(d["data_type"])
        return cls(
            shape, chunks, kind, decode_fill(d["fill_value"], kind), 3, codecs=tuple(d["codecs"]),
            encoding=keys.parse(d["chunk_key_encoding"]), attrs=d.get("attributes") or {},
            dimension_names=tuple(names) if names else None,
        )


@dataclass(frozen=True)
class GroupMeta:
    format: int = formats.DEFAULT_FORMAT
    attrs: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        if self.format == 2:
            return {formats.FORMAT_KEY: 2}
        return {formats.FORMAT_KEY: 3, "node_type": "group", "attributes": self.attrs}

    @classmethod
    def from_v3(cls, d: dict) -> GroupMeta:
        for k in d:
            if k not in formats.V3_GROUP_KEYS:
                raise ArgumentError(f"{k} is not known in a group")
        if d.get("node_type") != "group":
            raise ArgumentError(f"node type {d.get('node_type')!r} is not group")
        return cls(3, d.get("attributes") or {})


def dumps(d: dict, indent: bool = False) -> bytes:
    return json.dumps(d, indent=4 if indent else None, separators=None if indent else (",", ":")).encode()


def loads(raw: bytes) -> dict:
    """JSON in which a bare NaN is a number."""
    return json.loads(raw)


def default_codecs(kind: DType, compressor: dict | None) -> tuple:
    """v3 codecs for a v2 style compressor."""
    from .functions.codecs import to_v3_compressor

    return (Bytes().to_v3(), *to_v3_compressor(make_compressor(compressor, kind)))
