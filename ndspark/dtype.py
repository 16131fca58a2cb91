"""Element types: tags of both formats, numpy layout, Spark type, fill values."""

from __future__ import annotations

import base64
import decimal
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .errors import ArgumentError

# v3 names of plain types and their v2 layout, and date units.
V3_NAMES = {
    "bool": "|b1", "int8": "|i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "|u1", "uint16": "<u2",
    "uint32": "<u4", "uint64": "<u8", "float16": "<f2", "float32": "<f4", "float64": "<f8", "complex64": "<c8",
    "complex128": "<c16",
}
UNITS = ("Y", "M", "W", "D", "h", "m", "s", "ms", "us", "ns", "ps", "fs", "as")
SPARK = {
    "b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int",
    "u4": "bigint", "u8": "decimal(20,0)", "i16": "decimal(38,0)", "u16": "decimal(38,0)", "f2": "float",
    "f4": "float", "f8": "double", "c4": "struct<re:double,im:double>", "c8": "struct<re:double,im:double>",
    "c16": "struct<re:double,im:double>",
}
ARROW = {
    "boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(),
    "decimal(20,0)": pa.decimal128(20, 0), "decimal(38,0)": pa.decimal128(38, 0), "float": pa.float32(),
    "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "date": pa.date32(),
    "timestamp_ntz": pa.timestamp("us"),
    "struct<re:double,im:double>": pa.struct([("re", pa.float64()), ("im", pa.float64())]),
}

_TAG = re.compile(r"([<>|])([biufcSUVMmO])(\d*)(?:\[(\w+)\])?")


@dataclass(frozen=True)
class DType:
    """order: byte order sign. kind and size: as in numpy. unit: of dates. item: the tag of a
    ragged array's items. raw: bits of a raw type in the v3 format."""

    order: str
    kind: str
    size: int
    unit: str = ""
    item: str = ""
    raw: int = 0

    @property
    def tag(self) -> str:
        if self.kind == "O":
            return "|O"
        if self.kind == "M":
            return f"{self.order}M8[{self.unit}]"
        return f"{self.order}{self.kind}{self.size}"

    @property
    def v3_name(self) -> str:
        if self.raw:
            return f"r{self.raw}"
        plain = self.tag.replace(">", "<")
        for name, tag in V3_NAMES.items():
            if tag == plain:
                return name
        if self.kind == "O" and not self.item:
            return "string"
        raise ArgumentError(f"type {self.tag} has no name in format 3")

    @property
    def is_object(self) -> bool:
        return self.kind == "O"

    @property
    def itemsize(self) -> int:
        return self.size * 4 if self.kind == "U" else self.size

    @property
    def numpy(self) -> np.dtype:
        """The layout of stored elements."""
        if self.kind == "O":
            return np.dtype(object)
        if self.kind in "iu" and self.size == 16 or self.kind == "c" and self.size == 4 or self.raw:
            return np.dtype(f"V{self.size}")
        if self.kind == "M":
            return np.dtype(f"{self.order}M8[{self.unit}]")
        return np.dtype(f"{self.order.replace('|', '<') if self.size > 1 and self.kind not in 'SV' else '|'}{self.kind}{self.size}")

    @property
    def spark(self) -> str:
        if self.item:
            return f"array<{parse_v2(self.item).spark}>"
        if self.kind in "OSU":
            return "string"
        if self.kind == "V" or self.raw:
            return "binary"
        if self.kind == "M":
            return "date" if self.unit in "DW" else "timestamp_ntz" if self.unit in ("h", "m", "s", "ms", "us") else "bigint"
        return SPARK[f"{self.kind}{self.size}"]

    @property
    def arrow(self) -> pa.DataType:
        return pa.list_(parse_v2(self.item).arrow) if self.item else ARROW[self.spark]

    def to_arrow(self, x: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        """Stored elements as an Arrow array of the Spark type."""
        x = np.ascontiguousarray(x).reshape(-1)
        if self.item:
            inner = parse_v2(self.item)
            return pa.array([None if v is None else inner.to_arrow(np.asarray(v)).to_pylist() for v in x], self.arrow, mask=missing)
        if self.kind == "O":
            return pa.array(["" if v is None else v for v in x], pa.string(), mask=missing)
        if self.kind in "SU":
            texts = [v.split(b"\0")[0].decode("latin-1") if isinstance(v, bytes) else v.split("\0")[0] for v in x.tolist()]
            return pa.array(texts, pa.string(), mask=missing)
        if self.spark == "binary":
            return pa.array([v.tobytes() for v in x], pa.binary(), mask=missing)
        if self.kind in "iu" and self.size == 16:
            order = "big" if self.order == ">" else "little"
            numbers = [int.from_bytes(v.tobytes(), order, signed=self.kind == "i") for v in x]
            if any(abs(n) >= 10**38 for n in numbers):
                raise ArgumentError("a 128-bit value has more than 38 digits")
            return pa.array([decimal.Decimal(n) for n in numbers], self.arrow, mask=missing)
        if self.kind == "u" and self.size == 8:
            return pa.array([decimal.Decimal(n) for n in x.tolist()], self.arrow, mask=missing)
        if self.kind == "c":
            pairs = x.view(np.dtype(f"{'>' if self.order == '>' else '<'}f{self.size // 2}")).reshape(-1, 2)
            parts = [pa.array(pairs[:, i].astype("f8")) for i in (0, 1)]
            made = pa.StructArray.from_arrays(parts, ["re", "im"])
            return made if missing is None else pa.array([None if m else v for v, m in zip(made.to_pylist(), missing, strict=True)], made.type)
        if self.kind == "M":
            if self.spark == "date":
                return pa.array(x.astype("M8[D]"), pa.date32(), mask=missing)
            if self.spark == "timestamp_ntz":
                return pa.array(x.astype("M8[us]"), pa.timestamp("us"), mask=missing)
            return pa.array(x.astype("M8[ns]" if self.unit == "ns" else x.dtype.newbyteorder("=")).view("i8"), pa.int64(), mask=missing)
        native = x.astype(x.dtype.newbyteorder("="))
        if self.kind == "f" and self.size == 2:
            native = native.astype("f4")
        return pa.array(native, mask=missing).cast(self.arrow)

    def from_values(self, values: list) -> np.ndarray:
        """Python values (no nulls), as they come from Spark, as stored elements."""
        if self.kind == "O":
            out = np.empty(len(values), object)
            for i, v in enumerate(values):
                out[i] = np.asarray(parse_v2(self.item).from_values(list(v))) if self.item else v
            return out
        if self.kind in "SU":
            for v in values:
                raw = v.encode("latin-1", "replace") if self.kind == "S" else v
                if len(raw) > self.size:
                    raise ArgumentError(f"{v!r} is longer than {self.size}")
            return np.array([v.encode("latin-1") if self.kind == "S" else v for v in values], self.numpy)
        if self.spark == "binary":
            return np.frombuffer(b"".join(bytes(v).ljust(self.size, b"\0") for v in values), self.numpy)
        if self.kind in "iu" and self.size == 16:
            order = "big" if self.order == ">" else "little"
            raw = b"".join(int(v).to_bytes(16, order, signed=self.kind == "i") for v in values)
            return np.frombuffer(raw, self.numpy)
        if self.kind == "c":
            half = f"{'>' if self.order == '>' else '<'}f{self.size // 2}"
            flat = np.array([[v["re"], v["im"]] if isinstance(v, dict) else [v[0], v[1]] if isinstance(v, tuple) else [complex(v).real, complex(v).imag] for v in values], half)
            return flat.reshape(-1).view(self.numpy)
        if self.kind == "M":
            return np.array(values, "M8[us]" if self.spark == "timestamp_ntz" else "M8[D]" if self.spark == "date" else "i8").astype(self.numpy if self.spark != "bigint" else "i8").view(self.numpy)
        if self.kind == "u" and self.size == 8:
            return np.array([int(v) for v in values], self.numpy)
        return np.array(values).astype(self.numpy)

    def zero(self):
        """The value of a type that an array without one is filled with."""
        return {"b": False, "S": "", "U": "", "O": [] if self.item else "", "f": 0.0}.get(self.kind, 0)

    def scalar(self, fill) -> np.ndarray:
        """One stored element."""
        if self.kind == "O":
            out = np.empty(1, object)
            out[0] = np.empty(0, parse_v2(self.item).numpy) if self.item and not fill else (fill or "")
            return out
        if self.kind == "M":
            return np.array([int(fill)], f"{self.order}i8").view(self.numpy)
        if self.kind == "c":
            if not isinstance(fill, (list, tuple)):
                fill = (complex(fill).real, complex(fill).imag)
            return self.from_values([tuple(fill)])
        if self.kind in "SU" and not isinstance(fill, str):
            fill = "" if fill == 0 else str(fill)
        if self.spark == "binary" and not isinstance(fill, (bytes, bytearray)):
            fill = bytes(self.size)
        return self.from_values([fill])


@lru_cache(maxsize=256)
def parse_v2(tag: str, filters_have_object: bool = True) -> DType:
    """A format 2 tag; ragged and text types need the filter that says how items are stored."""
    m = _TAG.fullmatch(tag)
    if not m:
        raise ArgumentError(f"{tag!r} is not a type")
    order, kind, size, unit = m[1], m[2], int(m[3] or 0), m[4] or ""
    if kind == "O":
        if not filters_have_object:
            raise ArgumentError("an object type needs a filter that stores items")
        return DType("|", "O", 0)
    if kind == "M":
        if size != 8 or unit not in UNITS:
            raise ArgumentError(f"{tag!r} is not a date type")
        return DType(order.replace("|", "<"), "M", 8, unit)
    valid = {"b": (1,), "i": (1, 2, 4, 8, 16), "u": (1, 2, 4, 8, 16), "f": (2, 4, 8), "c": (4, 8, 16)}
    if kind == "m" or unit or not size or kind in valid and size not in valid[kind]:
        raise ArgumentError(f"{tag!r} is not a supported type")
    if size == 1 and kind in "biu" or kind in "SV":
        order = "|"
    return DType(order, kind, size)


def parse_v3(name: str) -> DType:
    if not isinstance(name, str):
        raise ArgumentError(f"data type {name!r} is not supported")
    if name in V3_NAMES:
        return parse_v2(V3_NAMES[name])
    if name == "string":
        return DType("|", "O", 0)
    if m := re.fullmatch(r"r(\w+)", name):
        if not m[1].isdigit() or int(m[1]) % 8 or not int(m[1]):
            raise ArgumentError(f"raw type {name!r} needs a number of bits that 8 divides")
        return DType("|", "V", int(m[1]) // 8, raw=int(m[1]))
    raise ArgumentError(f"data type {name!r} is not supported")


def from_spark(kind: str) -> DType:
    """The element type that a Spark column is stored as by default."""
    plain = {
        "boolean": "|b1", "tinyint": "|i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4",
        "double": "<f8", "decimal(20,0)": "<u8", "decimal(38,0)": "<i16", "date": "<M8[D]",
        "timestamp_ntz": "<M8[us]", "struct<re:double,im:double>": "<c16",
    }
    if kind in plain:
        return parse_v2(plain[kind])
    if kind == "string":
        return DType("|", "O", 0)
    if m := re.fullmatch(r"array<(.+)>", kind):
        return DType("|", "O", 0, item=from_spark(m[1]).tag)
    raise ArgumentError(f"column type {kind} has no element type")


def from_numpy(kind: np.dtype) -> DType:
    if kind.kind == "O":
        return DType("|", "O", 0)
    if kind.kind == "M":
        return parse_v2(f"<M8[{np.datetime_data(kind)[0]}]")
    if kind.kind == "U":
        return parse_v2(f"<U{kind.itemsize // 4}")
    sign = "|" if kind.itemsize == 1 or kind.kind in "SV" else ">" if kind.byteorder == ">" else "<"
    return parse_v2(f"{sign}{kind.kind}{kind.itemsize}")


def encode_fill(fill, kind: DType):
    """A fill value as JSON."""
    if fill is None:
        return None
    if isinstance(fill, (bytes, bytearray)):
        return base64.b64encode(bytes(fill)).decode()
    if kind.kind == "c":
        parts = fill if isinstance(fill, (list, tuple)) else (complex(fill).real, complex(fill).imag)
        return [_float_json(float(p)) for p in parts]
    if isinstance(fill, (float, np.floating)):
        return _float_json(float(fill))
    if isinstance(fill, np.generic):
        return fill.item()
    return fill


def _float_json(x: float):
    return "NaN" if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity") if math.isinf(x) else x


def decode_fill(fill, kind: DType):
    """A fill value from JSON, as a Python value of the type."""
    if fill is None:
        return None
    if kind.kind in "SU":
        if fill == 0:
            return ""
        text = str(fill)
        return None if kind.kind == "S" and kind.size == 1 and text == "" else text
    if kind.kind == "O":
        return fill if kind.item or isinstance(fill, str) else ""
    if kind.spark == "binary":
        return base64.b64decode(fill) if isinstance(fill, str) else bytes(fill) if isinstance(fill, list) else bytes(kind.size)
    if kind.kind == "b":
        return bool(fill)
    if kind.kind == "c":
        parts = fill if isinstance(fill, list) else [fill, 0]
        return tuple(float(str(p).replace("Infinity", "inf")) for p in parts)
    if kind.kind == "f":
        return float(str(fill).replace("Infinity", "inf"))
    if kind.kind == "M":
        return int(np.iinfo("i8").min) if fill == "NaT" else int(fill)
    number = int(float(fill)) if isinstance(fill, str) and not re.fullmatch(r"[+-]?\d+", fill) else int(fill)
    if kind.kind == "u" and number < 0:  # the same bits, read as unsigned
        number += 1 << (8 * kind.size)
    return number
