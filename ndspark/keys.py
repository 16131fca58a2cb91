"""Chunk keys: where the chunk of a grid place is stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ArgumentError

REGISTRY: dict[str, Callable[[dict], KeyEncoding]] = {}


def register_key_encoding(name: str) -> Callable:
    """Register a maker of encodings: it takes the JSON configuration."""

    def put(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return put


@dataclass(frozen=True)
class KeyEncoding:
    """prefix: what stands before the numbers, and alone for a rank of zero."""

    name: str
    separator: str
    prefix: str = ""
    suffix: str = ""
    base: KeyEncoding | None = None

    def key(self, place: tuple[int, ...]) -> str:
        if self.base:
            return self.base.key(place) + self.suffix
        parts = ([self.prefix] if self.prefix else []) + [str(i) for i in place]
        return self.separator.join(parts if place else [*parts, "0"])

    def column(self, places: list[Column]) -> Column:
        """The key as a column, from columns of grid places."""
        if self.base:
            return F.concat(self.base.column(places), F.lit(self.suffix))
        parts = ([F.lit(self.prefix)] if self.prefix else []) + [p.cast("string") for p in places]
        return F.concat_ws(self.separator, *(parts if places else [*parts, F.lit("0")]))

    def to_json(self) -> dict:
        if self.base:
            return {"name": self.name, "configuration": {"suffix": self.suffix, "base-encoding": self.base.to_json()}}
        return {"name": self.name, "configuration": {"separator": self.separator}}


def _separator(conf: dict, default: str) -> str:
    sep = conf.get("separator", default)
    if sep not in ("/", "."):
        raise ArgumentError(f"{sep!r} can't separate chunk keys")
    return sep


@register_key_encoding("default")
def default_encoding(conf: dict) -> KeyEncoding:
    return KeyEncoding("default", _separator(conf, "/"), "c")


@register_key_encoding("v2")
def v2_encoding(conf: dict) -> KeyEncoding:
    return KeyEncoding("v2", _separator(conf, "."))


@register_key_encoding("suffix")
def suffix_encoding(conf: dict) -> KeyEncoding:
    base = parse(conf.get("base-encoding") or {"name": "default"})
    return KeyEncoding("suffix", base.separator, suffix=conf["suffix"], base=base)


def parse(spec: dict | str) -> KeyEncoding:
    spec = {"name": spec} if isinstance(spec, str) else spec
    if spec.get("name") not in REGISTRY:
        raise ArgumentError(f"chunk key encoding {spec.get('name')!r} is not known")
    return REGISTRY[spec["name"]](spec.get("configuration") or {})
