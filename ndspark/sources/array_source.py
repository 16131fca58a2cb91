"""The Spark data source of chunked arrays: one row for each cell, chunks pruned by index.

Partitions are ranges of the chunks that a box touches, so planning costs the same for ten
chunks and for a billion. Comparisons of index columns with literals narrow the box.
"""

from __future__ import annotations

import base64
import itertools
import math
import pickle
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..errors import ArgumentError
from ..meta import ArrayMeta

NAME = "ndarray"
TASK_BYTES = 4 << 20  # decoded bytes that a task reads at least
MAX_TASKS = 100_000
BATCH_ROWS = 1 << 16
AHEAD_BYTES = 128 << 20  # decoded bytes that a task holds of chunks it has not given out yet


def pack(x) -> str:
    return base64.b64encode(pickle.dumps(x)).decode()


def unpack(x: str):
    return pickle.loads(base64.b64decode(x))


@dataclass
class Plan:
    """What a reader needs: the array, the box that is read (lo, hi per axis), how missing
    chunks and fill values come out. only: for some axes the indices that are read."""

    store: object
    path: str
    meta: ArrayMeta
    box: list[tuple[int, int]]
    fill_as_missing: bool = False
    dense: bool = True
    only: dict[int, tuple[int, ...]] = field(default_factory=dict)

    def chunk_ranges(self) -> list[range | list[int]]:
        """The chunks of each axis that the box touches."""
        out = []
        for axis, ((lo, hi), c) in enumerate(zip(self.box, self.meta.chunks, strict=True)):
            if axis in self.only:
                out.append(sorted({i // c for i in self.only[axis] if lo <= i < hi}))
            else:
                out.append(range(lo // c, -(-hi // c)) if hi > lo else range(0))
        return out


@dataclass
class Chunks(InputPartition):
    first: int
    last: int

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def ddl(meta: ArrayMeta) -> str:
    return ", ".join([f"d{i} bigint" for i in range(meta.rank)] + [f"value {meta.dtype.spark}"])


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _plan(self) -> Plan:
        if "plan" in self.options:
            return unpack(self.options["plan"])
        from ..operators.node import open_meta
        from .stores import open_store

        where, path = self.options.get("path", ""), self.options.get("array", "")
        store = open_store(where)
        meta = open_meta(store, path)
        if not isinstance(meta, ArrayMeta):
            raise ArgumentError(f"{where} {path} is a group")
        box = [(0, n) for n in meta.shape]
        missing = self.options.get("fillasmissing", "false").lower() == "true"
        return Plan(store, path, meta, box, missing, self.options.get("dense", "true").lower() == "true")

    def schema(self) -> str:
        return ddl(self._plan().meta)

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self._plan())


class ArrayReader(DataSourceReader):
    def __init__(self, plan: Plan):
        self.plan = plan

    def pushFilters(self, filters):
        for f in filters:
            self._narrow(f)
            yield f  # Spark keeps the filter for the cells inside the chunks

    def _narrow(self, f) -> None:
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
        if not (name[:1] == "d" and name[1:].isdigit() and int(name[1:]) < self.plan.meta.rank):
            return
        axis = int(name[1:])
        lo, hi = self.plan.box[axis]
        if isinstance(f, In):
            found = [int(v) for v in f.value if v is not None]
            lo, hi = (max(lo, min(found)), min(hi, max(found) + 1)) if found else (lo, lo)
            kept = self.plan.only.get(axis)
            self.plan.only[axis] = tuple(sorted(set(found) if kept is None else set(found) & set(kept)))
        elif getattr(f, "value", None) is None:
            return
        elif isinstance(f, EqualTo):
            lo, hi = max(lo, int(f.value)), min(hi, int(f.value) + 1)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            lo = max(lo, int(f.value) + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            hi = min(hi, int(f.value) + isinstance(f, LessThanOrEqual))
        self.plan.box[axis] = (lo, max(lo, hi))

    def partitions(self) -> list[Chunks]:
        ranges = self.plan.chunk_ranges()
        n = math.prod(map(len, ranges))
        each = math.prod(self.plan.meta.chunks) * max(1, self.plan.meta.dtype.itemsize)
        step = max(1, TASK_BYTES // max(1, each), -(-n // MAX_TASKS))
        return [Chunks(i, min(i + step, n)) for i in range(0, n, step)]

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        ranges = self.plan.chunk_ranges()

        def places():
            for i in range(partition.first, partition.last):
                place = []
                for r in reversed(ranges):
                    i, at = divmod(i, len(r))
                    place.append(r[at])
                yield tuple(reversed(place))

        for place, part, x in loaded(self.plan, places()):
            yield from give_cells(self.plan, place, part, x)


def same_bits(x: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Where elements are the fill value, bit by bit: NaN is itself, -0.0 is not 0.0."""
    if x.dtype == object:
        return np.array([np.array_equal(v, fill[0]) for v in x.reshape(-1)], bool)
    width = x.dtype.itemsize
    raw = np.ascontiguousarray(x).reshape(-1).view("u1").reshape(-1, width) if width else np.empty((x.size, 0))
    return (raw == fill.view("u1").reshape(1, width)).all(axis=1)


def load_chunk(plan: Plan, place: tuple[int, ...], box: list[tuple[int, int]] | None = None) -> np.ndarray | None:
    """A decoded chunk, None if it is not stored. With a box, a part of the chunk, of which a
    shard is read no further than needed."""
    key, meta = "/".join(x for x in (plan.path, plan.meta.key(place)) if x), plan.meta
    if box is not None and meta.format == 3 and meta.pipeline.reads_ranges and box != [(0, n) for n in meta.chunks]:
        return meta.pipeline.decode_ranges(lambda at, n: plan.store.get_range(key, at, n), box)
    raw = plan.store.get(key)
    if raw is None:
        return None
    if meta.format == 3 and box is not None:
        return meta.pipeline.decode(raw, box)
    return meta.pipeline.decode(raw)


def part_of(plan: Plan, place: tuple[int, ...]) -> list[tuple[int, int]]:
    """The part of a chunk that the box touches, counted from the chunk's corner."""
    meta = plan.meta
    return [
        (max(lo, p * c) - p * c, min(hi, p * c + c, n) - p * c)
        for (lo, hi), p, c, n in zip(plan.box, place, meta.chunks, meta.shape, strict=True)
    ]


def loaded(plan: Plan, places: Iterator[tuple[int, ...]]) -> Iterator[tuple]:
    """(place, part, chunk) in order, several reads under way at once where the store allows it,
    within AHEAD_BYTES."""
    parts = ((place, part_of(plan, place)) for place in places)
    wanted = ((place, part) for place, part in parts if all(hi > lo for lo, hi in part))
    each = math.prod(plan.meta.chunks) * max(8, plan.meta.dtype.itemsize)
    ahead = max(1, min(getattr(plan.store, "fetches", 1), AHEAD_BYTES // max(1, each)))
    if ahead == 1:
        for place, part in wanted:
            yield place, part, load_chunk(plan, place, part)
        return
    with ThreadPoolExecutor(ahead) as pool:
        held: deque = deque()
        try:
            for place, part in wanted:
                held.append((place, part, pool.submit(load_chunk, plan, place, part)))
                if len(held) >= ahead:
                    place, part, job = held.popleft()
                    yield place, part, job.result()
            while held:
                place, part, job = held.popleft()
                yield place, part, job.result()
        finally:
            for _, _, job in held:
                job.cancel()


def give_cells(plan: Plan, place: tuple[int, ...], part: list[tuple[int, int]], x: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    meta = plan.meta
    corner = [p * c for p, c in zip(place, meta.chunks, strict=True)]
    sizes = [hi - lo for lo, hi in part]
    if x is None:
        if not plan.dense:
            return
        if meta.fill_value is None:
            raise ArgumentError(f"chunk {meta.key(place)} is not stored, and the array has no fill value")
        cells = np.empty(math.prod(sizes), meta.dtype.numpy)
        cells[:] = meta.dtype.scalar(meta.fill_value)[0] if not meta.dtype.item else None
        if meta.dtype.item:
            for i in range(len(cells)):
                cells[i] = meta.dtype.scalar(meta.fill_value)[0]
    else:
        cells = x[tuple(slice(lo, hi) for lo, hi in part)].reshape(-1)
    names = [f"d{i}" for i in range(meta.rank)] + ["value"]
    for lo in range(0, len(cells), BATCH_ROWS):
        own = cells[lo : lo + BATCH_ROWS]
        flat = np.arange(lo, lo + len(own))
        index = np.unravel_index(flat, sizes) if sizes else ()
        columns = [pa.array(ix.astype("i8") + (at + a)) for ix, at, (a, _) in zip(index, corner, part, strict=True)]
        missing = None
        if plan.fill_as_missing and meta.fill_value is not None:
            missing = same_bits(own, meta.dtype.scalar(meta.fill_value))
        yield pa.RecordBatch.from_arrays([*columns, meta.dtype.to_arrow(own, missing)], names=names)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with index filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)


def all_places(ranges: list[range]) -> Iterator[tuple[int, ...]]:
    return itertools.product(*ranges)
