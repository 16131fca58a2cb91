"""Writing cells to chunks: one task owns a chunk, metadata comes last."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError, NotWriteable
from ..meta import ArrayMeta
from ..sources.array_source import Plan, load_chunk, same_bits
from ..sources.stores import Store, join


def chunk_number(meta: ArrayMeta) -> Column:
    """The place of a cell's chunk in the grid, as one number in C order."""
    out = F.lit(0).cast("bigint")
    for i, (n, c) in enumerate(zip(meta.grid, meta.chunks, strict=True)):
        out = out * F.lit(max(1, n)) + F.expr(f"d{i} div {c}")
    return out


def place_of(number: int, grid: tuple[int, ...]) -> tuple[int, ...]:
    out = []
    for n in reversed(grid):
        number, at = divmod(number, max(1, n))
        out.append(at)
    return tuple(reversed(out))


def blank_chunk(meta: ArrayMeta) -> np.ndarray:
    """A chunk of fill values; of zeros where there is no fill value."""
    out = np.empty(math.prod(meta.chunks), meta.dtype.numpy)
    one = meta.dtype.scalar(meta.dtype.zero() if meta.fill_value is None else meta.fill_value)
    if out.dtype == object:
        for i in range(len(out)):
            out[i] = one[0]
    else:
        out[:] = one[0]
    return out


def store_chunk(plan: Plan, place: tuple[int, ...], x: np.ndarray) -> bool:
    """Encode and put a chunk; one that is all fill is deleted instead. True if it is stored."""
    meta, key = plan.meta, join(plan.path, plan.meta.key(place))
    if meta.fill_value is not None and same_bits(x, meta.dtype.scalar(meta.fill_value)).all():
        plan.store.delete(key)
        return False
    plan.store.put(key, meta.pipeline.encode(x.reshape(meta.chunks)))
    return True


class _Chunk:
    """The chunk that a task is filling."""

    def __init__(self, plan: Plan, number: int):
        self.plan, self.place = plan, place_of(number, plan.meta.grid)
        self.cells = blank_chunk(plan.meta)
        self.seen = np.zeros(len(self.cells), bool)

    def add(self, at: np.ndarray, values: np.ndarray) -> None:
        self.cells[at] = values
        self.seen[at] = True

    def close(self) -> bool:
        """What no row covered keeps what is stored; a chunk that is covered is not read."""
        meta = self.plan.meta
        valid = [min(c, n - p * c) for p, c, n in zip(self.place, meta.chunks, meta.shape, strict=True)]
        if self.seen.sum() < math.prod(valid):
            old = load_chunk(self.plan, self.place)
            if old is not None:
                keep = ~self.seen
                self.cells[keep] = old.reshape(-1)[keep]
        return store_chunk(self.plan, self.place, self.cells)


def _write(plan: Plan):
    meta = plan.meta
    strides = [math.prod(meta.chunks[i + 1 :]) for i in range(meta.rank)]

    def run(batches: Iterator[pa.RecordBatch]):
        held, number, done, stored = None, -1, 0, 0
        for batch in batches:
            numbers = batch.column("chunk").to_numpy()
            if not len(numbers):
                continue
            at = np.zeros(len(numbers), np.int64)
            for i, (c, s) in enumerate(zip(meta.chunks, strides, strict=True)):
                at += batch.column(f"d{i}").to_numpy() % c * s
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(numbers)], strict=True):
                if held is None or numbers[lo] != number:
                    if held is not None:
                        stored, done = stored + held.close(), done + 1
                    number = int(numbers[lo])
                    held = _Chunk(plan, number)
                held.add(at[lo:hi], _values(meta, batch.column("value").slice(lo, hi - lo)))
        if held is not None:
            stored, done = stored + held.close(), done + 1
        yield pa.RecordBatch.from_pydict({"chunks": [done], "stored": [int(stored)]})

    return run


def _values(meta: ArrayMeta, column: pa.Array) -> np.ndarray:
    plain = column.type in (pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.float32(), pa.float64(), pa.bool_())
    if plain and meta.dtype.kind in "biuf":
        if not column.null_count:
            return column.to_numpy(zero_copy_only=False).astype(meta.dtype.numpy)
        if meta.fill_value is not None:
            out = column.fill_null(False if column.type == pa.bool_() else 0).to_numpy(zero_copy_only=False).astype(meta.dtype.numpy)
            out[column.is_null().to_numpy(zero_copy_only=False)] = meta.dtype.scalar(meta.fill_value)[0]
            return out
    values = column.to_pylist()
    if column.null_count:
        if meta.fill_value is None:
            raise ArgumentError("a null needs an array with a fill value")
        filled = [v is None for v in values]
        out = np.empty(len(values), meta.dtype.numpy)
        out[[i for i, f in enumerate(filled) if not f]] = meta.dtype.from_values([v for v in values if v is not None])
        for i in np.flatnonzero(filled):
            out[i] = meta.dtype.scalar(meta.fill_value)[0]
        return out
    return meta.dtype.from_values(values)


def write_cells(cells: DataFrame, store: Store, path: str, meta: ArrayMeta) -> dict[str, int]:
    """Write cells (d0.., value) into an array whose other cells stay as they are. One shuffle
    by chunk; of several rows for a cell any may count. Returns chunks touched and stored."""
    if not getattr(store, "writeable", True):
        raise NotWriteable(f"{type(store).__name__} is for reading")
    plan = Plan(store, path, meta, [])
    names = [f"d{i}" for i in range(meta.rank)]
    rows = cells.select(*[F.col(n).cast("bigint").alias(n) for n in names], "value")
    if names:
        inside = " and ".join(f"d{i} >= 0 and d{i} < {n}" for i, n in enumerate(meta.shape))
        rows = rows.select("*", F.when(F.expr(inside), chunk_number(meta)).otherwise(
            F.raise_error(F.lit("a cell lies outside the array"))).cast("bigint").alias("chunk"))
    else:
        rows = rows.withColumn("chunk", F.lit(0).cast("bigint"))
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk")
    if getattr(store, "local", False):  # a store in the driver's memory
        batches = (pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in part], _schema(meta)) for part in _chunked(dealt.orderBy("chunk").toLocalIterator()))
        done = [r for out in _write(plan)(batches) for r in out.to_pylist()]
    else:
        done = [r.asDict() for r in dealt.mapInArrow(_write(plan), "chunks long, stored long").collect()]
    return {k: sum(r[k] for r in done) for k in ("chunks", "stored")}


def _schema(meta: ArrayMeta) -> pa.Schema:
    return pa.schema([*((f"d{i}", pa.int64()) for i in range(meta.rank)), ("value", meta.dtype.arrow), ("chunk", pa.int64())])


def _chunked(rows, n: int = 1 << 14) -> Iterator[list]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def on_chunks(spark: SparkSession, store: Store, meta: ArrayMeta, apply, where: str = "true") -> None:
    """Run apply(place) for the places of a grid that a condition on p0.. selects."""
    if not meta.n_chunks:
        return
    grid, number = meta.grid, F.col("id")
    columns = []
    for i in reversed(range(meta.rank)):
        columns.append((number % grid[i]).alias(f"p{i}"))
        number = F.floor(number / grid[i])
    places = spark.range(meta.n_chunks).select("id", *reversed(columns)).where(where).select("id")
    if getattr(store, "local", False):
        for r in places.toLocalIterator():
            apply(place_of(r[0], grid))
        return

    def run(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                apply(place_of(n, grid))
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    places.mapInArrow(run, "n long").collect()


def zero_chunks(spark: SparkSession, store: Store, path: str, meta: ArrayMeta) -> None:
    """Put an encoded chunk of zeros at every key, unless zero is the fill value."""
    plan = Plan(store, path, meta, [])
    x = np.zeros(math.prod(meta.chunks), meta.dtype.numpy) if not meta.dtype.is_object else blank_chunk(meta)
    on_chunks(spark, store, meta, lambda place: store_chunk(plan, place, x))


def shrink(spark: SparkSession, store: Store, path: str, old: ArrayMeta, new: ArrayMeta) -> None:
    """Delete chunks that lie wholly outside the new shape, and blank the cells of the others
    that do, so that growing again shows fill values."""
    outside = " or ".join(f"p{i} >= {n}" for i, n in enumerate(new.grid)) or "false"
    edges = [f"p{i} = {n // c}" for i, (n, c, was) in enumerate(zip(new.shape, new.chunks, old.shape, strict=True)) if n < was and n % c]
    plan = Plan(store, path, new, [])

    def drop(place):
        if any(p >= n for p, n in zip(place, new.grid, strict=True)):
            store.delete(join(path, new.key(place)))
            return
        x = load_chunk(plan, place)
        if x is None:
            return
        kept = blank_chunk(new).reshape(new.chunks)
        at = tuple(slice(0, min(c, n - p * c)) for p, c, n in zip(place, new.chunks, new.shape, strict=True))
        kept[at] = x[at]
        store_chunk(plan, place, kept)

    on_chunks(spark, store, old, drop, " or ".join([outside, *edges]))
