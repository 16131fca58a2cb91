"""An N-dimensional array as a DataFrame (d0, .., dN-1, value) with metadata.

Slices are filters that prune chunks, elementwise functions are projections, broadcasts are
equi-joins on the shared axes, reductions are group-bys. All are lazy; Catalyst fuses them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dtype as dt
from .. import keys
from ..errors import ArgumentError, DimensionMismatch, NotWriteable
from ..meta import ArrayMeta, default_codecs
from ..sources.array_source import NAME, Plan, ddl, pack, register
from ..sources.stores import MemoryStore, Store, check_path, join, open_store
from .node import check_empty, open_meta, write_meta
from .sink import chunk_number, shrink, write_cells, zero_chunks

BROADCAST_CELLS = 1 << 20
DEFAULT_COMPRESSOR = {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
}


def axis_names(rank: int) -> list[str]:
    return [f"d{i}" for i in range(rank)]


def c_order(shape: tuple[int, ...]) -> Column:
    """A cell's position when the array is read in C order."""
    out = F.lit(0).cast("bigint")
    for i, n in enumerate(shape):
        out = out * F.lit(n) + F.col(f"d{i}")
    return out


def from_c_order(position: Column, shape: tuple[int, ...]) -> list[Column]:
    out = []
    for i, n in enumerate(shape):
        below = math.prod(shape[i + 1 :])
        at = F.floor(position / F.lit(below)).cast("bigint")
        out.append((at if i == 0 else at % F.lit(max(1, n))).alias(f"d{i}"))
    return out


def cells_of_numpy(spark: SparkSession, x: np.ndarray, meta: ArrayMeta) -> DataFrame | None:
    """(d0.., value) of values in memory, masked ones null; None if there are none."""
    masked = np.ma.getmaskarray(x).reshape(-1) if np.ma.isMaskedArray(x) else None
    flat = np.ascontiguousarray(np.ma.getdata(x)).reshape(-1)
    if not flat.size:
        return None
    index = np.unravel_index(np.arange(flat.size), x.shape) if x.ndim else ()
    like = dt.from_numpy(flat.dtype) if flat.dtype != object else meta.dtype
    columns = [pa.array(i.astype("i8")) for i in index] + [like.to_arrow(flat, masked)]
    cells = spark.createDataFrame(pa.table(columns, names=[*axis_names(x.ndim), "value"]))
    return cells.withColumn("value", F.col("value").cast(meta.dtype.spark))


@dataclass(frozen=True)
class ArrayFrame:
    """df has a bigint column for each axis, and value. store and path are set for an array
    that is stored; its df then reads the store."""

    df: DataFrame
    meta: ArrayMeta
    store: Store | None = None
    path: str = ""
    writeable: bool = False
    fill_as_missing: bool = False

    # ---- making

    @classmethod
    def open(cls, spark: SparkSession, where, path: str = "", mode: str = "r", fill_as_missing: bool = False, **options) -> ArrayFrame:
        if options.get("lru"):
            raise ArgumentError("there is no cache by that option; use persist() or a CachingStore")
        store, path = open_store(where), check_path(path)
        meta = open_meta(store, path, options.get("format"))
        if not isinstance(meta, ArrayMeta):
            raise ArgumentError(f"{path!r} is a group")
        return cls.of_store(spark, store, path, meta, mode in ("w", "r+", "a"), fill_as_missing)

    @classmethod
    def of_store(cls, spark, store, path, meta, writeable=False, fill_as_missing=False, box=None, dense=True) -> ArrayFrame:
        register(spark)
        plan = Plan(store, path, meta, box or [(0, n) for n in meta.shape], fill_as_missing, dense)
        df = spark.read.format(NAME).schema(ddl(meta)).option("plan", pack(plan)).load()
        return cls(df, meta, store, path, writeable, fill_as_missing)

    @classmethod
    def create(
        cls, spark: SparkSession, kind: str, shape: tuple[int, ...], where=None, path: str = "",
        chunks: tuple[int, ...] | None = None, fill_value=None, fill_as_missing: bool = False, compressor="default",
        filters: list[dict] | None = None, codecs: list[dict] | None = None, attrs: dict | None = None,
        format: int = 2, dimension_separator: str | None = None, key_encoding: dict | None = None,
        writeable: bool = True, indent: bool = False, first: Callable[[Store, str, ArrayMeta], object] | None = None,
    ) -> ArrayFrame:
        """An empty array: metadata only. kind is a tag of either format; text and ragged types
        get the filter they need. Without `where` it lives in the driver's memory. `first` is
        called before the metadata is written, to write chunks that are there once it is."""
        store, path = MemoryStore() if where is None else open_store(where), check_path(path)
        item = ""
        if kind.startswith("array<"):
            kind, item = "|O", kind[6:-1]
        made = dt.parse_v3(kind) if kind in dt.V3_NAMES or kind == "string" or kind[:1] == "r" else dt.parse_v2(kind)
        made = replace(made, item=item) if item else made
        if made.is_object and filters is None:
            filters = [{"id": "vlen-array", "dtype": item} if item else {"id": "vlen-utf8"}]
        compressor = DEFAULT_COMPRESSOR if compressor == "default" else compressor
        if format == 2:
            separator = dimension_separator or "."
            encoding = keys.parse({"name": "v2", "configuration": {"separator": separator}})
        else:
            encoding = keys.parse(key_encoding or {"name": "default", "configuration": {"separator": dimension_separator or "/"}})
        chunks = tuple(chunks) if chunks is not None else tuple(max(1, n) for n in shape)
        if len(chunks) != len(shape):
            raise DimensionMismatch(f"shape {shape} and chunks {chunks} differ in rank")
        meta = ArrayMeta(
            tuple(shape), chunks, made, fill_value, format, compressor if format == 2 else None, tuple(filters or ()) if format == 2 else (),
            tuple(codecs) if codecs else default_codecs(made, compressor) if format == 3 else ArrayMeta.codecs,
            encoding, attrs or {},
        )
        if format == 3 and filters:
            raise ArgumentError("format 3 has codecs, not filters")
        check_empty(store, path)
        if first:
            first(store, path, meta)
        write_meta(store, path, meta, indent)
        return cls.of_store(spark, store, path, meta, writeable, fill_as_missing)

    @classmethod
    def zeros(cls, spark: SparkSession, kind: str, shape: tuple[int, ...], where=None, path: str = "", **options) -> ArrayFrame:
        return cls.create(spark, kind, shape, where, path, first=lambda store, at, meta: zero_chunks(spark, store, at, meta), **options)

    @classmethod
    def from_numpy(cls, spark: SparkSession, x: np.ndarray, where=None, path: str = "", **options) -> ArrayFrame:
        """A stored array from values in memory; the type is theirs. Dates keep their unit."""
        ragged = x.dtype == object and x.size and not isinstance(x.reshape(-1)[0], str)
        if ragged:
            kind = f"array<{dt.from_numpy(np.asarray(x.reshape(-1)[0]).dtype).tag}>"
        else:
            kind = dt.from_numpy(x.dtype).tag

        def fill(store, at, meta):
            if (cells := cells_of_numpy(spark, x, meta)) is not None:
                write_cells(cells, store, at, meta)

        return cls.create(spark, kind, x.shape, where, path, first=fill, **options)

    @classmethod
    def of_cells(cls, df: DataFrame, shape: tuple[int, ...], chunks: tuple[int, ...] | None = None, fill_value=None) -> ArrayFrame:
        """A DataFrame (d0.., value) as an array; the type follows the column's."""
        kind = dt.from_spark(dict(df.dtypes)["value"])
        filters = ({"id": "vlen-array", "dtype": kind.item},) if kind.item else ({"id": "vlen-utf8"},) if kind.is_object else ()
        meta = ArrayMeta(tuple(shape), tuple(chunks or (max(1, n) for n in shape)), kind, fill_value, filters=filters)
        return cls(df.select(*[F.col(n).cast("bigint").alias(n) for n in axis_names(len(shape))], "value"), meta)

    # ---- describing

    @property
    def shape(self) -> tuple[int, ...]:
        return self.meta.shape

    @property
    def rank(self) -> int:
        return self.meta.rank

    @property
    def axes(self) -> list[str]:
        return axis_names(self.rank)

    def length(self, axis: int) -> int:
        """The length of an axis; 1 beyond the last, as for a singleton."""
        if axis < 0:
            raise ArgumentError(f"axis {axis} is negative")
        return self.shape[axis] if axis < self.rank else 1

    def __len__(self) -> int:
        return self.meta.size

    def __repr__(self) -> str:
        where = f" at {self.path or '/'}" if self.store is not None else ""
        return f"ArrayFrame({self.meta.dtype.tag} {' x '.join(map(str, self.shape)) or 'scalar'}{where})"

    def chunk_grid(self) -> DataFrame:
        """(chunk, p0.., lo0, hi0, ..): every chunk and the cells that it holds."""
        spark = self.df.sparkSession
        grid, number, columns = self.meta.grid, F.col("id"), []
        for i in reversed(range(self.rank)):
            columns.append((number % max(1, grid[i])).alias(f"p{i}"))
            number = F.floor(number / max(1, grid[i]))
        rows = spark.range(self.meta.n_chunks).select(F.col("id").alias("chunk"), *reversed(columns))
        for i, (n, c) in enumerate(zip(self.shape, self.meta.chunks, strict=True)):
            rows = rows.withColumn(f"lo{i}", F.col(f"p{i}") * c).withColumn(f"hi{i}", F.least(F.col(f"lo{i}") + c, F.lit(n)))
        return rows

    def chunks_touched(self, *box: tuple[int, int]) -> DataFrame:
        """(chunk, p0.., lo0, hi0, ..) of the chunks that a read of a box, (lo, hi) for each axis,
        would fetch."""
        rows = self.chunk_grid()
        for i, (lo, hi) in enumerate(box):
            rows = rows.where((F.col(f"lo{i}") < hi) & (F.col(f"hi{i}") > lo))
        return rows

    # ---- slicing

    def slice(self, *ranges) -> ArrayFrame:
        """A box. Each axis takes (lo, hi), a slice without a step, an index (which drops the
        axis) or None for all of it. What is left starts at 0 again."""
        if len(ranges) > self.rank:
            raise DimensionMismatch(f"{len(ranges)} ranges for {self.rank} axes")
        box, dropped = [], []
        for i, n in enumerate(self.shape):
            r = ranges[i] if i < len(ranges) else None
            if isinstance(r, (int, np.integer)):
                r = int(r) + n if r < 0 else int(r)
                if not 0 <= r < n:
                    raise ArgumentError(f"index {r} lies outside axis {i} of {n}")
                dropped.append(i)
                r = (r, r + 1)
            elif isinstance(r, slice):
                if r.step not in (None, 1):
                    raise ArgumentError("a box has no step")
                r = r.indices(n)[:2]
            lo, hi = (0, n) if r is None else r
            if not 0 <= lo <= hi <= n:
                raise ArgumentError(f"{(lo, hi)} lies outside axis {i} of {n}")
            box.append((lo, hi))
        df = self.df
        if self.store is not None:
            df = self.of_store(df.sparkSession, self.store, self.path, self.meta, False, self.fill_as_missing, box).df
        else:
            for i, (lo, hi) in enumerate(box):
                if (lo, hi) != (0, self.shape[i]):
                    df = df.where((F.col(f"d{i}") >= lo) & (F.col(f"d{i}") < hi))
        kept = [i for i in range(self.rank) if i not in dropped]
        moved = [(F.col(f"d{i}") - F.lit(box[i][0])).alias(f"d{k}") for k, i in enumerate(kept)]
        return self._lazy(df.select(*moved, "value"), tuple(box[i][1] - box[i][0] for i in kept), tuple(self.meta.chunks[i] for i in kept))

    def __getitem__(self, item) -> ArrayFrame:
        return self.slice(*(item if isinstance(item, tuple) else (item,)))

    def stored_cells(self) -> DataFrame:
        """Cells of stored chunks alone."""
        if self.store is None:
            return self.df
        return self.of_store(self.df.sparkSession, self.store, self.path, self.meta, dense=False).df

    def _lazy(self, df: DataFrame, shape, chunks=None, kind: str | None = None) -> ArrayFrame:
        value = kind or dict(df.dtypes)["value"]
        same = value == self.meta.dtype.spark
        made = self.meta.dtype if same else dt.from_spark(value)
        filters = self.meta.filters if same else ()
        if made.is_object and not filters:
            filters = ({"id": "vlen-array", "dtype": made.item},) if made.item else ({"id": "vlen-utf8"},)
        meta = ArrayMeta(tuple(shape), tuple(chunks or (max(1, n) for n in shape)), made, self.meta.fill_value if same and self.meta.format == 2 else None,
                         filters=tuple(f for f in filters if str(f.get("id")).startswith("vlen")))
        return ArrayFrame(df, meta)

    # ---- algebra

    def map(self, f: Callable[[Column], Column]) -> ArrayFrame:
        """An elementwise function, of a column."""
        return self._lazy(self.df.select(*self.axes, f(F.col("value")).alias("value")), self.shape, self.meta.chunks)

    def combine(self, other: ArrayFrame, f: Callable[[Column, Column], Column]) -> ArrayFrame:
        """An elementwise function of two arrays, axes of length 1 standing for any length; ranks
        are aligned at the last axis. A small side, by its shape, is broadcast."""
        rank = max(self.rank, other.rank)
        pads = [rank - x.rank for x in (self, other)]
        shapes = [(1,) * p + x.shape for p, x in zip(pads, (self, other), strict=True)]
        if any(a != b and 1 not in (a, b) for a, b in zip(*shapes, strict=True)):
            raise DimensionMismatch(f"shapes {self.shape} and {other.shape} do not fit")
        sides = []
        for x, pad, tag in ((self, pads[0], "l"), (other, pads[1], "r")):
            cols = [F.col(f"d{i}").alias(f"{tag}{i + pad}") for i in range(x.rank)]
            sides.append(x.df.select(*cols, F.col("value").alias(f"{tag}v")))
        on = [F.col(f"l{i}") == F.col(f"r{i}") for i in range(rank) if i >= max(pads) and shapes[0][i] == shapes[1][i]]
        # only shapes are looked at: cells of a sparse frame are fewer, never more
        sides = [F.broadcast(s) if len(x) <= BROADCAST_CELLS else s for s, x in zip(sides, (self, other), strict=True)]
        condition = fold(lambda a, b: a & b, on) if on else F.lit(True)
        joined = sides[0].join(sides[1], condition)
        axes = []
        for i in range(rank):
            left = i >= pads[0] and (shapes[0][i] != 1 or shapes[1][i] == 1 and i >= pads[0])
            axes.append(F.col(f"l{i}" if left else f"r{i}").alias(f"d{i}"))
        shape = tuple(b if a == 1 else a for a, b in zip(*shapes, strict=True))
        return self._lazy(joined.select(*axes, f(F.col("lv"), F.col("rv")).alias("value")), shape)

    def reduce(self, how: str | Callable[[Column], Column], axes: list[int] | None = None, keepdims: bool = False) -> ArrayFrame:
        """Reduce over axes (all of them if None): partial results by task, then merged."""
        gone = list(range(self.rank)) if axes is None else sorted(axes)
        if any(not 0 <= a < self.rank for a in gone):
            raise ArgumentError(f"axes {axes} of an array of rank {self.rank}")
        f = REDUCERS[how] if isinstance(how, str) else how
        kept = [i for i in range(self.rank) if i not in gone]
        made = self.df.groupBy(*[f"d{i}" for i in kept]).agg(f(F.col("value")).alias("value"))
        if keepdims:
            cols = [F.lit(0).cast("bigint").alias(f"d{i}") if i in gone else F.col(f"d{i}") for i in range(self.rank)]
            shape = tuple(1 if i in gone else n for i, n in enumerate(self.shape))
        else:
            cols = [F.col(f"d{i}").alias(f"d{k}") for k, i in enumerate(kept)]
            shape = tuple(self.shape[i] for i in kept)
        return self._lazy(made.select(*cols, "value"), shape)

    def weighted_mean(self, weights: ArrayFrame, axes: list[int]) -> ArrayFrame:
        """Sum of weight times value over sum of weights, in one aggregate."""
        both = self.combine(weights, lambda x, w: F.struct((x.cast("double") * w).alias("re"), w.cast("double").alias("im")))
        return both.reduce(lambda v: F.sum(v["re"]) / F.sum(v["im"]), axes)

    def transpose(self, order: list[int] | None = None) -> ArrayFrame:
        order = list(range(self.rank))[::-1] if order is None else list(order)
        if sorted(order) != list(range(self.rank)):
            raise ArgumentError(f"{order} does not order {self.rank} axes")
        cols = [F.col(f"d{i}").alias(f"d{k}") for k, i in enumerate(order)]
        return self._lazy(self.df.select(*cols, "value"), tuple(self.shape[i] for i in order), tuple(self.meta.chunks[i] for i in order))

    def reshape(self, shape: tuple[int, ...]) -> ArrayFrame:
        if math.prod(shape) != len(self):
            raise DimensionMismatch(f"{self.shape} has not the cells of {shape}")
        return self._lazy(self.df.select(*from_c_order(c_order(self.shape), tuple(shape)), "value"), shape)

    def ravel(self) -> DataFrame:
        """(position, value) in C order."""
        return self.df.select(c_order(self.shape).alias("position"), "value")

    def concat(self, other: ArrayFrame, axis: int) -> ArrayFrame:
        """Joined along an axis; an axis beyond the rank is a new one in front."""
        if axis >= self.rank or axis < 0:
            if self.shape != other.shape:
                raise DimensionMismatch(f"{self.shape} and {other.shape} differ")
            parts = []
            for k, x in enumerate((self, other)):
                cols = [F.lit(k).cast("bigint").alias("d0")] + [F.col(f"d{i}").alias(f"d{i + 1}") for i in range(x.rank)]
                parts.append(x.df.select(*cols, "value"))
            return self._lazy(parts[0].unionByName(parts[1]), (2, *self.shape))
        if self.rank != other.rank or any(a != b for i, (a, b) in enumerate(zip(self.shape, other.shape, strict=True)) if i != axis):
            raise DimensionMismatch(f"{self.shape} and {other.shape} do not join along axis {axis}")
        moved = other.df.withColumn(f"d{axis}", F.col(f"d{axis}") + F.lit(self.shape[axis]))
        shape = tuple(n + (other.shape[i] if i == axis else 0) for i, n in enumerate(self.shape))
        return self._lazy(self.df.unionByName(moved), shape, self.meta.chunks)

    def assigned(self, value, *ranges) -> ArrayFrame:
        """A box set to a value, or to null."""
        box = [(0, n) if i >= len(ranges) or ranges[i] is None else tuple(ranges[i]) for i, n in enumerate(self.shape)]
        inside = F.lit(True)
        for i, (lo, hi) in enumerate(box):
            inside = inside & (F.col(f"d{i}") >= lo) & (F.col(f"d{i}") < hi)
        set_to = F.lit(value).cast(self.meta.dtype.spark)
        return self._lazy(self.df.withColumn("value", F.when(inside, set_to).otherwise(F.col("value"))), self.shape, self.meta.chunks)

    def resized(self, shape: tuple[int, ...], fill=None) -> ArrayFrame:
        """Cut, and filled out where it grows."""
        self.meta.resized(tuple(shape))
        inside = fold(lambda a, b: a & b, [F.col(f"d{i}") < n for i, n in enumerate(shape)], F.lit(True))
        df = self.df.where(inside)
        if any(n > was for n, was in zip(shape, self.shape, strict=True)):
            grid = self.df.sparkSession.range(math.prod(shape)).select(*from_c_order(F.col("id"), tuple(shape)))
            fill = self.meta.fill_value if fill is None else fill
            cells = df.select(*self.axes, F.struct("value").alias("v"))
            df = grid.join(cells, self.axes, "left").select(
                *self.axes, F.when(F.col("v").isNull(), F.lit(fill).cast(self.meta.dtype.spark)).otherwise(F.col("v.value")).alias("value")
            )
        return self._lazy(df, shape, self.meta.chunks)

    def dense(self, fill=None) -> ArrayFrame:
        """Cells that have no row, as the fill value."""
        return replace(self.resized_grid(fill))

    def resized_grid(self, fill) -> ArrayFrame:
        grid = self.df.sparkSession.range(len(self)).select(*from_c_order(F.col("id"), self.shape))
        fill = self.meta.fill_value if fill is None else fill
        joined = grid.join(self.df, self.axes, "left").withColumn("value", F.coalesce("value", F.lit(fill).cast(self.meta.dtype.spark)))
        return self._lazy(joined, self.shape, self.meta.chunks)

    def missing(self, fill=None) -> ArrayFrame:
        """Fill values as nulls."""
        fill = self.meta.fill_value if fill is None else fill
        return self._lazy(self.df.withColumn("value", F.nullif("value", F.lit(fill).cast(self.meta.dtype.spark))), self.shape, self.meta.chunks)

    def differs(self, other: ArrayFrame) -> DataFrame:
        """Cells in which two arrays differ: none if they are equal."""
        if self.shape != other.shape:
            raise DimensionMismatch(f"{self.shape} and {other.shape} differ")
        a = self.df.select(*self.axes, F.col("value").alias("a"), F.lit(True).alias("in_a"))
        b = other.df.select(*self.axes, F.col("value").alias("b"), F.lit(True).alias("in_b"))
        both = a.join(b, self.axes, "full") if self.axes else a.crossJoin(b)
        return both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("a").eqNullSafe(F.col("b")))

    # ---- writing

    def _own(self) -> tuple[Store, str]:
        if self.store is None:
            raise ArgumentError("the array is not stored")
        if not self.writeable or not getattr(self.store, "writeable", True):
            raise NotWriteable(f"{self.path!r} was opened for reading")
        return self.store, self.path

    def reopened(self, meta: ArrayMeta | None = None) -> ArrayFrame:
        return self.of_store(self.df.sparkSession, self.store, self.path, meta or self.meta, self.writeable, self.fill_as_missing)

    def write(self, cells: DataFrame, offset: tuple[int, ...] | None = None) -> ArrayFrame:
        """Write cells into the stored array, moved by an offset; other cells stay."""
        store, path = self._own()
        for i, o in enumerate(offset or ()):
            cells = cells.withColumn(f"d{i}", F.col(f"d{i}") + F.lit(o))
        write_cells(cells, store, path, self.meta)
        return self.reopened()

    def write_numpy(self, x: np.ndarray, offset: tuple[int, ...] | None = None) -> ArrayFrame:
        cells = cells_of_numpy(self.df.sparkSession, x, self.meta)
        return self if cells is None else self.write(cells, offset)

    def fill_box(self, value, *ranges) -> ArrayFrame:
        """Set a box of the stored array to a value."""
        box = [(0, n) if i >= len(ranges) or ranges[i] is None else tuple(ranges[i]) for i, n in enumerate(self.shape)]
        sizes = tuple(hi - lo for lo, hi in box)
        cells = self.df.sparkSession.range(math.prod(sizes)).select(*from_c_order(F.col("id"), sizes), F.lit(value).cast(self.meta.dtype.spark).alias("value"))
        return self.write(cells, tuple(lo for lo, _ in box))

    def resize(self, *shape: int) -> ArrayFrame:
        """Change the stored array's shape; see shrink() for what is cut off. The metadata goes
        first, so that a failure in between leaves chunks that no reader looks at, and no cell of
        the array is lost; resizing to the same shape again does not clear them, trim() does."""
        store, path = self._own()
        new = self.meta.resized(tuple(shape))
        write_meta(store, path, new)
        if any(n < was for n, was in zip(new.shape, self.shape, strict=True)):
            shrink(self.df.sparkSession, store, path, self.meta, new)
        return self.reopened(new)

    def trim(self, was: tuple[int, ...]) -> ArrayFrame:
        """Clear what lies outside the array's shape but inside an older one, as a failed append
        or resize may have left it."""
        store, path = self._own()
        outer = tuple(max(a, b) for a, b in zip(was, self.shape, strict=True))
        shrink(self.df.sparkSession, store, path, self.meta.resized(outer), self.meta)
        return self.reopened()

    def append(self, other: ArrayFrame | np.ndarray, axis: int = 0) -> ArrayFrame:
        """Grow along an axis by another array, or by one of a rank less as a single entry. Cells
        are written first and the metadata last: after a failure in between the array is what it
        was, and appending again writes the same cells."""
        shape = tuple(other.shape)
        if len(shape) == self.rank - 1:
            shape = shape[:axis] + (1,) + shape[axis:]
        if len(shape) != self.rank or any(a != b for i, (a, b) in enumerate(zip(shape, self.shape, strict=True)) if i != axis):
            raise DimensionMismatch(f"{tuple(other.shape)} does not append to {self.shape} along axis {axis}")
        store, path = self._own()
        new = self.meta.resized(tuple(n + (shape[axis] if i == axis else 0) for i, n in enumerate(self.shape)))
        if isinstance(other, ArrayFrame):
            cells = other.df
            if other.rank == self.rank - 1:
                cols = [F.lit(0).cast("bigint").alias(f"d{i}") if i == axis else F.col(f"d{i - (i > axis)}").alias(f"d{i}") for i in range(self.rank)]
                cells = cells.select(*cols, "value")
        else:
            cells = cells_of_numpy(self.df.sparkSession, np.asarray(other).reshape(shape), new)
        if cells is not None:
            write_cells(cells.withColumn(f"d{axis}", F.col(f"d{axis}") + F.lit(self.shape[axis])), store, path, new)
        write_meta(store, path, new)
        return self.reopened(new)

    def with_attrs(self, **attrs) -> ArrayFrame:
        """Change attributes of the stored array; None takes one away."""
        store, path = self._own()
        kept = {k: v for k, v in (self.meta.attrs | attrs).items() if v is not None}
        meta = replace(self.meta, attrs=kept)
        write_meta(store, path, meta)
        return self.reopened(meta)

    def save(self, where, path: str = "", **options) -> ArrayFrame:
        """Store the array elsewhere; type, fill value and chunks as they are unless given."""
        m = self.meta
        kind = f"array<{m.dtype.item}>" if m.dtype.item else m.dtype.tag if not m.dtype.raw else m.dtype.v3_name
        defaults = {"chunks": m.chunks, "fill_value": m.fill_value, "attrs": m.attrs}
        fill = lambda store, at, meta: write_cells(self.df, store, at, meta)
        return self.create(self.df.sparkSession, kind, m.shape, where, path, first=fill, **(defaults | options))

    # ---- reading out

    def to_numpy(self) -> np.ndarray | np.ma.MaskedArray:
        """All cells on the driver; nulls masked."""
        rows = self.df.select(c_order(self.shape).alias("position"), "value").collect()
        kind = self.meta.dtype
        out = np.ma.masked_all(len(self), kind.numpy) if kind.numpy != object else np.empty(len(self), object)
        full = [r for r in rows if r["value"] is not None]
        if full:
            at = [r["position"] for r in full]
            values = kind.from_values([r["value"] for r in full])
            if out.dtype == object:
                for i, v in zip(at, values, strict=True):
                    out[i] = v
            else:
                out[at] = values
        out = out.reshape(self.shape)
        return out if out.dtype == object or np.ma.getmaskarray(out).any() else np.asarray(out.data if np.ma.isMaskedArray(out) else out)

    # ---- size

    def storage_size(self) -> int:
        store, _ = self.store, self.path
        return store.size(self.path)

    def nbytes(self) -> int | None:
        """Bytes of the cells; None where they differ in length."""
        return None if self.meta.dtype.is_object else len(self) * self.meta.dtype.itemsize

    def info(self) -> DataFrame:
        """One row that describes the stored array."""
        m, total, stored, done = self.meta, self.nbytes(), 0, 0
        for key, n in self.store.walk(self.path):
            if self._is_chunk(key):
                stored, done = stored + n, done + 1
        row = {
            "type": "array", "element_type": m.dtype.tag, "shape": list(m.shape), "chunks": list(m.chunks), "order": "C",
            "read_only": not self.writeable, "compressor": str(m.compressor) if m.format == 2 else str([c.get("name") for c in m.pipeline.to_json()]),
            "filters": str([f["id"] for f in m.filters]) if m.filters else None, "store_type": type(self.store).__name__,
            "n_bytes": total, "storage_size": stored, "storage_ratio": total / stored if total and stored else None,
            "chunks_initialized": f"{done}/{m.n_chunks}",
        }
        schema = (
            "type string, element_type string, shape array<bigint>, chunks array<bigint>, order string, read_only boolean, compressor string, "
            "filters string, store_type string, n_bytes bigint, storage_size bigint, storage_ratio double, chunks_initialized string"
        )
        return self.df.sparkSession.createDataFrame([tuple(row.values())], schema)

    def _is_chunk(self, key: str) -> bool:
        from .. import formats

        return key.rpartition("/")[2] not in formats.METADATA_NAMES

    def with_chunk(self) -> DataFrame:
        """Cells with the number and the key of their chunk."""
        places = [F.expr(f"d{i} div {c}") for i, c in enumerate(self.meta.chunks)]
        return self.df.withColumn("chunk", chunk_number(self.meta)).withColumn("key", self.meta.encoding.column(places))

    @property
    def location(self) -> str:
        return join(self.path, "")
