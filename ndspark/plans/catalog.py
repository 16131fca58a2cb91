"""Registered queries of the array engine and the SQL each must equal.

The test tables' keys are dense and start at 0, so they are axes: E is embeddings by vector and
component, V and U the events' values and users by event, O the orders' prices, L the labels
over all documents, with gaps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import keys
from ..errors import NotWriteable
from ..functions import expressions as ex
from ..operators.frame import ArrayFrame
from ..operators.group import Group, cached_array, open_node
from ..sources.scratch import scratch
from ..sources.stores import FileStore, HttpStore, MemoryStore, ZipStore, open_store, serve, write_zip

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extent(df: DataFrame, axis: str) -> int:
    """The length of an axis: from one column, by partial aggregates."""
    top = df.agg(F.max(axis)).first()[0]
    return 0 if top is None else int(top) + 1


def array_e(spark, sf_dir: str) -> ArrayFrame:
    rows = table(spark, sf_dir, "embeddings")
    cells = rows.select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "value"))
    cells = cells.select("d0", F.col("d1").cast("bigint").alias("d1"), F.col("value").cast("double").alias("value"))
    return ArrayFrame.of_cells(cells, (extent(rows, "vec_id"), 64), (100, 16))


def column_array(spark, sf_dir: str, name: str, axis: str, value: str, chunk: int = 1000) -> ArrayFrame:
    rows = table(spark, sf_dir, name)
    cells = rows.select(F.col(axis).alias("d0"), F.col(value).alias("value"))
    return ArrayFrame.of_cells(cells, (extent(rows, axis),), (chunk,))


def array_v(spark, sf_dir: str) -> ArrayFrame:
    return column_array(spark, sf_dir, "events", "event_id", "value")


def array_u(spark, sf_dir: str) -> ArrayFrame:
    return column_array(spark, sf_dir, "events", "event_id", "user_id")


def array_o(spark, sf_dir: str) -> ArrayFrame:
    return column_array(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")


def array_l(spark, sf_dir: str) -> ArrayFrame:
    cells = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("d0")).agg(F.min("quality").alias("value"))
    n = extent(table(spark, sf_dir, "documents"), "doc_id")
    return replace(a := ArrayFrame.of_cells(cells, (n,), (10,)), meta=replace(a.meta, fill_value=-1))


E = "(SELECT vec_id AS d0, unnest(range(0, len(embedding))) AS d1, unnest(embedding)::DOUBLE AS value FROM embeddings)"
V = "(SELECT event_id AS d0, value FROM events)"
U = "(SELECT event_id AS d0, user_id AS value FROM events)"
O = "(SELECT o_orderkey AS d0, o_totalprice AS value FROM orders)"
L = "(SELECT doc_id AS d0, min(quality) AS value FROM labels GROUP BY doc_id)"
GRID = "(SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM documents))) AS d0)"


# ---- slices


@query(f"SELECT d0 - 10 AS d0, d1, value FROM {E} WHERE d0 >= 10 AND d0 < 20 AND d1 < 4")
def slice_box_2d(spark, sf_dir):
    return array_e(spark, sf_dir).slice((10, 20), (0, 4)).df


@query(f"SELECT value FROM {E} WHERE d0 = 7 AND d1 = 3")
def slice_point(spark, sf_dir):
    return array_e(spark, sf_dir)[7, 3].df


@query(f"SELECT d1 AS d0, value FROM {E} WHERE d0 = 5")
def slice_row(spark, sf_dir):
    return array_e(spark, sf_dir)[5].df


@query(f"SELECT d1 AS d0, value FROM {E} WHERE d0 = (SELECT max(vec_id) FROM embeddings)")
def slice_last(spark, sf_dir):
    return array_e(spark, sf_dir)[-1].df


# ---- chunks and keys


@query(f"SELECT d0 // 100 AS p0, d1 // 16 AS p1, count(*) AS cells FROM {E} GROUP BY 1, 2")
def chunk_grid(spark, sf_dir):
    grid = array_e(spark, sf_dir).chunk_grid()
    return grid.select("p0", "p1", ((F.col("hi0") - F.col("lo0")) * (F.col("hi1") - F.col("lo1"))).alias("cells"))


def _keyed(spark, sf_dir, spec: dict) -> DataFrame:
    a = array_e(spark, sf_dir)
    a = replace(a, meta=replace(a.meta, encoding=keys.parse(spec)))
    return a.with_chunk().groupBy("key").agg(F.count(F.lit(1)).alias("cells"))


@query(f"SELECT (d0 // 100) || '.' || (d1 // 16) AS key, count(*) AS cells FROM {E} GROUP BY 1")
def chunk_key_v2(spark, sf_dir):
    return _keyed(spark, sf_dir, {"name": "v2"})


@query(f"SELECT 'c/' || (d0 // 100) || '/' || (d1 // 16) AS key, count(*) AS cells FROM {E} GROUP BY 1")
def chunk_key_default(spark, sf_dir):
    return _keyed(spark, sf_dir, {"name": "default"})


@query(f"SELECT 'c/' || (d0 // 100) || '/' || (d1 // 16) || '.bin' AS key, count(*) AS cells FROM {E} GROUP BY 1")
def chunk_key_suffix(spark, sf_dir):
    return _keyed(spark, sf_dir, {"name": "suffix", "configuration": {"suffix": ".bin", "base-encoding": {"name": "default"}}})


@query(f"SELECT count(DISTINCT (d0 // 100, d1 // 16)) AS chunks FROM {E} WHERE d0 >= 150 AND d0 < 320 AND d1 >= 10 AND d1 < 20")
def chunk_prune_count(spark, sf_dir):
    return array_e(spark, sf_dir).chunks_touched((150, 320), (10, 20)).agg(F.count(F.lit(1)).alias("chunks"))


# ---- algebra


@query(f"SELECT d0, round(value - 273.15::DOUBLE, 6) AS value FROM {V}")
def broadcast_scalar(spark, sf_dir):
    return array_v(spark, sf_dir).map(lambda x: F.round(x - F.lit(273.15), 6)).df


def weights(spark, n: int = 64) -> ArrayFrame:
    return ArrayFrame.of_cells(spark.range(n).select(F.col("id").alias("d0"), (F.col("id") + 1).cast("double").alias("value")), (n,))


@query(f"SELECT d0, d1, round(value * (d1 + 1), 6) AS value FROM {E}")
def broadcast_vector(spark, sf_dir):
    return array_e(spark, sf_dir).combine(weights(spark), lambda x, w: F.round(x * w, 6)).df


STATS = "round(sum(value), 4) AS s, round(min(value), 4) AS lo, round(max(value), 4) AS hi, count(*) AS n, round(avg(value), 4) AS mean"


def _stats(x):
    return F.struct(
        F.round(F.sum(x), 4).alias("s"), F.round(F.min(x), 4).alias("lo"), F.round(F.max(x), 4).alias("hi"),
        F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"),
    )


def _reduced(a: ArrayFrame, gone: list[int] | None) -> DataFrame:
    kept = [f"d{i}" for i in range(a.rank) if gone is not None and i not in gone]
    named = [F.col(c).alias(f"d{k}") for k, c in enumerate(kept)]
    return a.df.groupBy(*kept).agg(_stats(F.col("value")).alias("v")).select(*named, "v.*")


@query(f"SELECT d1 AS d0, {STATS} FROM {E} GROUP BY d1")
def reduce_axis0(spark, sf_dir):
    return _reduced(array_e(spark, sf_dir), [0])


@query(f"SELECT d0, {STATS} FROM {E} GROUP BY d0")
def reduce_axis1(spark, sf_dir):
    return _reduced(array_e(spark, sf_dir), [1])


@query(f"SELECT {STATS} FROM {E}")
def reduce_all(spark, sf_dir):
    return _reduced(array_e(spark, sf_dir), None)


@query(f"SELECT 0::BIGINT AS d0, d1, round(sum(value), 4) AS value FROM {E} GROUP BY d1")
def reduce_keepdims(spark, sf_dir):
    return array_e(spark, sf_dir).reduce("sum", [0], keepdims=True).map(lambda x: F.round(x, 4)).df


@query(f"SELECT d0, round(sum(value * (d1 + 1)) / sum(d1 + 1.0::DOUBLE), 6) AS value FROM {E} GROUP BY d0")
def weighted_mean(spark, sf_dir):
    return array_e(spark, sf_dir).weighted_mean(weights(spark), [1]).map(lambda x: F.round(x, 6)).df


@query(f"SELECT d0, round(cos(radians(value)), 6) AS value FROM {V}")
def elementwise_math(spark, sf_dir):
    return array_v(spark, sf_dir).map(lambda x: F.round(F.cos(F.radians(x)), 6)).df


@query(f"SELECT d0, d1, round(sum(value), 4) AS value FROM {E} GROUP BY GROUPING SETS ((d0), (d1), ())")
def reduce_grouping_sets(spark, sf_dir):
    df = array_e(spark, sf_dir).df
    return df.groupingSets([[df.d0], [df.d1], []], df.d0, df.d1).agg(F.round(F.sum("value"), 4).alias("value"))


# ---- fill values


@query(f"SELECT g.d0, coalesce(l.value, -1) AS value FROM {GRID} g LEFT JOIN {L} l ON g.d0 = l.d0")
def fill_dense(spark, sf_dir):
    return array_l(spark, sf_dir).dense().df


@query(f"SELECT count(*) AS cells, count(*) - count(l.value) AS missing FROM {GRID} g LEFT JOIN {L} l ON g.d0 = l.d0")
def fill_as_missing(spark, sf_dir):
    cells = array_l(spark, sf_dir).dense().missing(-1).df
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value").isNull()).alias("missing"))


@query(f"SELECT p0 FROM (SELECT DISTINCT d0 // 10 AS p0 FROM {GRID}) EXCEPT SELECT d0 // 10 FROM {L}")
def fill_elide(spark, sf_dir):
    a = array_l(spark, sf_dir)
    stored = a.df.where("value <> -1").select(F.expr("d0 div 10").alias("p0")).distinct()
    return a.chunk_grid().select("p0").join(stored, "p0", "left_anti")


@query(f"SELECT count(DISTINCT d0 // 10) AS k, (SELECT (max(doc_id) + 10) // 10 FROM documents) AS n FROM {L}")
def chunks_initialized(spark, sf_dir):
    a = array_l(spark, sf_dir)
    return a.df.agg(F.count_distinct(F.expr("d0 div 10")).alias("k")).withColumn("n", F.lit(a.meta.n_chunks).cast("bigint"))


# ---- writes and shapes


@query(f"SELECT d0, CASE WHEN d0 >= 100 AND d0 < 200 THEN 5.0::DOUBLE ELSE value END AS value FROM {V}")
def assign_box(spark, sf_dir):
    return array_v(spark, sf_dir).assigned(5.0, (100, 200)).df


@query(f"SELECT d0, value FROM {V} UNION ALL SELECT d0 + (SELECT max(event_id) + 1 FROM events), value FROM {V}")
def append_axis0(spark, sf_dir):
    a = array_v(spark, sf_dir)
    return a.concat(a, 0).df


@query(f"SELECT d0, d1, value FROM {E} UNION ALL SELECT d0, d1 + 64, -value FROM {E}")
def append_axis1(spark, sf_dir):
    a = array_e(spark, sf_dir)
    return a.concat(a.map(lambda x: -x), 1).df


@query(f"SELECT d0, d1, value FROM {E} UNION ALL SELECT (SELECT max(vec_id) + 1 FROM embeddings), d1, value FROM {E} WHERE d0 = 0")
def append_row(spark, sf_dir):
    a = array_e(spark, sf_dir)
    return a.concat(a.slice((0, 1)), 0).df


@query(f"SELECT 0::BIGINT AS d0, d0 AS d1, value FROM {V} UNION ALL SELECT 1, d0, value * 2 FROM {V}")
def concat_new_axis(spark, sf_dir):
    a = array_v(spark, sf_dir)
    return a.concat(a.map(lambda x: x * 2), a.rank).df


@query(f"SELECT d0, d1, value FROM {E} WHERE d0 < 50 AND d1 < 10")
def resize_shrink(spark, sf_dir):
    return array_e(spark, sf_dir).resized((50, 10)).df


@query(
    f"SELECT g.d0, coalesce(o.value, -1.0::DOUBLE) AS value FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 101 FROM orders))) AS d0) g "
    f"LEFT JOIN {O} o ON g.d0 = o.d0"
)
def resize_grow(spark, sf_dir):
    a = array_o(spark, sf_dir)
    return a.resized((a.shape[0] + 100,), -1.0).df


@query(f"SELECT d1 AS d0, d0 AS d1, value FROM {E}")
def transpose(spark, sf_dir):
    return array_e(spark, sf_dir).transpose().df


@query(f"SELECT (d0 * 64 + d1) // 16 AS d0, (d0 * 64 + d1) % 16 AS d1, value FROM {E}")
def reshape(spark, sf_dir):
    a = array_e(spark, sf_dir)
    return a.reshape((a.shape[0] * 4, 16)).df


@query(f"SELECT d0 * 64 + d1 AS position, value FROM {E}")
def linear_index(spark, sf_dir):
    return array_e(spark, sf_dir).ravel()


# ---- filters as expressions


def _chunked_u(spark, sf_dir) -> DataFrame:
    return array_u(spark, sf_dir).with_chunk().select("chunk", F.col("d0").alias("position"), "value")


@query(f"SELECT d0 // 1000 AS chunk, d0 AS position, coalesce(value - lag(value) OVER (PARTITION BY d0 // 1000 ORDER BY d0), value) AS value FROM {U}")
def delta_encode(spark, sf_dir):
    return ex.delta_encode(_chunked_u(spark, sf_dir))


@query(f"SELECT d0 // 1000 AS chunk, d0 AS position, value FROM {U}")
def delta_decode(spark, sf_dir):
    return ex.delta_decode(ex.delta_encode(_chunked_u(spark, sf_dir)))


@query(f"SELECT d0, round_even((value - 100.0::DOUBLE) * 10.0::DOUBLE, 0)::INTEGER AS value FROM {V}")
def scale_offset_encode(spark, sf_dir):
    return array_v(spark, sf_dir).map(lambda x: ex.scale_offset_encode(x, 100, 10)).df


@query(f"SELECT d0, round(round_even((value - 100.0::DOUBLE) * 10.0::DOUBLE, 0)::INTEGER / 10.0::DOUBLE + 100.0::DOUBLE, 6) AS value FROM {V}")
def scale_offset_decode(spark, sf_dir):
    return array_v(spark, sf_dir).map(lambda x: F.round(ex.scale_offset_decode(ex.scale_offset_encode(x, 100, 10), 100, 10), 6)).df


@query(f"SELECT d0, round_even(value * 16.0::DOUBLE, 0) / 16.0::DOUBLE AS value FROM {V}")
def quantize(spark, sf_dir):
    return array_v(spark, sf_dir).map(lambda x: ex.quantize(x, 1)).df


def ragged(spark, sf_dir) -> DataFrame:
    """The texts of a conversation, by turn, as one ragged element."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("d0"))
    return turns.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("value"))


@query("SELECT conv_id AS d0, count(*)::INTEGER AS items, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY conv_id")
def ragged_lengths(spark, sf_dir):
    sizes = F.aggregate("value", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x))
    return ragged(spark, sf_dir).select("d0", F.size("value").alias("items"), sizes.alias("bytes"))


@query("SELECT conv_id AS d0, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS item, text AS value FROM conversations")
def ragged_explode(spark, sf_dir):
    return ragged(spark, sf_dir).select("d0", F.posexplode("value").alias("item", "value"))


@query("SELECT c_custkey AS d0, c_mktsegment AS value, length(c_mktsegment)::INTEGER AS length FROM customer")
def fixed_string(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    value = ex.fixed_string(F.col("c_mktsegment"), 16)
    return rows.select(F.col("c_custkey").alias("d0"), value.alias("value")).withColumn("length", F.length("value"))


@query(f"SELECT count(*) AS differing FROM {E} WHERE value IS NULL")
def array_equal(spark, sf_dir):
    a = array_e(spark, sf_dir)
    return a.differs(_saved(a, "equal")).agg(F.count(F.lit(1)).alias("differing"))


@query(f"SELECT count(*) AS differing FROM {V} WHERE d0 >= 100 AND d0 < 200 AND value IS DISTINCT FROM 5.0::DOUBLE")
def array_differs(spark, sf_dir):
    a = array_v(spark, sf_dir)
    changed = replace(_saved(a, "differs", fill_value=0.0), writeable=True).fill_box(5.0, (100, 200))
    return a.differs(changed).agg(F.count(F.lit(1)).alias("differing"))


@query(
    "SELECT max(vec_id) + 1 AS n0, 64::BIGINT AS n1, (max(vec_id) + 1) * 64 * 8 AS n_bytes, ((max(vec_id) + 100) // 100) * 4 AS chunks FROM embeddings"
)
def info_row(spark, sf_dir):
    info = _saved(array_e(spark, sf_dir), "info").info()
    shape, chunks = F.col("shape"), F.split("chunks_initialized", "/")[1].cast("bigint")
    return info.select(shape[0].alias("n0"), shape[1].alias("n1"), "n_bytes", chunks.alias("chunks"))


@query(
    "SELECT l_linenumber - 1 AS d0, count(*) AS cells, round(sum(v), 2) AS value FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, "
    "sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1"
)
def sparse_reduce(spark, sf_dir):
    """Repeated coordinates are added up before the cells are an array."""
    rows = table(spark, sf_dir, "lineitem")
    at = [F.col("l_orderkey").alias("d0"), (F.col("l_linenumber") - 1).cast("bigint").alias("d1")]
    cells = rows.groupBy(*at).agg(F.sum("l_quantity").alias("value"))
    return cells.groupBy(F.col("d1").alias("d0")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 2).alias("value"))


# ---- what is written and read back


ALL_E = f"SELECT d0, d1, value FROM {E}"
ALL_U = f"SELECT d0, value FROM {U}"
SHARDS = {
    "name": "sharding_indexed",
    "configuration": {
        "chunk_shape": [25, 8],
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3}}],
        "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}],
    },
}
LITTLE = {"name": "bytes", "configuration": {"endian": "little"}}
V2_CODECS = {
    "raw": None,
    "zlib": {"id": "zlib", "level": 3},
    "gzip": {"id": "gzip", "level": 3},
    "zstd": {"id": "zstd", "level": 3},
    "blosc_lz4": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0},
    "blosc_zstd_bits": {"id": "blosc", "cname": "zstd", "clevel": 3, "shuffle": 2, "blocksize": 0},
}
V3_CODECS = {
    "v3_big_endian": [{"name": "bytes", "configuration": {"endian": "big"}}],
    "v3_gzip": [LITTLE, {"name": "gzip", "configuration": {"level": 3}}],
    "v3_transpose_zstd": [{"name": "transpose", "configuration": {"order": [1, 0]}}, LITTLE, {"name": "zstd", "configuration": {"level": 3}}],
    "v3_crc32c": [LITTLE, {"name": "crc32c"}],
    "v3_blosc": [LITTLE, {"name": "blosc", "configuration": {"cname": "zstd", "clevel": 3, "shuffle": "shuffle"}}],
    "v3_shards": [SHARDS],
}
V2_FILTERS = {
    "delta": [{"id": "delta", "dtype": "<i8", "astype": "<i8"}],
    "fletcher32": [{"id": "fletcher32"}],
    "shuffle": [{"id": "shuffle", "elementsize": 8}],
    "delta_fletcher32": [{"id": "delta", "dtype": "<i8", "astype": "<i8"}, {"id": "fletcher32"}],
}


def _saved(a: ArrayFrame, name: str, **options) -> ArrayFrame:
    where = scratch(a.df.sparkSession, name)
    a.save(where, "a", **options)
    return ArrayFrame.open(a.df.sparkSession, where, "a")


def _round_trip(make: Callable, **options) -> Callable:
    return lambda spark, sf_dir: _saved(make(spark, sf_dir), "round-trip", **options).df


for _name, _spec in V2_CODECS.items():
    query(ALL_E, f"codec_roundtrip_{_name}")(_round_trip(array_e, compressor=_spec))
for _name, _specs in V3_CODECS.items():
    query(ALL_E, f"codec_roundtrip_{_name}")(_round_trip(array_e, format=3, codecs=_specs, fill_value=0.0))
for _name, _specs in V2_FILTERS.items():
    query(ALL_U, f"filter_roundtrip_{_name}")(_round_trip(array_u, filters=_specs, compressor={"id": "zstd", "level": 3}))


@query(f"SELECT d0, value FROM {O}")
def float_roundtrip(spark, sf_dir):
    return _saved(array_o(spark, sf_dir), "orders").df


@query("SELECT doc_id AS d0, text AS value FROM documents")
def text_roundtrip_vlen_utf8(spark, sf_dir):
    return _saved(column_array(spark, sf_dir, "documents", "doc_id", "text", 64), "texts").df


@query("SELECT vec_id AS d0, embedding AS value FROM embeddings")
def ragged_roundtrip_vlen_array(spark, sf_dir):
    return _saved(column_array(spark, sf_dir, "embeddings", "vec_id", "embedding", 50), "ragged").df


@query("SELECT event_id AS d0, ts AS value FROM events")
def date_roundtrip(spark, sf_dir):
    return _saved(column_array(spark, sf_dir, "events", "event_id", "ts"), "dates").df


@query(f"SELECT d0 - 30 AS d0, d1 - 12 AS d1, value FROM {E} WHERE d0 >= 30 AND d0 < 140 AND d1 >= 12 AND d1 < 40")
def shard_box(spark, sf_dir):
    return _saved(array_e(spark, sf_dir), "shards", format=3, codecs=[SHARDS], fill_value=0.0).slice((30, 140), (12, 40)).df


@query(f"SELECT d0, d1, value FROM {E} WHERE d0 >= 210 AND d0 < 260 AND d1 = 33")
def pushed_filter(spark, sf_dir):
    return _saved(array_e(spark, sf_dir), "pushed").df.where("d0 >= 210 and d0 < 260 and d1 = 33")


@query(f"SELECT d0, CASE WHEN d0 >= 490 AND d0 < 510 THEN -1.5::DOUBLE ELSE value END AS value FROM {V}")
def stored_assign(spark, sf_dir):
    a = _saved(array_v(spark, sf_dir), "assign", fill_value=0.0)
    return replace(a, writeable=True).fill_box(-1.5, (490, 510)).df


@query(f"SELECT d0, value FROM {V} UNION ALL SELECT d0 + (SELECT max(event_id) + 1 FROM events), value FROM {V}")
def stored_append_whole(spark, sf_dir):
    a = _saved(array_v(spark, sf_dir), "append", fill_value=0.0)
    return replace(a, writeable=True).append(a).df


@query(
    f"SELECT d0, coalesce(value, -9.0::DOUBLE) AS value FROM (SELECT unnest(range(0, (SELECT max(event_id) + 1 FROM events))) AS d0) g "
    f"LEFT JOIN {V} v USING (d0) WHERE d0 < 234 UNION ALL SELECT unnest(range(234, 3000)), -9.0::DOUBLE"
)
def stored_resize(spark, sf_dir):
    a = replace(_saved(array_v(spark, sf_dir), "resize", fill_value=-9.0), writeable=True)
    return a.resize(234).resize(3000).df


@query(f"SELECT d0, value FROM {L}")
def stored_fill_as_missing(spark, sf_dir):
    a = _saved(array_l(spark, sf_dir), "missing", fill_value=-1)
    return ArrayFrame.open(spark, a.store, a.path, fill_as_missing=True).df.where("value is not null")


@query(f"SELECT count(DISTINCT d0 // 10) AS k, (SELECT (max(doc_id) + 10) // 10 FROM documents) AS n FROM {L}")
def stored_chunks_initialized(spark, sf_dir):
    info = _saved(array_l(spark, sf_dir), "initialized", fill_value=-1).info()
    parts = F.split("chunks_initialized", "/")
    return info.select(parts[0].cast("bigint").alias("k"), parts[1].cast("bigint").alias("n"))


def _small_e(spark, sf_dir) -> ArrayFrame:
    return _saved(array_e(spark, sf_dir), "store", fill_value=0.0)


@query(ALL_E)
def store_roundtrip_directory(spark, sf_dir):
    a = _small_e(spark, sf_dir)
    return ArrayFrame.open(spark, FileStore(a.store.uri), a.path).df


@query(ALL_E)
def store_roundtrip_zip(spark, sf_dir):
    import io

    a, out = _small_e(spark, sf_dir), io.BytesIO()
    write_zip(a.store, out)
    return ArrayFrame.open(spark, ZipStore(out.getvalue()), a.path).df


@query(ALL_E)
def store_roundtrip_cached(spark, sf_dir):
    a = cached_array(_small_e(spark, sf_dir), scratch(spark, "cache"))
    a.df.count()
    return a.df


@query(ALL_E)
def store_roundtrip_consolidated(spark, sf_dir):
    where = scratch(spark, "group")
    group = Group.create(spark, where)
    array_e(spark, sf_dir).save(open_store(where), "e")
    group.consolidate()
    return open_node(spark, where, consolidated=True)["e"].df


def _over_http(spark, sf_dir) -> ArrayFrame:
    """The whole array, read from a web server on the driver's own machine, so for a local master,
    and written to the scratch folder before the server stops."""
    a = _small_e(spark, sf_dir)
    server = serve(a.store)
    try:
        web = HttpStore(f"http://127.0.0.1:{server.server_address[1]}")
        return _saved(ArrayFrame.open(spark, web, a.path), "from-http", fill_value=0.0)
    finally:
        server.shutdown()


@query(ALL_E)
def store_roundtrip_http_whole(spark, sf_dir):
    return _over_http(spark, sf_dir).df


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, {rank}::BIGINT AS rank, (SELECT max({axis}) + 1 FROM {name}) AS length"
        for name, axis, rank in (("embeddings", "vec_id", 2), ("events", "event_id", 1), ("orders", "o_orderkey", 1))
    )
)
def group_catalog(spark, sf_dir):
    group = Group.create(spark, scratch(spark, "catalog"))
    for name, a in (("embeddings", array_e(spark, sf_dir)), ("events", array_v(spark, sf_dir)), ("orders", array_o(spark, sf_dir))):
        group.create_array(name, a.meta.dtype.tag, a.shape, chunks=a.meta.chunks)
    return group.catalog().select("name", F.size("shape").cast("bigint").alias("rank"), F.col("shape")[0].alias("length"))


# ---- making, describing and opening


@query("SELECT 700 * 30::BIGINT AS cells, 0::BIGINT AS total, 7 * 2::BIGINT AS chunks")
def zeros(spark, sf_dir):
    where = scratch(spark, "zeros")
    a = ArrayFrame.zeros(spark, "<i4", (700, 30), where, "z", chunks=(100, 15))
    done = int(a.info().first()["chunks_initialized"].split("/")[0])
    cells = a.df.agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))
    return cells.withColumn("chunks", F.lit(done).cast("bigint"))


@query("SELECT r AS d0, c AS d1, (r * 7 - c) / 2.0::DOUBLE AS value FROM (SELECT unnest(range(0, 40)) AS r) a, (SELECT unnest(range(0, 25)) AS c) b")
def from_memory(spark, sf_dir):
    x = (np.arange(40)[:, None] * 7 - np.arange(25)[None]) / 2
    return ArrayFrame.from_numpy(spark, x, scratch(spark, "memory"), "x", chunks=(16, 10)).df


@query(f"SELECT 2::BIGINT AS format, count(*) AS cells FROM {U} UNION ALL SELECT 3, count(*) FROM {U}")
def format_detection(spark, sf_dir):
    where, parts = scratch(spark, "formats"), []
    for format in (2, 3):
        array_u(spark, sf_dir).save(where, f"v{format}", format=format, fill_value=0)
        a = open_node(spark, where, f"v{format}")
        parts.append(a.df.agg(F.lit(a.meta.format).cast("bigint").alias("format"), F.count(F.lit(1)).alias("cells")))
    return parts[0].unionAll(parts[1])


@query("SELECT 'kelvin' AS unit, 12::BIGINT AS month, false AS has_note, (SELECT max(event_id) + 1 FROM events) AS length")
def attributes(spark, sf_dir):
    where = scratch(spark, "attributes")
    a = array_v(spark, sf_dir).save(where, "a", attrs={"unit": "celsius", "note": "raw"})
    a.with_attrs(unit="kelvin", month=12, note=None)
    b = open_node(spark, where, "a")
    row = (b.meta.attrs["unit"], b.meta.attrs["month"], "note" in b.meta.attrs, b.shape[0])
    return spark.createDataFrame([row], "unit string, month bigint, has_note boolean, length bigint")


@query(f"SELECT round(sum(value), 4) AS value FROM {V}")
def scalar_roundtrip(spark, sf_dir):
    return _saved(array_v(spark, sf_dir).reduce("sum"), "scalar").map(lambda x: F.round(x, 4)).df


@query("SELECT ((n + 999) // 1000) * 1000 * 8 AS storage_size, n * 8 AS n_bytes, round(n * 1.0::DOUBLE / (((n + 999) // 1000) * 1000), 9) AS ratio FROM (SELECT max(event_id) + 1 AS n FROM events)")
def storage_size(spark, sf_dir):
    info = _saved(array_v(spark, sf_dir), "size", compressor=None).info()
    return info.select("storage_size", "n_bytes", F.round("storage_ratio", 9).alias("ratio"))


@query(f"SELECT d0, round(round_even((value - 100.0::DOUBLE) * 10.0::DOUBLE, 0)::INTEGER / 10.0::DOUBLE + 100.0::DOUBLE, 6) AS value FROM {V}")
def stored_scale_offset(spark, sf_dir):
    spec = {"id": "fixedscaleoffset", "offset": 100, "scale": 10, "dtype": "<f8", "astype": "<i4"}
    return _saved(array_v(spark, sf_dir), "scaled", filters=[spec]).map(lambda x: F.round(x, 6)).df


@query(f"SELECT d0, round_even(value * 16.0::DOUBLE, 0) / 16.0::DOUBLE AS value FROM {V}")
def stored_quantize(spark, sf_dir):
    spec = {"id": "quantize", "digits": 1, "dtype": "<f8", "astype": "<f8"}
    return _saved(array_v(spark, sf_dir), "quantized", filters=[spec]).df


@query("SELECT c_custkey AS d0, substr(c_mktsegment, 1, 6) AS value FROM customer")
def fixed_text_roundtrip(spark, sf_dir):
    """Texts of six characters; longer ones are cut before they are stored."""
    a = column_array(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", 64).map(lambda x: F.substring(x, 1, 6))
    made = ArrayFrame.create(spark, "<U6", a.shape, scratch(spark, "fixed"), "t", chunks=(64,))
    return made.write(a.df).df


@query(f"SELECT d0, value FROM {U} WHERE d0 IN (3, 77, 2500, 9001)")
def pushed_indices(spark, sf_dir):
    return _saved(array_u(spark, sf_dir), "indices").df.where(F.col("d0").isin(3, 77, 2500, 9001))


@query(ALL_U)
def opened_by_url(spark, sf_dir):
    where = scratch(spark, "url")
    array_u(spark, sf_dir).save(open_store(where), "deep/er/a")
    return spark.read.format("ndarray").option("array", "deep/er/a").load(where)


@query(f"SELECT count(*) AS cells, sum(value)::BIGINT AS total FROM {U}")
def memory_store(spark, sf_dir):
    """A store in the driver's memory, of an array that fits there: sums by chunks of 1000."""
    a = array_u(spark, sf_dir)
    sums = a.df.groupBy(F.expr("d0 div 1000").alias("d0")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    kept = ArrayFrame.of_cells(sums.select("d0", "value"), (a.meta.n_chunks,)).save(MemoryStore(), "m")
    counts = ArrayFrame.of_cells(sums.select("d0", F.col("n").alias("value")), (a.meta.n_chunks,)).save(MemoryStore(), "n")
    both = kept.combine(counts, lambda x, n: F.struct(x.cast("double").alias("re"), n.cast("double").alias("im")))
    return both.df.agg(F.sum("value.im").cast("bigint").alias("cells"), F.sum("value.re").cast("bigint").alias("total"))


@query(f"SELECT e.d0, e.d1, round(e.value - m.value, 6) AS value FROM {E} e JOIN (SELECT d1, avg(value) AS value FROM {E} GROUP BY d1) m ON e.d1 = m.d1")
def singleton_combine(spark, sf_dir):
    a = array_e(spark, sf_dir)
    return a.combine(a.reduce("mean", [0], keepdims=True), lambda x, m: F.round(x - m, 6)).df


@query("SELECT 'NotWriteable' AS error, count(*) AS cells FROM events")
def read_only_guard(spark, sf_dir):
    a = _saved(array_u(spark, sf_dir), "guard")
    try:
        a.fill_box(0, (0, 1))
        error = "none"
    except NotWriteable as e:
        error = type(e).__name__
    return a.df.agg(F.lit(error).alias("error"), F.count(F.lit(1)).alias("cells"))


@query(f"SELECT d0, value FROM {V}")
def zip_file(spark, sf_dir):
    """An archive as a file in the shared folder, not in the plan."""
    a = _saved(array_v(spark, sf_dir), "to-zip")
    uri = f"{scratch(spark, 'zip')}.zip"
    write_zip(a.store, uri)
    return ArrayFrame.open(spark, uri, a.path).df
