"""Embedding near-duplicates by E8 lattice hashing.

Each table projects a unit vector to eight dimensions (more than one block of eight where
there are many vectors), and decodes each block to the nearest point of the E8 lattice. A
vector is filed under its own cell and the cells that are next nearest to it; two vectors are
candidates if they share a bucket, and every candidate's cosine is computed in double
precision. Tables and probes are chosen so that pairs just at the threshold are found with
`TARGET` probability; closer pairs are found more often.

Links are counted where they are found. A pair may share several buckets; it belongs to the
least of them, which any task can tell as each vector brings the list of its buckets. Pairs
that share a lesser bucket are ruled out first, most of them by one product of matrices, so
each pair's cosine is computed about once. No pair is ever a row: a bucket gives each of its
vectors a number of links, and a vector that it reaches there. Large buckets are cut into
blocks, and the pairs of blocks are dealt out.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage, unstage
from .components import components

THRESHOLD = 0.98
TARGET = 0.995
SHAPES = (  # tables, blocks, cells, scale: of those tried, cheap ones for few to very many vectors
    (2, 1, 4, 3.0), (3, 1, 4, 3.5), (4, 1, 4, 4.0), (4, 2, 4, 2.0), (6, 2, 4, 2.0), (9, 2, 2, 2.0),
    (6, 2, 8, 2.5), (3, 3, 16, 2.0), (4, 3, 16, 2.5), (9, 3, 16, 2.5),
)
BLOCK = 16384  # vectors of a bucket that one task holds against as many, at most
BLOCK_BYTES = 64 << 20  # of them in double precision
LESSER = 256  # buckets, the most shared, that rule out pairs by a product of matrices
SEED = 20240607


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, in doubled coordinates so that they are integers. E8 is the union
    of D8 (whole numbers with an even sum) and D8 shifted by a half."""

    def d8(x: np.ndarray) -> np.ndarray:
        r = np.rint(x)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        if len(odd):
            off = x[odd] - r[odd]
            at = np.abs(off).argmax(axis=1)
            r[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1, -1)
        return r

    whole, half = d8(y), d8(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, in doubled coordinates."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out, np.int64)


@dataclass(frozen=True)
class Tables:
    dims: int
    tables: int
    blocks: int
    cells: int  # a vector's buckets in each table
    scale: float  # lattice units that a distance of 1 gets on average, in each block

    @property
    def matrices(self) -> np.ndarray:
        return _matrices(self.dims, self.tables, self.blocks, self.scale)

    def buckets(self, units: np.ndarray, salts: np.ndarray, step: int = 2048) -> np.ndarray:
        """Bucket numbers of unit vectors, [vector, table, cell]. salts: a number for each
        vector's label."""
        out = np.empty((len(units), self.tables, self.cells), np.uint64)
        for lo in range(0, len(units), step):
            part = slice(lo, lo + step)
            for t, m in enumerate(self.matrices):
                out[part, t] = self._cells(units[part] @ m, salts[part] ^ np.uint64(t * 0x9E3779B97F4A7C15 % 2**64))
        return out

    def _cells(self, y: np.ndarray, salt: np.ndarray) -> np.ndarray:
        n, keep = len(y), self.cells
        keys = np.zeros((n, 1), np.uint64) + salt[:, None]
        costs = np.zeros((n, 1))
        for b in range(self.blocks):
            own = y[:, 8 * b : 8 * b + 8]
            home = decode_e8(own)
            near = home[:, None, :] + roots()[None]
            gap = ((own[:, None, :] - near / 2) ** 2).sum(2)
            best = np.argpartition(gap, keep - 1, axis=1)[:, : keep - 1]
            points = np.concatenate([home[:, None], np.take_along_axis(near, best[:, :, None], 1)], axis=1)
            cost = np.concatenate(
                [((own - home / 2) ** 2).sum(1)[:, None], np.take_along_axis(gap, best, 1)], axis=1
            )
            hashed = _mix_points(points)
            # the best combinations of what the blocks before and this one offer
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(n, -1)
            keys = _mix(keys[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + hashed[:, None, :]).reshape(n, -1)
            if keys.shape[1] > keep:
                top = np.argpartition(costs, keep - 1, axis=1)[:, :keep]
                costs, keys = np.take_along_axis(costs, top, 1), np.take_along_axis(keys, top, 1)
        return keys


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_points(points: np.ndarray) -> np.ndarray:
    h = np.zeros(points.shape[:-1], np.uint64)
    for i in range(8):
        h = _mix(h * np.uint64(0x100000001B3) + points[..., i].astype(np.uint64))
    return h


@lru_cache(maxsize=64)
def _matrices(dims: int, tables: int, blocks: int, scale: float) -> np.ndarray:
    """Projections with orthonormal columns, as far as there are dimensions, scaled so that a
    distance is multiplied by it on average."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(tables):
        raw = rng.standard_normal((max(dims, 8 * blocks), 8 * blocks))
        q, _ = np.linalg.qr(raw)
        out.append(q[:dims] * np.sqrt(dims) * scale / 2.8284271247461903)
    return np.array(out)


def _recall(tables: Tables, threshold: float, pairs: int = 800) -> float:
    """The share of random pairs just at the threshold that share a bucket."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((pairs, tables.dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((pairs, tables.dims))
    z -= (z * x).sum(1)[:, None] * x
    norm = np.linalg.norm(z, axis=1)[:, None]
    z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-12)
    y = threshold * x + np.sqrt(1 - threshold**2) * z
    y /= np.linalg.norm(y, axis=1)[:, None]
    zero = np.zeros(pairs, np.uint64)
    a, b = tables.buckets(x, zero), tables.buckets(y, zero)
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean())


def _cost(t: Tables, n: int) -> float:
    """Rows filed for a vector, those of shared buckets counting four times as they get their
    vector, and a little for each unrelated candidate. Unrelated pairs share a cell by the
    density of projected vectors, squared and summed; a block multiplies that."""
    sigma = t.scale / 2.8284271247461903
    share = (1 / ((4 * np.pi) ** 4 * sigma**8)) ** t.blocks
    mates = n * t.cells * share
    return t.tables * t.cells * (1 + 3 * min(1.0, mates) + 0.02 * mates)


@lru_cache(maxsize=32)
def fit(dims: int, n: int, threshold: float = THRESHOLD, target: float = TARGET) -> Tables:
    """The cheapest tables, blocks, cells and scale for n vectors of a label that reach the
    target."""
    unit = np.sqrt(0.04 / max(1e-4, 2 - 2 * threshold))  # shapes are for a distance of 0.2
    grid = [Tables(dims, t, b, c, float(s * unit)) for t, b, c, s in SHAPES if 8 * b <= max(8, dims)]
    for t in sorted(grid, key=lambda t: _cost(t, n)):
        if _recall(t, threshold) >= target:
            return t
    raise ValueError(f"no tables reach a recall of {target} at a cosine of {threshold}")


def _prepare(key: str, vector: str, label: str, width: int):
    """(vec_id, node, dims, vec, label): node tells apart label and vector; null for a row
    that links with nothing."""
    kind = np.dtype("<f4") if width == 4 else np.dtype("<f8")

    def run(batches):
        for batch in batches:
            rows, values = [], batch.column(vector)
            flat, bounds = values.values, values.offsets.to_numpy()
            lost = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else np.empty(0, np.int64)
            numbers = flat.fill_null(0).to_numpy().astype(kind, copy=False)
            there = values.is_valid().to_numpy(zero_copy_only=False)
            holes = np.searchsorted(lost, bounds)
            for i, lab in enumerate(batch.column(label).to_pylist()):
                x = numbers[bounds[i] : bounds[i + 1]] + kind.type(0)
                good = lab is not None and there[i] and len(x) > 0 and holes[i] == holes[i + 1]
                if good and np.isfinite(x).all() and np.any(x) and np.isfinite(np.linalg.norm(x.astype("f8"))):
                    raw, name = x.tobytes(), str(lab)
                    node = hashlib.blake2b(f"{name}\0".encode() + raw, digest_size=16).digest()
                    rows.append((node, len(x), raw, name))
                else:
                    rows.append((None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                names=["vec_id", "node", "dims", "vec", "label"],
            )

    return run


def _units(raws: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), "<f4" if width == 4 else "<f8").reshape(len(raws), -1).astype("f8")
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _salts(labels: list[str]) -> np.ndarray:
    made = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(labels)}
    return np.array([made[x] for x in labels], np.uint64)


def _file(tables: Tables, width: int):
    """(node, cells): the buckets of each vector."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                units = _units(part.column("vec").to_pylist(), width)
                found = tables.buckets(units, _salts(part.column("label").to_pylist())).reshape(len(units), -1)
                offsets = np.arange(len(units) + 1, dtype=np.int32) * found.shape[1]
                cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), cells], names=["node", "cells"])

    return run


def _reach(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n items and links a-b, the least item that each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _lesser(cells: np.ndarray, bucket: np.uint64) -> np.ndarray:
    """A column for each of the LESSER buckets below this one that most of its vectors share."""
    row, at = np.nonzero(cells < bucket)
    found, code, count = np.unique(cells[row, at], return_inverse=True, return_counts=True)
    most = np.argsort(-count, kind="stable")[:LESSER]
    place = np.full(len(found), -1)
    place[most[count[most] > 1]] = np.arange((count[most] > 1).sum())
    out = np.zeros((len(cells), place.max(initial=-1) + 1), np.float32)
    own = place[code] >= 0
    out[row[own], place[code[own]]] = 1
    return out


def _in_bucket(width: int, threshold: float, rows: list[tuple]) -> list[tuple]:
    """(node, least, links, root, root's least) from the rows of a block pair: (bucket, i, j,
    own block, node, least, vec, label, copies, cells). Only pairs that share no lesser bucket
    count. Links count copies of the other vector."""
    bucket, i, j = np.uint64(rows[0][0] % 2**64), *rows[0][1:3]
    rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: r[4])
    if len(rows) < 2:
        return []
    cells = np.array([r[9] for r in rows], np.int64).view(np.uint64)
    before = _lesser(cells, bucket)
    if before.size and before.all(axis=0).any():  # all its pairs belong to one lesser bucket
        return []
    units = _units([r[6] for r in rows], width)
    labels, copies = [r[7] for r in rows], np.array([r[8] for r in rows], np.int64)
    own = np.array([r[3] for r in rows])
    code = {x: k for k, x in enumerate(sorted(set(labels)))}
    kinds = np.array([code[x] for x in labels])
    links, ends = np.zeros(len(rows), np.int64), []
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for lo in range(0, len(left), 256):
        part = left[lo : lo + 256]
        close = kinds[part][:, None] == kinds[right][None, :]
        if before.size:
            close &= before[part] @ before[right].T < 0.5
        if not close.any():
            continue
        close &= units[part] @ units[right].T >= threshold - 1e-9
        x, y = np.nonzero(close)
        x, y = part[x], right[y]
        once = x < y if i == j else np.ones(len(x), bool)
        x, y = x[once], y[once]
        for at in range(0, len(x), 1 << 14):
            a, b = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            linked = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            a, b = a[linked], b[linked]
            shared = (cells[a][:, :, None] == cells[b][:, None, :]).any(axis=2)
            first = ~(shared & (cells[a] < bucket)).any(axis=1)
            a, b = a[first], b[first]
            ends.append((a, b))
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
    if not sum(len(a) for a, _ in ends):
        return []
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    root = _reach(len(rows), a, b)
    touched = np.unique(np.concatenate([a, b]))
    return [(*rows[k][4:6], int(links[k]), *rows[root[k]][4:6]) for k in touched]


def _verify(width: int, threshold: float, kind: pa.DataType):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.binary(), kind, pa.int64(), pa.binary(), kind]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "least", "links", "root", "first"]
        )

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    out += _in_bucket(width, threshold, held)
                    held = []
                held.append(row)
            yield batch_of(out)
        if held:
            yield batch_of(_in_bucket(width, threshold, held))

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    target: float = TARGET,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Rows link where labels are equal and not null, dimensions are equal, and the cosine is at
    least the threshold. Null or empty vectors, zero vectors, and such with null or non-finite
    components link with nothing: n_links 0, component_id the own id. Rows with the same
    vector and label are links of each other. component_id is the least non-null id reachable;
    kept is vec_id = component_id, false for a null id. Repeated rows are vectors of their own.
    Other columns are not read, and an empty table gives an empty result.
    """
    kinds = dict(vectors.dtypes)
    width = 8 if "double" in kinds[vector] else 4
    rows = stage(
        vectors.select(key, vector, label).mapInArrow(
            _prepare(key, vector, label, width),
            f"vec_id {kinds[key]}, node binary, dims int, vec binary, label string",
        ),
        "lattice-rows",
    )
    nodes = stage(
        rows.where("node is not null")
        .groupBy("node", "dims", "label", "vec")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")),
        "lattice-nodes",
    )
    found = None
    for dims, n in sorted(
        (r["dims"], r["n"])
        for r in nodes.groupBy("dims", "label").count().groupBy("dims").agg(F.max("count").alias("n")).collect()
    ):
        own = nodes.where(F.col("dims") == dims)
        tables = fit(dims, 1 << max(10, int(n - 1).bit_length()), threshold, target)
        part = _links(own, tables, width, threshold, max(1, min(block, BLOCK_BYTES // (8 * dims))))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
        )
    found = stage(found, "lattice-links")
    near = found.groupBy("node").agg(F.sum("links").alias("links"))
    # ordered by least key, so that a component's root tells its id and no join by root is needed
    end = lambda node, least: F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(node).alias("node"))
    roots_of = components(found.select(end("node", "least").alias("a"), end("root", "first").alias("b")), "lattice-components")
    roots_of = roots_of.select(F.col("node.node").alias("other"), "root")
    placed = nodes.select("node", "copies", "least").join(near, "node", "left")
    classes = stage(
        placed.join(roots_of, placed.node == roots_of.other, "left").select(
            "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.expr("if(root is null, least, root.least)").alias("component_id"),
        ),
        "lattice-classes",
    )
    unstage(nodes, found)
    return (
        rows.select("vec_id", "node")
        .join(classes, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.expr("if(node is null, vec_id, component_id)").alias("component_id"),
            F.expr("coalesce(vec_id = if(node is null, vec_id, component_id), false)").alias("kept"),
        )
    )


def _links(nodes: DataFrame, tables: Tables, width: int, threshold: float, block: int) -> DataFrame:
    filed = stage(
        nodes.select("node", "vec", "label").mapInArrow(_file(tables, width), "node binary, cells array<long>"),
        "lattice-filed",
    )
    buckets = filed.select("node", F.explode(F.array_distinct("cells")).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # blocks of a bucket by the hash of the node; a block meets every block of its bucket
    dealt = (
        buckets.join(shared, "bucket")
        .withColumn("blocks", F.expr(f"cast(ceil(n / {block}) as int)"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    )
    whole = nodes.select("node", "least", "vec", "label", "copies").join(filed, "node")
    kind = nodes.schema["least"].dataType
    schema = f"node binary, least {kind.simpleString()}, links long, root binary, first {kind.simpleString()}"
    return (
        dealt.join(whole, "node")
        .select("bucket", "i", "j", "own", "node", "least", "vec", "label", "copies", "cells")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_verify(width, threshold, to_arrow_type(kind)), schema)
    )
