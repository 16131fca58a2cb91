import itertools
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndspark import formats
from ndspark.errors import ArgumentError, DimensionMismatch, NotWriteable
from ndspark.operators.frame import ArrayFrame
from ndspark.operators.group import Group, cached_array, open_node
from ndspark.sources import array_source
from ndspark.sources import stores as s
from ndspark.streaming import append_stream

X = np.arange(100).reshape(10, 10)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


@pytest.fixture
def stored(spark, folder):
    return ArrayFrame.from_numpy(spark, X, folder, "a", chunks=(2, 5), fill_value=-1)


def test_slices(stored):
    assert (stored.to_numpy() == X).all()
    for box in itertools.product([None, (3, 7), 4, -1, slice(2, 9), (5, 5)], repeat=2):
        at = tuple(slice(None) if b is None else slice(*b) if isinstance(b, tuple) else b for b in box)
        assert np.array_equal(stored.slice(*box).to_numpy(), X[at])
    assert stored.length(0) == 10 and stored.length(5) == 1 and len(stored) == 100
    for bad in ((11,), ((3, 12),), (slice(0, 4, 2),)):
        with pytest.raises(ArgumentError):
            stored.slice(*bad)
    with pytest.raises(DimensionMismatch):
        stored.slice(1, 1, 1)
    with pytest.raises(ArgumentError):
        stored.length(-1)


def test_only_touched_chunks_are_read(stored):
    plan = array_source.Plan(stored.store, "a", stored.meta, [(3, 5), (0, 5)])
    reader = array_source.ArrayReader(plan)
    opened = []
    whole = s.FileStore.get
    try:
        s.FileStore.get = lambda self, key: opened.append(key) or whole(self, key)
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    finally:
        s.FileStore.get = whole
    assert rows == 10 and sorted(opened) == ["a/1.0", "a/2.0"]


def test_filters_narrow_the_box(stored):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    reader = array_source.ArrayReader(array_source.Plan(stored.store, "a", stored.meta, [(0, 10), (0, 10)]))
    kept = list(reader.pushFilters([GreaterThan(("d0",), 3), LessThanOrEqual(("d0",), 7), In(("d1",), (2, 4)), EqualTo(("value",), 1)]))
    assert len(kept) == 4 and reader.plan.box == [(4, 8), (2, 5)]
    got = stored.df.where("d0 > 3 and d0 <= 7 and d1 in (2, 4)").collect()
    assert sorted(r["value"] for r in got) == sorted(X[4:8, [2, 4]].ravel().tolist())


def test_planning_a_huge_array(spark, folder):
    a = ArrayFrame.create(spark, "|u1", (9327, 10653, 10674), folder, chunks=(1, 1024, 1024), fill_value=0)
    reader = array_source.ArrayReader(array_source.Plan(a.store, "", a.meta, [(0, n) for n in a.shape]))
    assert len(reader.partitions()) <= array_source.MAX_TASKS
    assert a.slice((5, 6), (7, 9), (0, 2)).to_numpy().tolist() == [[[0, 0], [0, 0]]]


def test_partial_writes_fill_and_elision(spark, folder):
    a = ArrayFrame.create(spark, "<f4", (4, 4), folder, chunks=(2, 2), fill_value=7.0)
    assert (a.to_numpy() == 7).all()
    a = a.write_numpy(np.full((1, 1), 3.5, "f4"), (1, 1))
    assert a.store.exists("0.0") and not a.store.exists("1.1") and a.to_numpy()[1, 1] == 3.5
    assert a.stored_cells().count() == 4
    a = a.fill_box(7.0, (0, 2), (0, 2))
    assert not a.store.exists("0.0")
    nan = ArrayFrame.create(spark, "<f8", (4,), folder, "nan", fill_value=float("nan")).write_numpy(np.full(4, np.nan))
    assert not nan.store.exists("nan/0")
    zero = ArrayFrame.create(spark, "<f8", (1,), folder, "zero", fill_value=0.0).write_numpy(np.array([-0.0]))
    assert zero.store.exists("zero/0")


def test_missing_values(spark, folder):
    x = np.ma.masked_array(np.arange(10), mask=[i % 3 == 0 for i in range(10)])
    a = ArrayFrame.create(spark, "<i8", (10,), folder, chunks=(4,), fill_value=-1, fill_as_missing=True).write_numpy(x)
    got = a.to_numpy()
    assert np.ma.getmaskarray(got).tolist() == np.ma.getmaskarray(x).tolist()
    assert ArrayFrame.open(spark, folder).to_numpy()[0] == -1
    bare = ArrayFrame.create(spark, "<i8", (10,), folder, "bare", chunks=(4,))
    with pytest.raises(Exception, match="not stored"):
        bare.to_numpy()
    with pytest.raises(Exception, match="fill value"):
        bare.write_numpy(x)


def test_resize_and_append(stored):
    with pytest.raises(ArgumentError):
        stored.resize(-1, 3)
    a = stored.resize(5, 7)
    assert not a.store.exists("a/3.0")
    a = a.resize(10, 10)
    want = np.full((10, 10), -1)
    want[:5, :7] = X[:5, :7]
    assert (a.to_numpy() == want).all()
    a = a.append(X[:3]).append(X[0]).append(np.full((14, 2), 5), axis=1)
    assert a.shape == (14, 12) and (a.to_numpy()[10:13, :10] == X[:3]).all() and (a.to_numpy()[:, 10:] == 5).all()
    a = a.append(a.slice((0, 2)))
    assert a.shape == (16, 12) and (a.to_numpy()[14:] == a.to_numpy()[:2]).all()
    with pytest.raises(DimensionMismatch):
        a.append(np.zeros((2, 3)))


def test_read_only(spark, folder, stored):
    a = ArrayFrame.open(spark, folder, "a")
    with pytest.raises(NotWriteable):
        a.fill_box(1)
    with pytest.raises(ArgumentError):
        ArrayFrame.create(spark, "<i4", (2,), folder, "a")
    with pytest.raises(ArgumentError):
        ArrayFrame.open(spark, folder, "a", lru=5)
    with pytest.raises(ArgumentError):
        ArrayFrame.open(spark, folder, "absent")
    assert not stored.store.exists("absent")
    with pytest.raises(DimensionMismatch):
        ArrayFrame.create(spark, "<i4", (2, 2), folder, "b", chunks=(1,))


def test_algebra(spark, stored):
    m = ArrayFrame.from_numpy(spark, X.astype("f8"))
    assert np.allclose(m.reduce("mean", [1]).to_numpy(), X.mean(1)) and m.reduce("sum").to_numpy() == X.sum()
    assert m.reduce("max", [0], keepdims=True).shape == (1, 10)
    centred = m.combine(m.reduce("mean", [1], keepdims=True), lambda a, b: a - b)
    assert np.allclose(centred.to_numpy(), X - X.mean(1, keepdims=True))
    w = ArrayFrame.from_numpy(spark, np.arange(1.0, 11))
    assert np.allclose(m.combine(w, lambda a, b: a * b).to_numpy(), X * np.arange(1, 11))
    assert np.allclose(m.weighted_mean(w, [1]).to_numpy(), (X * np.arange(1, 11)).sum(1) / 55)
    assert (m.transpose().to_numpy() == X.T).all() and (m.reshape((4, 25)).to_numpy() == X.reshape(4, 25)).all()
    assert (m.concat(m, 0).to_numpy() == np.concatenate([X, X])).all() and (m.concat(m, 2).to_numpy() == np.stack([X, X])).all()
    assert np.allclose(m.map(lambda v: F.cos(F.radians(v))).to_numpy(), np.cos(np.radians(X)))
    assert m.differs(m).count() == 0 and m.differs(m.assigned(-5.0, (0, 1), (0, 3))).count() == 3
    for bad in (lambda: m.combine(w.slice((0, 3)), lambda a, b: a), lambda: m.reshape((3, 3)), lambda: m.concat(w, 0)):
        with pytest.raises(DimensionMismatch):
            bad()
    with pytest.raises(ArgumentError):
        m.reduce("sum", [2])


def test_scalars_zeros_ragged(spark, folder):
    a = ArrayFrame.from_numpy(spark, np.array(3.5), folder, "scalar")
    assert a.store.exists("scalar/0") and a.to_numpy() == 3.5
    b = ArrayFrame.from_numpy(spark, np.array(3, "i2"), folder, "scalar3", format=3)
    assert b.store.exists("scalar3/c/0") and b.to_numpy() == 3
    assert ArrayFrame.zeros(spark, "<i4", (4,), folder, "z", chunks=(2,)).store.exists("z/1")
    assert not ArrayFrame.zeros(spark, "<i4", (4,), folder, "z0", chunks=(2,), fill_value=0).store.exists("z0/1")
    x = np.empty((2, 2), object)
    for i, v in enumerate([[1.0, 2.0], [], [3.0], [4.0] * 5]):
        x[divmod(i, 2)] = np.array(v)
    got = ArrayFrame.from_numpy(spark, x, folder, "ragged").to_numpy()
    assert [list(v) for v in got.ravel()] == [list(v) for v in x.ravel()]


@pytest.mark.parametrize("format", [2, 3])
@pytest.mark.parametrize(
    "x",
    [
        np.array([True, False]), np.array([-3, 4], "i1"), np.array([1, 2], ">i4"), np.array([2**63, 1], "u8"),
        np.array([1.5, np.nan], "f2"), np.array([1 + 2j, 3], "c8"), np.array([["a", "bc"], ["", "d"]]),
        np.array(["2020-01-01", "1900-02-03"], "M8[D]"), np.array(["2020-01-01T01:02:03"], "M8[ms]"), np.array([5, 6], "M8[ns]"),
        np.array(["é", "", "日本"], object), np.array([b"ab", b"c"], "S2"),
    ],
)
def test_types(spark, folder, x, format):
    if format == 3 and x.dtype.kind in "UMOS" or format == 3 and x.dtype.byteorder == ">":
        return
    ArrayFrame.from_numpy(spark, x, folder, format=format)
    got = np.asarray(ArrayFrame.open(spark, folder).to_numpy())
    assert np.array_equal(got.astype(str) if x.dtype.kind in "S" else got, x.astype(str) if x.dtype.kind in "S" else x, equal_nan=x.dtype.kind in "fc")


def test_raw_chunk_bytes(spark, folder):
    x = np.arange(15).reshape(3, 5)
    a = ArrayFrame.from_numpy(spark, x, folder, compressor=None)
    assert a.store.get("0.0") == x.tobytes()
    with pytest.raises(ArgumentError, match="longer"):
        from ndspark.dtype import parse_v2

        parse_v2("<U2").from_values(["abc"])


def _stores(tmp_path):
    yield s.MemoryStore()
    yield s.FileStore(f"file://{tmp_path}/f")
    yield s.FileStore(f"{tmp_path}/g")
    yield s.CachingStore(s.MemoryStore(), s.MemoryStore())


@pytest.mark.parametrize("which", range(4))
def test_writeable_stores(tmp_path, which):
    store = list(_stores(tmp_path))[which]
    assert store.children("") == ([], []) and store.get("a/0.0") is None
    store.put("a/0.0", b"12345")
    store.put("a/" + formats.V2_ARRAY, b"{}")
    store.put("a/b/c", b"x")
    assert store.get("a/0.0") == b"12345" and store.exists("a/0.0") and not store.exists("a/0.1")
    assert store.children("") == (["a"], []) and store.children("a")[0] == ["b"]
    assert store.size("a") == 6
    store.delete("a/0.0")
    store.delete("a/never")
    assert store.get("a/0.0") is None and pickle.loads(pickle.dumps(store)).get("a/b/c") == b"x"


def test_reading_stores(spark, tmp_path, folder, stored):
    group = Group.create(spark, f"{folder}/g", attrs={"n": 1})
    stored.save(group.store, "a", attrs={"u": "m"})
    group.create_group("sub").create_array("y", "<i2", (3,), fill_value=0)
    group.consolidate()
    s.write_zip(group.store, f"{tmp_path}/x.zip")
    server = s.serve(group.store)
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        for where in (f"{folder}/g", f"{tmp_path}/x.zip", url, s.CachingStore(group.store, s.MemoryStore())):
            node = open_node(spark, where)
            assert (node["a"].to_numpy() == X).all() and node["a"].meta.attrs == {"u": "m"} and "sub/y" in node
            assert node["sub"]["y"].to_numpy().tolist() == [0, 0, 0] and "b" not in node
        plain = s.HttpStore(url)
        assert plain.get("absent") is None
        with pytest.raises(OSError, match="missing"):
            s.HttpStore(url, missing=()).get("absent")
        with pytest.raises(NotWriteable):
            plain.put("k", b"")
    finally:
        server.shutdown()
    whole = s.ConsolidatedStore(group.store)
    with pytest.raises(ArgumentError):
        whole.put(formats.V2_ATTRS, b"")
    with pytest.raises(ArgumentError):
        s.ConsolidatedStore(s.MemoryStore())
    assert s.normalize(".\\\\path///to\\a\\place/..\\///") == "path/to/a"
    assert isinstance(s.open_store(f"{tmp_path}/x.zip"), s.ZipStore)


def test_cache_asks_once(spark, folder, stored):
    remote, asked = s.MemoryStore({"k": b"1"}), []
    whole = s.MemoryStore.get
    store = s.CachingStore(remote, s.MemoryStore())
    try:
        s.MemoryStore.get = lambda self, key: (asked.append(key) if self is remote else None) or whole(self, key)
        assert [store.get("k"), store.get("k"), store.get("no"), store.get("no")] == [b"1", b"1", None, None]
    finally:
        s.MemoryStore.get = whole
    assert asked == ["k", "no"]
    cached = cached_array(stored, f"{folder}-cache")
    assert (cached.to_numpy() == X).all()
    for key, _ in list(stored.store.walk("a")):
        stored.store.delete(key)
    assert (cached.to_numpy() == X).all()


@pytest.mark.parametrize("format", [2, 3])
def test_groups(spark, folder, format):
    group = Group.create(spark, folder, format=format, attrs={"description": "d"})
    group.create_array("my array", "<i4" if format == 2 else "int32", (4, 4), chunks=(2, 2), fill_value=1)
    group.create_group("s").create_group("t").create_array("x", "<f8" if format == 2 else "float64", (2,), fill_value=0.0)
    rows = {r["name"]: r["kind"] for r in group.catalog().collect()}
    assert rows == {"my array": "array", "s": "group", "s/t": "group", "s/t/x": "array"}
    assert set(group.arrays()) == {"my array"} and set(group.groups()) == {"s"}
    group.consolidate()
    assert open_node(spark, folder, consolidated=True)["s/t/x"].to_numpy().tolist() == [0, 0]
    assert Group.open(spark, folder).meta.attrs == {"description": "d"}
    with pytest.raises(KeyError):
        group["absent"]
    with pytest.raises(ArgumentError):
        Group.open(spark, folder).create_group("u")
    with pytest.raises(ArgumentError):
        Group.open(spark, folder, "my array")
    with pytest.raises(ArgumentError):
        Group.create(spark, folder)
    if format == 3:
        group.store.put("bad/" + formats.V3_NODE, b'{"%s": 3, "node_type": "array"}' % formats.FORMAT_KEY.encode())
        with pytest.warns(UserWarning, match="left out"):
            assert set(group.arrays()) == {"my array"}


def test_v3_resize_keeps_attributes(spark, folder):
    a = ArrayFrame.create(spark, "int16", (4,), folder, chunks=(2,), format=3, attrs={"a": 1}, fill_value=5)
    a = a.write_numpy(np.arange(4, dtype="i2")).resize(3)
    assert ArrayFrame.open(spark, folder).meta.attrs == {"a": 1} and a.resize(5).to_numpy().tolist() == [0, 1, 2, 5, 5]


def test_info(spark, stored):
    row = stored.info().first()
    assert row["n_bytes"] == 800 and row["chunks_initialized"] == "10/10" and row["storage_size"] == stored.storage_size()
    assert "10 x 10" in repr(stored) and stored.chunk_grid().count() == 10


def test_by_the_data_source_alone(spark, folder, stored):
    df = spark.read.format(array_source.NAME).option("array", "a").load(folder)
    assert df.where("d0 = 3 and d1 = 4").collect()[0]["value"] == 34


def test_stream_appends(spark, folder, tmp_path):
    a = ArrayFrame.create(spark, "<i8", (0, 2), folder, chunks=(3, 2), fill_value=-1)
    rows = spark.range(14).selectExpr("id div 2 as d0", "id % 2 as d1", "id as value")
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    append_stream(stream, a, f"file://{tmp_path}/state").awaitTermination(120)
    assert (ArrayFrame.open(spark, folder).to_numpy() == np.arange(14).reshape(7, 2)).all()
