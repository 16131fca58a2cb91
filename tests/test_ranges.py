import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndspark import ArrayFrame, Group
from ndspark.errors import ArgumentError
from ndspark.functions import codecs
from ndspark.operators import frame, sink
from ndspark.sources import array_source, scratch, stores

SHARDED = [
    {
        "name": "sharding_indexed",
        "configuration": {
            "chunk_shape": [10, 10],
            "codecs": [{"name": "bytes"}],
            "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}],
        },
    }
]


LOCK = threading.Lock()


class Counting(stores.MemoryStore):
    """Counts the bytes that reads give."""

    def __init__(self, fetches=1):
        super().__init__()
        self.fetches, self.bytes, self.under_way, self.most = fetches, 0, 0, 0

    def get(self, key):
        with LOCK:
            self.under_way += 1
            self.most = max(self.most, self.under_way)
        time.sleep(0.01)
        found = super().get(key)
        with LOCK:
            self.under_way -= 1
            self.bytes += len(found or b"")
        return found

    def get_range(self, key, offset, n):
        found = stores.cut(self.values.get(key), offset, n)
        with LOCK:
            self.bytes += len(found or b"")
        return found


@pytest.mark.parametrize("location", ["start", "end"])
def test_a_box_in_a_shard_fetches_the_index_and_what_it_touches(spark, location):
    store = Counting()
    spec = [{**SHARDED[0], "configuration": SHARDED[0]["configuration"] | {"index_location": location}}]
    x = np.arange(40_000, dtype="<i4").reshape(200, 200)
    a = ArrayFrame.from_numpy(spark, x, store, "s", chunks=(100, 100), format=3, codecs=spec, fill_value=-1)
    store.bytes = 0
    plan = array_source.Plan(store, "s", a.meta, [(13, 18), (120, 128)])
    cells = [array_source.give_cells(plan, *found) for found in array_source.loaded(plan, [(0, 1)])]
    got = np.concatenate([b.column("value").to_numpy() for part in cells for b in part]).reshape(5, 8)
    index = 100 * 16 + 4
    assert (got == x[13:18, 120:128]).all() and store.bytes == index + 10 * 10 * 4
    assert array_source.load_chunk(plan, (5, 5), [(0, 1), (0, 1)]) is None


def test_ranges_of_every_store(tmp_path):
    raw = bytes(range(200))
    memory = stores.MemoryStore()
    memory.put("a/b", raw)
    files = stores.FileStore(str(tmp_path))
    files.put("a/b", raw)
    stores.write_zip(memory, f"file://{tmp_path}/x.zip")
    server = stores.serve(memory)
    web = stores.HttpStore(f"http://127.0.0.1:{server.server_address[1]}")
    cached = stores.CachingStore(files, stores.MemoryStore())
    for store in (memory, files, web, cached, stores.ZipStore(f"file://{tmp_path}/x.zip"), stores.open_store(f"{tmp_path}/x.zip")):
        assert store.get_range("a/b", 10, 5) == raw[10:15] and store.get_range("a/b", -7, 7) == raw[-7:]
        assert store.get_range("a/b", 190, 50) == raw[190:] and store.get_range("none", 0, 5) is None
        assert store.get("a/b") == raw
    server.shutdown()


def test_chunks_are_fetched_together_and_come_in_order(spark):
    store = Counting(fetches=8)
    x = np.arange(640, dtype="<i8")
    a = ArrayFrame.from_numpy(spark, x, store, "a", chunks=(10,))
    plan = array_source.Plan(store, "a", a.meta, [(0, 640)])
    store.most = 0
    reader = array_source.ArrayReader(plan)
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert np.concatenate([b.column("value").to_numpy() for b in got]).tolist() == x.tolist()
    assert 2 <= store.most <= 8


def test_far_indices_read_their_chunks_alone(spark):
    from pyspark.sql.datasource import In

    a = ArrayFrame.create(spark, "<i8", (100_000,), chunks=(10,), fill_value=0)
    reader = array_source.ArrayReader(array_source.Plan(a.store, "", a.meta, [(0, 100_000)]))
    list(reader.pushFilters([In(("d0",), (3, 7, 99_999, 200_000, -4))]))
    assert [list(r) for r in reader.plan.chunk_ranges()] == [[0, 9999]]


class Broken(Exception):
    pass


@pytest.mark.parametrize("how", ["append", "resize", "save"])
def test_a_failure_in_between_leaves_the_array_as_it_was(spark, tmp_path, monkeypatch, how):
    x = np.arange(25, dtype="<i8")
    a = ArrayFrame.from_numpy(spark, x, f"{tmp_path}/s", "a", chunks=(10,), fill_value=-1)

    def broken(*args, **options):
        raise Broken

    monkeypatch.setattr(frame, {"append": "write_meta", "resize": "shrink", "save": "write_meta"}[how], broken)
    with pytest.raises(Broken):
        if how == "append":
            a.append(np.arange(100, 130, dtype="<i8"))
        elif how == "resize":
            a.resize(7)
        else:
            a.save(f"{tmp_path}/t", "b")
    monkeypatch.undo()
    if how == "save":
        with pytest.raises(ArgumentError):
            ArrayFrame.open(spark, f"{tmp_path}/t", "b")
        return
    b = ArrayFrame.open(spark, f"{tmp_path}/s", "a", mode="w")
    kept = 25 if how == "append" else 7
    assert b.to_numpy().tolist() == x[:kept].tolist()
    if how == "append":
        assert b.append(np.arange(100, 130, dtype="<i8")).to_numpy().tolist() == [*range(25), *range(100, 130)]
    else:
        assert b.trim((25,)).resize(25).to_numpy().tolist() == [*range(7), *[-1] * 18]


def test_cells_are_there_before_the_shape(spark, tmp_path, monkeypatch):
    a = ArrayFrame.from_numpy(spark, np.zeros((4, 3)), f"{tmp_path}/s", "a", chunks=(2, 3))
    seen, plain = [], frame.write_meta
    monkeypatch.setattr(frame, "write_meta", lambda store, path, meta, *x: (seen.append(store.exists(f"{path}/{meta.key((2, 0))}")), plain(store, path, meta, *x)))
    a.append(np.ones((2, 3)))
    assert seen == [True]


def test_attributes_change(spark, tmp_path):
    for format in (2, 3):
        a = ArrayFrame.create(spark, "<i4" if format == 2 else "int32", (4,), f"{tmp_path}/{format}", "a", format=format, fill_value=0, attrs={"p": 1, "q": [2]})
        a.with_attrs(p=None, r="s")
        assert ArrayFrame.open(spark, f"{tmp_path}/{format}", "a").meta.attrs == {"q": [2], "r": "s"}
        g = Group.create(spark, f"{tmp_path}/{format}", "g", format=format)
        g.with_attrs(x=1)
        assert Group.open(spark, f"{tmp_path}/{format}", "g").meta.attrs == {"x": 1}


def test_folders_of_one_machine_are_refused_on_a_cluster():
    class Context:
        master = "local-cluster[3,2,1024]"

        class _jsc:
            @staticmethod
            def sc():
                class Empty:
                    @staticmethod
                    def getCheckpointDir():
                        return type("None_", (), {"isDefined": staticmethod(lambda: False)})

                return Empty

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ArgumentError):
        scratch.scratch(Session, "x")


def _crc(raw):
    c = 0xFFFFFFFF
    for b in raw:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 16_383, 16_384, 16_391, 70_001, 300_000])
def test_crc32c_equals_its_definition(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert codecs.crc32c(raw) == _crc(raw)


def test_crc32c_of_known_strings():
    assert codecs.crc32c(b"123456789") == 0xE3069283 and codecs.crc32c(bytes(32)) == 0x8A9136AA


def test_crc32c_and_bits_are_fast():
    raw = np.random.default_rng(0).integers(0, 256, 32 << 20, dtype=np.uint8).tobytes()
    codecs.crc32c(raw[: 1 << 20])
    began = time.process_time()
    codecs.crc32c(raw)
    took = time.process_time() - began
    assert 32 / took > 25, took  # MB/s, on a slow and busy machine
    began = time.process_time()
    assert codecs.unshuffle_bits(codecs.shuffle_bits(raw, 4), 4) == raw
    assert 64 / (time.process_time() - began) > 15


@pytest.mark.parametrize("size", [1, 2, 3, 8, 12])
@pytest.mark.parametrize("n", [0, 5, 64, 1000])
def test_bits_equal_their_definition(size, n):
    raw = np.random.default_rng(n).integers(0, 256, n * size, dtype=np.uint8)
    whole = n // 8 * 8 * size
    bits = np.unpackbits(raw[:whole].reshape(-1, size), axis=1, bitorder="little") if whole else raw[:0]
    want = (np.packbits(bits.T, axis=1, bitorder="little").tobytes() if whole else b"") + raw[whole:].tobytes()
    assert codecs.shuffle_bits(raw.tobytes(), size) == want and codecs.unshuffle_bits(want, size) == raw.tobytes()


def test_small_buffers_are_stored_as_they_are():
    blosc = codecs.Blosc(typesize=8)
    assert len(blosc.encode(bytes(48))) == 64 and blosc.decode(blosc.encode(bytes(48))) == bytes(48)
    assert len(blosc.encode(bytes(128))) < 128


def test_ratio_of_sequential_integers():
    """One of the hundred chunks of a 10000 by 10000 array of 32-bit integers that count up."""
    x = (np.arange(1000)[:, None] * 10_000 + np.arange(1000)[None]).astype("<i4")
    packed = codecs.Blosc("zstd", 3, 1, 0, 4).encode(x.tobytes())
    assert x.nbytes / len(packed) > 100 and codecs.Blosc.decode(codecs.Blosc(), packed) == x.tobytes()


def test_nulls_become_fill_values_in_bulk(spark):
    a = ArrayFrame.create(spark, "<f8", (6,), chunks=(3,), fill_value=-2.5, fill_as_missing=True)
    cells = spark.range(6).select(F.col("id").alias("d0"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("value"))
    b = a.write(cells)
    assert sorted((r["d0"], r["value"]) for r in b.df.collect()) == [(i, float(i) if i % 2 == 0 else None) for i in range(6)]
    assert sink.blank_chunk(a.meta).tolist() == [-2.5] * 3


def test_a_cache_of_another_array_is_refused(spark, tmp_path):
    from ndspark.operators.group import cached_array

    a = ArrayFrame.from_numpy(spark, np.arange(6), f"{tmp_path}/s", "a", chunks=(4,))
    for _ in range(2):
        assert cached_array(a, f"{tmp_path}/cache").to_numpy().tolist() == list(range(6))
    with pytest.raises(ArgumentError):
        cached_array(a.append(np.arange(3)), f"{tmp_path}/cache")


def test_credentials_go_to_the_file_system():
    import pickle

    pytest.importorskip("pyarrow._s3fs")
    store = stores.open_store("s3a://bucket/top", {"access_key": "k", "secret_key": "s", "region": "us-east-1"})
    again = pickle.loads(pickle.dumps(store))
    assert again.fs.type_name == "s3" and again.root == "bucket/top" and again.fs.region == "us-east-1"
    assert again.fetches == stores.REMOTE_FETCHES
    with pytest.raises(ArgumentError):
        stores.open_store("hdfs://x/y", {"user": "z"})
