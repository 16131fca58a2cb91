import json
import math

import numpy as np
import pytest

from ndspark import dtype, formats, keys
from ndspark.errors import ArgumentError, DimensionMismatch
from ndspark.functions.codecs import Transpose, Zlib, layout_order, make_compressor, make_v3_pipeline, to_v3_compressor
from ndspark.meta import ArrayMeta, GroupMeta, loads
from ndspark.operators.node import node_format, open_meta, write_meta
from ndspark.sources.stores import MemoryStore

V3 = {
    formats.FORMAT_KEY: 3, "node_type": "array", "shape": [4, 6], "data_type": "int16", "fill_value": 0,
    "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 3]}},
    "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
    "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}],
}


def test_v2_document():
    meta = ArrayMeta((3, 2), (3, 2), dtype.parse_v2("<i8"))
    assert meta.to_json() == {
        "chunks": [3, 2], "compressor": None, "dtype": "<i8", "fill_value": None, "filters": None, "node_type": "array",
        "order": "C", "shape": [3, 2], formats.FORMAT_KEY: 2, "dimension_separator": ".",
    }
    assert ArrayMeta.from_v2(meta.to_json()) == meta


def test_v2_compressor_last_among_filters():
    d = ArrayMeta((3,), (3,), dtype.parse_v2("<i8")).to_json() | {"filters": [{"id": "shuffle"}, {"id": "zlib", "level": 1}]}
    meta = ArrayMeta.from_v2(d)
    assert meta.compressor["id"] == "zlib" and [f["id"] for f in meta.filters] == ["shuffle"]


def test_v3_round_trip_and_defaults():
    meta = ArrayMeta.from_v3(V3 | {"attributes": {"a": 1}, "dimension_names": ["x", "y"]})
    assert ArrayMeta.from_v3(meta.to_json()) == meta and meta.attrs == {"a": 1}
    assert ArrayMeta((2,), (2,), dtype.parse_v3("float32"), format=3).fill_value == 0.0


@pytest.mark.parametrize(
    "change",
    [
        {"node_type": "thing"}, {"data_type": "rten"}, {"data_type": "r13"}, {"data_type": "int3"}, {"what": 1},
        {"chunk_grid": {"name": "odd"}}, {"chunk_key_encoding": {"name": "odd"}}, {"shape": [4]},
        {"codecs": [{"name": "odd"}]}, {"codecs": []}, {"codecs": [{"name": "gzip"}]},
        {"codecs": [{"name": "bytes", "configuration": {"endian": "native"}}]},
        {"codecs": [{"name": "transpose", "configuration": {"order": "Z"}}, {"name": "bytes"}]},
        {"codecs": [{"name": "bytes"}, {"name": "blosc", "configuration": {"shuffle": "odd"}}]},
        {"codecs": [{"name": "bytes"}, {"name": "blosc", "configuration": {"shuffle": 7}}]},
        {"codecs": [{"name": "bytes"}, {"name": "bytes"}]}, {formats.FORMAT_KEY: 4}, {"storage_transformers": [1]},
        {"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [0, 3]}}}, {"dimension_names": ["x"]},
    ],
)
def test_v3_errors(change):
    with pytest.raises(ArgumentError):
        ArrayMeta.from_v3(V3 | change)


@pytest.mark.parametrize("name", formats.V3_ARRAY_REQUIRED)
def test_v3_missing_key(name):
    with pytest.raises(ArgumentError):
        ArrayMeta.from_v3({k: v for k, v in V3.items() if k != name})


def test_array_errors():
    kind = dtype.parse_v2("<i4")
    with pytest.raises(ArgumentError):
        ArrayMeta((-1,), (1,), kind)
    with pytest.raises(ArgumentError):
        ArrayMeta((1,), (0,), kind)
    with pytest.raises(DimensionMismatch):
        ArrayMeta((1, 2), (1,), kind)
    with pytest.raises(ArgumentError):
        ArrayMeta((1,), (1,), kind, format=4)
    with pytest.raises(ArgumentError):
        ArrayMeta((1,), (1,), kind, format=3, filters=({"id": "shuffle"},))
    with pytest.raises(ArgumentError):
        ArrayMeta((3,), (1,), kind).resized((-3,))
    d = ArrayMeta((3,), (3,), kind).to_json()
    for bad in ({"order": "F"}, {"dtype": "|O"}, {"dtype": "<m8[s]"}, {"dtype": "<i3"}, {"dtype": [["a", "<i4"]]}, {"compressor": {"id": "odd"}}):
        with pytest.raises(ArgumentError):
            ArrayMeta.from_v2(d | bad)
    with pytest.raises(ArgumentError):
        GroupMeta.from_v3({formats.FORMAT_KEY: 3, "node_type": "group", "extra": 1})


@pytest.mark.parametrize(
    "tag", ["|b1", "|i1", "<i8", "|u1", "<u4", ">u4", "<u16", "<i16", "<c8", "<c16", "<f2", "<f8", "|S5", "<U9", "|O", "<M8[D]", "<M8[ns]"]
)
def test_v2_tags(tag):
    assert dtype.parse_v2(tag).tag == tag


def test_fill_values():
    f8, u1 = dtype.parse_v2("<f8"), dtype.parse_v2("|u1")
    for x, text in ((math.inf, "Infinity"), (-math.inf, "-Infinity")):
        assert dtype.encode_fill(x, f8) == text and dtype.decode_fill(text, f8) == x
    assert dtype.encode_fill(math.nan, f8) == "NaN" and math.isnan(dtype.decode_fill("NaN", f8))
    assert dtype.decode_fill("3.4", f8) == 3.4 and dtype.decode_fill("3", dtype.parse_v2("<i4")) == 3
    assert dtype.decode_fill("", dtype.parse_v2("|S1")) is None and dtype.decode_fill(0, dtype.parse_v2("<U4")) == ""
    assert dtype.decode_fill(-1, u1) == 255
    assert math.isnan(loads(b'{"a": NaN}')["a"])


@pytest.mark.parametrize(
    ("spec", "place", "key"),
    [
        ({"name": "v2"}, (3, 5, 1), "3.5.1"), ({"name": "v2", "configuration": {"separator": "/"}}, (3, 5, 1), "3/5/1"),
        ({"name": "default"}, (3, 5, 1), "c/3/5/1"), ({"name": "default", "configuration": {"separator": "."}}, (3, 5, 1), "c.3.5.1"),
        ({"name": "v2"}, (), "0"), ({"name": "default"}, (), "c/0"), ({"name": "default", "configuration": {"separator": "."}}, (), "c.0"),
        ({"name": "suffix", "configuration": {"suffix": ".blk", "base-encoding": {"name": "default"}}}, (0, 1), "c/0/1.blk"),
        ({"name": "suffix", "configuration": {"suffix": ".part.bin", "base-encoding": {"name": "v2"}}}, (0, 0), "0.0.part.bin"),
    ],
)
def test_chunk_keys(spec, place, key):
    encoding = keys.parse(spec)
    assert encoding.key(place) == key and keys.parse(encoding.to_json()) == encoding


def test_own_key_encoding():
    @keys.register_key_encoding("flat")
    def flat(conf):
        return keys.KeyEncoding("flat", "_", "x")

    assert keys.parse("flat").key((1, 2)) == "x_1_2"


def test_format_2_comes_before_3():
    store, kind = MemoryStore(), dtype.parse_v2("<i4")
    write_meta(store, "a", ArrayMeta((1,), (1,), kind, format=3, fill_value=0))
    assert node_format(store, "a") == 3
    write_meta(store, "a", ArrayMeta((2,), (1,), kind, attrs={"unit": "K"}))
    assert node_format(store, "a") == 2 and open_meta(store, "a").shape == (2,)
    assert store.get("a/" + formats.V2_ATTRS) == b'{"unit":"K"}'
    with pytest.raises(ArgumentError):
        open_meta(store, "b")
    with pytest.raises(ArgumentError):
        open_meta(store, "/a")


def test_layout_and_translation():
    assert layout_order([], 3) == "C" and layout_order([Transpose((2, 1, 0))], 3) == "F"
    assert layout_order([Transpose((2, 1, 0)), Transpose((2, 1, 0))], 3) == "C"
    with pytest.raises(ArgumentError):
        layout_order([Transpose((1, 0, 2))], 3)
    assert to_v3_compressor(Zlib(-1)) == [{"name": "gzip", "configuration": {"level": 6}}]
    assert to_v3_compressor(None) == []
    assert make_compressor({"id": "zstd", "level": 2}, dtype.parse_v2("<i4")).to_json() == {"id": "zstd", "level": 2}
    assert make_v3_pipeline([{"name": "bytes"}, {"name": "numcodecs.zstd"}], dtype.parse_v2("<i4"), (2,)).decode
    with pytest.raises(ArgumentError):
        make_compressor({"id": "blosc", "cname": "odd"}, dtype.parse_v2("<i4"))
    assert json.dumps(np.int64(1).item())


def test_old_transpose_names_and_texts_in_format_3():
    kind, x = dtype.parse_v2("<i2"), np.arange(6, dtype="<i2").reshape(2, 3)
    with pytest.warns(UserWarning, match="out of date"):
        made = make_v3_pipeline([{"name": "transpose", "configuration": {"order": "F"}}, {"name": "bytes"}], kind, (2, 3))
    assert made.encode(x) == x.T.tobytes()
    with pytest.raises(ArgumentError):
        ArrayMeta((1,), (1,), dtype.parse_v3("string"), format=3)


def test_api_names():
    import ndspark

    assert all(getattr(ndspark, n) for n in ndspark._NAMES)
    with pytest.raises(AttributeError):
        ndspark.nothing
