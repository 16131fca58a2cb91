import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ndspark.dtype import parse_v2
from ndspark.errors import ArgumentError
from ndspark.functions import codecs as c
from ndspark.functions import filters as f
from ndspark.functions.sharding import make_sharding

BIG = {"name": "bytes", "configuration": {"endian": "big"}}
LITTLE = {"name": "bytes", "configuration": {"endian": "little"}}


def test_fletcher32_known_bytes():
    x = np.array([1911, -2427, 1897, -2412, 2440, 873, -621, -829, 551, -2118], "<i8")
    assert f.Fletcher32().encode(x) == x.tobytes() + bytes.fromhex("fd258664")
    with pytest.raises(c.ChecksumError):
        f.Fletcher32().decode(b"\1" + f.Fletcher32().encode(x)[1:])


def test_crc32c():
    assert c.crc32c(b"123456789") == 0xE3069283
    stored = c.Crc32c().encode(b"12345678")
    assert len(stored) == 12 and c.Crc32c().decode(stored) == b"12345678"
    with pytest.raises(c.ChecksumError):
        c.Crc32c().decode(stored[:-1] + bytes([stored[-1] ^ 1]))


@settings(max_examples=60, deadline=None)
@given(raw=st.binary(max_size=5000), size=st.sampled_from([1, 2, 3, 4, 8, 16]))
def test_bytes_codecs_round_trip(raw, size):
    raw = raw * 7
    for made in (c.Zlib(), c.Gzip(), c.Zstd(), c.Zstd(3, True), c.Crc32c(), f.Fletcher32(), f.Shuffle(size)):
        assert bytes(made.decode(made.encode(raw))) == raw
    for name in ("lz4", "zstd", "zlib", "snappy"):
        for shuffle in (-1, 0, 1, 2):
            made = c.Blosc(name, 5, shuffle, 0, size)
            assert made.decode(made.encode(raw)) == raw
    assert c.unshuffle_bits(c.shuffle_bits(raw, size), size) == raw


def test_blosc_blocks_and_splits():
    raw = np.arange(400_000, dtype="<i4").tobytes()
    made = c.Blosc("lz4", 5, 1, 1 << 16, 4)
    stored = made.encode(raw)
    assert len(stored) < len(raw) // 4 and made.decode(stored) == raw
    # a container as other writers lay it out: the first block split by bytes of the element
    block = np.arange(1024, dtype="<i4").tobytes()
    parts = [c._inner_encode("lz4", 5, c.shuffle_bytes(block, 4)[i * 1024 : (i + 1) * 1024]) for i in range(4)]
    body = b"".join(len(p).to_bytes(4, "little") + p for p in parts)
    head = bytes([2, 1, c.BLOSC_SHUFFLED | 1 << 5, 4]) + b"".join(n.to_bytes(4, "little") for n in (4096, 4096, 20 + len(body)))
    assert made.decode(head + (20).to_bytes(4, "little") + body) == block
    # the own inner codec: a literal run, then a match
    assert c._blosclz_decode(bytes([2]) + b"abc" + bytes([(4 << 5), 2]), 9) == b"abcabcabc"
    with pytest.raises(ArgumentError):
        c.Blosc(shuffle=3)


@pytest.mark.parametrize("digits", range(1, 13))
def test_quantize(digits):
    x = np.linspace(-3, 7, 101)
    got = f.Quantize(digits, "<f8", "<f8").encode(x)
    assert np.abs(got - x).max() <= 0.5 * 10.0**-digits
    assert f.quantize_bits(1) == 4 and f.quantize_bits(5) == 17 and f.quantize_bits(12) == 40


def test_delta():
    x = np.array([40, 37, 37, 52, -8])
    made = f.Delta("<i8", "<i4")
    assert made.encode(x).tolist() == [40, -3, 0, 15, -60] and (made.decode(made.encode(x)) == x).all()
    wrap = np.array([3, 1, 255, 0], "u1")
    assert (f.Delta("|u1", "|u1").decode(f.Delta("|u1", "|u1").encode(wrap)) == wrap).all()


def test_scale_offset_and_text():
    x = np.linspace(1000, 1001, 10)
    made = f.FixedScaleOffset(1000, 10, "<f8", "|u1")
    assert made.encode(x).dtype == np.uint8 and np.abs(made.decode(made.encode(x)) - x).max() <= 0.05
    texts = np.array(["", "é", "日本"], object)
    assert f.VlenUtf8().decode(f.VlenUtf8().encode(texts)).tolist() == texts.tolist()
    assert f.VlenUtf8().encode(texts)[:4] == b"\3\0\0\0"
    with pytest.raises(ArgumentError):
        f.make_filter({"id": "odd"})


def test_endian_and_transpose():
    x = np.arange(6, dtype="<i2").reshape(2, 3)
    assert c.make_v3_pipeline([BIG], parse_v2("<i2"), (2, 3)).encode(x) == x.astype(">i2").tobytes()
    chain = c.make_v3_pipeline([{"name": "transpose", "configuration": {"order": [1, 0]}}, LITTLE], parse_v2("<i2"), (2, 3))
    assert chain.encode(x) == x.T.tobytes() and (chain.decode(x.T.tobytes()) == x).all()
    three = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    odd = c.make_v3_pipeline([{"name": "transpose", "configuration": {"order": [1, 2, 0]}}, LITTLE], parse_v2("<i2"), (2, 3, 4))
    assert (odd.decode(odd.encode(three)) == three).all()


def _shard(shape, inner, location="end", index=None, codecs=None, fill=None):
    conf = {"chunk_shape": list(inner), "codecs": codecs or [LITTLE], "index_codecs": index or [LITTLE, {"name": "crc32c"}], "index_location": location}
    return make_sharding(conf | {"_shape": shape, "_fill": fill}, parse_v2("<i2"))


@pytest.mark.parametrize("location", ["start", "end"])
@pytest.mark.parametrize(("shape", "inner"), [((4,), (4,)), ((4,), (2,)), ((3,), (2,)), ((3, 3), (2, 2)), ((4, 4), (1, 1)), ((3, 3, 3), (3, 3, 1))])
def test_shards(shape, inner, location):
    kind = parse_v2("<i2")
    x = (np.arange(np.prod(shape)) + 1).astype("<i2").reshape(shape)
    for index in ([LITTLE], [LITTLE, {"name": "crc32c"}]):
        made = _shard(shape, inner, location, index, [LITTLE, {"name": "gzip"}])
        assert (made.decode(made.encode(x, kind), kind, shape) == x).all()
        assert made.encode(x * 0, kind) == b"" and (made.decode(b"", kind, shape) == 0).all()


def test_shard_layout_and_errors():
    kind = parse_v2("<i2")
    x = np.array([1, 2, 0, 0], "<i2")
    raw = _shard((4,), (2,)).encode(x, kind)
    none = b"\xff" * 16
    assert raw[:4] == x[:2].tobytes() and raw[4:20] == bytes(8) + (4).to_bytes(8, "little") and raw[20:36] == none
    assert len(raw) == 4 + 32 + 4
    nine = _shard((4,), (2,), fill=9)
    assert nine.decode(nine.encode(np.array([9, 9, 1, 9], "<i2"), kind), kind, (4,)).tolist() == [9, 9, 1, 9]
    with pytest.raises(ArgumentError):
        _shard((4,), (2,), index=[LITTLE, {"name": "gzip"}])
    with pytest.raises(ArgumentError):
        _shard((4,), (2,), location="middle")


def test_shard_box_decodes_only_what_it_needs(monkeypatch):
    kind, x = parse_v2("<i2"), np.arange(1, 65, dtype="<i2").reshape(8, 8)
    made = _shard((8, 8), (2, 2))
    raw, seen = made.encode(x, kind), []
    whole = c.V3Pipeline.decode

    def counted(self, part, box=None):
        seen.append(len(part))
        return whole(self, part, box)

    monkeypatch.setattr(c.V3Pipeline, "decode", counted)
    got = made.decode_box(raw, kind, (8, 8), [(2, 4), (0, 3)])
    assert (got[2:4, 0:3] == x[2:4, 0:3]).all() and len(seen) == 1 + 2
