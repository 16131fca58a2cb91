"""Token-id files with a shared compression dictionary.

A set of shards holds documents in ascending order of their key, each as the ids of its text
and an end id, compressed on its own with one zstandard dictionary trained on serialised id
arrays. A short document is read by its offset alone, and the dictionary carries what it
has in common with others.

Fixed values of the file format, version 1; numbers are little-endian:

    0   8 bytes   magic "NDTOKEN1"
    8   32 bytes  SHA-256 of the dictionary
    40  u8        bytes of an id: 2 or 4
    41  u8        1 if documents are compressed with the dictionary, else 0
    42  6 bytes   zero
    48  ...       the documents' blobs, one after the other
    i   n * 24    index: i64 key, u64 offset of the blob, u32 its bytes, u32 its ids
    -16 u64       i, where the index starts
    -8  u64       n, the number of documents

A missing key is written as the least 64-bit integer. The dictionary lies beside the shards,
named by its hash.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, least_by_hash, new_folder, small_batches

MAGIC = b"NDTOKEN1"
HEAD, TAIL = 48, 16
INDEX = np.dtype([("key", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("count", "<u4")])
NO_KEY = -(1 << 63)

SAMPLE_DOCS = 1024  # documents, least by the hash of their key, that train the dictionary
SAMPLE_BYTES = 4096  # of each one's serialised ids, from a place by the hash of its key
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SHARD_BYTES = 256 << 20
READ_IDS = 8 << 20  # bytes of ids that a reader holds at once, or one document


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, on whichever machine this runs."""
    uri = uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def publish(fs: pafs.FileSystem, temporary: str, path: str) -> None:
    """Rename onto the final name; a second attempt of a task replaces what the first left."""
    if fs.type_name == "local":
        os.replace(temporary, path)
    else:
        fs.move(temporary, path)


class ChunkTokenizer:
    """The tokenizers library over whole texts, chunk by chunk between ASCII white space, which
    no token of such a file spans. Remembers recent chunks, and the words of plain ones: the
    library gets new words, many in one text, and the ends of words part its ids again."""

    def __init__(self, path: str, memo: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.limit = memo
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = [x.content.lower().encode() for x in added]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.plain = re.compile(rb"[a-z0-9!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+").fullmatch if suffix else lambda c: None
        self.find = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+").findall

    def _library(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _by_words(self, chunks: list[bytes]) -> None:
        split = [self.find(c) for c in chunks]
        new = list({w for words in split for w in words if w not in self.words})
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
            new = list({w for words in split for w in words})
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        for group, ids in zip(groups, self._library([b" ".join(g) for g in groups]), strict=True):
            raw, ends = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(group):  # not a file whose words end so
                self.words |= {w: x.tobytes() for w, x in zip(group, self._library(group), strict=True)}
                continue
            starts = [0, *ends[:-1].tolist()]
            self.words |= {w: raw[lo:hi] for w, lo, hi in zip(group, starts, ends.tolist(), strict=True)}
        get = self.words.__getitem__
        for c, words in zip(chunks, split, strict=True):
            self.memo[c] = b"".join(map(get, words))

    def _remember(self, found: list[bytes]) -> None:
        """Every chunk's ids into the memo. When that is half of the limit it becomes the older one,
        from which chunks that come again are taken back."""
        get, memo = self.older.get, self.memo
        new = []
        for c in found:
            if c not in memo:
                ids = get(c)
                if ids is None:
                    new.append(c)
                else:
                    memo[c] = ids
        plain, other = [], []
        for c in new:
            (plain if len(c) <= 64 and self.plain(c) else other).append(c)
        self._by_words(plain)
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            memo |= {c: x.tobytes() for c, x in zip(part, self._library(part), strict=True)}

    def encode_all(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Arrow cuts the texts and
        numbers the chunks, so that Python meets each distinct one once."""
        lows = []
        for raw in raws:
            low = raw.lower()  # A-Z alone; not where that could make a special token
            lows.append(raw if any(x in low for x in self.marks) else low)
        texts = pa.array(lows, pa.large_binary())
        chunks = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), texts.buffers()))
        ends = chunks.offsets.to_numpy()
        coded = chunks.values.dictionary_encode()
        own = coded.dictionary
        found = pa.Array.from_buffers(pa.large_binary(), len(own), own.buffers()).to_pylist()
        self._remember(found)
        made = list(map(self.memo.__getitem__, found))
        for c in found:  # long chunks are not kept
            if len(c) > 64:
                del self.memo[c]
        if len(self.memo) > self.limit // 2:
            self.older, self.memo = self.memo, {b"": b""}
        ids = np.frombuffer(b"".join(made), "<u4")
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        which = coded.indices.to_numpy()
        counts = sizes[which]
        after = np.concatenate([[0], np.cumsum(counts)])
        # the place of each id: where its chunk's ids start, and how far it is in them
        place = np.repeat((np.cumsum(sizes) - sizes)[which] - after[:-1], counts)
        place += np.arange(len(place))
        flat, cuts = ids[place], after[ends].tolist()
        return [flat[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    top = max(t.get_vocab(with_added_tokens=True).values())
    return 2 if top < 1 << 16 else 4


def _pack(ids: bytes, width: int, end: int | None) -> bytes:
    numbers = np.frombuffer(ids, "<u4")
    if end is not None:
        numbers = np.append(numbers, np.uint32(end))
    return numbers.astype("<u2" if width == 2 else "<u4").tobytes()


def _sampled(text: str, path: str, width: int):
    def run(batches):
        encoder = worker_tokenizer(path)
        for batch in small_batches(batches, text, 4 << 20):
            out = []
            for raw, place in zip(binary_texts(batch, text), batch.column("place").to_pylist(), strict=True):
                ids = _pack(encoder.encode_all([raw or b""])[0], width, None)
                at = place % max(1, len(ids) - SAMPLE_BYTES + 1) // width * width
                out.append(ids[at : at + SAMPLE_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return run


def train_dictionary(
    docs: DataFrame, path: str, key: str, text: str, width: int, sample: int = SAMPLE_DOCS
) -> bytes:
    """A dictionary from SAMPLE_BYTES of the id arrays of at most `sample` documents, those least
    by the hash of their key, from anywhere in them. Empty if they hold too little to train on."""
    # keys alone are sorted; then only rows up to the last hash bring their texts
    last = least_by_hash(docs.select(key), [key], sample).agg(F.max(F.xxhash64(key))).first()[0]
    if last is None:
        return b""
    place = F.expr(f"pmod(xxhash64(`{key}`, 'place'), 1073741824)").alias("place")
    chosen = docs.where(F.xxhash64(key) <= last).select(F.col(text), place).limit(sample)
    packed = [bytes(r["ids"]) for r in chosen.mapInArrow(_sampled(text, path, width), "ids binary").collect()]
    packed = [x for x in packed if len(x) >= 64]
    total = sum(map(len, packed))
    if len(packed) < 16 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 4), packed).as_bytes()
    except zstandard.ZstdError:  # too uniform to train on
        return b""


class ShardWriter:
    """Writes one shard to a temporary name, and publishes it when it is complete."""

    def __init__(self, uri: str, name: str, dictionary: bytes, width: int):
        self.fs, base = open_fs(uri)
        self.path, self.temporary = f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        digest = hashlib.sha256(dictionary).digest()
        self.out.write(MAGIC + digest + bytes([width, bool(dictionary)]) + bytes(6))
        self.at, self.width, self.index = HEAD, width, []
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)
        self.tokens = 0

    def add(self, key: int | None, ids: bytes, end: int | None) -> None:
        packed = _pack(ids, self.width, end)
        blob, n = self.zstd.compress(packed), len(packed) // self.width
        self.out.write(blob)
        self.index.append((NO_KEY if key is None else key, self.at, len(blob), n))
        self.at += len(blob)
        self.tokens += n

    def close(self) -> None:
        rows = np.array(self.index, INDEX)
        self.out.write(rows.tobytes())
        self.out.write(np.array([self.at, len(rows)], "<u8").tobytes())
        self.out.close()
        publish(self.fs, self.temporary, self.path)


def _write(key: str, text: str, path: str, uri: str, dictionary: bytes, width: int, end: int | None):
    def run(batches):
        encoder, writer, name, part, rows = worker_tokenizer(path), None, "", 0, []
        task = TaskContext.get().partitionId()

        def close():
            writer.close()
            rows.append((name, task, part, len(writer.index), writer.tokens))

        for batch in small_batches(batches, text, 4 << 20):
            keys = batch.column(key).to_pylist()
            raws = [x or b"" for x in binary_texts(batch, text)]
            for k, ids in zip(keys, encoder.encode_all(raws), strict=True):
                if writer is not None and writer.at >= SHARD_BYTES:
                    close()
                    writer, part = None, part + 1
                if writer is None:
                    name = f"shard-{task:06d}-{part:04d}.tok"
                    writer = ShardWriter(uri, name, dictionary, width)
                writer.add(k, ids, end)
        if writer is not None:
            close()
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
            names=["name", "task", "part", "docs", "tokens"],
        )

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    uri: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = 1,
    partitions: int | None = None,
) -> list[tuple[str, int]]:
    """Write the ids of all documents to shards below `uri`, in ascending order of the key;
    null keys come first, and equal keys stay beside each other, ordered by a hash
    of the text. Returns (shard, ids of
    all shards before it) in order: one entry for each shard, which the driver also writes to
    `uri` as MANIFEST. Null texts are empty; the end id alone is written for them."""
    spark = docs.sparkSession
    width = id_width(path)
    if end_id is not None and end_id >= 1 << (8 * width):
        width = 4
    dictionary = train_dictionary(docs, path, key, text, width)
    fs, base = open_fs(uri)
    fs.create_dir(base, recursive=True)
    digest = hashlib.sha256(dictionary).hexdigest()
    with fs.open_output_stream(f"{base}/{digest}.dict") as f:
        f.write(dictionary)
    frame, order = docs.select(key, text), (F.col(key).asc_nulls_first(), F.xxhash64(text))
    # the hash parts rows of equal keys, and keeps texts out of the sample of the ranges
    dealt = frame.repartitionByRange(partitions, *order) if partitions else frame.repartitionByRange(*order)
    rows = (
        dealt.sortWithinPartitions(*order)
        .mapInArrow(
            _write(key, text, path, uri, dictionary, width, end_id),
            "name string, task int, part int, docs long, tokens long",
        )
        .collect()
    )
    shards, before = [], 0
    for r in sorted(rows, key=lambda r: (r["task"], r["part"])):
        shards.append((r["name"], before))
        before += r["tokens"]
    with fs.open_output_stream(f"{base}/MANIFEST") as f:
        f.write("".join(f"{name}\t{start}\n" for name, start in shards).encode())
    return shards


class ShardReader:
    """Reads a shard's index, then any document by its place."""

    def __init__(self, uri: str, name: str):
        self.fs, base = open_fs(uri)
        self.file = self.fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        head = self.file.read_at(HEAD, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.width = head[40]
        at, n = np.frombuffer(self.file.read_at(TAIL, size - TAIL), "<u8")
        self.index = np.frombuffer(self.file.read_at(int(n) * INDEX.itemsize, int(at)), INDEX)
        shared = None
        if head[41]:
            digest = head[8:40].hex()
            with self.fs.open_input_file(f"{base}/{digest}.dict") as f:
                raw = f.read()
            if hashlib.sha256(raw).hexdigest() != digest:
                raise ValueError(f"the dictionary of {name} does not match its hash")
            shared = zstandard.ZstdCompressionDict(raw)
        self.zstd = zstandard.ZstdDecompressor(dict_data=shared)

    def ids(self, i: int) -> np.ndarray:
        row = self.index[i]
        raw = self.file.read_at(int(row["size"]), int(row["offset"]))
        out = self.zstd.decompress(raw, max_output_size=max(1, int(row["count"]) * self.width))
        return np.frombuffer(out, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, key: int) -> Iterator[np.ndarray]:
        """The documents of a key: the index is sorted."""
        lo, hi = (np.searchsorted(self.index["key"], key, side) for side in ("left", "right"))
        for i in range(lo, hi):
            yield self.ids(i)

    def close(self) -> None:
        self.file.close()


def _read(uri: str, keep_ids: bool):
    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, start = ShardReader(uri, name), before
                counts = reader.index["count"].astype(np.int64)
                ends, lo = np.cumsum(counts * reader.width), 0
                while lo < len(counts):
                    done = ends[lo - 1] if lo else 0
                    hi = min(lo + 4096, max(lo + 1, int(np.searchsorted(ends, done + READ_IDS, "right"))))
                    own, keys = counts[lo:hi], reader.index["key"][lo:hi]
                    sums, ids = [], []
                    for i in range(lo, hi):
                        raw = reader.ids(i).tobytes()
                        sums.append(zlib.crc32(raw))
                        if keep_ids:
                            ids.append(raw)
                    out = {
                        "doc_id": pa.array(keys, mask=keys == NO_KEY),
                        "start": pa.array(start + np.cumsum(own) - own),
                        "n_tokens": pa.array(own),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                    if keep_ids:
                        out["ids"] = pa.array(ids, pa.binary())
                    start, lo = start + int(own.sum()), hi
                    yield pa.RecordBatch.from_pydict(out)
                reader.close()

    return run


def read_token_files(
    spark: SparkSession, uri: str, shards: list[tuple[str, int]] | None = None, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, one task for a
    shard: start is the number of ids before it, ids_crc32 over its ids, end id included, as
    little-endian unsigned 32-bit integers; with keep_ids also the ids."""
    if shards is None:
        fs, base = open_fs(uri)
        with fs.open_input_file(f"{base}/MANIFEST") as f:
            lines = [x.split("\t") for x in f.read().decode().splitlines()]
        shards = [(name, int(start)) for name, start in lines]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    if not shards:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame(shards, "name string, start long").repartition(len(shards))
    return names.mapInArrow(_read(uri, keep_ids), schema)


def token_files(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1
) -> DataFrame:
    """Write token files of docs to the shared folder and read them back; one row for each row
    of docs. The key is an integer; null keys are kept and come first, repeated rows stay
    repeated, null texts are empty, other columns are not read, an empty table gives none."""
    uri = new_folder(docs.sparkSession, "tokens")
    shards = write_token_files(docs, path, uri, key, text, end_id)
    return read_token_files(docs.sparkSession, uri, shards)
