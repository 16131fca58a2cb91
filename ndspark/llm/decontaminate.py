"""Benchmark decontamination as a prefix-filtered set join with positional bounds.

A benchmark item gives windows of `window` consecutive words (a shorter item is one window).
A window occurs in a document only if all its shingles do, so one necessary prefix token is
enough: of the window's shingles in order of rarity over all documents, the first. Documents
are probed for these tokens alone. A hit at position p of a token at offset o gives the only
possible start p - o; starts that the document's length rules out go, and the rest are
verified word by word.

Documents never shuffle. The benchmark is cut into blocks of a checked size, which are built
and written to the shared folder one at a time; an item larger than a block is cut as well, as
its windows do not depend on each other. A task holds some documents against one block after
the other, so neither driver nor worker ever holds more than one block, and documents are read
twice, however many blocks there are: to count shingles, and to probe.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, new_folder, small_batches, stage, unstage
from .tokenfiles import open_fs

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 64 << 20  # of one block: its words and its windows' ids; under 2^20 words
HELD_BYTES = 64 << 20  # of texts that a task holds against all blocks in turn
PAIRS = 1 << 18  # verified at once in a task

# A-Z to a-z; what is not a word byte (0-9, a-z, 0x80 and above) to a space
_WORD_BYTES = bytes(
    x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32
    for x in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_WORD_BYTES).split()


@dataclass
class Block:
    """Windows over one block of items. words: to ids from 1. window_ids: zero-padded rows.
    codes: the sorted shingle codes of all windows; prefix windows are grouped by code."""

    words: dict[bytes, int]
    items: list[str]
    window_ids: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray
    codes: dict[int, np.ndarray]
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None


def _codes(ids: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where k known words follow each other, and their shingles' codes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = ids > 0
    all_known = known[:n].copy()
    for i in range(1, k):
        all_known &= known[i : n + i]
    at = np.flatnonzero(all_known)
    code = np.zeros(len(at), np.int64)
    for i in range(k):
        code = code * base + ids[at + i]
    return at, code


def _ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.get, words, itertools.repeat(0)), np.int64, len(words))


def build_block(items: list[tuple[str, list[bytes]]], window: int, shingle: int) -> Block:
    known: dict[bytes, int] = {}
    for _, words in items:
        for w in words:
            known.setdefault(w, len(known) + 1)
    names = sorted({name for name, _ in items})
    place = {name: i for i, name in enumerate(names)}
    found: dict[tuple[int, ...], set[int]] = {}
    for name, words in items:
        ids = [known[w] for w in words]
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1):
            found.setdefault(tuple(ids[i : i + n]), set()).add(place[name])
    rows = [(w, owner) for w, owners in found.items() for owner in sorted(owners)]
    ids = np.zeros((len(rows), window), np.int64)
    for i, (w, _) in enumerate(rows):
        ids[i, : len(w)] = w
    lengths = np.array([len(w) for w, _ in rows], np.int64)
    base, codes = len(known) + 1, {}
    for k in sorted({min(shingle, int(n)) for n in set(lengths)}):
        own = ids[np.minimum(lengths, shingle) == k]
        made = [_codes(row, k, base)[1] for row in own]
        codes[k] = np.unique(np.concatenate(made))
    return Block(known, names, ids, lengths, np.array([o for _, o in rows], np.int64), codes)


class Blocks:
    """Blocks in a folder of their own; a worker remembers the last one that it read."""

    def __init__(self, uri: str):
        self.uri, self.n = uri, 0

    def write(self, i: int, block: Block) -> None:
        fs, base = open_fs(self.uri)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/block-{i:06d}") as f:
            f.write(pickle.dumps(block, 5))
        self.n = max(self.n, i + 1)

    def read(self, i: int) -> Block:
        fs, base = open_fs(self.uri)
        with fs.open_input_stream(f"{base}/block-{i:06d}") as f:
            return pickle.loads(f.read())

    def each(self, last: dict[int, Block]) -> Iterator[tuple[int, Block]]:
        """All blocks, one at a time; `last` holds that of the turn before."""
        for i in range(self.n):
            if i not in last:
                last.clear()
                last[i] = self.read(i)
            yield i, last[i]


def _held(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at most about HELD_BYTES of text."""
    held, size = [], 0
    for batch in small_batches(batches, text):
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(blocks: Blocks, text: str):
    """Occurrences of the blocks' shingles, summed within a list of batches."""

    def run(batches):
        last: dict[int, Block] = {}
        for held in _held(batches, text):
            for b, block in blocks.each(last):
                base = len(block.words) + 1
                total = {k: np.zeros(len(c), np.int64) for k, c in block.codes.items()}
                for batch in held:
                    for raw in binary_texts(batch, text):
                        ids = _ids(words_of(raw), block.words)
                        for k, codes in block.codes.items():
                            _, code = _codes(ids, k, base)
                            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                            np.add.at(total[k], at[codes[at] == code], 1)
                for k, sums in total.items():
                    some = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), x, np.int32)) for x in (b, k)]
                        + [pa.array(some), pa.array(sums[some])],
                        names=["block", "k", "at", "n"],
                    )

    return run


def prepare(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str,
    item_key: str,
    item_text: str,
    window: int,
    shingle: int,
    block_bytes: int,
) -> Blocks:
    """Blocks with their prefixes chosen by how often each shingle occurs in all documents."""
    spark = docs.sparkSession
    blocks = Blocks(new_folder(spark, "benchmark"))
    for i, block in enumerate(_blocks(benchmark, item_key, item_text, window, shingle, block_bytes)):
        blocks.write(i, block)
    counts = stage(
        docs.select(text)
        .mapInArrow(_count(blocks, text), "block int, k int, at long, n long")
        .groupBy("block", "k", "at")
        .agg(F.sum("n").alias("n")),
        "benchmark-counts",
    )
    for i in range(blocks.n):
        block = blocks.read(i)
        totals = {k: np.zeros(len(c), np.int64) for k, c in block.codes.items()}
        # at most one row for each shingle of a block
        for _, k, at, n in counts.where(F.col("block") == i).collect():
            totals[k][at] = n
        choose_prefix(block, totals, shingle)
        blocks.write(i, block)
    unstage(counts)
    return blocks


def choose_prefix(block: Block, counts: dict[int, np.ndarray], shingle: int) -> None:
    """For each window its rarest shingle (ties: the lower code, then the first offset)."""
    base, chosen = len(block.words) + 1, {k: [] for k in block.codes}
    for i, (row, n) in enumerate(zip(block.window_ids, block.lengths, strict=True)):
        k = min(shingle, int(n))
        at, code = _codes(row[:n], k, base)
        own = np.searchsorted(block.codes[k], code)
        best = np.lexsort((at, code, counts[k][own]))[0]
        chosen[k].append((code[best], at[best], i))
    block.prefix = {}
    for k, rows in chosen.items():
        rows.sort()
        code, offset, window = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        tokens, first = np.unique(code, return_index=True)
        block.prefix[k] = (tokens, np.append(first, len(code)), offset, window)


def _occurrences(ids: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, windows) of verified occurrences."""
    base, n = len(block.words) + 1, len(ids)
    cols = np.arange(block.window_ids.shape[1])
    for k, (tokens, first, offset, window) in (block.prefix or {}).items():
        at, code = _codes(ids, k, base)
        if not len(at):
            continue
        own = np.minimum(np.searchsorted(tokens, code), len(tokens) - 1)
        hit = tokens[own] == code
        at, own = at[hit], own[hit]
        many = first[own + 1] - first[own]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(at):  # a bounded number of candidates at once
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            m = many[lo:hi]
            row = np.repeat(first[own[lo:hi]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            start, win = np.repeat(at[lo:hi], m) - offset[row], window[row]
            fits = (start >= 0) & (start + block.lengths[win] <= n)
            start, win = start[fits], win[fits]
            length = block.lengths[win][:, None]
            place = np.minimum(start[:, None] + cols, n - 1)
            same = ((ids[place] == block.window_ids[win]) | (cols >= length)).all(axis=1)
            if same.any():
                yield start[same], win[same]
            lo = hi


def _probe(blocks: Blocks, key: str, text: str):
    def run(batches):
        last: dict[int, Block] = {}
        for held in _held(batches, text):
            spans = [[[] for _ in range(batch.num_rows)] for batch in held]
            names = [[set() for _ in range(batch.num_rows)] for batch in held]
            sizes = [[0] * batch.num_rows for batch in held]
            for _, block in blocks.each(last):
                for j, batch in enumerate(held):
                    for i, raw in enumerate(binary_texts(batch, text)):
                        ids = _ids(words_of(raw), block.words)
                        sizes[j][i] = len(ids)
                        for start, win in _occurrences(ids, block):
                            spans[j][i].append((start, start + block.lengths[win]))
                            names[j][i].update(block.items[x] for x in np.unique(block.owners[win]))
            for batch, own, found, size in zip(held, spans, names, sizes, strict=True):
                hits = [_covered(x, n) for x, n in zip(own, size, strict=True)]
                items = [sorted(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        pa.array(size, pa.int64()),
                        pa.array(hits, pa.int64()),
                        pa.array(list(map(len, items)), pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                        pa.array([x > 0 for x in hits], pa.bool_()),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
                )

    return run


def _covered(spans: list[tuple[np.ndarray, np.ndarray]], n: int) -> int:
    """Words of n that lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    for start, end in spans:
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
    return int((np.cumsum(edge) > 0).sum())


def _blocks(
    benchmark: DataFrame, key: str, text: str, window: int, shingle: int, block_bytes: int
) -> Iterator[Block]:
    """Blocks of items, read one at a time. An item that is larger than a block comes in parts
    that overlap by a window less one word: they have the same windows."""
    items, size = [], 0
    most = max(window, block_bytes // (8 * window + 8))  # words of a part
    for name, body in benchmark.select(F.col(key).cast("string"), text).toLocalIterator():
        words = words_of(body.encode("utf-8", "surrogatepass") if body is not None else None)
        for lo in range(0, max(0, len(words) - window) + 1 if words else 0, most):
            part = words[lo : lo + most + window - 1]
            cost = sum(map(len, part)) + 8 * window * len(part)
            if items and size + cost > block_bytes:
                yield build_block(items, window, shingle)
                items, size = [], 0
            items.append(("null" if name is None else name, part))
            size += cost
    yield build_block(items, window, shingle)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside any occurrence of a
    window), n_items and items (ids of items with occurring windows, sorted as strings),
    items_sha256 (of the ids, comma-joined), contaminated.

    Null and empty texts have no words, on either side; an item without words matches
    nothing, and a null item id is named "null". Items of equal id count once, equal windows
    of different items count for each. Repeated documents stay repeated, null keys are kept,
    other columns are not read, and either table may be empty.
    """
    blocks = prepare(docs, benchmark, text, item_key, item_text, window, shingle, block_bytes)
    schema = (
        f"doc_id {dict(docs.dtypes)[key]}, n_words long, n_hit long, n_items long, items array<string>, "
        "items_sha256 string, contaminated boolean"
    )
    return docs.select(key, text).mapInArrow(_probe(blocks, key, text), schema)


def _untouched(blocks: Blocks, text: str):
    def run(batches):
        last: dict[int, Block] = {}
        for held in _held(batches, text):
            keep = [np.ones(batch.num_rows, bool) for batch in held]
            for _, block in blocks.each(last):
                for own, batch in zip(keep, held, strict=True):
                    for i, raw in enumerate(binary_texts(batch, text)):
                        own[i] &= not (own[i] and any(True for _ in _occurrences(_ids(words_of(raw), block.words), block)))
            for own, batch in zip(keep, held, strict=True):
                yield batch.filter(pa.array(own))

    return run


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs that contamination() would not mark, with all their columns. No join:
    the blocks of the benchmark take out the rows that hold one of their windows."""
    blocks = prepare(docs, benchmark, text, item_key, item_text, window, shingle, block_bytes)
    return docs.mapInArrow(_untouched(blocks, text), docs.schema)
