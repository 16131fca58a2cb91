"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits. Partition i gets a
threshold t_i >= -1 (-1: not probed) with sum(t_i) = tau - m + 1; two fingerprints within
tau then agree within t_i on at least one probed partition. A dynamic program picks the
thresholds by estimated candidate counts. Every fingerprint probes, every hit is verified.

A bucket of more than `bucket_limit` fingerprints is not paired up. Its fingerprints, and
those that probe it, go to a midpoint step instead: two fingerprints within tau bits share a
midpoint within half of tau of both, so each emits all numbers that near, itself included, and
is linked with the least fingerprint that is within the smaller half of the same midpoint. At 2
bits a midpoint has 65 possible members, so nothing grows with the bucket, and no link between
classes is lost.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from .common import binary_texts, least_by_hash, small_batches, stage, unstage
from .components import components

SHINGLE_WORDS = 3
SEED = 42
SAMPLE = 1 << 14  # fingerprints that the partitioning is fitted on
BUCKET_LIMIT = 128
ROW_COST = 16  # of a probe, which is shuffled and sorted, against a candidate, which is one comparison
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(raw: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's UTF-8 bytes; no words: 0."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    k = words_per_shingle
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):  # bounds the memory for very long texts
        part = words[at : min(at + (1 << 16), n) + k - 1]
        line = b" ".join(part)
        ends = list(itertools.accumulate(len(w) + 1 for w in part))
        starts = [0, *ends]
        h = np.fromiter(
            (digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)),
            np.uint64,
            len(part) - k + 1,
        )
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(_WEIGHTS[2 * total > n].sum(dtype=np.uint64))


def _fingerprints(key: str, text: str):
    def run(batches):
        for batch in small_batches(batches, text):
            found = np.array([fingerprint(x) for x in binary_texts(batch, text)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null text: 0."""
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(_fingerprints(key, text), f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Plan:
    """masks: the bits of each partition. thresholds: -1, 0, 1 or 2 for each."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]
    cost: float


def _group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about 64 / m bits; each takes the bits most correlated with its own."""
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for i in range(m):
        want = (64 - sum(map(len, groups))) // (m - i)
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < want:
            best = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(best)
            left.discard(best)
        groups.append(sorted(own))
    return groups


def _pairs(values: np.ndarray) -> float:
    _, counts = np.unique(values, return_counts=True)
    return float((counts * (counts - 1.0)).sum() / 2)


def _estimates(sample: np.ndarray, group: list[int], n: int, most: int) -> list[float]:
    """Estimated cost of probes and candidate pairs for thresholds 0..most of one partition, at
    n fingerprints."""
    mask = np.uint64(sum(1 << b for b in group))
    own, w = sample & mask, len(group)
    scale = (n / max(1, len(sample))) ** 2
    same = _pairs(own)
    out = [ROW_COST * n + same * scale]
    if most >= 1:
        near = same + sum(max(0.0, _pairs(own & ~np.uint64(1 << b)) - same) for b in group)
        out.append(ROW_COST * n * (1 + w) + near * scale)
    if most >= 2:
        out.append(ROW_COST * n * (1 + w + w * (w - 1) / 2) + near * scale * w)
    return out


def fit(sample: np.ndarray, n: int, tau: int = 2) -> Plan:
    """The cheapest plan among 2 to tau + 2 partitions. The sample steers cost only: any plan
    finds every pair."""
    sample = np.asarray(sample, np.uint64)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    best = None
    for m in range(2, tau + 3):
        groups = _group_bits(bits, m)
        top = min(2, tau)
        costs = [[0.0, *_estimates(sample, g, n, min(top, max(0, tau - m + 1 + m - 1)))] for g in groups]
        # over partitions: the least cost for each sum of thresholds so far
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in costs:
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (cost, chosen) in table.items():
                for t, own in enumerate(row, start=-1):
                    x = (cost + own, (*chosen, t))
                    if total + t not in grown or x < grown[total + t]:
                        grown[total + t] = x
            table = grown
        cost, chosen = table[tau - m + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple(sum(1 << b for b in g) for g in groups), chosen, cost)
    return best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(mask: int, most: int) -> list[int]:
    bits = [b for b in range(64) if mask >> b & 1]
    return [
        sum(1 << b for b in chosen) for k in range(most + 1) for chosen in itertools.combinations(bits, k)
    ]


def _keys(nodes: DataFrame, plan: Plan, probing: bool) -> DataFrame:
    """(part, key, fp): the bucket of each fingerprint in each probed partition, or all
    buckets that it probes there."""
    made = []
    for i, (mask, t) in enumerate(zip(plan.masks, plan.thresholds, strict=True)):
        if t >= 0:
            own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
            for flip in _flips(mask, t if probing else 0):
                made.append(F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(_signed(flip))).alias("key")))
    return nodes.select("fp", F.explode(F.array(*made)).alias("k")).select("k.part", "k.key", "fp")


def links(nodes: DataFrame, plan: Plan, tau: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """nodes: distinct `fp`. Returns (a, b) of verified links that connect every pair of
    fingerprints within tau bits: all of them for small buckets, a star for each midpoint
    for large ones."""
    # read by several steps below: written once, however many of them there are
    index = stage(_keys(nodes, plan, False), "simhash-index")
    probes = index if max(plan.thresholds) <= 0 else stage(_keys(nodes, plan, True), "simhash-probes")
    near = F.bit_count(F.col("q.fp").bitwiseXOR(F.col("x.fp"))) <= tau
    hot = stage(
        index.groupBy("part", "key").count().where(F.col("count") > bucket_limit).select("part", "key"),
        "simhash-hot",
    )
    cold = index.join(hot, ["part", "key"], "left_anti")
    found = (
        probes.alias("q")
        .join(cold.alias("x"), ["part", "key"])
        .where((F.col("q.fp") < F.col("x.fp")) & near)
        .select(F.col("q.fp").alias("a"), F.col("x.fp").alias("b"))
    )
    if not hot.isEmpty():
        found = found.unionAll(_stars(probes.join(hot, ["part", "key"], "left_semi").select("fp").distinct(), tau))
    found = stage(found, "simhash-links")
    unstage(index, probes, hot)
    return found


def _stars(touched: DataFrame, tau: int) -> DataFrame:
    """(a, b): each fingerprint and the least one at each of its midpoints."""
    flips = [
        F.struct(F.lit(_signed(m)).alias("m"), F.lit(m.bit_count()).alias("far"))
        for m in _flips((1 << 64) - 1, -(-tau // 2))
    ]
    middles = touched.select("fp", F.explode(F.array(*flips)).alias("x")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("x.m")).alias("z"), "x.far"
    )
    near = F.when(F.col("far") <= tau // 2, F.col("fp"))
    centres = middles.groupBy("z").agg(F.min(near).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1 and b is not null")
    return middles.join(centres, "z").where("fp != b").select(F.col("fp").alias("a"), "b")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tau: int = 2,
    sample: int = SAMPLE,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each input row.

    component_id is the least non-null key reachable by links of at most tau bits, the row's
    own included. Repeated rows stay repeated. A null text has fingerprint zero, like an
    empty one, and is linked like any other; a null key is kept, and never is a component's
    id unless all its keys are null. Other columns of docs are not read. An empty table
    gives an empty result. The partitioning is fitted on at most `sample` fingerprints
    (least by hash); it steers cost, never which pairs are found.
    """
    found = stage(fingerprints(docs, key, text), "simhash-fp")
    nodes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    n = nodes.count()
    if not n:
        empty = found.select(
            "doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id")
        )
        return empty
    some = least_by_hash(nodes.select("fp"), ["fp"], sample).collect()
    plan = fit(np.array([r[0] for r in some], np.int64).view(np.uint64), n, tau)
    linked = links(nodes.select("fp"), plan, tau, bucket_limit)
    roots = components(linked, "simhash-roots")
    unstage(linked)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    # one row for each root with more than one fingerprint, then one for each fingerprint
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(placed.join(ids, "root").select("fp", "component_id"), "simhash-classes")
    unstage(nodes)
    return found.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _marked(text: str):
    def run(batches):
        for batch in small_batches(batches, text):
            found = [f"{fingerprint(x):016x}" for x in binary_texts(batch, text)]
            yield batch.append_column("_fp", pa.array(found, pa.string()))

    return run


def deduplicate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None, **options
) -> DataFrame:
    """One row of docs for each component, with all its columns: that with the least key. Of
    several rows with that key one stays. Rows without a key go if a row with one is in their
    component; else one stays for each distinct fingerprint.

    With a similarity, texts link by the Jaccard similarity of their sets of five-word shingles
    (similar.py) instead of by `tau` bits."""
    if similarity is not None:
        return similar.deduplicate(docs, key, text, similarity=similarity, **options)
    found = near_duplicates(docs, key, text, **options)
    kept = found.where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias(key))
    # both steps deal out by the key, so the texts are shuffled once
    stays = docs.join(kept.distinct(), key, "left_semi").dropDuplicates([key]).select(docs.columns)
    alone = found.where("doc_id is null and component_id is null").select(F.col("fingerprint").alias("_fp")).distinct()
    if alone.isEmpty():
        return stays
    schema = T.StructType([*docs.schema.fields, T.StructField("_fp", T.StringType())])
    bare = docs.where(F.col(key).isNull()).mapInArrow(_marked(text), schema)
    return stays.unionAll(bare.join(alone, "_fp", "left_semi").dropDuplicates(["_fp"]).select(docs.columns))
