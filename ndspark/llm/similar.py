"""SimHash near-duplicates up to a similarity of shingle sets, verified on the sets.

Two sets of Jaccard similarity s have a cosine of at least 2 s / (1 + s), so a bit of their
SimHashes differs with a probability of at most q = acos(cosine) / pi: a seventh at 0.8. A radius
of a seventh of the bits is beyond any guaranteed pigeonhole plan, so the plan is generalised
once more: fingerprints are long, correlated bits are grouped into partitions, and a dynamic
program gives each partition its own threshold (-1: unused, 0, 1) such that a pair just at the
similarity agrees on at least one partition with probability `target`, at the least estimated
cost. Closer pairs are found more often.

A threshold of 1 files a set under its key with one bit left out, for each bit. Sets that share
a bucket are compared by their sizes and by four words of their fingerprints that no partition uses, then by the
whole fingerprints, and last by their shingles, exactly. So no link is false.

A bucket of more than `bucket_limit` sets is not paired up at once: each member is verified with
two of a few members that are drawn by hash first. The same follows in buckets of any size, as
members of one large group of copies also meet in many small ones, among those that are not linked
yet. Pairs of a bucket that are then in different components are listed once; each set is verified
with two of its own, and all the pairs that this leaves in different components are verified. That
steers cost: every pair of a bucket is either compared or already in one component.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_texts, small_batches, stage, unstage
from .components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TARGET = 0.98  # of pairs just at the similarity that share a bucket
SEED = 42
LANES, CHECKED = 16, 4  # 64-bit words of a fingerprint; those that are compared in a bucket
SAMPLE = 1 << 12  # fingerprints that the plan is fitted on
WIDTHS = range(8, 31, 2)  # bits of a partition
ROW_COST = 30  # of a row in a bucket, which is shuffled and sorted, against one comparison
BUCKET_LIMIT = 64
DRAWN = 8  # members of a large bucket that all others are compared with first
AGAIN = 2  # members of any bucket that those with other roots are compared with next
SENT = 1 << 20  # keys or signatures that are broadcast; for more, both sides are shuffled
STEPS = 400  # of the dynamic program
_SALTS = (np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
_BYTES = np.uint64(0x0101010101010101)


def shingles(raw: bytes | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending. A text of fewer words is one shingle; no
    words: none."""
    words, digest = (raw or b"").lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([digest(line, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[k - 1 :], strict=False)
    return np.unique(np.fromiter((digest(line[s : e - 1], SEED) for s, e in spans), np.uint64, len(words) - k + 1))


def _signature(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """LANES words: a bit is 1 if set in over half of a set's hashes, each mixed with a number of
    the word's own. Bits are counted in bytes of 64-bit lanes, 255 hashes at a time."""
    counts = np.zeros((LANES, 8, 8), np.int64)  # [word, bit in a byte, byte]
    for at in range(0, len(found), 255 * 32):
        x = found[at : at + 255 * 32, None] ^ _SALTS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for lo in range(0, len(x), 255):
            part = x[lo : lo + 255]
            for k in range(8):
                sums = ((part >> np.uint64(k)) & _BYTES).sum(axis=0, dtype=np.uint64)
                counts[:, k] += sums.view(np.uint8).reshape(LANES, 8)
    bits = (2 * counts > len(found)).transpose(0, 2, 1).reshape(LANES, 64)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _bits(fps: np.ndarray) -> np.ndarray:
    """[fingerprint, bit] of the words that partitions use."""
    used = np.ascontiguousarray(fps[:, CHECKED:], "<u8").view(np.uint8)
    return np.unpackbits(used.reshape(len(fps), 8 * (LANES - CHECKED)), axis=1, bitorder="little")


def differing(similarity: float) -> float:
    """The greatest expected share of differing bits at a Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def radius(bits: int, similarity: float) -> int:
    """Differing bits of so many that all but about one pair in two hundred at the similarity
    stay within."""
    q = differing(similarity)
    return int(np.ceil(bits * q + 2.5 * np.sqrt(bits * q * (1 - q))))


@dataclass(frozen=True)
class Plan:
    """groups: the bits of each partition. thresholds: 0 or 1 for each. recall: of pairs just at
    the similarity, expected."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float
    recall: float

    def buckets(self, fps: np.ndarray) -> np.ndarray:
        """[fingerprint, bucket]: the partition and the bit left out in the upper half."""
        bits, out = _bits(fps).astype(np.int64), []
        for i, (group, t) in enumerate(zip(self.groups, self.thresholds, strict=True)):
            own = bits[:, list(group)] @ (1 << np.arange(len(group), dtype=np.int64))
            if not t:
                out.append(own + (i * 64 << 32))
                continue
            for b in range(len(group)):
                out.append((own & ~np.int64(1 << b)) + ((i * 64 + b + 1) << 32))
        return np.stack(out, axis=1)


def _group_bits(corr: np.ndarray, width: int) -> list[list[int]]:
    """Partitions of `width` bits; each takes the bits most correlated with its own."""
    left, total, groups = np.ones(len(corr), bool), corr.sum(axis=1), []
    for _ in range(len(corr) // width):
        own, pull = [], total.copy()
        while len(own) < width:
            best = int(np.argmax(np.where(left, pull, -1.0)))
            own.append(best)
            left[best] = False
            total -= corr[:, best]
            pull = corr[:, own].sum(axis=1) if len(own) < width else pull
        groups.append(sorted(own))
    return groups


def _pairs(keys: np.ndarray) -> float:
    counts = np.unique(keys, return_counts=True)[1]
    return float((counts * (counts - 1.0)).sum() / 2)


def _apart(fps: np.ndarray) -> np.ndarray:
    """Those of the fingerprints that differ from all before in two fifths of the bits. Only
    unrelated texts tell what a partition costs: counting similar ones as cost would prefer
    partitions that tell them apart, which are those that lose links."""
    kept = np.empty_like(fps)
    n = 0
    for x in fps:
        if not n or np.bitwise_count(kept[:n] ^ x).sum(axis=1, dtype=np.int64).min() > 64 * LANES * 2 // 5:
            kept[n] = x
            n += 1
    return kept[:n]


def _allocate(prices: list[list[float]], steps: list[int]) -> tuple[float, list[int]] | None:
    """The cheapest thresholds, one for each partition, whose steps add up to STEPS or more; None
    if all of them do not."""
    cost, trail = np.full(STEPS + 1, np.inf), []
    cost[0] = 0.0
    for own in prices:
        after, took, origin = cost.copy(), np.full(STEPS + 1, -1), np.arange(STEPS + 1)
        for t, price in enumerate(own):
            step = min(STEPS, steps[t])
            # a level is reached from `step` below; the last one from anywhere not further below
            source = np.arange(STEPS + 1) - step
            source[STEPS] = STEPS - step + int(np.argmin(cost[STEPS - step :]))
            reach = np.where(source >= 0, cost[source], np.inf) + price
            better = reach < after
            after[better], took[better], origin[better] = reach[better], t, source[better]
        trail.append((took, origin))
        cost = after
    if not np.isfinite(cost[STEPS]):
        return None
    chosen, level = [], STEPS
    for took, origin in reversed(trail):
        chosen.append(int(took[level]))
        level = int(origin[level])
    return float(cost[STEPS]), chosen[::-1]


def fit(sample: np.ndarray, n: int, similarity: float = SIMILARITY, target: float = TARGET) -> Plan:
    """The cheapest plan over all widths for n fingerprints that reaches the target. The sample
    steers cost only."""
    sample = np.asarray(sample, np.uint64).reshape(-1, LANES)
    bits, scale, best = _bits(_apart(sample)), (n / max(1, len(sample))) ** 2, None
    size = bits.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(np.float32)))) if len(bits) > 1 else np.zeros((size, size))
    np.fill_diagonal(corr, 0)
    q, need = differing(similarity), -np.log(1 - target)
    for width in WIDTHS:
        if not n / 4096 <= 2**width <= max(1024, 4 * n):
            continue
        miss = [1 - (1 - q) ** width]
        miss.append(miss[0] - width * q * (1 - q) ** (width - 1))
        gains = [float(-np.log(m)) for m in miss]
        groups, prices = _group_bits(corr, width), []
        for group in groups:
            own = bits[:, group].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
            near = sum(_pairs(own & ~np.int64(1 << b)) for b in range(width))
            prices.append([ROW_COST * n + _pairs(own) * scale, ROW_COST * n * width + near * scale])
        found = _allocate(prices, [int(g / need * STEPS) for g in gains])
        if found and (best is None or found[0] < best.cost):
            cost, chosen = found
            used = [(tuple(g), t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
            lost = float(np.exp(-sum(gains[t] for _, t in used)))
            best = Plan(tuple(g for g, _ in used), tuple(t for _, t in used), cost, 1 - lost)
    if best is None:
        raise ValueError(f"no plan reaches a recall of {target} at a similarity of {similarity}")
    return best


def _list_of(rows: np.ndarray, kind) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel().view(kind)))


def _prints(text: str):
    """(fp) of every row."""

    def run(batches):
        for batch in small_batches(batches, text, 4 << 20):
            fps = np.array([fingerprint(shingles(x)) for x in binary_texts(batch, text)])
            yield pa.RecordBatch.from_arrays([_list_of(fps, np.int64)], names=["fp"])

    return run


def _filed(key: str, text: str, plan: Plan):
    """(doc_id, sig, n, fp, buckets) of every row: the set's own hash, its size, its fingerprint
    and the buckets that it is filed under."""

    def run(batches):
        for batch in small_batches(batches, text, 4 << 20):
            sets = [shingles(x) for x in binary_texts(batch, text)]
            signed = np.array([_signature(x) for x in sets], np.uint64).view(np.int64)
            fps = np.array([fingerprint(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(signed), pa.array([len(x) for x in sets], pa.int32()),
                 _list_of(fps, np.int64), _list_of(plan.buckets(fps), np.int64)],
                names=["doc_id", "sig", "n", "fp", "buckets"],
            )

    return run


def _sets(text: str):
    def run(batches):
        for batch in small_batches(batches, text, 4 << 20):
            found = [shingles(x) for x in binary_texts(batch, text)]
            signed = np.array([_signature(x) for x in found], np.uint64).view(np.int64)
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            toks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(signed), toks], names=["sig", "toks"])

    return run


def filed(
    docs: DataFrame, key: str, text: str, similarity: float, target: float, sample: int
) -> tuple[DataFrame, float]:
    """(doc_id, sig, n, fp, buckets) of every row, by a plan that is fitted on at most about
    `sample` rows, drawn by the hash of their text; and how many unrelated rows a bucket has."""
    rows = docs.select(key, text)
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    some = rows.where(F.xxhash64(text) <= int(-(1 << 63) + ((1 << 64) - 1) * share)) if share < 1 else rows
    # repeated texts hash alike and come together: each counts once
    drawn = some.dropDuplicates([text]).limit(2 * sample).mapInArrow(_prints(text), "fp array<long>").collect()
    plan = fit(np.array([r["fp"] for r in drawn], np.int64).view(np.uint64), n, similarity, target)
    schema = f"doc_id {dict(docs.dtypes)[key]}, sig long, n int, fp array<long>, buckets array<long>"
    return rows.mapInArrow(_filed(key, text, plan), schema), n / 2 ** len(plan.groups[0])


def _differ(x: str, y: str, words: range) -> F.Column:
    return reduce(
        lambda a, b: a + b, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in words]
    )


def _near(similarity: float, whole: bool) -> F.Column:
    """Whether x and y share a bucket, and their sizes and checked words are near enough; with
    `whole` their fingerprints too."""
    sizes = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
    near = sizes & (_differ("x.fp", "y.fp", range(CHECKED)) <= radius(64 * CHECKED, similarity))
    if whole:
        near = near & (_differ("x.fp", "y.fp", range(LANES)) <= radius(64 * LANES, similarity))
    return (F.col("x.h") == F.col("y.h")) & near


def _pairs_of(met: DataFrame) -> DataFrame:
    """(x, y, d): two sets and their differing bits."""
    d = _differ("x.fp", "y.fp", range(LANES))
    return met.select(F.col("x.sig").alias("x"), F.col("y.sig").alias("y"), d.alias("d"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _few(pairs: DataFrame) -> DataFrame:
    """(a, b): of the pairs of each x that with the nearest y, and that with the first by hash, which
    is the same for most members of a group."""
    own = pairs.groupBy("x").agg(F.min_by("y", "d").alias("near"), F.min_by("y", F.xxhash64("y")).alias("first"))
    return _ordered(own.select("x", F.explode(F.array("near", "first")).alias("y")))


def _drawn_of(rows: DataFrame, k: int) -> DataFrame:
    """(h, sig) of at most k members of each bucket."""
    least = [F.min_by("sig", F.xxhash64("sig", F.lit(i))) for i in range(k)]
    chosen = rows.groupBy("h").agg(F.array_distinct(F.array(*least)).alias("d"))
    return chosen.select("h", F.explode("d").alias("sig"))


class Search:
    """The steps that compare sets: by buckets and fingerprints, by shingles."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, key: str, text: str, similarity: float):
        self.docs, self.nodes, self.key, self.text, self.similarity = docs, nodes, key, text, similarity
        self.sets = None  # (sig, toks) of all that is compared next, if they are there

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those (a, b) whose sets reach the similarity."""
        close = stage(pairs.distinct(), "near-close")
        own = self.sets
        if own is None:
            own = self._staged_sets(close.select(F.col("a").alias("sig")).unionAll(close.select("b")))
        both = F.size(F.array_intersect("x", "y"))
        # |x & y| >= s |x | y|, in whole numbers where s is a fraction of 1000
        s = round(1000 * self.similarity)
        enough = both * (1000 + s) >= s * (F.size("x") + F.size("y"))
        linked = close.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").where(enough).select("a", "b")
        done = stage(linked, "near-linked")
        unstage(close, *([own] if self.sets is None else []))
        return done

    def _staged_sets(self, held: DataFrame) -> DataFrame:
        held = stage(held.distinct(), "near-held")
        own = stage(self._sets_of(held), "near-sets")
        unstage(held)
        return own

    def _sets_of(self, held: DataFrame) -> DataFrame:
        """(sig, toks) of signatures, from the rows with their least keys."""
        sent = lambda df: F.broadcast(df) if df.count() <= SENT else df
        few = sent(held)
        keys = self.nodes.join(few, "sig", "left_semi").select(F.col("least").alias(self.key))
        rows = self.docs.select(self.key, self.text)
        own = rows.join(sent(keys.where(F.col(self.key).isNotNull()).distinct()), self.key, "left_semi")
        if not keys.where(F.col(self.key).isNull()).isEmpty():
            own = own.unionAll(rows.where(F.col(self.key).isNull()))
        made = own.mapInArrow(_sets(self.text), "sig long, toks array<long>")
        return made.join(few, "sig", "left_semi").dropDuplicates(["sig"])

    def _filed(self, nodes: DataFrame, *columns, words: int = LANES) -> DataFrame:
        """A row for each bucket of a set, with so many words of its fingerprint."""
        own = nodes.where("n > 0").select("sig", "n", F.slice("fp", 1, words).alias("fp"), "buckets", *columns)
        return own.select("sig", "n", "fp", *columns, F.explode("buckets").alias("h"))

    def links(self, bucket_limit: int) -> DataFrame:
        """(a, b) of verified links that connect what shares a bucket and reaches the similarity."""
        keys = self.nodes.where("n > 0").select(F.explode("buckets").alias("h"))
        large = stage(keys.groupBy("h").count().where(F.col("count") > bucket_limit).select("h"), "near-large")
        if large.isEmpty():
            unstage(large)
            return self._across(self.nodes.withColumn("root", F.col("sig")), None, None)
        drawn = self._drawn(large)
        roots = components(drawn, "near-roots")
        unstage(drawn)
        rooted = self.nodes.join(roots, F.col("sig") == F.col("node"), "left").drop("node")
        rooted = stage(rooted.withColumn("root", F.coalesce("root", "sig")), "near-rooted")
        edges = self._across(rooted, large, roots.toDF("a", "b"))
        unstage(large, rooted)
        return edges

    def _drawn(self, large: DataFrame) -> DataFrame:
        """(a, b) of verified links of members of large buckets to those that are drawn there."""
        crowd = stage(self._filed(self.nodes).join(large, "h", "left_semi"), "near-crowd")
        chosen = _drawn_of(crowd, DRAWN).join(self.nodes.select("sig", "n", "fp"), "sig")
        near = _near(self.similarity, True) & (F.col("x.sig") != F.col("y.sig"))
        edges = self.verified(_few(_pairs_of(crowd.alias("x").join(chosen.alias("y"), near))))
        unstage(crowd)
        return edges

    def _across(self, rooted: DataFrame, large: DataFrame | None, known: DataFrame | None) -> DataFrame:
        """The known links, and (a, b) of verified ones that connect sets that share a bucket and have
        different roots. Members that are near any such one come first, a row each: only they bring
        whole fingerprints, and a pair is met in its least bucket alone."""
        filed = self._filed(rooted, "root", words=CHECKED)
        small = filed if large is None else filed.join(large, "h", "left_anti")
        apart = F.col("x.root") != F.col("y.root")
        near, open_ = _near(self.similarity, False) & apart, ["h", "sig", "root", "most"]
        found = small.alias("x").join(small.alias("y"), near, "left_semi")
        found = found.select("h", "sig", "root", F.lit(None).cast("long").alias("most"))
        parts = []
        if large is not None:
            # the commonest root of a large bucket has its members compared with the others only
            crowd = filed.join(large, "h", "left_semi")
            counted = crowd.groupBy("h", "root").count()
            most = counted.groupBy("h").agg(
                F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots")
            )
            placed = stage(crowd.join(most.where("roots > 1").select("h", "most"), "h"), "near-placed")
            others = placed.where("root != most")
            others = stage(others.alias("x").join(placed.alias("y"), near, "left_semi"), "near-others")
            common = placed.where("root = most").alias("x").join(others.alias("y"), near, "left_semi")
            found = found.unionAll(others.select(open_)).unionAll(common.select(open_))
            parts = [placed, others]
        found = stage(found, "near-found")
        whole = stage(found.join(self.nodes.select("sig", "n", "fp", "buckets"), "sig"), "near-whole")
        self.sets = self._staged_sets(whole.select("sig"))
        chosen = whole.join(_drawn_of(whole, AGAIN), ["h", "sig"], "left_semi")
        near = _near(self.similarity, True)
        edges = self.verified(_few(_pairs_of(whole.alias("x").join(chosen.alias("y"), near & apart))))
        edges = edges if known is None else known.unionAll(edges)
        roots = components(edges, "near-roots").toDF("sig", "now")
        now = whole.join(roots, "sig", "left").withColumn("now", F.coalesce("now", "sig"))
        once = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.h")
        way = (F.col("x.sig") < F.col("y.sig")) | (F.col("y.root") == F.col("y.most"))
        still = F.col("x.now") != F.col("y.now")
        met = now.where("most is null or root != most").alias("x").join(now.alias("y"), near & still & way & once)
        met = stage(_pairs_of(met), "near-met")
        edges = roots.toDF("a", "b").unionAll(self._rest(met, roots.toDF("a", "b")))
        unstage(found, whole, met, self.sets, *parts)
        self.sets = None
        return edges

    def _rest(self, met: DataFrame, known: DataFrame) -> DataFrame:
        """(a, b) of verified links that connect the sets of the pairs: two pairs of each set first,
        then all whose sets are still in different components."""
        first = self.verified(_few(met.unionAll(met.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))))
        roots = components(known.unionAll(first), "near-roots")
        left = met.join(roots.toDF("x", "rx"), "x", "left").join(roots.toDF("y", "ry"), "y", "left")
        left = left.where(F.coalesce("rx", "x") != F.coalesce("ry", "y"))
        return first.unionAll(self.verified(_ordered(left)))


def _marked(text: str):
    def run(batches):
        for batch in small_batches(batches, text):
            found = np.array([_signature(shingles(x)) for x in binary_texts(batch, text)], np.uint64)
            yield batch.append_column("_sig", pa.array(found.view(np.int64)))

    return run


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    target: float = TARGET,
    sample: int = SAMPLE,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(root, least): a component of signatures each, and the least key of its rows, null if no
    row of it has one."""
    rows, mean = filed(docs, key, text, similarity, target, sample)
    rows = stage(rows, "near-rows")
    nodes = stage(
        rows.groupBy("sig").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "buckets")]),
        "near-nodes",
    )
    unstage(rows)
    edges = Search(docs, nodes, key, text, similarity).links(max(bucket_limit, 4 * int(mean)))
    roots = components(edges, "near-links")
    placed = nodes.select("sig", "least").join(roots, F.col("sig") == F.col("node"), "left")
    found = stage(placed.groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("least").alias("least")), "near-kept")
    unstage(nodes)
    return found


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of docs for each component of texts whose sets of five-word shingles have a Jaccard
    similarity of at least `similarity`, with all its columns: that with the least key. Of
    several rows with that key one stays. Rows without a key go if a row with one is in their
    component; else one stays. Texts without words (null, empty) are copies of each other. Other
    columns may have any names, and an empty table gives an empty result. No link is false; a
    pair just at the similarity is missed with a probability of at most 1 - `target`."""
    found = classes(docs, key, text, **options)
    kept = found.where("least is not null").select(F.col("least").alias(key))
    # both steps deal out by the key, so the texts are shuffled once
    stays = docs.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)
    alone = found.where("least is null").select(F.col("root").alias("_sig"))
    if alone.isEmpty():
        return stays
    # the text with the signature of a component's root stands for it
    schema = T.StructType([*docs.schema.fields, T.StructField("_sig", T.LongType())])
    bare = docs.where(F.col(key).isNull()).mapInArrow(_marked(text), schema)
    return stays.unionAll(bare.join(alone, "_sig", "left_semi").dropDuplicates(["_sig"]).select(docs.columns))
