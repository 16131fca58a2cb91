import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from ndspark.llm import similar, simhash

DOCS = "doc_id long, text string, lang string"


_linked = brute.similar


def _texts(rng):
    words, out = [f"w{i}" for i in range(300)], ["", None, "Two words", "two  words", "one"]
    line = [rng.choice(words) for _ in range(12)]  # in many texts
    for size in (60, 1, 1, 2, 2, 3, 4, 4, 25):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 120, 300]))] + line * rng.choice([0, 1])
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 30)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit, sample", [(1, 50), (8, 1 << 14), (128, 1 << 14)])
def test_near_copies_equal_brute_force(spark, limit, sample):
    rng = random.Random(limit)
    texts = dict(enumerate(_texts(rng), 3))
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], DOCS).repartition(5)
    got = similar.deduplicate(docs, sample=sample, bucket_limit=limit, target=0.99999)
    root = brute.classes(sorted(texts), lambda a, b: _linked(texts[a], texts[b]))
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))


def test_rows_without_a_key_and_empty_tables(spark):
    words = [f"v{i}" for i in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    rows = [(4, " ".join(words), "a"), (4, " ".join(words), "a"), (None, near, "b"), (None, "no id at all", "c"), (None, "No id  at all", "d"), (2, None, "e")]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.deduplicate(docs, similarity=0.8).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 2, 4] and simhash.deduplicate(docs.limit(0), similarity=0.8).count() == 0


def test_the_stage_drops_near_copies_beyond_two_bits(spark, sf):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(1, " ".join(base), "en"), (2, " ".join([*base[:50], "x", *base[51:120], "y", *base[121:]]), "en"), (3, " ".join(rng.sample(words, 200)), "en")]
    assert (brute.fingerprint(rows[0][1]) ^ brute.fingerprint(rows[1][1])).bit_count() > 2 and _linked(rows[0][1], rows[1][1])
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == [1, 3]


def test_recall_of_the_plan_in_use():
    found = total = 0
    for seed in range(12):
        texts = sorted({t for t in _texts(random.Random(seed)) if t})
        fps = np.array([similar.fingerprint(similar.shingles(t.encode())) for t in texts])
        plan = similar.fit(fps, len(fps))
        filed = plan.buckets(fps)
        assert plan.recall >= similar.TARGET
        for i, a in enumerate(texts):
            for j in range(i):
                if _linked(a, texts[j]):
                    total += 1
                    near = np.bitwise_count(fps[i] ^ fps[j])
                    own = near[: similar.CHECKED].sum() <= similar.radius(64 * similar.CHECKED, 0.8)
                    found += own and near.sum() <= similar.radius(64 * similar.LANES, 0.8) and (filed[i] == filed[j]).any()
    assert total > 1000 and found >= 0.97 * total


def test_wide_fingerprints_equal_their_definition():
    found = similar.shingles(" ".join(f"a{i % 700}" for i in range(9000)).encode())
    mixed = []
    for salt in similar._SALTS[0].tolist():
        own = []
        for x in found.tolist():
            x ^= salt
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
            own.append(x ^ (x >> 31))
        mixed.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own)))
    assert similar.fingerprint(found).tolist() == mixed and len(found) == 700


@pytest.mark.parametrize("n", [100, 10**5, 10**8])
def test_thresholds_of_one_find_pairs_with_one_bit(n):
    fps = np.random.default_rng(1).integers(0, 1 << 63, (200, similar.LANES), dtype=np.uint64)
    plan = similar.Plan(((0, 5, 9, 77), (1, 2, 3, 4)), (1, 0), 0.0, 1.0)
    near = fps.copy()
    near[:, similar.CHECKED] ^= np.uint64(1 << 5)
    near[:, similar.CHECKED] ^= np.uint64(1 << 2)
    assert ((plan.buckets(fps) == plan.buckets(near)).sum(axis=1) == 1).all()
    fitted = similar.fit(fps, n)
    assert fitted.recall >= similar.TARGET and len({b for g in fitted.groups for b in g}) == sum(map(len, fitted.groups))


def test_linked_members_of_a_large_group_are_not_paired_up(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"g{i}" for i in range(5000)]
    base, compared, plain = [rng.choice(words) for _ in range(150)], [], similar.Search.verified
    texts = {}
    for i in range(900):
        own = list(base) if i % 2 else [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(150)] = rng.choice(words)
        texts[i] = " ".join(own)

    def counted(self, pairs):
        compared.append(pairs.distinct().count())
        return plain(self, pairs)

    monkeypatch.setattr(similar.Search, "verified", counted)
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], DOCS)
    got = {r["doc_id"] for r in similar.deduplicate(docs).collect()}
    root = brute.classes(sorted(texts), lambda a, b: a % 2 == b % 2 == 1 and _linked(texts[a], texts[b]))
    assert got == set(root.values()) and sum(compared) < 20 * len(texts)


def test_links_of_a_group_in_small_buckets_are_found_by_few_comparisons(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"h{i}" for i in range(5000)]
    base, compared, plain = [rng.choice(words) for _ in range(150)], [], similar.Search.verified
    texts = {}
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(150)] = rng.choice(words)
        texts[i] = " ".join(own)
    assert sum(_linked(texts[a], texts[b]) for a in texts for b in range(a)) > 30_000

    def counted(self, pairs):
        compared.append(pairs.distinct().count())
        return plain(self, pairs)

    monkeypatch.setattr(similar.Search, "verified", counted)
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], DOCS)
    got = {r["doc_id"] for r in similar.deduplicate(docs, bucket_limit=1000).collect()}
    root = brute.classes(sorted(texts), lambda a, b: _linked(texts[a], texts[b]))
    assert got == set(root.values()) and sum(compared) <= 6 * len(texts)
