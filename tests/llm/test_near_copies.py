import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ndspark.llm import components, lattice, simhash

DOCS = "doc_id long, text string, lang string, fp string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcAB é\t\n.日", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


def test_plan_finds_every_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0x00FF_FFFF_0F0F_3333)
    for n in (400, 10**6, 10**10):
        plan = simhash.fit(base, n)
        assert sum(plan.thresholds) == 2 - len(plan.masks) + 1
        assert sum(plan.masks) == (1 << 64) - 1 and all(a & b == 0 for i, a in enumerate(plan.masks) for b in plan.masks[:i])
        for flips in [(), (5,), *((i, j) for i in range(64) for j in range(i))]:
            x = sum(1 << f for f in flips)
            assert any((x & m).bit_count() <= t for m, t in zip(plan.masks, plan.thresholds, strict=True))


def _near(rng, n):
    words = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            if own and rng.random() < 0.7:
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit", [1, 128])
def test_components_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    texts = _near(rng, 60) + ["", None, "  \n", "same text here"] * 2
    rows = [(i * 3 + 1, t, "en", "x") for i, t in enumerate(texts)] + [(1, texts[0], "en", "x"), (None, texts[0], "en", "x"), (None, "alone with no id at all", None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), bucket_limit=limit).collect()
    fps = {r[0]: brute.fingerprint(r[1]) for r in rows if r[0] is not None}
    want = brute.classes(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        assert r["component_id"] == want[r["doc_id"]] and int(r["fingerprint"], 16) == fps[r["doc_id"]]
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [want[1], None]


def test_a_dense_group_is_linked_by_midpoints(spark):
    rng = random.Random(3)
    fps = sorted({sum(1 << b for b in rng.sample(range(12), rng.randrange(5))) for _ in range(600)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    plan = simhash.fit(np.array(fps, np.uint64), len(fps))
    for limit in (2, 10_000):
        links = simhash.links(nodes, plan, bucket_limit=limit)
        rows = links.collect()
        assert all((a ^ b).bit_count() <= 2 for a, b in rows)
        got = {r["node"]: r["root"] for r in components.components(links).collect()}
        want = brute.classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
        assert {f: got.get(f, f) for f in fps} == want


@pytest.mark.parametrize("tau", [0, 1, 3])
def test_other_radii(spark, tau):
    rng = random.Random(tau)
    fps = sorted({sum(1 << b for b in rng.sample(range(14), rng.randrange(6))) for _ in range(150)} | {rng.getrandbits(62) for _ in range(40)})
    fps = sorted({*fps, *[f ^ (1 << 40) ^ (7 << 20 if tau == 3 else 0) for f in fps[-20:]]})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    plan = simhash.fit(np.array(fps, np.uint64), len(fps), tau)
    want = brute.classes(fps, lambda a, b: (a ^ b).bit_count() <= tau)
    for limit in (2, 10_000):
        rows = simhash.links(nodes, plan, tau, limit)
        assert all((a ^ b).bit_count() <= tau for a, b in rows.collect())
        got = {r["node"]: r["root"] for r in components.components(rows).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_signatures_of_many_edges_do_not_overflow(spark):
    edges = spark.range(3_000_000).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b"))
    n, mark = components._signature(edges)
    assert n == 3_000_000 and -(1 << 63) <= mark < 1 << 63 and components._signature(edges.limit(10)) != (n, mark)
    # the exclusive or of hashes needs no more room, however many there are
    kinds = edges.agg(F.bit_xor(F.xxhash64("a", "b")).alias("x")).dtypes
    assert kinds == [("x", "bigint")]


def test_deduplicate_and_empty(spark):
    rows = [(3, "a b c d", "en", "x"), (1, "a b c d", "de", "y"), (1, "a b c d", "de", "y"), (7, "quite another text of words", "en", None), (None, "a b c d", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d", "de", "y"), (7, "quite another text of words", "en", None)]
    bare = spark.createDataFrame([(None, "no id", "x", None), (None, "No  id", "y", None), (2, "with an id here", "z", None)], DOCS)
    assert sorted(r["text"].lower().split() for r in simhash.deduplicate(bare).collect()) == [["no", "id"], ["with", "an", "id", "here"]]
    none = simhash.near_duplicates(docs.limit(0))
    assert none.columns == ["doc_id", "fingerprint", "component_id"] and none.count() == 0
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    ids = list(range(300))
    rng.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(200)] + [(ids[i], ids[250]) for i in range(220, 300) if i != 250] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    chain, star = set(ids[:201]), set(ids[220:300])
    for x in ids:
        want = min(chain) if x in chain else min(star) if x in star else None
        assert got.get(x) == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_e8():
    rng = np.random.default_rng(0)
    roots = lattice.roots()
    assert len({tuple(r) for r in roots}) == 240 and set((roots**2).sum(1)) == {8}
    y = rng.standard_normal((500, 8)) * 3
    p = lattice.decode_e8(y)
    gap = ((2 * y - p) ** 2).sum(1)
    assert gap.max() <= 4 + 1e-9  # the covering radius is 1
    assert (((2 * y[:, None] - p[:, None] - roots) ** 2).sum(2) >= gap[:, None] - 1e-9).all()
    assert ((p.sum(1) % 4 == 0) & ((p % 2 == p[:, :1] % 2).all(1))).all()


def _vectors(rng, n, dims=64):
    rows = []
    for i in range(n):
        c = rng.standard_normal(dims)
        for _ in range(int(rng.choice([1, 1, 2, 12]))):
            noise = rng.standard_normal(dims) * rng.choice([0.02, 0.05, 0.1, 0.14, 0.2])
            rows.append(((c + noise).astype("f4").tolist(), int(i % 3)))
    return rows


@pytest.mark.parametrize("block", [2048, 4])
def test_recall_and_no_false_link(spark, block):
    rows = _vectors(np.random.default_rng(1), 120)
    rows += [rows[0]] * 3 + [(rows[0][0], None), (None, 1), ([0.0] * 64, 1), ([float("nan")] * 64, 1), ([], 1), ([float("inf")] + [1.0] * 63, 1), (rows[5][0][:60], rows[5][1]), ([2 * v for v in rows[7][0]], rows[7][1])]
    rows = [(i * 2, v, lab, "extra") for i, (v, lab) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string").repartition(3)
    got = {r["vec_id"]: r for r in lattice.near_duplicate_vectors(df, block=block).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and np.isfinite(r[1]).all() and any(r[1])]
    pairs = {(a[0], b[0]) for i, a in enumerate(good) for b in good[i + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and brute.cosine(a[1], b[1]) >= 0.98}
    degree = {r[0]: 0 for r in rows}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert len(got) == len(rows) and all(got[i]["n_links"] <= degree[i] for i in degree)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * 2 * len(pairs)
    want = brute.classes([r[0] for r in rows], lambda a, b: (a, b) in pairs or (b, a) in pairs)
    same = sum(got[i]["component_id"] == want[i] for i in want)
    assert same >= 0.98 * len(want) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_vectors_without_rows_or_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (9, [1.0, 0.001], 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicate_vectors(df).collect()}
    assert got == {None: (2, 4, False), 4: (2, 4, True), 9: (2, 4, False)}
    assert lattice.near_duplicate_vectors(df.limit(0)).count() == 0
    assert lattice.near_duplicate_vectors(df.where("false").unionAll(spark.createDataFrame([(1, None, None)], df.schema))).first()["component_id"] == 1
