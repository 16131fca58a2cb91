import hashlib
import inspect

import brute
import numpy as np
import public_tokenizers
import pytest
from oracle import compare
from tokenizers import Tokenizer

import corpus_pipeline
from ndspark.llm import bpe, chat, licenses, queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline_equals_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: tuple(r)[:4] for r in corpus_pipeline.run(spark, sf).collect()}
    model = toxicity.train(docs, labels)
    clean = {r["doc_id"] for r in toxicity.score_documents(docs, model).where("predicted = 0").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in clean}
    root = brute.classes(sorted(texts), lambda a, b: brute.similar(texts[a], texts[b]))
    kept = {i for i, r in root.items() if i == r}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hit = brute.contamination([(i, texts[i]) for i in kept], items)
    kept = {i for i in kept if not hit[i][1]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i in kept:
        ids = library.encode(texts[i], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want[i] = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs.limit(20), sf).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "bpe"]


def test_stages_on_nulls_repeats_and_empty_tables(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first()["text"]
    words = " ".join(f"wort{i}" for i in range(300))
    near = words.replace("wort150 ", "other ")
    rows = [
        (5, words, "de", 1), (5, words, "de", 1), (3, near, None, None), (None, words, "en", 2), (None, "quite alone here", "en", 3), (None, "Quite  alone here", "en", 3),
        (8, None, "en", 4), (9, "", None, 4), (10, " \n", "en", 4), (11, f"{words[:60]} {item}", "en", 5), (11, f"{words[:60]} {item}", "en", 5), (12, "long " * 100_000, "en", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, spans int")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs.limit(0), sf).count() == 0
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(map(str, stages["toxicity"](spark, docs, sf).collect())) == sorted(map(str, docs.collect()))
    kept = stages["simhash"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower().split()[:2]) for r in kept.collect()) == [
        (0, ["quite", "alone"]), (3, ["wort0", "wort1"]), (8, []), (11, ["wort0", "wort1"]), (12, ["long", "long"]),
    ]
    clean = stages["decontamination"](spark, docs, sf)
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 0, 0, 3, 5, 5, 8, 9, 10, 12]
    encoded = stages["bpe"](spark, docs, sf).collect()
    assert len(encoded) == len(rows) and {r["n_tokens"] for r in encoded if r["doc_id"] in (8, 9, 10)} == {0}


def test_native_operators_have_no_python_on_the_path(spark, sf):
    for name in ("op2_licenses", "op4_preferences"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    for module in (chat, licenses):
        assert "pandas" not in inspect.getsource(module) and "mapInArrow" not in inspect.getsource(module)
    assert bpe.MEMO
