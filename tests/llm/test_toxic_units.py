import itertools
import random

import numpy as np
import pytest

from ndspark.llm import toxicity

PARTS = ["ban", "tor", "lim", "ser", "ond", "at", "ing", "pel", "ura", "mok", "字", "語", "本", "山", "川"]


def _table(spark, insult, n=500):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(PARTS, k=rng.choice([2, 3]))) for _ in range(60)]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), insult)
        rows.append((f"d{i}", " ".join(w + (". " if k % 9 == 8 else "") for k, w in enumerate(words)), 1.0))
        labels.append((f"d{i}", int(i % 4 == 0)))
    labels += [(None, 1), ("d0", 1), ("d0", None), ("nobody", 1)]
    rows += [(None, f"here {insult} is", 0.0), ("long", "mokura " * 60_000 + insult, 0.0), ("no", None, 0.0), ("no", "", 0.0), ("no", "", 0.0)]
    return spark.createDataFrame(rows, "doc_id string, text string, predicted double"), spark.createDataFrame(labels, "doc_id string, toxic int")


@pytest.mark.parametrize("insult", ["zq", "咕嘟", "х", "zwarfigkluxmorvihbrutzwarfigs"])
def test_short_long_and_other_scripts(spark, insult):
    docs, labels = _table(spark, insult)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"][1:].isdigit()]
    right = [r["predicted"] == int(int(r["doc_id"][1:]) % 4 == 0) for r in held]
    assert len(held) > 80 and sum(right) >= 0.95 * len(right)
    odd = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] is None or r["doc_id"] in ("long", "no")}
    assert odd == {None: 1, "long": 1, "no": 0}


def test_words_in_a_text_without_spaces():
    assert {"山川", "川本", "山川本"} <= set(toxicity.token_units("山川本語"))
    assert toxicity.token_units("a") == ["a"] and toxicity.token_units("!") == [] and toxicity.token_units("a-b") == ["a", "b", "ab"]


def _kernel(alphabet, a, b):
    def counts(u):
        s, out = f"{toxicity.FIRST}{u}{toxicity.LAST}", {}
        for k in (3, 4):
            for at in itertools.combinations(range(len(s)), k):
                if at[-1] - at[0] < toxicity.SPAN:
                    key = tuple(s[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = counts(a), counts(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_scores_equal_their_definition():
    positive = {"zwarf": 20, "klux": 9, "zwarfs": 3}
    negative = {w: 5 for w in ("dwarf", "flux", "table", "chair", "swarm", "warm", "lux")}
    trainer = toxicity.Trainer(positive, negative, toxicity.Bounds())
    model = trainer.fit()
    texts = ["the zw-arf sat", "a table. A chair", "kluux", "", "warm dwarfs"]
    got = toxicity.Scorer(model).margins(texts)
    for text, margin in zip(texts, got, strict=True):
        units = {u for t in toxicity.tokens_of(text) for u in toxicity.token_units(t)}
        want = max(
            (sum(b * _kernel(None, u, m) for m, b in zip(trainer.marks, trainer.beta, strict=True)) + model.bias for u in units),
            default=-2.0,
        )
        assert abs(margin - want) < 0.05  # fours share hashed numbers
    assert got[0] > 0 > got[1]


def test_training_is_bounded_by_its_parameters(spark):
    docs, labels = _table(spark, "zwarfig", 200)
    model = toxicity.train(docs, labels, bounds=toxicity.Bounds(docs=60, positive=5, negative=40, landmarks=20, rounds=1, hard=10, marks=2))
    assert toxicity.score_documents(docs, model).count() == docs.count()


def test_phrases_of_harmless_words(spark):
    docs, labels = _table(spark, "mokban torlim")  # words of the same parts as all others
    bare = spark.createDataFrame([("one", "lim mokban ser torlim at", 0.0), ("both", "at Mok-baan, torlimm. ser", 0.0), ("apart", "at mokban. torlim ser", 0.0)], docs.schema)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.unionAll(bare), labels).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"][1:].isdigit()]
    right = [r["predicted"] == int(int(r["doc_id"][1:]) % 4 == 0) for r in held]
    assert sum(right) >= 0.95 * len(right)
    assert [got[i]["predicted"] for i in ("one", "both", "apart")] == [0, 1, 0]
