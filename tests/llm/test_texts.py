import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ndspark.llm import bpe, decontaminate, html, tokenfiles, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.lists(
    st.sampled_from([*"abcotheringns's!?.,12 \t\n", "É", "Σ", "ς", "İ", "ß", "日", "😀", "́", "\x1c", "\x85", "\xa0", "the", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "K"]),
    max_size=30,
).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    return bpe.load(PATH)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoding_equals_the_library(text):
    library, encoder = Tokenizer.from_file(PATH) if False else _library(), bpe.worker_encoder(PATH)
    ids = np.frombuffer(encoder.encode(text.encode()), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenfiles.worker_tokenizer(PATH).encode_all([text.encode()])[0], "<u4").tolist() == ids
    decoder = bpe.Decoder(encoder.vocab)
    got = "".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + decoder.finish()
    assert got == library.decode(ids, skip_special_tokens=False)


_kept = []


def _library():
    if not _kept:
        _kept.append(Tokenizer.from_file(PATH))
    return _kept[0]


@pytest.mark.parametrize("word", ["a" * 9000, "ha" * 4000, "in" * 5000, "theringonsab" * 900, "!" * 6000, "日本" * 2500])
def test_the_transducer_holds_a_bounded_part(vocab, library, word):
    run, out = bpe.Transducer(vocab, 64), []
    symbols = "".join(bpe.BYTE_CHARS[b] for b in word.encode())
    for i in range(0, len(symbols), 500):
        out += run.feed(symbols[i : i + 500])
    out += run.finish()
    assert out == library.encode(word, add_special_tokens=False).ids
    assert run.peak <= 2 * vocab.lookahead + 2 * 64


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ING", "'s", "'ll", "'", "!?", "1", "é", "É", "\u0301", "가", "\u1161", "\u11a8", "İ", "日本", "😀", "<|endoftext|>", "<|endof", "\x85", " ", "x" * 70, "!" * 70]), max_size=40).map("".join), st.sampled_from([7, 16, 40, 200]))
def test_texts_are_read_in_pieces(text, piece):
    encoder = bpe.Encoder(bpe.load(PATH), piece=piece)
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == _library().encode(text, add_special_tokens=False).ids


def test_every_word_goes_through_the_transducer(vocab, monkeypatch):
    fed, plain = [], bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, x: fed.append(x) or plain(self, x))
    bpe.Encoder(vocab).encode(b"Three short words")
    assert fed == ["three", "short", "words"]


def test_an_open_word_is_held_in_part(vocab, library, monkeypatch):
    peaks, plain = [], bpe.Transducer.finish
    monkeypatch.setattr(bpe.Transducer, "finish", lambda self: peaks.append(self.peak) or plain(self))
    for word in ("theringonsab" * 30_000, "日本" * 60_000, "!" * 200_000):
        parts = list(bpe.Encoder(vocab, piece=4096).stream(word.encode()))
        assert len(parts) > 20 and np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    assert max(peaks) <= 2 * vocab.lookahead + 2 * bpe.BLOCK


def test_lookahead_of_small_merge_lists():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # a b c d: whether c d merges decides whether b c does, and that whether a b does
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3


def test_text_decoder_is_incremental(vocab):
    decoder = bpe.Decoder(vocab, "text")
    ids = np.frombuffer(bpe.Encoder(vocab).encode("Über 日本 it's".encode()), "<u4").tolist()
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "über 日本 it 's "


def test_encode_documents(spark, library):
    rows = [(1, "The cat.", "x"), (1, "The cat.", "x"), (2, None, "x"), (3, "", "x"), (None, "a " * 30000 + "b" * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(docs, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        own = library.decode(ids, skip_special_tokens=False)
        plain = bpe.Decoder(bpe.load(PATH), "text")
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), own.encode(), (plain.feed(ids) + plain.finish()).encode())]
        want.append((i, len(ids), *digests))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_token_files(spark, library, tmp_path):
    texts = [f"document number {i} of the words the the {i % 7}" * (i % 9) for i in range(200)]
    rows = [(i * 5 % 1000, t, 0) for i, t in enumerate(texts)] + [(5, "twice", 0), (5, "twice", 0), (None, "no id", 0), (7, None, 0), (8, "w" * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    uri = f"file://{tmp_path}/t"
    shards = tokenfiles.write_token_files(docs, PATH, uri, partitions=4)
    again = tokenfiles.write_token_files(docs, PATH, uri, partitions=4)  # as a second attempt would
    assert [s for _, s in again][0] == 0 and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]
    got = tokenfiles.read_token_files(spark, uri, again, keep_ids=True).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [r[0] for r in ordered]
    want = sorted((r[0] is not None, r[0] or 0, library.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows)
    have = sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    assert have == want
    for r in by_start:
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    found = [list(x) for name, _ in again for x in tokenfiles.ShardReader(uri, name).find(10)]
    assert found == [library.encode(texts[2], add_special_tokens=False).ids + [1]] and shards
    assert tokenfiles.token_files(docs.limit(0), PATH).count() == 0


def test_contamination(spark):
    item = "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu nu"
    items = [(1, item), (2, "short one"), (3, ""), (4, None), (5, "!!! ..."), (None, "an item without id"), (10, "short one"), (6, "the the the the the the the the the the the")]
    docs = [
        (1, "x " + item.lower().replace(" ", ", ") + " y"), (2, "nothing"), (3, None), (4, ""), (5, "SHORT-one and short one short ONE"),
        (6, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (7, "beta gamma delta epsilon zeta eta theta iota kappa"),
        (8, "the " * 30), (9, "an item without id, short one"), (11, "short on"), (12, item + " " + item),
    ]
    want = brute.contamination(docs, items)
    df = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    for size in (64 << 20, 900, 1):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(df, bench, block_bytes=size).collect()}
        assert got == want
        kept = decontaminate.clean(df, bench, block_bytes=size)
        assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[1]}
    again = decontaminate.contamination(df.unionAll(df).unionAll(spark.createDataFrame([(None, item + " " + "word " * 50000, "e")], df.schema)), bench)
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in again.collect()) == sorted([(str(i), w[1]) for i, w in want.items()] * 2 + [("None", 13)])
    row = decontaminate.contamination(df, bench).where("doc_id = 12").first()
    assert row["items_sha256"] == hashlib.sha256(b"1").hexdigest() and row["contaminated"] and row["n_items"] == 1
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_a_large_item_is_cut_and_blocks_come_one_at_a_time(spark):
    long = " ".join(f"w{i % 997}" for i in range(4000))
    bench = spark.createDataFrame([(1, long), (2, "w5 w6 w7")], "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 10, 3, 9000))
    assert len(blocks) > 10 and max(len(b.lengths) for b in blocks) <= 9000 // 88
    docs = [(1, " ".join(long.split()[100:140])), (2, "w5 w6 w7 w9"), (3, long)]
    want = brute.contamination(docs[:2], [(1, long), (2, "w5 w6 w7")])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=9000).collect()}
    assert got[1] == want[1] and got[2] == want[2] and got[3] == (4000, 4000, ["1", "2"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=25), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=14), min_size=1, max_size=4))
def test_windows_equal_brute_force(docs, items):
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    items = [(i, " ".join(d)) for i, d in enumerate(items)]
    block = decontaminate.build_block([(str(i), decontaminate.words_of(t.encode())) for i, t in items if t], 10, 3)
    counts = {k: np.zeros(len(c), np.int64) for k, c in block.codes.items()}
    decontaminate.choose_prefix(block, counts, 3)
    want = brute.contamination(docs, items)
    for i, t in docs:
        ids = decontaminate._ids(decontaminate.words_of(t.encode()), block.words)
        hit, names = set(), set()
        for starts, windows in decontaminate._occurrences(ids, block):
            for s, w in zip(starts, windows, strict=True):
                hit.update(range(s, s + block.lengths[w]))
                names.add(block.items[block.owners[w]])
        assert (len(hit), sorted(names)) == want[i][1:]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page sidebar-left">
<header><a href=/>Home</a><p>Site, name, of, it</p></header><nav><ul><li><a href=a>A</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, many, and more, please accept, thanks.</p></div>
<div class="layout"><div class="sidebar"><p>Aside, with, many, commas, here, and, more.</p></div>
<main><div class="post-content"><h2>Title &amp; more</h2><p>First para, with <a href=x>a link</a>,
   long&nbsp;enough.</p><div class=ad>Buy, now</div><p>Second &lt;b&gt; para.<p>Third <b>bold<p>Fourth.</b>
<ul><li>one<li>two</ul><blockquote>Quote</blockquote></div>
<section class="comments"><p>Nice, a lot, really, good, one, two, three.</p></section></main></div>
<form><p>Subscribe, now</p></form><footer>f &copy;</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_main_text():
    assert html.main_text(PAGE).split("\n") == ["Title & more", "First para, with a link, long enough.", "Second <b> para.", "Third bold", "Fourth.", "one", "two", "Quote"]
    assert html.main_text("") == "" and html.main_text("<nav>a</nav><script>x</script>") == ""
    assert html.main_text("plain &amp; text") == "plain & text"
    assert html.main_text("<article><p>" + "a, b " * 30000) == ("a, b " * 30000).strip()
    for odd in ("<", "<p", "</", "<!--", "<a href='", "<p>x</p", "<script>", "&#x;", "<p>a<!-- b --><p>c", "</div></div><p>t"):
        html.main_text(odd)
    assert html.main_text("<p>a<!-- b --><p>c") == "a\nc"


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = html.main_text(PAGE)
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(5)
    parts = ["ban", "tor", "lim", "ser", "ond", "at", "ing", "pel", "ura", "mok"]
    insults = ["zwarfig", "kluxmor", "vihbrut"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choices(parts, k=rng.choice([1, 2, 3]))) for _ in range(rng.choice([20, 60, 120]))]
        bad = i % 4 == 0
        for _ in range(rng.choice([1, 3])) if bad else ():
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        body = " ".join(w + (". " if k % 9 == 8 else "") for k, w in enumerate(words))
        rows.append((i, body, "en"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learnt_and_tolerates_gaps(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == 900 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    odd = ["ban tor kluxxmor lim", "a zwar-fig at", "v i h b r u t", "zwa.rf.ig", "vihbruts"]
    clean = ["ban tor lim", "serondat pel", "", None, "a " * 50000, "q" * 40000, "pel " * 3]
    rows = [(i, t, None) for i, t in enumerate(odd + clean)] + [(None, "kluxmor", None)]
    scored = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(rows, docs.schema), model).collect()}
    assert [scored[i]["predicted"] for i in range(len(odd))] == [1] * len(odd)
    assert [scored[len(odd) + i]["predicted"] for i in range(len(clean))] == [0] * len(clean)
    assert scored[None]["predicted"] == 1 and scored[None]["held_out"] is False
    kept = toxicity.keep_clean(spark.createDataFrame(rows, docs.schema), model)
    assert kept.columns == docs.columns and kept.count() == len(clean)


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    none = toxicity.toxicity(docs, labels.limit(0))
    assert none.where("predicted = 0").count() == 900 and toxicity.toxicity(docs.limit(0), labels).count() == 0
    same = toxicity.toxicity(docs, labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic"))
    assert same.where("score between 0 and 1").count() == 900


def test_subsequence_kernel_equals_its_definition():
    import itertools

    a = toxicity.Alphabet(toxicity.FIRST + toxicity.LAST + "abc")

    def counts(u):
        s, out = f"{toxicity.FIRST}{u}{toxicity.LAST}", {}
        for k in (3, 4):
            for at in itertools.combinations(range(len(s)), k):
                if at[-1] - at[0] < toxicity.SPAN:
                    key = tuple(s[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    units = ["abc", "abca", "ccbbaa", "abcabcab"]
    got = a.gram(units, units)
    for i, x in enumerate(units):
        for j, y in enumerate(units):
            cx, cy = counts(x), counts(y)
            dot = sum(v * cy.get(k, 0) for k, v in cx.items())
            want = dot / np.sqrt(sum(v * v for v in cx.values()) * sum(v * v for v in cy.values()))
            assert abs(got[i, j] - want) < 2e-3


def test_chunks_that_come_again_stay_in_a_full_memo(monkeypatch):
    encoder, asked = tokenfiles.ChunkTokenizer(PATH, memo=600), []
    plain = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda texts: (asked.extend(texts), plain(texts))[1])
    library = Tokenizer.from_file(PATH)
    for batch in range(8):
        texts = [" ".join(f"\u00e9{i} b{i}, neu\u00e9{batch * 200 + i}" for i in range(lo, lo + 50)) for lo in (0, 50, 0)] + ["", " \t\x0b\x0c", "\u00a0\x1c"]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [asked.count(f"\u00e9{i}".encode()) for i in range(100)] == [1] * 100
