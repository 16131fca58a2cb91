import hashlib

import pytest

from ndspark.llm import chat, licenses, queries, warc

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\nWARC/1.0\r\nContent-Length: 5000\r\n\r\n"


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_records_inside_payloads_are_not_records(spark, split):
    rows = [(i, f"http://a/{i} x\n", "é" * i + INNER * (i % 4)) for i in range(30)]
    rows += [(300, None, None), (None, "u", "z" * 2000), (301, "u", "z" * 2000), (302, "u", "z" * 2000), (302, "u", "z" * 2000), (303, "u", "big" + INNER * 100), (304, "u", "z" * 999), (305, "u", "z" * 999)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    uri = warc.new_folder(spark, "warc")
    files = warc.write_warc(df, uri, file_bytes=9000)
    got = warc.read_warc(spark, uri, files, split).collect()

    def want(p, h):
        raw = (h or "").encode()
        again = p == 301
        return (p is None, p or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 302 if again else -1)

    have = [(r[0] is None, r[0] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in got]
    assert sorted(have) == sorted(want(p, h) for p, _, h in rows)
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://a/3%20x%0A"}


def test_both_ways_of_joining_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", "x" * (1000 + i % 3 if i < 40 else i + 2000)) for i in range(60)], "page_id long, url string, html string")
    rows = sorted(map(str, warc.warc_round_trip(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert sorted(map(str, warc.warc_round_trip(df).collect())) == rows
    for bits in (64, 128):  # most rows have their bit set by another
        monkeypatch.setattr(warc, "FILTER_BITS", bits)
        assert sorted(map(str, warc.warc_round_trip(df).collect())) == rows
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_a_cut_archive_ends_its_chain(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    uri = f"file://{tmp_path}"
    ((name, size),) = warc.write_warc(df, uri)
    (tmp_path / name).write_bytes((tmp_path / name).read_bytes()[:-9])
    assert {r["page_id"] for r in warc.read_warc(spark, uri, [(name, size - 9)]).collect()} == {0, 1, 2, 3}
    with pytest.raises(Exception, match="chain of records breaks"):
        warc.read_warc(spark, uri, [(name, size - 9)], strict=True).collect()


def test_every_file_goes_by_its_chain(spark, sf, monkeypatch):
    staged, plain = [], warc.stage
    monkeypatch.setattr(warc, "stage", lambda df, name: staged.append(name) or plain(df, name))
    df = spark.createDataFrame([(1, "u", "x" * 40), (2, "u", INNER * 40)], "page_id long, url string, html string").coalesce(1)
    uri = warc.new_folder(spark, "warc")
    files = warc.write_warc(df, uri)
    found = warc.entries(spark, uri, files).collect()
    assert "warc-exits" in staged and [tuple(r) for r in found] == [(files[0][0], 0)]
    assert len(warc.entries(spark, uri, files, 300).collect()) > 1 and staged.count("warc-jumps") > 2


def test_long_payloads(spark):
    body = "é" * 3_000_000 + INNER
    df = spark.createDataFrame([(1, "u", body), (2, "u", body), (3, "u", "x")], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r for r in warc.warc_round_trip(df).collect()}
    assert got[1]["refers_to"] == 2 and got[2]["payload_bytes"] == len(body.encode()) == got[1]["payload_bytes"]
    assert got[2]["payload_digest"] == hashlib.sha1(body.encode()).hexdigest() and len(got) == 3


def _scan(spark, *texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, sequence int")
    return [(r["n_sentences"], r["n_known"], r["licenses"]) for r in licenses.license_scan(df).orderBy("doc_id").collect()]


def test_licenses(spark):
    mit = ". ".join(licenses.SENTENCES[i][0] for i in ("mit_grant", "mit_notice", "as_is_mit"))
    bsd = ".\n".join(licenses.SENTENCES[i][0].upper() for i in ("bsd_grant", "bsd_source", "bsd_binary"))
    got = _scan(
        spark, "Hello there.\nReleased under the MIT License.\nBye", mit, bsd, bsd + ".\n" + licenses.SENTENCES["bsd_endorse"][0], None, "", "...",
        "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "This license is mine. " * 3000,
        "This work is licensed under the GNU General Public License, version 3.\r\nÉté",
    )
    assert got == [
        (3, 1, "MIT"), (3, 3, "MIT"), (3, 3, "BSD-2-Clause"), (4, 4, "BSD-3-Clause"), (0, 0, ""), (0, 0, ""), (0, 0, ""),
        (2, 2, "Apache-2.0,CC-BY-NC-4.0"), (3000, 0, ""), (2, 1, "GPL-3.0"),
    ]
    rules = [("Two", ["mit_ref", "cc_by_nc_ref"]), ("One", ["mit_ref"])]
    df = spark.createDataFrame([(1, "License: MIT. Licensed under CC BY-NC 4.0."), (2, "Released under the MIT License. x. Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["sequence"], r["licenses"]) for r in licenses.license_scan(df, rules=rules).collect()}
    assert got[2] == ("<mit_ref>-<cc_by_nc_ref>", "One") and licenses.license_scan(df.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, part int"


def test_preferences(spark):
    chosen = [(1, 0, "user", "q", 0), (1, 1, "assistant", "good", 0), (1, 2, "user", "more", 0), (2, 0, "user", "same", 0), (3, 0, None, None, 0), (None, 0, "user", "x", 0), (4, None, "user", "x", 0)]
    rejected = [(1, 0, "user", "q", 0), (1, 1, "assistant", f"bad {chat.CLOSE}", 0), (2, 0, "user", "same", 0), (3, 0, "", "", 0), (3, 1, "assistant", "only here", 0), (3, 1, "assistant", "only here", 0)]
    a, b = spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)
    got = {(r["pair_id"], r["part"], r["turn"]): (r["rendered"], r["target"]) for r in chat.format_preferences(a, b).collect()}
    assert got == {
        (1, "prompt", 0): ("<|im_start|>user\nq<|im_end|>\n", False), (1, "chosen", 1): ("<|im_start|>assistant\ngood<|im_end|>\n", True),
        (1, "chosen", 2): ("<|im_start|>user\nmore<|im_end|>\n", False), (1, "rejected", 1): ("<|im_start|>assistant\nbad < |im_end|><|im_end|>\n", True),
        (2, "prompt", 0): ("<|im_start|>user\nsame<|im_end|>\n", False), (3, "prompt", 0): ("<|im_start|>\n<|im_end|>\n", False),
        (3, "rejected", 1): ("<|im_start|>assistant\nonly here<|im_end|>\n", True),
    }
    assert chat.format_preferences(a.limit(0), b.limit(0)).count() == 0
    assert chat.swapped_answers(a.limit(0)).count() == 0


def test_every_conversation_stays_and_ties_go_one_way(spark):
    rows = [
        (1, 0, "user", "q", 0), (1, 1, "assistant", "b", 0), (1, 1, "assistant", "a", 0), (1, 1, "assistant", "a", 0), (1, 2, "user", "bye", 0),
        (2, 0, "user", "alone", 0), (3, 0, "assistant", "x" * 200_000, 0), (4, 0, "assistant", None, 0), (5, 3, None, None, 0), (None, 1, "user", "x", 0),
    ]
    df = spark.createDataFrame(rows, TURNS)
    got = {(r["pair_id"], r["part"], r["turn"]): (r["role"], r["rendered"].split("\n", 1)[1][: -len(chat.CLOSE) - 1]) for r in chat.format_preferences(df, chat.swapped_answers(df)).collect()}
    assert got == {
        (1, "prompt", 0): ("user", "q"), (1, "chosen", 1): ("assistant", "a"), (1, "chosen", 2): ("user", "bye"), (1, "rejected", 1): ("assistant", ""),
        (2, "prompt", 0): ("user", "alone"), (3, "chosen", 0): ("assistant", "x" * 200_000), (3, "rejected", 0): ("assistant", ""),
        (4, "prompt", 0): ("assistant", ""), (5, "prompt", 3): ("", ""),
    }


def test_all_conversations_of_the_table_are_rendered(spark):
    sf = "/root/testdata/sf0.01"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {r[0] for r in queries.QUERIES["op4_preferences"](spark, sf).select("pair_id").distinct().collect()} == ids
