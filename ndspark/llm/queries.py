"""Queries of the pipeline operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


ASCII_LOWER = (
    "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)


@query(
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w
    FROM documents),
b AS (SELECT item_id, regexp_extract_all({ASCII_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w
    FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
    FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM p JOIN win ON p.n = win.n AND p.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
"""
)
def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, items).drop("items")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op6_bpe(spark, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), word_bpe())


@query()
def op9_token_files(spark, sf_dir: str) -> DataFrame:
    from .tokenfiles import token_files

    return token_files(table(spark, sf_dir, "documents"), word_bpe(), end_id=1)


@query(
    """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM q
"""
)
def op10_warc(spark, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


@query()
def op5_html(spark, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query()
def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON v.vec_id = l.a
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON v.vec_id = r.a
"""
)
def op3_lattice(spark, sf_dir: str) -> DataFrame:
    from .lattice import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def _license_sql() -> str:
    from .licenses import oracle

    return oracle()


@query(_license_sql())
def op2_licenses(spark, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@query(
    """
WITH u AS (SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (SELECT conv_id, max(turn) AS last, arg_max(said.text, turn) AS answer
    FROM u WHERE said.role = 'assistant' GROUP BY conv_id),
s AS (SELECT l.conv_id, l.last, coalesce(d.answer, '') AS other FROM l LEFT JOIN l d ON d.conv_id = l.conv_id + 1),
k AS (SELECT conv_id AS pair_id, turn, said.role AS role, said.text AS text FROM u),
r AS (SELECT k.pair_id, k.turn, k.role, k.text FROM k LEFT JOIN s ON s.conv_id = k.pair_id
    WHERE s.last IS NULL OR k.turn < s.last
    UNION ALL SELECT conv_id, last, 'assistant', other FROM s),
j AS (SELECT coalesce(k.pair_id, r.pair_id) AS pair_id, coalesce(k.turn, r.turn) AS turn, k.role AS cr, k.text AS ct,
    r.role AS rr, r.text AS rt FROM k FULL JOIN r ON k.pair_id = r.pair_id AND k.turn = r.turn),
f AS (SELECT pair_id, min(turn) AS first FROM j WHERE cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt GROUP BY pair_id),
p AS (SELECT j.*, f.first FROM j LEFT JOIN f ON f.pair_id = j.pair_id),
o AS (SELECT pair_id, 'prompt' AS part, turn, cr AS role, ct AS text FROM p WHERE first IS NULL OR turn < first
    UNION ALL SELECT pair_id, 'chosen', turn, cr, ct FROM p WHERE turn >= first AND cr IS NOT NULL
    UNION ALL SELECT pair_id, 'rejected', turn, rr, rt FROM p WHERE turn >= first AND rr IS NOT NULL)
SELECT pair_id, part, turn, role, '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'),
    '<|im_end|>', '< |im_end|>') || chr(10) || replace(replace(text, '<|im_start|>', '< |im_start|>'),
    '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS rendered,
    part <> 'prompt' AND role = 'assistant' AS target FROM o
"""
)
def op4_preferences(spark, sf_dir: str) -> DataFrame:
    from .chat import format_preferences, swapped_answers

    turns = table(spark, sf_dir, "conversations")
    return format_preferences(turns, swapped_answers(turns))
