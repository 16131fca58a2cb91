"""Licence recognition by sentences, in DataFrame functions only.

A text is cut into sentences; each is normalised (A-Z to lower case, everything but a-z and
0-9 a space) and, if known, mapped to its identifier. A sentence may span lines, up to a blank
one; one that is not known as a whole is looked up line by line. The identifiers in order,
unknown sentences leaving a gap, are matched against ordered licence rules: the longest
sequences first, each taking what it matches out of the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of notices that refer to them, normalised, as
# SENTENCE_END cuts them.
SENTENCES = {
    "mit_ref": ["released under the mit license", "licensed under the mit license",
                "this project is licensed under the mit license", "license mit"],
    "apache2_ref": ["licensed under the apache license version 2 0", "license apache 2 0",
                    "this project is licensed under the apache license 2 0",
                    "licensed under the apache license version 2 0 the license"],
    "gpl2_ref": ["this work is licensed under the gnu general public license version 2",
                 "licensed under the gnu general public license version 2"],
    "gpl3_ref": ["this work is licensed under the gnu general public license version 3",
                 "licensed under the gnu general public license version 3",
                 "licensed under the gnu gpl v3"],
    "lgpl3_ref": ["licensed under the gnu lesser general public license version 3"],
    "agpl3_ref": ["licensed under the gnu affero general public license version 3"],
    "cc_by_ref": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa_ref": ["licensed under cc by sa 4 0"],
    "cc_by_nc_ref": ["licensed under cc by nc 4 0"],
    "cc0_ref": ["this work is dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0"],
    "bsd3_ref": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "bsd2_ref": ["licensed under the bsd 2 clause license"],
    "isc_ref": ["licensed under the isc license", "released under the isc license"],
    "mpl2_ref": ["licensed under the mozilla public license version 2 0",
                 "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "apache2_title": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "gpl2_title": ["gnu general public license version 2 june 1991"],
    "gpl3_title": ["gnu general public license version 3 29 june 2007"],
    "lgpl21_title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl3_title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl3_title": ["gnu affero general public license version 3 19 november 2007"],
    "mpl2_title": ["mozilla public license version 2 0"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions"],
    "mit_notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software"],
    "as_is_mit": [
        "the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc_grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zero_grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted"],
    "as_is_isc": [
        "the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness"],
    "unlicense_free": ["this is free and unencumbered software released into the public domain"],
    "unlicense_anyone": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source "
        "code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "epl2_terms": [
        "this program and the accompanying materials are made available under the terms of the eclipse public "
        "license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "bsd_grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met"],
    "bsd_source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer"],
    "bsd_binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission"],
    "apache_you_may": ["you may not use this file except in compliance with the license"],
    "apache_obtain": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache_at": ["you may obtain a copy of the license at"],
    "apache_url": ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"],
    "gpl_free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version"],
    "gpl_hope": [
        "this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose"],
    "fsf_program": ["this program is free software"],
    "fsf_library": ["this library is free software"],
    "gpl3_you_can": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl3_you_can": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3_you_can": [
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl_terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation"],
    "lgpl_terms": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation"],
    "later_2": ["either version 2 of the license or at your option any later version"],
    "later_21": ["either version 2 1 of the license or at your option any later version"],
    "gpl_no_warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "lgpl_no_warranty": ["this library is distributed in the hope that it will be useful but without any warranty"],
    "gpl_without_even": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "mpl2_form": ["this source code form is subject to the terms of the mozilla public license v"],
    "two_0": ["2 0"],
    "spdx": ["spdx license identifier"],
    "spdx_mit": ["mit"],
    "spdx_apache2": ["apache 2 0"],
    "spdx_bsd2": ["bsd 2 clause"],
    "spdx_bsd3": ["bsd 3 clause"],
    "spdx_gpl2": ["gpl 2 0 only"],
    "spdx_gpl2_later": ["gpl 2 0 or later"],
    "spdx_gpl3": ["gpl 3 0 only"],
    "spdx_gpl3_later": ["gpl 3 0 or later"],
    "spdx_lgpl21_later": ["lgpl 2 1 or later"],
    "spdx_agpl3_later": ["agpl 3 0 or later"],
    "spdx_isc": ["isc"],
    "spdx_mpl2": ["mpl 2 0"],
    "spdx_cc0": ["cc0 1 0"],
    "spdx_unlicense": ["unlicense"],
}
# Licences and the sentences that make them, in order.
RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("GPL-3.0-or-later", ["fsf_program", "gpl3_you_can", "gpl_no_warranty", "gpl_without_even"]),
    ("Apache-2.0", ["apache2_ref", "apache_you_may", "apache_at", "apache_url"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is_mit"]),
    ("Apache-2.0", ["apache2_ref", "apache_you_may", "apache_obtain"]),
    ("GPL-2.0-or-later", ["fsf_program", "gpl_terms", "later_2"]),
    ("LGPL-2.1-or-later", ["fsf_library", "lgpl_terms", "later_21"]),
    ("Apache-2.0", ["apache2_ref", "apache_you_may"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-3.0-or-later", ["fsf_program", "gpl3_you_can"]),
    ("LGPL-3.0-or-later", ["fsf_program", "lgpl3_you_can"]),
    ("LGPL-3.0-or-later", ["fsf_library", "lgpl3_you_can"]),
    ("AGPL-3.0-or-later", ["fsf_program", "agpl3_you_can"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("ISC", ["isc_grant", "as_is_isc"]),
    ("0BSD", ["zero_grant", "as_is_isc"]),
    ("Unlicense", ["unlicense_free", "unlicense_anyone"]),
    ("MPL-2.0", ["mpl2_form", "two_0"]),
    ("MIT", ["spdx", "spdx_mit"]),
    ("Apache-2.0", ["spdx", "spdx_apache2"]),
    ("BSD-2-Clause", ["spdx", "spdx_bsd2"]),
    ("BSD-3-Clause", ["spdx", "spdx_bsd3"]),
    ("GPL-2.0", ["spdx", "spdx_gpl2"]),
    ("GPL-2.0-or-later", ["spdx", "spdx_gpl2_later"]),
    ("GPL-3.0", ["spdx", "spdx_gpl3"]),
    ("GPL-3.0-or-later", ["spdx", "spdx_gpl3_later"]),
    ("LGPL-2.1-or-later", ["spdx", "spdx_lgpl21_later"]),
    ("AGPL-3.0-or-later", ["spdx", "spdx_agpl3_later"]),
    ("ISC", ["spdx", "spdx_isc"]),
    ("MPL-2.0", ["spdx", "spdx_mpl2"]),
    ("CC0-1.0", ["spdx", "spdx_cc0"]),
    ("Unlicense", ["spdx", "spdx_unlicense"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("EPL-2.0", ["epl2_terms"]),
    ("ISC", ["isc_grant"]),
    ("Unlicense", ["unlicense_free"]),
    ("MIT", ["mit_ref"]),
    ("Apache-2.0", ["apache2_ref"]),
    ("Apache-2.0", ["apache2_title"]),
    ("GPL-2.0", ["gpl2_ref"]),
    ("GPL-2.0", ["gpl2_title"]),
    ("GPL-3.0", ["gpl3_ref"]),
    ("GPL-3.0", ["gpl3_title"]),
    ("LGPL-2.1", ["lgpl21_title"]),
    ("LGPL-3.0", ["lgpl3_ref"]),
    ("LGPL-3.0", ["lgpl3_title"]),
    ("AGPL-3.0", ["agpl3_ref"]),
    ("AGPL-3.0", ["agpl3_title"]),
    ("CC-BY-4.0", ["cc_by_ref"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_ref"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_ref"]),
    ("CC0-1.0", ["cc0_ref"]),
    ("BSD-3-Clause", ["bsd3_ref"]),
    ("BSD-2-Clause", ["bsd2_ref"]),
    ("ISC", ["isc_ref"]),
    ("MPL-2.0", ["mpl2_ref"]),
    ("MPL-2.0", ["mpl2_title"]),
]
# A sentence ends at these signs before white space or the text's end, or at a blank line.
SENTENCE_END = r"[.;:!?]+(?:[ \t\r\n]+|\z)|\r?\n[ \t]*\r?\n[ \t\r\n]*"
LINE_END = r"[\r\n]+"
WORDS = r"[A-Za-z0-9]"
LIST_NUMBER = r"\A[ \t\r\n(]*([0-9]{1,2}|[IVXivx]{2,4})[ \t\r\n)]*\z"  # parts no sentences


def _normal(sentence: Column) -> Column:
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def ordered_rules(rules: list[tuple[str, list[str]]] | None = None) -> list[tuple[str, str]]:
    """(licence, ",id,id,") with the longest sequences first, else in the order given."""
    ranked = sorted(enumerate(RULES if rules is None else rules), key=lambda x: (-len(x[1][1]), x[0]))
    return [(name, "".join(f"<{i}>" for i in ids)) for _, (name, ids) in ranked]


def license_scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sentences: dict[str, list[str]] | None = None,
    rules: list[tuple[str, list[str]]] | None = None,
) -> DataFrame:
    """(doc_id, n_sentences, n_known, sequence, licenses) of every row.

    sequence is "<id>" for each known sentence, in order, and "-" for each run of unknown ones
    between or around them; licenses the sorted names of the rules that matched, comma-joined.
    A sentence that is not known as a whole counts as its lines. List numbers are no sentences.
    A rule matches adjacent identifiers and takes them out, so a longer rule hides the shorter
    ones in it; of rules of one length the first in order goes first. A sentence that is wrapped
    needs a blank line or a sign before it. Null and empty texts have no sentences; texts may be
    of any length. Repeated rows stay repeated, null keys are kept, other columns are not read,
    and an empty table gives an empty result. `sentences` are normalised as texts are.
    """
    known = SENTENCES if sentences is None else sentences
    pairs = [F.lit(x) for i, own in known.items() for s in own for x in (s, f"<{i}>")]
    table = F.create_map(*pairs) if pairs else F.create_map(F.lit("-"), F.lit("-"))

    def looked_up(s: Column) -> Column:
        return F.try_element_at(table, _normal(s))

    def by_line(s: Column) -> Column:
        lines = F.filter(F.split(s, LINE_END, -1), lambda x: x.rlike(WORDS))
        return F.transform(lines, lambda x: F.coalesce(looked_up(x), F.lit("-")))

    full = F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END, -1)
    parts = F.filter(full, lambda s: s.rlike(WORDS) & ~s.rlike(LIST_NUMBER))
    ids = F.flatten(
        F.transform(parts, lambda s: F.when(looked_up(s).isNotNull(), F.array(looked_up(s))).otherwise(by_line(s)))
    )
    rows = docs.select(F.col(key).alias("doc_id"), ids.alias("ids"))
    rows = rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.size(F.filter("ids", lambda x: x != "-")).cast("long").alias("n_known"),
        F.regexp_replace(F.array_join("ids", ""), "-+", "-").alias("sequence"),
    )
    return _with_licenses(rows, RULES if rules is None else rules)


def _with_licenses(rows: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    rest, hits = F.col("sequence"), []
    for name, pattern in ordered_rules(rules):
        hits.append(F.when(F.contains(rest, F.lit(pattern)), F.lit(name)))
        rest = F.replace(rest, F.lit(pattern), F.lit("-"))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    # most texts have no known sentence, and no rule to try
    return rows.withColumn(
        "licenses", F.when(F.col("n_known") > 0, F.array_join(found, ",")).otherwise("")
    )


def oracle(sentences: dict[str, list[str]] | None = None) -> str:
    """The same in DuckDB's SQL."""
    known = SENTENCES if sentences is None else sentences
    values = ", ".join(f"('{s}', '<{i}>')" for i, own in known.items() for s in own)
    steps, last = [], "seq"
    for k, (name, pattern) in enumerate(ordered_rules()):
        steps.append(
            f"r{k} AS (SELECT *, CASE WHEN contains(rest, '{pattern}') THEN list_append(hits, '{name}') "
            f"ELSE hits END AS hits{k}, replace(rest, '{pattern}', '-') AS rest{k} FROM "
            f"(SELECT doc_id, n_sentences, n_known, sequence, {'sequence' if not k else f'rest{k - 1}'} AS rest, "
            f"{'[]::VARCHAR[]' if not k else f'hits{k - 1}'} AS hits FROM {last}))"
        )
        last = f"r{k}"
    normal = (
        "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^a-z0-9]+', ' ', 'g'))"
    )
    return f"""
WITH known(s, id) AS (VALUES {values}),
parts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SENTENCE_END}'),
    lambda x: regexp_matches(x, '{WORDS}') AND NOT regexp_matches(x, '{LIST_NUMBER}')) AS p FROM documents),
one AS (SELECT doc_id, i, x, id FROM (SELECT doc_id, i, p[i] AS x
    FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)) LEFT JOIN known ON {normal.format("x")} = known.s),
lines AS (SELECT doc_id, i, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, i,
    list_filter(string_split_regex(x, '{LINE_END}'), lambda y: regexp_matches(y, '{WORDS}')) AS l FROM one WHERE id IS NULL)),
ids AS (SELECT doc_id, i, 0 AS j, id FROM one WHERE id IS NOT NULL
    UNION ALL SELECT doc_id, i, j, coalesce(id, '-') FROM lines LEFT JOIN known ON {normal.format("l[j]")} = known.s),
made AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (id <> '-') AS n_known,
    regexp_replace(string_agg(id, '' ORDER BY i, j), '-+', '-', 'g') AS sequence FROM ids GROUP BY doc_id),
seq AS (SELECT parts.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_known, 0) AS n_known,
    coalesce(sequence, '') AS sequence FROM parts LEFT JOIN made ON parts.doc_id = made.doc_id),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, sequence,
    array_to_string(list_sort(list_distinct(hits{len(steps) - 1})), ',') AS licenses FROM {last}
"""
