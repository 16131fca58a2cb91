import textwrap

import pytest

from ndspark.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
WHOLE = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "MPL-2.0": MPL}


def _wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


@pytest.mark.parametrize("width", [40, 76, 10_000])
def test_standard_texts_are_found(spark, width):
    rows = [(name, "Copyright (c) 2020 A. Person\n\n" + _wrapped(text, width)) for name, text in WHOLE.items()]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {name: name for name in WHOLE}


def test_every_rule_of_references_and_lines(spark):
    rows = [(name, "Some words\n" + ".\n".join(licenses.SENTENCES[i][0] for i in ids) + "\nmore words") for name, ids in licenses.RULES]
    got = licenses.license_scan(spark.createDataFrame(rows + [("", None)], "doc_id string, text string")).collect()
    assert [r["doc_id"] for r in got if r["licenses"] != r["doc_id"]] == []


def test_more_standard_texts(spark):
    texts = {
        "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
        "Apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "GPL-2.0": "# SPDX-License-Identifier: GPL-2.0-only\nimport os",
        "": "MIT is a place. ISC, too.\n\nUnlicense\n\n1. Redistributions",
    }
    rows = [(name, t) for name, t in texts.items()] + [(None, "License: MIT"), (None, "License: MIT"), ("long", "word " * 200_000 + "\n\nReleased under the MIT License.")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    found = {r["doc_id"]: r["licenses"] for r in got if r["doc_id"] in texts}
    assert found == {name: name for name in texts}
    assert [r["licenses"] for r in got if r["doc_id"] not in texts] == ["", "", "MIT"]


def test_sentences_of_the_caller(spark):
    df = spark.createDataFrame([(1, "Use it as you like.\nBye")], "doc_id long, text string")
    got = licenses.license_scan(df, sentences={"own": ["use it as you like"]}, rules=[("Own", ["own"])]).first()
    assert got["licenses"] == "Own" and licenses.license_scan(df, sentences={}).first()["n_known"] == 0


def test_sql_on_odd_texts(spark, tmp_path):
    from oracle import compare

    from ndspark.llm import queries

    odd = [*WHOLE.values(), *(_wrapped(t, 50) for t in WHOLE.values()), "a\r\n\r\nb. c\x0b\u2028", "1. Redistributions of source code must retain\nx", "1.\nii. iv) License: MIT", None, "", "...", "é. É"]
    rows = [(i, t) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/x")
    (part,) = (tmp_path / "x").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    compare(spark, str(tmp_path), queries.QUERIES["op2_licenses"], queries.ORACLE_SQL["op2_licenses"])
