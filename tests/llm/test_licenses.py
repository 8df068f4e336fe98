from __future__ import annotations

from quernstone.llm.licenses import KNOWN, SENTENCES, oracle, scan
from quernstone.llm.queries import op10_licenses
from tests.oracle import assert_same

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_licenses(spark, sf)
    assert_same(got, oracle(), sf)
    assert got.where("licenses <> ''").count() > 10


def test_cases(spark):
    rows = [
        (1, MIT), (2, None), (3, ""), (4, "x\nLicensed under the Apache License, Version 2.0.\ny"), (5, "Released under the MIT License.\nAll rights reserved.\n" * 3), (6, "copyright law is not a licence"),
        (7, "SPDX-License-Identifier: GPL-3.0"), (8, "word " * 60_000 + "\nLicensed under CC BY-NC 4.0."), (8, "word " * 60_000 + "\nLicensed under CC BY-NC 4.0."),
        (9, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + SENTENCES["MIT/grant"] + ":"),
    ]
    docs = spark.createDataFrame([(i, t, "z", [1]) for i, t in rows], "doc_id long, text string, licenses string, ids array<int>")
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert scan(docs).count() == len(rows) and scan(docs.limit(0)).count() == 0
    assert got[1].licenses == "MIT" and got[1].sentence_ids.startswith("MIT/grant MIT/notice MIT/warranty")
    assert (got[2].n_sentences, got[3].licenses, got[6].sentence_ids) == (0, "", "")
    assert got[4].licenses == "Apache-2.0" and got[5].licenses == "MIT,all-rights-reserved" and got[5].n_sentences == 6
    assert got[7].licenses == "GPL-3.0" and got[8].licenses == "CC-BY-NC-4.0"
    assert got[9].licenses == ""  # the right sentences in the wrong order
    assert len(KNOWN) > 200


def test_headers_and_short_forms(spark):
    gpl3 = """Prog - does things.
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.example/MPL/2.0/."
    both = "MIT License applies to parts\n" + gpl3 + "\n\nLicensed under MIT\nno mark at the end"
    rows = [(1, gpl3), (2, mpl), (3, "SPDX-License-Identifier: GPL-3.0-or-later"), (4, "Licensed under the GNU General Public License v2.0 only."), (5, both), (None, None)]
    got = {r.doc_id: r.licenses for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "GPL-3.0", 2: "MPL-2.0", 3: "GPL-3.0", 4: "GPL-2.0", 5: "GPL-3.0,MIT", None: ""}


BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. """ + SENTENCES["BSD/source"].capitalize() + ".\n2. " + SENTENCES["BSD/binary"].capitalize() + ".\n"
BSD3 = BSD2 + "3. " + SENTENCES["BSD/endorse"].capitalize() + ".\n"


def test_longest_rule_expressions_and_more_licences(spark):
    lesser = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
    cases = {
        BSD2: "BSD-2-Clause", BSD3: "BSD-3-Clause", BSD2 + "\n" + BSD3: "BSD-2-Clause,BSD-3-Clause", BSD3 + "\n\n" + BSD3: "BSD-3-Clause", BSD3 + "\n" + BSD2: "BSD-2-Clause,BSD-3-Clause",
        BSD2 + "3. " + SENTENCES["BSD/advertise"] + ":\nThis product includes x.": "BSD-4-Clause",
        "SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0,MIT", "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note AND BSD-3-Clause) OR LGPL-2.1+ */": "BSD-3-Clause,GPL-2.0,LGPL-2.1",
        "SPDX-License-Identifier: Unknown-1.0": "", "This project is licensed under the MIT License - see the LICENSE file for details": "MIT", "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.": "MIT",
        lesser: "LGPL-2.1", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy": "Unlicense", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "This software is provided 'as-is', without any express or implied\nwarranty. Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:": "Zlib",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan(docs).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_sql_on_licence_texts(spark, tmp_path):
    texts = [MIT, BSD2, BSD3, BSD2 + BSD3, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib", "Released under MIT, see LICENSE for more information.", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert_same(scan(spark.read.parquet(str(tmp_path / "documents.parquet"))), oracle(), str(tmp_path))
