from spawnlens.llm import licences

MIT = """MIT License

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
TEXTS = [
    (1, None, []), (2, "", []), (3, "words only", []), (4, "Some text.\nReleased under the MIT License.", ["MIT"]), (5, MIT, ["MIT"]),
    (6, "text without mark\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.", ["Apache-2.0", "Proprietary"]),
    (7, "You may obtain a copy of the License at x. You may not use this file except in compliance with the License.", []),
    (8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"]),
    (9, "This work is licensed under the GNU General Public License, version 3. " * 3, ["GPL-3.0"]), (9, "Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), (None, "SPDX-License-Identifier: MIT", ["MIT"]), (10, "x " * 300_000 + "\nMIT License", []), (11, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n  http://x", ["Apache-2.0"]),
]


def test_scan(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in TEXTS], "doc_id long, text string, licences string")
    got = licences.scan(df)
    assert got.columns == ["doc_id", "text", "sentence_ids", "licences", "n_licences"]
    rows = got.collect()
    assert [r["licences"] for r in rows] == [w for _, _, w in TEXTS]
    assert rows[8]["sentence_ids"] == ["gpl3-ref"] * 3
    assert licences.scan(df.where("false")).count() == 0
    assert not any("Python" in x or "Arrow" in x for x in got._jdf.queryExecution().executedPlan().toString().split())


def test_rules_are_ordered(spark):
    df = spark.createDataFrame([("a b. c d.",), ("c d. a b.",), ("a b.\nlicense x.\nc d.",)], "text string")
    got = licences.scan(df.selectExpr("replace(replace(text, 'a b', 'license a'), 'c d', 'license c') AS text"), sentences={"license a": "A", "license c": "C"}, rules=[("AC", ["A", "C"])])
    assert [r["licences"] for r in got.collect()] == [["AC"], [], ["AC"]]


GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NOTICES = [
    (GPL, ["GPL-2.0-or-later"]), (GPL.replace("version 2", "version 3"), ["GPL-3.0-or-later"]), (GPL.replace("\n", " "), ["GPL-2.0-or-later"]), ("/* " + GPL.replace("\n", "\n * ") + " */", ["GPL-2.0-or-later"]), (GPL.replace("General", "Library General"), []),
    (TEXTS[7][1], ["GPL-3.0-or-later"]), (TEXTS[7][1].replace("version 3", "version 2"), ["GPL-2.0-or-later"]),
    (MPL, ["MPL-2.0"]), (MPL.replace("\n", " "), ["MPL-2.0"]), ("# " + MPL.replace("v. ", "v.\n").replace("\n", "\n# "), ["MPL-2.0"]), (MPL.replace("v. 2.0", "v. 1.9"), []),
    (BSD, ["BSD-2-Clause"]), (BSD + "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.", ["BSD-2-Clause", "BSD-3-Clause"]),
    (GPL.replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ").replace("program", "library"), ["LGPL-2.1-or-later"]), (GPL.replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 3 "), ["LGPL-3.0-or-later"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", ["GPL-2.0-only"]),
    (TEXTS[7][1].replace("GNU General", "GNU Affero General"), ["AGPL-3.0-or-later"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]), ("// Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("Licensed under the EUPL", ["EUPL"]),
    ("To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain worldwide.", ["CC0-1.0"]),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", ["Zlib"]),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", ["EPL-2.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    *((f"# SPDX-License-Identifier: {x}\nimport os", [x]) for x in licences.SPDX),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), (TEXTS[8][1], ["GPL-3.0"]), (MIT, ["MIT"]), (TEXTS[-1][1], ["Apache-2.0"]), ("All rights reserved.", ["Proprietary"]),
]


def test_every_rule_with_its_notice(spark):
    rows = licences.scan(spark.createDataFrame([(t,) for t, _ in NOTICES], "text string")).collect()
    assert [r["licences"] for r in rows] == [w for _, w in NOTICES]
    assert {w for _, ws in NOTICES for w in ws} == {name for name, _ in licences.RULES + licences.CUT_RULES}


def test_tables_of_the_caller(spark):
    df = spark.createDataFrame([("alpha beta.\ngamma delta.",), ("Gamma, delta! Alpha beta.",), ("alpha",), (None,)], "text string")
    rows = licences.scan(df, sentences={"alpha beta": "A", "gamma delta": "B"}, rules=[("AB", ["A", "B"])]).collect()
    assert [(r["sentence_ids"], r["licences"]) for r in rows] == [(["A", "B"], ["AB"]), (["B", "A"], []), ([], []), ([], [])]
    every = {s: "x" for s in licences.SENTENCES | licences.CUT_SENTENCES}
    assert all(any(w.replace("[.]", ".") in s for w in licences.cues(every).split("|")) for s in every)


def test_sql_reads_the_same_notices(spark):
    """The query's SQL on a table that has the notices which the given documents lack, cut and wrapped ones included."""
    import sys
    from pathlib import Path

    import duckdb

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from compare import same
    from pyspark.sql import functions as F

    from spawnlens.llm.oracles import LICENCES

    texts = [MIT, GPL, MPL, BSD, *(n[0] if isinstance(n[0], str) else n[1] for n in NOTICES), *(t for _, t, _ in TEXTS if t), GPL + "\n\n" + MPL, GPL.replace("\n", " "), MPL.replace("v. ", "v."), ""]
    rows = [(k, t) for k, t in enumerate(texts)] + [(999, None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.col("n_licences").cast("long").alias("n_licences"))
    same(got, c, LICENCES)
    assert {"GPL-2.0-or-later", "MPL-2.0"} <= {x for r in got.collect() for x in r["licences"].split(",")}
