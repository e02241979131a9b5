"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised and looked up in a table of known licence sentences; the identifiers found, in their order,
are matched against ordered rules. A rule matches if its identifiers occur in this order, others in between allowed.

Results for odd input: a null or empty text has no identifiers and no licences; repeated rows and null ids stay; tied or repeated
sentences each give their identifier; other columns of the input are kept, and clashing ones (`sentence_ids`, `licences`, `n_licences`)
are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-ref",
    "licensed under the apache license version 2.0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "licensed under cc by nc 4.0": "ccbync4-ref",
    "licensed under cc by 4.0": "ccby4-ref",
    "licensed under cc by sa 4.0": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-ref",
    "spdx license identifier mit": "mit-ref",
    "spdx license identifier apache 2.0": "apache2-ref",
    "spdx license identifier gpl 3.0 only": "gpl3-ref",
    "spdx license identifier gpl 3.0 or later": "gpl3-ref",
    "all rights reserved": "rights-reserved",
}
# Further sentences of public licence notices.
SENTENCES |= {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "distributed under the boost software license version 1.0": "boost-ref",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-ref",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": "epl2-ref",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "ccbync4-ref",
    "licensed under the eupl": "eupl-ref",
}
# Identifiers of licences that a line SPDX-License-Identifier names.
SPDX = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT-0 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Unlicense UPL-1.0 WTFPL Zlib".split()
SENTENCES |= {f"spdx license identifier {x.lower().replace('-', ' ')}": f"spdx-{x}" for x in SPDX}
# Licences and the sentence identifiers that must follow one another for them.
RULES = [
    ("Apache-2.0", ["apache2-ref"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-copy"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-4.0", ["ccby4-ref"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4-ref"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("Proprietary", ["rights-reserved"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("BSL-1.0", ["boost-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("EUPL", ["eupl-ref"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-ref"]),
    ("Zlib", ["zlib-warranty", "zlib-liable", "zlib-grant"]),
    *((x, [f"spdx-{x}"]) for x in SPDX),
]
# The sentences into which LINES and WRAPPED cut notices of these licences, and their rules.
CUT_SENTENCES = {
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-grant",
    "either version 2.1 of the license or at your option any later version": "lgpl21-or-later",
    "either version 2 of the license or at your option any later version": "gpl2-or-later",
    "either version 3 of the license or at your option any later version": "gpl3-or-later",
    "this source code form is subject to the terms of the mozilla public license v.2.0": "mpl2-ref",
}
CUT_RULES = [("LGPL-2.1-or-later", ["lgpl-grant", "lgpl21-or-later"]), ("LGPL-3.0-or-later", ["lgpl-grant", "gpl3-or-later"]), ("GPL-2.0-or-later", ["gpl-grant", "gpl2-or-later"]), ("GPL-3.0-or-later", ["gpl-grant", "gpl3-or-later"])]
#: Where sentences end if each line is taken for itself, and if a text is wrapped, so that only blank lines and marks end them.
LINES, WRAPPED = r"\n+|[.!?;][ \t\r]+", r"\n[ \t\r]*\n\s*|[.!?;]\s+"
#: A version's number belongs to its sentence.
VERSION = r"\bv\.[^a-z0-9.]+([0-9])"


def cues(sentences: dict[str, str]) -> str:
    """A pattern of words such that each of the sentences holds one: a text without them has none of the sentences.

    Of each sentence's longer words, the one that most of the sentences without a word share is taken, until all have one.
    """
    left, taken = [s for s in sentences if s.split()], []
    longer = lambda s: [w for w in s.split() if len(w) >= min(6, max(map(len, s.split())))]
    while left:
        taken.append(max(sorted({w for s in left for w in longer(s)}), key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if taken[-1] not in s]
    return "|".join(w.replace(".", "[.]") for w in taken) or "(?!)"


def scan(df: DataFrame, text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Adds sentence_ids array<string> in text order, licences array<string> sorted and distinct, and n_licences.

    Sentences are read line by line and, for wrapped texts, across lines; sentence_ids has the reading that knows more of them.
    """
    sentences, rules = sentences or SENTENCES | CUT_SENTENCES, rules or RULES + CUT_RULES
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    wanted = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("% " + " % ".join(seq) + " %").alias("like")) for name, seq in rules])
    none = F.array().cast("array<string>")
    # Only sentences that hold a cue are normalised and looked up; a version's cue may be spelt with a space.
    cue = F.lit(cues(sentences))
    lower = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), VERSION, "v.$1")
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.]+", " "), r"^[ .]+|[ .]+$", "")

    def ids(cut: str):
        cued = F.filter(F.split(lower, cut), lambda s: F.rlike(s, cue))
        return F.when(F.rlike(lower, cue), F.filter(F.transform(cued, lambda s: F.try_element_at(known, clean(s))), lambda x: x.isNotNull())).otherwise(none)

    def licences(col: str):
        spaced = F.concat(F.lit(" "), F.array_join(F.col(col), "  "), F.lit(" "))
        return F.when(F.size(col) > 0, F.transform(F.filter(wanted, lambda r: F.like(spaced, r["like"])), lambda r: r["licence"])).otherwise(none)

    kept = [c for c in df.columns if c not in ("sentence_ids", "licences", "n_licences", "_lines", "_wrapped")]
    read = df.select(*kept, ids(LINES).alias("_lines"), ids(WRAPPED).alias("_wrapped"))
    both = read.select(*kept, F.when(F.size("_wrapped") > F.size("_lines"), F.col("_wrapped")).otherwise(F.col("_lines")).alias("sentence_ids"), F.array_sort(F.array_union(licences("_lines"), licences("_wrapped"))).alias("licences"))
    return both.withColumn("n_licences", F.size("licences"))
