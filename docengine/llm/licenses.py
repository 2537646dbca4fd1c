"""Licence recognition by sentences: known sentences get identifiers, identifier sequences match ordered rules.

DataFrame functions only. Line ends are made one kind, the marks that begin comment lines go, and the text
is cut into sentences at stops and at blank lines, so wrapped sentences stay whole. A sentence is normalised
to lower-case words of ASCII letters and digits; it has the identifier of each known sentence that it holds
as whole words, in the order of their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: normalised sentences of public licences and of licence notices
SENTENCES = {
    "mit-note": ["released under the mit license", "licensed under the mit license", "under the terms of the mit license", "distributed under the mit license", "available under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied"],
    "apache-note": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "under the terms of the apache license version 2 0", "licensed under the apache 2 0 license"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-as-is": ["software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "gpl3-note": ["licensed under the gnu general public license version 3", "under the terms of the gnu general public license version 3", "licensed under the gnu gpl version 3"],
    "gpl2-note": ["licensed under the gnu general public license version 2", "under the terms of the gnu general public license version 2", "licensed under the gnu gpl version 2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl-free": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-free": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "fsf-3": ["free software foundation either version 3 of the license"],
    "fsf-2": ["free software foundation either version 2 of the license"],
    "fsf-2-1": ["free software foundation either version 2 1 of the license"],
    "gpl-warranty": ["in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl3-note": ["licensed under the gnu lesser general public license version 3"],
    "lgpl2-note": ["licensed under the gnu lesser general public license version 2 1"],
    "agpl-note": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license version 3"],
    "bsd-note-3": ["licensed under the bsd 3 clause license", "released under the 3 clause bsd license", "governed by a bsd style license that can be found in the license file"],
    "bsd-note-2": ["licensed under the bsd 2 clause license", "released under the 2 clause bsd license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-ads": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-name": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "licensed under the zero clause bsd license"],
    "mpl-note": ["this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license version 2 0"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl-note": ["made available under the terms of the eclipse public license", "licensed under the eclipse public license"],
    "boost-note": ["distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0"],
    "zlib-use": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "zlib-origin": ["the origin of this software must not be misrepresented you must not claim that you wrote the original software"],
    "artistic-note": ["licensed under the artistic license 2 0", "under the terms of the artistic license 2 0"],
    "ofl-note": ["licensed under the sil open font license version 1 1"],
    "wtfpl-note": ["do what the fuck you want to public license"],
    "ccby-note": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "ccbysa-note": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license", "licensed under a creative commons attribution share alike 4 0 international license"],
    "ccbync-note": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbyncsa-note": ["licensed under cc by nc sa 4 0", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "ccbynd-note": ["licensed under cc by nd 4 0", "licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc0-note": ["licensed under cc0 1 0", "dedicated to the public domain under a cc0 1 0 license", "the person who associated a work with this deed has dedicated the work to the public domain"],
    "unlicense-grant": ["this is free and unencumbered software released into the public domain"],
    "public-domain": ["this work is in the public domain", "placed in the public domain", "released into the public domain by its author"],
    "reserved": ["copyright all rights reserved", "all rights reserved under copyright", "this software is proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited"],
}
# fixed values: licences by the names that a line "SPDX-License-Identifier: <name>" gives
SPDX = (
    "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib",
    "Artistic-2.0", "OFL-1.1", "WTFPL", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense",
)
# fixed values: the ordered rules, a licence and its sentence identifiers in order (others may stand between)
RULES = [
    ("MIT", ["mit-note"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", ["apache-note"]),
    ("Apache-2.0", ["apache-use", "apache-copy", "apache-as-is"]),
    ("GPL-3.0", ["gpl3-note"]),
    ("GPL-3.0", ["gpl-free", "fsf-3"]),
    ("GPL-2.0", ["gpl2-note"]),
    ("GPL-2.0", ["gpl-free", "fsf-2"]),
    ("LGPL-3.0", ["lgpl3-note"]),
    ("LGPL-3.0", ["lgpl-free", "fsf-3"]),
    ("LGPL-2.1", ["lgpl2-note"]),
    ("LGPL-2.1", ["lgpl-free", "fsf-2-1"]),
    ("AGPL-3.0", ["agpl-note"]),
    ("AGPL-3.0", ["agpl-free", "fsf-3"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-note-3"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-note-2"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl-note"]),
    ("EPL-2.0", ["epl-note"]),
    ("BSL-1.0", ["boost-note"]),
    ("Zlib", ["zlib-use", "zlib-origin"]),
    ("Artistic-2.0", ["artistic-note"]),
    ("OFL-1.1", ["ofl-note"]),
    ("WTFPL", ["wtfpl-note"]),
    ("CC-BY-4.0", ["ccby-note"]),
    ("CC-BY-SA-4.0", ["ccbysa-note"]),
    ("CC-BY-NC-4.0", ["ccbync-note"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa-note"]),
    ("CC-BY-ND-4.0", ["ccbynd-note"]),
    ("CC0-1.0", ["cc0-note"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Public-Domain", ["public-domain"]),
    ("Proprietary", ["reserved"]),
] + [(name, [f"spdx-{name.lower()}"]) for name in SPDX]
#: Where the first of two licences is found, the second, whose rule is part of the first's, is not named.
INSTEAD = (("BSD-4-Clause", "BSD-3-Clause"), ("BSD-4-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-2-Clause"))
#: Every known sentence holds one of these, so sentences without them need no search.
CUES = ("licen", "permission", "redistribut", "warrant", "copyright", "public domain", "advertising", "misrepresented", "free software foundation", "proprietary", "unauthorized copying", "mpl was not")
IDS = {s: name for name, sentences in SENTENCES.items() for s in sentences} | {"spdx license identifier " + name.lower().replace("-", " ").replace(".", " "): f"spdx-{name.lower()}" for name in SPDX}

#: A line end and what comment lines begin with; a stop before white space, or a blank line.
COMMENT = r"\n[ \t]*[#*/;%>|!-]+[ \t]*"
CUT = r"[.!?][ \t\n]+|\n[ \t]*\n"


def _identifiers(low: Column) -> Column:
    """<id><id>... of the known sentences of a lower-case text, in order; a sentence gives an identifier once for each known one."""
    lines = F.concat(F.lit("\n"), F.replace(F.replace(low, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    sentences = F.split(F.regexp_replace(lines, COMMENT, "\n"), CUT)
    cued = F.filter(sentences, lambda s: s.rlike("|".join(c.replace(" ", "[^a-z0-9]+") for c in CUES)))
    normal = F.transform(cued, lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), F.lit(" ")))
    known = F.array(*(F.struct(F.lit(f" {s} ").alias("says"), F.lit(f"<{name}>").alias("id")) for s, name in IDS.items()))

    def names(s: Column) -> Column:
        placed = F.transform(known, lambda k: F.struct(F.position(k.says, s).alias("at"), k.id.alias("id")))
        return F.array_join(F.transform(F.array_sort(F.filter(placed, lambda p: p["at"] > 0)), lambda p: p["id"]), "")

    return F.array_join(F.transform(normal, names), "")


def recognise(docs: DataFrame) -> DataFrame:
    """One row per document: its known sentences in order, how many they are, and the licences whose rules match.

    Null and empty texts have none; repeated rows give a row each; the same licence is named once, in the order of
    the rules. Known sentences that begin at one place are ordered by their identifiers.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    cue = F.lit(False)
    for word in CUES:
        cue = cue | F.contains("low", F.lit(word.split()[0]))
    staged = docs.select("doc_id", low.alias("low")).select("doc_id", F.when(cue, F.col("low")).alias("low"))
    found = staged.select("doc_id", F.coalesce(F.when(F.col("low").isNotNull(), _identifiers(F.col("low"))), F.lit("")).alias("sentences"))
    matched: dict[str, Column] = {}
    for name, ids in RULES:
        hit = F.col("sentences").like("%" + "%".join(f"<{i}>" for i in ids) + "%")
        matched[name] = matched[name] | hit if name in matched else hit
    whole = dict(matched)
    for first, second in INSTEAD:
        matched[second] = matched[second] & ~whole[first]
    licences = F.concat_ws(",", *(F.when(hit, F.lit(name)) for name, hit in matched.items()))
    return found.select("doc_id", F.regexp_count("sentences", F.lit("<")).cast("long").alias("n_sentences"), "sentences", F.when(F.col("sentences") == "", "").otherwise(licences).alias("licenses"))


def oracle() -> str:
    """The same in SQL by another way: lines are grouped into paragraphs by windows, sentences are joined with known ones."""
    known = ", ".join(f"(' {s} ', '{name}')" for s, name in IDS.items())
    rules = ", ".join(f"({n}, '{name}', '%{'%'.join(f'<{i}>' for i in ids)}%')" for n, (name, ids) in enumerate(RULES))
    instead = ", ".join(f"('{a}', '{b}')" for a, b in INSTEAD)
    return rf"""
WITH known(says, id) AS (VALUES {known}),
rules(nth, name, pattern) AS (VALUES {rules}),
instead(first, second) AS (VALUES {instead}),
docs AS (SELECT row_number() OVER () AS row, doc_id, lower(coalesce(text, '')) AS low FROM documents),
numbered AS (SELECT row, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT row, string_split_regex(low, '\r\n|\r|\n') AS l FROM docs)),
plain AS (SELECT row, n, regexp_replace(line, '^[ \t]*[#*/;%>|!-]+[ \t]*', '') AS line FROM numbered),
grouped AS (SELECT row, n, line, sum(CASE WHEN trim(line, ' ' || chr(9)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY n) AS paragraph FROM plain),
paragraphs AS (SELECT row, paragraph, string_agg(line, ' ' ORDER BY n) AS body FROM grouped GROUP BY row, paragraph),
cut AS (SELECT row, paragraph, unnest(l) AS said, generate_subscripts(l, 1) AS nth FROM (SELECT row, paragraph, string_split_regex(body, '[.!?]\s+') AS l FROM paragraphs)),
normal AS (SELECT row, paragraph, nth, ' ' || array_to_string(list_filter(string_split_regex(said, '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' AS said FROM cut),
hits AS (SELECT row, paragraph, nth, strpos(said, says) AS place, id FROM normal JOIN known ON contains(said, says)),
named AS (SELECT row, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY paragraph, nth, place, '<' || id || '>') AS sentences FROM hits GROUP BY row),
ruled AS (SELECT row, name, min(nth) AS nth FROM named JOIN rules ON sentences LIKE pattern GROUP BY row, name),
firsts AS (SELECT name, min(nth) AS place FROM rules GROUP BY name),
stay AS (SELECT row, name FROM ruled AS r WHERE NOT EXISTS (SELECT 1 FROM instead AS i JOIN ruled AS o ON o.name = i.first WHERE i.second = r.name AND o.row = r.row)),
listed AS (SELECT row, string_agg(name, ',' ORDER BY place) AS licenses FROM stay JOIN firsts USING (name) GROUP BY row)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_sentences, coalesce(n.sentences, '') AS sentences, coalesce(l.licenses, '') AS licenses
FROM docs AS d LEFT JOIN named AS n ON n.row = d.row LEFT JOIN listed AS l ON l.row = d.row"""
