"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each normalised to lower-case ASCII words. Sentences known from licences and
licence notices are mapped to identifiers; the sequence of identifiers, unknown sentences left out, is
matched against ordered rules, the longest first. What a rule has matched no later rule matches again.

Marks of comments at the start of lines go first (// # * /* -- % <!-- and the like). A sentence ends after . ! or ?
before white space, and at a blank line; so hard-wrapped notices are read whole. Of a sentence that is not known as a
whole every line is looked up by itself, since many texts put a licence in a line without a stop.

Null and empty texts: no sentence, no licence. Repeated rows give repeated rows; empty tables none. Extra
columns are ignored by `license_scans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

# Sentences of licences and notices, normalised, by identifier.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-name": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-notice": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "this work has been dedicated to the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-name": "isc license",
    "zlib-given": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl-program": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "epl-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "boost-ref": "distributed under the boost software license version 1 0",
    "wtfpl": "do what the fuck you want to public license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-gpl3-only": "spdx license identifier gpl 3 0 only",
    "spdx-gpl2": "spdx license identifier gpl 2 0 or later",
    "spdx-gpl2-only": "spdx license identifier gpl 2 0 only",
    "spdx-lgpl21": "spdx license identifier lgpl 2 1 or later",
    "spdx-agpl3": "spdx license identifier agpl 3 0 or later",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-isc": "spdx license identifier isc",
    "spdx-mpl": "spdx license identifier mpl 2 0",
    "spdx-epl": "spdx license identifier epl 2 0",
    "spdx-cc0": "spdx license identifier cc0 1 0",
}

# Ordered rules: licence, kind, identifiers in order.
RULES = [
    ("MIT", "permissive", ["mit-name", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-comply", "apache-copy", "apache-basis"]),
    ("Apache-2.0", "permissive", ["apache-head", "apache-copy", "apache-basis"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-free", "lgpl-hope", "lgpl-see"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl-free", "gpl-hope", "agpl-see"]),
    ("Zlib", "permissive", ["zlib-given", "zlib-grant"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("BSD-3-Clause", "permissive", ["bsd-redistribute", "bsd-neither"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-comply"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-free", "gpl-hope"]),
    ("Apache-2.0", "permissive", ["apache-head"]),
    ("MIT", "permissive", ["mit-grant"]),
    ("MIT", "permissive", ["mit-name"]),
    ("MIT", "permissive", ["mit-ref"]),
    ("MIT", "permissive", ["mit-ref2"]),
    ("Apache-2.0", "permissive", ["apache-notice"]),
    ("Apache-2.0", "permissive", ["apache-ref"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-free"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-ref"]),
    ("BSD-2-Clause", "permissive", ["bsd-redistribute"]),
    ("CC-BY-NC-4.0", "non-commercial", ["cc-by-nc-ref"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-ref"]),
    ("CC-BY-4.0", "permissive", ["cc-by-ref"]),
    ("CC-BY-4.0", "permissive", ["cc-by-work"]),
    ("CC0-1.0", "public-domain", ["cc0"]),
    ("Unlicense", "public-domain", ["unlicense"]),
    ("MPL-2.0", "copyleft", ["mpl-form"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl-free"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("ISC", "permissive", ["isc-name"]),
    ("Zlib", "permissive", ["zlib-grant"]),
    ("EPL-1.0", "copyleft", ["epl-program"]),
    ("EPL-2.0", "copyleft", ["epl-made"]),
    ("BSL-1.0", "permissive", ["boost-ref"]),
    ("WTFPL", "public-domain", ["wtfpl"]),
    ("MIT", "permissive", ["spdx-mit"]),
    ("Apache-2.0", "permissive", ["spdx-apache"]),
    ("GPL-3.0-or-later", "copyleft", ["spdx-gpl3"]),
    ("GPL-3.0-only", "copyleft", ["spdx-gpl3-only"]),
    ("GPL-2.0-or-later", "copyleft", ["spdx-gpl2"]),
    ("GPL-2.0-only", "copyleft", ["spdx-gpl2-only"]),
    ("LGPL-2.1-or-later", "copyleft", ["spdx-lgpl21"]),
    ("AGPL-3.0-or-later", "copyleft", ["spdx-agpl3"]),
    ("BSD-3-Clause", "permissive", ["spdx-bsd3"]),
    ("BSD-2-Clause", "permissive", ["spdx-bsd2"]),
    ("ISC", "permissive", ["spdx-isc"]),
    ("MPL-2.0", "copyleft", ["spdx-mpl"]),
    ("EPL-2.0", "copyleft", ["spdx-epl"]),
    ("CC0-1.0", "public-domain", ["spdx-cc0"]),
]

#: Marks of comments at the start of a line; ends of sentences; what is no letter or digit, but for the two marks put in.
COMMENT = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|%+|<!--)[ \t]*"
BREAK = "[.!?]+[\"')\\]]*[ \\t\\r\\n\\f]+|[ \\t\\r\\f]*\\n[ \\t\\r\\f]*\\n[ \\t\\r\\n\\f]*"
LINE = r"[ \t\r\f]*\n[ \t\r\f]*"
OTHER = r"[^A-Za-z0-9\x01\x02]+"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, the empty ones left out; their lines are parted by the character 2."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, "$1")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, BREAK, "\x01"), LINE, "\x02"), OTHER, " ")
    return F.filter(F.split(F.lower(cut), "\x01"), lambda s: F.trim(s, F.lit(" \x02")) != "")


def _sequence(ids: list[str]) -> str:
    return "".join(f"|{i}|" for i in ids)


def _joined(s: Column) -> Column:
    """A sentence in one line."""
    return F.trim(F.regexp_replace(s, " *\x02 *", " "))


def license_scans(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences, identifiers (array, in order), licenses and kinds (arrays, in order of rules)."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    rules = F.array(*[F.struct(F.lit(_sequence(ids)).alias("ids"), F.lit(name).alias("license"), F.lit(kind).alias("kind")) for name, kind, ids in RULES])
    names = list(SENTENCES.values())
    found = documents.select("doc_id", sentences(F.col("text").cast("string")).alias("s"))
    # a sentence counts whole; an unknown one by its lines
    lines = lambda x: F.filter(F.transform(F.split(x, "\x02"), lambda y: F.trim(y)), lambda y: y.isin(names))
    none = F.array().cast("array<string>")
    whole = F.transform("s", lambda x: F.struct(F.when(F.contains(x, F.lit("\x02")), _joined(x)).otherwise(F.trim(x)).alias("whole"), x.alias("own")))
    known_parts = F.transform("s", lambda x: F.when(x["whole"].isin(names), F.array(x["whole"])).when(F.contains(x["own"], F.lit("\x02")), lines(x["own"])).otherwise(none))
    found = found.select("doc_id", whole.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.flatten(known_parts).alias("s"))
    found = found.select("doc_id", "n_sentences", F.transform("s", lambda x: F.element_at(known, x)).alias("identifiers"))
    start = F.struct(
        F.array_join(F.transform("identifiers", lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "").alias("left"),
        F.array().cast("array<string>").alias("licenses"), F.array().cast("array<string>").alias("kinds"),
    )
    matched = F.aggregate(
        rules,
        start,
        lambda done, r: F.when(
            F.contains(done["left"], r["ids"]),
            F.struct(
                F.replace(done["left"], r["ids"], F.lit("|#|")).alias("left"),
                F.array_union(done["licenses"], F.array(r["license"])).alias("licenses"),
                F.array_union(done["kinds"], F.array(r["kind"])).alias("kinds"),
            ),
        ).otherwise(done),
    )
    none = F.array().cast("array<string>")
    matched = F.when(F.size("identifiers") > 0, matched)
    return found.withColumn("m", matched).select(
        "doc_id", "n_sentences", "identifiers", F.coalesce("m.licenses", none).alias("licenses"), F.coalesce("m.kinds", none).alias("kinds")
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scans(K.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", F.size("identifiers").cast("long").alias("n_known"), F.array_join("identifiers", ",").alias("identifiers"),
        F.array_join("licenses", ",").alias("licenses"), F.array_join("kinds", ",").alias("kinds"),
    )


def _oracle() -> str:
    values = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    brk = BREAK.replace("'", "''")
    steps, last = [], "seq"
    for k, (name, kind, ids) in enumerate(RULES):
        r = _sequence(ids)
        hit = f"contains(rest, '{r}')"
        steps.append(
            f"r{k} as (select doc_id, rid, n_sentences, n_known, identifiers, replace(rest, '{r}', '|#|') as rest, "
            f"case when {hit} and not list_contains(licenses, '{name}') then list_append(licenses, '{name}') else licenses end as licenses, "
            f"case when {hit} and not list_contains(kinds, '{kind}') then list_append(kinds, '{kind}') else kinds end as kinds from {last})"
        )
        last = f"r{k}"
    comment, line, other = COMMENT, LINE, OTHER
    plain = rf"regexp_replace(coalesce(text, ''), '{comment}', '\1', 'g')"
    return rf"""
with known(s, id) as (values {values}),
d as (select doc_id, row_number() over () as rid, string_split(lower(regexp_replace(regexp_replace(regexp_replace({plain}, '{brk}', chr(1), 'g'), '{line}', chr(2), 'g'), '{other}', ' ', 'g')), chr(1)) as parts from documents),
s as (select doc_id, rid, list_filter(parts, lambda x: trim(x, ' ' || chr(2)) <> '') as s from d),
e as (select rid, unnest(s) as s, unnest(range(len(s))) as p from s),
w as (select rid, p, s, trim(regexp_replace(s, ' *\x02 *', ' ', 'g')) as whole from e),
kw as (select rid, p, 0 as q, id from w join known on w.whole = known.s),
kl as (select rid, p, q, id from (select rid, p, trim(unnest(string_split(s, chr(2)))) as t, unnest(range(len(string_split(s, chr(2))))) as q from w where whole not in (select s from known)) l join known on l.t = known.s),
ka as (select * from kw union all select * from kl),
k as (select rid, count(*) as n_known, string_agg(id, ',' order by p, q) as identifiers, string_agg('|' || id || '|', '' order by p, q) as rest from ka group by rid),
seq as (select doc_id, rid, len(s)::bigint as n_sentences, coalesce(n_known, 0)::bigint as n_known, coalesce(identifiers, '') as identifiers, coalesce(rest, '') as rest, []::varchar[] as licenses, []::varchar[] as kinds from s left join k using (rid)),
{", ".join(steps)}
select doc_id, n_sentences, n_known, identifiers, array_to_string(licenses, ',') as licenses, array_to_string(kinds, ',') as kinds from {last}
"""


OP3_SQL = _oracle()
