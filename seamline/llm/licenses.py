"""License scans by sentence rules (DataFrame operations only).

A text is normalised and searched for known licence sentences, which stand between end marks and line
ends but may themselves be wrapped over lines; besides those of a table, "licensed under" and the like
with any of the licences' names are known. The
identifiers of those found, in order of the text, form a sequence; ordered rules are matched against it,
longer ones first, and a rule uses up the identifiers it matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.session import texts

#: Normalised sentences of public licence texts and notices, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "the mit license": "mit-name",
    "mit license": "mit-name",
    "the mit license mit": "mit-name",
    "spdx license identifier mit": "mit-spdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "released under the apache license version 2 0": "apache2-ref",
    "apache license version 2 0": "apache2-name",
    "spdx license identifier apache 2 0": "apache2-spdx",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-obtain",
    "http www apache org licenses license 2 0": "apache2-url",
    "https www apache org licenses license 2 0": "apache2-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "released under the bsd 3 clause license": "bsd3-ref",
    "spdx license identifier bsd 3 clause": "bsd3-spdx",
    "spdx license identifier bsd 2 clause": "bsd2-spdx",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 2 of the license or at your option any later version": "gpl-2plus",
    "either version 3 of the license or at your option any later version": "gpl-3plus",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "released under the gnu general public license version 3": "gpl3-ref",
    "spdx license identifier gpl 3 0 only": "gpl3-spdx",
    "spdx license identifier gpl 3 0 or later": "gpl3plus-spdx",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-ref",
    "licensed under cc by 4 0": "cc-by-4-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "all rights reserved": "reserved",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
}
#: Licences by the names that references use (normalised); the first letters of a name's identifiers are the key.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit", "expat license", "mit expat license"),
    "Apache-2.0": (
        "apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache licence version 2 0", "apache software license version 2 0",
        "apache 2 0 license", "apache 2 0", "apache license version 2", "apache 2 license", "apache v2 0 license", "apache v2 license",
    ),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "bsd 2 clause", "simplified bsd license", "freebsd license", "two clause bsd license"),
    "BSD-3-Clause": (
        "bsd 3 clause license", "3 clause bsd license", "bsd 3 clause", "new bsd license", "modified bsd license", "revised bsd license", "three clause bsd license",
        "bsd 3 clause new or revised license",
    ),
    "BSD": ("bsd license", "bsd licence", "bsd style license"),
    "ISC": ("isc license", "isc licence", "isc"),
    "0BSD": ("zero clause bsd license", "bsd zero clause license", "0bsd license", "0bsd"),
    "Zlib": ("zlib license", "zlib libpng license"),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "boost software license"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl v2 0", "mplv2"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "epl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"),
    "CDDL-1.0": ("common development and distribution license version 1 0", "common development and distribution license 1 0", "cddl 1 0"),
    "WTFPL": ("do what the fuck you want to public license", "wtfpl"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "PSF-2.0": ("python software foundation license version 2", "python software foundation license", "psf license"),
    "CC0-1.0": ("creative commons zero v1 0 universal", "creative commons cc0 1 0 universal license", "cc0 1 0 universal", "cc0 1 0", "cc0"),
}
for _family, _long, _short in (("GPL", "gnu general public license", "gpl"), ("LGPL", "gnu lesser general public license", "lgpl"), ("AGPL", "gnu affero general public license", "agpl")):
    NAMES[_family] = (_long, f"gnu {_short}", _short, f"{_short} license", _long.replace("license", "licence"))
    for _v in {"GPL": ("2", "3"), "LGPL": ("2 1", "3"), "AGPL": ("3",)}[_family]:
        _exact = tuple(
            name
            for v in dict.fromkeys((_v, _v if " " in _v else f"{_v} 0"))
            for name in (
                f"{_long} version {v}", f"{_long} v{v}", f"{_long} {v}", f"version {v} of the {_long}", f"gnu {_short} version {v}", f"gnu {_short} v{v}",
                f"gnu {_short} {v}", f"{_short} version {v}", f"{_short} v{v}", f"{_short} {v}", f"{_short}v{v}", f"gnu {_short}v{v}",
            )
        )
        _code = _v.replace(" ", ".") if " " in _v else f"{_v}.0"
        NAMES[f"{_family}-{_code}-only"] = _exact + tuple(f"{n} only" for n in _exact)
        NAMES[f"{_family}-{_code}-or-later"] = tuple(f"{n} {more}" for n in _exact for more in ("or later", "or any later version", "or at your option any later version", "or newer"))
for _code, _long in (
    ("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"),
    ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"),
):
    for _v in ("2.0", "3.0", "4.0"):
        _n, _short = _v.replace(".", " "), "cc " + _code.lower().replace("-", " ")
        _spelt = dict.fromkeys((_long, _long.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives"), _long.replace("noderivatives", "noderivs")))
        NAMES[f"CC-{_code}-{_v}"] = (
            *(f"{_short} {_n}{end}" for end in ("", " license", " international", " international license")),
            *(f"creative commons {x} {_n}{end}" for x in _spelt for end in ("", " license", " international", " international license", " international public license", " unported license")),
            f"creative commons {_code.lower().replace('-', ' ')} {_n}", f"creative commons {_code.lower().replace('-', ' ')} {_n} license",
        )
#: How a reference begins; the name of the licence follows, perhaps after an article.
VERBS = tuple(f"{verb} under{terms}" for verb in ("licensed", "licenced", "released", "distributed", "published", "available", "made available", "provided", "dual licensed") for terms in ("", " the terms of"))
SUBJECTS = ("", *(f"{which} {what} is " for which in ("this", "the") for what in ("work", "project", "file", "code", "source code", "software", "program", "library", "package", "repository", "document", "module")))
LEADS = tuple(f"{who}{verb} {the}" for who in SUBJECTS for verb in (*VERBS, "subject to the terms of", "covered by") for the in ("", "the ", "a ", "an ")) + ("license ", "licence ")
SPDX = "spdx license identifier "
#: Beginnings of identifiers; other licences have their own name.
STEMS = {"MIT": "mit", "Apache-2.0": "apache2", "BSD-2-Clause": "bsd2", "BSD-3-Clause": "bsd3", "GPL-3.0-only": "gpl3", "GPL-3.0-or-later": "gpl3plus", "CC-BY-4.0": "cc-by-4", "MPL-2.0": "mpl2"}
#: Families, which have no version and no SPDX identifier.
FAMILIES = ("BSD", "GPL", "LGPL", "AGPL")


def stem(licence: str) -> str:
    return STEMS.get(licence, licence.lower())


def plain(words: str) -> str:
    return re.sub("[^a-z0-9]+", " ", words.lower())


#: Beginnings of identifiers by name, by names that may stand alone, and by SPDX identifier.
BY_NAME = {n: stem(licence) for licence, names in NAMES.items() for n in names}
ALONE = {the + n: stem(licence) for licence, names in NAMES.items() if licence not in FAMILIES for n in names if " " in n for the in ("", "the ")}
BY_SPDX = {plain(licence): stem(licence) for licence in NAMES if licence not in FAMILIES}
#: The usual references are sentences of the table; others are put together from lead and name.
for _licence, _names in NAMES.items():
    for _name in _names[:2]:
        for _lead in ("licensed under ", "released under ", "this work is licensed under ", "this project is licensed under ", "this file is licensed under ", "this software is licensed under "):
            for _the in ("", "the "):
                SENTENCES.setdefault(f"{_lead}{_the}{_name}", f"{stem(_licence)}-ref")
for _long, _stem in (("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl")):
    _terms = f"you can redistribute it and or modify it under the terms of the {_long} as published by the free software foundation"
    SENTENCES.setdefault(_terms, f"{_stem}-terms")
    for _v in ("2", "2 1", "3"):
        SENTENCES[f"{_terms} either version {_v} of the license or at your option any later version"] = f"{_stem}-terms-{_v.replace(' ', '.')}plus"
SENTENCES["either version 2 1 of the license or at your option any later version"] = "gpl-2.1plus"
for _what in ("library", "file", "software"):
    SENTENCES[f"this {_what} is free software"] = "gpl-free"
    SENTENCES[f"this {_what} is distributed in the hope that it will be useful but without any warranty"] = "gpl-hope"
for _who in ("author", "university", "organization", "company", "project"):
    SENTENCES[f"neither the name of the {_who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"] = "bsd-endorse"
#: Ordered rules: the licence and the identifiers that name it, adjacent in the sequence.
RULES = (
    ("MIT", "mit-name mit-grant mit-notice mit-warranty mit-liability"),
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("Apache-2.0", "apache2-ref apache2-compliance apache2-obtain apache2-url apache2-warranty apache2-see"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-warranty"),
    ("GPL-2.0-or-later", "gpl-free gpl-terms gpl-2plus"),
    ("GPL-3.0-or-later", "gpl-free gpl-terms gpl-3plus"),
    ("Apache-2.0", "apache2-ref apache2-compliance"),
    ("MIT", "mit-grant mit-notice"),
    ("GPL-2.0-or-later", "gpl-terms-2plus"),
    ("GPL-3.0-or-later", "gpl-terms-3plus"),
    ("LGPL-2.1-or-later", "lgpl-terms gpl-2.1plus"),
    ("LGPL-3.0-or-later", "lgpl-terms gpl-3plus"),
    ("LGPL-2.1-or-later", "lgpl-terms-2.1plus"),
    ("LGPL-3.0-or-later", "lgpl-terms-3plus"),
    ("AGPL-3.0-or-later", "agpl-terms gpl-3plus"),
    ("AGPL-3.0-or-later", "agpl-terms-3plus"),
    ("ISC", "isc-grant"),
    ("0BSD", "0bsd-grant"),
    ("Unlicense", "unlicense-grant"),
    ("MIT", "mit-spdx"),
    ("Apache-2.0", "apache2-spdx"),
    ("BSD-3-Clause", "bsd3-spdx"),
    ("BSD-2-Clause", "bsd2-spdx"),
    ("GPL-3.0-only", "gpl3-spdx"),
    ("GPL-3.0-or-later", "gpl3plus-spdx"),
    ("MIT", "mit-ref"),
    ("Apache-2.0", "apache2-ref"),
    ("BSD-3-Clause", "bsd3-ref"),
    ("GPL-3.0-only", "gpl3-ref"),
    ("CC-BY-4.0", "cc-by-4-ref"),
    ("MPL-2.0", "mpl2-ref"),
    ("MIT", "mit-name"),
    ("Apache-2.0", "apache2-name"),
    *((licence, f"{stem(licence)}-{kind}") for licence in NAMES for kind in ("spdx", "ref", "name") if licence not in ("MIT", "Apache-2.0")),
    ("Proprietary", "reserved"),
)
#: Some word of every known sentence; texts without any are not cut.
WORDS = "licen|copyright|permission|warrant|redistribut|liable|rights[^a-z0-9]+reserved|free[^a-z0-9]+(?:software|and)|under[^a-z0-9]|covered by|terms of|apache|bsd|gpl|cc0|mpl|epl|cddl|creative"
NOT_WORD = "[^a-z0-9]+"
#: Stands for an end mark with the blanks or the line end after it. A sentence runs over single line ends only.
END = "\x01"
#: Comment leaders that are words.
LEADER = r"(?m)^[ \t]*(?:dnl|rem|REM)[ \t]"


def one_of(sentences: Iterable[str]) -> str:
    """A pattern of the sentences, each as one alternative of a tree of their words, longest first."""
    tree: dict = {}
    for s in sentences:
        node = tree
        for w in s.split():
            node = node.setdefault(w, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        """What may follow a word, gap included."""
        some = []
        for w, below in node.items():
            if w:
                while len(below) == 1 and "" not in below:
                    ((following, below),) = below.items()
                    w = f"{w}[ \n]{following}"
                some.append(w + pattern(below))
        if not some:
            return ""
        inner = some[0] if len(some) == 1 else f"(?:{'|'.join(some)})"
        return f"(?:[ \n]{inner}){'?' if '' in node else ''}"

    return pattern(tree).removeprefix("(?:[ \n]").removesuffix(")")


def known_pattern() -> str:
    """Every known sentence, between ends of lines or sentences. The names after "License:" may follow an end mark."""
    after = f"(?:spdx[ \n]license[ \n]identifier)[ {END}](?:{one_of(BY_SPDX)})"
    named = f"licen[sc]e{END}(?:{one_of(BY_NAME)})"
    reference = f"(?:{one_of(LEADS)})[ \n](?:{one_of(BY_NAME)})"
    bound = rf"[^\n{END}]"
    return f"(?<!{bound})(?:{'|'.join((after, named, one_of(SENTENCES), reference, one_of(ALONE)))})(?!{bound})"


def sentences(text: Column) -> Column:
    """Known sentences of the text in order, words apart by one blank; a hard-wrapped sentence is one sentence."""
    marked = F.regexp_replace(F.regexp_replace(F.translate(text, END, "-"), LEADER, ""), r"[.;:!?](?:[ \t]+|[ \t\r]*\n)", END)
    words = F.regexp_replace(F.lower(marked), f"[^a-z0-9\n{END}]+", " ")
    words = F.regexp_replace(words, f" ?([\n{END}]) ?", "$1")
    words = F.regexp_replace(words, "^ | $", "")
    return F.transform(F.regexp_extract_all(words, F.lit(known_pattern()), F.lit(0)), lambda s: F.regexp_replace(s, f"[ \n{END}]", " "))


def literal_map(values: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in values.items())), F.lit("\n"), F.lit("\t"))


def identifier(sentence: Column) -> Column:
    """The identifier of a known sentence: its own, or that of the licence it names."""
    name = F.regexp_replace(sentence, f"^(?:{one_of(LEADS)}) ".replace("[ \n]", " "), "")
    spdx = F.when(F.startswith(sentence, F.lit(SPDX)), F.concat(F.try_element_at(literal_map(BY_SPDX), F.substr(sentence, F.lit(len(SPDX) + 1))), F.lit("-spdx")))
    return F.coalesce(
        F.try_element_at(literal_map(SENTENCES), sentence), spdx,
        F.concat(F.try_element_at(literal_map(ALONE), sentence), F.lit("-name")), F.concat(F.try_element_at(literal_map(BY_NAME), name), F.lit("-ref")),
    )


def scan_licenses(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_sentences (known ones), sentence_ids in order, licenses (each once, in order of the rules).

    A null or empty text has none. Repeated rows stay; other columns of ``df`` are not looked at.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    ids = F.filter(F.transform(sentences(t), identifier), lambda i: i.isNotNull())
    ids = F.when(F.lower(t).rlike(WORDS), ids).otherwise(F.array().cast("array<string>"))
    rows = df.select(F.col(key), ids.alias("ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {' '.join(f'<{i}>' for i in seq.split())} ").alias("seq")) for name, seq in RULES])
    # each identifier stands between blanks of its own, so that adjacent matches do not share one
    sequence = F.concat(F.lit(" "), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), " "), F.lit(" "))
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["seq"], F.lit(" # "))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_union(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    found = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)["found"]).otherwise(F.array().cast("array<string>"))
    return rows.select(
        key, F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join(found, ",").alias("licenses")
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return scan_licenses(texts(spark, sf_dir), "doc_id", "text")


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps = ["s0 AS (SELECT doc_id, n, ids, seq AS rest, [] :: VARCHAR[] AS found FROM seqs)"]
    for k, (name, seq) in enumerate(RULES, 1):
        mark = f" {' '.join(f'<{i}>' for i in seq.split())} "
        steps.append(
            f"s{k} AS (SELECT doc_id, n, ids, replace(rest, '{mark}', ' # ') AS rest, CASE WHEN contains(rest, '{mark}') AND NOT "
            f"list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM s{k - 1})"
        )
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
lines AS (SELECT doc_id, string_split(regexp_replace(text, '[.;:!?][ \\t]+', chr(10), 'g'), chr(10)) AS l FROM documents),
pieces AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM lines),
cut AS (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM pieces),
hits AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY i) AS ids, string_agg('<' || id || '>', ' ' ORDER BY i) AS tagged
  FROM cut JOIN known USING (sentence) GROUP BY doc_id),
seqs AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, ' ' || coalesce(tagged, '') || ' ' AS seq
  FROM documents LEFT JOIN hits USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, ids AS sentence_ids, array_to_string(found, ',') AS licenses FROM s{len(RULES)}
"""


SQL = _sql()
