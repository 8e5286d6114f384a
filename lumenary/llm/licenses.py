"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised (A-Z lower-cased, every run of other than a-z and 0-9 one
space) and looked up among known licence sentences; the identifiers found, in their order in the text, are matched
against an ordered list of rules. A rule is a sequence of identifiers with nothing known in between; what it matches is
used up, so that a later, shorter rule doesn't match the same sentences again. All of it is column expressions.

Texts come with their lines wrapped or not, so two readings are made: one where every line end ends a sentence, one
where only a sentence mark or an empty line does. A rule that matches either reading is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_ENDS = r"[.!?;:]+[\t\r ]+|\n"
#: An empty line may begin with a comment's mark.
PARAGRAPHS = r"[.!?;:]+[\t\r\n ]+|\n[\t\r #*/;]*\n"
#: Marks within a sentence, which would end it: those of "spdx-license-identifier: x" and "v. 2.0".
INNER = r"(spdx-license-identifier|[^a-z0-9]v)[:.][\t\r\n ]+"

#: identifier: normalised sentences
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit_title": ("mit license", "the mit license", "the mit license mit"),
    "mit_ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "mit licensed"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit_as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit_liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd_as_is": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd_liable": ("in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services", "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    "bsd_loss": ("loss of use data or profits",),
    "bsd_caused": ("or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",),
    "bsd_ref": ("licensed under the bsd license", "released under the bsd license"),
    "apache_2_ref": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0", "released under the apache license version 2 0"),
    "apache_comply": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0", "you may obtain a copy of the license at"),
    "apache_as_is": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "gpl_3_ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "gpl_2_ref": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"),
    "gpl_3_later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    "gpl_2_later": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl_free": ("this program is free software",),
    "gpl_hope": ("this program is distributed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    "lgpl_ref": ("licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1"),
    "agpl_ref": ("licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"),
    "mpl_2_ref": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "cc_by_nc_ref": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc_by_sa_ref": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc_by_ref": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc0_ref": ("dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "spdx_mit": ("spdx license identifier mit",),
    "spdx_apache_2": ("spdx license identifier apache 2 0",),
    "spdx_gpl_3": ("spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0"),
    "spdx_gpl_3_later": ("spdx license identifier gpl 3 0 or later",),
    "spdx_gpl_2": ("spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0"),
    "spdx_gpl_2_later": ("spdx license identifier gpl 2 0 or later",),
    "spdx_agpl_3": ("spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"),
    "spdx_lgpl": ("spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later"),
    "spdx_bsd_2": ("spdx license identifier bsd 2 clause",),
    "spdx_bsd_3": ("spdx license identifier bsd 3 clause",),
    "spdx_isc": ("spdx license identifier isc",),
    "spdx_mpl_2": ("spdx license identifier mpl 2 0",),
    "spdx_cc0": ("spdx license identifier cc0 1 0",),
    "spdx_cc_by": ("spdx license identifier cc by 4 0",),
    "spdx_unlicense": ("spdx license identifier unlicense",),
    "reserved": ("all rights reserved",),
}

#: licence, identifiers in their order; longer rules stand before the rules that begin them
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_title", "reserved", "mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_liable", "bsd_loss", "bsd_caused")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_liable", "bsd_loss", "bsd_caused")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_2_ref", "apache_comply", "apache_copy", "apache_as_is")),
    ("Apache-2.0", ("apache_2_ref", "apache_comply")),
    ("Apache-2.0", ("apache_2_ref",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_3_later", "gpl_hope")),
    ("GPL-3.0-or-later", ("gpl_3_later",)),
    ("GPL-2.0-or-later", ("gpl_free", "gpl_2_later", "gpl_hope")),
    ("GPL-2.0-or-later", ("gpl_2_later",)),
    ("GPL-3.0", ("gpl_3_ref",)),
    ("GPL-2.0", ("gpl_2_ref",)),
    ("LGPL", ("lgpl_ref",)),
    ("AGPL-3.0", ("agpl_ref",)),
    ("MPL-2.0", ("mpl_2_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_ref",)),
    ("CC-BY-4.0", ("cc_by_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("spdx_apache_2",)),
    ("GPL-3.0", ("spdx_gpl_3",)),
    ("GPL-3.0-or-later", ("spdx_gpl_3_later",)),
    ("GPL-2.0", ("spdx_gpl_2",)),
    ("GPL-2.0-or-later", ("spdx_gpl_2_later",)),
    ("AGPL-3.0", ("spdx_agpl_3",)),
    ("LGPL", ("spdx_lgpl",)),
    ("BSD-2-Clause", ("spdx_bsd_2",)),
    ("BSD-3-Clause", ("spdx_bsd_3",)),
    ("ISC", ("spdx_isc",)),
    ("MPL-2.0", ("spdx_mpl_2",)),
    ("CC0-1.0", ("spdx_cc0",)),
    ("CC-BY-4.0", ("spdx_cc_by",)),
    ("Unlicense", ("spdx_unlicense",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_title",)),
    ("BSD", ("bsd_ref",)),
    ("Proprietary", ("reserved",)),
)

KNOWN = {s: ident for ident, texts in SENTENCES.items() for s in texts}
LICENCES = tuple(dict.fromkeys(name for name, _ in RULES))
#: Reported only where no other licence is: those begin with the same reservation.
LAST = "Proprietary"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pattern(idents: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in idents)


def identifiers(text: Column, ends: str) -> Column:
    """The identifiers of the known sentences of ``text`` in their order, as one string of <identifier>."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    cut = F.split(F.regexp_replace(F.translate(text, UPPER, LOWER), INNER, "$1 "), ends)
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.concat_ws("", F.transform(F.filter(plain, lambda s: s.isin(list(KNOWN))), lambda s: F.concat(F.lit("<"), F.element_at(known, s), F.lit(">"))))


def matched(sequence: Column) -> Column:
    """struct(rest, found): what no rule has used up, and the licences found."""
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(_pattern(idents)).alias("pattern")) for name, idents in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(
        rules,
        start,
        lambda acc, r: F.struct(
            F.replace(acc["rest"], r["pattern"], F.lit("|")).alias("rest"),
            F.when(F.contains(acc["rest"], r["pattern"]), F.array_union(acc["found"], F.array(r["licence"]))).otherwise(acc["found"]).alias("found"),
        ),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (names joined by ' + ' in the order of RULES; empty: none found), n_license_sentences (known
    sentences, of the reading that has more), n_unmatched (of them, left by every rule, of the reading that has fewer):
    one row per row of ``docs``, whose columns other than doc_id and text are not read.

    A null or empty text has no sentences. Very long texts are read whole. Repeated rows are scanned each by itself. An
    empty table gives no rows.
    """
    count = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit("")))).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    seqs = docs.select("doc_id", identifiers(text, LINE_ENDS).alias("by_line"), identifiers(text, PARAGRAPHS).alias("by_par"))
    none = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("found"))
    m = lambda c: F.when(F.col(c) == "", none).otherwise(matched(F.col(c)))
    hits = seqs.withColumns({"a": m("by_line"), "b": m("by_par")})
    found = lambda name: F.array_contains("a.found", name) | F.array_contains("b.found", name)
    alone = F.size(F.array_except(F.array_union("a.found", "b.found"), F.array(F.lit(LAST)))) == 0
    either = lambda name: found(name) & alone if name == LAST else found(name)
    return hits.select(
        "doc_id",
        F.concat_ws(" + ", *[F.when(either(name), F.lit(name)) for name in LICENCES]).alias("licenses"),
        F.greatest(count(F.col("by_line")), count(F.col("by_par"))).alias("n_license_sentences"),
        F.least(count(F.col("a.rest")), count(F.col("b.rest"))).alias("n_unmatched"),
    )


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(s)}: {q('<' + i + '>')}" for s, i in KNOWN.items()) + "}"
    ids = lambda ends: f"array_to_string(list_transform(list_filter(list_transform(string_split_regex(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {q(INNER)}, '\\1 ', 'g'), {q(ends)}), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: map_contains(k, s)), lambda s: k[s]), '')"
    parts = [f"WITH known AS (SELECT {known} AS k), s AS (SELECT doc_id, {ids(LINE_ENDS)} AS by_line, {ids(PARAGRAPHS)} AS by_par FROM documents, known), r0 AS (SELECT *, by_line AS a0, by_par AS b0 FROM s)"]
    for i, (_, idents) in enumerate(RULES):
        p = q(_pattern(idents))
        parts.append(f"r{i + 1} AS (SELECT *, contains(a{i}, {p}) OR contains(b{i}, {p}) AS m{i}, replace(a{i}, {p}, '|') AS a{i + 1}, replace(b{i}, {p}, '|') AS b{i + 1} FROM r{i})")
    n = len(RULES)
    any_of = lambda test: reduce(lambda x, y: f"{x} OR {y}", [f"m{i}" for i, (x, _) in enumerate(RULES) if test(x)])
    hit = lambda name: f"({any_of(lambda x: x == name)})" + (f" AND NOT ({any_of(lambda x: x != name)})" if name == LAST else "")
    names = ", ".join(f"CASE WHEN {hit(name)} THEN {q(name)} END" for name in LICENCES)
    count = lambda c: f"(length({c}) - length(replace({c}, '<', '')))::BIGINT"
    return ", ".join(parts) + f" SELECT doc_id, concat_ws(' + ', {names}) AS licenses, greatest({count('by_line')}, {count('by_par')}) AS n_license_sentences, least({count(f'a{n}')}, {count(f'b{n}')}) AS n_unmatched FROM r{n}"


SQL = _sql()
