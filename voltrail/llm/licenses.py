"""Licence scan by sentences: known sentences become identifiers, and sequences of identifiers match ordered rules.

A text is cut into sentences at line ends and behind `.`, `!`, `?` or `;` before white space. A sentence is lower-cased,
everything but letters and digits becomes one blank, and the result is looked up among the known sentences. A known
sentence may also be wrapped over several lines, behind comment marks, or hold a `;`: such pieces are looked up together,
as long as none is blank or ends in `.`, `!` or `?`; the sentence has the number of its first piece, and one that is part
of a longer one does not count. The SQL knows sentences of one piece only. The
identifiers of a text's known sentences, in order, are then searched for each rule's sequence; unknown sentences between
them do not matter. Everything is column expressions on one row, so no row meets another and nothing is shuffled.

Defined results: null or empty text has no sentence and no licence. A text of any length is scanned whole. Repeated rows
give repeated rows. Repeated sentences repeat their identifier; a licence is reported once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentences of public licence texts and notices, each under an identifier.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction including without "
                 "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
                 "software and to permit persons to whom the software is furnished to do so subject to the following "
                 "conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not "
                    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache2-under": "licensed under the apache license version 2 0",
    "apache2-the-license": "licensed under the apache license version 2 0 the license",
    "apache2-not-use": "you may not use this file except in compliance with the license",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is "
                     "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-program": "this program is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation either version 3 of the license or at your "
                "option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the "
                "implied warranty of merchantability or fitness for a particular purpose",
    "lgpl21-work": "this library is licensed under the gnu lesser general public license version 2 1",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided "
                 "that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
                  "the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                "promote products derived from this software without specific prior written permission",
    "ccby4-under": "licensed under cc by 4 0",
    "ccby4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-under": "licensed under cc by sa 4 0",
    "ccbync4-under": "licensed under cc by nc 4 0",
    "ccbyncnd4-under": "licensed under cc by nc nd 4 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}

# Rules in order of preference: a licence and the sequence of identifiers that shows it.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache2-the-license", "apache2-not-use", "apache2-as-is")),
    ("Apache-2.0", ("apache2-the-license",)),
    ("Apache-2.0", ("apache2-under",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-program",)),
    ("GPL-2.0-only", ("gpl2-work",)),
    ("LGPL-2.1-only", ("lgpl21-work",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("ccby4-under",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-SA-4.0", ("ccbysa4-under",)),
    ("CC-BY-NC-4.0", ("ccbync4-under",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4-under",)),
    ("Unlicense", ("unlicense-free",)),
    ("all-rights-reserved", ("all-rights",)),
]

#: Every known sentence holds one of these, so a text without them needs no cutting.
CUES = ("licen", "permission", "copyright", "warrant", "redistribut", "unencumbered", "reserved", "contributors")
# Ends of known sentences, and the most pieces that one can have: a word each.
LAST_WORDS = sorted({x.split()[-1] for x in SENTENCES.values()})
MOST_PIECES = max(len(x.split()) for x in SENTENCES.values())
BOUNDARY = r"\n|(?<=[.!?;])[\x20\x09-\x0D]+"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def _wrapped(cut: Column, known: Column) -> Column:
    """at, to and id of the known sentences that are several pieces of a text."""
    # A piece that does not go on from the one before starts with a bar, so no known sentence holds it further back.
    pieces = F.transform(cut, lambda s, i: F.concat(
        F.when((i > 0) & ~F.coalesce(F.get(cut, i - 1).rlike(r"[.!?]\s*\z"), F.lit(False)) & (normalised(s) != ""), "").otherwise("|"),
        normalised(s)))
    none = F.array().cast("array<struct<at:int,to:int,id:string>>")

    def ending(all_: Column, piece: Column, j: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.least(j, F.lit(MOST_PIECES - 1))), lambda k: F.struct(
            (j - k).cast("int").alias("at"), j.cast("int").alias("to"),
            F.try_element_at(known, F.ltrim(F.array_join(F.slice(all_, j - k + 1, k + 1), " "), F.lit("|"))).alias("id")))
        ends = (j > 0) & piece.rlike(rf"^(?:[^|].*)?\b(?:{'|'.join(LAST_WORDS)})\z")
        return F.when(ends, F.filter(runs, lambda x: x["id"].isNotNull())).otherwise(none)

    return F.flatten(F.flatten(F.transform(F.array(pieces), lambda all_: F.transform(all_, lambda s, j: ending(all_, s, j)))))


def _is_sequence(ids: Column, rule: tuple[str, ...]) -> Column:
    """The rule's identifiers stand next to each other, in order, among the text's identifiers."""
    joined = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    return F.contains(joined, F.lit("|" + "|".join(rule) + "|"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_known long, sentence_ids, first_at long (sentence number, from 0) and licenses, comma-joined.

    Of rules that overlap, the earlier one speaks: the four-sentence BSD rule hides the three-sentence one.
    """
    text = F.col(text_col)
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, name)])
    cued = F.lower(text).rlike("|".join(CUES))
    rows = docs.select(F.col(id_col), F.when(cued, F.split(text, BOUNDARY, -1)).alias("cut"))
    single = F.transform("cut", lambda s, i: F.struct(
        i.alias("at"), i.alias("to"), F.try_element_at(known, normalised(s)).alias("id")))
    rows = rows.withColumn("wrapped", _wrapped(F.col("cut"), known)).withColumn(
        "found", F.concat(F.filter(single, lambda x: x["id"].isNotNull()), F.col("wrapped")))
    part = lambda x: F.exists(
        "wrapped", lambda y: (y["at"] <= x["at"]) & (y["to"] >= x["to"]) & (y["to"] - y["at"] > x["to"] - x["at"]))
    rows = rows.withColumn("found", F.array_sort(F.filter("found", lambda x: ~part(x)))).withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<at:int,to:int,id:string>>")))
    ids = F.transform("found", lambda x: x["id"])
    hits, seen = [], {}
    for licence, rule in RULES:
        hidden = F.lit(False)
        for other, longer in seen.items():
            if other[0] != licence and set(rule) <= set(longer):
                hidden = hidden | _is_sequence(F.col("ids"), longer)
        hits.append(F.when(_is_sequence(F.col("ids"), rule) & ~hidden, F.lit(licence)))
        seen[(licence, rule)] = rule
    return rows.withColumn("ids", ids).select(
        F.col(id_col), F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"),
        F.try_element_at(F.transform("found", lambda x: x["at"]), F.lit(1)).cast("long").alias("first_at"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",").alias("licenses"),
    )


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in row) + ")" for row in rows)


SQL = f"""WITH known(words, id) AS (VALUES {_values([(w, n) for n, w in SENTENCES.items()])}),
rules(nr, licence, ids) AS (VALUES {", ".join(f"({i}, '{l}', '|{'|'.join(r)}|')" for i, (l, r) in enumerate(RULES))}),
cut AS (
  SELECT r, doc_id, generate_subscripts(s, 1) - 1 AS nr, unnest(s) AS sentence
  FROM (SELECT row_number() OVER () AS r, doc_id,
               string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'),
                                  '\\n') AS s FROM documents)),
found AS (
  SELECT r, nr, id FROM (SELECT *, trim(regexp_replace(lower(sentence), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS words FROM cut)
  JOIN known USING (words)),
texts AS (
  SELECT r, any_value(doc_id) AS doc_id, count(id) AS n_known, coalesce(string_agg(id, ',' ORDER BY nr), '') AS sentence_ids,
         min(CASE WHEN id IS NOT NULL THEN nr END) AS first_at,
         '|' || coalesce(string_agg(id, '|' ORDER BY nr), '') || '|' AS seq
  FROM cut LEFT JOIN found USING (r, nr) GROUP BY r),
hits AS (
  SELECT DISTINCT r, licence FROM texts JOIN rules ON contains(seq, ids)
  WHERE NOT (licence = 'BSD-2-Clause' AND contains(seq, '|bsd-grant|bsd-source|bsd-binary|bsd-name|')))
SELECT doc_id, n_known, sentence_ids, CAST(first_at AS BIGINT) AS first_at,
       coalesce((SELECT string_agg(licence, ',' ORDER BY licence) FROM hits h WHERE h.r = t.r), '') AS licenses
FROM texts t"""
