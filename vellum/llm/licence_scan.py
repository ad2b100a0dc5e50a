"""Licence scans by recognition of sentences.

A text's sentences are normalised (letters of ASCII to lower case, no quotes, everything but letters, digits and a few signs to one space) and mapped to identifiers of known licence sentences. The ordered
rules then go over the sequence of identifiers: a rule whose pattern occurs names its licence and takes the identifiers it matched away, so later, weaker rules see only what is left.
Sentences are read from paragraphs, in which line ends are spaces, and from single lines; what only lines give comes behind what paragraphs give, in the lines' order, repeats included.
Only sentences with a part that all known sentences have one of (CUES) are compared with the table, and only texts that have one are cut into sentences, which leaves none out. All of it is DataFrame expressions in the document's row; nothing is shuffled.

Null and empty texts have no sentences and no licences. Repeated rows are scanned one by one. An empty table gives an empty result.
A very long text is read whole, in its row. Columns of any other name, those of the results too, are left out of reports and carried through where whole rows are returned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import table

#: Of what every sentence below has one, each in one word, as words may stand on two lines: tests draw sentences from the table and look for it. Nothing without it can be a known sentence.
CUES = "licen[sc]|copyright|permission|warrant|liab|redistribut|software|domain|commons|(?:^|[^a-z0-9])cc0?|spdx|gpl|gnu|applicable|endorse|\\(c\\)|rights"
_COMMENT = r"(?m)^[ \t]*(?:#+|//+|\*+|;+|--+|/\*+|<!--)?[ \t]*"

_BY = "(?:this (?:work|file|software|program|code|document|text|project) is )?(?:released|licen[sc]ed|distributed|available|published|made available|provided)"
_UNDER = f"{_BY} under (?:the terms of )?(?:the |a |an )?"
_GNU = "this (?:program|library|file|software) is free software (?:you can|you may) redistribute it and/or modify it under the terms of {of}the gnu {kind}general public license {behind}as published by the free software foundation"
_GNU_KINDS = {"GPL": "", "LGPL": "(?:lesser|library) ", "AGPL": "affero "}
_GNU_NAMES = {"GPL": "(?:gnu general public licen[sc]e|gnu gpl|gpl)", "LGPL": "(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl)", "AGPL": "(?:gnu affero general public licen[sc]e|gnu agpl|agpl)"}
_CC = {"BY": "attribution", "BY-SA": "attribution-sharealike", "BY-NC": "attribution-noncommercial", "BY-ND": "attribution-noderivs", "BY-NC-SA": "attribution-noncommercial-sharealike", "BY-NC-ND": "attribution-noncommercial-noderivs"}


def _sentences() -> list[tuple[str, str]]:
    """(identifier, pattern of a whole normalised sentence), the first that fits counts."""
    out = [
        ("SpdxMIT", "spdx-license-identifier mit"), ("SpdxApache2", "spdx-license-identifier apache-2.0"), ("SpdxBSD3", "spdx-license-identifier bsd-3-clause"), ("SpdxBSD2", "spdx-license-identifier bsd-2-clause"),
        ("SpdxMPL2", "spdx-license-identifier mpl-2.0"), ("SpdxISC", "spdx-license-identifier isc"),
        *((f"Spdx{k}{v}{plus}", f"spdx-license-identifier {k.lower()}-{v}(?:.{'1' if (k, v) == ('LGPL', '2') else '0'})?{end}") for k in _GNU_NAMES for v in "23" for plus, end in (("plus", "(?:\\+|-or-later)"), ("", "(?:-only)?"))),
        ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:\\(the software\\) )?to deal in the software without restriction .*"),
        ("MITNotice", "the above copyright notice and this permission notice (?:\\(including the next paragraph\\) )?shall be included in all copies or substantial portions of the software"),
        ("AsIs", "(?:the|this) software is provided (?:by .* )?as is (?:and .*|,? ?without warranty of any kind.*)"), ("NoLiability", "in no event shall .* be liable .*"),
        ("MITRef", f"{_UNDER}mit licen[sc]e"), ("MITName", "(?:the )?mit licen[sc]e(?: \\(mit\\))?"),
        ("Apache2Ref", f"{_UNDER}apache licen[sc]e,? (?:version |v)?2.0(?: \\(the license\\))?"), ("Apache2Name", "apache licen[sc]e,? (?:version |v)?2.0.*"),
        ("ApacheUse", "(?:you|and you) may not use this (?:file|work|software) except in compliance with the license"), ("ApacheCopy", "you may obtain a copy of the license at.*"),
        ("ApacheUnless", "unless required by applicable law or agreed to in writing,? .*"), ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
        ("BSDRedist", "redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met(?: 1)?"),
        ("BSDSource", "(?:[1a]\\.? )?redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer"),
        ("BSDBinary", "(?:[2b]\\.? )?redistributions in binary form must reproduce the above copyright notice .*"), ("BSDNames", "(?:[3c]\\.? )?neither the names? .* may be used to endorse or promote products .*"),
        ("BSD3Ref", f"{_UNDER}(?:new |revised |modified |3-clause |bsd 3-clause )(?:bsd )?licen[sc]e"), ("BSD2Ref", f"{_UNDER}(?:simplified |2-clause |bsd 2-clause )(?:bsd )?licen[sc]e"), ("BSDRef", f"{_UNDER}bsd(?:-style)? licen[sc]e"),
    ]
    for kind, word in _GNU_KINDS.items():
        for v in "23":
            number = f"{v}(?:.[01])?"
            plain = _GNU.format(of="", behind="", kind=word)
            stated = "(?:" + _GNU.format(of=f"version {number} of ", behind="", kind=word) + "|" + _GNU.format(of="", behind=f"version {number} ", kind=word) + ")"
            later = ",? (?:\\(at your option\\)|or at your option|or) any later version"
            out += [(f"{kind}{v}plus", f"{plain},? (?:either )?version {number}(?: of the license)?,?(?: or)?{later}"), (f"{kind}{v}only", f"(?:{plain},? version {number}.*|{stated}.*)")]
            name = _GNU_NAMES[kind]
            out += [(f"{kind}{v}plusRef", f"{_UNDER}{name},? (?:version |v\\.? ?)?{number},? or (?:any )?later(?: version)?"), (f"{kind}{v}Ref", f"{_UNDER}{name},? ?(?:version |v\\.? ?)?{number}(?: only)?")]
        out += [(f"{kind}Ref", f"{_UNDER}{_GNU_NAMES[kind]}")]
    out += [("GNUNoWarranty", "this (?:program|library|file|software) is distributed in the hope that it will be useful,? but without any warranty.*"), ("GNUSee", "see the gnu (?:lesser |library |affero )?general public license for more details"), ("GNUCopy", "you should have received a copy of the gnu .*")]
    for kind, words in reversed(_CC.items()):
        for v in ("4.0", "3.0", "2.5", "2.0"):
            out.append((f"CC-{kind}-{v}", f"{_UNDER}(?:cc[ -]{kind.lower()}[ -]{v}|creative commons {words}s?(?: {v}| international| unported| generic| licen[sc]e)* {v}(?: international| unported| generic)*|creative commons {words}s? {v})(?: licen[sc]e)?"))
    out += [
        ("CC0", f"(?:{_UNDER}(?:cc0|creative commons zero).*|to the extent possible under law,? .* waived all copyright .*)"), ("PublicDomain", "(?:this (?:work|file|software|text|book|ebook) is (?:hereby )?(?:released into|placed in|in|dedicated to) the public domain|this is free and unencumbered software released into the public domain)"),
        ("UnlicenseUse", "anyone is free to copy,? modify,? publish,? use,? compile,? sell,? or distribute this software.*"), ("MPL2", "this source code form is subject to the terms of the mozilla public licen[sc]e,? (?:version |v\\. ?)?2.0"), ("MPL2Ref", f"{_UNDER}mozilla public licen[sc]e,? (?:version |v\\.? ?)?2.0"),
        ("ISCGrant", "permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice and this permission notice appear in all copies"), ("ISCRef", f"{_UNDER}isc licen[sc]e"),
        ("ZlibUse", "permission is granted to anyone to use this software for any purpose,? including commercial applications,? and to alter it and redistribute it freely.*"), ("ZlibRef", f"{_UNDER}zlib(?:/libpng)? licen[sc]e"), ("EPL2Ref", f"{_UNDER}eclipse public licen[sc]e,? (?:version |v\\.? ?)?2.0"),
        ("AllRights", "all rights reserved"), ("Copyright", "(?:copyright|\\(c\\)) .*"),
    ]
    return out


def _rules() -> list[tuple[str, str]]:
    """(licence, pattern over identifiers that have a space before and a semicolon behind), in order."""
    out = [
        ("Apache-2.0", "(?:Apache2Ref|Apache2Name);(?:(?:ApacheUse|ApacheCopy|ApacheUnless|ApacheSee);)*"), ("Apache-2.0", "SpdxApache2;"),
        ("MIT", "(?:MITName;)?(?:Copyright;|AllRights;)*MITGrant;MITNotice;(?:AsIs;)?(?:NoLiability;)?"), ("MIT", "SpdxMIT;"), ("MIT", "MITRef;"), ("MIT", "MITName;"),
        ("BSD-3-Clause", "BSDRedist;BSDSource;BSDBinary;BSDNames;(?:AsIs;)?(?:NoLiability;)?"), ("BSD-2-Clause", "BSDRedist;BSDSource;BSDBinary;(?:AsIs;)?(?:NoLiability;)?"), ("BSD-3-Clause", "(?:BSD3Ref|SpdxBSD3);"), ("BSD-2-Clause", "(?:BSD2Ref|SpdxBSD2);"), ("BSD", "BSDRef;"),
    ]
    tail = "(?:(?:GNUNoWarranty|GNUSee|GNUCopy);)*"
    for kind in ("AGPL", "LGPL", "GPL"):
        for v in "32":
            number = "2.1" if (kind, v) == ("LGPL", "2") else f"{v}.0"
            out += [(f"{kind}-{number}-or-later", f"(?:{kind}{v}plus|{kind}{v}plusRef|Spdx{kind}{v}plus);{tail}"), (f"{kind}-{number}-only", f"(?:{kind}{v}only|{kind}{v}Ref|Spdx{kind}{v});{tail}")]
        out.append((kind, f"{kind}Ref;{tail}"))
    out += [(f"CC-{kind}-{v}", f"CC-{kind}-{v};") for kind in _CC for v in ("4.0", "3.0", "2.5", "2.0")]
    out += [("CC0-1.0", "CC0;"), ("Unlicense", "PublicDomain;UnlicenseUse;(?:AsIs;)?(?:NoLiability;)?"), ("Public-Domain", "PublicDomain;"), ("MPL-2.0", "(?:MPL2|MPL2Ref|SpdxMPL2);"), ("ISC", "(?:Copyright;)?ISCGrant;(?:AsIs;)?(?:NoLiability;)?"), ("ISC", "(?:ISCRef|SpdxISC);"), ("Zlib", "(?:AsIs;)?ZlibUse;"), ("Zlib", "ZlibRef;"), ("EPL-2.0", "EPL2Ref;")]
    return [(name, re.sub("[A-Z][A-Za-z0-9.-]*", r" \g<0>", pattern)) for name, pattern in out]


SENTENCES, RULES = _sentences(), _rules()


def _low(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\"'", "abcdefghijklmnopqrstuvwxyz")


def _normal(low: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(low, "[^a-z0-9.,()/+-]+", " ")), "^[ .,/+-]+|[ .,/-]+$", ""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences and n_unruled (identifiers that no rule took) of each row of documents (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, _COMMENT, "")
    flat = F.regexp_replace(F.regexp_replace(bare, "\\n[ \\t]*\\n", "\u2029"), "\\n", " ")
    empty = F.array().cast("array<string>")
    cue = _low(flat).rlike(CUES)
    marked = docs.select("doc_id", F.when(cue, F.split(flat, "[.;!?]+[ \u2029]+|\u2029")).otherwise(empty).alias("paragraphs"), F.when(cue, F.split(bare, "\\n|[.;!?]+ +")).otherwise(empty).alias("lines"))

    def kept(c: str) -> Column:
        return F.filter(F.transform(F.filter(F.transform(c, _low), lambda s: s.rlike(CUES)), _normal), lambda s: s != "")

    def named(c: str) -> Column:
        # Literal patterns are compiled once; the first that fits ends the search.
        first = F.transform(c, lambda s: F.coalesce(*(F.when(s.rlike(f"^(?:{p})$"), F.lit(i)) for i, p in SENTENCES)))
        return F.filter(first, lambda x: x.isNotNull())

    some = marked.select("doc_id", kept("paragraphs").alias("paragraphs"), kept("lines").alias("lines"))
    ids = some.select("doc_id", named("paragraphs").alias("a"), named("lines").alias("b"))
    ids = ids.select("doc_id", F.concat("a", F.filter("b", lambda x: ~F.array_contains("a", x))).alias("ids"))
    rules = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in RULES))
    start = F.struct(F.array_join(F.transform("ids", lambda x: F.concat(F.lit(" "), x, F.lit(";"))), "").alias("left"), empty.alias("out"))

    def step(a: Column, r: Column) -> Column:
        after = F.struct(F.regexp_replace(a["left"], r["p"], F.lit("")).alias("left"), F.concat(a["out"], F.array(r["n"])).alias("out"))
        return F.when(F.rlike(a["left"], r["p"]), after).otherwise(a)

    end = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)).otherwise(F.struct(F.lit("").alias("left"), empty.alias("out")))
    done = ids.select("doc_id", "ids", end.alias("end"))
    left = F.size(F.split("end.left", ";")) - 1
    return done.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct("end.out"), ",").alias("licences"), left.cast("long").alias("n_unruled"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _normal_sql(s: str) -> str:
    low = f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ\"''', 'abcdefghijklmnopqrstuvwxyz')"
    return f"trim(regexp_replace(trim(regexp_replace({low}, '[^a-z0-9.,()/+-]+', ' ', 'g')), '^[ .,/+-]+|[ .,/-]+$', '', 'g'))"


def _sql() -> str:
    """The same scan: each rule is a step of its own."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ\"\'\'', 'abcdefghijklmnopqrstuvwxyz')"
    cue = lambda x: f"regexp_matches({low.format(x)}, {_q(CUES)})"
    kept = f"list_filter(list_transform(list_filter({{}}, lambda s: {cue('s')}), lambda s: {_normal_sql('s')}), lambda s: s <> '')"
    named = "list_filter(list_transform({}, lambda s: list_filter(l, lambda x: regexp_matches(s, x.p))[1].i), lambda x: x IS NOT NULL)"
    known = ", ".join(f"{{'i': {_q(i)}, 'p': {_q(f'^(?:{p})$')}}}" for i, p in SENTENCES)
    out = rf"""
WITH known AS (SELECT [{known}] AS l),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, regexp_replace(text, {_q(_COMMENT)}, '', 'g') AS bare FROM d),
f AS (SELECT doc_id, bare, replace(regexp_replace(bare, '\n[ \t]*\n', chr(8233), 'g'), chr(10), ' ') AS flat FROM b),
m AS (SELECT doc_id, bare, flat, {cue('flat')} AS cue FROM f),
p AS (SELECT doc_id, CASE WHEN cue THEN regexp_split_to_array(flat, '[.;!?]+[ ' || chr(8233) || ']+|' || chr(8233)) ELSE [] END AS ps, CASE WHEN cue THEN regexp_split_to_array(bare, '\n|[.;!?]+ +') ELSE [] END AS ls FROM m),
k AS (SELECT doc_id, {kept.format('ps')} AS ps, {kept.format('ls')} AS ls FROM p),
n AS (SELECT doc_id, {named.format('ps')} AS a, {named.format('ls')} AS b FROM k, known),
i AS (SELECT doc_id, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS ids FROM n),
r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: ' ' || x || ';'), '') AS q, CAST([] AS VARCHAR[]) AS o FROM i)"""
    for n, (name, pattern) in enumerate(RULES, 1):
        out += f",\nr{n} AS (SELECT doc_id, ids, regexp_replace(q, {_q(pattern)}, '', 'g') AS q, CASE WHEN regexp_matches(q, {_q(pattern)}) AND NOT list_contains(o, {_q(name)}) THEN list_append(o, {_q(name)}) ELSE o END AS o FROM r{n - 1})"
    return out + f"\nSELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(o, ',') AS licences, (len(q) - len(replace(q, ';', '')))::BIGINT AS n_unruled FROM r{len(RULES)}"


SQL = _sql()
