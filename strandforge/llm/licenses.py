"""Licence recognition by sentence rules, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import text_of

#: GNU licences by the name in their texts: short name, versions, title dates.
GNU = {
    "gnu general public license": ("gpl", {"2": "june 1991", "3": "29 june 2007"}),
    "gnu lesser general public license": ("lgpl", {"2 1": "february 1999", "3": "29 june 2007"}),
    "gnu affero general public license": ("agpl", {"3": "19 november 2007"}),
}
#: Known licence sentences, normalised (lower case, runs of anything but a-z and 0-9 as one space): sentence to identifier.  A star stands for any words of the sentence.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "in no event shall * or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy-at",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy-at",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy-at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "apache license version 2 0 january 2004": "apache-title",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache-grant",
    "this program is free software": "gnu-free",
    "this library is free software": "gnu-free",
    "this file is free software": "gnu-free",
    "either version 2 of the license or at your option any later version": "gnu-2-later",
    "either version 2 1 of the license or at your option any later version": "gnu-2.1-later",
    "either version 3 of the license or at your option any later version": "gnu-3-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-obtain",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-terms",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl-notice",
    "boost software license version 1 0 august 17th 2003": "bsl-notice",
    "spdx license identifier": "spdx",
}
for _name, (_short, _versions) in GNU.items():
    SENTENCES[f"you can redistribute it and or modify it under the terms of the {_name} as published by the free software foundation"] = f"{_short}-terms"
    for _v, _date in _versions.items():
        _id = f"{_short}-{_v.replace(' ', '.')}"
        SENTENCES[f"you can redistribute it and or modify it under the terms of the {_name} as published by the free software foundation either version {_v} of the license or at your option any later version"] = f"{_id}-later"
        SENTENCES[f"you can redistribute it and or modify it under the terms of the {_name} version {_v} as published by the free software foundation"] = f"{_id}-only"
        SENTENCES[f"{_name} version {_v} {_date}"] = f"{_id}-title"
#: Names in notices such as ``this work is licensed under ...``, normalised, to the notice's identifier.
NOTICES = {
    "mit license": "mit-notice", "isc license": "isc-notice", "apache license version 2 0": "apache-notice-short", "apache license 2 0": "apache-notice-short", "apache 2 0 license": "apache-notice-short",
    "gnu general public license version 2": "gpl-2-notice", "gnu general public license version 3": "gpl-3-notice", "gnu affero general public license version 3": "agpl-3-notice", "gnu lesser general public license version 3": "lgpl-3-notice", "gnu lesser general public license version 2 1": "lgpl-2.1-notice",
    "mit": "mit-notice", "isc": "isc-notice", "apache 2 0": "apache-notice-short", "bsd 2 clause": "bsd2-notice", "bsd 3 clause": "bsd3-notice", "mpl 2 0": "mpl-notice", "epl 2 0": "epl-notice",
    "bsd 2 clause license": "bsd2-notice", "bsd 3 clause license": "bsd3-notice", "mozilla public license version 2 0": "mpl-notice", "eclipse public license 2 0": "epl-notice",
}
for _kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    for _v in ("3.0", "4.0"):
        NOTICES[f"cc {_kind} {_v}".replace("-", " ").replace(".", " ")] = f"cc-{_kind}-{_v}-notice"
#: Ordered rules: licence, and the identifiers that must follow one another among a text's known sentences.
RULES = [
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy-at"]),
    ("Apache-2.0", ["apache-notice-short"]),
    ("Apache-2.0", ["apache-title", "apache-grant"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSL-1.0", ["bsl-notice"]),
    ("EPL-2.0", ["epl-terms"]),
    ("EPL-2.0", ["epl-notice"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-notice"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("MIT", ["mit-notice"]),
    ("MPL-2.0", ["mpl-subject", "mpl-obtain"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Zlib", ["zlib-liability", "zlib-grant"]),
]
for _short, _versions in GNU.values():
    for _v in _versions:
        _id, _spdx = f"{_short}-{_v.replace(' ', '.')}", f"{_short.upper()}-{_v.replace(' ', '.')}{'' if ' ' in _v else '.0'}"
        RULES += [(f"{_spdx}-or-later", ["gnu-free", f"{_id}-later"]), (f"{_spdx}-or-later", ["gnu-free", f"{_short}-terms", f"gnu-{_v.replace(' ', '.')}-later"])]
        RULES += [(f"{_spdx}-only", ["gnu-free", f"{_id}-only"]), (f"{_spdx}-only", [f"{_id}-notice"]), (_spdx, [f"{_id}-title"])]
RULES += [(f"CC-{n[3:-7].upper()}", [n]) for n in sorted(set(NOTICES.values())) if n.startswith("cc-")]
#: After ``SPDX-License-Identifier:`` any licence of the rules may be named.
NAMES = {n.lower().replace("-", " ").replace(".", " "): f"name-{n}" for n in sorted({n for n, _ in RULES} | {"GPL-2.0", "GPL-3.0", "CC0-1.0"})}
RULES += [(n[5:], ["spdx", n]) for n in NAMES.values()]
#: A plus after a version, which the normalisation writes as a word: the same or a later one.
NAMES |= {f"{s.removesuffix(' or later')} plus": n for s, n in NAMES.items() if s.endswith(" or later")}
RULES.sort()
#: A rule that another one contains counts only where the longer one doesn't match.
SHADOWED = {"BSD-2-Clause": "BSD-3-Clause"}
#: Every known sentence stands in a text with one of these words.
HINTS = "(?i)licens|distribut|software|permission|copyright|warrant|liable"
#: Mark of a sentence's end, and of a line's end within a sentence.
_END, _LINE = "\x01", "\x02"
_GAP = r"(?: |\x02\x02)"
#: An exception to a licence in an expression; it changes no licence's name.
_EXCEPTION = rf"(?:{_GAP}with{_GAP}(?:[a-z0-9]+{_GAP})+?(?:exception|note)(?:{_GAP}[0-9]+)*)?"
_VERB = r"(?:this (?:work|project|software|program|library|file|code|document) is )?(?:licensed|released|distributed|made available) under (?:the )?"
_BY_VERB = f"^{_VERB}"


def _pattern() -> str:
    """A known sentence between two ends of lines or sentences, perhaps numbered; longer ones first."""
    words = lambda s: "".join(rf"[a-z0-9][a-z0-9\x02 ]*?{_GAP}" if w == "*" else w + (_GAP if i < n - 1 else "") for n in [len(s.split())] for i, w in enumerate(s.split()))
    longest = lambda table: sorted(table, key=lambda s: (-len(s.split()), s))
    notices = "|".join(map(words, longest(NOTICES)))
    name = rf"(?:{'|'.join(map(words, longest(NAMES)))}){_EXCEPTION}"
    expression = rf"{name}(?:{_GAP}(?:or|and){_GAP}{name})*"
    return rf"[\x01\x02](?:(?:[a-z]|[0-9]{{1,2}}|[ivx]+){_GAP})?({'|'.join(map(words, longest(SENTENCES)))}|{expression}|{_VERB.replace(' ', _GAP)}(?:{notices}))[\x01\x02]"


def _names() -> str:
    """A licence's name within an expression, the longest that stands there."""
    return rf"\b({'|'.join(sorted(NAMES, key=lambda s: (-len(s.split()), s)))})\b"


#: Steps that turn lower-cased text into words with marked ends: (pattern, replacement).
_STEPS = [
    (r"[\x01\x02]", " "),
    (r"([0-9])\+", "$1 plus "),
    (r"([.!?;:][\"')\]]*)[\x20\x09-\x0D]", "\x01"),  # a sentence's end
    (r"\n[^a-z0-9\n\x01]*\n", "\x01"),  # a line without a word ends a paragraph
    (r"\n", "\x02"),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r" ?\x02[\x02 ]*", "\x02"),
    (r"[\x02 ]?\x01[\x01\x02 ]*", "\x01"),
]


def marked(text: Column) -> Column:
    """The text's words in lower case, one space apart, with doubled marks where a line (``\\x02``) or a sentence (``\\x01``) ends."""
    out = F.translate(F.concat(F.lit("\n\n"), text, F.lit("\n\n")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, new in _STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.regexp_replace(F.concat(F.lit(_END), out, F.lit(_END)), r"([\x01\x02])", "$1$1")


def _lookup() -> dict[str, str]:
    """Normalised sentence, whoever is licensed, to identifier."""
    return {**{re.sub(_BY_VERB, "under ", s): n for s, n in SENTENCES.items()}, **NAMES, **{f"under {s}": n for s, n in NOTICES.items()}}


#: A known sentence's variable words, as the table has them.
_CANONICAL = [(r"\x02\x02", " "), (_BY_VERB, "under "), ("^neither the name of .* nor the names of its", "neither the name of * nor the names of its"), ("^in no event shall .* or contributors be liable for any direct", "in no event shall * or contributors be liable for any direct")]


def _named_rule(name: str) -> str:
    """A name somewhere in the expression that follows an SPDX tag."""
    return f",spdx(?:,name-[^,]+)*,{re.escape(name)},"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses): known sentences in text order, and the licences by name.

    A sentence begins and ends where a line or a sentence does (after one of . ! ? ; : and white space, or at a line without a word)
    and may run over lines, whatever marks of comments or numbering stand before it.  Normalised, it is looked up among the known ones;
    of known sentences that begin together the longest counts, and they do not overlap.
    After ``SPDX-License-Identifier:`` an expression of several licences (``or``, ``and``, brackets, ``with`` an exception) gives an
    identifier for each.  A rule matches where its identifiers stand next to one another in the text's sequence of known sentences,
    whatever unknown text lies between.  Null and empty texts have none (n_sentences 0, both strings empty); very long ones are
    read whole, in linear time.  Every row is judged alone: repeated rows give as many rows, a null id is kept, an empty table gives
    none, extra columns are ignored.  The tables of sentences and rules are constants, so a row needs no join and no shuffle.
    """
    known = F.create_map(*(F.lit(x) for pair in _lookup().items() for x in pair))

    def named(sentence: Column) -> Column:
        for pattern, new in _CANONICAL:
            sentence = F.regexp_replace(sentence, pattern, new)
        one = known[sentence]
        return F.when(one.isNotNull(), F.array(one)).otherwise(F.transform(F.regexp_extract_all(sentence, F.lit(_names()), F.lit(1)), lambda x: known[x]))

    ids = F.filter(F.flatten(F.transform(F.regexp_extract_all(marked(F.col("_text")), F.lit(_pattern()), F.lit(1)), named)), lambda x: x.isNotNull())
    found = docs.select("doc_id", text_of().alias("_text")).select("doc_id", F.when(F.col("_text").rlike(HINTS), ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    told = found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    chain = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    hit: dict[str, Column] = {}
    for name, rule in RULES:
        one = F.rlike(chain, F.lit(_named_rule(rule[1]))) if rule[0] == "spdx" else chain.contains("," + ",".join(rule) + ",")
        hit[name] = hit[name] | one if name in hit else one
    listed = F.filter(F.array(*(F.when(hit[n] & ~hit[SHADOWED[n]] if n in SHADOWED else hit[n], F.lit(n)) for n in sorted(hit))), lambda x: x.isNotNull())
    return told.select("doc_id", "n_sentences", "sentence_ids", F.when(F.col("n_sentences") > 0, F.array_join(listed, ",")).otherwise(F.lit("")).alias("licenses"))


def license_sql() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({q(s)}, {q(i)})" for s, i in _lookup().items())
    enc = "translate(chr(10) || chr(10) || t || chr(10) || chr(10), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, new in _STEPS:
        enc = f"regexp_replace({enc}, {q(pattern)}, {f'chr({ord(new)})' if new in (_END, _LINE) else q(new.replace('$1', chr(92) + '1'))}, 'g')"
    s = "s"
    for pattern, new in _CANONICAL:
        s = f"regexp_replace({s}, {q(pattern)}, {q(new)}, 'g')"
    tests: dict[str, list[str]] = {}
    for name, rule in RULES:
        tests.setdefault(name, []).append(f"regexp_matches(chain, {q(_named_rule(rule[1]))})" if rule[0] == "spdx" else f"contains(chain, {q(',' + ','.join(rule) + ',')})")
    told = {n: "(" + " or ".join(x) + ")" for n, x in tests.items()}
    cases = ", ".join(f"case when {told[n]}{' and not ' + told[SHADOWED[n]] if n in SHADOWED else ''} then {q(n)} end" for n in sorted(told))
    return f"""
with known(sentence, id) as (values {table}),
rows as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
marked as (select r, regexp_replace(chr(1) || {enc} || chr(1), '([\\x01\\x02])', '\\1\\1', 'g') m from rows where regexp_matches(t, {q(HINTS)})),
parts as (select r, unnest(e) s, generate_subscripts(e, 1) i from (select r, regexp_extract_all(m, {q(_pattern())}, 1) e from marked)),
clean as (select r, i, case when k.sentence is not null then [c.s] else regexp_extract_all(c.s, {q(_names())}, 1) end l from (select r, i, {s} s from parts) c left join known k on k.sentence = c.s),
named as (select r, i, j, k.id from (select r, i, unnest(l) s, generate_subscripts(l, 1) j from clean) join known k on k.sentence = s),
ids as (select r, count(*) n, string_agg(id, ',' order by i, j) ids from named group by r),
chains as (select doc_id, coalesce(n, 0) n_sentences, coalesce(ids, '') sentence_ids, ',' || coalesce(ids, '') || ',' as chain from rows left join ids using (r))
select doc_id, n_sentences::bigint n_sentences, sentence_ids, array_to_string(list_filter([{cases}], lambda x: x is not null), ',') licenses from chains"""
