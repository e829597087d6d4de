"""License scans by ordered signature rules. DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases counted as such, whatever the rules say of them.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Rule(NamedTuple):
    """A signature over normalised text: lower-case words with one space between them."""

    label: str
    priority: int
    keyword: str
    regex: str


# label | a word every form has | forms of the name in normalised text
_NAMES = r"""
mit | mit | mit(?: x11)?
mit | expat | expat(?: x11)?
mit-0 | mit | mit (?:0|no attribution)
apache-2 | apache | apache(?: software)?(?: license)?(?: version)? 2(?: 0)?
apache-1.1 | apache | apache(?: software)?(?: license)?(?: version)? 1 1
apache-1.0 | apache | apache(?: software)?(?: license)?(?: version)? 1 0
gpl-1 | gpl | gpl ?v?1(?: 0)?(?: only| or later)?
gpl-2 | gpl | gpl ?v?2(?: 0)?(?: only| or later)?
gpl-3 | gpl | gpl ?v?3(?: 0)?(?: only| or later)?
gpl-1 | general public license | gnu general public license version 1
gpl-2 | general public license | gnu general public license(?: as published by the free software foundation either)? version 2
gpl-3 | general public license | gnu general public license(?: as published by the free software foundation either)? version 3
gpl | general public license | gnu general public license
lgpl-2.1 | lgpl | lgpl ?v?2 1(?: only| or later)?
lgpl-3 | lgpl | lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.1 | lesser general public license | gnu lesser general public license version 2 1
lgpl-3 | lesser general public license | gnu lesser general public license version 3
lgpl-2 | library general public license | gnu library general public license version 2
lgpl | lesser general public license | gnu lesser general public license
agpl-3 | agpl | agpl ?v?3(?: 0)?(?: only| or later)?
agpl-3 | affero | gnu affero general public license(?: version 3)?
gfdl-1.3 | free documentation | gnu free documentation license(?: version 1 3)?
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)
bsd-0-clause | bsd | (?:0bsd|zero clause bsd|bsd zero clause)
bsd | bsd | bsd(?: style)?
isc | isc | isc
mpl-1.1 | mozilla | mozilla public license(?: version)? 1 1
mpl-2 | mozilla | mozilla public license(?: version)? 2 0
mpl-2 | mpl | mpl 2 0
epl-1 | eclipse | eclipse public license(?: version| v)? ?1 0
epl-2 | eclipse | eclipse public license(?: version| v)? ?2 0
edl-1 | eclipse | eclipse distribution license(?: version| v)? ?1 0
cddl-1 | common development | common development and distribution license(?: version 1 0)?
cddl-1.1 | cddl | cddl 1 1
cpl-1 | common public | common public license(?: version 1 0)?
eupl-1.2 | european union public | european union public licen[cs]e(?: v 1 2)?
artistic-1 | artistic | artistic license 1 0
artistic-2 | artistic | artistic license 2 0
zlib | zlib | zlib(?: libpng)?
libpng-2 | libpng | libpng(?: version)? 2
boost-1 | boost | boost software license(?: version)? 1 0
boost-1 | bsl | bsl 1 0
python-2 | python | python software foundation license(?: version)? 2
psf-2 | psf | psf 2 0
php-3.01 | php | php license(?: version)? 3 01
ruby | ruby | ruby
perl | perl | same terms as perl(?: itself)?
postgresql | postgresql | postgresql
openssl | openssl | openssl
openldap-2.8 | openldap | openldap public license(?: version)? 2 8
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl(?: version 2)?
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd | nc nd | cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa | nc sa | cc by nc sa(?: [1-4] 0)?
cc-by-nc-nd | derivatives | creative commons attribution non ?commercial no ?derivatives(?: [1-4] 0)?
cc-by-nc-sa | alike | creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc | cc by nc | cc by nc(?! (?:nd|sa))(?: [1-4] 0)?
cc-by-nc | commercial | creative commons attribution non ?commercial(?: [1-4] 0)?
cc-by-nd | cc by nd | cc by nd(?: [1-4] 0)?
cc-by-sa | cc by sa | cc by sa(?: [1-4] 0)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] 0)?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?
cc-by | cc by | cc by(?! (?:nc|nd|sa))(?: [1-4] 0)?
cc-by | creative commons | creative commons attribution(?! (?:non|share|no ))(?: [1-4] 0)?
odbl-1 | open database | open database license
odc-by-1 | open data commons | open data commons attribution license
pddl-1 | public domain dedication | public domain dedication and license
ofl-1.1 | sil open font | sil open font license(?: version)?(?: 1 1)?
openrail | openrail | (?:creativeml )?openrail(?: m)?
ms-pl | microsoft public | microsoft public license
ms-rl | microsoft reciprocal | microsoft reciprocal license
afl-3 | academic free | academic free license(?: version)?(?: 3 0)?
osl-3 | open software license | open software license(?: version)?(?: 3 0)?
upl-1 | universal permissive | universal permissive license(?: version)?(?: 1 0)?
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)?
w3c | w3c | w3c(?: software notice and)?
vim | vim | vim
x11 | x11 | x11
"""

# label | priority | keyword | signature of the license's own text, an address or a notice of its own
_SIGNATURES = r"""
mit | 95 | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | 95 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
bsd-0-clause | 96 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
bsd-3-clause | 95 | neither the name | neither the names? of [^ ]+(?: [^ ]+){0,12} may be used to endorse or promote products derived from this software
bsd-2-clause | 70 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | 96 | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2 | 95 | apache org | (?:http|https) (?:www )?apache org licenses license 2 0
apache-2 | 94 | compliance with the license | you may not use this file except in compliance with the license
gpl-3 | 95 | gnu org | gnu org licenses gpl 3 0
gpl-2 | 95 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0
lgpl-2.1 | 95 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | 95 | gnu org | gnu org licenses lgpl 3 0
agpl-3 | 95 | gnu org | gnu org licenses agpl 3 0
gpl | 85 | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2 | 97 | either version 2 | gnu general public license as published by the free software foundation either version 2
gpl-3 | 97 | either version 3 | gnu general public license as published by the free software foundation either version 3
mpl-2 | 95 | mozilla org | mozilla org mpl 2 0
mpl-2 | 94 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mit | 95 | opensource org | opensource org licenses mit
bsd-3-clause | 95 | opensource org | opensource org licenses bsd 3 clause
bsd-2-clause | 95 | opensource org | opensource org licenses bsd 2 clause
isc | 95 | opensource org | opensource org licenses isc
zlib | 95 | as is without | this software is provided as is without any express or implied warranty in no event will the authors be held liable
boost-1 | 95 | boost org | boost org license 1 0
wtfpl | 95 | what the fuck | do what the fuck you want to public license
unlicense | 95 | unencumbered | this is free and unencumbered software released into the public domain
public-domain | 60 | public domain | (?:released|placed|dedicated|donated|is) (?:in ?to|in|to) the public domain
cc0-1 | 95 | creativecommons org | creativecommons org publicdomain zero 1 0
cc-by | 95 | creativecommons org | creativecommons org licenses by [1-4] 0
cc-by-sa | 95 | creativecommons org | creativecommons org licenses by sa [1-4] 0
cc-by-nd | 95 | creativecommons org | creativecommons org licenses by nd [1-4] 0
cc-by-nc | 95 | creativecommons org | creativecommons org licenses by nc [1-4] 0
cc-by-nc-sa | 95 | creativecommons org | creativecommons org licenses by nc sa [1-4] 0
cc-by-nc-nd | 95 | creativecommons org | creativecommons org licenses by nc nd [1-4] 0
ofl-1.1 | 95 | scripts sil org | scripts sil org ofl
epl-2 | 95 | eclipse org | eclipse org legal epl 2 0
epl-1 | 95 | eclipse org | eclipse org legal epl v10
proprietary | 55 | all rights reserved | copyright(?: c)?(?: [^ ]+){1,12} all rights reserved
proprietary | 70 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 70 | written | without the express(?:ed)? written (?:permission|consent) of
"""

_VERBS = "licensed|released|distributed|available|provided|published|covered|issued|offered|dual licensed"

# What a name stands in, with its priority. The last needs the word itself in the name or beside it.
_FORMS = (
    (100, "spdx", r"spdx licen[sc]e identifier {}"),
    (80, "under", rf"(?:{_VERBS})(?: [^ ]+){{{{0,3}}}}? under (?:the )?(?:terms of )?(?:the )?{{}}(?: (?:open source )?licen[sc]e)?(?: version [0-9](?: [0-9])?)?"),
    (65, "licen", r"licen[sc]e (?:is |type |under )?(?:the )?{}"),
    (60, "licen", r"{}(?: (?:open source |public )?licen[sc]e)(?: version [0-9](?: [0-9])?)?"),
)


def rules() -> list[Rule]:
    """All rules, highest priority first; equal ones in the order written."""
    split = lambda block: [[x.strip() for x in line.split("|", n)] for line in block.strip().splitlines()]
    n = 2
    out = [Rule(label, priority, word, "(?<![^ ])" + form.format(f"(?:{name})") + "(?![^ ])") for label, word, name in split(_NAMES) for priority, _, form in _FORMS]
    # names that mean nothing else stand alone as well
    out += [Rule(label, 50, word, f"(?<![^ ])(?:{name})(?![^ ])") for label, word, name in split(_NAMES) if label.startswith(("cc-by", "gpl-", "lgpl-", "agpl-"))]
    n = 3
    out += [Rule(label, int(p), word, f"(?<![^ ])(?:{regex})(?![^ ])") for label, p, word, regex in split(_SIGNATURES)]
    return sorted(out, key=lambda r: -r.priority)


#: Every match of a rule and every base phrase has one of these in its text, or "as is", _CC or _UNDER, whatever stands between its words.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CC = rf"cc{_GAP}by"
#: What all rules with "under" begin with, as it stands in the raw text; the verbs are their own words.
_UNDER = rf"(?:{_VERBS.replace(' ', _GAP)})(?:{_GAP}{_WORD}){{0,3}}{_GAP}under"
_GATES = ("licen", "spdx", "copyright", "confidential", "public", "permission", "redistribution", "advertising", "neither", "gnu", "gpl", "mozilla", "opensource", "creative", "eclipse", "boost", "apache", "unencumbered", "scripts", "express", "fuck")


def _literal(table: list[Rule]):
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ",".join(f"named_struct('label',{q(r.label)},'priority',{r.priority},'keyword',{q(r.keyword)},'regex',{q(r.regex)})" for r in table) + ")")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row of docs.

    Words are runs [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased (null:
    empty). n_base counts the places where a base phrase's words stand one after the other;
    first_word and last_word are their smallest and largest starts. Base labels always stay.
    Rules run in order on the words joined by one space, only where a cheap test of the raw
    text and then the rule's own keyword succeed. A detection is dropped whose interval lies
    within another's of higher priority, or of equal priority and larger, or the same interval
    of an earlier rule. detections lists what stays: (label, priority, start, end) in code points
    of the joined words. score is 1 with a base phrase, else the best priority / 100, else 0.
    There is no shuffle; equal rows give equal results and further columns are not read.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("low", F.lower("text"))  # a column of its own, so that it is made once for all tests
    text, lower = F.col("text"), F.col("low")
    gate = F.lit(False)
    for g in _GATES:
        gate = gate | lower.contains(g)
    gate = gate | lower.contains("as is") | F.rlike(lower, F.lit(_CC)) | (lower.contains("under") & F.rlike(lower, F.lit(_UNDER)))
    d = d.select("id", F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), F.when(gate, text).alias("t"))
    d = d.withColumn("w", F.when(F.col("t").isNotNull(), F.regexp_extract_all(ascii_lower(F.col("t")), F.lit(_WORD), F.lit(0))))
    d = d.withColumn("s", F.array_join("w", " "))

    def places(phrase: str):
        words = phrase.split()

        def here(i):
            out = F.get("w", i) == words[0]
            for k, x in enumerate(words[1:], 1):
                out = out & F.coalesce(F.get("w", i + k) == x, F.lit(False))
            return out

        return F.when(F.concat(F.lit(" "), "s", F.lit(" ")).contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size("w") - 1), here)).otherwise(F.array().cast("array<int>"))

    def labelled(phrase: str, label: str):
        return F.transform(places(phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    base = F.when(F.coalesce(F.size("w"), F.lit(0)) > 0, F.flatten(F.array(*[labelled(p, label) for p, label in phrases.items()])))
    d = d.withColumn("base", F.coalesce(base, F.array().cast("array<struct<at:int,label:string>>")))
    survivors = F.filter(_literal(rules()), lambda r: F.col("s").contains(r["keyword"]))
    d = d.withColumn("rules", F.when(F.coalesce(F.size("w"), F.lit(0)) > 0, survivors))
    detect = """flatten(transform(rules, (r, n) -> transform(
        arrays_zip(regexp_extract_all(s, r.regex, 0), slice(split(s, r.regex, -1), 1, size(regexp_extract_all(s, r.regex, 0)))),
        (m, k) -> named_struct('label', r.label, 'priority', r.priority, 'rule', n, 'hit', m.`0`, 'gap', m.`1`, 'k', k))))"""
    d = d.withColumn("m", F.when(F.size("rules") > 0, F.expr(detect)))
    # a match starts after the gaps up to it and the rule's matches before it
    start = """transform(m, x -> named_struct('label', x.label, 'priority', x.priority, 'rule', x.rule,
        'start', aggregate(filter(m, y -> y.rule = x.rule and y.k <= x.k), 0, (a, y) -> a + length(y.gap) + if(y.k < x.k, length(y.hit), 0)), 'len', length(x.hit)))"""
    d = d.withColumn("m", F.when(F.size("m") > 0, F.expr(start)))
    inside = """filter(m, x -> not exists(m, y -> y.start <= x.start and y.start + y.len >= x.start + x.len and (
        y.priority > x.priority or y.priority = x.priority and (y.len > x.len or y.len = x.len and y.rule < x.rule))))"""
    none = "cast(array() as array<struct<label:string,priority:int,rule:int,start:int,len:int>>)"
    d = d.withColumn("m", F.expr(f"coalesce({inside}, {none})"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    at = F.transform("base", lambda b: b["at"])
    base_labels = F.transform("base", lambda b: b["label"])
    return d.select(
        "id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("m", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("m", lambda x: x["priority"])), F.lit(0)) / 100.0).alias("score"),
        F.transform("m", lambda x: F.struct(x["label"].alias("label"), x["priority"].alias("priority"), x["start"].alias("start"), (x["start"] + x["len"]).alias("end"))).alias("detections"),
    )
