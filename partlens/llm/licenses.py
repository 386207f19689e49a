"""License detection by ordered signature rules, in DataFrame functions alone.

A text's lower-cased words are joined by one blank. That line is scanned once for the gate: word runs one of which every rule
and phrase needs. Only lines that hold one go on to the rules' regular expressions, and of these only those
one of whose own keywords occurs are run. Gate and keywords are derived from the expressions (`needed`).
A detection is an interval of words with a priority. Detections are ordered by start (longer first); one that lies
inside an earlier one of the same or a higher priority is suppressed, others stay.

The three base phrases are found in the same way, count at all their places and are never suppressed.

Null texts are empty; an empty table gives no rows; very long texts are scanned whole, in time about linear in their length and
matches; repeated rows have the same result; other columns are ignored, whatever their names; a text without words has no places, null first and last words, empty labels and score 0.
The score is the greatest confidence of the kept detections.
"""

from __future__ import annotations

import json
from itertools import product
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, let, running, words

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families: label, the name as it reads in lower-cased words.
FAMILIES = """
mit | (?:the )?mit(?: x11)?
apache-2 | (?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?
apache-1 | (?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?1(?: [01])?
gpl-2 | (?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version)? ?v?2(?: 0)?
gpl-3 | (?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version)? ?v?3(?: 0)?
gpl | (?:the )?gnu (?:general public licen[sc]e|gpl)
lgpl-2.1 | (?:the )?(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)(?: version)? ?v?2(?: [01])?
lgpl-3 | (?:the )?(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version)? ?v?3(?: 0)?
agpl-3 | (?:the )?(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version)? ?v?3(?: 0)?
gfdl | (?:the )?gnu free documentation licen[sc]e
bsd-2-clause | (?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)
bsd-3-clause | (?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)
bsd-4-clause | (?:the )?(?:original bsd|bsd 4 clause|4 clause bsd)
bsd | (?:the )?bsd(?: style)?
isc | (?:the )?isc
zlib | (?:the )?zlib(?: libpng)?
boost-1 | (?:the )?boost software(?: licen[sc]e)?(?: version)?(?: 1(?: 0)?)?
unlicense | (?:the )?unlicense
wtfpl | (?:the )?wtfpl
mpl-1.1 | (?:the )?(?:mozilla public licen[sc]e|mpl)(?: version)? ?v?1 1
mpl-2 | (?:the )?(?:mozilla public licen[sc]e|mpl)(?: version)? ?v?2(?: 0)?
epl-1 | (?:the )?(?:eclipse public licen[sc]e|epl)(?: version)? ?v?1(?: 0)?
epl-2 | (?:the )?(?:eclipse public licen[sc]e|epl)(?: version)? ?v?2(?: 0)?
cddl-1 | (?:the )?(?:common development and distribution licen[sc]e|cddl)(?: version)?(?: 1(?: [01])?)?
cpl-1 | (?:the )?common public licen[sc]e(?: version)?(?: 1(?: 0)?)?
artistic-1 | (?:the )?artistic licen[sc]e(?: version)? 1(?: 0)?
artistic-2 | (?:the )?artistic licen[sc]e(?: version)? 2(?: 0)?
eupl | (?:the )?(?:european union public licen[sc]e|eupl)(?: version)?(?: 1(?: [012])?)?
osl-3 | (?:the )?open software licen[sc]e(?: version)?(?: 3(?: 0)?)?
afl-3 | (?:the )?academic free licen[sc]e(?: version)?(?: 3(?: 0)?)?
ms-pl | (?:the )?microsoft public
ms-rl | (?:the )?microsoft reciprocal
ofl-1.1 | (?:the )?(?:sil )?open font licen[sc]e(?: version)?(?: 1(?: 1)?)?
psf | (?:the )?python software foundation
php-3 | (?:the )?php licen[sc]e(?: version)?(?: 3(?: 0 ?1?)?)?
w3c | (?:the )?w3c software
x11 | (?:the )?x11
ncsa | (?:the )?(?:university of illinois )?ncsa(?: open source)?
postgresql | (?:the )?postgresql
openssl | (?:the )?openssl
vim | (?:the )?vim
curl | (?:the )?curl
cecill | (?:the )?cecill(?: [abc])?(?: version)?(?: 2(?: [01])?)?
mulan-2 | (?:the )?mulan(?: psl| permissive software licen[sc]e)(?: version)? ?v?2
upl-1 | (?:the )?universal permissive licen[sc]e(?: version)?(?: 1(?: 0)?)?
bsl-1.1 | (?:the )?business source licen[sc]e(?: version)?(?: 1(?: 1)?)?
sspl-1 | (?:the )?(?:server side public licen[sc]e|sspl)(?: version)? ?v?1?
elastic-2 | (?:the )?elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?
odbl-1 | (?:the )?(?:open database licen[sc]e|odbl)(?: version)?(?: 1(?: 0)?)?
odc-by-1 | (?:the )?open data commons attribution
pddl-1 | (?:the )?(?:open data commons )?public domain dedication
cc0 | (?:the )?(?:creative commons zero|cc0|cc zero)(?: 1(?: 0)?)?
cc-by | (?:the )?(?:creative commons attribution|cc by)(?: [1-4](?: [05])?)?(?= )(?! (?:nc|nd|sa|non|no|share))
cc-by-sa | (?:the )?(?:creative commons attribution share ?alike|cc by sa)(?: [1-4](?: [05])?)?
cc-by-nd | (?:the )?(?:creative commons attribution no ?deriv[a-z]*|cc by nd)(?: [1-4](?: [05])?)?
cc-by-nc | (?:the )?(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4](?: [05])?)?(?= )(?! (?:nd|sa|no|share))
cc-by-nc-sa | (?:the )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4](?: [05])?)?
cc-by-nc-nd | (?:the )?(?:creative commons attribution non ?commercial no ?deriv[a-z]*|cc by nc nd)(?: [1-4](?: [05])?)?
"""
#: Forms a family's name stands in: priority (1 is highest), confidence, expression with {} for the name.
FORMS = [
    (1, 0.95, "(?:licen[sc]ed|released|distributed|available|published|provided|made available|covered|governed) (?:under|by)(?: the)?(?: terms of)?(?: the)? {}(?: public)?(?: licen[sc]e)?"),
    (1, 0.95, "(?:subject to|according to|in accordance with|conditions of) (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?"),
    (2, 0.8, "spdx licen[sc]e identifier {}"),
    (2, 0.8, "under (?:the )?(?:terms of )?(?:the )?{} licen[sc]e"),
    (3, 0.5, "{} licen[sc]e"),
]
#: Further signatures: label, priority, confidence, expression.
OTHERS = """
mit | 1 | 0.9 | permission is hereby granted free of charge to any person obtaining a copy
isc | 1 | 0.9 | permission to use copy modify and or distribute this software for any purpose
bsd | 1 | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
gpl-3 | 2 | 0.8 | gnu general public license version 3
gpl-2 | 2 | 0.8 | gnu general public license version 2
gpl | 2 | 0.7 | free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
apache-2 | 2 | 0.8 | apache license version 2(?: 0)?
cc-by-nc | 2 | 0.8 | cc by nc(?: [1-4](?: 0)?)?(?= )(?! (?:nd|sa))
cc-by-nc-sa | 2 | 0.8 | cc by nc sa(?: [1-4](?: 0)?)?
cc-by-nc-nd | 2 | 0.8 | cc by nc nd(?: [1-4](?: 0)?)?
cc-by-sa | 2 | 0.8 | cc by sa(?: [1-4](?: 0)?)?
unlicense | 2 | 0.8 | this is free and unencumbered software released into the public domain
public-domain | 2 | 0.6 | (?:released|dedicated|placed) (?:in|into|to) the public domain
proprietary | 3 | 0.5 | all rights reserved
unknown-free | 3 | 0.3 | (?:an|the) open source licen[sc]e
"""
#: Signatures of the licenses' own texts and notices, each written from what the license says: label, priority, confidence, expression.
TEXTS = """
mit | 1 | 0.9 | to deal in the software without restriction including without limitation the rights
mit | 2 | 0.7 | the above copyright notice and this permission notice shall be included in all copies
mit-0 | 1 | 0.9 | mit no attribution
x11 | 1 | 0.9 | except as contained in this notice the names? of(?: [a-z]+){1,8} shall not be used in advertising
isc | 1 | 0.9 | with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | 1 | 0.9 | (?:bsd )?zero clause (?:bsd|license)
bsd-2-clause | 1 | 0.9 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3-clause | 1 | 0.9 | neither the names? of(?: [a-z]+){1,8} may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 1 | 0.9 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | 1 | 0.9 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | 1 | 0.9 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 | 2 | 0.8 | www apache org licen[sc]es licen[sc]e 2 0
apache-1 | 1 | 0.9 | this product includes software developed by the apache (?:group|software foundation)
gpl | 1 | 0.9 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl-2 | 1 | 0.95 | general public licen[sc]e as published by the free software foundation (?:either )?version 2
gpl-3 | 1 | 0.95 | general public licen[sc]e as published by the free software foundation (?:either )?version 3
gpl | 2 | 0.7 | you should have received a copy of the gnu general public licen[sc]e along with this
gpl | 2 | 0.7 | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e
lgpl-2.1 | 1 | 0.95 | gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation (?:either )?version 2
lgpl-3 | 1 | 0.95 | gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3
lgpl | 2 | 0.7 | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this
agpl-3 | 1 | 0.95 | gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3
agpl-3 | 2 | 0.7 | you should have received a copy of the gnu affero general public licen[sc]e along with this
gfdl | 1 | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl | 2 | 0.8 | with no invariant sections no front cover texts and no back cover texts
gpl-classpath | 1 | 0.9 | linking this library statically or dynamically with other modules is making a combined work
gpl-linking | 2 | 0.7 | as a special exception(?: [a-z]+){1,12} permission to link
mpl-2 | 1 | 0.95 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2 | 2 | 0.8 | mozilla org mpl 2 0
mpl-1.1 | 1 | 0.9 | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
npl | 1 | 0.9 | the contents of this file are subject to the netscape public licen[sc]e
epl-2 | 1 | 0.95 | made available under the terms of the eclipse public licen[sc]e 2 0
epl-1 | 1 | 0.95 | made available under the terms of the eclipse public licen[sc]e v1 0
edl-1 | 1 | 0.9 | eclipse distribution licen[sc]e
cddl-1 | 1 | 0.95 | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cpl-1 | 1 | 0.9 | made available under the terms of the common public licen[sc]e
ipl-1 | 1 | 0.9 | ibm public licen[sc]e
spl-1 | 1 | 0.9 | sun public licen[sc]e
apsl-2 | 1 | 0.9 | apple public source licen[sc]e
rpl | 1 | 0.9 | reciprocal public licen[sc]e
qpl | 1 | 0.9 | q public licen[sc]e
lppl | 1 | 0.9 | latex project public licen[sc]e
ofl-1.1 | 1 | 0.9 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
ofl-1.1 | 2 | 0.8 | with reserved font name
zlib | 1 | 0.9 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 2 | 0.8 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | 1 | 0.9 | the png reference library is supplied as is
libtiff | 1 | 0.9 | the names of sam leffler and silicon graphics may not be used in any advertising
ijg | 1 | 0.9 | this software is based in part on the work of the independent jpeg group
bzip2 | 1 | 0.9 | this program bzip2 the associated library libbzip2
curl | 1 | 0.8 | copyright c(?: [a-z0-9]+){1,5} daniel stenberg
boost-1 | 1 | 0.9 | distributed under the boost software licen[sc]e version 1 0
boost-1 | 1 | 0.9 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
unlicense | 1 | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 1 | 0.9 | do what the fuck you want to public licen[sc]e
beerware | 1 | 0.9 | if we meet some day and you think this stuff is worth it you can buy me a beer in return
cc0 | 1 | 0.9 | to the extent possible under law(?: [a-z]+){1,10} has waived all copyright and related or neighboring rights
cc0 | 2 | 0.8 | creativecommons org publicdomain zero
cc-by | 2 | 0.8 | creativecommons org licen[sc]es by [1-4]
cc-by-sa | 2 | 0.8 | creativecommons org licen[sc]es by sa
cc-by-nc | 2 | 0.8 | creativecommons org licen[sc]es by nc [1-4]
cc-by-nd | 2 | 0.8 | creativecommons org licen[sc]es by nd
cc-by-nc-sa | 2 | 0.8 | creativecommons org licen[sc]es by nc sa
cc-by-nc-nd | 2 | 0.8 | creativecommons org licen[sc]es by nc nd
pddl-1 | 1 | 0.9 | opendatacommons org licen[sc]es pddl
odbl-1 | 1 | 0.9 | this(?: [a-z]+){1,10} is made available under the open database licen[sc]e
odc-by-1 | 1 | 0.9 | opendatacommons org licen[sc]es by
cdla-permissive | 1 | 0.9 | community data licen[sc]e agreement permissive
cdla-sharing | 1 | 0.9 | community data licen[sc]e agreement sharing
artistic-2 | 1 | 0.9 | the intent of this document is to state the conditions under which a package may be copied
perl | 2 | 0.8 | under the same terms as perl itself
python-2 | 1 | 0.9 | psf is making python available to licensee on an as is basis
cnri-python | 1 | 0.9 | cnri grants licensee a nonexclusive royalty free world wide licen[sc]e
php-3 | 1 | 0.9 | this product includes php software freely available from
ruby | 2 | 0.8 | under the same terms as ruby
tcl | 1 | 0.9 | the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose
openssl | 1 | 0.9 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 1 | 0.9 | this product includes cryptographic software written by eric young
openldap | 1 | 0.9 | openldap public licen[sc]e
postgresql | 1 | 0.9 | in no event shall the university of california be liable to any party for direct indirect special
w3c | 1 | 0.9 | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
ncsa | 1 | 0.9 | neither the names of(?: [a-z]+){0,10} university of illinois(?: [a-z]+){0,10} may be used to endorse
hpnd | 1 | 0.8 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
ntp | 1 | 0.8 | makes no representations about the suitability this software for any purpose
afl-3 | 1 | 0.9 | licensed under the academic free licen[sc]e version 3
osl-3 | 1 | 0.9 | licensed under the open software licen[sc]e version 3
ecl-2 | 1 | 0.9 | educational community licen[sc]e version 2
eupl | 1 | 0.9 | licensed under the eupl
cecill | 1 | 0.9 | this software is governed by the cecill(?: [abc])? licen[sc]e
ms-pl | 1 | 0.9 | this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e
upl-1 | 1 | 0.9 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software
bsl-1.1 | 1 | 0.9 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
sspl-1 | 1 | 0.9 | server side public licen[sc]e
elastic-2 | 1 | 0.9 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 1 | 0.9 | commons clause licen[sc]e condition
polyform-nc | 1 | 0.9 | polyform noncommercial licen[sc]e
polyform-shield | 1 | 0.9 | polyform shield licen[sc]e
prosperity | 1 | 0.9 | prosperity public licen[sc]e
parity | 1 | 0.9 | parity public licen[sc]e
hippocratic | 1 | 0.9 | hippocratic licen[sc]e
json | 1 | 0.9 | the software shall be used for good not evil
unicode | 1 | 0.9 | unicode licen[sc]e agreement data files and software
icu | 1 | 0.8 | icu licen[sc]e
vim | 1 | 0.9 | vim is charityware
mulan-2 | 1 | 0.9 | you can use this software according to the terms and conditions of the mulan psl v2
openrail | 1 | 0.8 | (?:creativeml )?open ?rail(?: [a-z]{1,3})? licen[sc]e
llama | 1 | 0.8 | llama [1-4](?: [0-9])? community licen[sc]e
gemma | 1 | 0.8 | gemma terms of use
proprietary | 2 | 0.7 | this (?:software|document|file) (?:is|contains) (?:the )?(?:confidential and )?proprietary (?:information )?(?:of|to)
proprietary | 2 | 0.7 | unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|work|software)(?: [a-z]+){0,8} is (?:strictly )?prohibited
proprietary | 2 | 0.6 | may not be reproduced (?:distributed )?(?:or transmitted )?in any form (?:or by any means )?without (?:the )?(?:express |prior )?(?:written )?permission
no-commercial | 2 | 0.6 | for non ?commercial (?:use|purposes|research) only
research-only | 2 | 0.6 | for (?:academic|research) (?:use|purposes) only
freeware | 3 | 0.4 | (?:is|as) freeware
shareware | 3 | 0.4 | (?:is|as) shareware
public-domain | 2 | 0.7 | this (?:work|file|software|document|image) is (?:in|hereby in) the public domain
public-domain | 2 | 0.7 | united states government work and is not subject to copyright
copyleft | 3 | 0.3 | some rights reserved
see-file | 3 | 0.2 | see (?:the )?(?:file )?(?:licen[sc]e|copying) (?:file )?for (?:licen[sc]ing )?(?:details|terms|information)
"""
RULE = "array<struct<label:string,priority:int,confidence:double,keywords:array<string>,pattern:string>>"
SPANS = "array<struct<start:int,stop:int>>"


def _strings(part, most: int = 64) -> set[str] | None:
    """All strings that a piece of a parsed expression matches, None if there are more than `most`. Looking around takes no signs."""
    kind, what = part
    if kind is syntax.LITERAL:
        return {chr(what)}
    if kind is syntax.IN:
        found = set()
        for k, x in what:
            if k not in (syntax.LITERAL, syntax.RANGE):
                return None
            found |= {chr(c) for c in (range(x[0], x[1] + 1) if k is syntax.RANGE else [x])}
        return found if len(found) <= 8 else None
    if kind in (syntax.ASSERT, syntax.ASSERT_NOT):
        return {""}
    if kind is syntax.SUBPATTERN:
        choices = [what[3]]
    elif kind is syntax.BRANCH:
        choices = what[1]
    elif kind is syntax.MAX_REPEAT and what[:2] == (0, 1):
        choices = [what[2], []]
    else:
        return None
    found = set()
    for choice in choices:
        own = {""}
        for x in choice:
            more = _strings(x, most)
            if more is None or len(own) * len(more) > most:
                return None
            own = {a + b for a, b in product(own, more)}
        found |= own
    return found if len(found) <= most else None


def _least(found: set[str]) -> set[str]:
    """The strings that hold no other one."""
    return {x for x in found if not any(y != x and y in x for y in found)}


def needed(pattern: str, most: int = 8) -> set[str]:
    """At most `most` strings one of which every match of the pattern (with a blank before it) holds: the longest such."""
    best, run = {""}, {" "}
    for part in syntax.parse(pattern):
        own = _strings(part)
        if own is None or len(run) * len(own) > 64:
            run = own or {""}
        else:
            run = {a + b for a, b in product(run, own)}
        least = _least(run)
        if len(least) <= most and min(map(len, least)) > min(map(len, best)):
            best = least
    return best


def rules() -> list[dict]:
    """All rules: each family in each form, and the other signatures."""
    made = []
    for line in FAMILIES.strip().splitlines():
        label, name = (x.strip() for x in line.split(" | "))
        for priority, confidence, form in FORMS:
            made.append({"label": label, "priority": priority, "confidence": confidence, "keywords": sorted(needed(name)), "pattern": f"(?<= )(?:{form.format(name)})(?= )"})
    for line in (OTHERS + TEXTS).strip().replace("\n\n", "\n").splitlines():
        label, priority, confidence, pattern = (x.strip() for x in line.split(" | "))
        made.append({"label": label, "priority": int(priority), "confidence": float(confidence), "keywords": sorted(needed(pattern)), "pattern": f"(?<= ){pattern}(?= )"})
    return made


def gate() -> str:
    """What a line of words must hold to be looked at: the words that a form, another signature or a base phrase needs, as a tree of their letters."""
    lines = (OTHERS + TEXTS).strip().replace("\n\n", "\n").splitlines()
    runs = set().union(*(needed(form.replace("{}", "[a-z]*"), 32) for _, _, form in FORMS), *(needed(line.split(" | ")[3].strip(), 32) for line in lines), *(needed(p) for p in BASE))
    runs = sorted(x.removesuffix(" ") for x in _least(runs))
    if not all(x.startswith(" ") and len(x) > 3 for x in runs):
        raise ValueError(f"a rule needs no word: {runs}")
    return _tree(runs)


def _tree(strings: list[str]) -> str:
    """An expression for any of the strings that takes each letter once."""
    if "" in strings:
        return ""
    if len(strings) == 1:
        return syntax_escape(strings[0])
    branches = [syntax_escape(first) + _tree(sorted(x[1:] for x in own)) for first, own in _by_first(strings)]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _by_first(strings: list[str]) -> list[tuple[str, list[str]]]:
    groups: dict[str, list[str]] = {}
    for x in strings:
        groups.setdefault(x[0], []).append(x)
    return list(groups.items())


def syntax_escape(x: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in x)


def _blanks(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))


def spans(line: Column, pattern: Column) -> Column:
    """The word intervals (stop excluded) of a pattern's matches in blank-joined words with a blank at both ends."""

    def walk(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda v, i: _blanks(v) + _blanks(F.get(between, i)))
        one = lambda stops: lambda v, i: F.struct((F.get(stops, i) - _blanks(v) - 1).alias("start"), F.get(stops, i).alias("stop"))
        return let(running(steps, "int", lambda x, y: x + y), lambda stops: F.transform(found, one(stops)).cast(SPANS))

    found = F.regexp_extract_all(line, pattern, F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(SPANS)).otherwise(let(F.split(line, pattern, -1), lambda p: walk(m, p))))


def _unsuppressed(found: Column) -> Column:
    """Detections (start, back = -stop, priority, label, confidence), ordered, without those inside an earlier one of no lower priority."""
    ends = lambda own, p: running(F.transform(own, lambda d: F.when(d["priority"] <= p, -d["back"]).otherwise(-1)), "int", F.greatest)

    def kept(own: Column, reach: Column) -> Column:
        over = lambda d, i: before(F.get(reach, d["priority"] - 1), i, -1)
        return F.filter(own, lambda d, i: over(d, i) < -d["back"])

    return let(F.array_sort(found), lambda own: let(F.array(*(ends(own, p) for p in (1, 2, 3))), lambda reach: kept(own, reach)))


def detect(docs: DataFrame, prefilter: bool = True) -> DataFrame:
    """doc_id, n_words, base (phrase places: start, label) and found (kept detections) of documents(doc_id, text).

    Gate and keywords save work only; without `prefilter` every rule is run on every text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(words(F.col("text").cast("string")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("line"))).alias("_w"))
    line = F.col("_w.line")
    rows = rows.select("doc_id", F.col("_w.n").alias("n_words"), (F.when(F.rlike(line, F.lit(gate())), line) if prefilter else line).alias("_line"))
    phrases = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(label).alias("label")) for p, label in BASE.items()))
    base = F.flatten(F.transform(phrases, lambda b: F.transform(spans(F.col("_line"), F.concat(F.lit("(?<= )"), b["phrase"], F.lit("(?= )"))), lambda s: F.struct(s["start"].alias("start"), b["label"].alias("label")))))
    table = F.from_json(F.lit(json.dumps(rules())), RULE)
    usable = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("_line"), k))) if prefilter else table
    found = F.flatten(F.transform(usable, lambda r: F.transform(spans(F.col("_line"), r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    none = F.array().cast("array<struct<start:int,label:string>>")
    rows = rows.select("doc_id", "n_words", F.coalesce(F.when(F.col("_line").isNotNull(), base), none).alias("base"), F.when(F.col("_line").isNotNull(), found).alias("_found"))
    kept = F.when(F.size("_found") > 0, _unsuppressed(F.col("_found")))
    return rows.select("doc_id", "n_words", "base", F.coalesce(kept, F.array().cast("array<struct<start:int,back:int,priority:int,label:string,confidence:double>>")).alias("found"))
