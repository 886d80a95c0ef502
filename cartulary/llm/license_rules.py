"""License signatures: phrases over normalised words and what they say.

A rule is a regular expression over text of lower-case words with single spaces
between.  It has a keyword (a word without which it can't match), a priority and
a score.  SIGNATURES are written by hand, one for each wording; names with versions
are built from families, versions and forms.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


#: Fixed values: (label, keyword, name, versions).
FAMILIES = (
    ("gpl", "gnu", "gnu general public license", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public license", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", "affero", "(?:gnu )?affero general public license", ("1", "1 0", "3", "3 0")),
    ("gfdl", "gnu", "gnu free documentation license", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache (?:software )?license", ("1 0", "1 1", "2", "2 0")),
    ("mpl", "mozilla", "mozilla public license", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public license", ("1 0", "2 0")),
    ("cddl", "development", "common development and distribution license", ("1 0", "1 1")),
    ("cpl", "common", "common public license", ("1 0",)),
    ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("bsl", "boost", "boost software license", ("1 0",)),
    ("afl", "academic", "academic free license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "open", "open software license", ("1 0", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", "artistic license", ("1 0", "2 0")),
    ("ofl", "font", "(?:sil )?open font license", ("1 0", "1 1")),
    ("odbl", "database", "open database license", ("1 0",)),
    ("ms-pl", "microsoft", "microsoft (?:public|reciprocal) license", ("1 0",)),
    ("psf", "python", "python software foundation license", ("2",)),
    ("lppl", "latex", "latex project public license", ("1 0", "1 1", "1 2", "1 3")),
    ("zpl", "zope", "zope public license", ("1 1", "2 0", "2 1")),
    ("cc-by", "attribution", "creative commons attribution license", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike license", ("1 0", "2 0", "2 5", "3 0", "4 0")),
)
#: Conditions of "cc by" licenses.
CC_PARTS = ("sa", "nc", "nd", "nc sa", "nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Forms of a name with a version, and what a suffix adds to a label.
FORMS = ("{name} version {v}", "{name} v ?{v}", "{name} {v}", "version {v} of the {name}")
SUFFIXES = (("", "", 2), ("-or-later", " or (?:at your option )?(?:any )?later(?: version)?", 3), ("-only", " only", 3))
#: Base phrases and labels; their places are counted and their labels always stay.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: A raw text in which none of these stands, lower-cased, and no "cc ... by" has no match of any rule.
ANCHORS = (
    "licen", "cc0", "permission", "redistribut", "domain", "rights", "proprietary", "copyright", "warrant", "liable", "copyleft", "sublicens", "confidential", "trademark", "patent", "distributed",
    "misrepresent", "acknowledg", "openssl", "apache", "derivative", "consortium", "interacting", "perl", "evil", "reserved", "commercial", "creativecommons",
)
CC_BY = r"(?i)cc[^0-9A-Za-z\x{80}-\x{10FFFF}]+by"
#: Score of a base place, and of a hand-written signature by its priority.
BASE_SCORE = 0.9
SCORES = {1: 0.6, 2: 0.8, 3: 0.95}

#: Hand-written signatures: label, keyword, priority (1 a name or a hint, 2 a notice or a
#: grant, 3 an exact identifier or a whole clause) and the wording.
SIGNATURES = """
mit            ; mit         ; 1 ; mit license
mit            ; mit         ; 2 ; (?:released|licensed|distributed|available) under the (?:terms of the )?mit license
mit            ; mit         ; 2 ; the mit license mit
mit            ; expat       ; 1 ; expat license
mit            ; mit         ; 3 ; spdx license identifier mit
mit            ; granted     ; 2 ; permission is hereby granted free of charge to any person obtaining a copy
mit            ; granted     ; 3 ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit            ; sublicense  ; 2 ; to use copy modify merge publish distribute sublicense and or sell copies of the software
mit            ; permission  ; 2 ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0          ; attribution ; 2 ; mit no attribution license
x11            ; x11         ; 1 ; x11 license
x11            ; consortium  ; 2 ; except as contained in this notice the name of the x consortium shall not be used in advertising
isc            ; isc         ; 1 ; isc license
isc            ; isc         ; 3 ; spdx license identifier isc
isc            ; fee         ; 2 ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc            ; author      ; 2 ; the software is provided as is and the author disclaims all warranties with regard to this software
0bsd           ; zero        ; 1 ; (?:bsd zero clause|zero clause bsd) license
0bsd           ; 0bsd        ; 3 ; spdx license identifier 0bsd
bsd            ; bsd         ; 1 ; bsd license
bsd            ; bsd         ; 2 ; (?:released|licensed|distributed) under (?:the|a) bsd (?:style )?license
bsd            ; redistribution ; 2 ; redistribution and use in source and binary forms with or without modification are permitted
bsd            ; redistributions ; 2 ; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd            ; redistributions ; 2 ; redistributions in binary form must reproduce the above copyright notice
bsd            ; contributors ; 2 ; this software is provided by the (?:copyright holders|regents) and contributors as is
bsd-2-clause   ; bsd         ; 1 ; (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd style bsd) license
bsd-2-clause   ; bsd         ; 3 ; spdx license identifier bsd 2 clause
bsd-3-clause   ; bsd         ; 1 ; (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license
bsd-3-clause   ; bsd         ; 3 ; spdx license identifier bsd 3 clause
bsd-3-clause   ; endorse     ; 3 ; may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause   ; bsd         ; 1 ; (?:bsd 4 clause|4 clause bsd|original bsd|old bsd) license
bsd-4-clause   ; advertising ; 3 ; all advertising materials mentioning features or use of this software must display the following acknowledgement
zlib           ; zlib        ; 1 ; zlib license
zlib           ; zlib        ; 1 ; zlib libpng license
zlib           ; express     ; 2 ; this software is provided as is without any express or implied warranty
zlib           ; misrepresented ; 3 ; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib           ; altered     ; 2 ; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
ncsa           ; ncsa        ; 1 ; ncsa (?:open source )?license
unlicense      ; unlicense   ; 1 ; the unlicense
unlicense      ; unlicense   ; 3 ; spdx license identifier unlicense
unlicense      ; unencumbered ; 2 ; this is free and unencumbered software released into the public domain
wtfpl          ; want        ; 1 ; do what the fuck you want to public license
wtfpl          ; wtfpl       ; 1 ; wtfpl license
beerware       ; beerware    ; 1 ; (?:the )?beerware license
beerware       ; beer        ; 1 ; the beer ware license
apache         ; apache      ; 1 ; apache license
apache         ; apache      ; 2 ; (?:released|licensed|distributed|available) under the (?:terms of the )?apache license
apache         ; asf         ; 2 ; licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0     ; apache      ; 3 ; licensed under the apache license version 2 0 the license
apache-2.0     ; apache      ; 3 ; spdx license identifier apache 2 0
apache-2.0     ; compliance  ; 2 ; you may not use this file except in compliance with the license
apache-2.0     ; apache      ; 2 ; you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0     ; warranties  ; 1 ; distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0     ; perpetual   ; 3 ; grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
apache-2.0     ; patent      ; 3 ; irrevocable except as stated in this section patent license to make have made use offer to sell sell import
apache-1.1     ; apache      ; 2 ; this product includes software developed by the apache software foundation http www apache org
llvm-exception ; llvm        ; 3 ; apache license (?:v2 0|2 0) with llvm (?:exception|exceptions)
gpl            ; gpl         ; 1 ; gpl (?:license|licensed)
gpl            ; gnu         ; 1 ; gnu gpl license
gpl            ; gnu         ; 2 ; (?:released|licensed|distributed) under the (?:terms of the )?gnu general public license
gpl            ; redistribute ; 2 ; you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl            ; merchantability ; 1 ; without even the implied warranty of merchantability or fitness for a particular purpose
gpl            ; gnu         ; 2 ; you should have received a copy of the gnu general public license along with this program
gpl            ; freedom     ; 2 ; the licenses for most software are designed to take away your freedom to share and change it
gpl            ; copies      ; 1 ; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl            ; copyleft    ; 1 ; (?:strong )?copyleft license
gpl-2.0-only   ; gpl         ; 3 ; spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later ; gpl       ; 3 ; spdx license identifier gpl 2 0 or later
gpl-3.0-only   ; gpl         ; 3 ; spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later ; gpl       ; 3 ; spdx license identifier gpl 3 0 or later
gpl-2.0        ; gplv2       ; 1 ; gplv2(?: license| licensed)
gpl-3.0        ; gplv3       ; 1 ; gplv3(?: license| licensed)
gpl-classpath  ; classpath   ; 3 ; licensed with (?:the )?classpath exception
gpl-linking    ; exception   ; 2 ; as a special exception the copyright holders (?:of this library )?give you permission to link this library
gpl-linking    ; linking     ; 2 ; linking exception to the license
lgpl           ; lgpl        ; 1 ; lgpl (?:license|licensed)
lgpl           ; lesser      ; 2 ; under the terms of the gnu lesser general public license as published by the free software foundation
lgpl           ; library     ; 2 ; under the terms of the gnu library general public license as published by the free software foundation
lgpl           ; lesser      ; 2 ; you should have received a copy of the gnu lesser general public license along with this library
lgpl-2.1       ; lgpl        ; 3 ; spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0       ; lgpl        ; 3 ; spdx license identifier lgpl 3 0(?: only| or later)?
agpl           ; agpl        ; 1 ; agpl (?:license|licensed)
agpl           ; affero      ; 2 ; under the terms of the gnu affero general public license as published by the free software foundation
agpl-3.0       ; agpl        ; 3 ; spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0       ; interacting ; 2 ; all users interacting with it remotely through a computer network an opportunity to receive the corresponding source
gfdl           ; invariant   ; 2 ; with no invariant sections no front cover texts and no back cover texts a copy of the license
gfdl           ; documentation ; 2 ; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl            ; mpl         ; 1 ; mpl (?:license|licensed)
mpl-1.1        ; mozilla     ; 3 ; the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0        ; mozilla     ; 3 ; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0        ; mpl         ; 3 ; spdx license identifier mpl 2 0
mpl-2.0        ; mpl         ; 2 ; if a copy of the mpl was not distributed with this file you can obtain one at
npl            ; netscape    ; 1 ; netscape public license
epl            ; eclipse     ; 2 ; this program and the accompanying materials are made available under the terms of the eclipse public license
epl-1.0        ; epl         ; 3 ; spdx license identifier epl 1 0
epl-2.0        ; epl         ; 3 ; spdx license identifier epl 2 0
edl-1.0        ; eclipse     ; 1 ; eclipse distribution license
cddl           ; cddl        ; 1 ; cddl (?:license|licensed)
cddl-1.0       ; cddl        ; 3 ; spdx license identifier cddl 1 0
ipl            ; ibm         ; 1 ; ibm public license
eupl           ; eupl        ; 2 ; licensed under the eupl
bsl-1.0        ; boost       ; 2 ; distributed under the boost software license
bsl-1.0        ; bsl         ; 3 ; spdx license identifier bsl 1 0
bsl-1.0        ; machine     ; 2 ; unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
busl-1.1       ; business    ; 1 ; business source license(?: 1 1)?
busl-1.1       ; change      ; 2 ; change license means the license
sspl           ; server      ; 1 ; server side public license
elastic        ; elastic     ; 1 ; elastic license(?: 2 0)?
commons-clause ; clause      ; 2 ; commons clause license condition
polyform       ; polyform    ; 1 ; polyform (?:noncommercial|small business|shield|perimeter) license
confluent      ; confluent   ; 1 ; confluent community license
redis          ; redis       ; 1 ; redis source available license
fsl            ; functional  ; 1 ; functional source license
perl           ; perl        ; 2 ; under the same terms as perl itself
psf            ; psf         ; 1 ; psf license agreement
python-cnri    ; cnri        ; 1 ; cnri (?:open source )?(?:python )?license agreement
php            ; php         ; 1 ; php license(?: version 3 0 1)?
ruby           ; ruby        ; 1 ; ruby license
openssl        ; openssl     ; 1 ; openssl license
openssl        ; openssl     ; 2 ; this product includes software developed by the openssl project for use in the openssl toolkit
ssleay         ; ssleay      ; 1 ; ssleay license
curl           ; curl        ; 1 ; curl license
vim            ; vim         ; 1 ; vim license
tcl            ; tcl         ; 1 ; tcl tk license
ijg            ; jpeg        ; 1 ; independent jpeg group license
libpng         ; libpng      ; 1 ; libpng license
libtiff        ; libtiff     ; 1 ; libtiff license
freetype       ; freetype    ; 1 ; freetype (?:project )?license
icu            ; icu         ; 1 ; icu license
unicode        ; unicode     ; 1 ; unicode (?:inc )?license agreement
intel          ; intel       ; 1 ; intel open source license
nasa           ; nasa        ; 1 ; nasa open source agreement license
w3c            ; w3c         ; 1 ; w3c software (?:notice and )?license
postgresql     ; postgresql  ; 1 ; postgresql license
postgresql     ; paragraphs  ; 2 ; provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
sleepycat      ; sleepycat   ; 1 ; sleepycat license
qpl            ; q           ; 1 ; q public license
watcom         ; watcom      ; 1 ; sybase open watcom public license
upl            ; universal   ; 1 ; universal permissive license
mulan          ; mulan       ; 1 ; mulan (?:permissive software|psl) license
ecl            ; educational ; 1 ; educational community license
blueoak        ; blue        ; 1 ; blue oak model license
hippocratic    ; hippocratic ; 1 ; hippocratic license
json           ; evil        ; 2 ; the software shall be used for good not evil
ofl            ; ofl         ; 1 ; ofl (?:license|licensed)
ofl-1.1        ; ofl         ; 3 ; spdx license identifier ofl 1 1
ofl            ; reserved    ; 2 ; with reserved font name
odbl           ; odbl        ; 1 ; odbl (?:license|licensed)
odc-by         ; commons     ; 1 ; open data commons attribution license
pddl           ; dedication  ; 1 ; public domain dedication and license
cdla           ; community   ; 1 ; community data license agreement
ogl            ; government  ; 1 ; open government licen[cs]e
etalab         ; etalab      ; 1 ; (?:licence ouverte|open licence) etalab
dl-de          ; datenlizenz ; 1 ; datenlizenz deutschland licen[cs]e
openrail       ; openrail    ; 1 ; (?:creativeml |bigscience |bigcode )?openrail(?: m)? license
llama          ; llama       ; 1 ; llama (?:2 |3 )?community license agreement
cc             ; commons     ; 1 ; creative commons license
cc             ; commons     ; 2 ; this work is licensed under a creative commons
cc             ; creativecommons ; 2 ; to view a copy of this license visit http creativecommons org
cc-by          ; attribution ; 2 ; creative commons attribution(?: 4 0)? international license
cc-by-sa       ; attribution ; 2 ; creative commons attribution share ?alike(?: 4 0)? international license
cc-by-nc       ; attribution ; 2 ; creative commons attribution non ?commercial(?: 4 0)? international license
cc-by-nd       ; attribution ; 2 ; creative commons attribution no ?derivatives(?: 4 0)? international license
cc-by-nc-sa    ; attribution ; 2 ; creative commons attribution non ?commercial share ?alike(?: 4 0)? international license
cc-by-nc-nd    ; attribution ; 2 ; creative commons attribution non ?commercial no ?derivatives(?: 4 0)? international license
cc0            ; cc0         ; 1 ; cc0(?: 1 0)?(?: universal)?
cc0            ; cc0         ; 3 ; spdx license identifier cc0 1 0
cc0            ; waived      ; 2 ; has waived all copyright and related or neighboring rights
public-domain  ; domain      ; 1 ; (?:released into|in) the public domain
public-domain  ; dedicated   ; 2 ; (?:is|are) (?:hereby )?dedicated to the public domain
public-domain  ; domain      ; 2 ; placed in the public domain by (?:its|the) (?:author|authors)
proprietary    ; rights      ; 1 ; all rights reserved
proprietary    ; proprietary ; 1 ; proprietary (?:and confidential|license)
proprietary    ; confidential ; 2 ; (?:this document|this file|this software) is confidential
proprietary    ; unauthorized ; 2 ; unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential
proprietary    ; secrets     ; 2 ; contains (?:confidential )?trade secrets and proprietary information
proprietary    ; reproduced  ; 2 ; no part of this (?:publication|work|document) may be reproduced without (?:the )?(?:prior )?written permission
eula           ; end         ; 1 ; end user license agreement
commercial     ; commercial  ; 1 ; commercial license
non-commercial ; commercial  ; 2 ; for non commercial (?:use|purposes) only
shareware      ; shareware   ; 1 ; shareware license
copyright      ; copyright   ; 1 ; copyright (?:c )?(?:19|20)[0-9][0-9]
trademark      ; trademark   ; 1 ; is a registered trademark of
patent         ; patent      ; 1 ; (?:royalty free )?patent license
disclaimer     ; liable      ; 1 ; in no event shall the (?:authors|author|copyright owner|copyright holders|copyright holder) (?:or contributors )?be liable
disclaimer     ; warranty    ; 1 ; the software is provided as is without warranty of any kind express or implied
"""


def signatures() -> list[Rule]:
    """SIGNATURES as rules."""
    rows = [[cell.strip() for cell in line.split(";")] for line in SIGNATURES.strip().splitlines()]
    return [Rule(label, key, pattern, int(priority), SCORES[int(priority)]) for label, key, priority, pattern in rows]


def rules() -> list[Rule]:
    """All rules, in order of label, priority and pattern."""
    out = signatures()
    own = {r.pattern for r in out}
    for label, key, name, versions in FAMILIES:
        out.append(Rule(label, key, name, 1, 0.7))
        for v in versions:
            number = v.replace(" ", ".")
            for form in FORMS:
                for more, suffix, priority in SUFFIXES:
                    out.append(Rule(f"{label}-{number}{more}", key, form.format(name=name, v=v) + suffix, priority, 0.8 + 0.1 * (priority == 3)))
    for parts in CC_PARTS:
        label = "cc-by-" + parts.replace(" ", "-")
        out.append(Rule(label, "cc", f"cc by {parts}", 2, 0.8))
        out += [Rule(f"{label}-{v.replace(' ', '.')}", "cc", f"cc by {parts} {v}", 3, 1.0) for v in CC_VERSIONS]
    out += [Rule(f"cc-by-{v.replace(' ', '.')}", "cc", f"cc by {v}", 3, 1.0) for v in CC_VERSIONS]
    return sorted(r for i, r in enumerate(out) if i < len(own) or r.pattern not in own)
