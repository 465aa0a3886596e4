"""Signature rules of licence statements: `label | regular expression`, in order of priority.

A rule is tried only where one of its keywords occurs. Keywords are read off the expression: a piece of a word that every
match contains, or one for each of its alternatives. Texts are lower case, so rules are; `_` in a rule stands for any run
of characters that aren't part of words, and a rule begins and ends at a word's border. Families name their versions once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _parser

_GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

#: Whole notices and exact identifiers, which outrank names, which outrank mentions.
_NOTICES = """
mit | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files
mit-0 | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software[^.]{0,80}without restriction[^.]{0,200}without limitation
isc | permission to use,? copy,? modify,? and\\/?(?:or)? distribute this software for any purpose with or without fee is hereby granted
x11 | permission is hereby granted[^.]{0,300}except as contained in this notice,? the name of the x consortium
hpnd | permission to use,? copy,? modify and distribute this software and its documentation for any purpose
ntp | permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose with or without fee
bsd-4-clause | all advertising materials mentioning features or use of this software must display
bsd-3-clause | neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd-2-clause | redistributions? in binary form must reproduce the above copyright notice
bsd | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause-clear | no express or implied licenses to any party'?s patent rights are granted
apache-2.0 | licensed under the apache_licen[cs]e_version_2(?:_0)?
apache-2.0 | you may not use this file except in compliance with the license
apache-1.1 | this product includes software developed by the apache software foundation
gpl-3.0-or-later | gnu_general_public_licen[cs]e as published by the free software foundation.{0,40}version_3.{0,60}any later version
gpl-2.0-or-later | gnu_general_public_licen[cs]e as published by the free software foundation.{0,40}version_2.{0,60}any later version
gpl-3.0-only | gnu_general_public_licen[cs]e as published by the free software foundation.{0,20}version_3(?!.{0,60}later)
gpl-2.0-only | gnu_general_public_licen[cs]e as published by the free software foundation.{0,20}version_2(?!.{0,60}later)
lgpl-3.0-or-later | gnu_lesser_general_public_licen[cs]e as published by the free software foundation.{0,40}version_3.{0,60}any later version
lgpl-2.1-or-later | gnu_lesser_general_public_licen[cs]e as published by the free software foundation.{0,40}version_2_1.{0,60}any later version
lgpl-2.0-or-later | gnu_library_general_public_licen[cs]e as published by the free software foundation.{0,40}version_2.{0,60}any later version
agpl-3.0-or-later | gnu_affero_general_public_licen[cs]e as published by the free software foundation.{0,40}version_3.{0,60}any later version
gfdl | permission is granted to copy,? distribute and\\/?(?:or)? modify this document under the terms of the gnu_free_documentation_licen[cs]e
mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[cs]e,? v(?:ersion)?_?2_0
mpl-1.1 | the contents of this file are subject to the mozilla public licen[cs]e version_1_1
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e_(?:v_?)?2_0
epl-1.0 | made available under the terms of the eclipse public licen[cs]e_v?1_0
cddl-1.0 | subject to the terms of the common development and distribution licen[cs]e
zlib | this software is provided_as_is_without any express or implied warranty.{0,120}held liable for any damages
bsl-1.0 | boost software licen[cs]e_version_1_0
unlicense | this is free and unencumbered software released into the public domain
cc0-1.0 | to the extent possible under law.{0,80}waived all copyright
wtfpl | do what the f[*u]ck you want to public licen[cs]e
beerware | the beer_ware licen[cs]e
json | the software shall be used for good,? not evil
postgresql | permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee,? and without a written agreement
ofl-1.1 | this font software is licensed under the sil open font licen[cs]e,?_version_1_1
python-2.0 | python software foundation licen[cs]e_version_2
curl | permission to use,? copy,? modify,? and distribute this software for any purpose with or without fee.{0,200}daniel stenberg
openssl | this product includes software developed by the openssl project
php-3.01 | the php licen[cs]e_version_3_01
vim | vim licen[cs]e
proprietary | all_rights_reserved
proprietary | this (?:software|material|document) is (?:the )?(?:confidential and )?proprietary
"""

_NAMES = """
afl-3.0 | academic free licen[cs]e_(?:version_|v_?)?3_0
apsl-2.0 | apple public source licen[cs]e_(?:version_|v_?)?2_0
artistic-1.0 | artistic licen[cs]e_(?:version_|v_?)?1_0
artistic-2.0 | artistic licen[cs]e_(?:version_|v_?)?2_0
artistic | artistic licen[cs]e
blueoak-1.0.0 | blue oak model licen[cs]e
bsd-0-clause | (?:bsd_zero_clause|zero_clause_bsd|0bsd)
bsd-1-clause | (?:bsd_1_clause|1_clause_bsd)
bsd-2-clause | (?:bsd_2_clause|2_clause_bsd|simplified_bsd|freebsd_licen[cs]e)
bsd-3-clause | (?:bsd_3_clause|3_clause_bsd|new_bsd|modified_bsd|revised_bsd)
bsd-4-clause | (?:bsd_4_clause|4_clause_bsd|original_bsd)
bsd-2-clause-patent | bsd_2_clause_plus_patent
bsd | (?:bsd_style_licen[cs]e|bsd_licen[cs]ed?)
bsl-1.0 | boost software licen[cs]e
busl-1.1 | business source licen[cs]e
cal-1.0 | cryptographic autonomy licen[cs]e
cc0-1.0 | cc0(?:_1_0)?
cc0-1.0 | creative commons_zero
cecill-2.1 | cecill_(?:v_?)?2_1
cecill-b | cecill_b
cecill-c | cecill_c
cecill | cecill
cpal-1.0 | common public attribution licen[cs]e
cpl-1.0 | common public licen[cs]e
ecl-2.0 | educational community licen[cs]e
elastic-2.0 | elastic licen[cs]e_(?:version_|v_?)?2(?:_0)?
elastic | elastic licen[cs]e
etalab-2.0 | (?:etalab|licence ouverte)
eupl-1.2 | european union public licen[cs]e_(?:version_|v_?)?1_2
eupl-1.1 | european union public licen[cs]e_(?:version_|v_?)?1_1
eupl | european union public licen[cs]e
fsl-1.1 | functional source licen[cs]e
gfdl | gnu_free_documentation_licen[cs]e
imagemagick | imagemagick licen[cs]e
ipl-1.0 | ibm public licen[cs]e
isc | isc licen[cs]ed?
lppl-1.3c | latex project public licen[cs]e
mit-0 | mit_no_attribution
mit | (?:mit_licen[cs]ed?|licen[cs]ed? under (?:the )?mit|expat licen[cs]e)
ms-pl | microsoft public licen[cs]e
ms-rl | microsoft reciprocal licen[cs]e
mulan-psl-2.0 | mulan (?:psl|permissive software licen[cs]e)
ncsa | (?:ncsa|university of illinois)_open source licen[cs]e
npl-1.1 | netscape public licen[cs]e
nasa-1.3 | nasa open source agreement
odbl-1.0 | (?:open data commons )?open database licen[cs]e
odc-by-1.0 | open data commons attribution licen[cs]e
pddl-1.0 | public domain dedication and licen[cs]e
ofl-1.1 | (?:sil )?open font licen[cs]e
ogl-uk-3.0 | open government licen[cs]e
osl-3.0 | open software licen[cs]e_(?:version_|v_?)?3_0
opl-1.0 | open publication licen[cs]e
polyform-noncommercial | polyform noncommercial licen[cs]e
postgresql | postgresql licen[cs]e
psf-2.0 | (?:psf|python software foundation)_licen[cs]e
qpl-1.0 | q public licen[cs]e
rail | (?:openrail|responsible ai licen[cs]e|open rail)
ruby | ruby licen[cs]e
sspl-1.0 | server side public licen[cs]e
sleepycat | sleepycat licen[cs]e
unicode-dfs | unicode(?:_inc)? licen[cs]e
unlicense | (?:the_)?unlicense
upl-1.0 | universal permissive licen[cs]e
vsl-1.0 | vovida software licen[cs]e
w3c | w3c software (?:notice and )?licen[cs]e
wtfpl | wtfpl
zlib | (?:zlib(?:_libpng)?_licen[cs]e)
zpl-2.1 | zope public licen[cs]e
llama | llama_(?:2|3)?_?community licen[cs]e
gemma | gemma terms of use
public-domain | (?:released|placed|dedicated)?_?(?:in|into|to) the public domain
"""

#: family, name in texts, versions, suffixes: one rule for each version and suffix, exact before general.
_FAMILIES = [
    ("gpl", r"gnu_general_public_licen[cs]e", ("1", "2", "3"), True),
    ("gpl", r"(?:gnu_)?gpl", ("1", "2", "3"), True),
    ("lgpl", r"gnu_(?:lesser|library)_general_public_licen[cs]e", ("2", "2.1", "3"), True),
    ("lgpl", r"(?:gnu_)?lgpl", ("2", "2.1", "3"), True),
    ("agpl", r"(?:gnu_)?affero_general_public_licen[cs]e", ("1", "3"), True),
    ("agpl", r"(?:gnu_)?agpl", ("1", "3"), True),
    ("gfdl", r"(?:gnu_)?gfdl", ("1.1", "1.2", "1.3"), True),
    ("apache", r"apache(?:_software)?_licen[cs]e", ("1.0", "1.1", "2.0"), False),
    ("apache", r"apache", ("1.0", "1.1", "2.0"), False),
    ("mpl", r"mozilla_public_licen[cs]e", ("1.0", "1.1", "2.0"), False),
    ("mpl", r"mpl", ("1.0", "1.1", "2.0"), False),
    ("epl", r"eclipse_public_licen[cs]e", ("1.0", "2.0"), False),
    ("epl", r"epl", ("1.0", "2.0"), False),
    ("cddl", r"cddl", ("1.0", "1.1"), False),
    ("eupl", r"eupl", ("1.0", "1.1", "1.2"), False),
    ("osl", r"open_software_licen[cs]e", ("1.0", "2.0", "2.1", "3.0"), False),
    ("php", r"php_licen[cs]e", ("3.0", "3.01"), False),
]
#: Creative Commons: the parts in texts by label; each with every version and without.
_CC_PARTS = {
    "by-nc-sa": (r"by_nc_sa", r"attribution_non_?commercial_share_?alike"),
    "by-nc-nd": (r"by_nc_nd", r"attribution_non_?commercial_no_?deriv(?:ative)?s?(?:_works)?"),
    "by-nc": (r"by_nc", r"attribution_non_?commercial"),
    "by-nd": (r"by_nd", r"attribution_no_?deriv(?:ative)?s?(?:_works)?"),
    "by-sa": (r"by_sa", r"attribution_share_?alike"),
    "by": (r"by", r"attribution"),
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    priority: int
    weight: float


def _compiled(body: str) -> re.Pattern[bytes]:
    body = body.replace("_?", f"(?:{_GAP})?").replace("_", _GAP).replace(" ", r"\s+")
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + body.encode() + rb")(?![0-9a-z\x80-\xff])", re.DOTALL)


def _keywords(parsed: Iterable) -> tuple[bytes, ...]:
    """Pieces of words of which every match of a parsed expression contains one; empty if there are none. Of several such
    sets, the one whose shortest piece is longest."""
    found: list[tuple[bytes, ...]] = []
    run = b""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += bytes([value])
            continue
        found, run = [*found, (run,)] if run else found, b""
        if op is _parser.SUBPATTERN:
            found.append(_keywords(value[-1]))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0]:
            found.append(_keywords(value[2]))
        elif op is _parser.BRANCH:
            each = [_keywords(x) for x in value[1]]
            found.append(tuple(sorted({k for ks in each for k in ks})) if all(each) else ())
    return max(filter(None, found), key=lambda ks: min(map(len, ks)), default=())


def _rules() -> list[Rule]:
    found: list[tuple[str, str, float]] = []

    def listed(text: str, weight: float) -> None:
        found.extend((*(x.strip() for x in line.split(" | ", 1)), weight) for line in text.strip().split("\n"))

    listed(_NOTICES, 1.0)
    number = lambda v: v.replace(".", "_?") + ("(?:_?0)?" if "." not in v else "")
    for family, name, versions, later in _FAMILIES:
        for v in sorted(versions, key=float, reverse=True):
            full = v if "." in v else f"{v}.0"
            written = rf"{name}(?:_(?:licen[cs]e_)?(?:version|v)?_?|v){number(v)}"
            if later:
                found.append((f"{family}-{full}-or-later", rf"{written}(?:_?\+|_or_(?:any_)?(?:later|newer)(?:_version)?)", 0.95))
                found.append((f"{family}-{full}-only", rf"{written}_only", 0.95))
            found.append((f"{family}-{full}", written, 0.9))
    for parts, (short, long) in _CC_PARTS.items():
        for v in reversed(_CC_VERSIONS):
            found.append((f"cc-{parts}-{v}", rf"cc_?{short}_{number(v)}", 0.95))
            found.append((f"cc-{parts}-{v}", rf"creative_commons_{long}_{number(v)}", 0.95))
        found.append((f"cc-{parts}", rf"cc_{short}", 0.8))
        found.append((f"cc-{parts}", rf"creative_commons_{long}", 0.8))
    listed(_NAMES, 0.8)
    found += [(family, name if "licen" in name else rf"{name}_licen[cs]ed?", 0.6) for family, name, _, _ in _FAMILIES]
    compiled = [(label, _compiled(body), weight) for label, body, weight in found]
    return [Rule(label, _keywords(_parser.parse(pattern.pattern, pattern.flags)), pattern, -i, weight) for i, (label, pattern, weight) in enumerate(compiled)]


RULES = _rules()
