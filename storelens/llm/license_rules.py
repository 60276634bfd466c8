"""License signatures: hand-written patterns in order of priority.

Patterns run over lower-cased bytes. A space in a pattern stands for any gap between two words, however long. Each signature has
one or more keywords, of which every match holds one, so a text without them never meets the pattern.
"""

from __future__ import annotations

import re
from typing import NamedTuple

GAP = rb"[^0-9a-z\x80-\xff]++"
EDGE = rb"(?![0-9a-z\x80-\xff])"
START = rb"(?<![0-9a-z\x80-\xff])"

# Priorities, and how sure a detection of each is.
TAG, TEXT, GRANT, NAME, HINT = 1, 2, 3, 4, 5
SURE = {TAG: 1.0, TEXT: 0.95, GRANT: 0.9, NAME: 0.7, HINT: 0.4}


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


# label, keywords, name of the license, its short identifier in tags.
V = "(?:,? ?v(?:ersion)? ?|-| )"
NAMED = [
    ("mit", "mit", r"mit", r"mit"),
    ("mit-0", "mit", r"mit no attribution", r"mit-0"),
    ("x11", "x11", r"x11", r"x11"),
    ("expat", "expat", r"expat", r"expat"),
    ("isc", "isc|consortium", r"(?:isc|internet systems consortium)", r"isc"),
    ("apache-1.0", "apache", rf"apache(?: software)?(?: licen[sc]e)?{V}1\.0", r"apache-1\.0"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: licen[sc]e)?{V}1\.1", r"apache-1\.1"),
    ("apache-2", "apache", rf"apache(?: software)?(?: licen[sc]e)?{V}2(?:\.0)?", r"apache-2\.0"),
    ("bsd-0", "bsd", r"(?:0|zero) clause bsd", r"0bsd"),
    ("bsd-1", "bsd", r"bsd (?:1|one) clause", r"bsd-1-clause"),
    ("bsd-2", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)", r"bsd-2-clause"),
    ("bsd-3", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|revised bsd|modified bsd)",
     r"bsd-3-clause"),
    ("bsd-4", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)", r"bsd-4-clause"),
    ("bsd-patent", "bsd", r"bsd (?:2 clause )?plus patent", r"bsd-2-clause-patent"),
    ("gpl-1", "gpl|general", rf"(?:gnu )?(?:gpl|general public licen[sc]e){V}1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?"),
    ("gpl-2", "gpl|general", rf"(?:gnu )?(?:gpl|general public licen[sc]e){V}2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3", "gpl|general", rf"(?:gnu )?(?:gpl|general public licen[sc]e){V}3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2", "lgpl|general", rf"(?:gnu )?(?:lgpl|library general public licen[sc]e){V}2(?:\.0)?",
     r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lgpl|general", rf"(?:gnu )?(?:lgpl|lesser general public licen[sc]e){V}2\.1",
     r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3", "lgpl|general", rf"(?:gnu )?(?:lgpl|lesser general public licen[sc]e){V}3(?:\.0)?",
     r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("agpl-3", "agpl|affero", rf"(?:gnu )?(?:agpl|affero general public licen[sc]e){V}3(?:\.0)?",
     r"agpl-3\.0(?:-only|-or-later|\+)?"),
    ("gfdl-1.1", "gfdl|documentation", rf"(?:gnu )?(?:gfdl|free documentation licen[sc]e){V}1\.1", r"gfdl-1\.1(?:-only|-or-later)?"),
    ("gfdl-1.2", "gfdl|documentation", rf"(?:gnu )?(?:gfdl|free documentation licen[sc]e){V}1\.2", r"gfdl-1\.2(?:-only|-or-later)?"),
    ("gfdl-1.3", "gfdl|documentation", rf"(?:gnu )?(?:gfdl|free documentation licen[sc]e){V}1\.3", r"gfdl-1\.3(?:-only|-or-later)?"),
    ("mpl-1.0", "mpl|mozilla", rf"(?:mozilla public licen[sc]e|mpl){V}1\.0", r"mpl-1\.0"),
    ("mpl-1.1", "mpl|mozilla", rf"(?:mozilla public licen[sc]e|mpl){V}1\.1", r"mpl-1\.1"),
    ("mpl-2", "mpl|mozilla", rf"(?:mozilla public licen[sc]e|mpl){V}2(?:\.0)?", r"mpl-2\.0"),
    ("epl-1", "epl|eclipse", rf"(?:eclipse public licen[sc]e|epl){V}1(?:\.0)?", r"epl-1\.0"),
    ("epl-2", "epl|eclipse", rf"(?:eclipse public licen[sc]e|epl){V}2(?:\.0)?", r"epl-2\.0"),
    ("edl-1", "eclipse", rf"eclipse distribution licen[sc]e{V}1(?:\.0)?", r"edl-1\.0"),
    ("cpl-1", "common", rf"common public licen[sc]e{V}1(?:\.0)?", r"cpl-1\.0"),
    ("cddl-1.0", "cddl|development", rf"(?:common development and distribution licen[sc]e|cddl){V}1(?:\.0)?", r"cddl-1\.0"),
    ("cddl-1.1", "cddl|development", rf"(?:common development and distribution licen[sc]e|cddl){V}1\.1", r"cddl-1\.1"),
    ("eupl-1.1", "eupl|european", rf"(?:european union public licen[sc]e|eupl){V}1\.1", r"eupl-1\.1"),
    ("eupl-1.2", "eupl|european", rf"(?:european union public licen[sc]e|eupl){V}1\.2", r"eupl-1\.2"),
    ("artistic-1", "artistic", rf"artistic licen[sc]e{V}1(?:\.0)?", r"artistic-1\.0"),
    ("artistic-2", "artistic", rf"artistic licen[sc]e{V}2(?:\.0)?", r"artistic-2\.0"),
    ("bsl-1", "boost", rf"boost software licen[sc]e(?:{V}1(?:\.0)?)?", r"bsl-1\.0"),
    ("busl-1.1", "business", rf"business source licen[sc]e(?:{V}1\.1)?", r"busl-1\.1"),
    ("sspl-1", "sspl|server", rf"(?:server side public licen[sc]e|sspl)(?:{V}1)?", r"sspl-1\.0"),
    ("elastic-2", "elastic", rf"elastic licen[sc]e(?:{V}2(?:\.0)?)?", r"elastic-2\.0"),
    ("osl-3", "software", rf"open software licen[sc]e(?:{V}3(?:\.0)?)?", r"osl-3\.0"),
    ("afl-3", "academic", rf"academic free licen[sc]e(?:{V}3(?:\.0)?)?", r"afl-3\.0"),
    ("ecl-2", "educational", rf"educational community licen[sc]e(?:{V}2(?:\.0)?)?", r"ecl-2\.0"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl|want", r"(?:wtfpl|do what the f\S{1,6} you want to public)", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    ("libpng", "libpng", r"libpng", r"libpng(?:-2\.0)?"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("python-2", "python|psf", r"(?:python software foundation|psf|python)(?: licen[sc]e)?(?: agreement)?(?:,? version)? 2(?:\.0)?",
     r"(?:python|psf)-2\.0"),
    ("ruby", "ruby", r"ruby", r"ruby"),
    ("php-3", "php", rf"php licen[sc]e{V}3(?:\.0[01]?)?", r"php-3\.0[01]?"),
    ("ncsa", "ncsa", r"(?:university of illinois ncsa(?: open source)?|ncsa)", r"ncsa"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("curl", "curl", r"curl", r"curl"),
    ("ftl", "freetype", r"freetype(?: project)?", r"ftl"),
    ("ijg", "jpeg", r"independent jpeg group", r"ijg"),
    ("ofl-1.1", "font", rf"(?:sil )?open font licen[sc]e(?:{V}1\.1)?", r"ofl-1\.1"),
    ("unicode", "unicode", r"unicode(?: inc)?(?: data files and software)?", r"unicode-(?:dfs-2016|3\.0)"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?", r"w3c"),
    ("vim", "vim", r"vim", r"vim"),
    ("beerware", "beer", r"beer ?ware", r"beerware"),
    ("json", "json", r"json", r"json"),
    ("hpnd", "historical", r"historical permission notice and disclaimer", r"hpnd"),
    ("ms-pl", "microsoft", r"microsoft public", r"ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", r"ms-rl"),
    ("apsl-2", "apple", rf"apple public source licen[sc]e(?:{V}2(?:\.0)?)?", r"apsl-2\.0"),
    ("ipl-1", "ibm", rf"ibm public licen[sc]e(?:{V}1(?:\.0)?)?", r"ipl-1\.0"),
    ("qpl-1", "public", rf"q public licen[sc]e(?:{V}1(?:\.0)?)?", r"qpl-1\.0"),
    ("lppl-1.3c", "latex", rf"latex project public licen[sc]e(?:{V}1\.3c?)?", r"lppl-1\.3c"),
    ("mulan-2", "mulan", rf"mulan(?: permissive software licen[sc]e| psl)(?:,?{V}2)?", r"mulanpsl-2\.0"),
    ("upl-1", "permissive", rf"universal permissive licen[sc]e(?:{V}1(?:\.0)?)?", r"upl-1\.0"),
    ("blueoak-1", "oak", rf"blue oak model licen[sc]e(?:{V}1(?:\.0)?(?:\.0)?)?", r"blueoak-1\.0\.0"),
    ("cecill-2.1", "cecill", rf"cecill(?: free software licen[sc]e)?(?: agreement)?{V}2\.1", r"cecill-2\.1"),
    ("cecill-b", "cecill", r"cecill b", r"cecill-b"),
    ("cecill-c", "cecill", r"cecill c", r"cecill-c"),
    ("etalab-2", "etalab", r"licence ouverte(?: open licence)?(?: version)?(?: 2(?:\.0)?)? etalab", r"etalab-2\.0"),
    ("ogl-uk-3", "government", rf"open government licen[sc]e(?:{V}3(?:\.0)?)?", r"ogl-uk-3\.0"),
    ("odbl-1", "odbl|database", rf"(?:open (?:data commons open )?database licen[sc]e|odbl)(?:{V}1(?:\.0)?)?", r"odbl-1\.0"),
    ("odc-by-1", "odc|commons", rf"(?:open data commons attribution licen[sc]e|odc by)(?:{V}1(?:\.0)?)?", r"odc-by-1\.0"),
    ("pddl-1", "pddl|dedication", rf"(?:public domain dedication and licen[sc]e|pddl)(?:{V}1(?:\.0)?)?", r"pddl-1\.0"),
    ("cdla-permissive-2", "community", rf"community data licen[sc]e agreement permissive(?:{V}2(?:\.0)?)?",
     r"cdla-permissive-2\.0"),
    ("cdla-sharing-1", "community", rf"community data licen[sc]e agreement sharing(?:{V}1(?:\.0)?)?",
     r"cdla-sharing-1\.0"),
    ("cc0-1", "cc0|cc|zero", rf"(?:cc ?0|cc zero|creative commons zero)(?:{V}1(?:\.0)?)?", r"cc0-1\.0"),
    ("openrail", "rail", r"(?:creativeml )?open rail(?: m)?", r"(?:creativeml-)?openrail(?:-m|\+\+)?"),
    ("bigscience-rail-1", "bigscience", r"bigscience (?:bloom )?rail(?: 1\.0)?", r"bigscience-(?:bloom-)?rail-1\.0"),
    ("llama-2", "llama", r"llama 2 community", r"llama2"),
    ("llama-3", "llama", r"llama 3(?:\.[0-9])? community", r"llama3(?:\.[0-9])?"),
    ("gemma", "gemma", r"gemma(?: terms of use)?", r"gemma"),
]

# Creative Commons: parts of the name in words and letters; versions are matched in any of the usual forms.
PARTS = [
    ("by", r"attribution", r"by"),
    ("by-sa", r"attribution share ?alike", r"by sa"),
    ("by-nc", r"attribution non ?commercial", r"by nc"),
    ("by-nd", r"attribution no ?deriv(?:ative|ativ|ate)?s?(?: works)?", r"by nd"),
    ("by-nc-sa", r"attribution non ?commercial share ?alike", r"by nc sa"),
    ("by-nc-nd", r"attribution non ?commercial no ?deriv(?:ative|ativ|ate)?s?(?: works)?", r"by nc nd"),
]
VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

GRANTED = (r"(?:licen[sc]ed|released|distributed|published|available|provided|covered|offered|redistributable)"
           r"(?: to you)? (?:under|by|with)(?: the)?(?: terms of)?(?: the)?")

# label, priority, keyword, pattern: sentences and addresses of the license texts themselves.
TEXTS = [
    ("mit", TEXT, "hereby",
     r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     r"documentation files"),
    ("mit", TEXT, "permission",
     r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", TEXT, "opensource.org", r"opensource\.org/licen[sc]es?/mit"),
    ("isc", TEXT, "permission", r"permission to use copy modify and/or distribute this software for any purpose"
     r" with or without fee is hereby granted"),
    ("isc", TEXT, "opensource.org", r"opensource\.org/licen[sc]es?/isc"),
    ("bsd", TEXT, "redistribution", r"redistribution and use in source and binary forms with or without "
     r"modification are permitted"),
    ("bsd-3", TEXT, "endorse", r"may be used to endorse or promote products derived from this software "
     r"without specific prior written permission"),
    ("bsd-4", TEXT, "advertising", r"all advertising materials mentioning features or use of this software"),
    ("bsd-2", TEXT, "opensource.org", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("bsd-3", TEXT, "opensource.org", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("apache-2", TEXT, "apache.org", r"apache\.org/licen[sc]es/licen[sc]e-2\.0"),
    ("apache-1.1", TEXT, "apache.org", r"apache\.org/licen[sc]es/licen[sc]e-1\.1"),
    ("apache-2", TEXT, "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl", TEXT, "redistribute", r"redistribute it and/or modify it under the terms of the gnu "
     r"general public licen[sc]e"),
    ("lgpl", TEXT, "redistribute", r"redistribute it and/or modify it under the terms of the gnu "
     r"(?:lesser|library) general public licen[sc]e"),
    ("agpl", TEXT, "redistribute", r"redistribute it and/or modify it under the terms of the gnu "
     r"affero general public licen[sc]e"),
    ("gpl", TEXT, "gnu", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", TEXT, "gnu", r"you should have received a copy of the gnu (?:lesser|library) "
     r"general public licen[sc]e"),
    ("gpl-2", TEXT, "gnu.org", r"gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?gpl-2\.0"),
    ("gpl-3", TEXT, "gnu.org", r"gnu\.org/licen[sc]es/gpl-3\.0"),
    ("gpl", TEXT, "gnu.org", r"gnu\.org/(?:copyleft|licen[sc]es)/gpl"),
    ("lgpl-2.1", TEXT, "gnu.org", r"gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?lgpl-2\.1"),
    ("lgpl-3", TEXT, "gnu.org", r"gnu\.org/licen[sc]es/lgpl-3\.0"),
    ("agpl-3", TEXT, "gnu.org", r"gnu\.org/licen[sc]es/agpl-3\.0"),
    ("gfdl", TEXT, "gnu.org", r"gnu\.org/(?:copyleft|licen[sc]es)/fdl"),
    ("mpl-2", TEXT, "mozilla.org", r"mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", TEXT, "mozilla.org", r"mozilla\.org/mpl/mpl-1\.1"),
    ("mpl-2", TEXT, "mozilla", r"this source code form is subject to the terms of the mozilla public"),
    ("epl-1", TEXT, "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("epl-2", TEXT, "eclipse.org", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", TEXT, "opensource.org", r"opensource\.org/licen[sc]es?/cddl"),
    ("bsl-1", TEXT, "boost.org", r"boost\.org/licen[sc]e_1_0"),
    ("unlicense", TEXT, "unlicense.org", r"unlicense\.org"),
    ("unlicense", TEXT, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", TEXT, "implied", r"this software is provided as is without any express or implied "
     r"warranty in no event will the authors be held liable"),
    ("wtfpl", TEXT, "wtfpl.net", r"wtfpl\.net"),
    ("ofl-1.1", TEXT, "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    ("artistic-2", TEXT, "perlfoundation", r"perlfoundation\.org/artistic_licen[sc]e_2_0"),
    ("artistic", TEXT, "perl", r"under the same terms as perl itself"),
    ("cc0-1", TEXT, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", TEXT, "creativecommons.org", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("public-domain", GRANT, "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("odbl-1", TEXT, "opendatacommons.org", r"opendatacommons\.org/licen[sc]es/odbl"),
    ("pddl-1", TEXT, "opendatacommons.org", r"opendatacommons\.org/licen[sc]es/pddl"),
    ("odc-by-1", TEXT, "opendatacommons.org", r"opendatacommons\.org/licen[sc]es/by"),
    ("ogl-uk-3", TEXT, "nationalarchives", r"nationalarchives\.gov\.uk/doc/open-government-licen[sc]e"),
    ("all-rights-reserved", NAME, "reserved", r"all rights reserved"),
    ("proprietary", GRANT, "proprietary", r"proprietary and confidential"),
    ("proprietary", GRANT, "prior", r"may not be (?:reproduced|copied|distributed)[^.]{0,80}without "
     r"(?:the )?prior written (?:permission|consent)"),
    ("commercial", GRANT, "commercial", r"(?:licen[sc]ed|available) under a commercial licen[sc]e"),
    ("non-commercial", GRANT, "commercial", r"for (?:personal and )?non ?commercial (?:use|purposes) only"),
    ("gpl", HINT, "gnu", r"gnu general public licen[sc]e"),
    ("lgpl", HINT, "gnu", r"gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", HINT, "affero", r"gnu affero general public licen[sc]e"),
    ("gfdl", HINT, "gnu", r"gnu free documentation licen[sc]e"),
    ("apache", HINT, "apache", r"apache(?: software)? licen[sc]e"),
    ("bsd", HINT, "bsd", r"bsd(?: style| like)? licen[sc]e"),
    ("mpl", HINT, "mozilla", r"mozilla public licen[sc]e"),
    ("cc", HINT, "commons", r"creative commons(?: licen[sc]e)?"),
    ("public-domain", HINT, "domain", r"public domain"),
    ("copyright", HINT, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
]


def _rule(label: str, priority: int, keyword: str, pattern: str) -> Rule:
    body = pattern.encode().replace(b" ?", b"\x00").replace(b" ", GAP).replace(b"\x00", b"(?:" + GAP + b")?")
    return Rule(label, priority, tuple(k.encode() for k in keyword.split("|")), re.compile(START + b"(?:" + body + b")" + EDGE))


def rules() -> list[Rule]:
    """All signatures, the most certain first."""
    found = [_rule(*t) for t in TEXTS]
    for label, keyword, name, tag in NAMED:
        found.append(_rule(label, TAG, "spdx", rf"spdx licen[sc]e identifier {tag}"))
        found.append(_rule(label, GRANT, keyword, rf"{GRANTED} {name}(?: licen[sc]e)?"))
        found.append(_rule(label, NAME, keyword, rf"{name}(?: open source| software)? licen[sc]e"
                           if "licen" not in name else name))
    for parts, words, letters in PARTS:
        dashed = parts
        for version in VERSIONS:
            v = re.escape(version)
            label = f"cc-{parts}-{version}"
            found.append(_rule(label, TAG, "spdx", rf"spdx licen[sc]e identifier cc-{dashed}-{v}"))
            found.append(_rule(label, TEXT, "creativecommons.org", rf"creativecommons\.org/licen[sc]es/{dashed}/{v}"))
            found.append(_rule(label, GRANT, "commons", rf"creative commons {words}(?: {v}| licen[sc]e {v}| international "
                               rf"{v}| {v} international)"))
            found.append(_rule(label, NAME, "cc", rf"cc {letters} {v}"))
        found.append(_rule(f"cc-{parts}", NAME, "cc", rf"cc {letters}"))
        found.append(_rule(f"cc-{parts}", NAME, "commons", rf"creative commons {words}"))
    return sorted(found, key=lambda r: r.priority)
