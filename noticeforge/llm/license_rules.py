"""Ordered signature rules for license mentions, written by hand over word sequences.

A text is seen as its lower-case words with single spaces between them ("Apache-2.0" reads "apache 2 0"), so patterns need
no punctuation. Every rule has keywords, one of which each of its matches holds as a word: only rules with a keyword that stands
in a text are run on it. Rules come from hand-written tables: how a license is named (with its own title,
identifier and address patterns), sentences of notices, families, and the frames in which names stand; an earlier rule has priority over a later one.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    keywords: tuple[str, ...]
    label: str
    pattern: str
    weight: float


#: Fixed values of the contract: phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

_V = "(?:version |v)?"
_OPT_V = "(?: version| v)?"

# label, keywords of the title (one of several), its pattern, keywords of the identifier, its pattern
LICENSES = [
    ("apache-2.0", "apache", f"apache (?:software )?licen[sc]e {_V}2(?: 0)?", "apache|apachev2|apache2", "apache(?: version)? ?v?2(?: 0)?"),
    ("apache-1.1", "apache", f"apache (?:software )?licen[sc]e {_V}1 1", "apache", "apache 1 1"),
    ("apache-1.0", "apache", f"apache (?:software )?licen[sc]e {_V}1 0", "apache", "apache 1 0"),
    ("gpl-1.0", "general", f"gnu general public licen[sc]e {_V}1(?: 0)?", "gpl|gplv1|gpl1", "gpl(?: version)? ?v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "general", f"gnu general public licen[sc]e {_V}2(?: 0)?(?: or later| only)?", "gpl|gplv2|gpl2", "gpl(?: version)? ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "general", f"gnu general public licen[sc]e {_V}3(?: 0)?(?: or later| only)?", "gpl|gplv3|gpl3", "gpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "library", f"gnu library general public licen[sc]e {_V}2(?: 0)?", "lgpl|lgplv2|lgpl2", "lgpl(?: version)? ?v?2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", f"gnu lesser general public licen[sc]e {_V}2 1", "lgpl|lgplv2|lgpl2", "lgpl(?: version)? ?v?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", f"gnu lesser general public licen[sc]e {_V}3(?: 0)?", "lgpl|lgplv3|lgpl3", "lgpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "affero", f"gnu affero general public licen[sc]e(?: {_V}3(?: 0)?)?", "agpl|agplv3|agpl3", "agpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-1.0", "affero", f"affero general public licen[sc]e {_V}1(?: 0)?", "agpl|agplv1|agpl1", "agpl(?: version)? ?v?1(?: 0)?"),
    ("gfdl", "documentation", "gnu free documentation licen[sc]e(?: version 1 [123])?", "gfdl", "gfdl(?: 1 [123])?"),
    ("mit", "mit", "(?:the )?mit (?:x11 )?licen[sc]e", "mit", "mit"),
    ("mit-0", "mit", "mit no attribution(?: licen[sc]e)?", "mit", "mit 0"),
    ("x11", "x11", "x11 licen[sc]e", "x11", "x11"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause) bsd licen[sc]e", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised|3 clause) bsd licen[sc]e", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|old|4 clause) bsd licen[sc]e", "bsd", "bsd 4 clause"),
    ("0bsd", "bsd", "zero clause bsd(?: licen[sc]e)?", "0bsd", "0bsd"),
    ("isc", "isc", "isc licen[sc]e", "isc", "isc"),
    ("zlib", "zlib", "zlib (?:libpng )?licen[sc]e", "zlib", "zlib"),
    ("libpng", "libpng", "libpng licen[sc]e", "libpng", "libpng"),
    ("mpl-1.0", "mozilla", f"mozilla public licen[sc]e {_V}1 0", "mpl|mplv1|mpl1", "mpl(?: version)? ?v?1 0"),
    ("mpl-1.1", "mozilla", f"mozilla public licen[sc]e {_V}1 1", "mpl|mplv1|mpl1", "mpl(?: version)? ?v?1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public licen[sc]e {_V}2(?: 0)?", "mpl|mplv2|mpl2", "mpl(?: version)? ?v?2(?: 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public licen[sc]e {_V}1(?: 0)?", "epl|eplv1|epl1", "epl(?: version)? ?v?1 0"),
    ("epl-2.0", "eclipse", f"eclipse public licen[sc]e {_V}2(?: 0)?", "epl|eplv2|epl2", "epl(?: version)? ?v?2 0"),
    ("cddl-1.0", "development", f"common development and distribution licen[sc]e{_OPT_V}(?: 1 0)?", "cddl|cddlv1|cddl1", "cddl(?: version)? ?v?1 0"),
    ("cddl-1.1", "development", f"common development and distribution licen[sc]e {_V}1 1", "cddl|cddlv1|cddl1", "cddl(?: version)? ?v?1 1"),
    ("cpl-1.0", "common", f"common public licen[sc]e{_OPT_V}(?: 1 0)?", "cpl", "cpl 1 0"),
    ("eupl-1.1", "union", f"european union public licen[sc]e {_V}1 1", "eupl|euplv1|eupl1", "eupl(?: version)? ?v?1 1"),
    ("eupl-1.2", "union", f"european union public licen[sc]e(?: {_V}1 2)?", "eupl|euplv1|eupl1", "eupl(?: version)? ?v?1 2"),
    ("artistic-1.0", "artistic", f"artistic licen[sc]e {_V}1(?: 0)?", "artistic", "artistic 1 0"),
    ("artistic-2.0", "artistic", f"artistic licen[sc]e {_V}2(?: 0)?", "artistic", "artistic 2 0"),
    ("boost-1.0", "boost", "boost software licen[sc]e(?: (?:version )?1 0)?", "bsl", "bsl 1 0"),
    ("busl-1.1", "business", "business source licen[sc]e(?: (?:version )?1 1)?", "busl", "busl 1 1"),
    ("sspl-1.0", "server", "server side public licen[sc]e(?: (?:version |v)?1)?", "sspl", "sspl(?: 1 0)?"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e(?: 2 0| v2)?", "elastic", "elastic 2 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[sc]e", "wtfpl", "wtfpl"),
    ("python-2.0", "python", "python (?:software foundation )?licen[sc]e(?: (?:version )?2)?", "psf", "psf 2 0"),
    ("php-3.01", "php", "php licen[sc]e(?: (?:version )?3 01)?", "php", "php 3 01"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl", "openssl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", "ncsa", "ncsa"),
    ("ofl-1.1", "font", "sil open font licen[sc]e(?: (?:version )?1 1)?", "ofl", "ofl 1 1"),
    ("odbl-1.0", "database", "open (?:data commons open )?database licen[sc]e(?: v?1 0)?", "odbl", "odbl(?: 1 0)?"),
    ("odc-by-1.0", "attribution", "open data commons attribution licen[sc]e", "odc", "odc by(?: 1 0)?"),
    ("pddl-1.0", "dedication", "open data commons public domain dedication(?: and)? licen[sc]e", "pddl", "pddl(?: 1 0)?"),
    ("cecill-2.1", "cecill", "cecill (?:free software )?licen[sc]e(?: agreement)?", "cecill", "cecill 2 1"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", "pl", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", "rl", "ms rl"),
    ("osl-3.0", "open", "open software licen[sc]e (?:version |v)?3 0", "osl", "osl 3 0"),
    ("afl-3.0", "academic", "academic free licen[sc]e (?:version |v)?3 0", "afl", "afl 3 0"),
    ("upl-1.0", "universal", "universal permissive licen[sc]e(?: (?:version |v)?1 0)?", "upl", "upl 1 0"),
    ("w3c", "w3c", "w3c software(?: notice)?(?: and document)? licen[sc]e", "w3c", "w3c"),
    ("vim", "vim", "vim licen[sc]e", "vim", "vim"),
    ("llama-community", "llama", "llama [23](?: [0-9])? community licen[sc]e(?: agreement)?", "llama", "llama [23](?: [0-9])?"),
    ("openrail", "openrail|rail", "(?:creativeml |bigscience )?(?:bloom )?(?:openrail(?: m)?(?: licen[sc]e)?|open rail (?:m(?: licen[sc]e)?|licen[sc]e))", "openrail|rail", "(?:creativeml |bigscience )?(?:bloom )?(?:openrail(?: m)?|open rail m)"),
    ("cc0-1.0", "zero", "creative commons zero(?: v?1 0)?(?: universal)?", "cc0", "cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "noncommercial|commercial", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] 0)?(?: international| unported)?", "cc", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "noncommercial|commercial", "attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported)?", "cc", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "noncommercial|commercial", "attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?", "cc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "attribution", "attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] 0)?(?: international| unported)?", "cc", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "attribution", "attribution share ?alike(?: [1-4] 0)?(?: international| unported)?", "cc", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-4.0", "attribution", "creative commons attribution 4 0(?: international)?", "cc", "cc by 4 0"),
    ("cc-by-3.0", "attribution", "creative commons attribution 3 0(?: unported)?", "cc", "cc by 3 0"),
    ("unicode", "unicode", "unicode (?:data files and software )?licen[sc]e(?: agreement)?", "unicode", "unicode dfs(?: 201[56])?"),
    ("curl", "curl", "curl licen[sc]e", "curl", "curl"),
    ("ftl", "freetype", "freetype (?:project )?licen[sc]e", "ftl", "ftl"),
    ("ijg", "jpeg", "independent jpeg group licen[sc]e", "ijg", "ijg"),
    ("libtiff", "libtiff", "libtiff licen[sc]e", "libtiff", "libtiff"),
    ("ecl-2.0", "educational", "educational community licen[sc]e(?: (?:version |v)?2 0)?", "ecl", "ecl 2 0"),
    ("rpl-1.5", "reciprocal", "reciprocal public licen[sc]e(?: 1 5)?", "rpl", "rpl 1 5"),
    ("qpl-1.0", "q", "q public licen[sc]e(?: (?:version )?1 0)?", "qpl", "qpl 1 0"),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", "sleepycat", "sleepycat"),
    ("watcom-1.0", "watcom", "sybase open watcom public licen[sc]e(?: 1 0)?", "watcom", "watcom 1 0"),
    ("apsl-2.0", "apple", "apple public source licen[sc]e(?: (?:version )?2(?: 0)?)?", "apsl", "apsl 2 0"),
    ("ipl-1.0", "ibm", "ibm public licen[sc]e(?: (?:version )?1 0)?", "ipl", "ipl 1 0"),
    ("lppl-1.3c", "latex", "latex project public licen[sc]e(?: (?:version )?1 3c?)?", "lppl", "lppl 1 3c?"),
    ("zpl-2.1", "zope", "zope public licen[sc]e(?: (?:version )?2 1)?", "zpl", "zpl 2 1"),
    ("mulanpsl-2.0", "mulan", "mulan permissive software licen[sc]e(?: (?:version |v)?2)?", "mulanpsl", "mulanpsl 2 0"),
    ("blueoak-1.0.0", "oak", "blue oak model licen[sc]e(?: 1 0 0)?", "blueoak", "blueoak 1 0 0"),
    ("polyform-noncommercial", "polyform", "polyform non ?commercial licen[sc]e(?: 1 0 0)?", "polyform", "polyform noncommercial 1 0 0"),
    ("commons-clause", "clause", "commons clause licen[sc]e(?: condition)?", "commons", "commons clause"),
    ("ogl-uk-3.0", "government", "open government licen[sc]e(?: v?3(?: 0)?)?", "ogl", "ogl uk 3 0"),
    ("etalab-2.0", "ouverte", "licence ouverte(?: v?2 0)?", "etalab", "etalab 2 0"),
    ("dl-de-by-2.0", "datenlizenz", "datenlizenz deutschland namensnennung(?: (?:version )?2 0)?", "dl", "dl de by 2 0"),
    ("cdla-permissive-2.0", "community", "community data licen[sc]e agreement permissive(?: (?:version )?2 0)?", "cdla", "cdla permissive 2 0"),
    ("hippocratic-2.1", "hippocratic", "hippocratic licen[sc]e(?: (?:version )?2 1)?", "hippocratic", "hippocratic 2 1"),
    ("nposl-3.0", "profit", "non profit open software licen[sc]e(?: (?:version )?3 0)?", "nposl", "nposl 3 0"),
    ("beerware", "beerware|beer", "beer ?ware licen[sc]e", "beerware", "beerware"),
]

# addresses, read as words
ADDRESSES = [
    ("apache-2.0", "apache", "apache org licenses license 2 0"),
    ("gpl", "gnu", "gnu org licenses(?: old licenses)?(?: gpl(?: [123] 0)?)?"),
    ("lgpl", "lgpl", "gnu org (?:licenses|copyleft) lgpl"),
    ("agpl-3.0", "agpl", "gnu org licenses agpl"),
    ("mit", "opensource", "opensource org licenses? mit(?: license)?"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"),
    ("mpl-2.0", "mozilla", "mozilla org (?:en us )?mpl 2 0"),
    ("epl-2.0", "eclipse", "eclipse org legal epl 2 0"),
    ("unlicense", "unlicense", "unlicense org"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] 0"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] 0"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] 0"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] 0"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] 0"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons", "creativecommons org licenses by 3 0"),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl"),
]

# sentences of license texts and notices that name no license
NOTICES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.85),
    ("apache-2.0", "obtain", "you may not use this file except in compliance with the license you may obtain a copy of the license", 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", 0.95),
    ("agpl-3.0", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.95),
    ("zlib", "acknowledgment", "an acknowledgment in the product documentation would be appreciated but is not required", 0.85),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "domain", "(?:is|are) in the public domain", 0.7),
    ("all-rights-reserved", "reserved", "all rights reserved", 0.6),
    ("all-rights-reserved", "réservés", "tous droits réservés", 0.6),
    ("all-rights-reserved", "vorbehalten", "alle rechte vorbehalten", 0.6),
    ("all-rights-reserved", "reservados", "todos los derechos reservados", 0.6),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 0.5),
    ("proprietary", "proprietary", "proprietary and confidential", 0.6),
    ("mit", "warranty", "the software is provided as is without warranty of any kind", 0.6),
    ("bsd", "holders", "this software is provided by the copyright holders and contributors as is", 0.7),
    ("gpl", "hope", "this program is distributed in the hope that it will be useful but without any warranty", 0.7),
    ("apache-2.0", "basis", "distributed under the license is distributed on an as is basis", 0.85),
    ("mpl-2.0", "subject", "this source code form is subject to the terms of the mozilla public license", 0.95),
    ("epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.95),
    ("boost-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 0.9),
    ("cc", "work", "this work is licensed under a creative commons", 0.8),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights", 0.85),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 0.8),
    ("openssl", "toolkit", "for use in the openssl toolkit", 0.8),
    ("python-2.0", "psf", "psf is making python available to licensee on an as is basis", 0.9),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license", 0.95),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution) (?:of this file )?(?:via any medium )?is (?:strictly )?prohibited", 0.6),
    ("all-rights-reserved", "riservati", "tutti i diritti riservati", 0.6),
    ("all-rights-reserved", "reservados", "todos os direitos reservados", 0.6),
    ("all-rights-reserved", "voorbehouden", "alle rechten voorbehouden", 0.6),
    ("non-commercial", "noncommercial|commercial", "(?:for )?non ?commercial use only", 0.6),
    ("research-only", "research", "for research purposes only", 0.6),
    ("no-redistribution", "permission", "(?:may not|must not|cannot) be (?:reproduced|redistributed|copied) without (?:prior |written |prior written )?permission", 0.7),
]

# families, for names without a version
FAMILIES = [
    ("gpl", "general", "gnu general public licen[sc]e", 0.7),
    ("lgpl", "lesser", "gnu lesser general public licen[sc]e", 0.7),
    ("gpl", "gpl", "(?:gnu )?gpl", 0.4),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", 0.4),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl", 0.4),
    ("apache", "apache", "apache (?:software )?licen[sc]e", 0.7),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", 0.6),
    ("mpl", "mozilla", "mozilla public licen[sc]e", 0.7),
    ("epl", "eclipse", "eclipse public licen[sc]e", 0.7),
    ("artistic", "artistic", "artistic licen[sc]e", 0.6),
    ("cc", "creative", "creative commons(?: licen[sc]e| attribution)?", 0.6),
    ("cc-by", "cc", "cc by", 0.6),
]


def rules() -> list[Rule]:
    """All rules in order of priority."""
    out: list[Rule] = []
    add = lambda keys, label, pattern, weight: out.append(Rule(tuple(keys.split("|")), label, pattern, weight))
    tag, terms = "spdx license identifier ", "(?:the )?(?:terms of the )?"
    under = f"(?:licen[sc]ed|released|distributed|available|published|provided) under {terms}"
    by = f"(?:licen[sc]ed (?:with|by)|(?:released|distributed|available|published|provided) with) {terms}"
    for label, _, _, key, name in LICENSES:
        add(key, label, tag + name, 1.0)
    for label, key, address in ADDRESSES:
        add(key, label, address, 0.95)
    for label, key, title, _, _ in LICENSES:
        add(key, label, f"(?:{under}|{by})(?:{title})", 0.95)
    for label, _, _, key, name in LICENSES:
        # "by" and "with" also stand before other things that are called so: a bare word needs "license" behind it there
        add(key, label, f"(?:{under}(?:{name})(?: licen[sc]e)?|{by}(?:{name})" + ("(?: licen[sc]e)?)" if " " in name else " licen[sc]e)"), 0.9)
    for label, key, text, weight in NOTICES:
        add(key, label, text, weight)
    for label, key, title, _, _ in LICENSES:
        add(key, label, title, 0.85)
    for label, _, _, key, name in LICENSES:
        if " " in name:  # a bare word such as "ruby" says nothing by itself
            add(key, label, name, 0.6)
    for label, key, text, weight in FAMILIES:
        add(key, label, text, weight)
    return out
