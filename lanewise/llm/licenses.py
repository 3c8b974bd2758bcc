"""Licence notices by ordered signature rules, in DataFrame functions alone.

A text is brought to words joined by single spaces. A rule is a regular
expression over that form with a priority and a keyword; it runs only on texts
that hold its keyword, and no rule runs on a text without any of a few gate
words. Rules are the written name patterns below in the phrasings of
``CONTEXTS``, and written patterns of licence texts. Detections are intervals
of words. Those of higher priority, then the longer, then those of the earlier
rule, then those that start first are accepted; one that overlaps an accepted
one, be it within it, about it or beside it, is suppressed.

Patterns are literals, so that each is compiled once: a text that holds a
rule's keyword is searched for the name, then for the name's phrasings.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import LOWER, UPPER, text_or_empty

#: All of ASCII but digits and letters parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that are always looked for, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V = r"(?:version |v ?)?"
_LATER = r"(?: or (?:any )?(?:later|newer)(?: version)?| or at your option any later version)?"
_LICENSE = r"(?: public)? licen[cs]es?"
#: label, keyword, pattern of the name; where a name is a prefix of another the longer match wins by its length.
NAMES = (
    ("mit", "mit", rf"mit{_LICENSE}"), ("mit", "expat", rf"expat{_LICENSE}"), ("mit-0", "mit 0", rf"mit 0(?:{_LICENSE})?"), ("mit", "x11", rf"(?:mit )?x11{_LICENSE}"), ("isc", "isc", rf"isc{_LICENSE}"),
    ("apache-1.1", "apache", rf"apache(?: software)?{_LICENSE} {_V}1 1|apache 1 1"), ("apache-1.0", "apache", rf"apache(?: software)?{_LICENSE} {_V}1 0|apache 1 0"),
    ("apache-2.0", "apache", rf"apache(?: software)?{_LICENSE} {_V}2(?: 0)?"), ("apache-2.0", "apache", rf"apache {_V}2(?: 0)?(?:{_LICENSE})?"), ("apache", "apache", rf"apache(?: software)?{_LICENSE}"), ("apache-2.0", "asl", r"asl ?2(?: 0)?"),
    ("bsd-0-clause", "bsd", rf"(?:zero|0) clause bsd(?:{_LICENSE})?|0bsd"), ("bsd-2-clause", "bsd", rf"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?:{_LICENSE})?"),
    ("bsd-3-clause", "bsd", rf"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?:{_LICENSE})?"), ("bsd-4-clause", "bsd", rf"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?:{_LICENSE})?"), ("bsd", "bsd", rf"bsd(?: style)?{_LICENSE}"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general{_LICENSE}(?: {_V}3(?: 0)?)?{_LATER}"), ("agpl-1.0", "affero", rf"(?:gnu )?affero general{_LICENSE} {_V}1(?: 0)?"), ("agpl-3.0", "agpl", rf"agpl ?{_V}3(?: 0)?(?: only)?{_LATER}"), ("agpl", "agpl", r"agpl"),
    ("lgpl-2.0", "lgpl", rf"lgpl ?{_V}2(?: 0)?(?: only)?{_LATER}"), ("lgpl-2.1", "lgpl", rf"lgpl ?{_V}2 1(?: only)?{_LATER}"), ("lgpl-3.0", "lgpl", rf"lgpl ?{_V}3(?: 0)?(?: only)?{_LATER}"), ("lgpl", "lgpl", r"lgpl"),
    ("lgpl-2.0", "library general", rf"(?:gnu )?library general{_LICENSE}(?: {_V}2(?: 0)?)?{_LATER}"), ("lgpl-2.1", "lesser general", rf"(?:gnu )?lesser general{_LICENSE} {_V}2 1{_LATER}"), ("lgpl-3.0", "lesser general", rf"(?:gnu )?lesser general{_LICENSE} {_V}3(?: 0)?{_LATER}"), ("lgpl", "lesser general", rf"(?:gnu )?lesser general{_LICENSE}"),
    ("gpl-1.0", "general public", rf"(?:gnu )?general{_LICENSE} {_V}1(?: 0)?{_LATER}"), ("gpl-2.0", "general public", rf"(?:gnu )?general{_LICENSE} {_V}2(?: 0)?{_LATER}"), ("gpl-3.0", "general public", rf"(?:gnu )?general{_LICENSE} {_V}3(?: 0)?{_LATER}"), ("gpl", "general public", rf"gnu general{_LICENSE}"),
    ("gpl-1.0", "gpl", rf"(?:gnu )?gpl ?{_V}1(?: 0)?(?: only)?{_LATER}"), ("gpl-2.0", "gpl", rf"(?:gnu )?gpl ?{_V}2(?: 0)?(?: only)?{_LATER}"), ("gpl-3.0", "gpl", rf"(?:gnu )?gpl ?{_V}3(?: 0)?(?: only)?{_LATER}"), ("gpl", "gpl", rf"(?:gnu )?gpl(?:{_LICENSE})?"),
    ("gfdl-1.1", "free documentation", rf"(?:gnu )?free documentation{_LICENSE} {_V}1 1{_LATER}"), ("gfdl-1.2", "free documentation", rf"(?:gnu )?free documentation{_LICENSE} {_V}1 2{_LATER}"), ("gfdl-1.3", "free documentation", rf"(?:gnu )?free documentation{_LICENSE} {_V}1 3{_LATER}"), ("gfdl", "free documentation", rf"(?:gnu )?free documentation{_LICENSE}"), ("gfdl", "gfdl", r"gfdl(?: 1 [123])?"),
    ("mpl-1.0", "mozilla", rf"mozilla{_LICENSE} {_V}1 0"), ("mpl-1.1", "mozilla", rf"mozilla{_LICENSE} {_V}1 1"), ("mpl-2.0", "mozilla", rf"mozilla{_LICENSE} {_V}2(?: 0)?"), ("mpl", "mozilla", rf"mozilla{_LICENSE}"), ("mpl-2.0", "mpl", rf"mpl ?{_V}2(?: 0)?"), ("mpl-1.1", "mpl", rf"mpl ?{_V}1 1"),
    ("epl-1.0", "eclipse", rf"eclipse{_LICENSE} {_V}1(?: 0)?"), ("epl-2.0", "eclipse", rf"eclipse{_LICENSE} {_V}2(?: 0)?"), ("epl", "eclipse", rf"eclipse{_LICENSE}"), ("epl-2.0", "epl", rf"epl ?{_V}2(?: 0)?"), ("epl-1.0", "epl", rf"epl ?{_V}1(?: 0)?"), ("edl-1.0", "eclipse distribution", rf"eclipse distribution{_LICENSE}(?: {_V}1(?: 0)?)?"),
    ("cddl-1.0", "common development", rf"common development and distribution{_LICENSE}(?: {_V}1(?: 0)?)?"), ("cddl-1.1", "common development", rf"common development and distribution{_LICENSE} {_V}1 1"), ("cddl", "cddl", r"cddl(?: 1 [01])?"), ("cpl-1.0", "common public", rf"common{_LICENSE}(?: {_V}1(?: 0)?)?"), ("ipl-1.0", "ibm public", rf"ibm{_LICENSE}(?: {_V}1(?: 0)?)?"),
    ("eupl-1.1", "european union public", rf"european union{_LICENSE} {_V}1 1"), ("eupl-1.2", "european union public", rf"european union{_LICENSE}(?: {_V}1 2)?"), ("eupl", "eupl", r"eupl(?: 1 [0-9])?"), ("artistic-1.0", "artistic", rf"artistic{_LICENSE} {_V}1(?: 0)?"), ("artistic-2.0", "artistic", rf"artistic{_LICENSE} {_V}2(?: 0)?"), ("artistic", "artistic", rf"artistic{_LICENSE}"),
    ("bsl-1.0", "boost", rf"boost(?: software)?{_LICENSE}(?: {_V}1(?: 0)?)?"), ("busl-1.1", "business source", rf"business source{_LICENSE}(?: {_V}1 1)?"), ("unlicense", "unlicense", r"unlicense"), ("wtfpl", "wtfpl", r"wtfpl(?: 2)?"), ("zlib", "zlib", rf"zlib(?: libpng)?(?:{_LICENSE})?"), ("libpng", "libpng", rf"libpng{_LICENSE}"), ("openssl", "openssl", rf"openssl{_LICENSE}"),
    ("psf-2.0", "python", rf"python(?: software foundation)?{_LICENSE}(?: {_V}2(?: 0)?)?"), ("php-3.01", "php", rf"php{_LICENSE}(?: {_V}3 01)?"), ("ruby", "ruby", rf"ruby{_LICENSE}"), ("ofl-1.1", "open font", rf"(?:sil )?open font{_LICENSE}(?: {_V}1 1)?"), ("ofl-1.1", "ofl", r"ofl(?: 1 1)?"), ("postgresql", "postgresql", rf"postgresql{_LICENSE}"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)?{_LICENSE}"), ("ms-pl", "microsoft", rf"microsoft{_LICENSE}"), ("ms-rl", "microsoft reciprocal", rf"microsoft reciprocal{_LICENSE}"), ("sspl-1.0", "server side", rf"server side{_LICENSE}(?: {_V}1)?"), ("elastic-2.0", "elastic", rf"elastic{_LICENSE}(?: {_V}2(?: 0)?)?"), ("osl-3.0", "open software", rf"open software{_LICENSE}(?: {_V}3(?: 0)?)?"), ("afl-3.0", "academic free", rf"academic free{_LICENSE}(?: {_V}3(?: 0)?)?"),
    ("odbl-1.0", "database", rf"open (?:data commons open )?database{_LICENSE}(?: {_V}1(?: 0)?)?"), ("odc-by-1.0", "data commons", rf"open data commons attribution{_LICENSE}(?: {_V}1(?: 0)?)?"), ("pddl-1.0", "public domain dedication", rf"public domain dedication and{_LICENSE}"), ("cdla-permissive", "community data", rf"community data{_LICENSE} agreement permissive"), ("cdla-sharing", "community data", rf"community data{_LICENSE} agreement sharing"), ("ogl-uk-3.0", "open government", rf"open government{_LICENSE}(?: {_V}3(?: 0)?)?"),
    ("openrail", "openrail", rf"(?:creativeml |bigscience )?open ?rail(?: m)?(?:{_LICENSE})?"), ("proprietary", "proprietary", rf"proprietary(?: software)?{_LICENSE}"),
)
MORE_NAMES = (
    ("aal", "attribution assurance", rf"attribution assurance{_LICENSE}"), ("adobe-2006", "adobe", rf"adobe systems incorporated source code{_LICENSE}"), ("adsl", "amazon digital", rf"amazon digital services{_LICENSE}"), ("afl-1.2", "academic free", rf"academic free{_LICENSE} {_V}1 2"),
    ("afl-2.0", "academic free", rf"academic free{_LICENSE} {_V}2 0"), ("afl-2.1", "academic free", rf"academic free{_LICENSE} {_V}2 1"), ("aladdin", "aladdin", rf"aladdin free{_LICENSE}"), ("apsl-1.2", "apple public", rf"apple{_LICENSE} {_V}1 2"),
    ("apsl-2.0", "apple public", rf"apple{_LICENSE}(?: {_V}2(?: 0)?)?"), ("beerware", "beer ware", rf"beer ?ware{_LICENSE}"), ("bittorrent-1.1", "bittorrent", rf"bittorrent open source{_LICENSE}(?: {_V}1 [01])?"), ("blueoak-1.0.0", "blue oak", rf"blue oak model{_LICENSE}(?: {_V}1 0 0)?"),
    ("cal-1.0", "cryptographic autonomy", rf"cryptographic autonomy{_LICENSE}(?: {_V}1(?: 0)?)?"), ("caldera", "caldera", rf"caldera{_LICENSE}"), ("catosl-1.1", "computer associates", rf"computer associates trusted open source{_LICENSE}(?: {_V}1 1)?"), ("cecill-2.0", "cecill", rf"cecill(?: free software)?{_LICENSE}(?: agreement)? {_V}2(?: 0)?"),
    ("cecill-2.1", "cecill", rf"cecill(?: free software)?{_LICENSE}(?: agreement)? {_V}2 1"), ("cecill-b", "cecill b", rf"cecill b(?: free software)?{_LICENSE}"), ("cecill-c", "cecill c", rf"cecill c(?: free software)?{_LICENSE}"), ("clartistic", "clarified artistic", rf"clarified artistic{_LICENSE}"),
    ("cnri-python", "cnri", rf"cnri(?: python| open source| jython)?{_LICENSE}"), ("condor-1.1", "condor", rf"condor{_LICENSE}(?: {_V}1 1)?"), ("cpal-1.0", "common public attribution", rf"common public attribution{_LICENSE}(?: {_V}1(?: 0)?)?"), ("cpol-1.02", "code project", rf"(?:the )?code project open{_LICENSE}(?: {_V}1 02)?"),
    ("cua-opl-1.0", "cua office", rf"cua office{_LICENSE}(?: {_V}1(?: 0)?)?"), ("curl", "curl", rf"curl{_LICENSE}"), ("d-fsl-1.0", "deutsche freie", rf"deutsche freie software lizenz|german free software{_LICENSE}"), ("ecl-1.0", "educational community", rf"educational community{_LICENSE} {_V}1(?: 0)?"),
    ("ecl-2.0", "educational community", rf"educational community{_LICENSE}(?: {_V}2(?: 0)?)?"), ("efl-2.0", "eiffel forum", rf"eiffel forum{_LICENSE}(?: {_V}[12](?: 0)?)?"), ("entessa", "entessa", rf"entessa{_LICENSE}"), ("etalab-2.0", "etalab", rf"etalab open{_LICENSE}(?: {_V}2(?: 0)?)?"),
    ("eudatagrid", "datagrid", rf"eu datagrid(?: software)?{_LICENSE}"), ("fair", "fair", rf"fair{_LICENSE}"), ("frameworx-1.0", "frameworx", rf"frameworx(?: open)?{_LICENSE}(?: {_V}1(?: 0)?)?"), ("ftl", "freetype", rf"freetype(?: project)?{_LICENSE}"),
    ("gemma", "gemma", r"gemma terms of use"), ("gl2ps", "gl2ps", rf"gl2ps{_LICENSE}"), ("gnuplot", "gnuplot", rf"gnuplot{_LICENSE}"), ("hippocratic-2.1", "hippocratic", rf"hippocratic{_LICENSE}(?: {_V}[123] [0-9])?"),
    ("hpnd", "historical permission", rf"historical permission notice and disclaimer(?:{_LICENSE})?"), ("icu", "icu", rf"icu{_LICENSE}"), ("ijg", "jpeg group", rf"independent jpeg group{_LICENSE}"), ("imagemagick", "imagemagick", rf"imagemagick{_LICENSE}"),
    ("info-zip", "info zip", rf"info zip{_LICENSE}"), ("intel", "intel", rf"intel open source{_LICENSE}"), ("interbase-1.0", "interbase", rf"interbase{_LICENSE}(?: {_V}1(?: 0)?)?"), ("ipa", "ipa font", rf"ipa font{_LICENSE}"),
    ("jasper-2.0", "jasper", rf"jasper{_LICENSE}(?: {_V}2(?: 0)?)?"), ("json", "json", rf"json{_LICENSE}"), ("latex2e", "latex2e", rf"latex2e{_LICENSE}"), ("leptonica", "leptonica", rf"leptonica{_LICENSE}"),
    ("liliq-p-1.1", "liliq p", rf"(?:licence libre du quebec permissive|liliq p)(?: {_V}1 1)?"), ("liliq-r-1.1", "liliq r", rf"liliq r(?: {_V}1 1)?"), ("llama2", "llama 2", rf"llama 2 community{_LICENSE}"), ("llama3", "llama 3", rf"(?:meta )?llama 3(?: [0-9])? community{_LICENSE}"),
    ("lpl-1.02", "lucent", rf"lucent{_LICENSE}(?: {_V}1 0[02]?)?"), ("lppl-1.3c", "latex project", rf"latex project{_LICENSE}(?: {_V}1 3c?)?{_LATER}"), ("miros", "miros", rf"miros{_LICENSE}"), ("motosoto", "motosoto", rf"motosoto open source{_LICENSE}"),
    ("mulanpsl-2.0", "mulan", rf"mulan (?:psl|permissive software{_LICENSE})(?: {_V}2)?"), ("multics", "multics", rf"multics{_LICENSE}"), ("nasa-1.3", "nasa", rf"nasa open source(?: agreement|{_LICENSE})(?: {_V}1 3)?"), ("naumen", "naumen", rf"naumen{_LICENSE}"),
    ("nbpl-1.0", "net boolean", rf"net boolean{_LICENSE}(?: {_V}1(?: 0)?)?"), ("netcdf", "netcdf", rf"netcdf{_LICENSE}"), ("ngpl", "nethack", rf"nethack general{_LICENSE}"), ("nokia", "nokia", rf"nokia open source{_LICENSE}"),
    ("nosl", "netizen", rf"netizen open source{_LICENSE}"), ("npl-1.1", "netscape", rf"netscape{_LICENSE}(?: {_V}1 [01])?"), ("nposl-3.0", "non profit open", rf"non profit open software{_LICENSE}(?: {_V}3(?: 0)?)?"), ("ntp", "ntp", rf"ntp{_LICENSE}"),
    ("oclc-2.0", "oclc", rf"oclc research{_LICENSE}(?: {_V}2(?: 0)?)?"), ("ogl-canada-2.0", "government licence canada", rf"open government{_LICENSE} canada"), ("oldap-2.8", "openldap", rf"openldap{_LICENSE}(?: {_V}2 8)?"), ("oset-pl-2.1", "oset", rf"oset(?: foundation)?{_LICENSE}(?: {_V}2 1)?"),
    ("parity-7.0", "parity", rf"parity{_LICENSE}(?: {_V}[67] 0(?: 0)?)?"), ("polyform-noncommercial-1.0", "polyform", rf"polyform noncommercial{_LICENSE}(?: {_V}1(?: 0 0)?)?"), ("polyform-small-business-1.0", "polyform", rf"polyform small business{_LICENSE}(?: {_V}1(?: 0 0)?)?"), ("prosperity-3.0", "prosperity", rf"prosperity{_LICENSE}(?: {_V}3(?: 0 0)?)?"),
    ("qpl-1.0", "q public", rf"q{_LICENSE}(?: {_V}1(?: 0)?)?"), ("rhecos-1.1", "red hat ecos", rf"red hat ecos{_LICENSE}(?: {_V}1 1)?"), ("rpl-1.5", "reciprocal public", rf"reciprocal{_LICENSE}(?: {_V}1 [15])?"), ("rpsl-1.0", "realnetworks", rf"realnetworks public source{_LICENSE}(?: {_V}1(?: 0)?)?"),
    ("rscpl", "ricoh", rf"ricoh source code{_LICENSE}"), ("sendmail", "sendmail", rf"sendmail{_LICENSE}"), ("sgi-b-2.0", "sgi free", rf"sgi free software{_LICENSE} b(?: {_V}2 0)?"), ("simpl-2.0", "simple public", rf"simple{_LICENSE}(?: {_V}2 0)?"),
    ("sissl", "sun industry", rf"sun industry standards source{_LICENSE}(?: {_V}1 [12])?"), ("sleepycat", "sleepycat", rf"sleepycat{_LICENSE}"), ("spl-1.0", "sun public", rf"sun{_LICENSE}(?: {_V}1(?: 0)?)?"), ("sugarcrm-1.1.3", "sugarcrm", rf"sugarcrm{_LICENSE}(?: {_V}1 1 3)?"),
    ("tcl", "tcl", rf"tcl(?: tk)?{_LICENSE}"), ("unicode-3.0", "unicode", rf"unicode{_LICENSE}(?: {_V}3)?"), ("upl-1.0", "universal permissive", rf"universal permissive{_LICENSE}(?: {_V}1(?: 0)?)?"), ("vim", "vim", rf"vim{_LICENSE}"),
    ("vsl-1.0", "vovida", rf"vovida software{_LICENSE}(?: {_V}1(?: 0)?)?"), ("w3c", "w3c", rf"w3c(?: software(?: notice and)?| document)?{_LICENSE}"), ("watcom-1.0", "watcom", rf"sybase open watcom{_LICENSE}(?: {_V}1(?: 0)?)?"), ("xfree86-1.1", "xfree86", rf"xfree86{_LICENSE}(?: {_V}1 1)?"),
    ("ypl-1.1", "yahoo", rf"yahoo{_LICENSE}(?: {_V}1 [01])?"), ("zend-2.0", "zend", rf"zend{_LICENSE}(?: {_V}2(?: 0)?)?"), ("zimbra-1.4", "zimbra", rf"zimbra{_LICENSE}(?: {_V}1 [34])?"), ("zpl-2.1", "zope", rf"zope{_LICENSE}(?: {_V}[12] [01])?"),
)
_CC = r"(?:creative commons|cc)"
_CC_END = r"(?:{0})?(?: {1}(?:4 0|3 0|2 5|2 0|1 0|[1-4]))?(?: (?:international|unported|generic))?(?:{0})?".format(_LICENSE, _V)
CREATIVE = (
    ("cc-by", r"(?:by|attribution)"), ("cc-by-sa", r"(?:by sa|attribution share ?alike)"), ("cc-by-nd", r"(?:by nd|attribution no ?deriv(?:ative)?s?)"), ("cc-by-nc", r"(?:by nc|attribution non ?commercial)"),
    ("cc-by-nc-sa", r"(?:by nc sa|attribution non ?commercial share ?alike)"), ("cc-by-nc-nd", r"(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)"),
)
#: What a name stands in, its priority and the weight of such a detection in a text's score; {} is the name.
CONTEXTS = (
    ("tag", r"spdx licen[cs]e identifier {}", 4, 1.0),
    ("grant", r"(?:(?:dual |multi )?licen[cs]ed|released|distributed|published|provided|offered|covered|available|redistribute it) (?:to you |and or modify it )?(?:under|by|with)(?: the)?(?: terms of)?(?: the| an?)? {}", 3, 0.95),
    ("subject", r"(?:subject to|governed by|under|terms of|terms and conditions of|permitted by|a copy of|comply with|compliance with|see)(?: the| an?)? {}", 2, 0.8),
    ("field", r"licen[cs]e(?: is| type| name)? {}", 1, 0.6),
)
#: label, keyword, pattern of a passage of the licence itself.
PASSAGES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"), ("mit", "shall be included in all copies", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"), ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"), ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it"), ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"), ("public-domain", "public domain", r"(?:released into|dedicated to|placed in|in) the public domain"), ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("zlib", "provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"), ("wtfpl", "do what the", r"do what the fuck you want to public licen[cs]e"), ("proprietary", "all rights reserved", r"all rights reserved"), ("bsl-1.0", "boost", r"distributed under the boost software licen[cs]e version 1 0"),
)
#: Every rule's pattern takes one of these words.
GATES = ("licen", "spdx", "permission", "permitted", "redistribut", "released", "distributed", "published", "provided", "offered", "covered", "available", "subject to", "governed by", "under", "terms", "copy of", "comply with", "compliance with", "see", "public domain", "cc0", "all rights reserved", "shall be included", "cc by", "creative commons")
PASSAGE = 3, 0.9
#: Of a name that says that it is a licence, without any phrasing about it.
TITLE = 0, 0.4


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def _taken(pattern: str) -> str:
    """A pattern over " word word ": it takes the space before the words and leaves that after them."""
    return rf" (?:{pattern})(?= )"


def _families() -> list[tuple[str, str, list[Rule]]]:
    """(keyword, pattern that any match of the rules holds, rules), in the order of the rules."""
    out = []
    creative = [(label, word, f"{_CC} {kind}{_CC_END}") for label, kind in CREATIVE for word in ("cc by", "creative commons")]
    for i, (label, keyword, pattern) in enumerate((*NAMES, *MORE_NAMES, *creative)):
        family = [Rule(f"{label}:{context}:{i}", label, keyword, _taken(around.format(f"(?:{pattern})")), priority, weight) for context, around, priority, weight in CONTEXTS]
        if pattern.startswith(_CC):
            family.append(Rule(f"{label}:name:{i}", label, keyword, _taken(pattern), 1, 0.7))  # these names are plain enough on their own
        elif _LICENSE in pattern and f"(?:{_LICENSE})?" not in pattern:
            family.append(Rule(f"{label}:title:{i}", label, keyword, _taken(pattern), *TITLE))
        out.append((keyword, _taken(pattern), family))
    for i, (label, keyword, pattern) in enumerate(PASSAGES):
        out.append((keyword, _taken(pattern), [Rule(f"{label}:text:{i}", label, keyword, _taken(pattern), *PASSAGE)]))
    return out


def rules() -> list[Rule]:
    """All rules in their order."""
    return [r for _, _, family in _families() for r in family]


def _words(x: Column) -> Column:
    """Spaces: words of a stretch that begins with a space and ends before one."""
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" ")))


def _places(text: Column, pattern: Column) -> Column:
    """Intervals of words (start, end) where a pattern matches, from left to right."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(_words(p).alias("skip"), _words(m).alias("take")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda s, x: F.struct((s["at"] + x["skip"] + x["take"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["skip"]).alias("start"), (s["at"] + x["skip"] + x["take"]).alias("end")))).alias("out"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])


_DETECTION = "struct<start:int,end:int,priority:int,n:int,label:string,rule:string,weight:double>"


def _held(text: str) -> Column:
    """Numbers of the rules that match a text column; literal patterns, each tried where its keyword and then its name is there.

    Written as SQL: as many columns made one by one take the driver several seconds.
    """
    out, n = [], 0
    for keyword, name, family in _families():
        numbers = ", ".join(f"CASE WHEN {text} RLIKE r'{r.pattern}' THEN {n + k} END" for k, r in enumerate(family))
        out.append(f"CASE WHEN contains({text}, '{keyword}') AND {text} RLIKE r'{name}' THEN array({numbers}) END")
        n += len(family)
    return F.expr(f"filter(flatten(filter(array({', '.join(out)}), x -> x IS NOT NULL)), x -> x IS NOT NULL)")


def _detections(text: str) -> Column:
    """All matches of the rules in a text column."""
    table = ", ".join(f"named_struct('rule', '{r.name}', 'label', '{r.label}', 'pattern', r'{r.pattern}', 'priority', {r.priority}, 'weight', {r.weight}D)" for r in rules())
    of = lambda n, r: F.transform(_places(F.col(text), r["pattern"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), n.alias("n"), r["label"].alias("label"), r["rule"].alias("rule"), r["weight"].alias("weight")))
    return F.flatten(F.transform(_held(text), lambda n: of(n, F.get(F.expr(f"array({table})"), n))))


def _resolved(found: Column) -> Column:
    """The accepted detections, by their places; those that overlap one another, be it through others, are looked at together."""
    kind, group = f"array<{_DETECTION}>", F.array().cast(f"array<{_DETECTION}>")
    ordered = F.array_sort(found)  # by start
    step = lambda s, d: F.when(d["start"] < s["end"], F.struct(s["out"].alias("out"), F.concat(s["now"], F.array(d)).alias("now"), F.greatest(s["end"], d["end"]).alias("end"))).otherwise(
        F.struct(F.concat(s["out"], F.array(s["now"])).alias("out"), F.array(d).alias("now"), d["end"].alias("end"))
    )
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), group.alias("now"), F.lit(-1).alias("end"))
    groups = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.array(s["now"])))
    ranked = lambda g: F.transform(F.array_sort(F.transform(g, lambda d: F.struct((-d["priority"]).alias("p"), (d["start"] - d["end"]).alias("length"), d["n"].alias("n"), d["start"].alias("start"), d.alias("d")))), lambda x: x["d"])
    accept = lambda g: F.aggregate(ranked(g), group, lambda kept, d: F.when(F.exists(kept, lambda k: (k["start"] < d["end"]) & (d["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(d))))
    return F.array_sort(F.flatten(F.transform(groups, accept)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for every row of docs(doc_id, text, ...).

    Places of BASE phrases are counted and located in words from 0; detections
    are the rules' intervals of words (start, end exclusive). labels has the
    labels of both; score is the largest weight of a detection, 0.9 for a base
    phrase, 0 for none. A null text is an empty one: no words, no labels, null
    places. doc_id may be null or repeated; other columns are ignored.
    """
    plain = F.regexp_replace(F.concat(F.lit(" "), text_or_empty(), F.lit(" ")), SEPARATORS, " ")
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("__p")).select("*", F.lower("__p").alias("__l"))
    any_ = lambda words: reduce(or_, (F.contains("__l", F.lit(w)) for w in words))
    keywords = sorted({r.keyword for r in rules()})
    # keywords that hold a shorter one needn't be looked for themselves
    least = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    may_hold = any_([*dict.fromkeys([*least, "cc by nc"])])
    gated = low.select("doc_id", (_words(F.col("__p")) - 1).cast("long").alias("n_words"), F.when(any_(GATES) & may_hold, F.translate("__p", UPPER, LOWER)).alias("__t"))
    nothing = F.array().cast("array<struct<start:int,end:int,label:string>>")
    named = lambda label: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("label"))
    base = F.concat(*(F.when(F.contains("__t", F.lit(f" {p} ")), F.transform(_places(F.col("__t"), F.lit(f" {p}(?= )")), named(label))).otherwise(nothing) for p, label in BASE))
    found = gated.select("doc_id", "n_words", F.when(F.col("__t").isNull(), nothing).otherwise(base).alias("__b"), F.when(F.col("__t").isNull(), F.array().cast(f"array<{_DETECTION}>")).otherwise(_resolved(_detections("__t"))).alias("__d"))
    labels = lambda *a: F.array_join(F.array_sort(F.array_distinct(F.concat(*a))), ",")
    ours = F.transform("__d", lambda d: d["label"])
    theirs = F.transform("__b", lambda b: b["label"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("__d", lambda d: d["weight"])), F.lit(0.0)), F.when(F.size("__b") > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
    starts = F.transform("__b", lambda b: b["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("__b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(theirs).alias("base_labels"), labels(theirs, ours).alias("labels"), score.alias("score"),
        F.transform("__d", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["rule"].alias("rule"), d["priority"].alias("priority"))).alias("detections"),
    )
