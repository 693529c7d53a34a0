"""Signature rules for licences: five kinds of signature for every licence below, and some that stand alone.

Patterns are matched against text with A-Z lower-cased.  They use only syntax that Java and RE2 read alike and
never match the empty string.
"""

from __future__ import annotations

import json
from typing import NamedTuple


class Licence(NamedTuple):
    label: str
    keyword: str
    """Part of every match of ``name`` once each run of white space in it is one space."""
    name: str
    tag: str
    """Pattern of the short identifier."""
    site: str = ""
    """Pattern of the address of the text; its keyword is the part before the first backslash."""


class Rule(NamedTuple):
    rule: str
    label: str
    priority: int
    confidence: float
    gate: str
    keyword: str
    pattern: str


V = r",?\s*(version\s*|v\.?\s*)?"
LICENCE = r"licen[cs]e"

# Public names and identifiers of licences.
LICENCES = [
    Licence("0bsd", "zero-clause", rf"(bsd\s+)?zero-clause\s+bsd(\s+{LICENCE})?", r"0bsd"),
    Licence("afl-3", "academic free licen", rf"academic\s+free\s+{LICENCE}({V}3(\.0)?)?", r"afl-3\.0"),
    Licence("agpl-3", "affero general public", rf"(gnu\s+)?affero\s+general\s+public\s+{LICENCE}({V}3(\.0)?)?", r"agpl-3\.0(-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    Licence("apache-1", "apache", rf"apache\s+(software\s+)?{LICENCE}{V}1\.[01]", r"apache-1\.[01]", r"apache\.org/licenses/license-1"),
    Licence("apache-2", "apache", rf"apache\s+(software\s+)?{LICENCE}({V}2(\.0)?)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    Licence("artistic-1", "artistic licen", rf"artistic\s+{LICENCE}{V}1(\.0)?", r"artistic-1\.0"),
    Licence("artistic-2", "artistic licen", rf"artistic\s+{LICENCE}({V}2(\.0)?)?", r"artistic-2\.0"),
    Licence("bsd-2", "bsd", rf"(simplified\s+bsd|(2|two)[\s-]clause\s+bsd|bsd\s+(2|two)[\s-]clause)(\s+{LICENCE})?", r"bsd-2-clause"),
    Licence("bsd-3", "bsd", rf"((new|modified|revised)\s+bsd|(3|three)[\s-]clause\s+bsd|bsd\s+(3|three)[\s-]clause)(\s+{LICENCE})?", r"bsd-3-clause"),
    Licence("bsd-4", "bsd", rf"(original\s+bsd|(4|four)[\s-]clause\s+bsd|bsd\s+(4|four)[\s-]clause)(\s+{LICENCE})?", r"bsd-4-clause"),
    Licence("bsd", "bsd", rf"bsd[\s-]+(style\s+)?{LICENCE}", r"bsd"),
    Licence("bsl-1", "boost software", rf"boost\s+software\s+{LICENCE}({V}1(\.0)?)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    Licence("busl-1.1", "business source", rf"business\s+source\s+{LICENCE}({V}1\.1)?", r"busl-1\.1"),
    Licence("cc0", "cc0", r"(creative\s+commons\s+)?cc0(\s+1\.0)?(\s+universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    Licence("cc-by", "cc", r"cc[\s-]+by([\s-]+[1-4](\.[0-9])?)?", r"cc-by-[1-4]\.[0-9]", r"creativecommons\.org/licenses/by/"),
    Licence("cc-by-sa", "cc", r"cc[\s-]+by-sa([\s-]+[1-4](\.[0-9])?)?", r"cc-by-sa-[1-4]\.[0-9]", r"creativecommons\.org/licenses/by-sa"),
    Licence("cc-by-nd", "cc", r"cc[\s-]+by-nd([\s-]+[1-4](\.[0-9])?)?", r"cc-by-nd-[1-4]\.[0-9]", r"creativecommons\.org/licenses/by-nd"),
    Licence("cc-by-nc", "cc", r"cc[\s-]+by-nc([\s-]+[1-4](\.[0-9])?)?", r"cc-by-nc-[1-4]\.[0-9]", r"creativecommons\.org/licenses/by-nc/"),
    Licence("cc-by-nc-sa", "cc", r"cc[\s-]+by-nc-sa([\s-]+[1-4](\.[0-9])?)?", r"cc-by-nc-sa-[1-4]\.[0-9]", r"creativecommons\.org/licenses/by-nc-sa"),
    Licence("cc-by-nc-nd", "cc", r"cc[\s-]+by-nc-nd([\s-]+[1-4](\.[0-9])?)?", r"cc-by-nc-nd-[1-4]\.[0-9]", r"creativecommons\.org/licenses/by-nc-nd"),
    Licence("cddl-1", "common development and distribution", rf"common\s+development\s+and\s+distribution\s+{LICENCE}({V}1\.[01])?", r"cddl-1\.[01]"),
    Licence("cecill", "cecill", rf"cecill(-[bc])?(\s+(free\s+software\s+)?{LICENCE})?({V}2(\.[01])?)?", r"cecill-2\.[01]", r"cecill\.info"),
    Licence("cpal-1", "common public attribution", rf"common\s+public\s+attribution\s+{LICENCE}({V}1(\.0)?)?", r"cpal-1\.0"),
    Licence("cpl-1", "common public licen", rf"common\s+public\s+{LICENCE}({V}1(\.0)?)?", r"cpl-1\.0"),
    Licence("ecl-2", "educational community", rf"educational\s+community\s+{LICENCE}({V}2(\.0)?)?", r"ecl-2\.0"),
    Licence("elastic-2", "elastic licen", rf"elastic\s+{LICENCE}({V}2(\.0)?)?", r"elastic-2\.0"),
    Licence("epl-1", "eclipse public", rf"eclipse\s+public\s+{LICENCE}{V}1(\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    Licence("epl-2", "eclipse public", rf"eclipse\s+public\s+{LICENCE}({V}2(\.0)?)?", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0"),
    Licence("eupl-1.2", "european union public", rf"european\s+union\s+public\s+{LICENCE}({V}1\.[12])?", r"eupl-1\.[12]"),
    Licence("gfdl", "free documentation", rf"(gnu\s+)?free\s+documentation\s+{LICENCE}({V}1\.[123])?", r"gfdl-1\.[123]", r"gnu\.org/licenses/fdl"),
    Licence("gpl-1", "general public licen", rf"(gnu\s+)?general\s+public\s+{LICENCE}{V}1(\.0)?", r"gpl-1\.0(-only|-or-later)?"),
    Licence("gpl-2", "general public licen", rf"(gnu\s+)?general\s+public\s+{LICENCE}{V}2(\.0)?", r"gpl-2\.0(-only|-or-later)?", r"gnu\.org/licenses/(old-licenses/)?gpl-2"),
    Licence("gpl-3", "general public licen", rf"(gnu\s+)?general\s+public\s+{LICENCE}{V}3(\.0)?", r"gpl-3\.0(-only|-or-later)?", r"gnu\.org/licenses/gpl-3"),
    Licence("gpl", "general public licen", rf"(gnu\s+)?general\s+public\s+{LICENCE}", r"gpl", r"gnu\.org/licenses/gpl"),
    Licence("hpnd", "historical permission", rf"historical\s+permission\s+notice\s+and\s+disclaimer(\s+{LICENCE})?", r"hpnd"),
    Licence("icu", "icu licen", rf"icu\s+{LICENCE}", r"icu"),
    Licence("ijg", "independent jpeg", rf"independent\s+jpeg\s+group(\s+{LICENCE})?", r"ijg"),
    Licence("ipl-1", "ibm public", rf"ibm\s+public\s+{LICENCE}({V}1(\.0)?)?", r"ipl-1\.0"),
    Licence("isc", "isc licen", rf"isc\s+{LICENCE}", r"isc"),
    Licence("lgpl-2.1", "lesser general public", rf"(gnu\s+)?lesser\s+general\s+public\s+{LICENCE}{V}2(\.1)?", r"lgpl-2\.[01](-only|-or-later)?", r"gnu\.org/licenses/(old-licenses/)?lgpl-2"),
    Licence("lgpl-3", "lesser general public", rf"(gnu\s+)?lesser\s+general\s+public\s+{LICENCE}({V}3(\.0)?)?", r"lgpl-3\.0(-only|-or-later)?", r"gnu\.org/licenses/lgpl"),
    Licence("lppl-1.3", "project public licen", rf"latex\s+project\s+public\s+{LICENCE}({V}1\.3[ac]?)?", r"lppl-1\.3[ac]"),
    Licence("mit", "mit", rf"mit[\s/x1-]+{LICENCE}", r"mit", r"opensource\.org/licenses/mit"),
    Licence("mit-0", "mit no attribution", r"mit\s+no\s+attribution(\s+licen[cs]e)?", r"mit-0"),
    Licence("mpl-1.1", "mozilla public", rf"mozilla\s+public\s+{LICENCE}{V}1\.[01]", r"mpl-1\.[01]", r"mozilla\.org/mpl/1"),
    Licence("mpl-2", "mozilla public", rf"mozilla\s+public\s+{LICENCE}({V}2(\.0)?)?", r"mpl-2\.0", r"mozilla\.org/mpl/2\.0"),
    Licence("ms-pl", "microsoft public", rf"microsoft\s+public\s+{LICENCE}", r"ms-pl"),
    Licence("ms-rl", "microsoft reciprocal", rf"microsoft\s+reciprocal\s+{LICENCE}", r"ms-rl"),
    Licence("ncsa", "illinois", rf"university\s+of\s+illinois(/ncsa)?\s+open\s+source\s+{LICENCE}", r"ncsa"),
    Licence("odbl-1", "open database", rf"open\s+database\s+{LICENCE}({V}1(\.0)?)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    Licence("odc-by", "open data commons attribution", rf"open\s+data\s+commons\s+attribution\s+{LICENCE}", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    Licence("ofl-1.1", "open font", rf"(sil\s+)?open\s+font\s+{LICENCE}({V}1\.[01])?", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    Licence("openssl", "openssl licen", rf"openssl\s+{LICENCE}", r"openssl"),
    Licence("osl-3", "open software licen", rf"open\s+software\s+{LICENCE}({V}3(\.0)?)?", r"osl-3\.0"),
    Licence("pddl", "public domain dedication", rf"public\s+domain\s+dedication(\s+and\s+{LICENCE})?", r"pddl-1\.0"),
    Licence("php-3", "php licen", rf"php\s+{LICENCE}({V}3(\.0[01])?)?", r"php-3\.0[01]?"),
    Licence("postgresql", "postgresql licen", rf"postgresql\s+{LICENCE}", r"postgresql"),
    Licence("python-2", "python", rf"python(\s+software\s+foundation)?\s+{LICENCE}({V}2(\.0)?)?", r"(psf|python)-2\.0"),
    Licence("qpl-1", "q public licen", rf"q\s+public\s+{LICENCE}({V}1(\.0)?)?", r"qpl-1\.0"),
    Licence("sspl-1", "server side public", rf"server\s+side\s+public\s+{LICENCE}({V}1)?", r"sspl-1\.0"),
    Licence("unicode", "unicode licen", rf"unicode\s+{LICENCE}(\s+agreement)?({V}3)?", r"unicode-(3\.0|dfs-201[56])"),
    Licence("unlicense", "unlicense", r"(the\s+)?unlicense", r"unlicense", r"unlicense\.org"),
    Licence("vim", "vim licen", rf"vim\s+{LICENCE}", r"vim"),
    Licence("w3c", "w3c software", rf"w3c\s+software\s+(notice\s+and\s+)?{LICENCE}", r"w3c"),
    Licence("wtfpl", "wtfpl", rf"wtfpl({V}2)?(\s+{LICENCE})?", r"wtfpl"),
    Licence("zlib", "zlib", rf"zlib(/libpng)?\s+{LICENCE}", r"zlib"),
    Licence("zpl-2", "zope public", rf"zope\s+public\s+{LICENCE}({V}2\.[01])?", r"zpl-2\.[01]"),
]

# Signatures that belong to no single name.
ALONE = [
    Rule("text:mit", "mit", 2, 0.7, "permission is hereby", "free of charge", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    Rule("text:bsd", "bsd", 2, 0.6, "redistribution and use", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    Rule("text:isc", "isc", 2, 0.6, "permission to use", "permission to use", r"permission\s+to\s+use,?\s+copy,?\s+modify,?\s+and(/or)?\s+distribute\s+this\s+software"),
    Rule("text:gpl", "gpl", 1, 0.5, "free software", "redistribute it", r"free\s+software[:;,]?\s+you\s+can\s+redistribute\s+it"),
    Rule("domain:dedication", "public-domain", 1, 0.5, "public domain", "public domain", r"(released|dedicated|placed)\s+(in|in)?to\s+the\s+public\s+domain"),
    Rule("rights:reserved", "all-rights-reserved", 1, 0.4, "rights reserved", "all rights reserved", r"all\s+rights\s+reserved"),
    Rule("rights:owner", "copyright", 1, 0.3, "copyright", "copyright", r"copyright\s+(\(c\)|©)?\s*[12][0-9]{3}"),
    *[
        Rule(f"spelled:{label}", label, 2, 0.8, "creative commons", "creative commons attribution", rf"creative\s+commons\s+attribution{rest}([\s-]+[1-4](\.[0-9])?)?")
        for label, rest in (
            ("cc-by", ""),
            ("cc-by-sa", r"[\s-]+share-?alike"),
            ("cc-by-nd", r"[\s-]+no-?deriv(ative)?s?"),
            ("cc-by-nc", r"[\s-]+non-?commercial"),
            ("cc-by-nc-sa", r"[\s-]+non-?commercial[\s-]+share-?alike"),
            ("cc-by-nc-nd", r"[\s-]+non-?commercial[\s-]+no-?deriv(ative)?s?"),
        )
    ],
    *[
        Rule(f"short:{label}", label, 2, 0.7, "gpl", "gpl", rf"gnu\s+{name}(\s+v?{version}(\.[0-9])?)")
        for label, name, version in (("gpl-2", "gpl", 2), ("gpl-3", "gpl", 3), ("lgpl-2.1", "lgpl", 2), ("lgpl-3", "lgpl", 3), ("agpl-3", "agpl", 3))
    ],
    Rule("rights:proprietary", "proprietary", 2, 0.5, "proprietary", "proprietary", r"proprietary\s+and\s+confidential"),
]

GRANTS = r"(licen[cs]ed|released|distributed|available|published|provided|made\s+available|covered|governed)\s+(under|by)\s+(the\s+)?((terms|conditions)(\s+and\s+conditions)?\s+of\s+)?(the\s+)?"


def rules() -> list[Rule]:
    """Every rule, first those that outrank others."""
    out = []
    for x in LICENCES:
        out.append(Rule(f"tag:{x.label}", x.label, 4, 1.0, "spdx", "spdx-license-identifier", rf"spdx-license-identifier:\s*{x.tag}"))
        out.append(Rule(f"grant:{x.label}", x.label, 3, 0.95, gate(x.keyword), x.keyword, GRANTS + f"({x.name})"))
        if x.site:
            out.append(Rule(f"site:{x.label}", x.label, 3, 0.9, x.site.partition("\\")[0], x.site.partition("\\")[0], x.site))
        out.append(Rule(f"name:{x.label}", x.label, 2, 0.8, gate(x.keyword), x.keyword, x.name))
        out.append(Rule(f"badge:{x.label}", x.label, 1, 0.6, "licen", "licen", rf"{LICENCE}\s*[:=]\s*[\"']?{x.tag}"))
    return sorted(out + ALONE, key=lambda r: -r.priority)


def gate(keyword: str) -> str:
    """The coarse words that a document must hold before the keyword is looked for."""
    if keyword in ("cc", "cc0"):
        return keyword
    return next((g for g in ("cecill", "wtfpl", "bsd", "unlicense", "zero-clause", "no attribution", "public domain", "independent jpeg", "historical permission") if g in keyword), "licen")


def rules_json() -> str:
    return json.dumps([r._asdict() for r in rules()])
