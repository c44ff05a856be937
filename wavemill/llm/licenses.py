"""License scans: ordered signature rules with a keyword prefilter and containment suppression.

A rule is a regular expression with a keyword that every match contains (small, as the text is), a label and a level (1 is
strongest). Only rules whose keyword occurs in the text run. A hit is suppressed if a hit of the same or a stronger level contains its
interval: of equal intervals the stronger level wins, then the earlier rule.

Everything is an expression over one row: no shuffle, no join. Only A-Z are made small. Time grows as a
text's length, and as its hits, which are sorted once. Null and empty texts have no words and
no labels. Repeated rows each get a row; extra columns are left out.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, scanned, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IN, _OUT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE = "(?<!" + _IN + ")(?:" + "|".join(p.replace(" ", _OUT) for p in PHRASES) + ")(?!" + _IN + ")"

#: label; SPDX identifier; the name as it is written in prose; an address; a keyword of the prose name.
LICENSES = [
    ("mit", r"mit", r"(?:the )?mit(?:/x11)? licen[sc]e", r"opensource\.org/licenses/mit", "mit"),
    ("mit-0", r"mit-0", r"mit no attribution(?: licen[sc]e)?", r"opensource\.org/licenses/mit-0", "mit no attribution"),
    ("apache-1.1", r"apache-1\.1", r"apache (?:software )?licen[sc]e,? (?:version )?1\.1", r"apache\.org/licenses/license-1\.1", "apache"),
    ("apache-2.0", r"apache-2\.0", r"apache licen[sc]e,? (?:version )?2(?:\.0)?", r"apache\.org/licenses/license-2\.0", "apache"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu (?:general public licen[sc]e|gpl),? (?:version |v)1(?:\.0)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0", "gnu"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu (?:general public licen[sc]e|gpl),? (?:version |v)2(?:\.0)?", r"gnu\.org/licenses/old-licenses/gpl-2\.0", "gnu"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu (?:general public licen[sc]e|gpl),? (?:version |v)3(?:\.0)?", r"gnu\.org/licenses/gpl(?:-3\.0)?\b", "gnu"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"gnu (?:library|lesser) general public licen[sc]e,? (?:version |v)2(?:\.0)?\b(?!\.1)", r"gnu\.org/licenses/old-licenses/lgpl-2\.0", "general public"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu lesser general public licen[sc]e,? (?:version |v)2\.1", r"gnu\.org/licenses/old-licenses/lgpl-2\.1", "lesser"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu lesser general public licen[sc]e,? (?:version |v)3(?:\.0)?", r"gnu\.org/licenses/lgpl(?:-3\.0)?\b", "lesser"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu affero general public licen[sc]e(?:,? (?:version |v)3(?:\.0)?)?", r"gnu\.org/licenses/agpl(?:-3\.0)?\b", "affero"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", r"gnu free documentation licen[sc]e", r"gnu\.org/licenses/fdl", "free documentation"),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd licen[sc]e|bsd 2[- ]clause(?: licen[sc]e)?", r"opensource\.org/licenses/bsd-2-clause", "bsd"),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:new|revised|modified|3[- ]clause|three[- ]clause) bsd licen[sc]e|bsd 3[- ]clause(?: licen[sc]e)?", r"opensource\.org/licenses/bsd-3-clause", "bsd"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:original|old|4[- ]clause) bsd licen[sc]e|bsd 4[- ]clause(?: licen[sc]e)?", r"spdx\.org/licenses/bsd-4-clause", "bsd"),
    ("0bsd", r"0bsd", r"(?:zero[- ]clause|0[- ]clause|free public) bsd licen[sc]e", r"opensource\.org/licenses/0bsd", "bsd"),
    ("isc", r"isc", r"(?:the )?isc licen[sc]e", r"opensource\.org/licenses/isc", "isc"),
    ("zlib", r"zlib", r"(?:the )?zlib(?:/libpng)? licen[sc]e", r"opensource\.org/licenses/zlib", "zlib"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[sc]e,? (?:version |v)?1\.1", r"mozilla\.org/mpl/1\.1", "mozilla"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[sc]e(?:,? (?:version |v)?(?:\. )?2\.0)?", r"mozilla\.org/mpl/2\.0", "mozilla"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[sc]e(?: -)?,? (?:version |v)?1\.0", r"eclipse\.org/legal/epl-v10", "eclipse"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[sc]e(?: -)?,? (?:version |v)?2\.0", r"eclipse\.org/legal/epl-2\.0", "eclipse"),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution licen[sc]e", r"opensource\.org/licenses/cddl1?", "common development"),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[sc]e", r"opensource\.org/licenses/cpl1?\.0", "common public"),
    ("artistic-1.0", r"artistic-1\.0", r"(?:perl )?artistic licen[sc]e(?: 1\.0)?", r"opensource\.org/licenses/artistic-1\.0", "artistic"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic licen[sc]e,? (?:version |v)?2\.0", r"opensource\.org/licenses/artistic-2\.0", "artistic"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[sc]e", r"boost\.org/license_1_0", "boost"),
    ("unlicense", r"unlicense", r"(?:the )?unlicen[sc]e\b", r"unlicense\.org", "unlicen"),
    ("wtfpl", r"wtfpl", r"do what the f\w+ you want to public licen[sc]e", r"wtfpl\.net", "do what the"),
    ("cc0-1.0", r"cc0-1\.0", r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero", "cc0"),
    ("cc-by-2.0", r"cc-by-2\.0", r"(?:creative commons attribution|cc[- ]by) 2\.0", r"creativecommons\.org/licenses/by/2\.0", "2.0"),
    ("cc-by-3.0", r"cc-by-3\.0", r"(?:creative commons attribution|cc[- ]by) 3\.0", r"creativecommons\.org/licenses/by/3\.0", "3.0"),
    ("cc-by-4.0", r"cc-by-4\.0", r"(?:creative commons attribution|cc[- ]by) 4\.0", r"creativecommons\.org/licenses/by/4\.0", "4.0"),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", r"(?:creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa) 3\.0", r"creativecommons\.org/licenses/by-sa/3\.0", "3.0"),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", r"(?:creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa) 4\.0", r"creativecommons\.org/licenses/by-sa/4\.0", "4.0"),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", r"(?:creative commons attribution[- ]non-?commercial|cc[- ]by[- ]nc) 4\.0", r"creativecommons\.org/licenses/by-nc/4\.0", "4.0"),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", r"(?:creative commons attribution[- ]no ?derivatives|cc[- ]by[- ]nd) 4\.0", r"creativecommons\.org/licenses/by-nd/4\.0", "4.0"),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", r"cc[- ]by[- ]nc[- ]sa(?: 4\.0)?", r"creativecommons\.org/licenses/by-nc-sa", "cc"),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", r"cc[- ]by[- ]nc[- ]nd(?: 4\.0)?", r"creativecommons\.org/licenses/by-nc-nd", "cc"),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons )?database licen[sc]e", r"opendatacommons\.org/licenses/odbl", "database licen"),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution licen[sc]e", r"opendatacommons\.org/licenses/by", "open data commons"),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication and licen[sc]e", r"opendatacommons\.org/licenses/pddl", "public domain dedication"),
    ("ofl-1.1", r"ofl-1\.1", r"sil open font licen[sc]e", r"scripts\.sil\.org/ofl", "open font"),
    ("python-2.0", r"(?:python|psf)-2\.0", r"python software foundation licen[sc]e", r"docs\.python\.org/\d/license", "python"),
    ("postgresql", r"postgresql", r"postgresql licen[sc]e", r"opensource\.org/licenses/postgresql", "postgresql"),
    ("php-3.01", r"php-3\.01", r"php licen[sc]e", r"php\.net/license", "php"),
    ("openssl", r"openssl", r"openssl licen[sc]e", r"openssl\.org/source/license", "openssl"),
    ("eupl-1.2", r"eupl-1\.2", r"european union public licen[sc]e", r"joinup\.ec\.europa\.eu/\S*eupl", "european union"),
    ("ms-pl", r"ms-pl", r"microsoft public licen[sc]e", r"opensource\.org/licenses/ms-pl", "microsoft public"),
    ("ncsa", r"ncsa", r"university of illinois/ncsa open source licen[sc]e", r"opensource\.org/licenses/ncsa", "ncsa"),
]
_GRANT = r"(?:licen[sc]ed|released|distributed|made available|provided|available|published|offered) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"

#: Level, label, keyword, expression: signatures that name no licence by the tables above.
OTHERS = [
    (1, "mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    (1, "isc", "permission to use, copy", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose"),
    (1, "bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    (1, "gpl", "free software", r"this program is free software[:;,] you can redistribute it and/or modify"),
    (1, "lgpl", "library is free software", r"this library is free software[:;,] you can redistribute it and/or modify"),
    (1, "apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license"),
    (1, "unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    (1, "zlib", "'as-is'", r"this software is provided 'as-is', without any express or implied warranty"),
    (2, "no-warranty", "warranty", r"without (?:any )?warranty(?: of any kind)?"),
    (2, "no-warranty", "warrant", r"no warrant(?:y|ies), express(?:ed)? or implied"),
    (2, "as-is", "as is", r"provided [\"']?as is[\"']?"),
    (2, "gpl-family", "general public licen", r"(?:gnu )?(?:lesser |library |affero )?general public licen[sc]e"),
    (2, "creative-commons", "creative commons", r"creative commons(?: [a-z]+){0,3} licen[sc]e"),
    (2, "cc-by-sa", "cc", r"\bcc[- ]by[- ]sa\b"),
    (2, "cc-by-nc", "cc", r"\bcc[- ]by[- ]nc\b"),
    (2, "cc-by-nd", "cc", r"\bcc[- ]by[- ]nd\b"),
    (2, "bsd", "bsd", r"\bbsd[- ]style licen[sc]e|\bbsd licen[sc]e"),
    (2, "dual", "dual", r"dual[- ]licen[sc]ed"),
    (2, "public-domain", "public domain", r"\b(?:in|into|to) the public domain\b"),
    (2, "proprietary", "proprietary", r"proprietary(?: and confidential)?(?: information| software| licen[sc]e)"),
    (2, "commercial", "commercial", r"commercial licen[sc]e|non-?commercial use only"),
    (2, "no-redistribution", "may not be", r"may not be (?:copied|reproduced|redistributed)(?:,? (?:or )?(?:copied|reproduced|redistributed))*"),
    (2, "patent-grant", "patent", r"patent (?:licen[sc]e|grant)"),
    (3, "licence-mention", "licen", r"\blicen[sc](?:e|es|ed|ing)\b"),
    (3, "copyright", "copyright", r"\bcopyright(?: \(c\)| ©)?(?: \d{4}(?:\s?[-,]\s?\d{4})*)?"),
    (3, "reserved", "rights reserved", r"(?:all|some|no) rights reserved"),
    (3, "public-domain", "public domain", r"\bpublic domain\b"),
    (3, "copyleft", "copyleft", r"\bcopyleft\b"),
    (3, "trademark", "trademark", r"\b(?:registered )?trademarks?\b"),
    # Clauses and notices, one by one.
    (1, "mit", "above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    (1, "bsd-3-clause", "endorse or promote", r"neither the name of [^\n]{1,120}? nor the names of its contributors may be used to endorse or promote"),
    (1, "bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    (1, "bsd-2-clause", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    (1, "gpl-2.0", "either version 2 of the license", r"either version 2 of the license(?:,? or \(at your option\) any later version)?"),
    (1, "gpl-3.0", "either version 3 of the license", r"either version 3 of the license(?:,? or \(at your option\) any later version)?"),
    (1, "gpl", "you should have received a copy of the gnu", r"you should have received a copy of the gnu general public licen[sc]e"),
    (1, "lgpl", "gnu lesser general public", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    (1, "agpl-3.0", "gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    (1, "gpl-classpath-exception", "as a special exception", r"as a special exception, the copyright holders (?:of this library )?give you permission to link"),
    (1, "gcc-exception", "gcc runtime library exception", r"gcc runtime library exception(?:,? version 3\.1)?"),
    (1, "mpl-2.0", "this source code form is subject to", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    (1, "mpl-1.1", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    (1, "cddl-1.0", "subject to the terms of the common development", r"subject to the terms of the common development and distribution licen[sc]e"),
    (1, "epl", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    (1, "bsl-1.0", "boost software", r"distributed under the boost software licen[sc]e, version 1\.0"),
    (1, "artistic", "standard version", r"you may make and give away verbatim copies of the source form of the standard version"),
    (1, "afl-3.0", "academic free", r"licensed under the academic free licen[sc]e version 3\.0"),
    (1, "osl-3.0", "open software licen", r"licensed under the open software licen[sc]e version 3\.0"),
    (1, "ofl-1.1", "font software", r"this font software is licensed under the sil open font licen[sc]e"),
    (1, "ofl-1.1", "reserved font name", r"with reserved font names?"),
    (1, "cc0-1.0", "to the extent possible under law", r"to the extent possible under law, [^\n]{1,120}? waived all copyright"),
    (1, "cc0-1.0", "no rights reserved", r"\bcc0[^\n]{0,20}no rights reserved|no rights reserved \(cc0"),
    (1, "cc-by-4.0", "attribution 4.0 international", r"creative commons attribution 4\.0 international(?: public)?(?: licen[sc]e)?"),
    (1, "cc-by-sa-4.0", "sharealike 4.0 international", r"attribution-sharealike 4\.0 international(?: public)?(?: licen[sc]e)?"),
    (1, "cc-by-nc-4.0", "noncommercial 4.0 international", r"attribution-noncommercial 4\.0 international(?: public)?(?: licen[sc]e)?"),
    (1, "cc-by-nd-4.0", "noderivatives 4.0 international", r"attribution-(?:noncommercial-)?noderivatives 4\.0 international(?: public)?(?: licen[sc]e)?"),
    (1, "cc-by-sa-3.0", "3.0 unported", r"attribution-share ?alike 3\.0 unported"),
    (1, "cc-by-3.0", "3.0 unported", r"attribution 3\.0 unported"),
    (1, "wtfpl", "you just do what", r"you just do what the f\w+ you want to"),
    (1, "beerware", "beer", r"\bbeer-?ware licen[sc]e|buy me a beer in return"),
    (1, "json", "shall be used for good", r"the software shall be used for good, not evil"),
    (1, "ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    (1, "openssl", "openssl toolkit", r"includes software developed by the openssl project for use in the openssl toolkit"),
    (1, "curl", "curl licen", r"\bcurl licen[sc]e\b"),
    (1, "vim", "vim licen", r"\bvim licen[sc]e\b"),
    (1, "ruby", "ruby licen", r"\bruby licen[sc]e\b"),
    (1, "tcl", "tcl/tk", r"tcl/tk licen[sc]e"),
    (1, "x11", "x consortium", r"the x consortium shall not be used in advertising"),
    (1, "hpnd", "historical permission notice", r"historical permission notice and disclaimer"),
    (1, "icu", "unicode, inc", r"unicode, inc\.? licen[sc]e agreement|unicode, inc\. data files"),
    (1, "w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[sc]e"),
    (1, "libpng", "png reference library", r"png reference library licen[sc]e"),
    (1, "bzip2", "bzip2", r"bzip2 and libbzip2 licen[sc]e|\bbzip2 licen[sc]e"),
    (1, "sleepycat", "sleepycat", r"sleepycat (?:software )?(?:public )?licen[sc]e"),
    (1, "elastic-2.0", "elastic licen", r"elastic licen[sc]e(?: version)? 2\.0"),
    (1, "sspl-1.0", "server side public", r"server side public licen[sc]e"),
    (1, "busl-1.1", "business source", r"business source licen[sc]e(?: 1\.1)?"),
    (1, "polyform", "polyform", r"polyform (?:noncommercial|strict|shield|small business|free trial) licen[sc]e"),
    (1, "openrail", "openrail", r"\bopenrail(?:\+\+|-m|-s|-d)?(?: licen[sc]e)?"),
    (1, "llama-community", "community licen", r"llama \d(?:\.\d)? community licen[sc]e"),
    (2, "source-available", "source-available", r"\bsource-available\b"),
    (2, "no-liability", "in no event shall", r"in no event shall [^\n]{1,160}? be liable"),
    (2, "no-fitness", "fitness for a particular purpose", r"(?:merchantability (?:or|and) )?fitness for a particular purpose"),
    (2, "notice-kept", "must retain", r"must retain (?:the above|this|all) (?:copyright )?notices?"),
    (2, "royalty-free", "royalty-free", r"(?:perpetual|worldwide|non-exclusive)(?:, (?:worldwide|non-exclusive|no-charge))*,? royalty-free"),
    (2, "attribution-asked", "with attribution", r"(?:free to use|may be used|reuse[d]?) with attribution"),
    (2, "credit-asked", "give appropriate credit", r"you must give appropriate credit"),
    (2, "share-alike-asked", "under the same licen", r"distribute (?:your contributions|it|them) under the same licen[sc]e"),
    (2, "non-commercial", "non-commercial", r"(?:for )?non-commercial (?:use|purposes?|research)(?: only)?"),
    (2, "research-only", "research purposes only", r"(?:for )?(?:academic|scientific|non-profit)? ?research purposes only"),
    (2, "personal-use", "personal use only", r"(?:for )?(?:your )?personal use only"),
    (2, "educational-use", "educational", r"(?:for )?educational (?:use|purposes) only"),
    (2, "internal-use", "internal use only", r"(?:for )?internal use only"),
    (2, "evaluation-only", "evaluation", r"(?:for )?evaluation (?:use|purposes) only"),
    (2, "permission-asked", "prior written", r"without (?:the )?(?:express )?prior written (?:permission|consent)"),
    (2, "no-derivatives", "derivative works", r"(?:no|not create|may not create|not make) derivative works"),
    (2, "no-resale", "resale", r"not for resale"),
    (2, "confidential", "confidential", r"(?:strictly |company )?confidential and proprietary|this (?:document|message|file) is (?:strictly )?confidential"),
    (2, "trade-secret", "trade secret", r"(?:contains|constitutes) (?:valuable )?trade secrets?"),
    (2, "government-rights", "u.s. government", r"u\.s\. government (?:restricted rights|end users)"),
    (2, "government-work", "work of the", r"work of the (?:u\.s\.|united states) government"),
    (2, "crown-copyright", "crown copyright", r"(?:© )?crown copyright"),
    (2, "ogl-3.0", "open government", r"open government licen[sc]e(?: v?3\.0)?"),
    (2, "etalab", "licence ouverte", r"licence ouverte(?: / open licence)?"),
    (2, "dl-de", "datenlizenz deutschland", r"datenlizenz deutschland(?: [-–] \w+)?"),
    (2, "subject-to-licence", "see the license for", r"see the license for the specific language governing permissions"),
    (2, "licence-file", "see licen", r"see licen[sc]e(?:\.txt|\.md| file)? (?:in the project root )?for (?:license information|details|more information)"),
    (2, "terms-accepted", "by using this", r"by using this (?:software|site|website|file),? you (?:agree|accept)"),
    (3, "terms-of-use", "terms of", r"\bterms of (?:use|service)\b"),
    (3, "eula", "end user licen", r"\bend user licen[sc]e agreement\b|\bend user license\b"),
    (3, "open-source", "open source", r"\bopen source (?:software|licen[sc]e|initiative)\b"),
    (3, "shareware", "shareware", r"\bshareware\b"),
    (3, "freeware", "freeware", r"\bfreeware\b"),
    (3, "patent-pending", "patent pending", r"\bpatent pending\b"),
]


def _rules() -> list[tuple[int, str, str, str]]:
    out = []
    for label, spdx, _, _, _ in LICENSES:
        out.append((1, label, "spdx-license-identifier", r"spdx-license-identifier:\s*" + spdx + r"(?![\w.+-])"))
    for label, _, name, _, keyword in LICENSES:
        out.append((1, label, keyword, _GRANT + f"(?:{name})"))
    for label, _, _, address, _ in LICENSES:
        out.append((1, label, re.split(r"[\\(?]", address)[0], r"https?://(?:www\.)?" + address))
    for label, _, name, _, keyword in LICENSES:
        out.append((2, label, keyword, r"\b(?:" + name + r")(?!\w)"))
    return out + OTHERS


#: Ordered rules, over 300: (level, label, keyword, expression).
RULES = _rules()
#: Each keyword is looked for once in a text, however many rules have it.
KEYWORDS = sorted({keyword for _, _, keyword, _ in RULES})
_CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.4}
_BASE_CONFIDENCE = 0.6


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_array() -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('rule', {k}, 'level', {level}, 'label', {_literal(label)}, 'keyword', {_literal(keyword)}, 'regex', {_literal(regex)})" for k, (level, label, keyword, regex) in enumerate(RULES)) + ")")


_SPAN = "struct<start:int,end:int>"


def _hits(text: Column, rule: Column) -> Column:
    """All matches of a rule with their places, from the lengths of the matches and of what stands between them."""
    between = lambda n: F.slice(F.split(text, rule["regex"], -1), 1, n)
    lengths = bound(F.regexp_extract_all(text, rule["regex"], F.lit(0)), lambda found: F.when(F.size(found) > 0, F.zip_with(between(F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("before"), F.length(m).alias("match")))).otherwise(F.expr("cast(array() as array<struct<before:int,match:int>>)")))
    spans = scanned(lengths, F.lit(0), lambda at, x: at + x["before"] + x["match"], lambda at, x: F.struct((at + x["before"]).alias("start"), (at + x["before"] + x["match"]).alias("end")), _SPAN)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), rule["level"].alias("level"), rule["rule"].alias("rule"), rule["label"].alias("label")))


def _kept_hits(hits: Column) -> Column:
    """Hits that no other contains, if it is as strong: in order of start, longest first, a hit is out if one of its
    level or a stronger one ended as late before it."""
    levels = sorted(_CONFIDENCE)
    zero = F.struct(*[F.lit(-1).alias(f"to{k}") for k in levels])
    step = lambda s, h: F.struct(*[F.when((h["level"] <= k) & (-h["until"] > s[f"to{k}"]), -h["until"]).otherwise(s[f"to{k}"]).alias(f"to{k}") for k in levels])

    def covered(s: Column, h: Column) -> Column:
        reach = F.lit(-1)
        for k in levels:
            reach = F.when(h["level"] == k, s[f"to{k}"]).otherwise(reach)
        return reach >= -h["until"]

    made = lambda s, h: F.when(~covered(s, h), F.struct(h["start"].alias("start"), (-h["until"]).alias("end"), h["level"].alias("level"), h["rule"].alias("rule"), h["label"].alias("label")))
    found = scanned(F.array_sort(hits), zero, step, made, "struct<start:int,end:int,level:int,rule:int,label:string>")
    return F.filter(found, lambda h: h.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and `hits`: start, end, level, rule, label of what stays."""
    text = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase).alias("t"))
    count = lambda c: F.regexp_count(c, F.lit(WORDS)).cast("long")
    maybe = F.contains("t", F.lit("cc")) | F.contains("t", F.lit("general")) | F.contains("t", F.lit("rights"))
    empty = F.expr("cast(array() as array<string>)")
    based = text.select("doc_id", "t", count(F.col("t")).alias("n_words"), F.when(maybe, F.regexp_extract_all("t", F.lit(BASE), F.lit(0))).otherwise(empty).alias("found"), F.when(maybe, F.split("t", BASE, -1)).otherwise(F.array("t")).alias("parts"))
    present = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(F.col("t"), k))
    gated = F.filter(_rule_array(), lambda r: F.array_contains(F.col("present"), r["keyword"]))
    none = F.expr("cast(array() as array<struct<start:int,until:int,level:int,rule:int,label:string>>)")
    hits = F.when(F.size("present") > 0, F.flatten(F.transform(gated, lambda r: _hits(F.col("t"), r)))).otherwise(none)
    placed = based.withColumn("present", present).select("doc_id", "t", "n_words", "found", "parts", hits.alias("all_hits"))
    kept = placed.select("doc_id", "n_words", "found", "parts", _kept_hits(F.col("all_hits")).alias("hits"))
    n = F.size("found")
    label = lambda m: F.when(F.startswith(m, F.lit("cc")), "cc-by").when(F.startswith(m, F.lit("general")), "gpl").otherwise("reserved")
    base_labels = F.array_sort(F.array_distinct(F.transform("found", label)))
    last = F.col("n_words") - count(F.element_at("parts", -1)) - F.when(F.startswith(F.element_at("found", -1), F.lit("cc")), 2).otherwise(3)
    level = F.array_min(F.col("hits.level"))
    confidence = F.coalesce(*[F.when(level == k, v) for k, v in _CONFIDENCE.items()], F.lit(0.0))
    return kept.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.when(n > 0, count(F.element_at("parts", 1))).alias("first_word"),
        F.when(n > 0, last).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.array_distinct(F.col("hits.label")))), ",").alias("labels"),
        F.greatest(confidence, F.when(n > 0, _BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        "hits",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("hits")


def brute_force(text: str | None) -> tuple[int, int, int | None, int | None, str, str]:
    """For tests: the same columns up to labels, from word lists and Python's regular expressions."""
    t = (text or "").translate({a: b for a, b in zip(map(ord, ascii_uppercase), ascii_lowercase, strict=True)})
    w = re.findall(WORDS, t)
    at = sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    hits = [(m.start(), m.end(), level, k, label) for k, (level, label, _, regex) in enumerate(RULES) for m in re.finditer(regex, t, re.ASCII)]
    stay = [h for h in hits if not any(g[2] <= h[2] and g[0] <= h[0] and g[1] >= h[1] and (g[0] < h[0] or g[1] > h[1] or g[2:4] < h[2:4]) for g in hits)]
    base = {label for _, label in at}
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | {h[4] for h in stay}))
