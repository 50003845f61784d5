"""Signature rules of the license scan, over texts reduced to lower-case words parted by single spaces.

A rule is (level, label, keywords, pattern): the pattern is tried only where all keywords
are words of the text.  ``<2.0>`` stands for a version as it is written: "version 2 0",
"v2 0", "2" and so on.  Patterns are regular expressions that Java, RE2 and Python read
alike (no look-around, no back references), and match whole words.
"""

from __future__ import annotations

import re

#: Levels of evidence, strongest first, and the confidence each gives.
LEVELS = {"text": 1.0, "tag": 0.95, "notice": 0.9, "url": 0.85, "title": 0.8, "field": 0.6}
#: Confidence of the base phrases alone.
PHRASE = 0.3

# Fixed values, by hand: label | keywords | the license's name in running text.
NAMES = """
apache-1.0 | apache | apache (?:software )?licen[sc]e <1.0>
apache-1.1 | apache | apache (?:software )?licen[sc]e <1.1>
apache-2.0 | apache | apache (?:software )?(?:public )?licen[sc]e <2.0>
apache-2.0 | apache | apache <2.0>(?: licen[sc]ed?)?
apache-2.0 | asl | asl <2.0>
mit | mit | (?:the )?mit licen[sc]e
mit | expat | expat licen[sc]e
mit-0 | mit | mit no attribution(?: licen[sc]e)?
mit-0 | mit | mit 0(?: licen[sc]e)?
x11 | x11 | (?:mit )?x11 licen[sc]e
isc | isc | (?:the )?isc licen[sc]e
0bsd | 0bsd | 0bsd(?: licen[sc]e)?
0bsd | bsd | (?:bsd )?zero clause bsd(?: licen[sc]e)?
bsd-1-clause | bsd | bsd (?:1|one) clause(?: licen[sc]e)?
bsd-2-clause | bsd | (?:simplified|freebsd|two clause|2 clause) bsd licen[sc]e
bsd-2-clause | bsd | bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?
bsd-2-clause-patent | bsd patent | bsd (?:2 clause )?plus patent(?: licen[sc]e)?
bsd-3-clause | bsd | (?:new|modified|revised|three clause|3 clause) bsd licen[sc]e
bsd-3-clause | bsd | bsd (?:3|three) clause(?: new| revised| modified)?(?: licen[sc]e)?
bsd-3-clause-clear | bsd clear | (?:the )?clear bsd licen[sc]e
bsd-4-clause | bsd | (?:original|old|four clause|4 clause) bsd licen[sc]e
bsd-4-clause | bsd | bsd (?:4|four) clause(?: original)?(?: licen[sc]e)?
bsd | bsd | (?:the )?bsd(?: style| type)? licen[sc]e
gpl-1.0 | general public | (?:gnu )?general public licen[sc]e <1.0>
gpl-2.0 | general public | (?:gnu )?general public licen[sc]e <2.0>(?: only)?
gpl-2.0-or-later | general public | (?:gnu )?general public licen[sc]e <2.0> or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0 | general public | (?:gnu )?general public licen[sc]e <3.0>(?: only)?
gpl-3.0-or-later | general public | (?:gnu )?general public licen[sc]e <3.0> or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0 | gnu gpl | gnu gpl <2.0>(?: only)?
gpl-2.0-or-later | gnu gpl | gnu gpl <2.0> or (?:any )?later(?: version)?
gpl-3.0 | gnu gpl | gnu gpl <3.0>(?: only)?
gpl-3.0-or-later | gnu gpl | gnu gpl <3.0> or (?:any )?later(?: version)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: only)?
gpl-2.0-or-later | gplv2 | (?:gnu )?gplv2 or (?:any )?later(?: version)?
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: only)?
gpl-3.0-or-later | gplv3 | (?:gnu )?gplv3 or (?:any )?later(?: version)?
lgpl-2.0 | library public | (?:gnu )?library general public licen[sc]e <2.0>
lgpl-2.1 | lesser public | (?:gnu )?lesser general public licen[sc]e <2.1>(?: only)?
lgpl-2.1-or-later | lesser public | (?:gnu )?lesser general public licen[sc]e <2.1> or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0 | lesser public | (?:gnu )?lesser general public licen[sc]e <3.0>(?: only)?
lgpl-3.0-or-later | lesser public | (?:gnu )?lesser general public licen[sc]e <3.0> or (?:at your option )?(?:any )?later(?: version)?
lgpl | lesser public | (?:gnu )?(?:lesser|library) general public licen[sc]e
lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2 1
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
agpl-3.0 | affero public | (?:gnu )?affero general public licen[sc]e(?: <3.0>)?(?: only)?
agpl-3.0-or-later | affero public | (?:gnu )?affero general public licen[sc]e <3.0> or (?:at your option )?(?:any )?later(?: version)?
agpl-3.0 | agplv3 | (?:gnu )?agplv3
sspl-1.0 | side public | server side public licen[sc]e(?: <1.0>)?
gfdl-1.2 | documentation | (?:gnu )?free documentation licen[sc]e <1.2>
gfdl-1.3 | documentation | (?:gnu )?free documentation licen[sc]e <1.3>
gfdl | documentation | (?:gnu )?free documentation licen[sc]e
mpl-1.0 | mozilla | mozilla public licen[sc]e <1.0>
mpl-1.1 | mozilla | mozilla public licen[sc]e <1.1>
mpl-2.0 | mozilla | mozilla public licen[sc]e <2.0>
epl-1.0 | eclipse | eclipse public licen[sc]e <1.0>
epl-2.0 | eclipse | eclipse public licen[sc]e <2.0>
edl-1.0 | eclipse | eclipse distribution licen[sc]e <1.0>
cddl-1.0 | development | common development and distribution licen[sc]e(?: <1.0>)?
cddl-1.1 | development | common development and distribution licen[sc]e <1.1>
cpl-1.0 | common | common public licen[sc]e <1.0>
ipl-1.0 | ibm | ibm public licen[sc]e <1.0>
eupl-1.1 | european | european union public licen[sc]e <1.1>
eupl-1.2 | european | european union public licen[sc]e <1.2>
osl-3.0 | open | open software licen[sc]e <3.0>
afl-3.0 | academic | academic free licen[sc]e <3.0>
artistic-1.0 | artistic | artistic licen[sc]e <1.0>
artistic-2.0 | artistic | artistic licen[sc]e <2.0>
bsl-1.0 | boost | boost software licen[sc]e(?: <1.0>)?
busl-1.1 | business | business source licen[sc]e(?: <1.1>)?
elastic-2.0 | elastic | elastic licen[sc]e <2.0>
cecill-2.1 | cecill | cecill(?: free software licen[sc]e(?: agreement)?)?(?: <2.1>)?
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
mulan-psl-2.0 | mulan | mulan (?:psl|permissive software licen[sc]e) <2.0>
ms-pl | microsoft | microsoft public licen[sc]e
ms-rl | microsoft | microsoft reciprocal licen[sc]e
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
openssl | openssl | openssl licen[sc]e
php-3.01 | php | php licen[sc]e <3.01>
postgresql | postgresql | postgresql licen[sc]e
psf-2.0 | python | python software foundation licen[sc]e(?: <2.0>)?
ruby | ruby | ruby licen[sc]e
unicode-dfs | unicode | unicode licen[sc]e agreement
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | universal | universal permissive licen[sc]e(?: <1.0>)?
w3c | w3c | w3c software (?:notice and )?(?:and document )?licen[sc]e
wtfpl | wtfpl | wtfpl(?: <2.0>)?
zlib | zlib | zlib(?: libpng)? licen[sc]e
zpl-2.1 | zope | zope public licen[sc]e <2.1>
ofl-1.1 | sil | sil open font licen[sc]e(?: <1.1>)?
vim | vim | vim licen[sc]e
odbl-1.0 | odbl | odbl(?: <1.0>)?
odbl-1.0 | database | open (?:data commons open )?database licen[sc]e(?: odbl)?
odc-by-1.0 | commons | open data commons attribution licen[sc]e(?: <1.0>)?
pddl-1.0 | dedication | (?:open data commons )?public domain dedication and licen[sc]e
ogl-3.0 | government | open government licen[sc]e(?: <3.0>)?
cdla-permissive-2.0 | community | community data licen[sc]e agreement permissive <2.0>
cdla-sharing-1.0 | community | community data licen[sc]e agreement sharing <1.0>
openrail-m | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?
openrail-m | rail | (?:bigscience |creativeml )?open rail m(?: licen[sc]e)?
llama-community | llama | llama (?:[0-9]+ )?(?:[0-9]+ )?community licen[sc]e(?: agreement)?
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: <1.0>)?(?: universal)?
cc0-1.0 | creative zero | creative commons zero(?: <1.0>)?(?: universal)?
cc-by-2.0 | cc by | cc by <2.0>
cc-by-2.5 | cc by | cc by <2.5>
cc-by-3.0 | cc by | cc by <3.0>
cc-by-4.0 | cc by | cc by <4.0>
cc-by-sa-2.0 | cc sa | cc by sa <2.0>
cc-by-sa-3.0 | cc sa | cc by sa <3.0>
cc-by-sa-4.0 | cc sa | cc by sa <4.0>
cc-by-nc-3.0 | cc nc | cc by nc <3.0>
cc-by-nc-4.0 | cc nc | cc by nc <4.0>
cc-by-nd-3.0 | cc nd | cc by nd <3.0>
cc-by-nd-4.0 | cc nd | cc by nd <4.0>
cc-by-nc-sa-3.0 | cc nc sa | cc by nc sa <3.0>
cc-by-nc-sa-4.0 | cc nc sa | cc by nc sa <4.0>
cc-by-nc-nd-3.0 | cc nc nd | cc by nc nd <3.0>
cc-by-nc-nd-4.0 | cc nc nd | cc by nc nd <4.0>
cc-by-sa | cc sa | cc by sa
cc-by-nc | cc nc | cc by nc
cc-by-nd | cc nd | cc by nd
cc-by-nc-sa | cc nc sa | cc by nc sa
cc-by-nc-nd | cc nc nd | cc by nc nd
cc-by-3.0 | creative attribution | creative commons attribution <3.0>(?: unported)?(?: licen[sc]e)?
cc-by-4.0 | creative attribution | creative commons attribution <4.0>(?: international)?(?: public)?(?: licen[sc]e)?
cc-by | creative attribution | creative commons attribution(?: licen[sc]e)?
cc-by-sa-3.0 | creative attribution | creative commons attribution share ?alike <3.0>(?: unported)?(?: licen[sc]e)?
cc-by-sa-4.0 | creative attribution | creative commons attribution share ?alike <4.0>(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-sa | creative attribution | creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nc-4.0 | creative attribution | creative commons attribution non ?commercial <4.0>(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc | creative attribution | creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nd-4.0 | creative attribution | creative commons attribution no ?deriv(?:s|atives|ative works) <4.0>(?: international)?(?: licen[sc]e)?
cc-by-nd | creative attribution | creative commons attribution no ?deriv(?:s|atives|ative works)(?: licen[sc]e)?
cc-by-nc-sa-4.0 | creative attribution | creative commons attribution non ?commercial share ?alike <4.0>(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-sa | creative attribution | creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc-nd-4.0 | creative attribution | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works) <4.0>(?: international)?(?: licen[sc]e)?
cc-by-nc-nd | creative attribution | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: licen[sc]e)?
creative-commons | creative | creative commons licen[sc]e
public-domain | domain | (?:dedicated|released|placed) (?:in|in ?to|to) the public domain
public-domain | domain | (?:is|are) in the public domain
"""

# Fixed values, by hand: label | keywords | a sentence that only this license's text or header has.
TEXTS = """
mit | hereby associated | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | purpose hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | purpose hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-2-clause | redistributions binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3-clause | endorse promote | neither the names? of .{1,120} may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | apache compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at (?:http|https) www apache org
apache-2.0 | perpetual irrevocable | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
gpl-2.0-or-later | redistribute gnu | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or
gpl-3.0-or-later | redistribute gnu | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or
gpl-2.0 | redistribute gnu | you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3.0 | redistribute gnu | you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation
lgpl-2.1-or-later | redistribute gnu | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or
lgpl-3.0-or-later | redistribute gnu | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or
agpl-3.0-or-later | redistribute affero | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or
gpl | details gnu | see the gnu general public license for more details
lgpl | details lesser | see the gnu lesser general public license for more details
agpl-3.0 | details affero | see the gnu affero general public license for more details
mpl-2.0 | mozilla subject | this source code form is subject to the terms of the mozilla public license <2.0>
mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license <2.0>
cddl-1.0 | development distribution | the contents of this file are subject to the terms of the common development and distribution license
artistic-2.0 | artistic | this package is free software you can redistribute it and or modify it under the terms of the artistic license <2.0>
bsl-1.0 | boost | distributed under the boost software license(?: version 1 0)?
zlib | misrepresented claim | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered plainly | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
wtfpl | everyone verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
gpl | everyone verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
ofl-1.1 | font sil | this font software is licensed under the sil open font license version 1 1
cc0-1.0 | waived worldwide | has waived all copyright and related or neighboring rights to this work worldwide
cc-by | creative attribution | this work is licensed under (?:a|the) creative commons attribution [0-9] [0-9] (?:international|unported|generic) license
cc-by-sa | creative attribution | this work is licensed under (?:a|the) creative commons attribution share ?alike [0-9] [0-9] (?:international|unported|generic) license
cc-by-nc | creative attribution | this work is licensed under (?:a|the) creative commons attribution non ?commercial [0-9] [0-9] (?:international|unported|generic) license
cc-by-nc-sa | creative attribution | this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike [0-9] [0-9] (?:international|unported|generic) license
cc-by-nc-nd | creative attribution | this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?derivatives [0-9] [0-9] (?:international|unported|generic) license
gfdl-1.2 | documentation granted | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl-1.3 | documentation granted | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
postgresql | california damages | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
psf-2.0 | psf nonexclusive | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce
ncsa | illinois hereby | developed by .{1,80} university of illinois .{1,200} permission is hereby granted free of charge
beerware | beer worth | if we meet some day and you think this stuff is worth it you can buy me a beer in return
json | good evil | the software shall be used for good not evil
proprietary | confidential proprietary | (?:this (?:software|document|file|information) is|contains) (?:the )?(?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary | unauthorized strictly | unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material)(?: .{1,60})? is strictly prohibited
proprietary | part reproduced | no part of this (?:publication|book|document|work) may be reproduced
"""

# Fixed values, by hand: label | keywords | address of the license.
URLS = """
apache-2.0 | apache org | apache org licenses license 2 0
apache-2.0 | opensource org | opensource org licenses? apache 2 0
mit | opensource mit | opensource org licenses? mit
mit | choosealicense mit | choosealicense com licenses mit
bsd-2-clause | opensource bsd | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource bsd | opensource org licenses? bsd 3 clause
isc | opensource isc | opensource org licenses? isc
gpl-2.0 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu org | gnu org licenses gpl 3 0
lgpl-2.1 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | gnu org | gnu org licenses lgpl 3 0
agpl-3.0 | gnu org | gnu org licenses agpl 3 0
gfdl-1.3 | gnu org | gnu org licenses fdl 1 3
gpl | gnu org | gnu org licenses gpl
lgpl | gnu org | gnu org licenses lgpl
mpl-2.0 | mozilla org | mozilla org mpl 2 0
mpl-1.1 | mozilla org | mozilla org mpl 1 1
epl-1.0 | eclipse org | eclipse org legal epl v10
epl-2.0 | eclipse org | eclipse org legal epl (?:v20|2 0)
bsl-1.0 | boost org | boost org license 1 0
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | wtfpl net
ofl-1.1 | sil org | scripts sil org ofl
odbl-1.0 | opendatacommons org | opendatacommons org licenses odbl
pddl-1.0 | opendatacommons org | opendatacommons org licenses pddl
odc-by-1.0 | opendatacommons org | opendatacommons org licenses by
cc-by-2.0 | creativecommons org | creativecommons org licenses by 2 0
cc-by-2.5 | creativecommons org | creativecommons org licenses by 2 5
cc-by-3.0 | creativecommons org | creativecommons org licenses by 3 0
cc-by-4.0 | creativecommons org | creativecommons org licenses by 4 0
cc-by-sa-2.0 | creativecommons org | creativecommons org licenses by sa 2 0
cc-by-sa-3.0 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-nc-3.0 | creativecommons org | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons org | creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | creativecommons org | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org | creativecommons org licenses by nc nd 4 0
cc0-1.0 | creativecommons org | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org | creativecommons org publicdomain mark 1 0
ogl-3.0 | nationalarchives gov | nationalarchives gov uk doc open government licence version 3
eupl-1.2 | joinup eu | joinup ec europa eu .{1,60} eupl
"""

_NOTICE = (
    "(?:licensed|released|distributed|available|provided|published|redistributed|covered|governed|shared|offered|dual licensed) "
    "(?:under|by|with|via) (?:the |an |a )?(?:terms (?:and conditions )?of (?:the |an |a )?|conditions of (?:the |an |a )?)?"
)


def _version(m: re.Match) -> str:
    major, minor = m[1], m[2]
    tail = "" if minor is None else "(?: 0)?" if minor == "0" else f" {minor}"
    return f"(?:version |v |v|versions )?{major}{tail}"


def _lines(block: str) -> list[tuple[str, tuple[str, ...], str]]:
    rows = (line.split(" | ") for line in block.strip().split("\n"))
    return [(label, tuple(keys.split()), re.sub(r"<(\d+)\.(\d+)>", _version, pattern)) for label, keys, pattern in rows]


def _identifiers() -> list[tuple[str, str]]:
    """(label, its identifier as words) of every label that is an identifier."""
    labels = dict.fromkeys(label for label, _, _ in _lines(NAMES) if label not in ("public-domain", "creative-commons"))
    return [(label, re.sub("[^a-z0-9]+", " ", label)) for label in labels]


def rules() -> list[tuple[int, str, tuple[str, ...], str]]:
    """(level from 0, label, keywords, pattern), in order of priority.

    Written rules come as they stand; from each name follow its title and its notice
    ("licensed under ..."), from each identifier its tag and its field ("license: ...").
    """
    names, ids = _lines(NAMES), _identifiers()
    by_level = {
        "text": _lines(TEXTS),
        "tag": [(label, ("spdx", words.split()[0]), f"spdx license identifier {words}(?: only)?") for label, words in ids],
        "notice": [(label, keys, f"{_NOTICE}{pattern}") for label, keys, pattern in names],
        "url": _lines(URLS),
        "title": names,
        "field": [(label, (words.split()[0],), f"licen[sc]es? {words}") for label, words in ids],
    }
    return [(k, *rule) for k, level in enumerate(LEVELS) for rule in by_level[level]]
