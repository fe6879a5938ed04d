"""Hand-written signatures of licences and notices, and how they are gated.

Texts are matched as lower-case words joined by single blanks, so patterns hold no marks. Of
three kinds, by descending priority: sentences of the licences' own texts and headers
(``SIGNATURES``), names inside a granting sentence (``NAMES`` in ``SENTENCES``), notices that
name no licence (``NOTICES``) and names alone. Every rule holds a keyword that any match holds.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

#: label: sentences of its own text or header. ``*`` stands for one to eight words.
SIGNATURES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "use of this source code is governed by a bsd style license",
    ],
    "bsd-3-clause": [
        "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-4-clause": ["all advertising materials mentioning features or use of this software must display the following acknowledge?ment"],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "apache org licenses license 2 0",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
    ],
    "apache-1.1": ["this product includes software developed by the apache software foundation"],
    "gpl": [
        "this (?:program|library|software|file) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this (?:program|library|software|file)",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "the licenses for most software are designed to take away your freedom to share and change it",
        "the gnu general public license is a free copyleft license for software and other kinds of works",
        "this program comes with absolutely no warranty",
        "this is free software and you are welcome to redistribute it under certain conditions",
        "gnu org licenses gpl",
    ],
    "gpl-2.0": [
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "under the terms of the gnu general public license version 2 as published by the free software foundation",
        "gnu general public license version 2 june 1991",
    ],
    "gpl-3.0": [
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "under the terms of the gnu general public license version 3 as published by the free software foundation",
        "gnu general public license version 3 29 june 2007",
    ],
    "lgpl-2.1": [
        "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
        "gnu lesser general public license version 2 1 february 1999",
    ],
    "lgpl-3.0": [
        "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",
    ],
    "lgpl": ["you should have received a copy of the gnu (?:lesser|library) general public license along with this", "a work that uses the library in isolation is not a derivative work of the library"],
    "agpl-3.0": [
        "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
        "you should have received a copy of the gnu affero general public license along with this",
        "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    ],
    "gfdl": [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "with no invariant sections no front cover texts and no back cover texts",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "this source code form is incompatible with secondary licenses as defined by the mozilla public license",
    ],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version 1 1 the license", "the initial developer of the original code is"],
    "epl-1.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "the accompanying program is provided under the terms of this eclipse public license agreement"],
    "cddl-1.0": ["the contents of this file are subject to the terms of the common development and distribution license", "you can obtain a copy of the license at usr src opensolaris license"],
    "cpl-1.0": ["the accompanying program is provided under the terms of this common public license agreement"],
    "eupl": ["licensed under the eupl version 1 [12] or as soon they will be approved by the european commission subsequent versions of the eupl"],
    "artistic-1.0": ["you may make and give away verbatim copies of the source form of the standard version of this package without restriction", "the intent of this document is to state the conditions under which a package may be copied"],
    "artistic-2.0": ["this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"],
    "isc": [
        "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ],
    "boost": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "distributed under the boost software license version 1 0",
        "boost org license 1 0 txt",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ],
    "wtfpl": ["you just do what the fuck you want to", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "cc0": [
        "to the extent possible under law * has waived all copyright and related or neighboring rights to this work",
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "creativecommons org publicdomain zero 1 0",
    ],
    "cc-by": [
        "you are free to share copy and redistribute the material in any medium or format",
        "you must give appropriate credit provide a link to the license and indicate if changes were made",
        "creativecommons org licenses by [1234] [05]",
    ],
    "cc-by-sa": ["if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "creativecommons org licenses by sa [1234] [05]"],
    "cc-by-nc": ["you may not use the material for commercial purposes", "creativecommons org licenses by nc [1234] [05]"],
    "cc-by-nd": ["if you remix transform or build upon the material you may not distribute the modified material", "creativecommons org licenses by nd [1234] [05]"],
    "cc-by-nc-sa": ["creativecommons org licenses by nc sa [1234] [05]"],
    "cc-by-nc-nd": ["creativecommons org licenses by nc nd [1234] [05]"],
    "odbl": ["this * is made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license", "opendatacommons org licenses odbl"],
    "ofl": ["this font software is licensed under the sil open font license version 1 1", "the font software may be bundled redistributed and or sold with any software"],
    "ogl": ["contains public sector information licensed under the open government licence"],
    "psf": ["psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly", "this license agreement is between the python software foundation psf and the individual or organization"],
    "php": ["this product includes php software freely available from", "this source file is subject to version 3 0[01]? of the php license"],
    "openssl": ["this product includes software developed by the openssl project for use in the openssl toolkit"],
    "ssleay": ["this product includes cryptographic software written by eric young"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"],
    "ncsa": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "to deal with the software without restriction including without limitation the rights to use"],
    "ms-pl": ["if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license from such contributor to the software ends automatically"],
    "w3c": ["permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"],
    "x11": ["except as contained in this notice the name of * shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"],
    "curl": ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "json": ["the software shall be used for good not evil"],
    "beerware": ["as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer"],
    "vim": ["there are no restrictions on distributing unmodified copies of vim"],
    "upl": ["subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"],
    "bsl": ["the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"],
    "sspl": ["if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"],
    "elastic": ["you may not provide the software to third parties as a hosted or managed service"],
    "openrail": ["you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law"],
    "llama": ["if you use the llama materials to create train fine tune or otherwise improve an ai model"],
}
#: Notices that name no licence.
NOTICES = {
    "reserved": [
        "all rights reserved", "all rights are reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "tutti i diritti riservati",
        "no part of this (?:publication|book|work) may be reproduced", "reproduction in whole or in part is prohibited", "nachdruck verboten", "toute reproduction interdite", "prohibida su reproducción",
    ],
    "copyright": ["copyright (?:c )?(?:19|20)\\d\\d", "copyright (?:c )?by", "urheberrechtlich geschützt", "protégé par le droit d auteur", "protegido por derechos de autor"],
    "public-domain": ["(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain work", "this (?:work|file) is in the public domain", "no known copyright restrictions", "gemeinfrei"],
    "proprietary": [
        "proprietary and confidential", "confidential and proprietary information of", "unauthorized (?:copying|reproduction|use) (?:of this file |or distribution )?is (?:strictly )?prohibited", "use is subject to license terms",
        "for internal use only do not distribute", "may not be copied or distributed without (?:the )?prior written permission", "trade secrets? of",
    ],
    "permission": ["permission is hereby granted free of charge to any person obtaining a copy", "reproduced (?:here )?with (?:kind )?permission of", "used (?:here )?by permission"],
    "redistribution": ["redistribution and use in source and binary forms"],
    "noncommercial": ["for non ?commercial use only", "personal and non ?commercial use", "for research purposes only"],
    "gpl": ["general public license"],
}
#: label: patterns of its name; the first word of each is part of its keyword gate.
NAMES = {
    "apache-2.0": [r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", r"apache 2(?: 0)? license"],
    "apache-1.1": [r"apache(?: software)?(?: license)?(?: version)? 1 1"],
    "apache": [r"apache(?: software)? license"],
    "mit": [r"mit license", r"mit open source license", r"expat license"],
    "bsd-2-clause": [r"bsd 2 clause", r"2 clause bsd", r"simplified bsd", r"freebsd license"],
    "bsd-3-clause": [r"bsd 3 clause", r"3 clause bsd", r"modified bsd", r"new bsd"],
    "bsd-4-clause": [r"bsd 4 clause", r"original bsd"],
    "bsd": [r"bsd license"],
    "gpl-1.0": [r"gnu general public license(?: gpl)?(?: version)? v?1(?: 0)?", r"gpl ?v?1(?: 0)?"],
    "gpl-2.0": [r"gnu general public license(?: gpl)?(?: version)? v?2(?: 0)?", r"gpl(?: version)? ?v?2(?: 0)?"],
    "gpl-3.0": [r"gnu general public license(?: gpl)?(?: version)? v?3(?: 0)?", r"gpl(?: version)? ?v?3(?: 0)?"],
    "lgpl-2.1": [r"gnu lesser general public license(?: version)? v?2 1", r"lgpl(?: version)? ?v?2 1"],
    "lgpl-3.0": [r"gnu lesser general public license(?: version)? v?3(?: 0)?", r"lgpl(?: version)? ?v?3(?: 0)?"],
    "lgpl": [r"gnu (?:lesser|library) general public license", r"lgpl"],
    "agpl-3.0": [r"gnu affero general public license(?: version)?(?: v?3(?: 0)?)?", r"agpl(?: version)? ?v?3(?: 0)?"],
    "gfdl": [r"gnu free documentation license(?: version)?(?: 1 [123])?", r"gfdl"],
    "mpl-1.1": [r"mozilla public license(?: version)? 1 1", r"mpl 1 1"],
    "mpl-2.0": [r"mozilla public license(?: version)?(?: 2(?: 0)?)?", r"mpl 2 0"],
    "epl-1.0": [r"eclipse public license(?: version)? 1 0", r"epl 1 0"],
    "epl-2.0": [r"eclipse public license(?: version)?(?: 2 0)?", r"epl 2 0"],
    "cddl-1.0": [r"common development and distribution license(?: version)?(?: 1 0)?", r"cddl(?: 1 0)?"],
    "cpl-1.0": [r"common public license(?: version)?(?: 1 0)?"],
    "eupl": [r"european union public licence(?: version)?(?: 1 [12])?", r"eupl(?: 1 [12])?"],
    "artistic-2.0": [r"artistic license(?: version)? 2 0"],
    "artistic-1.0": [r"artistic license(?: version)?(?: 1 0)?"],
    "isc": [r"isc license", r"internet systems consortium license"],
    "zlib": [r"zlib(?: libpng)? license"],
    "boost": [r"boost software license(?: version)?(?: 1 0)?"],
    "unlicense": [r"the unlicense", r"unlicense"],
    "wtfpl": [r"do what the fuck you want to public license", r"wtfpl"],
    "cc0": [r"creative commons zero(?: 1 0)?(?: universal)?", r"cc0(?: 1 0)?(?: universal)?", r"cc zero"],
    "cc-by": [r"creative commons attribution(?: [1234] [05])?(?: international| unported)?", r"cc by(?: [1234] [05])?"],
    "cc-by-sa": [r"creative commons attribution share ?alike(?: [1234] [05])?", r"cc by sa(?: [1234] [05])?"],
    "cc-by-nc": [r"creative commons attribution non ?commercial(?: [1234] [05])?", r"cc by nc(?: [1234] [05])?"],
    "cc-by-nd": [r"creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?", r"cc by nd(?: [1234] [05])?"],
    "cc-by-nc-sa": [r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?", r"cc by nc sa(?: [1234] [05])?"],
    "cc-by-nc-nd": [r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?", r"cc by nc nd(?: [1234] [05])?"],
    "odbl": [r"open database license(?: 1 0)?", r"odbl"],
    "odc-by": [r"open data commons attribution license(?: 1 0)?", r"odc by(?: 1 0)?"],
    "pddl": [r"public domain dedication and license", r"pddl"],
    "ofl": [r"sil open font license(?: version)?(?: 1 1)?"],
    "ogl": [r"open government licence(?: v?[123](?: 0)?)?"],
    "psf": [r"python software foundation license(?: version)?(?: 2)?"],
    "php": [r"php license(?: version)?(?: 3 0[01]?)?"],
    "ruby": [r"ruby license"],
    "w3c": [r"w3c (?:software|document) license"],
    "ms-pl": [r"microsoft public license", r"ms pl"],
    "ms-rl": [r"microsoft reciprocal license", r"ms rl"],
    "upl": [r"universal permissive license(?: version)?(?: 1 0)?"],
    "osl": [r"open software license(?: version)?(?: 3 0)?"],
    "afl": [r"academic free license(?: version)?(?: 3 0)?"],
    "ncsa": [r"university of illinois (?:ncsa )?open source license"],
    "vim": [r"vim license"],
    "postgresql": [r"postgresql license"],
    "openssl": [r"openssl license"],
    "bsl": [r"business source license(?: 1 1)?"],
    "sspl": [r"server side public license(?: version)?(?: 1)?", r"sspl"],
    "elastic": [r"elastic license(?: 2 0)?"],
    "openrail": [r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?"],
    "llama": [r"llama [23](?: [12])? community license"],
}
#: Sentences around a name; {} is its place.
SENTENCES = [
    r"spdx license identifier {}",
    r"(?:this|the) (?:work|file|program|software|code|document|project|text) is (?:licensed|released|distributed|made available|available|provided|covered) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}",
    r"licensed under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}",
    r"(?:released|distributed|published|made available|available|provided|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}",
    r"(?:subject to|governed by|covered by|according to|in accordance with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}",
    r"(?:license|licence|lizenz|licencia) {}",
    r"{}",
]
#: Priorities: a licence's own sentence; a name by its sentence, from the first to the last; a notice.
OWN, NAMED, NOTICE = 100, (98, 90, 80, 70, 60, 50, 40), 35
_WORDS = "(?:[^ ]+ ){0,7}[^ ]+"


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    #: A word, or part of one, that every match holds; and the same with the blanks that must surround it.
    keyword: str
    gate: str
    priority: int


def keyword(pattern: str) -> str:
    """The longest word that every match of ``pattern`` holds: groups, options and sets are left out."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", " ", pattern)
    plain = re.sub(r"\[[^\]]*\]\??|\\d|.\?|\*", " ", plain)
    words = re.findall(r"[^\W_]+", plain)
    return max(words, key=lambda w: (len(w), -words.index(w)))


def gate(pattern: str, word: str) -> str:
    """``word`` with a blank in front or behind where ``pattern`` shows that a word starts or ends
    there (blanks surround the joined words)."""
    front, _, rest = pattern.partition(word)
    starts = front == "" or front[-1] == " "
    ends = rest == "" or re.fullmatch(r"(?:\(\?: [^|()]*\)\?)*(?: [^?].*)?", rest)
    return (" " if starts else "") + word + (" " if ends else "")


@functools.cache
def rules() -> list[Rule]:
    """All rules by descending priority."""
    out = []

    def add(label: str, pattern: str, part: str, priority: int) -> None:
        word = keyword(part)
        out.append(Rule(label, re.compile(rf"(?<![^ ]){pattern}(?![^ ])"), word, gate(part, word), priority))

    for table, priority in ((SIGNATURES, OWN), (NOTICES, NOTICE)):
        for label, sentences in table.items():
            for sentence in sentences:
                add(label, sentence.replace("*", _WORDS), sentence, priority)
    for sentence, priority in zip(SENTENCES, NAMED, strict=True):
        for label, own in NAMES.items():
            for name in own:
                add(label, sentence.format(f"(?:{name})"), name, priority)
    return sorted(out, key=lambda r: -r.priority)
