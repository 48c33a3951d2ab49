"""Hand-written signatures of license texts, notices, addresses and identifiers, over lower-case words.

A row: label, priority, weight, keyword, pattern. The keyword stands in every text that the pattern matches. A word
is letters and digits; signs between words are single spaces, so v2.0 reads v2 0 and an address reads as words.
"""

from __future__ import annotations

#: Priorities: an identifier says most, then a body's own words, addresses, notices, and general words least.
IDENTIFIER, BODY, ADDRESS, NOTICE, GENERAL = 9, 8, 7, 6, 1

SIGNATURES = (
    # bodies of permissive licenses
    ("mit", BODY, 1.0, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", BODY, 0.9, "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit", BODY, 0.9, "substantial portions", "(?:the above|this) copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", BODY, 1.0, "sublicense and or sell", "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", BODY, 0.9, "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-cmu", BODY, 0.9, "supporting documentation", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("isc", BODY, 1.0, "with or without fee is hereby granted", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", BODY, 0.8, "and the author disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", BODY, 0.9, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", BODY, 0.8, "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", BODY, 0.8, "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", BODY, 0.9, "endorse or promote products", "neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", BODY, 1.0, "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("0bsd", BODY, 0.9, "bsd zero clause", "bsd zero clause license"),
    ("apache-1.1", BODY, 0.9, "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", BODY, 0.9, "publicly perform sublicense and distribute", "prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works"),
    ("apache-2.0", BODY, 0.9, "patent litigation", "if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit"),
    ("apache-2.0", BODY, 0.8, "carry prominent notices", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("zlib", BODY, 1.0, "express or implied warranty in no event will the authors", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", BODY, 0.8, "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", BODY, 0.8, "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", BODY, 1.0, "machine executable object code", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", BODY, 1.0, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", BODY, 0.8, "overt act of relinquishment", "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights"),
    ("wtfpl", BODY, 1.0, "you just do what the fuck", "you just do what the fuck you want to"),
    ("beerware", BODY, 1.0, "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("ncsa", BODY, 0.9, "deal with the software", "to deal with the software without restriction including without limitation the rights to use"),
    ("openssl", BODY, 0.9, "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", BODY, 0.9, "eric young", "this product includes cryptographic software written by eric young"),
    ("libpng", BODY, 0.9, "png reference library", "the png reference library is supplied as is"),
    ("curl", BODY, 0.8, "copyright holder shall not be used", "except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote"),
    ("postgresql", BODY, 0.9, "university of california be liable", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("python", BODY, 0.9, "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform"),
    ("cnri-python", BODY, 0.9, "cnri hereby grants", "cnri hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("ruby", BODY, 0.9, "verbatim copies of the source form", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("php", BODY, 0.9, "php software freely available", "this product includes php software freely available from"),
    ("ofl", BODY, 1.0, "reserved font name", "no modified version of the font software may use the reserved font name"),
    ("ofl", BODY, 0.8, "font software", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself|neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("vim", BODY, 0.9, "distributing unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("json", BODY, 1.0, "shall be used for good", "the software shall be used for good not evil"),
    ("artistic", BODY, 0.9, "standard version", "you may distribute verbatim copies of the source form of the standard version of this package"),
    ("hpnd", BODY, 0.8, "no representations about the suitability", "makes no representations about the suitability of this software for any purpose"),
    ("ijg", BODY, 0.9, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("unicode", BODY, 0.9, "unicode data files", "any person obtaining a copy of the unicode data files and any associated documentation"),
    ("w3c", BODY, 0.9, "w3c", "w3c software (?:notice and license|and document license|and document notice and license)"),
    ("ntp", BODY, 0.8, "it is provided as is", "it is provided as is without express or implied warranty"),
    ("mulan", BODY, 0.9, "mulan", "mulan psl v[0-9]"),
    ("blueoak", BODY, 0.9, "blue oak", "blue oak model license"),
    ("afl", BODY, 0.9, "academic free license", "licensed under the academic free license version [0-9](?: [0-9])?"),
    ("fair", BODY, 0.9, "usage of the works is permitted", "usage of the works is permitted provided that this instrument is retained"),
    # bodies of copyleft licenses
    ("gpl", BODY, 1.0, "free software you can redistribute it", "(?:this program|it|this file) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", BODY, 0.8, "guarantee your freedom", "the gnu general public license is intended to guarantee your freedom to share and change"),
    ("gpl", BODY, 0.8, "you should have received a copy", "you should have received a copy of the gnu general public license along with"),
    ("gpl", BODY, 0.7, "without even the implied warranty", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl-2.0", BODY, 1.0, "version 2", "gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: of the license)?(?: only| or at your option any later version| june 1991)?"),
    ("gpl-3.0", BODY, 1.0, "version 3", "gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?(?: only| or at your option any later version| 29 june 2007)?"),
    ("gpl-1.0", BODY, 0.9, "version 1", "gnu general public license (?:as published by the free software foundation )?(?:either )?version 1(?: february 1989)?"),
    ("lgpl", BODY, 1.0, "lesser general public license", "under the terms of the gnu lesser general public license"),
    ("lgpl-2.1", BODY, 1.0, "version 2 1", "gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1"),
    ("lgpl-3.0", BODY, 1.0, "lesser general public license", "gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3"),
    ("lgpl-2.0", BODY, 1.0, "library general public license", "gnu library general public license (?:as published by the free software foundation )?(?:either )?version 2"),
    ("lgpl", BODY, 0.8, "work that uses the library", "a work that uses the library in isolation is not a derivative work of the library"),
    ("agpl-3.0", BODY, 1.0, "affero general public license", "gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3"),
    ("agpl", BODY, 0.9, "remotely through a computer network", "all users interacting with it remotely through a computer network"),
    ("gfdl", BODY, 0.9, "invariant sections", "with (?:no|the) invariant sections"),
    ("gpl-classpath", BODY, 1.0, "independent modules", "permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules"),
    ("gpl-gcc-exception", BODY, 1.0, "gcc runtime library exception", "gcc runtime library exception"),
    ("gpl-autoconf", BODY, 0.9, "configuration script generated by autoconf", "if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-bison", BODY, 0.9, "bison parser skeleton", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font", BODY, 0.9, "embeds this font", "if you create a document which uses this font and embeds this font or unaltered portions of this font"),
    ("linux-syscall", BODY, 1.0, "user programs that use kernel services", "user programs that use kernel services by normal system calls"),
    ("llvm-exception", IDENTIFIER, 1.0, "llvm", "(?:with )?llvm exceptions?"),
    ("mpl-2.0", BODY, 1.0, "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", BODY, 1.0, "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-2.0", BODY, 0.8, "covered software", "distribution of covered software in source code form"),
    ("epl-1.0", BODY, 1.0, "eclipse public license", "(?:terms of the )?eclipse public license v(?:ersion )?1 0"),
    ("epl-2.0", BODY, 1.0, "eclipse public license", "(?:terms of the )?eclipse public license v(?:ersion )?2 0"),
    ("epl", BODY, 0.8, "recipient s acceptance of the agreement", "any use reproduction or distribution of the program constitutes recipient s acceptance of the agreement"),
    ("cddl", BODY, 1.0, "common development and distribution license", "terms of the common development and distribution license"),
    ("cpl", BODY, 1.0, "common public license", "common public license (?:agreement|v(?:ersion )?1 0)"),
    ("osl", BODY, 1.0, "open software license", "licensed under the open software license version [0-9](?: [0-9])?"),
    ("eupl", BODY, 1.0, "eupl", "licensed under the eupl(?: version| v)? 1 [012]"),
    ("cecill", BODY, 0.9, "cecill", "governed by the cecill(?: [abc])? license under french law"),
    ("sleepycat", BODY, 1.0, "complete source code for the db software", "information on how to obtain complete source code for the db software"),
    ("qpl", BODY, 1.0, "q public license", "the q public license version 1 0"),
    ("apsl", BODY, 1.0, "apple public source license", "apple public source license version [12] [0-9]"),
    ("ms-pl", BODY, 1.0, "microsoft public license", "microsoft public license ms pl"),
    ("ms-pl", BODY, 0.8, "accompanying software", "this license governs use of the accompanying software"),
    ("sspl", BODY, 1.0, "third parties as a service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", BODY, 1.0, "change date", "business source license [^ ]+(?: [^ ]+){0,30} change date|change date [0-9]+(?: [0-9]+)*(?: [^ ]+){0,12} change license"),
    ("elastic", BODY, 0.9, "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", BODY, 1.0, "commons clause", "commons clause license condition"),
    ("polyform", BODY, 1.0, "polyform", "polyform (?:noncommercial|shield|small business|strict|perimeter|free trial|internal use) license"),
    # creative commons, data, public domain
    ("cc-by", BODY, 1.0, "creative commons attribution", "creative commons attribution (?:[0-9] [0-9] )?(?:international |generic |unported )?license"),
    ("cc-by-sa", BODY, 1.0, "share", "creative commons attribution share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc", BODY, 1.0, "commercial", "creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc-sa", BODY, 1.0, "commercial share", "creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: international| unported)?(?: license)?"),
    ("cc-by-nd", BODY, 1.0, "deriv", "creative commons attribution no ?deriv(?:ative)?s(?: [0-9] [0-9])?(?: license)?"),
    ("cc-by-nc-nd", BODY, 1.0, "deriv", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [0-9] [0-9])?(?: license)?"),
    ("cc0", BODY, 1.0, "cc0", "cc0 1 0 universal(?: public domain dedication)?"),
    ("cc0", BODY, 0.9, "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("public-domain", NOTICE, 0.8, "public domain", "(?:released|placed|dedicated|put)(?: in)?(?: to|into)? the public domain"),
    ("public-domain", GENERAL, 0.5, "public domain", "is (?:in|hereby in) the public domain"),
    ("odbl", BODY, 1.0, "open database license", "made available under the open database license"),
    ("odc-by", BODY, 1.0, "open data commons attribution", "open data commons attribution license"),
    ("pddl", BODY, 1.0, "public domain dedication and license", "public domain dedication and license"),
    ("ogl-uk", BODY, 1.0, "open government licen", "open government licen[cs]e(?: v[0-9](?: [0-9])?)?"),
    # addresses
    ("apache-2.0", ADDRESS, 1.0, "apache org licenses", "(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("mit", ADDRESS, 1.0, "opensource org licenses mit", "opensource org licenses mit(?: license)?(?: php)?"),
    ("bsd", ADDRESS, 1.0, "opensource org licenses bsd", "opensource org licenses bsd(?: [23] clause| license)?(?: php)?"),
    ("isc", ADDRESS, 1.0, "opensource org licenses isc", "opensource org licenses isc(?: license)?"),
    ("gpl", ADDRESS, 1.0, "gnu org licenses gpl", "gnu org licenses gpl(?: [23] 0)?(?: html| txt)?"),
    ("gpl", ADDRESS, 0.9, "gnu org copyleft gpl", "gnu org copyleft gpl(?: html)?"),
    ("lgpl", ADDRESS, 1.0, "gnu org licenses lgpl", "gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("agpl", ADDRESS, 1.0, "gnu org licenses agpl", "gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", ADDRESS, 1.0, "gnu org licenses fdl", "gnu org licenses fdl(?: 1 [0-9])?(?: html| txt)?"),
    ("gpl", ADDRESS, 0.8, "gnu org licenses", "see (?:https? )?(?:www )?gnu org licenses"),
    ("mpl", ADDRESS, 1.0, "mozilla org mpl", "mozilla org mpl(?: [12] [01])?"),
    ("mpl", ADDRESS, 1.0, "mozilla org en us mpl", "mozilla org en us mpl(?: 2 0)?"),
    ("epl", ADDRESS, 1.0, "eclipse org legal epl", "eclipse org legal epl(?: v10| 2 0| v20)?(?: html)?"),
    ("edl", ADDRESS, 1.0, "eclipse org org documents edl", "eclipse org org documents edl v10(?: php| html)?"),
    ("boost", ADDRESS, 1.0, "boost org license", "boost org license 1 0(?: txt)?"),
    ("unlicense", ADDRESS, 1.0, "unlicense org", "unlicense org"),
    ("wtfpl", ADDRESS, 1.0, "wtfpl net", "wtfpl net"),
    ("cc-by", ADDRESS, 1.0, "creativecommons org licenses by", "creativecommons org licenses by [0-9] [0-9]"),
    ("cc-by-sa", ADDRESS, 1.0, "creativecommons org licenses by sa", "creativecommons org licenses by sa [0-9] [0-9]"),
    ("cc-by-nc", ADDRESS, 1.0, "creativecommons org licenses by nc", "creativecommons org licenses by nc [0-9] [0-9]"),
    ("cc-by-nc-sa", ADDRESS, 1.0, "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [0-9] [0-9]"),
    ("cc-by-nd", ADDRESS, 1.0, "creativecommons org licenses by nd", "creativecommons org licenses by nd [0-9] [0-9]"),
    ("cc-by-nc-nd", ADDRESS, 1.0, "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [0-9] [0-9]"),
    ("cc0", ADDRESS, 1.0, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", ADDRESS, 0.9, "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("zlib", ADDRESS, 1.0, "zlib net zlib license", "zlib net zlib license(?: html)?"),
    ("openssl", ADDRESS, 1.0, "openssl org source license", "openssl org source license(?: html)?"),
    ("python", ADDRESS, 1.0, "python org psf license", "python org psf license"),
    ("php", ADDRESS, 1.0, "php net license", "php net license(?: 3 0[01]?(?: txt)?)?"),
    ("ofl", ADDRESS, 1.0, "scripts sil org ofl", "scripts sil org ofl"),
    ("eupl", ADDRESS, 1.0, "ec europa eu", "joinup ec europa eu(?: [^ ]+){0,4} eupl"),
    ("cddl", ADDRESS, 1.0, "opensource org licenses cddl", "opensource org licenses cddl ?1(?: php| 0)?"),
    ("afl", ADDRESS, 1.0, "opensource org licenses afl", "opensource org licenses afl 3 0(?: php)?"),
    ("osl", ADDRESS, 1.0, "opensource org licenses osl", "opensource org licenses osl 3 0(?: php)?"),
    ("artistic", ADDRESS, 1.0, "opensource org licenses artistic", "opensource org licenses artistic license(?: 2 0)?(?: php)?"),
    ("artistic", ADDRESS, 1.0, "perlfoundation org artistic", "perlfoundation org artistic license 2 0"),
    ("cecill", ADDRESS, 1.0, "cecill info", "cecill info(?: licences(?: [^ ]+){0,3})?"),
    ("mulan", ADDRESS, 1.0, "license coscl org cn", "license coscl org cn mulanpsl2?"),
    ("odbl", ADDRESS, 1.0, "opendatacommons org licenses odbl", "opendatacommons org licenses odbl"),
    ("pddl", ADDRESS, 1.0, "opendatacommons org licenses pddl", "opendatacommons org licenses pddl"),
    ("unicode", ADDRESS, 1.0, "unicode org copyright", "unicode org copyright html"),
    ("spdx", ADDRESS, 0.6, "spdx org licenses", "spdx org licenses [^ ]+"),
    # identifiers and expressions
    ("mit", IDENTIFIER, 1.0, "spdx", "spdx license identifier mit(?: 0)?"),
    ("apache-2.0", IDENTIFIER, 1.0, "spdx", "spdx license identifier apache 2 0"),
    ("gpl-2.0", IDENTIFIER, 1.0, "spdx", "spdx license identifier gpl 2 0(?: only| or later)?(?: with [^ ]+(?: [^ ]+){0,3} exception(?: [0-9] [0-9])?| with linux syscall note)?"),
    ("gpl-3.0", IDENTIFIER, 1.0, "spdx", "spdx license identifier gpl 3 0(?: only| or later)?(?: with [^ ]+(?: [^ ]+){0,3} exception(?: [0-9] [0-9])?)?"),
    ("lgpl-2.1", IDENTIFIER, 1.0, "spdx", "spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", IDENTIFIER, 1.0, "spdx", "spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", IDENTIFIER, 1.0, "spdx", "spdx license identifier agpl 3 0(?: only| or later)?"),
    ("bsd-2-clause", IDENTIFIER, 1.0, "spdx", "spdx license identifier bsd 2 clause(?: patent)?"),
    ("bsd-3-clause", IDENTIFIER, 1.0, "spdx", "spdx license identifier bsd 3 clause(?: clear)?"),
    ("mpl-2.0", IDENTIFIER, 1.0, "spdx", "spdx license identifier mpl 2 0"),
    ("dual", IDENTIFIER, 1.0, "spdx", "spdx license identifier [^ ]+(?: [^ ]+){0,4} or (?:mit|apache 2 0|gpl [23] 0|bsd [23] clause)(?: only| or later)?"),
    ("both", IDENTIFIER, 0.9, "spdx", "spdx license identifier [^ ]+(?: [^ ]+){0,4} and (?:mit|apache 2 0|gpl [23] 0|bsd [23] clause)(?: only| or later)?"),
    ("unlicensed", IDENTIFIER, 0.8, "spdx", "spdx license identifier (?:none|noassertion|unlicensed|licenseref [^ ]+)"),
    ("mit", IDENTIFIER, 0.9, "osi approved", "license osi approved mit license"),
    ("bsd", IDENTIFIER, 0.9, "osi approved", "license osi approved bsd license"),
    ("apache", IDENTIFIER, 0.9, "osi approved", "license osi approved apache software license"),
    ("gpl", IDENTIFIER, 0.9, "osi approved", "license osi approved gnu general public license v[23](?: or later)?(?: gplv[23])?"),
    # notices
    ("dual", NOTICE, 0.9, "dual licensed", "dual licensed under(?: the)? [^ ]+(?: [^ ]+){0,4} (?:and|or) [^ ]+"),
    ("apache-2.0", NOTICE, 0.9, "apache license version 2 0", "(?:licensed )?(?:under )?(?:the )?apache license version 2 0(?: the license)?"),
    ("apache-2.0", NOTICE, 0.8, "you may not use this file except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", NOTICE, 0.7, "as is basis", "distributed (?:under the license is distributed )?on an as is basis"),
    ("bsd", NOTICE, 0.7, "bsd style", "(?:use of this source code is )?governed by a bsd style license"),
    ("bsd", NOTICE, 0.7, "berkeley", "university of california berkeley and its contributors"),
    ("mit", NOTICE, 0.7, "mit style", "governed by an mit style license"),
    ("mit", NOTICE, 0.7, "file license for terms", "released under the mit licen[cs]e see the file license for terms"),
    ("perl", NOTICE, 0.9, "same terms as perl", "under the same terms as perl(?: itself)?"),
    ("ruby", NOTICE, 0.9, "same terms as ruby", "under the same terms as ruby"),
    ("python", NOTICE, 0.9, "same terms as python", "under the same terms as python"),
    ("proprietary", NOTICE, 0.8, "confidential and proprietary", "confidential and proprietary(?: information)?"),
    ("proprietary", NOTICE, 0.8, "end user licen", "end user licen[cs]e agreement"),
    ("proprietary", NOTICE, 0.7, "without prior written permission", "may (?:not )?be (?:reproduced|copied|distributed)(?: [^ ]+){0,12} without prior written permission"),
    ("proprietary", NOTICE, 0.6, "no part of this", "no part of this (?:publication|book|document|work) may be reproduced"),
    ("non-commercial", NOTICE, 0.7, "commercial use", "for non ?commercial use only|commercial use is (?:strictly )?(?:prohibited|forbidden|not permitted)"),
    ("research-only", NOTICE, 0.7, "research purposes only", "for (?:academic |non ?commercial )?research purposes only"),
    ("all-rights-reserved", GENERAL, 0.4, "all rights reserved", "(?:copyright (?:c )?[0-9]{4}(?: [0-9]{4})?(?: by)?(?: [^ ]+){1,6} )?all rights reserved"),
    ("freeware", GENERAL, 0.4, "freeware", "(?:this (?:software|program) is )?freeware"),
    ("shareware", GENERAL, 0.4, "shareware", "(?:this (?:software|program) is )?shareware"),
    ("open-source", GENERAL, 0.3, "open source licen", "open source licen[cs]e[sd]?"),
    ("free-software", GENERAL, 0.3, "free software licen", "free software licen[cs]e"),
    ("copyleft", GENERAL, 0.3, "copyleft", "copyleft licen[cs]e"),
    ("see-license", GENERAL, 0.3, "see licen", "see licen[cs]e(?: file| txt| md)?(?: in the project root)? for (?:license information|details|terms)"),
)
