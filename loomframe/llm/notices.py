"""Wordings of licence notices, written by hand: headers, short forms, conditions, disclaimers,
exceptions, dual licences, file names, waivers and closed terms.

A pattern is met by words in lower case between single spaces. Level 1 wins over 2 and so on:
2 is the notice of a licence, 3 a sentence that belongs to few licences, 4 a plain statement,
5 a sentence that many licences share, 6 a reference.
"""

from __future__ import annotations

import re

#: label, level, score, pattern. Wordings as the licences and their guides give them.
WORDINGS = (
    # Apache
    ("apache-2.0", 2, 0.95, "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", 2, 0.95, "http www apache org licenses license 2 0(?: (?:txt|html))?"),
    ("apache-2.0", 3, 0.9, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 3, 0.9, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 3, 0.85, "apache license version 2 0 january 2004"),
    ("apache-2.0", 3, 0.85, "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive"),
    ("apache", 3, 0.8, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 2, 0.9, "this product includes software developed by the apache software foundation"),
    ("apache-1.1", 3, 0.85, "products derived from this software may not be called apache nor may apache appear in their name"),
    ("llvm-exception", 2, 0.9, "apache license v2 0 with llvm exceptions"),
    # MIT and its kin
    ("mit", 3, 0.9, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", 3, 0.85, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 3, 0.85, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 2, 0.95, "use of this source code is governed by an mit style license that can be found in the license file"),
    ("mit", 4, 0.8, "mit style licen[cs]e"),
    ("mit-0", 2, 0.95, "mit no attribution"),
    ("x11", 2, 0.9, "except as contained in this notice the name(?: [^ ]+){1,8} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("hpnd", 2, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd", 3, 0.8, "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("ntp", 2, 0.85, "makes no representations about the suitability this software for any purpose"),
    ("mit-cmu", 3, 0.8, "this permission notice appear in supporting documentation"),
    ("isc", 3, 0.85, "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 3, 0.85, "the author disclaims all warranties with regard to this software"),
    ("0bsd", 2, 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("mit-modern", 3, 0.8, "permission is hereby granted without written agreement and without license or royalty fees"),
    ("curl", 2, 0.95, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    # BSD
    ("bsd", 3, 0.85, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, 0.85, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", 3, 0.85, "this software is provided by(?: [^ ]+){1,8} as is and any express or implied warranties including but not limited to"),
    ("bsd-3-clause", 3, 0.9, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 2, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 2, 0.9, "use of this source code is governed by a bsd style licen[cs]e that can be found in the licen[cs]e file"),
    ("bsd", 4, 0.8, "bsd style licen[cs]e"),
    ("bsd-3-clause-clear", 2, 0.9, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-views", 2, 0.9, "the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-patent", 2, 0.9, "bsd plus patents? licen[cs]e"),
    ("beerware", 2, 0.95, "the beer ware licen[cs]e"),
    ("beerware", 3, 0.9, "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    # GNU
    ("gpl", 2, 0.9, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", 1, 0.95, "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 1, 0.95, "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", 2, 0.9, "gnu general public license version 2 only as published by the free software foundation"),
    ("gpl-2.0", 3, 0.85, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", 3, 0.85, "gnu general public license version 3 29 june 2007"),
    ("gpl", 5, 0.6, "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", 5, 0.6, "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library)"),
    ("agpl", 5, 0.6, "you should have received a copy of the gnu affero general public license along with this program"),
    ("lgpl", 2, 0.9, "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1-or-later", 1, 0.95, "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", 1, 0.95, "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", 1, 0.95, "gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3.0-or-later", 1, 0.95, "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", 3, 0.85, "gnu affero general public license version 3 19 november 2007"),
    ("gfdl", 2, 0.9, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 3, 0.8, "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl", 4, 0.8, "this (?:program|script|module|plugin|package|software) is (?:free software )?(?:licensed )?under the gpl"),
    ("gpl", 4, 0.8, "gnu gpl v?[123]"),
    ("gpl", 4, 0.8, "gplv2"),
    ("gpl", 4, 0.8, "gplv3"),
    ("lgpl", 4, 0.8, "lgplv2"),
    ("lgpl", 4, 0.8, "lgplv3"),
    ("agpl", 4, 0.8, "agplv3"),
    ("lgpl", 4, 0.8, "gnu lgpl"),
    ("copyleft", 5, 0.5, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("fsf-all-permissive", 2, 0.9, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsf-unlimited", 2, 0.9, "the free software foundation gives unlimited permission to copy and or distribute it with or without modifications"),
    # Exceptions
    ("classpath-exception", 1, 0.95, "gpl(?: v?2)? with (?:the )?classpath exception"),
    ("classpath-exception", 2, 0.9, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("classpath-exception", 3, 0.85, "gives you permission to link this library with independent modules to produce an executable"),
    ("gcc-exception", 2, 0.9, "gcc runtime library exception"),
    ("autoconf-exception", 2, 0.9, "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("bison-exception", 2, 0.9, "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("linux-syscall-note", 1, 0.95, "gpl 2 0(?: only| or later)? with linux syscall note"),
    ("openssl-exception", 2, 0.9, "permission to link the code of portions of this program with the openssl library"),
    ("font-exception", 2, 0.9, "if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("licence-exception", 6, 0.4, "as a special exception the (?:copyright holders?|authors?|free software foundation)"),
    # Mozilla, Eclipse, Sun, IBM, European
    ("mpl-2.0", 2, 0.95, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 3, 0.9, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", 3, 0.9, "incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", 2, 0.95, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", 3, 0.85, "you may not use this file except in compliance with the license you may obtain a copy of the license at http www mozilla org mpl"),
    ("mpl-tri-license", 1, 0.95, "mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("epl-1.0", 2, 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 2, 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl", 3, 0.85, "(?:http|https) www eclipse org legal epl v[12]0"),
    ("edl-1.0", 2, 0.9, "eclipse distribution license v ?1 0"),
    ("cddl", 2, 0.95, "the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("cddl", 3, 0.85, "when distributing (?:covered code|the software) include this (?:cddl header|license header) (?:notice )?in each file"),
    ("ipl-1.0", 2, 0.9, "the accompanying program is provided under the terms of this ibm public license"),
    ("cpl-1.0", 2, 0.9, "the accompanying program is provided under the terms of this common public license"),
    ("eupl", 2, 0.95, "licensed under the eupl version 1 [012]"),
    ("cecill", 2, 0.9, "this software is governed by the cecill(?: [bc])? license under french law"),
    ("osl-3.0", 2, 0.95, "licensed under the open software license version 3 0"),
    ("afl-3.0", 2, 0.95, "licensed under the academic free license version 3 0"),
    ("artistic", 2, 0.9, "this (?:library|module|program) is free software you can redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("artistic", 3, 0.8, "the intent of this document is to state the conditions under which a package may be copied"),
    ("qpl-1.0", 2, 0.9, "this file is part of(?: [^ ]+){1,6} and may be distributed under the terms of the q public license"),
    # Small permissive licences
    ("zlib", 3, 0.9, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 3, 0.85, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 3, 0.85, "this notice may not be removed or altered from any source distribution"),
    ("boost-1.0", 2, 0.95, "distributed under the boost software license version 1 0"),
    ("boost-1.0", 3, 0.9, "boost org license 1 0 txt"),
    ("boost-1.0", 3, 0.85, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("wtfpl", 2, 0.95, "you just do what the fuck you want to"),
    ("unlicense", 3, 0.9, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 3, 0.9, "(?:http|https) unlicense org"),
    ("ms-pl", 2, 0.9, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("python", 2, 0.9, "licensed to psf under a contributor agreement"),
    ("python", 3, 0.85, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", 2, 0.95, "this source file is subject to version 3 01? of the php license"),
    ("php", 3, 0.85, "this product includes php software freely available from"),
    ("openssl", 2, 0.9, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 2, 0.9, "this product includes cryptographic software written by eric young"),
    ("postgresql", 2, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ncsa", 3, 0.85, "to deal with the software without restriction including without limitation"),
    ("json", 2, 0.95, "the software shall be used for good not evil"),
    ("w3c", 2, 0.9, "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with"),
    ("vim", 2, 0.9, "vim is charityware"),
    ("ijg", 2, 0.9, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 2, 0.9, "portions of this software are copyright(?: [^ ]+){1,4} the freetype project"),
    ("unicode", 2, 0.9, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", 3, 0.8, "icu license icu 1 8 1 and later"),
    ("libtiff", 2, 0.85, "the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("bzip2", 2, 0.85, "bzip2 and libbzip2"),
    ("blessing", 2, 0.95, "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("mulan-psl", 2, 0.95, "licensed under mulan psl v[12]"),
    ("upl-1.0", 2, 0.95, "universal permissive license v? ?1 0"),
    ("artistic", 4, 0.8, "same terms as perl(?: itself)?"),
    ("ruby", 4, 0.8, "(?:same|under the) terms as ruby(?: itself)?"),
    # Creative Commons, documents, data, fonts
    ("cc-by-4.0", 2, 0.95, "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", 2, 0.95, "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", 2, 0.95, "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa-4.0", 2, 0.95, "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-4.0", 2, 0.95, "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-sa-3.0", 2, 0.95, "creativecommons org licenses by sa 3 0"),
    ("cc-by-3.0", 2, 0.95, "creativecommons org licenses by 3 0"),
    ("cc-by-nc", 2, 0.9, "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", 2, 0.9, "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 2, 0.9, "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nd", 2, 0.9, "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-sa", 3, 0.8, "text is available under the creative commons attribution share ?alike license"),
    ("cc0-1.0", 3, 0.9, "to the extent possible under law(?: [^ ]+){1,8} waived all copyright and related or neighboring rights"),
    ("cc-pdm", 3, 0.85, "creativecommons org publicdomain mark 1 0"),
    ("creative-commons", 5, 0.6, "some rights reserved"),
    ("ogl", 2, 0.9, "contains public sector information licensed under the open government licen[cs]e"),
    ("odbl", 2, 0.9, "this database is made available under the open database license"),
    ("odbl", 3, 0.8, "openstreetmap contributors"),
    ("ofl-1.1", 2, 0.95, "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 3, 0.85, "scripts sil org ofl"),
    ("gutenberg", 2, 0.9, "you may copy it give it away or re use it under the terms of the project gutenberg license"),
    ("etalab", 2, 0.85, "licence ouverte(?: open licence)?"),
    # Public domain and waivers
    ("public-domain", 3, 0.85, "this (?:file|code|software|work|program|document) is (?:hereby )?(?:in|released into|placed in|dedicated to) the public domain"),
    ("public-domain", 3, 0.85, "i the copyright holder of this work hereby release it into the public domain"),
    ("us-government-work", 2, 0.85, "pursuant to title 17 section 105 of the united states code"),
    ("us-government-work", 2, 0.85, "(?:is a )?work of the (?:united states|u s) government"),
    ("no-known-copyright", 4, 0.6, "no known copyright restrictions"),
    ("copyfree", 4, 0.6, "no rights reserved"),
    # Choice between licences
    ("dual-licence", 4, 0.7, "dual licensed(?: under)?"),
    ("dual-licence", 4, 0.7, "dually licensed(?: under)?"),
    ("dual-licence", 4, 0.7, "available under (?:two|either of two|multiple) licen[cs]es"),
    ("apache-2.0-or-mit", 1, 0.95, "licensed under either of apache license version 2 0(?: [^ ]+){0,12} or mit license"),
    ("apache-2.0-or-mit", 1, 0.95, "mit or apache 2 0"),
    ("apache-2.0-or-mit", 1, 0.95, "apache 2 0 or mit"),
    ("mit-or-gpl", 1, 0.95, "dual licensed under the mit (?:and|or) gpl(?: version [23])?(?: licenses)?"),
    ("licence-choice", 5, 0.5, "at your option(?: under)? either of the following licenses"),
    ("licence-choice", 5, 0.5, "alternatively this software may be distributed under the terms of"),
    # Source-available and closed terms
    ("sspl-1.0", 2, 0.95, "server side public license version 1 as published by mongodb"),
    ("busl-1.1", 2, 0.95, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", 2, 0.95, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 2, 0.95, "commons clause license condition"),
    ("polyform", 2, 0.95, "polyform (?:noncommercial|strict|shield|perimeter|small business) license"),
    ("non-commercial", 4, 0.7, "for (?:personal|private|academic|research|educational)(?: and| or)?(?: personal| private| academic| research| educational)? use only"),
    ("non-commercial", 4, 0.7, "(?:for )?non commercial (?:use|purposes) only"),
    ("proprietary", 3, 0.8, "this software is the confidential and proprietary information of"),
    ("proprietary", 3, 0.8, "contains trade secrets and (?:confidential|proprietary) information"),
    ("proprietary", 4, 0.7, "no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", 4, 0.7, "end user licen[cs]e agreement"),
    ("proprietary", 4, 0.7, "you may not reverse engineer decompile or disassemble"),
    ("proprietary", 5, 0.5, "reproduced with permission"),
    # Disclaimers and references that many licences share
    ("warranty-disclaimer", 5, 0.4, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", 5, 0.4, "in the hope that it will be useful but without any warranty"),
    ("warranty-disclaimer", 5, 0.4, "in no event shall(?: [^ ]+){1,10} be liable for any"),
    ("warranty-disclaimer", 5, 0.4, "merchantability and fitness for a particular purpose are disclaimed"),
    ("copyright-notice", 6, 0.4, "all copyrights are (?:the property of|owned by) their respective (?:owners|holders)"),
    ("copyright-notice", 6, 0.3, "all trademarks are the property of their respective owners"),
    ("licence-reference", 6, 0.3, "for (?:the )?full (?:copyright and )?licen[cs]e (?:information|text) (?:please )?(?:view|see) the licen[cs]e file"),
    ("licence-reference", 6, 0.3, "licen[cs]e that can be found in the (?:licen[cs]e|copying) file"),
    ("licence-reference", 6, 0.3, "refer to the licen[cs]e file(?: for details)?"),
    ("licence-reference", 6, 0.3, "usage of the works is permitted provided that this instrument is retained"),
)


def sure_words(pattern: str) -> tuple[str, ...]:
    """The longest run of whole words that every match holds, from outside groups and options;
    none if there is no such word."""
    flat = pattern
    while (less := re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", "\0", flat)) != flat:
        flat = less
    flat = re.sub(r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?|.[?*+]|.\{[^}]*\}", "\0", flat)
    # A word that touches something open is not known in whole.
    runs = [re.sub(r"^[^ ]*\0[^ ]*|\0", "\0", run) for run in re.split(r"(?<=\0)", flat)]
    whole = [w if "\0" not in w else "\0" for w in "".join(runs).split(" ")]
    best = max((run.strip() for run in " ".join(whole).split("\0")), key=len)
    return (best,) if best else ()
