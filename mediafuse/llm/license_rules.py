"""The ordered signature rules of the licence scan, written by hand.

A rule is a label, a keyword that a text must hold for the rule to be tried, and a regular expression over
lower-case words joined by single spaces. Tables stand in order of priority, and so do the rules of each:
texts of licences, identifiers, addresses, names, notices. Fixed values throughout: the wording of public
licences and their public identifiers.
"""

from __future__ import annotations

from typing import NamedTuple

#: Sentences of licence texts.
TEXTS = [
    ("mit-0", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: [a-z]+){1,30} to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("boost-1", "free of charge", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1", "machine executable", r"machine executable object code generated by a source language processor"),
    ("ofl-1.1", "font software", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl-1.1", "font software", r"neither the font software nor any of its individual components"),
    ("unicode", "unicode data", r"obtaining a copy of the unicode data files"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("postgresql", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following"),
    ("bsd-3", "neither the name", r"neither the names? of (?:[a-z0-9]+ ){1,14}nor the names of (?:its|their|any) contributors may be used to endorse or promote"),
    ("bsd-3", "neither the name", r"neither the name of (?:[a-z0-9]+ ){1,14}may be used to endorse or promote products"),
    ("bsd-3-clear", "patent rights", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-2", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "png reference", r"the png reference library is supplied as is"),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache", r"apache license version 2 0 january 2004"),
    ("apache-2", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "except in compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("agpl-3", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3", "remotely through", r"all users interacting with it remotely through a computer network"),
    ("lgpl-2.1", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-2", "library general", r"under the terms of the gnu library general public license as published by the free software foundation"),
    ("gpl-2", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-2", "free software foundation", r"under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("gpl-3", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3", "free software foundation", r"under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation"),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", "share and change", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-classpath", "exception", r"gnu classpath exception|classpath exception to the gpl"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1"),
    ("epl-2", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2"),
    ("cpl-1", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("artistic", "intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "artistic", r"this copyright license seeks to ensure that the copyright holder maintains some artistic control"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "want to", r"you just do what the [a-z]+ you want to"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("cc0", "associated a work", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "copyright and related", r"to the extent possible under law (?:[a-z0-9]+ ){1,10}waived all copyright and related or neighboring rights"),
    ("cc-by-sa", "commons", r"this work is licensed under (?:a|the) creative commons attribution share ?alike"),
    ("cc-by", "commons", r"this work is licensed under (?:a|the) creative commons attribution(?= [0-9]| international| license| unported)"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("php-3", "php", r"this product includes php(?: software)? freely available from"),
    ("python-2", "python", r"python software foundation license version 2"),
    ("ruby", "either the terms", r"you may redistribute it and or modify it under either the terms of the (?:gpl|2 clause bsdl)"),
    ("curl", "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies except as contained in this notice"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("commons-clause", "by the licensor", r"the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("busl-1.1", "non production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic-2", "managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1", "functionality of the program", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("no-warranty", "warranty", r"without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("no-warranty", "warranty", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
]
#: What may stand before an identifier: the tag of a source file or a further part of its expression, a field of a package or a sentence.
TAG = r"(?:spdx licen[cs]e identifier |(?:or|and|with)(?<=identifier [a-z0-9 ]{1,80} (?:or|and|with)) |licen[cs]es?(?: (?:is|expression|type|name|id|identifier))? |(?:dual )?(?:licen[cs]ed|released|distributed|published|available|provided|shared) under (?:(?:the|a|an) )?(?:terms of (?:the )?)?)"
#: Identifiers as words, each behind such a tag.
IDENTIFIERS = [
    ("agpl-3", "agpl", r"agpl(?:v| v)? ?3(?: 0)?(?: only| or later)?"), ("agpl", "agpl", r"agpl"), ("agpl-1", "agpl", r"agpl 1 0"),
    ("lgpl-2.1", "lgpl", r"lgpl(?:v| v)? ?2 1(?: only| or later)?"), ("lgpl-3", "lgpl", r"lgpl(?:v| v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2", "lgpl", r"lgpl(?:v| v)? ?2(?: 0)?(?: only| or later)?"), ("lgpl", "lgpl", r"lgpl"),
    ("gpl-classpath", "classpath", r"gpl 2 0(?: only| or later)? with classpath exception 2 0"), ("gpl-2", "gpl", r"gpl(?:v| v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", r"gpl(?:v| v)? ?3(?: 0)?(?: only| or later)?"), ("gpl-1", "gpl", r"gpl(?:v| v)? ?1(?: 0)?(?: only| or later)?"), ("gpl", "gpl", r"gpl"),
    ("gfdl", "gfdl", r"gfdl(?: 1 [123])?(?: invariants| no invariants)?(?: only| or later)?"),
    ("apache-2", "apache", r"apache(?: license)?(?:v| v)? ?2(?: 0)?"), ("apache-1.1", "apache", r"apache 1 1"), ("apache-1", "apache", r"apache 1 0"),
    ("mit-0", "mit 0", r"mit 0"), ("mit-cmu", "mit cmu", r"mit cmu"), ("mit-modern", "mit modern", r"mit modern variant"), ("mit", "mit", r"mit(?! (?:der|dem|den|einer|einem|einen))"),
    ("x11", "x11", r"x11(?: distribute modifications variant)?"), ("expat", "expat", r"expat"),
    ("0bsd", "0bsd", r"0bsd"), ("bsd-1", "bsd 1", r"bsd 1 clause"), ("bsd-2", "bsd 2", r"bsd 2 clause(?: patent| views| freebsd| netbsd)?"),
    ("bsd-3-clear", "bsd 3", r"bsd 3 clause clear"), ("bsd-3", "bsd 3", r"bsd 3 clause(?: lbnl| attribution| modification)?"),
    ("bsd-4", "bsd 4", r"bsd 4 clause(?: uc| shortened)?"), ("bsd-source", "bsd source", r"bsd source code"), ("bsd", "bsd", r"bsd"),
    ("isc", "isc", r"isc"), ("mpl-1", "mpl", r"mpl 1 0"), ("mpl-1.1", "mpl", r"mpl 1 1"), ("mpl-2", "mpl", r"mpl(?: v)? ?2(?: 0)?(?: no copyleft exception)?"), ("mpl", "mpl", r"mpl"),
    ("epl-1", "epl", r"epl 1 0"), ("epl-2", "epl", r"epl(?: v)? ?2(?: 0)?"), ("edl-1", "edl", r"edl 1 0"), ("cpl-1", "cpl", r"cpl 1 0"), ("ipl-1", "ipl", r"ipl 1 0"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"), ("cecill-1", "cecill", r"cecill 1 [01]"), ("cecill-2", "cecill", r"cecill 2 [01]"), ("cecill-b", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c"), ("eupl-1.1", "eupl", r"eupl 1 1"), ("eupl-1.2", "eupl", r"eupl(?: 1 2)?"), ("artistic-1", "artistic", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2", "artistic", r"artistic 2 0"), ("boost-1", "bsl", r"bsl 1 0"), ("busl-1.1", "busl", r"busl 1 1"), ("bzip2", "bzip2", r"bzip2 1 0 [56]"),
    ("zlib", "zlib", r"zlib(?: acknowledgement)?"), ("libpng", "libpng", r"libpng(?: 2 0)?"), ("ijg", "ijg", r"ijg"), ("libtiff", "libtiff", r"libtiff"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("beerware", "beerware", r"beerware"), ("python-2", "psf", r"psf 2 0"), ("python-2", "python", r"python 2 0(?: 1)?"),
    ("php-3", "php", r"php 3 01?"), ("ruby", "ruby", r"ruby"), ("perl", "perl", r"(?:the same terms as )?perl(?: 5)?(?: itself)?"), ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 [01])?"),
    ("ncsa", "ncsa", r"ncsa"), ("ntp", "ntp", r"ntp"), ("hpnd", "hpnd", r"hpnd(?: sell variant)?"), ("postgresql", "postgresql", r"postgresql"), ("openssl", "openssl", r"openssl"),
    ("curl", "curl", r"curl"), ("afl-3", "afl", r"afl 3 0"), ("afl-2.1", "afl", r"afl 2 [01]"), ("osl-3", "osl", r"osl 3 0"), ("ecl-2", "ecl", r"ecl 2 0"), ("lppl-1.3", "lppl", r"lppl 1 3[ac]?"),
    ("ms-pl", "ms pl", r"ms pl"), ("ms-rl", "ms rl", r"ms rl"), ("rpl-1.5", "rpl", r"rpl 1 5"), ("rpsl-1", "rpsl", r"rpsl 1 0"), ("qpl-1", "qpl", r"qpl 1 0"), ("upl-1", "upl", r"upl 1 0"),
    ("vim", "vim", r"vim"), ("w3c", "w3c", r"w3c(?: 19980720| 20150513)?"), ("wxwindows", "wxwindows", r"wxwindows"), ("zpl-2.1", "zpl", r"zpl 2 [01]"), ("tcl", "tcl", r"tcl"),
    ("unicode", "unicode", r"unicode (?:3 0|dfs 2016|dfs 2015)"), ("icu", "icu", r"icu"), ("json", "json", r"json"), ("blueoak-1", "blueoak", r"blueoak 1 0 0"), ("mulan-psl-2", "mulanpsl", r"mulanpsl 2 0"),
    ("sspl-1", "sspl", r"sspl 1 0"), ("elastic-2", "elastic", r"elastic 2 0"), ("parity-7", "parity", r"parity 7 0 0"), ("polyform-nc", "polyform", r"polyform noncommercial 1 0 0"), ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("pddl-1", "pddl", r"pddl 1 0"), ("odc-by", "odc", r"odc by(?: 1 0)?"), ("cdla-permissive", "cdla", r"cdla permissive [12] 0"), ("cdla-sharing", "cdla", r"cdla sharing 1 0"), ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"), ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"), ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"), ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"), ("proprietary", "unlicensed", r"unlicensed"),
]
#: Addresses, as the words that their parts give.
ADDRESSES = [
    ("apache-2", "licenses", r"apache org licenses license 2 0"), ("apache-1.1", "licenses", r"apache org licenses license 1 1"), ("apache", "licenses", r"apache org licenses"),
    ("gpl-2", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0"), ("gpl-3", "gnu org", r"gnu org licenses gpl 3 0"), ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl"),
    ("lgpl-2.1", "gnu org", r"gnu org licenses (?:old licenses )?lgpl 2 1"), ("lgpl-3", "gnu org", r"gnu org licenses lgpl 3 0"), ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("agpl-3", "gnu org", r"gnu org licenses agpl(?: 3 0)?"), ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl"), ("gnu", "gnu org", r"gnu org licenses"),
    ("mit", "opensource org", r"opensource org licenses? mit"), ("isc", "opensource org", r"opensource org licenses? isc"), ("bsd-2", "opensource org", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3", "opensource org", r"opensource org licenses? bsd 3 clause"), ("bsd", "opensource org", r"opensource org licenses? bsd"), ("apache-2", "opensource org", r"opensource org licenses? apache 2 0"),
    ("zlib", "opensource org", r"opensource org licenses? zlib"), ("cddl", "opensource org", r"opensource org licenses? cddl"), ("epl-1", "opensource org", r"opensource org licenses? epl 1 0"),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0"), ("mpl-1.1", "mozilla org", r"mozilla org mpl (?:mpl )?1 1"), ("mpl", "mozilla org", r"mozilla org mpl"),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10"), ("epl-2", "eclipse org", r"eclipse org legal epl (?:v20|2 0)"), ("edl-1", "eclipse org", r"eclipse org (?:org )?documents edl v10"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"), ("public-domain", "creativecommons", r"creativecommons org publicdomain mark"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"), ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] [05])?"), ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] [05])?"), ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("boost-1", "boost org", r"boost org license 1 0"), ("unlicense", "unlicense org", r"unlicense org"), ("wtfpl", "wtfpl", r"(?:sam zoy org|www) wtfpl(?: net)?"), ("ofl-1.1", "scripts sil", r"scripts sil org ofl"),
    ("cecill", "cecill", r"cecill info licen[cs]es?"), ("odbl", "opendatacommons", r"opendatacommons org licenses odbl"), ("odc-by", "opendatacommons", r"opendatacommons org licenses by"),
    ("ecl-2", "opensource org", r"opensource org licenses? ecl 2 0"), ("eupl-1.2", "joinup", r"joinup ec europa eu (?:[a-z0-9]+ ){0,6}eupl"),
]
#: Names as prose gives them, with what leads up to them.
LEAD = r"(?:(?:(?:dual )?(?:licen[cs]ed|released|distributed|published|available|provided|made available) )?(?:under|subject to|in accordance with|governed by|covered by) (?:(?:the|a|an) )?(?:terms of (?:the )?)?)?"
NAMES = [
    ("agpl-3", "affero", r"(?:gnu )?affero (?:general )?public licen[cs]e(?: v(?:ersion )?| version )? ?3(?: 0)?"), ("agpl", "affero", r"(?:gnu )?affero (?:general )?public licen[cs]e"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1"), ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"), ("lgpl-2", "library general", r"(?:gnu )?library general public licen[cs]e(?: (?:version |v ?)?2)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:v |v|version )? ?2 1"), ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?(?:v |v|version )? ?3(?: 0)?"), ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?"), ("gpl-3", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"), ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:v |v|version )? ?2(?: 0)?"), ("gpl-2", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:v |v|version )? ?3(?: 0)?"), ("gpl-3", "gplv3", r"(?:gnu )?gplv3"), ("lgpl-3", "lgplv3", r"(?:gnu )?lgplv3"), ("agpl-3", "agplv3", r"(?:gnu )?agplv3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"), ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache-2", "apache", r"apache (?:software )?licen[cs]e (?:version |v ?)?2(?: 0)?"), ("apache-2", "apache", r"apache ?2(?: 0)?(?: licen[cs]e)?"), ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[cs]e)?"), ("mit", "mit", r"mit(?: style| x11| expat)? licen[cs]e"), ("mit", "expat", r"expat licen[cs]e"), ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-2", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"), ("bsd-3", "bsd", r"(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?"),
    ("bsd-2", "freebsd", r"freebsd licen[cs]e"), ("bsd-4", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?"), ("0bsd", "bsd", r"zero clause bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd (?:style |type )?licen[cs]e"), ("isc", "isc", r"isc licen[cs]e"), ("isc", "internet ", r"internet (?:systems|software) consortium licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1"), ("mpl-2", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?"), ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?"), ("epl-2", "eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?"), ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("edl-1", "eclipse", r"eclipse distribution licen[cs]e"), ("cddl", "common development", r"common development and distribution licen[cs]e(?: version 1 [01])?"), ("cpl-1", "common public", r"common public licen[cs]e"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: (?:version |v )?1 2)?"), ("eupl-1.1", "european union", r"european union public licen[cs]e (?:version |v )?1 1"),
    ("artistic-2", "artistic", r"artistic licen[cs]e (?:version |v )?2(?: 0)?"), ("artistic", "artistic", r"artistic licen[cs]e"), ("boost-1", "boost", r"boost software licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"), ("libpng", "libpng", r"libpng licen[cs]e"), ("unlicense", "unlicense", r"the unlicense"), ("wtfpl", "do what the", r"do what the [a-z]+ you want to public licen[cs]e"),
    ("beerware", "beerware", r"beer ?ware licen[cs]e"), ("python-2", "python", r"python software foundation licen[cs]e"), ("python-2", "psf", r"psf licen[cs]e"), ("php-3", "php", r"php licen[cs]e(?: version 3 01?)?"), ("ruby", "ruby", r"ruby licen[cs]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)?"), ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"), ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"), ("afl-3", "academic free", r"academic free licen[cs]e(?: version 3 0)?"), ("osl-3", "open software", r"open software licen[cs]e(?: version 3 0)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"), ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"), ("lppl-1.3", "latex", r"latex project public licen[cs]e"), ("qpl-1", "q public", r"q public licen[cs]e"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e"), ("upl-1", "universal permissive", r"universal permissive licen[cs]e"), ("cecill", "cecill", r"cecill(?: [bc])? (?:free software )?licen[cs]e"),
    ("busl-1.1", "business source", r"business source licen[cs]e"), ("sspl-1", "server side", r"server side public licen[cs]e"), ("elastic-2", "elastic", r"elastic licen[cs]e(?: 2 0)?"), ("commons-clause", "commons clause", r"commons clause"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"), ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"), ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"), ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"), ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"), ("cc0", "commons zero", r"creative commons zero"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"), ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial"), ("cc-by-sa", "commons", r"creative commons attribution share ?alike"), ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by", "commons", r"creative commons attribution"), ("odbl", "database", r"open (?:data commons open )?database licen[cs]e"), ("public-domain", "public domain", r"(?:released into|placed in|dedicated to|in) the public domain"),
    ("public-domain", "public domain", r"public domain"),
]
#: Notices that name no licence, with the confidence of each in percent.
NOTICES = [
    ("proprietary", "proprietary", r"proprietary and confidential", 90), ("proprietary", "all rights reserved", r"all rights reserved", 60), ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)", 70),
    ("copyright-notice", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 40), ("see-file", "see ", r"see (?:the )?licen[cs]e(?: file| txt| md)(?: for (?:details|terms|more information))?", 30),
    ("unknown", "licen", r"licen[cs]ed under", 20), ("unknown", "licen", r"licen[cs]e agreement", 20), ("unknown", "terms", r"terms of use", 10),
]
#: Beginnings of words of which every match of every rule holds one: a text without any is done at once.
GATE = ("licen", "under ", "copyright", "software", "permission", "redistribut", "warrant", "gnu ", "gpl", "lgpl", "agpl", "program ", "names? of ", "misrepresented", "altered source", "machine executable", "patent rights", "png reference",
        "general public", "affero", "lesser", "library general", "classpath exception", "network ?", "source code form", "you just do what", "beer in return", "deed has dedicated", "waived", "product includes", "unicode data", "third parties", "anyone is free",
        "apache", "cc by", "cc0", "creative ?commons", "bsd", "freebsd", "clause bsd", "public domain", "commons clause", "unlicense", "no attribution", "wtfpl", "cecill", "eupl",
        "(?:apache|gnu|opensource|mozilla|eclipse|creativecommons|boost|unlicense|sil|opendatacommons) org", "proprietary", "all rights", "unauthorized", "terms of use", "opendatacommons", "source and binary")
#: (table, what comes before a rule's expression, confidence in percent), the higher priority first.
TABLES = [(TEXTS, "", 95), (IDENTIFIERS, TAG, 100), (ADDRESSES, "", 90), (NAMES, LEAD, 80)]


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: int


def gate() -> str:
    """An expression that finds any of GATE, tried by first letter."""
    first: dict[str, list[str]] = {}
    for g in GATE:
        first.setdefault("" if g.startswith("(") else g[0], []).append(g if g.startswith("(") else g[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")"


def rules() -> list[Rule]:
    """All rules, a higher priority first. A keyword begins at a word's start."""
    made = [(label, key, lead + f"(?:{pattern})", sure) for table, lead, sure in TABLES for label, key, pattern in table] + NOTICES
    return [Rule(label, f" {key}", f" {pattern}(?= )", len(made) - i, sure) for i, (label, key, pattern, sure) in enumerate(made)]
