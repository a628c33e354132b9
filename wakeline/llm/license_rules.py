"""Signature rules of the license scan.

A rule is written over normalised words: lower case, letters and digits only,
single spaces. ``[x]`` marks an optional word, ``a/b`` a choice of words and
``*`` one arbitrary word. Rules stand in order; the class of a rule gives its
priority (1 comes first) and its confidence. Every rule names the keyword that
has to occur before its regex is tried.

``SIGNATURES`` are written by hand; the usual ways to name each of ``LICENSES`` in a
tag or a grant are made from four patterns.
"""

from __future__ import annotations

import re

# class: (priority, confidence)
CLASSES = {"tag": (1, 0.99), "grant": (2, 0.95), "text": (3, 0.9), "notice": (4, 0.8), "url": (5, 0.75), "name": (6, 0.6), "hint": (7, 0.3)}

#: Places that the base columns count, whatever suppresses them among the labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: label, keyword, ways to write the name, words of its SPDX tag.
LICENSES = [
    ("apache-2.0", "apache", "apache [software] license [version/v/v2] 2/v2 [0]", "apache 2 0"),
    ("apache-1.1", "apache", "apache [software] license [version] 1 1", "apache 1 1"),
    ("mit", "mit", "mit license", "mit"),
    ("mit", "expat", "expat license", ""),
    ("mit", "x11", "x11 license", ""),
    ("mit-0", "mit", "mit no attribution [license]", "mit 0"),
    ("bsd-2-clause", "bsd", "bsd 2/two clause [simplified] [license]", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3/three clause [new/revised] [license]", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd 4/four clause [original] [license]", "bsd 4 clause"),
    ("0bsd", "bsd", "bsd zero/0 clause [license]", "0bsd"),
    ("gpl-3.0", "public", "[gnu] general public license [as] [published] version/v3/v 3/0 [0]", "gpl 3 0 [only/or] [later]"),
    ("gpl-2.0", "public", "[gnu] general public license version/v 2 [0]", "gpl 2 0 [only/or] [later]"),
    ("gpl-1.0", "public", "[gnu] general public license version/v 1 [0]", "gpl 1 0 [only/or] [later]"),
    ("lgpl-3.0", "lesser", "[gnu] lesser general public license version/v 3 [0]", "lgpl 3 0 [only/or] [later]"),
    ("lgpl-2.1", "lesser", "[gnu] lesser general public license version/v 2 1", "lgpl 2 1 [only/or] [later]"),
    ("lgpl-2.0", "library", "[gnu] library general public license version/v 2 [0]", "lgpl 2 0 [only/or] [later]"),
    ("agpl-3.0", "affero", "[gnu] affero general public license version/v 3 [0]", "agpl 3 0 [only/or] [later]"),
    ("gfdl-1.3", "documentation", "[gnu] free documentation license [version/v] 1 3", "gfdl 1 3 [only/or] [later]"),
    ("gfdl-1.2", "documentation", "[gnu] free documentation license [version/v] 1 2", "gfdl 1 2 [only/or] [later]"),
    ("mpl-2.0", "mozilla", "mozilla public license [version/v] 2 0", "mpl 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public license [version/v] 1 1", "mpl 1 1"),
    ("epl-2.0", "eclipse", "eclipse public license [version/v] 2 0", "epl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license [version/v] 1 0", "epl 1 0"),
    ("cddl-1.0", "distribution", "common development and distribution license [version] 1 0", "cddl 1 0"),
    ("cpl-1.0", "common", "common public license [version] 1 0", "cpl 1 0"),
    ("isc", "isc", "isc license", "isc"),
    ("zlib", "zlib", "zlib [libpng] license", "zlib"),
    ("bsl-1.0", "boost", "boost software license [version] 1 0", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense [license]", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl [version] [2]", "wtfpl"),
    ("artistic-2.0", "artistic", "artistic license [version] 2 0", "artistic 2 0"),
    ("artistic-1.0", "artistic", "artistic license [version] 1 0", "artistic 1 0"),
    ("afl-3.0", "academic", "academic free license [version/v] 3 0", "afl 3 0"),
    ("osl-3.0", "open", "open software license [version/v] 3 0", "osl 3 0"),
    ("ecl-2.0", "educational", "educational community license [version] 2 0", "ecl 2 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("eupl-1.2", "european", "european union public licence/license [version/v] [1] [2]", "eupl 1 2"),
    ("cecill-2.1", "cecill", "cecill [free] [software] [license] 2 1", "cecill 2 1"),
    ("psf-2.0", "python", "python software foundation license [version] [2]", "psf 2 0"),
    ("php-3.01", "php", "php license [version] 3 01", "php 3 01"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("ofl-1.1", "sil", "sil open font license [version] [1] [1]", "ofl 1 1"),
    ("ubuntu-font-1.0", "ubuntu", "ubuntu font licence/license [version] [1] [0]", "ubuntu font 1 0"),
    ("postgresql", "postgresql", "postgresql license/licence", "postgresql"),
    ("ncsa", "illinois", "university of illinois ncsa open source license", "ncsa"),
    ("upl-1.0", "universal", "universal permissive license [version/v] [1] [0]", "upl 1 0"),
    ("bluebsd-oak", "blue", "blue oak model license [1] [0] [0]", "blueoak 1 0 0"),
    ("odbl-1.0", "database", "open database license [version/v] [1] [0]", "odbl 1 0"),
    ("odc-by-1.0", "attribution", "open data commons attribution license", "odc by 1 0"),
    ("pddl-1.0", "dedication", "public domain dedication and license", "pddl 1 0"),
    ("cc0-1.0", "cc0", "cc0 [1] [0] [universal]", "cc0 1 0"),
    ("cc-by-nc-sa", "cc", "cc by nc sa [1/2/3/4] [0/5]", "cc by nc sa 1/2/3/4 0/5"),
    ("cc-by-nc-nd", "cc", "cc by nc nd [1/2/3/4] [0/5]", "cc by nc nd 1/2/3/4 0/5"),
    ("cc-by-nc", "cc", "cc by nc [1/2/3/4] [0/5]", "cc by nc 1/2/3/4 0/5"),
    ("cc-by-nd", "cc", "cc by nd [1/2/3/4] [0/5]", "cc by nd 1/2/3/4 0/5"),
    ("cc-by-sa", "cc", "cc by sa [1/2/3/4] [0/5]", "cc by sa 1/2/3/4 0/5"),
    ("cc-by-4.0", "cc", "cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "cc", "cc by 3 0", "cc by 3 0"),
    ("cc-by-nc-sa", "noncommercial", "[creative] [commons] attribution noncommercial sharealike [1/2/3/4] [0/5]", ""),
    ("cc-by-nc-nd", "noderivatives", "[creative] [commons] attribution noncommercial noderivatives [1/2/3/4] [0/5]", ""),
    ("cc-by-nc", "noncommercial", "[creative] [commons] attribution noncommercial [1/2/3/4] [0/5]", ""),
    ("cc-by-sa", "sharealike", "[creative] [commons] attribution sharealike [1/2/3/4] [0/5]", ""),
    ("cc-by-nd", "noderivatives", "[creative] [commons] attribution noderivatives [1/2/3/4] [0/5]", ""),
    ("cc-by", "creative", "creative commons attribution [1/2/3/4] [0/5]", ""),
    ("openrail", "rail", "open rail m/d/s [license]", ""),
    ("elastic-2.0", "elastic", "elastic license [version/v] 2 0", "elastic 2 0"),
    ("sspl-1.0", "server", "server side public license [version/v] [1]", "sspl 1 0"),
    ("busl-1.1", "business", "business source license [version] 1 1", "busl 1 1"),
]

#: class, label, keyword, rule: sentences of license texts, notices, addresses and hints.
SIGNATURES = [
    ("text", "mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("text", "mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("text", "isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("text", "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("text", "bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("text", "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("text", "bsd-3-clause", "endorse", "neither the name of * [*] [*] nor the names of its contributors may be used to endorse"),
    ("text", "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("text", "zlib", "origin", "the origin of this software must not be misrepresented"),
    ("text", "zlib", "altered", "altered source versions must be plainly marked as such"),
    ("text", "apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("text", "apache-2.0", "agreed", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("text", "gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("text", "lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("text", "gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("text", "gpl", "received", "you should have received a copy of the gnu general public license along with this program"),
    ("text", "lgpl", "received", "you should have received a copy of the gnu lesser general public license"),
    ("text", "agpl", "received", "you should have received a copy of the gnu affero general public license"),
    ("text", "agpl-3.0", "network", "interacting with it remotely through a computer network"),
    ("text", "mpl-2.0", "source", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("text", "epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("text", "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("text", "wtfpl", "want", "you just do what the fuck you want to"),
    ("text", "bsl-1.0", "boost", "distributed under the boost software license"),
    ("text", "cc0-1.0", "waived", "has waived all copyright and related or neighboring rights"),
    ("text", "cc0-1.0", "dedicated", "has dedicated the work to the public domain"),
    ("text", "artistic", "perl", "under the same terms as perl itself"),
    ("text", "ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    ("text", "ofl-1.1", "reserved", "with reserved font name"),
    ("text", "gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("text", "json", "evil", "the software shall be used for good not evil"),
    ("text", "beerware", "beer", "you can buy me a beer in return"),
    ("text", "warranty", "merchantability", "including but not limited to the [implied] warranties of merchantability"),
    ("text", "warranty", "warranty", "the software is provided as is without warranty of any kind"),
    ("text", "warranty", "liable", "in no event shall the [authors/copyright] [or] [holders/owner] [*] [*] be liable for any"),
    ("notice", "reserved", "rights", "all rights [are] reserved"),
    ("notice", "some-reserved", "rights", "some rights reserved"),
    ("notice", "no-rights", "rights", "no rights reserved"),
    ("notice", "proprietary", "proprietary", "confidential and proprietary"),
    ("notice", "proprietary", "unauthorized", "unauthorized copying/reproduction/use/distribution of this * is [strictly] prohibited"),
    ("notice", "proprietary", "permission", "without [the] [prior/express] [written] permission of"),
    ("notice", "proprietary", "transmitted", "may be reproduced stored in a retrieval system or transmitted"),
    ("notice", "proprietary", "reproduced", "no part of this publication/book/document may be reproduced"),
    ("notice", "public-domain", "domain", "this work/text/book/file/image is in the public domain"),
    ("notice", "public-domain", "domain", "released/placed/dedicated into/to/in the public domain"),
    ("notice", "public-domain", "domain", "public domain mark"),
    ("notice", "us-government", "government", "work of the united states government"),
    ("notice", "crown", "crown", "crown copyright"),
    ("notice", "ogl-3.0", "government", "open government licence v3/v2/v1 [0]"),
    ("notice", "gutenberg", "gutenberg", "project gutenberg license"),
    ("notice", "cc", "creative", "some rights reserved creative commons"),
    ("notice", "fair-use", "fair", "fair use notice/rationale"),
    ("notice", "royalty-free", "royalty", "royalty free license"),
    ("notice", "nc-use", "commercial", "for non commercial use only"),
    ("notice", "nc-use", "noncommercial", "for noncommercial use/purposes only"),
    ("notice", "nc-use", "personal", "for personal [and] [non] [commercial] use only"),
    ("notice", "research-only", "research", "for research purposes/use only"),
    ("notice", "research-only", "academic", "for academic [and] [research] use/purposes only"),
    ("notice", "dual", "dual", "dual licensed under"),
    ("notice", "dual", "either", "under either the * [*] license or the"),
    ("url", "apache-2.0", "apache", "apache org licenses license 2 0"),
    ("url", "mit", "opensource", "opensource org licenses mit [license]"),
    ("url", "bsd", "opensource", "opensource org licenses bsd [2/3] [clause] [license]"),
    ("url", "gpl-3.0", "gnu", "gnu org licenses gpl 3 [0]"),
    ("url", "gpl-2.0", "gnu", "gnu org licenses [old] [licenses] gpl 2 [0]"),
    ("url", "gpl", "gnu", "gnu org [copyleft] [licenses] gpl"),
    ("url", "lgpl", "gnu", "gnu org [copyleft] [licenses] lgpl"),
    ("url", "agpl", "gnu", "gnu org [copyleft] [licenses] agpl"),
    ("url", "gfdl", "gnu", "gnu org [copyleft] [licenses] fdl"),
    ("url", "mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    ("url", "mpl", "mozilla", "mozilla org mpl"),
    ("url", "epl", "eclipse", "eclipse org legal epl v10/v20/2"),
    ("url", "unlicense", "unlicense", "unlicense org"),
    ("url", "cc-by", "creativecommons", "creativecommons org licenses by [1/2/3/4] [0/5]"),
    ("url", "cc-by-sa", "creativecommons", "creativecommons org licenses by sa"),
    ("url", "cc-by-nd", "creativecommons", "creativecommons org licenses by nd"),
    ("url", "cc-by-nc", "creativecommons", "creativecommons org licenses by nc"),
    ("url", "cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa"),
    ("url", "cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd"),
    ("url", "cc0-1.0", "creativecommons", "creativecommons org publicdomain zero"),
    ("url", "public-domain", "creativecommons", "creativecommons org publicdomain mark"),
    ("url", "ofl-1.1", "sil", "scripts sil org ofl"),
    ("url", "bsl-1.0", "boost", "boost org license 1 0"),
    ("url", "zlib", "zlib", "zlib net zlib license"),
    ("url", "odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl"),
    ("name", "gpl", "public", "[gnu] general public license"),
    ("name", "lgpl", "lesser", "[gnu] lesser general public license"),
    ("name", "agpl", "affero", "[gnu] affero general public license"),
    ("name", "gfdl", "documentation", "[gnu] free documentation license"),
    ("name", "apache", "apache", "apache [software] license"),
    ("name", "mpl", "mozilla", "mozilla public license"),
    ("name", "epl", "eclipse", "eclipse public license"),
    ("name", "artistic", "artistic", "artistic license"),
    ("name", "bsd", "bsd", "bsd [style] license"),
    ("name", "mit", "mit", "mit style license"),
    ("name", "cc", "creative", "creative commons license"),
    ("name", "cc-by", "cc", "cc by"),
    ("name", "gpl", "gpl", "gplv2/gplv3/gpl2/gpl3 [or] [later]"),
    ("name", "lgpl", "lgpl", "lgplv2/lgplv3/lgpl2/lgpl3"),
    ("name", "agpl", "agpl", "agplv3/agpl3"),
    ("hint", "license-file", "file", "see [the] license/copying file [for] [details/more]"),
    ("hint", "license-file", "license", "see license [txt/md] [for] [details]"),
    ("hint", "license-terms", "terms", "under the terms of the/this license"),
    ("hint", "license-terms", "following", "subject to the following terms/conditions"),
    ("hint", "copyright", "copyright", "copyright [c] 19*/20* [*]"),
    ("hint", "copyright", "copyright", "copyright holder/holders/owner/notice"),
    ("hint", "copyright", "copyrighted", "copyrighted material/work/content"),
    ("hint", "open-source", "source", "open source license/licence"),
    ("text", "apache-2.0", "derivative", "you may reproduce and distribute copies of the work or derivative works thereof in any medium"),
    ("text", "apache-2.0", "perpetual", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright/patent license"),
    ("text", "apache-2.0", "trademarks", "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("text", "apache-2.0", "prominent", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("text", "apache-1.1", "foundation", "this product includes software developed by the apache software foundation"),
    ("text", "mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("text", "mit", "furnished", "to permit persons to whom the software is furnished to do so"),
    ("text", "x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("text", "isc", "appear", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("text", "hpnd", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("text", "hpnd", "publicity", "shall not be used in advertising or publicity pertaining to distribution of the software"),
    ("text", "bsd", "disclaimer", "this list of conditions and the following disclaimer"),
    ("text", "bsd", "contributors", "this software is provided by the copyright holders and contributors as is"),
    ("text", "bsd", "regents", "this software is provided by the regents and contributors as is"),
    ("text", "bsd", "consequential", "direct indirect incidental special exemplary or consequential damages"),
    ("text", "bsd-4-clause", "university", "this product includes software developed by the university of california"),
    ("text", "zlib", "anyone", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("text", "zlib", "removed", "this notice may not be removed or altered from any source distribution"),
    ("text", "gpl", "distributed", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("text", "lgpl", "distributed", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("text", "gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("text", "gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("text", "gpl", "covered", "to propagate or modify any covered work"),
    ("text", "gpl", "convey", "you may convey verbatim copies of the program s source code"),
    ("text", "gpl", "temple", "free software foundation inc 59 temple place"),
    ("text", "gpl", "franklin", "free software foundation inc 51 franklin street"),
    ("text", "lgpl", "combine", "you may combine or link a work that uses the library with the library"),
    ("text", "agpl-3.0", "modified", "if you modify the program your modified version must prominently offer all users"),
    ("text", "agpl", "ensure", "designed specifically to ensure cooperation with the community in the case of network server software"),
    ("text", "gfdl", "permission", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("text", "gfdl", "invariant", "with the invariant sections being"),
    ("text", "mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file"),
    ("text", "mpl-2.0", "incompatible", "this source code form is incompatible with secondary licenses"),
    ("text", "mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("text", "mpl", "distributed", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language"),
    ("text", "epl-2.0", "secondary", "this source code may also be made available under the following secondary licenses"),
    ("text", "cddl", "distribution", "the contents of this file are subject to the terms of the common development and distribution license [the] [license] [cddl]"),
    ("text", "cpl-1.0", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("text", "bsl-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("text", "bsl-1.0", "machine", "solely in the form of machine executable object code generated by a source language processor"),
    ("text", "unlicense", "benefit", "we make this dedication for the benefit of the public at large"),
    ("text", "unlicense", "relinquishment", "an overt act of relinquishment in perpetuity of all present and future rights"),
    ("text", "wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("text", "cc0-1.0", "contravention", "to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently"),
    ("text", "cc0-1.0", "copy", "you can copy modify distribute and perform the work even for commercial purposes all without asking permission"),
    ("text", "cc-by", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("text", "cc-by-sa", "contributions", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("text", "cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("text", "cc-by-nd", "modified", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("text", "cc", "adapted", "adapted material means material subject to copyright and similar rights that is derived from or based upon the licensed material"),
    ("text", "cc", "licensor", "the licensor hereby grants you a worldwide royalty free non sublicensable non exclusive irrevocable license"),
    ("text", "cc", "corporation", "creative commons corporation is not a law firm and does not provide legal services"),
    ("text", "odbl-1.0", "database", "this database is made available under the open database license"),
    ("text", "odbl-1.0", "individual", "any rights in individual contents of the database are licensed under the database contents license"),
    ("text", "pddl-1.0", "dedicates", "the rightsholder dedicates the whole of the copyright in the database to the public domain"),
    ("text", "artistic-2.0", "package", "this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("text", "artistic-1.0", "semblance", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("text", "afl", "academic", "licensed under the academic free license"),
    ("text", "osl", "open", "licensed under the open software license"),
    ("text", "ms-pl", "contributor", "each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("text", "eupl", "eupl", "licensed under the eupl"),
    ("text", "cecill", "cecill", "governed by the cecill [b/c] license under french law"),
    ("text", "psf-2.0", "psf", "psf is making python available to licensee on an as is basis"),
    ("text", "php-3.01", "php", "this product includes php software freely available from"),
    ("text", "openssl", "toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("text", "ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("text", "ncsa", "deal", "permission is hereby granted to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("text", "postgresql", "agreement", "without a written agreement is hereby granted provided that the above copyright notice and this paragraph"),
    ("text", "curl", "permission", "copyright and permission notice copyright [c] [*] [*] daniel stenberg"),
    ("text", "sspl-1.0", "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("text", "elastic-2.0", "managed", "you may not provide the software to third parties as a hosted or managed service"),
    ("text", "busl-1.1", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("text", "openrail", "restrictions", "use based restrictions set forth in attachment a"),
    ("text", "llama", "llama", "llama [2/3] community license agreement"),
    ("text", "ogl-3.0", "information", "contains public sector information licensed under the open government licence"),
    ("text", "gutenberg", "ebook", "this ebook is for the use of anyone anywhere"),
    ("text", "gutenberg", "trademark", "project gutenberg is a registered trademark"),
    ("text", "warranty", "fitness", "fitness for a particular purpose and noninfringement"),
    ("text", "warranty", "disclaims", "disclaims all warranties with regard to this software"),
    ("text", "warranty", "performance", "the entire risk as to the quality and performance of the program is with you"),
    ("notice", "proprietary", "trade", "this [document/file/software] contains trade secrets"),
    ("notice", "proprietary", "confidential", "confidential information of the company/owner"),
    ("notice", "proprietary", "unpublished", "this is unpublished proprietary source code"),
    ("notice", "proprietary", "redistribution", "redistribution is [strictly/expressly] prohibited"),
    ("notice", "proprietary", "consent", "without the [express] [prior] [written] consent of"),
    ("notice", "proprietary", "internal", "for internal use only"),
    ("notice", "proprietary", "evaluation", "for evaluation purposes only"),
    ("notice", "proprietary", "published", "may not be published broadcast rewritten or redistributed"),
    ("notice", "proprietary", "resale", "not for resale"),
    ("notice", "proprietary", "respective", "property of their respective owners"),
    ("notice", "public-domain", "expired", "copyright has expired"),
    ("notice", "public-domain", "domain", "is a public domain work"),
    ("notice", "public-domain", "copyright", "no known copyright restrictions"),
    ("notice", "public-domain", "waive", "waive all copyright and related rights"),
    ("notice", "us-government", "17", "17 u s c 105"),
    ("notice", "dmca", "dmca", "dmca notice/takedown/complaint/policy"),
    ("notice", "dmca", "infringement", "claimed [copyright] infringement"),
    ("notice", "dual", "choose", "you may choose either license"),
    ("notice", "dual", "option", "at your option any later version"),
    ("notice", "nc-use", "educational", "for educational use/purposes only"),
    ("notice", "nc-use", "private", "for private use only"),
    ("notice", "permission", "permission", "used/reprinted/reproduced with permission"),
    ("notice", "permission", "free", "free to use with credit/attribution"),
    ("notice", "copyleft", "copyleft", "copyleft all wrongs reserved"),
    ("notice", "patent", "patent", "patent pending"),
    ("notice", "trademark", "registered", "is a registered trademark of"),
    ("url", "cc", "creativecommons", "creativecommons org licenses"),
    ("url", "spdx", "spdx", "spdx org licenses"),
    ("url", "choosealicense", "choosealicense", "choosealicense com licenses"),
    ("url", "isc", "opensource", "opensource org licenses isc [license]"),
    ("url", "apache-2.0", "opensource", "opensource org licenses apache 2 0"),
    ("url", "artistic-2.0", "opensource", "opensource org licenses artistic [license] 2 0"),
    ("url", "epl", "opensource", "opensource org licenses epl"),
    ("url", "openssl", "openssl", "openssl org source license"),
    ("url", "postgresql", "postgresql", "postgresql org about licence"),
    ("url", "psf-2.0", "python", "docs python org license"),
    ("url", "ogl-3.0", "nationalarchives", "nationalarchives gov uk doc open government licence"),
    ("url", "gutenberg", "gutenberg", "gutenberg org license"),
    ("url", "wtfpl", "wtfpl", "wtfpl net"),
    ("url", "elastic-2.0", "elastic", "elastic co licensing elastic license"),
    ("url", "sspl-1.0", "mongodb", "mongodb com licensing server side public license"),
    ("name", "cc0-1.0", "creative", "creative commons zero"),
    ("name", "ogl", "ogl", "ogl licence/license"),
    ("name", "isc", "isc", "isc style license"),
    ("name", "wtfpl", "fuck", "do what the fuck you want to public license"),
    ("name", "mpl", "mpl", "mplv1/mplv2/mpl1/mpl2"),
    ("name", "apache", "apache", "apache style license"),
    ("name", "unlicense", "unlicense", "the unlicense"),
    ("hint", "license-file", "notice", "see the notice file"),
    ("hint", "license-file", "licenses", "see the licenses directory/folder"),
    ("hint", "license-file", "distributed", "license file distributed with this/the"),
    ("hint", "license-terms", "agree", "by using this [software/site/service] you agree to"),
    ("hint", "license-terms", "agreement", "end user license agreement"),
    ("hint", "copyright", "copyrights", "all other trademarks and copyrights"),
    ("hint", "copyright", "copr", "copr 19*/20*"),
    ("hint", "open-source", "libre", "free libre [and] open source software"),
]


def _grants(label: str, key: str, name: str, tag: str):
    """The usual ways to put a work under a license: a tag, three grants and the bare name."""
    if tag:
        yield "tag", label, "spdx", f"spdx license identifier {tag}"
    yield "grant", label, key, f"licensed/released/distributed/available/published/provided under [the] [terms] [of] [the] {name}"
    yield "grant", label, key, f"licence/license {name}"
    yield "grant", label, key, f"this work/software/project/file/code/library/document is [*] [*] under [the] [terms] [of] [the] {name}"
    yield "name", label, key, name


def rules() -> list[tuple[str, str, str, str]]:
    """(class, label, keyword, rule) of every rule, in order."""
    out = [r for row in LICENSES for r in _grants(*row)] + SIGNATURES
    return list(dict.fromkeys(out))


def regex(rule: str) -> str:
    """A regex over words that each end in a space; a match begins at a word's start."""
    word, out = r"[^ ]+", []
    for part in rule.split(" "):
        optional = part[0] == "["
        part = part.strip("[]")
        choices = "|".join(re.escape(x).replace(r"\*", r"[^ ]*") for x in part.split("/"))
        one = word if part == "*" else f"(?:{choices})"
        out.append(f"(?:{one} )?" if optional else f"{one} ")
    return r"(?<= )" + "".join(out)
