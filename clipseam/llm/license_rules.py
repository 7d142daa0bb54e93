"""Signatures of licences, written by hand over normalised words.

A line holds label | level | keyword | pattern. Patterns are regular expressions over lower-case words parted by single
spaces; groups don't capture. The keyword is a word of every match. Levels, from the surest: 1 identifier tags, 2 grants
and licence texts, 3 links, 4 titles, 5 mentions.
"""

from __future__ import annotations

#: Labels that the query's contract names, with their phrases (fixed values).
BASE = """
cc-by | 5 | cc | cc by
gpl | 5 | public | general public license
reserved | 5 | reserved | all rights reserved
"""

RULES = """
apache-2.0 | 1 | spdx | spdx license identifier apache 2 0
apache-2.0 | 2 | licensed | licensed under( the)?( terms of the)? apache( software)? license( version)? v?2( 0)?
apache-2.0 | 2 | apache | (released|distributed|available|published|provided) under( the)?( terms of the)? apache( software)? license( version)? v?2( 0)?
apache-2.0 | 3 | apache | apache org licenses license 2 0
apache-2.0 | 3 | opensource | opensource org licenses? apache 2 0
apache-2.0 | 4 | apache | apache( software)? license( version)? v?2( 0)?
apache-2.0 | 5 | apache | apache v?2( 0)?
apache-2.0 | 5 | asl | asl 2( 0)?
apache-1.1 | 1 | spdx | spdx license identifier apache 1 1
apache-1.1 | 4 | apache | apache software license( version)? v?1 1
apache-1.0 | 4 | apache | apache software license( version)? v?1 0
apache | 2 | licensed | licensed under( the)? apache( software)? license
apache | 2 | apache | (released|distributed|available) under( the)? apache( software)? license
apache | 5 | apache | apache( software)? licen[cs]e
mit | 1 | spdx | spdx license identifier mit
mit | 2 | mit | (licensed|released|distributed|available|published|provided) under( the)?( terms of the)? mit( x11)? licen[cs]e
mit | 2 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | 2 | software | the software is provided as is without warranty of any kind express or implied
mit | 3 | mit | opensource org licenses? mit( license)?
mit | 3 | mit | choosealicense com licenses mit
mit | 4 | mit | (the )?mit( x11)? licen[cs]e
mit | 4 | mit | mit( style)? licensed
mit | 4 | expat | expat licen[cs]e
mit | 5 | mit | license mit
mit-0 | 1 | spdx | spdx license identifier mit 0
mit-0 | 4 | attribution | mit no attribution( licen[cs]e)?
x11 | 1 | spdx | spdx license identifier x11
x11 | 4 | x11 | x11 licen[cs]e
bsd-2-clause | 1 | spdx | spdx license identifier bsd 2 clause
bsd-2-clause | 3 | bsd | opensource org licenses? bsd 2 clause
bsd-2-clause | 4 | bsd | (simplified|freebsd) bsd licen[cs]e
bsd-2-clause | 4 | bsd | (bsd 2 clause|2 clause bsd|two clause bsd)( licen[cs]e)?
bsd-2-clause | 4 | freebsd | freebsd licen[cs]e
bsd-3-clause | 1 | spdx | spdx license identifier bsd 3 clause
bsd-3-clause | 2 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 3 | bsd | opensource org licenses? bsd 3 clause
bsd-3-clause | 4 | bsd | (new|modified|revised) bsd licen[cs]e
bsd-3-clause | 4 | bsd | (bsd 3 clause|3 clause bsd|three clause bsd)( licen[cs]e)?
bsd-4-clause | 1 | spdx | spdx license identifier bsd 4 clause
bsd-4-clause | 2 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 4 | bsd | (original|old) bsd licen[cs]e
bsd-4-clause | 4 | bsd | (bsd 4 clause|4 clause bsd|four clause bsd)( licen[cs]e)?
0bsd | 1 | spdx | spdx license identifier 0bsd
0bsd | 4 | bsd | (zero clause bsd|bsd zero clause)( licen[cs]e)?
0bsd | 5 | 0bsd | 0bsd
bsd | 2 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 2 | bsd | (licensed|released|distributed|available) under( the)?( terms of the)? bsd( style)? licen[cs]e
bsd | 4 | bsd | bsd( style)? licen[cs]e
bsd | 5 | bsd | bsd licensed
gpl-1.0 | 1 | spdx | spdx license identifier gpl 1 0( only| or later)?
gpl-1.0 | 4 | general | general public license( version)? v?1( 0)?
gpl-2.0 | 1 | spdx | spdx license identifier gpl 2 0( only)?
gpl-2.0 | 2 | general | (licensed|released|distributed|available) under( the)?( terms of the)?( gnu)? general public license( version)? v?2( 0)?
gpl-2.0 | 3 | gpl | gnu org licenses( old licenses)? gpl 2 0
gpl-2.0 | 4 | general | (gnu )?general public license( as published by the free software foundation)?( version)? v?2( 0)?
gpl-2.0 | 5 | gplv2 | gplv2
gpl-2.0 | 5 | gpl | gpl( version)? v?2( 0)?
gpl-2.0-or-later | 1 | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0-or-later | 2 | general | general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-or-later | 5 | gpl | gpl( version)? v?2( 0)? or later
gpl-3.0 | 1 | spdx | spdx license identifier gpl 3 0( only)?
gpl-3.0 | 2 | general | (licensed|released|distributed|available) under( the)?( terms of the)?( gnu)? general public license( version)? v?3( 0)?
gpl-3.0 | 3 | gpl | gnu org licenses gpl( 3 0)?
gpl-3.0 | 4 | general | (gnu )?general public license( version)? v?3( 0)?
gpl-3.0 | 5 | gplv3 | gplv3
gpl-3.0 | 5 | gpl | gpl( version)? v?3( 0)?
gpl-3.0-or-later | 1 | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0-or-later | 2 | general | general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0-or-later | 5 | gpl | gpl( version)? v?3( 0)? or later
gpl | 2 | general | (licensed|released|distributed|available) under( the)?( terms of the)?( gnu)? general public license
gpl | 2 | gpl | (licensed|released|distributed|available) under( the)?( terms of the)?( gnu)? gpl
gpl | 2 | general | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 2 | general | you should have received a copy of the gnu general public license
gpl | 4 | general | gnu general public licen[cs]e
gpl | 5 | gpl | (gnu )?gpl
lgpl-2.0 | 1 | spdx | spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.0 | 4 | library | (gnu )?library general public license( version)? v?2( 0)?
lgpl-2.1 | 1 | spdx | spdx license identifier lgpl 2 1( only| or later)?
lgpl-2.1 | 3 | lgpl | gnu org licenses( old licenses)? lgpl 2 1
lgpl-2.1 | 4 | lesser | (gnu )?lesser general public license( version)? v?2 1
lgpl-2.1 | 5 | lgpl | lgpl( version)? v?2 1
lgpl-3.0 | 1 | spdx | spdx license identifier lgpl 3 0( only| or later)?
lgpl-3.0 | 3 | lgpl | gnu org licenses lgpl( 3 0)?
lgpl-3.0 | 4 | lesser | (gnu )?lesser general public license( version)? v?3( 0)?
lgpl-3.0 | 5 | lgpl | lgpl( version)? v?3( 0)?
lgpl-3.0 | 5 | lgplv3 | lgplv3
lgpl | 2 | lesser | (licensed|released|distributed|available) under( the)?( terms of the)?( gnu)? lesser general public license
lgpl | 4 | lesser | (gnu )?lesser general public licen[cs]e
lgpl | 4 | library | (gnu )?library general public licen[cs]e
lgpl | 5 | lgpl | (gnu )?lgpl
agpl-3.0 | 1 | spdx | spdx license identifier agpl 3 0( only| or later)?
agpl-3.0 | 3 | agpl | gnu org licenses agpl( 3 0)?
agpl-3.0 | 4 | affero | (gnu )?affero general public license( version)? v?3( 0)?
agpl-3.0 | 5 | agpl | agpl( version)? v?3( 0)?
agpl-3.0 | 5 | agplv3 | agplv3
agpl | 2 | affero | (licensed|released|distributed|available) under( the)?( terms of the)?( gnu)? affero general public license
agpl | 4 | affero | (gnu )?affero general public licen[cs]e
agpl | 5 | agpl | (gnu )?agpl
gfdl | 1 | spdx | spdx license identifier gfdl 1 [123]( only| or later)?
gfdl | 2 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 3 | fdl | gnu org (copyleft|licenses) fdl( 1 3)?
gfdl | 4 | documentation | (gnu )?free documentation licen[cs]e( version 1 [123])?
gfdl | 5 | gfdl | gfdl
mpl-1.1 | 1 | spdx | spdx license identifier mpl 1 1
mpl-1.1 | 4 | mozilla | mozilla public license( version)? v?1 1
mpl-1.1 | 5 | mpl | mpl v?1 1
mpl-2.0 | 1 | spdx | spdx license identifier mpl 2 0
mpl-2.0 | 2 | mozilla | subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 3 | mpl | mozilla org (en us )?mpl 2 0
mpl-2.0 | 4 | mozilla | mozilla public license( version)?( v)? v?2( 0)?
mpl-2.0 | 5 | mpl | mpl v?2( 0)?
mpl | 4 | mozilla | mozilla public licen[cs]e
epl-1.0 | 1 | spdx | spdx license identifier epl 1 0
epl-1.0 | 3 | epl | eclipse org legal epl v10
epl-1.0 | 4 | eclipse | eclipse public license( version)? v?1( 0)?
epl-2.0 | 1 | spdx | spdx license identifier epl 2 0
epl-2.0 | 3 | epl | eclipse org legal epl( v20| 2 0)
epl-2.0 | 4 | eclipse | eclipse public license( version)? v?2( 0)?
epl | 4 | eclipse | eclipse public licen[cs]e
cddl-1.0 | 1 | spdx | spdx license identifier cddl 1 [01]
cddl-1.0 | 4 | distribution | common development and distribution licen[cs]e( version)?( 1 [01])?
cddl-1.0 | 5 | cddl | cddl( 1 [01])?
cpl-1.0 | 4 | common | common public licen[cs]e( version)?( 1 0)?
ibm-pl | 4 | ibm | ibm public licen[cs]e( version)?( 1 0)?
artistic-1.0 | 4 | artistic | (perl )?artistic license( version)? 1 0
artistic-2.0 | 1 | spdx | spdx license identifier artistic 2 0
artistic-2.0 | 4 | artistic | artistic license( version)? 2( 0)?
artistic | 2 | perl | (licensed )?under the same terms as perl itself
artistic | 4 | artistic | (perl )?artistic licen[cs]e
bsl-1.0 | 1 | spdx | spdx license identifier bsl 1 0
bsl-1.0 | 2 | boost | distributed under the boost software license
bsl-1.0 | 3 | boost | boost org license 1 0 txt
bsl-1.0 | 4 | boost | boost software licen[cs]e( version)?( 1 0)?
busl-1.1 | 1 | spdx | spdx license identifier busl 1 1
busl-1.1 | 4 | business | business source licen[cs]e( 1 1)?
sspl-1.0 | 1 | spdx | spdx license identifier sspl 1 0
sspl-1.0 | 4 | server | server side public licen[cs]e( version)?( v?1)?
elastic-2.0 | 1 | spdx | spdx license identifier elastic 2 0
elastic-2.0 | 4 | elastic | elastic licen[cs]e( version)?( 2 0)?
isc | 1 | spdx | spdx license identifier isc
isc | 2 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | isc | opensource org licenses? isc( license)?
isc | 4 | isc | isc licen[cs]e
zlib | 1 | spdx | spdx license identifier zlib
zlib | 2 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 3 | zlib | opensource org licenses? zlib( license)?
zlib | 4 | zlib | zlib( libpng)? licen[cs]e
libpng | 4 | libpng | libpng licen[cs]e
unlicense | 1 | spdx | spdx license identifier unlicense
unlicense | 2 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | unlicense | unlicense org
unlicense | 4 | unlicense | the unlicense
wtfpl | 1 | spdx | spdx license identifier wtfpl
wtfpl | 4 | public | do what the fuck you want to public licen[cs]e
wtfpl | 5 | wtfpl | wtfpl
cc0-1.0 | 1 | spdx | spdx license identifier cc0 1 0
cc0-1.0 | 2 | dedicate | dedicate any and all copyright interest in the software to the public domain
cc0-1.0 | 3 | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | 4 | cc0 | (creative commons )?cc0( 1 0)?( universal)?
cc0-1.0 | 4 | commons | creative commons zero( v?1 0)?( universal)?
cc-by-3.0 | 3 | creativecommons | creativecommons org licenses by 3 0
cc-by-3.0 | 4 | cc | cc by 3 0
cc-by-3.0 | 4 | commons | creative commons attribution 3 0
cc-by-4.0 | 1 | spdx | spdx license identifier cc by 4 0
cc-by-4.0 | 3 | creativecommons | creativecommons org licenses by 4 0
cc-by-4.0 | 4 | cc | cc by( v)? 4 0
cc-by-4.0 | 4 | commons | creative commons attribution 4 0( international)?
cc-by-sa-3.0 | 3 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-3.0 | 4 | cc | cc by sa 3 0
cc-by-sa-4.0 | 1 | spdx | spdx license identifier cc by sa 4 0
cc-by-sa-4.0 | 3 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-4.0 | 4 | cc | cc by sa 4 0
cc-by-sa-4.0 | 4 | sharealike | creative commons attribution sharealike 4 0( international)?
cc-by-sa | 4 | cc | cc by sa
cc-by-sa | 4 | sharealike | creative commons attribution sharealike
cc-by-nc-4.0 | 1 | spdx | spdx license identifier cc by nc 4 0
cc-by-nc-4.0 | 2 | cc | (licensed|released|distributed|available) under( a| the)? cc by nc 4 0
cc-by-nc-4.0 | 3 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | 4 | cc | cc by nc 4 0
cc-by-nc-4.0 | 4 | noncommercial | creative commons attribution noncommercial 4 0( international)?
cc-by-nc | 4 | cc | cc by nc
cc-by-nc | 4 | noncommercial | creative commons attribution noncommercial
cc-by-nc | 4 | commons | creative commons attribution non commercial
cc-by-nc-sa-4.0 | 3 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 | 4 | cc | cc by nc sa 4 0
cc-by-nc-sa | 4 | cc | cc by nc sa
cc-by-nc-sa | 4 | sharealike | creative commons attribution noncommercial sharealike
cc-by-nc-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 | 4 | cc | cc by nc nd 4 0
cc-by-nc-nd | 4 | cc | cc by nc nd
cc-by-nc-nd | 4 | noderivatives | creative commons attribution noncommercial noderivatives
cc-by-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nd-4.0 | 4 | cc | cc by nd 4 0
cc-by-nd | 4 | cc | cc by nd
cc-by-nd | 4 | noderivatives | creative commons attribution noderivatives
cc-by | 2 | commons | licensed under( a| the)? creative commons attribution
cc-by | 4 | commons | creative commons attribution licen[cs]e
creative-commons | 3 | creativecommons | creativecommons org licenses
creative-commons | 5 | commons | creative commons( licen[cs]e)?
public-domain | 2 | domain | (released|placed|dedicated) (in|into|to) the public domain
public-domain | 4 | domain | this (work|file|image|text|software|book) is in the public domain
public-domain | 4 | domain | public domain (dedication|mark)( 1 0)?
public-domain | 3 | publicdomain | creativecommons org publicdomain mark 1 0
odbl-1.0 | 1 | spdx | spdx license identifier odbl 1 0
odbl-1.0 | 3 | odbl | opendatacommons org licenses odbl
odbl-1.0 | 4 | database | open (data commons open )?database licen[cs]e
odbl-1.0 | 5 | odbl | odbl
pddl-1.0 | 3 | pddl | opendatacommons org licenses pddl
pddl-1.0 | 4 | pddl | pddl( 1 0)?
odc-by | 3 | opendatacommons | opendatacommons org licenses by
odc-by | 4 | odc | odc by( v?1 0)?
odc-by | 4 | commons | open data commons attribution licen[cs]e
ofl-1.1 | 1 | spdx | spdx license identifier ofl 1 1
ofl-1.1 | 3 | ofl | scripts sil org ofl
ofl-1.1 | 4 | sil | sil open font licen[cs]e( version)?( 1 1)?
ofl-1.1 | 5 | font | open font licen[cs]e
eupl-1.2 | 1 | spdx | spdx license identifier eupl 1 [12]
eupl-1.2 | 4 | european | european union public licen[cs]e( version)?( v?1 [12])?
eupl-1.2 | 5 | eupl | eupl
cecill | 1 | spdx | spdx license identifier cecill( b| c)?( 2 [01])?
cecill | 4 | cecill | (licence )?cecill( b| c)?
ms-pl | 1 | spdx | spdx license identifier ms pl
ms-pl | 4 | microsoft | microsoft public licen[cs]e
ms-rl | 4 | microsoft | microsoft reciprocal licen[cs]e
ncsa | 1 | spdx | spdx license identifier ncsa
ncsa | 4 | ncsa | (university of illinois )?ncsa open source licen[cs]e
psf-2.0 | 1 | spdx | spdx license identifier (psf|python) 2 0
psf-2.0 | 4 | python | python software foundation licen[cs]e( version)?( 2)?
php-3.01 | 4 | php | php licen[cs]e( version)?( 3 01| 3 0)?
ruby | 4 | ruby | ruby licen[cs]e
vim | 4 | vim | vim licen[cs]e
w3c | 4 | w3c | w3c software( notice and)? licen[cs]e
openssl | 4 | openssl | openssl licen[cs]e
postgresql | 4 | postgresql | postgresql licen[cs]e
qpl-1.0 | 4 | public | q public licen[cs]e( version)?( 1 0)?
afl-3.0 | 1 | spdx | spdx license identifier afl 3 0
afl-3.0 | 4 | academic | academic free licen[cs]e( version)?( 3 0)?
osl-3.0 | 1 | spdx | spdx license identifier osl 3 0
osl-3.0 | 4 | open | open software licen[cs]e( version)?( 3 0)?
beerware | 4 | beer | the beer ware licen[cs]e
json | 2 | evil | the software shall be used for good not evil
llama | 4 | llama | llama( [234])? community licen[cs]e( agreement)?
openrail | 2 | openrail | (licensed|released|distributed|available) under( the)? (creativeml |bigscience )?openrail( m)?
openrail | 4 | openrail | (creativeml )?openrail( m)?( licen[cs]e)?
ogl-uk | 4 | government | open government licen[cs]e( v?[123] 0)?
copyleft | 5 | copyleft | copyleft
proprietary | 2 | reproduced | no part of this (publication|book|work|document) may be reproduced
proprietary | 2 | confidential | proprietary and confidential
proprietary | 2 | prohibited | unauthori[sz]ed (copying|reproduction|distribution|use)( or distribution)? (of this file |of this work )?(is )?(strictly )?prohibited
proprietary | 4 | proprietary | proprietary licen[cs]e
proprietary | 4 | eula | (this )?eula
proprietary | 4 | user | end user licen[cs]e agreement
copyright | 4 | copyright | copyright( c)? (19|20)[0-9][0-9]( (19|20)[0-9][0-9])?
copyright | 5 | copyright | copyright (notice|holder|holders|owner|owners)
"""


def rules() -> list[tuple[str, int, str, str, bool]]:
    """Label, level, keyword, pattern over words that each have a space of their own on either side, and whether the contract names it."""
    out = []
    for text, base in ((BASE, True), (RULES, False)):
        for line in text.strip().splitlines():
            label, level, keyword, pattern = line.split(" | ")
            out.append((label, int(level), keyword, " (?:" + pattern.replace("(", "(?:").replace(" ", "  ") + ") ", base))
    return out
