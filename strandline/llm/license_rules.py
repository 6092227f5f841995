"""Signature rules for licences, in order of priority: an earlier rule wins over a later one inside it.

A line is `label | keyword | regular expression`. Rules are matched against lower-case words with one space between them
(signs other than letters and digits separate words, so `CC-BY 4.0` is `cc by 4 0`), and only whole words match. A keyword is a literal that every match
contains; texts without it are never given to the expression. A line in brackets opens a tier with the confidence of its rules.
Rules without a label are decoys: what they match is no licence, nor is anything inside it.
Expressions keep to what both Python's and SQL's matchers know: no look-around, no back references.
"""

from __future__ import annotations

from dataclasses import dataclass

RULES_TEXT = r"""
[0.0 decoys]
 | driv | driv(?:er s|ers|ing|er) licen[cs]es?
 | plate | licen[cs]e plates?(?: numbers?)?
 | marriage | marriage licen[cs]es?
 | tic licen | (?:poetic|artistic|dramatic) licen[cs]e
 | artistic lic | artistic licen[cs]e to
 | licen | (?:liquor|alcohol) licen[cs]es?
 | licen | (?:fishing|hunting|gun|firearms?) licen[cs]es?
 | pilot | pilot s? ?licen[cs]es?
 | medical lic | medical licen[cs]es?
 | taxi | taxi licen[cs]es?
 | tv licen | tv licen[cs]es?(?: fee)?
 | licen | licen[cs]e to (?:kill|drive|print money|practi[cs]e)
 | business lic | business licen[cs]es?
 | dog licen | dog licen[cs]es?
 | licen | licen[cs]e (?:key|keys|server|servers|number|numbers|holder|holders)
 | reserved seat | reserved seat(?:s|ing)?
[1.0 identifiers]
mit-0 | spdx | spdx license identifier mit 0
mit | spdx | spdx license identifier mit
apache-1.1 | spdx | spdx license identifier apache 1 1
apache-2.0 | spdx | spdx license identifier apache 2 0
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only)?
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only)?
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | spdx | spdx license identifier cddl 1 1
eupl-1.1 | spdx | spdx license identifier eupl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
artistic-2.0 | spdx | spdx license identifier artistic 2 0
bsl-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
zlib | spdx | spdx license identifier zlib
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | spdx | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | spdx | spdx license identifier cc by nc nd 4 0
ofl-1.1 | spdx | spdx license identifier ofl 1 1
odbl-1.0 | spdx | spdx license identifier odbl 1 0
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
postgresql | spdx | spdx license identifier postgresql
python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
ncsa | spdx | spdx license identifier ncsa
upl-1.0 | spdx | spdx license identifier upl 1 0
afl-3.0 | spdx | spdx license identifier afl 3 0
osl-3.0 | spdx | spdx license identifier osl 3 0
sspl-1.0 | spdx | spdx license identifier sspl 1 0
[0.95 notices and titles with versions]
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd (?:v|version )?4(?: 0)?
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd (?:v|version )?3(?: 0)?
cc-by-nc-nd-2.0 | cc by nc nd | cc by nc nd (?:v|version )?2(?: [05])?
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa (?:v|version )?4(?: 0)?
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa (?:v|version )?3(?: 0)?
cc-by-nc-sa-2.0 | cc by nc sa | cc by nc sa (?:v|version )?2(?: [05])?
cc-by-nc-4.0 | cc by nc | cc by nc (?:v|version )?4(?: 0)?
cc-by-nc-3.0 | cc by nc | cc by nc (?:v|version )?3(?: 0)?
cc-by-nc-2.0 | cc by nc | cc by nc (?:v|version )?2(?: [05])?
cc-by-nc-1.0 | cc by nc | cc by nc (?:v|version )?1(?: 0)?
cc-by-nd-4.0 | cc by nd | cc by nd (?:v|version )?4(?: 0)?
cc-by-nd-3.0 | cc by nd | cc by nd (?:v|version )?3(?: 0)?
cc-by-nd-2.0 | cc by nd | cc by nd (?:v|version )?2(?: [05])?
cc-by-sa-4.0 | cc by sa | cc by sa (?:v|version )?4(?: 0)?
cc-by-sa-3.0 | cc by sa | cc by sa (?:v|version )?3(?: 0)?
cc-by-sa-2.0 | cc by sa | cc by sa (?:v|version )?2(?: [05])?
cc-by-4.0 | cc by | cc by (?:v|version )?4(?: 0)?
cc-by-3.0 | cc by | cc by (?:v|version )?3(?: 0)?
cc-by-2.0 | cc by | cc by (?:v|version )?2(?: [05])?
cc-by-1.0 | cc by | cc by (?:v|version )?1(?: 0)?
cc0-1.0 | cc0 | cc0 (?:v|version )?1(?: 0)?(?: universal)?
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works) (?:v|version )?4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-nd-3.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works) (?:v|version )?3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike (?:v|version )?4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa-3.0 | creative commons | creative commons attribution non ?commercial share ?alike (?:v|version )?3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial (?:v|version )?4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-3.0 | creative commons | creative commons attribution non ?commercial (?:v|version )?3 0(?: unported)?(?: licen[cs]e)?
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:s|atives|ative works) (?:v|version )?4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike (?:v|version )?4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike (?:v|version )?3 0(?: unported)?(?: licen[cs]e)?
cc-by-4.0 | creative commons | creative commons attribution (?:v|version )?4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-3.0 | creative commons | creative commons attribution (?:v|version )?3 0(?: unported)?(?: licen[cs]e)?
cc-by-2.5 | creative commons | creative commons attribution (?:v|version )?2 5(?: generic)?(?: licen[cs]e)?
cc-by-2.0 | creative commons | creative commons attribution (?:v|version )?2 0(?: generic)?(?: licen[cs]e)?
cc0-1.0 | creative commons | creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 0 universal | 1 0 universal(?: cc0 1 0)? public domain dedication
agpl-3.0-or-later | affero | gnu affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?3(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e (?:v|version )?3(?: 0)?
agpl-1.0 | affero | (?:gnu )?affero general public licen[cs]e (?:v|version )?1(?: 0)?
lgpl-2.1-or-later | general public | (?:gnu )?(?:lesser|library) general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?2 1(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0-or-later | lesser | (?:gnu )?lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?3(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e (?:v|version )?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[cs]e (?:v|version )?3(?: 0)?
lgpl-2.0-or-later | library general | (?:gnu )?library general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?2(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
lgpl-2.0 | library general | (?:gnu )?library general public licen[cs]e (?:v|version )?2(?: 0)?
gpl-1.0-or-later | general public | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?1(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-or-later | general public | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?2(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later | general public | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?3(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
gpl-1.0 | general public | (?:gnu )?general public licen[cs]e (?:v|version )?1(?: 0)?
gpl-2.0 | general public | (?:gnu )?general public licen[cs]e (?:v|version )?2(?: 0)?(?: only)?
gpl-3.0 | general public | (?:gnu )?general public licen[cs]e (?:v|version )?3(?: 0)?(?: only)?
agpl-3.0-or-later | agpl | (?:gnu )?agpl ?(?:v|version )?3(?: 0)? or later
agpl-3.0 | agpl | (?:gnu )?agpl ?(?:v|version )?3(?: 0)?(?: only)?
lgpl-2.1-or-later | lgpl | (?:gnu )?lgpl ?(?:v|version )?2 1 or later
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?(?:v|version )?2 1(?: only)?
lgpl-2.0 | lgpl | (?:gnu )?lgpl ?(?:v|version )?2(?: 0)?(?: only)?
lgpl-3.0-or-later | lgpl | (?:gnu )?lgpl ?(?:v|version )?3(?: 0)? or later
lgpl-3.0 | lgpl | (?:gnu )?lgpl ?(?:v|version )?3(?: 0)?(?: only)?
gpl-2.0-or-later | gpl | (?:gnu )?gpl ?(?:v|version )?2(?: 0)? or later
gpl-2.0 | gpl | (?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: only)?
gpl-3.0-or-later | gpl | (?:gnu )?gpl ?(?:v|version )?3(?: 0)? or later
gpl-3.0 | gpl | (?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: only)?
gfdl-1.1 | free documentation | (?:gnu )?free documentation licen[cs]e (?:v|version )?1 1(?: or any later version)?
gfdl-1.2 | free documentation | (?:gnu )?free documentation licen[cs]e (?:v|version )?1 2(?: or any later version)?
gfdl-1.3 | free documentation | (?:gnu )?free documentation licen[cs]e (?:v|version )?1 3(?: or any later version)?
apache-2.0 | apache | apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?(?: the licen[cs]e)?
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:v|version )?1 1
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:v|version )?1(?: 0)?
apache-2.0 | apache | apache (?:v|version )?2(?: 0)?(?: licen[cs]ed?)?
apache-2.0 | asl | asl (?:v|version )?2(?: 0)?
apache-2.0 | org licenses license 2 | apache org licenses license 2 0(?: txt| html)?
bsd-4-clause | clause | (?:bsd (?:4|four)|(?:4|four)) clause (?:bsd )?licen[cs]e
bsd-3-clause | bsd 3 | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-2-clause | bsd 2 | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | bsd | (?:2|two) clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|modified|revised) bsd(?: licen[cs]e)?
bsd-2-clause | bsd | (?:simplified|freebsd) bsd(?: licen[cs]e)?
0bsd | bsd | (?:bsd zero clause|zero clause bsd|bsd 0 clause)(?: licen[cs]e)?
mpl-2.0 | mozilla | mozilla public licen[cs]e (?:v|version )?2(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:v|version )?1 1
mpl-1.0 | mozilla | mozilla public licen[cs]e (?:v|version )?1(?: 0)?
mpl-2.0 | mpl | mpl (?:v|version )?2(?: 0)?
mpl-1.1 | mpl | mpl (?:v|version )?1 1
epl-2.0 | eclipse | eclipse public licen[cs]e (?:v|version )?2(?: 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e (?:v|version )?1(?: 0)?
edl-1.0 | eclipse | eclipse distribution licen[cs]e (?:v|version )?1(?: 0)?
cddl-1.1 | common development | common development and distribution licen[cs]e(?: cddl)? (?:v|version )?1 1
cddl-1.0 | common development | common development and distribution licen[cs]e(?: cddl)? (?:v|version )?1(?: 0)?
cddl-1.0 | cddl | cddl (?:v|version )?1(?: 0)?
cpl-1.0 | common public | common public licen[cs]e (?:v|version )?1(?: 0)?
ipl-1.0 | ibm public | ibm public licen[cs]e (?:v|version )?1(?: 0)?
eupl-1.2 | european union public | european union public licen[cs]e (?:v|version )?1 2
eupl-1.1 | european union public | european union public licen[cs]e (?:v|version )?1 1
eupl-1.2 | eupl | eupl (?:v|version )?1 2
artistic-2.0 | artistic | artistic licen[cs]e (?:v|version )?2(?: 0)?
artistic-1.0 | artistic | artistic licen[cs]e (?:v|version )?1(?: 0)?
bsl-1.0 | boost | boost software licen[cs]e (?:v|version )?1(?: 0)?
busl-1.1 | business source | business source licen[cs]e (?:v|version )?1 1
sspl-1.0 | server side public | server side public licen[cs]e (?:v|version )?1(?: 0)?
elastic-2.0 | elastic | elastic licen[cs]e (?:v|version )?2(?: 0)?
ofl-1.1 | open font | (?:sil )?open font licen[cs]e (?:v|version )?1 1
ofl-1.0 | open font | (?:sil )?open font licen[cs]e (?:v|version )?1 0
odbl-1.0 | open data | open data commons open database licen[cs]e(?: odbl)?(?: v?1 0)?
odc-by-1.0 | open data | open data commons attribution licen[cs]e(?: odc by)?(?: v?1 0)?
pddl-1.0 | public domain dedication | open data commons public domain dedication and licen[cs]e(?: pddl)?(?: v?1 0)?
upl-1.0 | universal permissive | universal permissive licen[cs]e (?:v|version )?1(?: 0)?
afl-3.0 | academic free | academic free licen[cs]e (?:v|version )?3(?: 0)?
afl-2.1 | academic free | academic free licen[cs]e (?:v|version )?2 1
osl-3.0 | open software | open software licen[cs]e (?:v|version )?3(?: 0)?
lppl-1.3c | latex project | latex project public licen[cs]e (?:v|version )?1 3c?
php-3.01 | php | php licen[cs]e (?:v|version )?3 01
zpl-2.1 | zope | zope public licen[cs]e (?:v|version )?2 1
apsl-2.0 | apple public | apple public source licen[cs]e (?:v|version )?2(?: 0)?
cecill-2.1 | cecill | cecill(?: free software licen[cs]e)?(?: agreement)? (?:v|version )?2 1
cecill-c | cecill | cecill c(?: licen[cs]e)?
cecill-b | cecill | cecill b(?: licen[cs]e)?
mulanpsl-2.0 | mulan | mulan permissive software licen[cs]e (?:v|version )?2
ogl-uk-3.0 | open government | open government licen[cs]e (?:v|version )?3(?: 0)?
ogl-uk-2.0 | open government | open government licen[cs]e (?:v|version )?2(?: 0)?
openssl | openssl | dual openssl ssleay licen[cs]e|openssl licen[cs]e
llama2 | llama 2 | llama 2 community licen[cs]e(?: agreement)?
llama3 | llama 3 | llama 3(?: [123])? community licen[cs]e(?: agreement)?
openrail | rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)?
isc | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither the name | neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
zlib | altered source versions | altered source versions must be plainly marked as such
boost | boost | distributed under the boost software licen[cs]e
gpl | free software foundation | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation
warranty-disclaimer | without warranty of any kind | (?:the software is )?provided as is without warranty of any kind
warranty-disclaimer | without any warranty | (?:but )?without any warranty without even the implied warranty of merchantability(?: or fitness for a particular purpose)?
[0.8 titles without versions]
agpl | affero | (?:gnu )?affero general public licen[cs]e
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | library general | (?:gnu )?library general public licen[cs]e
gpl | general public | (?:gnu )?general public licen[cs]e
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e
gfdl | gfdl | gfdl
mit | mit lic | mit licen[cs]e(?:d)?
mit | mit | (?:x11|expat) mit(?: style)? licen[cs]e
mit | expat | expat licen[cs]e
x11 | x11 | x11 licen[cs]e
mit | opensource org licenses mit | opensource org licenses mit(?: licen[cs]e)?
apache | apache | apache (?:software )?licen[cs]e
bsd | bsd | bsd(?: style| like)? licen[cs]e(?:d)?
bsd | berkeley software | berkeley software distribution licen[cs]e
isc | isc | isc licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cddl | common development | common development and distribution licen[cs]e
eupl | european union public | european union public licen[cs]e
artistic | artistic | (?:perl )?artistic licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e
busl | business source | business source licen[cs]e
sspl | server side public | server side public licen[cs]e
ofl | open font | (?:sil )?open font licen[cs]e
odbl | open database | open database licen[cs]e
ogl-uk | open government | open government licen[cs]e
afl | academic free | academic free licen[cs]e
osl | open software | open software licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng | libpng licen[cs]e
python-2.0 | python software | python software foundation licen[cs]e(?: version 2)?
postgresql | postgresql | postgresql licen[cs]e
ruby | ruby | ruby licen[cs]e
perl | terms as perl | (?:under )?the same terms as perl(?: itself)?
php | php | php licen[cs]e
openssl | ssleay | ssleay licen[cs]e
ms-pl | microsoft public | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
cecill | cecill | cecill(?: free software)?(?: licen[cs]e)?
lppl | latex project | latex project public licen[cs]e
zpl | zope | zope public licen[cs]e
apsl | apple public | apple public source licen[cs]e
qpl | q public | q public licen[cs]e
sleepycat | sleepycat | sleepycat licen[cs]e
beerware | beer | beer ?ware(?: licen[cs]e)?
wtfpl | fuck you want | do what the fuck you want to public licen[cs]e
wtfpl | wtfpl | wtfpl
unlicense | unlicense | unlicense(?: org)?
json | software shall be used for good | the software shall be used for good not evil
commons-clause | commons clause | commons clause(?: licen[cs]e)?(?: condition)?
polyform-nc | polyform | polyform noncommercial licen[cs]e
polyform-sb | polyform | polyform small business licen[cs]e
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: licen[cs]e)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:s|atives|ative works)(?: licen[cs]e)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by | creative commons | creative commons attribution(?: licen[cs]e)?
cc | creative commons | creative commons(?: licen[cs]e)?
cc-by-nc-nd | org licenses by nc nd | creativecommons org licenses by nc nd
cc-by-nc-sa | org licenses by nc sa | creativecommons org licenses by nc sa
cc-by-nc | org licenses by nc | creativecommons org licenses by nc
cc-by-nd | org licenses by nd | creativecommons org licenses by nd
cc-by-sa | org licenses by sa | creativecommons org licenses by sa
cc-by | org licenses by | creativecommons org licenses by
cc0-1.0 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-sa | cc by sa | cc by sa
cc-by | cc by | cc by
cc0-1.0 | cc0 | cc0
[0.6 abbreviations and statements]
agpl | agpl | (?:gnu )?agpl
lgpl | lgpl | (?:gnu )?lgpl
gpl | gpl | (?:gnu )?gpl
public-domain | public domain | (?:is |are |been )?(?:released|placed|dedicated)? ?(?:in|into|to) the public domain
public-domain | public domain | public domain (?:dedication|mark|work|book|software)
public-domain | domaine public | (?:dans le|relève du|du) domaine public
public-domain | dominio | (?:de|del|en el) dominio público
public-domain | gemeinfrei | gemeinfrei
proprietary | proprietary | proprietary and confidential
proprietary | trade secret | contains (?:confidential information and )?trade secrets?
proprietary | unpublished | this is unpublished proprietary source code
proprietary | unauthori | unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:[^ ]+ ){0,8}strictly prohibited
proprietary | no part of this | no part of this (?:publication|book|work|document) may be reproduced
eula | end user | end user licen[cs]e agreement
eula | eula | eula
freeware | freeware | freeware
shareware | shareware | shareware
dual-license | dual lic | dual licen[cs]ed? under
non-commercial | non | for non ?commercial (?:use|purposes)(?: only)?
academic-use | only | for (?:academic|research|educational) (?:use|purposes) only
attribution | original author | with attribution to the original authors?
redistribution | free to | (?:you are )?free to (?:copy|share|use|modify|adapt) (?:and (?:re)?distribute )?(?:the|this) (?:material|software|work|program)
reserved | rechte vorbehalten | alle rechte vorbehalten
reserved | droits r | tous droits réservés
reserved | derechos reservados | (?:todos )?los derechos reservados|todos los derechos reservados
reserved | some rights reserved | some rights reserved
reserved | no rights reserved | no rights reserved
reserved | all rights reserved | all rights reserved
[0.4 hints]
license-statement | licen | (?:re)?(?:licen[cs]ed|distributed|released|published|provided|made available) under (?:the |an? )?(?:terms of )?(?:the )?(?:[^ ]+ ){1,4}licen[cs]e
license-statement | under licen | used under licen[cs]e(?: from)?
license-statement | licen | (?:see|read) (?:the )?(?:file )?licen[cs]e(?: file| txt| md)?(?: for (?:more )?details)?
license-statement | lizenz | (?:unter der|lizenziert unter) (?:[^ ]+ ){0,4}lizenz
license-statement | sous lic | (?:distribué|publié|diffusé)e? sous licence
license-statement | bajo l | (?:publicado|distribuido|licenciado) bajo (?:la )?licencia
open-source | open source | open source (?:licen[cs]e|software)
copyleft | copyleft | copyleft
copyright | copyright | (?:c )?copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright | copyright | copyright (?:holders?|owners?|notice)
"""


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    confidence: float


def parse(text: str) -> list[Rule]:
    """Rules of a table like RULES_TEXT, in its order. The expression is the rest of a line, | signs included."""
    rules, confidence = [], 0.0
    for line in filter(str.strip, text.splitlines()):
        if line.startswith("["):
            confidence = float(line[1:].split()[0])
            continue
        label, keyword, pattern = (x.strip() for x in line.split("|", 2))
        rules.append(Rule(label, keyword, pattern, confidence))
    return rules


RULES = parse(RULES_TEXT)
