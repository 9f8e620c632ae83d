"""Signature rules of the licence scan: `label | class | keywords | pattern`, one a line, in order.

Patterns are matched against a text's words in lower case with single spaces between them, at word boundaries. All of a
rule's keywords (license standing for licence too) are words of every match; only texts that have them are searched for the rule. Classes, best first:
0 a sentence of a licence's own text, 1 a notice that grants it or an SPDX tag, 2 a name with its version, 3 a name, 4 a hint.
"""

from __future__ import annotations

from dataclasses import dataclass

CONFIDENCE = (0.99, 0.95, 0.9, 0.7, 0.4)
#: Phrases whose places are always kept, whatever contains them.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RULES = r"""
cc-by | 3 | cc by | cc by
gpl | 3 | general public license | general public license
reserved | 4 | all rights reserved | all rights reserved

mit | 0 | permission hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 0 | sublicense sell copies | (?:to )?use copy modify merge publish distribute sublicense and or sell copies
mit | 0 | above copyright notice | the above copyright notice and this permission notice(?: \S+){0,3} shall be included in all copies
mit | 0 | noninfringement merchantability | warranties of merchantability fitness for a particular purpose and noninfringement
mit | 1 | mit license | (?:licensed|released|distributed|available|published|provided)(?: \S+){0,3} under(?: \S+){0,4} mit licen[cs]e
mit | 1 | spdx mit | spdx license identifier mit
mit | 2 | mit expat | mit expat licen[cs]e
mit | 3 | mit license | mit licen[cs]e
mit | 3 | expat license | expat licen[cs]e
mit | 3 | mit licensed | mit licensed
mit-0 | 2 | mit attribution | mit no attribution(?: licen[cs]e)?
mit-0 | 1 | spdx mit 0 | spdx license identifier mit 0
mit-modern | 2 | modern mit | mit modern variant
x11 | 3 | x11 license | x11 licen[cs]e
x11 | 1 | spdx x11 | spdx license identifier x11
isc | 0 | hereby permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 1 | isc under license | under(?: \S+){0,3} isc licen[cs]e
isc | 1 | spdx isc | spdx license identifier isc
isc | 3 | isc license | isc licen[cs]e
0bsd | 1 | spdx 0bsd | spdx license identifier 0bsd
0bsd | 2 | zero clause bsd | (?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?
0bsd | 3 | 0bsd | 0bsd
bsd-2-clause | 0 | redistributions conditions binary | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-2-clause | 1 | spdx bsd 2 | spdx license identifier bsd 2 clause
bsd-2-clause | 2 | bsd clause 2 | (?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd-2-clause | 2 | simplified bsd | simplified bsd licen[cs]e
bsd-2-clause | 2 | freebsd license | freebsd licen[cs]e
bsd-2-clause | 2 | two clause bsd | two clause bsd(?: licen[cs]e)?
bsd-3-clause | 0 | endorse promote products | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 1 | spdx bsd 3 | spdx license identifier bsd 3 clause
bsd-3-clause | 1 | bsd style governed | governed by a bsd style licen[cs]e
bsd-3-clause | 2 | bsd clause 3 | (?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-3-clause | 2 | modified bsd | modified bsd licen[cs]e
bsd-3-clause | 2 | new bsd | new bsd licen[cs]e
bsd-3-clause | 2 | revised bsd | revised bsd licen[cs]e
bsd-3-clause | 2 | three clause bsd | three clause bsd(?: licen[cs]e)?
bsd-3-clause-clear | 2 | clear bsd | clear bsd licen[cs]e
bsd-3-clause-clear | 1 | spdx bsd clear | spdx license identifier bsd 3 clause clear
bsd-4-clause | 0 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display
bsd-4-clause | 1 | spdx bsd 4 | spdx license identifier bsd 4 clause
bsd-4-clause | 2 | bsd clause 4 | (?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
bsd-4-clause | 2 | original bsd | original bsd licen[cs]e
bsd | 0 | redistribution source binary | redistribution and use in source and binary forms with or without modification are permitted
bsd | 1 | bsd under license | under(?: \S+){0,4} bsd(?: style)? licen[cs]e
bsd | 3 | bsd license | bsd(?: style)? licen[cs]e
bsd | 3 | bsd licensed | bsd licensed

apache-2.0 | 0 | apache compliance obtain | you may not use this (?:file|software|work) except in compliance with the license you may obtain a copy of the license at(?: \S+){0,6} apache
apache-2.0 | 1 | apache under license 2 | (?:licensed|released|distributed|available|published|provided)(?: \S+){0,3} under(?: \S+){0,3} apache licen[cs]e(?: version)? 2(?: 0)?
apache-2.0 | 1 | spdx apache 2 | spdx license identifier apache 2 0
apache-2.0 | 1 | apache licenses 2 | apache org licenses license 2 0(?: html| txt)?
apache-2.0 | 2 | apache license 2 | apache(?: software)? licen[cs]e (?:version |v )?2(?: 0)?
apache-2.0 | 2 | apache license v2 | apache(?: software)? licen[cs]e v2(?: 0)?
apache-2.0 | 2 | apache 2 0 | apache 2 0(?: licen[cs]ed?)?
apache-2.0 | 2 | asl 2 0 | asl 2 0
apache-1.1 | 1 | spdx apache 1 | spdx license identifier apache 1 1
apache-1.1 | 2 | apache license 1 1 | apache(?: software)? licen[cs]e (?:version )?1 1
apache-1.0 | 2 | apache license 1 0 | apache(?: software)? licen[cs]e (?:version )?1 0
apache | 3 | apache license | apache(?: software)?(?: foundation)? licen[cs]e
apache | 3 | apache licensed | apache licensed

gpl-2.0-or-later | 0 | gnu later redistribute | redistribute it and or modify it under the terms of the gnu general public license(?: \S+){0,8} either version 2 of the license or at your option any later version
gpl-2.0-or-later | 1 | spdx gpl 2 later | spdx license identifier gpl 2 0 or later
gpl-2.0-or-later | 2 | gpl later 2 | gpl (?:version |v )?2(?: 0)? or(?: any)? later(?: version)?
gpl-2.0-or-later | 2 | gplv2 later | gplv2 or(?: any)? later(?: version)?
gpl-2.0-or-later | 2 | general public license 2 later | (?:gnu )?general public license (?:version |v )?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-2.0 | 1 | spdx gpl 2 | spdx license identifier gpl 2 0(?: only)?
gpl-2.0 | 1 | gnu under general public license 2 | under(?: \S+){0,6} gnu general public license version 2
gpl-2.0 | 2 | general public license 2 | (?:gnu )?general public license (?:version |v )?2(?: 0)?
gpl-2.0 | 2 | general public license v2 | (?:gnu )?general public license v2(?: 0)?
gpl-2.0 | 2 | gpl 2 | gpl (?:version |v )?2(?: 0)?
gpl-2.0 | 2 | gplv2 | gplv2
gpl-3.0-or-later | 0 | gnu later redistribute 3 | redistribute it and or modify it under the terms of the gnu general public license(?: \S+){0,8} either version 3 of the license or at your option any later version
gpl-3.0-or-later | 1 | spdx gpl 3 later | spdx license identifier gpl 3 0 or later
gpl-3.0-or-later | 2 | gpl later 3 | gpl (?:version |v )?3(?: 0)? or(?: any)? later(?: version)?
gpl-3.0-or-later | 2 | gplv3 later | gplv3 or(?: any)? later(?: version)?
gpl-3.0-or-later | 2 | general public license 3 later | (?:gnu )?general public license (?:version |v )?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-3.0 | 1 | spdx gpl 3 | spdx license identifier gpl 3 0(?: only)?
gpl-3.0 | 1 | gnu under general public license 3 | (?:licensed |released |distributed )?under(?: \S+){0,6} gnu general public license version 3
gpl-3.0 | 2 | general public license 3 | (?:gnu )?general public license (?:version |v )?3(?: 0)?
gpl-3.0 | 2 | general public license v3 | (?:gnu )?general public license v3(?: 0)?
gpl-3.0 | 2 | gpl 3 | gpl (?:version |v )?3(?: 0)?
gpl-3.0 | 2 | gplv3 | gplv3
gpl-1.0 | 1 | spdx gpl 1 | spdx license identifier gpl 1 0(?: only| or later)?
gpl-1.0 | 2 | general public license 1 | (?:gnu )?general public license (?:version |v )?1(?: 0)?
gpl-exception | 2 | classpath exception | (?:gpl|general public license)(?: \S+){0,4} with(?: the)? classpath exception
gpl-exception | 2 | linking exception | (?:gpl|general public license)(?: \S+){0,4} with(?: a)? linking exception
gpl-exception | 2 | gcc runtime exception | gcc runtime library exception
gpl | 0 | gnu details | see the gnu general public license for more details
gpl | 3 | gnu gpl | gnu gpl
gpl | 3 | gnu public license | gnu public licen[cs]e
gpl | 3 | gpl licensed | gpl licensed
gpl | 3 | gpl license | gpl licen[cs]e
gpl | 3 | gpl under | under(?: the)? gpl
lgpl-2.0 | 2 | library general public license | (?:gnu )?library general public license(?: (?:version |v )?2(?: 0)?)?
lgpl-2.1-or-later | 1 | spdx lgpl 2 later | spdx license identifier lgpl 2 1 or later
lgpl-2.1-or-later | 2 | lesser general public license 2 later | (?:gnu )?lesser general public license (?:version |v )?2 1 or(?: at your option)?(?: any)? later(?: version)?
lgpl-2.1 | 1 | spdx lgpl 2 | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1 | 2 | lesser general public license 2 1 | (?:gnu )?lesser general public license (?:version |v )?2 1
lgpl-2.1 | 2 | lgpl 2 | lgpl (?:version |v )?2(?: 1)?
lgpl-2.1 | 2 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0-or-later | 1 | spdx lgpl 3 later | spdx license identifier lgpl 3 0 or later
lgpl-3.0 | 1 | spdx lgpl 3 | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0 | 2 | lesser general public license 3 | (?:gnu )?lesser general public license (?:version |v )?3(?: 0)?
lgpl-3.0 | 2 | lgpl 3 | lgpl (?:version |v )?3(?: 0)?
lgpl-3.0 | 2 | lgplv3 | lgplv3
lgpl | 3 | lesser general public license | (?:gnu )?lesser general public licen[cs]e
lgpl | 3 | gnu lgpl | gnu lgpl
lgpl | 3 | lgpl license | lgpl licen[cs]e
agpl-3.0-or-later | 1 | spdx agpl later | spdx license identifier agpl 3 0 or later
agpl-3.0 | 0 | affero details | see the gnu affero general public license for more details
agpl-3.0 | 1 | spdx agpl 3 | spdx license identifier agpl 3 0(?: only)?
agpl-3.0 | 2 | affero general public license 3 | (?:gnu )?affero general public license (?:version |v )?3(?: 0)?
agpl-3.0 | 2 | agpl 3 | agpl (?:version |v )?3(?: 0)?
agpl-3.0 | 2 | agplv3 | agplv3
agpl | 3 | affero general public license | (?:gnu )?affero general public licen[cs]e
agpl | 3 | agpl license | agpl licen[cs]e
gfdl-1.3 | 2 | free documentation license 1 3 | free documentation licen[cs]e (?:version |v )?1 3
gfdl-1.2 | 2 | free documentation license 1 2 | free documentation licen[cs]e (?:version |v )?1 2
gfdl | 0 | invariant cover texts | with no invariant sections no front cover texts and no back cover texts
gfdl | 3 | free documentation license | (?:gnu )?free documentation licen[cs]e
gfdl | 3 | gfdl | gfdl

cc0-1.0 | 0 | waived copyright related neighboring | waived all copyright and related or neighboring rights
cc0-1.0 | 1 | spdx cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 1 | creativecommons publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 2 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 2 | creative commons zero | creative commons(?: cc)? zero(?: 1 0)?(?: universal)?
cc-by-nc-nd | 1 | creativecommons nc nd | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd | 1 | spdx cc nc nd | spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd | 2 | cc by nc nd | cc by nc nd(?: [1-4](?: [05])?)?
cc-by-nc-nd | 2 | attribution noncommercial noderivatives | attribution noncommercial noderivatives(?: works)?(?: [1-4](?: [05])?)?
cc-by-nc-nd | 2 | attribution noncommercial noderivs | attribution noncommercial noderivs(?: [1-4](?: [05])?)?
cc-by-nc-sa | 1 | creativecommons nc sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa | 1 | spdx cc nc sa | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa | 2 | cc by nc sa | cc by nc sa(?: [1-4](?: [05])?)?
cc-by-nc-sa | 2 | attribution noncommercial sharealike | attribution noncommercial sharealike(?: [1-4](?: [05])?)?
cc-by-nc-sa | 2 | attribution non commercial share alike | attribution non commercial share alike(?: [1-4](?: [05])?)?
cc-by-nc | 1 | creativecommons by nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nc | 1 | spdx cc by nc | spdx license identifier cc by nc [1-4] [05]
cc-by-nc | 1 | cc by nc licensed | licensed under(?: a)?(?: \S+){0,3} cc by nc(?: [1-4](?: [05])?)?
cc-by-nc | 2 | cc by nc | cc by nc(?: [1-4](?: [05])?)?
cc-by-nc | 2 | attribution noncommercial | attribution noncommercial(?: [1-4](?: [05])?)?
cc-by-nc | 2 | attribution non commercial | attribution non commercial(?: [1-4](?: [05])?)?
cc-by-nd | 1 | creativecommons by nd | creativecommons org licenses by nd [1-4] [05]
cc-by-nd | 1 | spdx cc by nd | spdx license identifier cc by nd [1-4] [05]
cc-by-nd | 2 | cc by nd | cc by nd(?: [1-4](?: [05])?)?
cc-by-nd | 2 | attribution noderivatives | attribution noderivatives(?: [1-4](?: [05])?)?
cc-by-nd | 2 | attribution noderivs | attribution noderivs(?: [1-4](?: [05])?)?
cc-by-sa | 1 | creativecommons by sa | creativecommons org licenses by sa [1-4] [05]
cc-by-sa | 1 | spdx cc by sa | spdx license identifier cc by sa [1-4] [05]
cc-by-sa | 2 | cc by sa | cc by sa(?: [1-4](?: [05])?)?
cc-by-sa | 2 | attribution sharealike | attribution sharealike(?: [1-4](?: [05])?)?
cc-by-sa | 2 | attribution share alike | attribution share alike(?: [1-4](?: [05])?)?
cc-by | 1 | creativecommons by | creativecommons org licenses by [1-4] [05]
cc-by | 1 | spdx cc by | spdx license identifier cc by [1-4] [05]
cc-by | 2 | creative commons attribution | creative commons attribution(?: licen[cs]e)?(?: [1-4](?: [05])?)?(?: international| unported)?
cc-by | 2 | cc by 4 | cc by 4(?: 0)?
cc-by | 2 | cc by 3 | cc by 3(?: 0)?
cc-by | 2 | cc by 2 | cc by 2(?: [05])?
cc-pdm | 1 | creativecommons publicdomain mark | creativecommons org publicdomain mark 1 0
cc-pdm | 2 | public domain mark | public domain mark(?: 1 0)?
creative-commons | 3 | creative commons license | creative commons licen[cs]e
creative-commons | 3 | creative commons licensed | creative commons licensed
creative-commons | 4 | creative commons | creative commons

mpl-2.0 | 0 | mozilla source subject | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-2.0 | 1 | spdx mpl 2 | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2.0 | 2 | mozilla public license 2 | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-2.0 | 2 | mpl 2 | mpl (?:version |v )?2(?: 0)?
mpl-1.1 | 1 | spdx mpl 1 | spdx license identifier mpl 1 1
mpl-1.1 | 2 | mozilla public license 1 | mozilla public licen[cs]e (?:version |v )?1 1
mpl | 3 | mozilla public license | mozilla public licen[cs]e
epl-2.0 | 1 | spdx epl 2 | spdx license identifier epl 2 0
epl-2.0 | 2 | eclipse public license 2 | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-2.0 | 2 | epl 2 | epl (?:version |v )?2(?: 0)?
epl-1.0 | 1 | spdx epl 1 | spdx license identifier epl 1 0
epl-1.0 | 2 | eclipse public license 1 | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl | 3 | eclipse public license | eclipse public licen[cs]e
edl-1.0 | 2 | eclipse distribution license | eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?
cddl-1.1 | 2 | common development distribution license 1 1 | common development and distribution licen[cs]e (?:version )?1 1
cddl-1.0 | 1 | spdx cddl | spdx license identifier cddl 1 0
cddl-1.0 | 2 | common development distribution license 1 0 | common development and distribution licen[cs]e (?:version )?1 0
cddl | 3 | common development distribution license | common development and distribution licen[cs]e
cddl | 3 | cddl | cddl
cpl-1.0 | 2 | common public license | common public licen[cs]e(?: (?:version |v )?1 0)?
ipl-1.0 | 2 | ibm public license | ibm public licen[cs]e(?: (?:version |v )?1 0)?
eupl-1.2 | 1 | spdx eupl | spdx license identifier eupl 1 2
eupl-1.2 | 2 | eupl 1 2 | eupl (?:version |v )?1 2
eupl | 3 | european union public license | european union public licen[cs]e
eupl | 3 | eupl | eupl
cecill-2.1 | 2 | cecill 2 | cecill(?: free software licen[cs]e)?(?: agreement)? (?:version |v )?2(?: 1)?
cecill-b | 2 | cecill b | cecill b
cecill-c | 2 | cecill c | cecill c
cecill | 3 | cecill | cecill
artistic-2.0 | 1 | spdx artistic | spdx license identifier artistic 2 0
artistic-2.0 | 2 | artistic license 2 | artistic licen[cs]e (?:version |v )?2(?: 0)?
artistic-1.0 | 2 | artistic license 1 | artistic licen[cs]e (?:version |v )?1(?: 0)?
artistic | 3 | artistic license | artistic licen[cs]e
perl | 1 | same terms perl | under the same terms as perl(?: itself)?
boost-1.0 | 0 | boost distributed | distributed under the boost software license version 1 0
boost-1.0 | 1 | spdx bsl 1 | spdx license identifier bsl 1 0
boost-1.0 | 2 | boost software license | boost software licen[cs]e(?: (?:version |v )?1(?: 0)?)?
busl-1.1 | 1 | spdx busl | spdx license identifier busl 1 1
busl-1.1 | 2 | business source license | business source licen[cs]e(?: (?:version |v )?1 1)?
sspl-1.0 | 1 | spdx sspl | spdx license identifier sspl 1 0
sspl-1.0 | 2 | server side public license | server side public licen[cs]e(?: (?:version |v )?1)?
elastic-2.0 | 1 | spdx elastic | spdx license identifier elastic 2 0
elastic-2.0 | 2 | elastic license | elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?
commons-clause | 2 | commons clause | commons clause(?: licen[cs]e)?(?: condition)?
polyform | 2 | polyform noncommercial | polyform noncommercial(?: licen[cs]e)?(?: 1 0 0)?
polyform | 2 | polyform small business | polyform small business(?: licen[cs]e)?(?: 1 0 0)?
polyform | 3 | polyform | polyform
prosperity | 2 | prosperity public license | prosperity public licen[cs]e(?: 3 0 0)?
parity | 2 | parity public license | parity public licen[cs]e(?: 7 0 0)?
unlicense | 0 | unencumbered public domain | this is free and unencumbered software released into the public domain
unlicense | 1 | spdx unlicense | spdx license identifier unlicense
unlicense | 3 | unlicense | unlicense
wtfpl | 2 | do what public license | do what the (?:fuck|f) you want to public licen[cs]e(?: version 2)?
wtfpl | 3 | wtfpl | wtfpl
zlib | 0 | misrepresented origin | the origin of this software must not be misrepresented
zlib | 0 | altered plainly marked | altered source versions must be plainly marked as such
zlib | 1 | spdx zlib | spdx license identifier zlib
zlib | 2 | zlib libpng | zlib libpng licen[cs]e
zlib | 3 | zlib license | zlib licen[cs]e
libpng | 3 | libpng license | libpng licen[cs]e(?: version 2)?
bzip2 | 2 | bzip2 license | bzip2(?: and libbzip2)? licen[cs]e
openssl | 0 | openssl toolkit includes | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 3 | openssl license | openssl licen[cs]e
curl | 2 | curl license | curl licen[cs]e
python-2.0 | 1 | spdx python | spdx license identifier python 2 0
python-2.0 | 2 | python software foundation license | python software foundation licen[cs]e(?: version 2)?
python-2.0 | 2 | psf license | psf licen[cs]e(?: version 2)?
php-3.01 | 2 | php license 3 | php licen[cs]e (?:version |v )?3(?: 01)?
php | 3 | php license | php licen[cs]e
ruby | 2 | ruby license | ruby licen[cs]e
postgresql | 0 | written agreement granted | without a written agreement is hereby granted provided that the above copyright notice
postgresql | 2 | postgresql license | postgresql licen[cs]e
ncsa | 2 | illinois ncsa | university of illinois ncsa open source licen[cs]e
ncsa | 3 | ncsa license | ncsa(?: open source)? licen[cs]e
w3c | 2 | w3c notice | w3c software(?: and document)? notice and license
w3c | 3 | w3c license | w3c(?: software)? licen[cs]e
unicode | 2 | unicode license | unicode(?: dfs)?(?: 2016)? licen[cs]e(?: agreement)?
icu | 3 | icu license | icu licen[cs]e
ftl | 2 | freetype license | freetype(?: project)? licen[cs]e
ijg | 2 | independent jpeg group | this software is based in part on the work of the independent jpeg group
imagemagick | 2 | imagemagick license | imagemagick licen[cs]e
afl-3.0 | 2 | academic free license | academic free licen[cs]e(?: (?:version |v )?[123] [01])?
osl-3.0 | 2 | open software license | open software licen[cs]e(?: (?:version |v )?[123] [01])?
ecl-2.0 | 2 | educational community license | educational community licen[cs]e(?: (?:version |v )?2 0)?
ms-pl | 2 | microsoft public license | microsoft public licen[cs]e
ms-rl | 2 | microsoft reciprocal license | microsoft reciprocal licen[cs]e
apsl-2.0 | 2 | apple public source license | apple public source licen[cs]e(?: (?:version |v )?2 0)?
qpl-1.0 | 2 | q public license | q public licen[cs]e(?: (?:version |v )?1 0)?
sleepycat | 3 | sleepycat license | sleepycat licen[cs]e
vim | 3 | vim license | vim licen[cs]e
upl-1.0 | 2 | universal permissive license | universal permissive licen[cs]e(?: (?:version |v )?1 0)?
blueoak-1.0 | 2 | blue oak model | blue oak model licen[cs]e(?: 1 0 0)?
mulan-2.0 | 2 | mulan psl | mulan psl(?: v2| 2)?
ofl-1.1 | 0 | reserved font name | with reserved font name
ofl-1.1 | 1 | spdx ofl | spdx license identifier ofl 1 1
ofl-1.1 | 2 | sil open font license | sil open font licen[cs]e(?: (?:version |v )?1 1)?
ofl-1.1 | 3 | open font license | open font licen[cs]e
odbl-1.0 | 1 | spdx odbl | spdx license identifier odbl 1 0
odbl-1.0 | 2 | open database license | open database licen[cs]e(?: odbl)?(?: (?:version |v )?1 0)?
odbl-1.0 | 3 | odbl | odbl
odc-by-1.0 | 2 | open data commons attribution | open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?
pddl-1.0 | 2 | public domain dedication license | public domain dedication and licen[cs]e
cdla-permissive | 2 | community data license permissive | community data licen[cs]e agreement permissive(?: (?:version )?[12] 0)?
cdla-sharing | 2 | community data license sharing | community data licen[cs]e agreement sharing(?: (?:version )?1 0)?
ogl-uk-3.0 | 2 | open government license 3 | open government licen[cs]e (?:version |v )?3(?: 0)?
ogl-uk-3.0 | 2 | open government license v3 | open government licen[cs]e v3(?: 0)?
ogl | 3 | open government license | open government licen[cs]e
openrail | 2 | creativeml | creativeml open ?rail(?: plus plus)? m(?: licen[cs]e)?
openrail | 2 | bigscience | bigscience (?:open ?)?rail m?(?: licen[cs]e)?
openrail | 3 | openrail | openrail(?: m)?(?: licen[cs]e)?
llama | 2 | llama community license | llama [234](?: [1-3])? community licen[cs]e(?: agreement)?
gemma | 3 | gemma terms use | gemma terms of use
cern-ohl | 2 | cern open hardware license | cern open hardware licen[cs]e(?: version 2)?(?: permissive| strongly reciprocal| weakly reciprocal)?
tapr-ohl | 2 | tapr open hardware license | tapr open hardware licen[cs]e
beerware | 0 | buy beer return | you can buy me a beer in return
beerware | 3 | beerware | beerware(?: licen[cs]e)?
json | 0 | good evil software | the software shall be used for good not evil

public-domain | 1 | public domain | (?:dedicated|released|placed)(?: \S+){0,3} (?:to|into|in) the public domain
public-domain | 2 | government work public domain | work of the (?:u s|us|united states) government(?: \S+){0,8} public domain
public-domain | 3 | public domain | in the public domain
no-known-copyright | 2 | no known copyright | no known copyright restrictions
no-redistribution | 1 | may reproduced permission | no part of this (?:publication|book|work|document) may be reproduced(?: \S+){0,20} permission
no-redistribution | 1 | prohibited | (?:unauthorized |unauthorised )?(?:reproduction|redistribution|copying)(?: or (?:distribution|redistribution))?(?: \S+){0,4} (?:is )?(?:strictly )?prohibited
no-redistribution | 2 | not redistribute | do not (?:copy or )?redistribute
proprietary | 1 | proprietary confidential | proprietary and confidential
proprietary | 1 | confidential proprietary | confidential and proprietary
proprietary | 2 | contains trade | contains trade secrets?
proprietary | 3 | proprietary license | proprietary licen[cs]e
proprietary | 3 | end user license agreement | end user licen[cs]e agreement
proprietary | 3 | eula | eula
non-commercial | 2 | non commercial only | for non commercial(?: use)? only
non-commercial | 2 | noncommercial only | for noncommercial(?: use)? only
non-commercial | 2 | personal use only | for personal(?: and non commercial| and noncommercial)? use only
research-only | 2 | research only | for (?:academic |scientific )?research(?: purposes)? only
research-only | 2 | academic use only | for academic use only
reserved | 2 | rechte vorbehalten | alle rechte vorbehalten
reserved | 2 | droits réservés | tous droits réservés
reserved | 2 | derechos reservados | todos los derechos reservados
reserved | 3 | some rights reserved | some rights reserved
reserved | 3 | no rights reserved | no rights reserved
copyright | 3 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*
copyright | 4 | copyright by | copyright by
copyright | 4 | copyright | copyright holders?
copyright | 4 | copyrighted | copyrighted (?:material|work|works|by)
license-reference | 3 | see license file | see(?: the)? licen[cs]e file
license-reference | 3 | license file details | licen[cs]e file for(?: more)? details
license-reference | 3 | license found file | license that can be found in the license file
license-reference | 3 | open source license | open source licen[cs]e
license-reference | 4 | under license | (?:licensed|released|distributed) under(?: \S+){0,4} licen[cs]e
license-reference | 4 | licensed under | licensed under
license-reference | 4 | spdx license identifier | spdx license identifier(?: \S+){1,4}
"""


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.rank]


def parse(lines: str = RULES, base: dict[str, str] = BASE) -> list[Rule]:
    """The rules of a text of lines, in order; those of `base` phrases are marked."""
    out = []
    for line in filter(None, map(str.strip, lines.splitlines())):
        label, rank, keywords, pattern = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, int(rank), tuple(keywords.split()), pattern, base.get(pattern) == label))
    return out
