"""The signature rules of license detection, written by hand.

One rule a line: label, keyword, priority, confidence, regular expression. They run
on lower-cased text, from the beginning of a word to the end of one. A blank in an
expression stands for whatever lies between two words. The keyword is a part of every
match; a rule runs only where its keyword occurs. Of equal priority, the longer match
counts, then the earlier rule.
"""

RULES = r"""
# SPDX lines with a version
gpl-2.0 | spdx | 100 | 0.99 | spdx license identifier gpl-2\.0(?:-only|-or-later|\+)?
gpl-3.0 | spdx | 100 | 0.99 | spdx license identifier gpl-3\.0(?:-only|-or-later|\+)?
gpl-1.0 | spdx | 100 | 0.99 | spdx license identifier gpl-1\.0(?:-only|-or-later|\+)?
lgpl-2.0 | spdx | 100 | 0.99 | spdx license identifier lgpl-2\.0(?:-only|-or-later|\+)?
lgpl-2.1 | spdx | 100 | 0.99 | spdx license identifier lgpl-2\.1(?:-only|-or-later|\+)?
lgpl-3.0 | spdx | 100 | 0.99 | spdx license identifier lgpl-3\.0(?:-only|-or-later|\+)?
agpl-3.0 | spdx | 100 | 0.99 | spdx license identifier agpl-3\.0(?:-only|-or-later|\+)?
apache-1.1 | spdx | 100 | 0.99 | spdx license identifier apache-1\.1
apache-2.0 | spdx | 100 | 0.99 | spdx license identifier apache-2\.0
mpl-1.1 | spdx | 100 | 0.99 | spdx license identifier mpl-1\.1
mpl-2.0 | spdx | 100 | 0.99 | spdx license identifier mpl-2\.0(?:-no-copyleft-exception)?
epl-1.0 | spdx | 100 | 0.99 | spdx license identifier epl-1\.0
epl-2.0 | spdx | 100 | 0.99 | spdx license identifier epl-2\.0
eupl-1.1 | spdx | 100 | 0.99 | spdx license identifier eupl-1\.1
eupl-1.2 | spdx | 100 | 0.99 | spdx license identifier eupl-1\.2
cddl-1.0 | spdx | 100 | 0.99 | spdx license identifier cddl-1\.0
cddl-1.1 | spdx | 100 | 0.99 | spdx license identifier cddl-1\.1
artistic-1.0 | spdx | 100 | 0.99 | spdx license identifier artistic-1\.0(?:-perl|-cl8)?
artistic-2.0 | spdx | 100 | 0.99 | spdx license identifier artistic-2\.0
boost-1.0 | spdx | 100 | 0.99 | spdx license identifier bsl-1\.0
busl-1.1 | spdx | 100 | 0.99 | spdx license identifier busl-1\.1
sspl-1.0 | spdx | 100 | 0.99 | spdx license identifier sspl-1\.0
ofl-1.1 | spdx | 100 | 0.99 | spdx license identifier ofl-1\.1(?:-rfn|-no-rfn)?
python-2.0 | spdx | 100 | 0.99 | spdx license identifier (?:psf|python)-2\.0
cc0-1.0 | spdx | 100 | 0.99 | spdx license identifier cc0-1\.0
cc-by-3.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-3\.0
cc-by-4.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-4\.0
cc-by-sa-3.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-sa-3\.0
cc-by-sa-4.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-sa-4\.0
cc-by-nc-4.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-nc-4\.0
cc-by-nd-4.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-nd-4\.0
cc-by-nc-sa-4.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-nc-sa-4\.0
cc-by-nc-nd-4.0 | spdx | 100 | 0.99 | spdx license identifier cc-by-nc-nd-4\.0
odbl-1.0 | spdx | 100 | 0.99 | spdx license identifier odbl-1\.0
gfdl-1.3 | spdx | 100 | 0.99 | spdx license identifier gfdl-1\.3(?:-only|-or-later)?
ecl-2.0 | spdx | 100 | 0.99 | spdx license identifier ecl-2\.0
afl-3.0 | spdx | 100 | 0.99 | spdx license identifier afl-3\.0
osl-3.0 | spdx | 100 | 0.99 | spdx license identifier osl-3\.0
# SPDX lines without one
mit | spdx | 95 | 0.98 | spdx license identifier mit
mit-0 | spdx | 97 | 0.98 | spdx license identifier mit-0
bsd-2-clause | spdx | 97 | 0.98 | spdx license identifier bsd-2-clause(?:-patent|-views)?
bsd-3-clause | spdx | 97 | 0.98 | spdx license identifier bsd-3-clause(?:-clear|-lbnl)?
bsd-4-clause | spdx | 97 | 0.98 | spdx license identifier bsd-4-clause(?:-uc)?
0bsd | spdx | 97 | 0.98 | spdx license identifier 0bsd
isc | spdx | 95 | 0.98 | spdx license identifier isc
zlib | spdx | 95 | 0.98 | spdx license identifier zlib
ms-pl | spdx | 95 | 0.98 | spdx license identifier ms-pl
ms-rl | spdx | 95 | 0.98 | spdx license identifier ms-rl
ncsa | spdx | 95 | 0.98 | spdx license identifier ncsa
unlicense | spdx | 95 | 0.98 | spdx license identifier unlicense
wtfpl | spdx | 95 | 0.98 | spdx license identifier wtfpl
postgresql | spdx | 95 | 0.98 | spdx license identifier postgresql
openssl | spdx | 95 | 0.98 | spdx license identifier openssl
ruby | spdx | 95 | 0.98 | spdx license identifier ruby
proprietary | spdx | 95 | 0.97 | spdx license identifier licenseref-(?:proprietary|commercial)
gpl | spdx | 90 | 0.95 | spdx license identifier gpl
lgpl | spdx | 90 | 0.95 | spdx license identifier lgpl
agpl | spdx | 90 | 0.95 | spdx license identifier agpl
apache | spdx | 90 | 0.95 | spdx license identifier apache
bsd | spdx | 90 | 0.95 | spdx license identifier bsd
# Names with a version
apache-2.0 | apache | 80 | 0.96 | apache(?: software)? licen[sc]e,? (?:version |ver |v)?2(?:\.0)?
apache-2.0 | apache | 79 | 0.95 | apache[ -]?v?2\.0
apache-1.1 | apache | 80 | 0.96 | apache(?: software)? licen[sc]e (?:version |ver |v)?1\.1
apache-1.0 | apache | 80 | 0.95 | apache(?: software)? licen[sc]e (?:version |ver |v)?1\.0
gpl-1.0 | general | 80 | 0.95 | gnu general public licen[sc]e (?:version |ver |v)?1(?:\.0)?
gpl-2.0 | general | 80 | 0.96 | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |ver |v)?2(?:\.0)?
gpl-3.0 | general | 80 | 0.96 | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |ver |v)?3(?:\.0)?
gpl-2.0 | gpl | 78 | 0.93 | (?:gnu )?gpl[ -]?(?:version |ver |v)?2(?:\.0)?(?:-only|-or-later|\+)?
gpl-3.0 | gpl | 78 | 0.93 | (?:gnu )?gpl[ -]?(?:version |ver |v)?3(?:\.0)?(?:-only|-or-later|\+)?
lgpl-2.0 | library | 81 | 0.96 | gnu library general public licen[sc]e (?:version |ver |v)?2(?:\.0)?
lgpl-2.1 | lesser | 81 | 0.96 | gnu lesser general public licen[sc]e (?:version |ver |v)?2\.1
lgpl-3.0 | lesser | 81 | 0.96 | gnu lesser general public licen[sc]e (?:version |ver |v)?3(?:\.0)?
lgpl-2.1 | lgpl | 79 | 0.93 | (?:gnu )?lgpl[ -]?(?:version |ver |v)?2\.1(?:-only|-or-later|\+)?
lgpl-3.0 | lgpl | 79 | 0.93 | (?:gnu )?lgpl[ -]?(?:version |ver |v)?3(?:\.0)?(?:-only|-or-later|\+)?
agpl-1.0 | affero | 81 | 0.95 | affero general public licen[sc]e (?:version |ver |v)?1(?:\.0)?
agpl-3.0 | affero | 81 | 0.96 | (?:gnu )?affero general public licen[sc]e (?:version |ver |v)?3(?:\.0)?
agpl-3.0 | agpl | 79 | 0.93 | (?:gnu )?agpl[ -]?(?:version |ver |v)?3(?:\.0)?(?:-only|-or-later|\+)?
mpl-1.0 | mozilla | 80 | 0.95 | mozilla public licen[sc]e (?:version |ver |v)?1\.0
mpl-1.1 | mozilla | 80 | 0.96 | mozilla public licen[sc]e (?:version |ver |v)?1\.1
mpl-2.0 | mozilla | 80 | 0.96 | mozilla public licen[sc]e (?:version |ver |v)?2(?:\.0)?
mpl-2.0 | mpl | 78 | 0.93 | mpl[ -]?v?2(?:\.0)?
mpl-1.1 | mpl | 78 | 0.93 | mpl[ -]?v?1\.1
epl-1.0 | eclipse | 80 | 0.96 | eclipse public licen[sc]e (?:version |ver |v)?1(?:\.0)?
epl-2.0 | eclipse | 80 | 0.96 | eclipse public licen[sc]e (?:version |ver |v)?2(?:\.0)?
epl-2.0 | epl | 78 | 0.9 | epl[ -]?v?2(?:\.0)?
eupl-1.1 | european | 80 | 0.96 | european union public licen[sc]e (?:version |ver |v)?1\.1
eupl-1.2 | european | 80 | 0.96 | european union public licen[sc]e (?:version |ver |v)?1\.2
eupl-1.2 | eupl | 78 | 0.93 | eupl[ -]?v?1\.2
cddl-1.0 | common | 80 | 0.96 | common development and distribution licen[sc]e (?:cddl )?(?:version |ver |v)?1(?:\.0)?
cddl-1.1 | common | 80 | 0.96 | common development and distribution licen[sc]e (?:cddl )?(?:version |ver |v)?1\.1
cddl-1.0 | cddl | 78 | 0.93 | cddl[ -]?(?:version |v)?1\.0
artistic-1.0 | artistic | 80 | 0.95 | (?:perl )?artistic licen[sc]e (?:version |ver |v)?1(?:\.0)?
artistic-2.0 | artistic | 80 | 0.96 | artistic licen[sc]e (?:version |ver |v)?2(?:\.0)?
boost-1.0 | boost | 80 | 0.96 | boost software licen[sc]e (?:version |ver |v)?1(?:\.0)?
busl-1.1 | business | 80 | 0.95 | business source licen[sc]e (?:version |ver |v)?1\.1
sspl-1.0 | server | 80 | 0.95 | server side public licen[sc]e (?:version |ver |v)?1(?:\.0)?
python-2.0 | python | 80 | 0.95 | python software foundation licen[sc]e (?:version |ver |v)?2(?:\.0)?
ofl-1.0 | open | 80 | 0.95 | (?:sil )?open font licen[sc]e (?:version |ver |v)?1\.0
ofl-1.1 | open | 80 | 0.96 | (?:sil )?open font licen[sc]e (?:version |ver |v)?1\.1
apsl-1.2 | apple | 80 | 0.95 | apple public source licen[sc]e (?:version |ver |v)?1\.2
apsl-2.0 | apple | 80 | 0.95 | apple public source licen[sc]e (?:version |ver |v)?2(?:\.0)?
gfdl-1.1 | documentation | 80 | 0.95 | gnu free documentation licen[sc]e (?:version |ver |v)?1\.1
gfdl-1.2 | documentation | 80 | 0.95 | gnu free documentation licen[sc]e (?:version |ver |v)?1\.2
gfdl-1.3 | documentation | 80 | 0.96 | gnu free documentation licen[sc]e (?:version |ver |v)?1\.3
cc0-1.0 | cc0 | 82 | 0.96 | cc0[ -]1\.0(?: universal)?
cc-by-2.0 | attribution | 80 | 0.95 | creative commons attribution 2\.0
cc-by-2.5 | attribution | 80 | 0.95 | creative commons attribution 2\.5
cc-by-3.0 | attribution | 80 | 0.96 | creative commons attribution 3\.0
cc-by-4.0 | attribution | 80 | 0.96 | creative commons attribution 4\.0
cc-by-sa-3.0 | attribution | 82 | 0.96 | creative commons attribution share ?alike 3\.0
cc-by-sa-4.0 | attribution | 82 | 0.96 | creative commons attribution share ?alike 4\.0
cc-by-nd-4.0 | attribution | 82 | 0.96 | creative commons attribution no ?derivatives 4\.0
cc-by-nc-4.0 | attribution | 82 | 0.96 | creative commons attribution non ?commercial 4\.0
cc-by-nc-sa-4.0 | attribution | 83 | 0.96 | creative commons attribution non ?commercial share ?alike 4\.0
cc-by-nc-nd-4.0 | attribution | 83 | 0.96 | creative commons attribution non ?commercial no ?derivatives 4\.0
cc-by-4.0 | by | 78 | 0.93 | cc[ -]by[ -]4\.0
cc-by-3.0 | by | 78 | 0.93 | cc[ -]by[ -]3\.0
cc-by-sa-4.0 | by | 79 | 0.94 | cc[ -]by[ -]sa[ -]4\.0
cc-by-sa-3.0 | by | 79 | 0.94 | cc[ -]by[ -]sa[ -]3\.0
cc-by-nc-4.0 | by | 79 | 0.94 | cc[ -]by[ -]nc[ -]4\.0
cc-by-nd-4.0 | by | 79 | 0.94 | cc[ -]by[ -]nd[ -]4\.0
cc-by-nc-sa-4.0 | by | 80 | 0.94 | cc[ -]by[ -]nc[ -]sa[ -]4\.0
cc-by-nc-nd-4.0 | by | 80 | 0.94 | cc[ -]by[ -]nc[ -]nd[ -]4\.0
odbl-1.0 | database | 80 | 0.95 | open database licen[sc]e (?:odbl )?(?:version |v)?1\.0
# Where licenses live on the web
apache-2.0 | apache | 85 | 0.97 | apache org licenses license 2\.0
gpl-2.0 | gnu | 85 | 0.96 | gnu org licenses (?:old licenses )?gpl 2\.0
gpl-3.0 | gnu | 85 | 0.96 | gnu org licenses gpl 3\.0
gpl | gnu | 75 | 0.9 | gnu org (?:copyleft|licenses) gpl
lgpl | gnu | 75 | 0.9 | gnu org (?:copyleft|licenses) lgpl
agpl | gnu | 75 | 0.9 | gnu org licenses agpl
mpl-2.0 | mozilla | 85 | 0.96 | mozilla org mpl 2\.0
mit | opensource | 85 | 0.95 | opensource org licenses? mit
isc | opensource | 85 | 0.95 | opensource org licenses? isc
bsd-2-clause | opensource | 85 | 0.95 | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource | 85 | 0.95 | opensource org licenses? bsd 3 clause
cc0-1.0 | creativecommons | 85 | 0.96 | creativecommons org publicdomain zero 1\.0
public-domain | creativecommons | 85 | 0.95 | creativecommons org publicdomain mark 1\.0
cc-by-4.0 | creativecommons | 85 | 0.96 | creativecommons org licenses by 4\.0
cc-by-3.0 | creativecommons | 85 | 0.96 | creativecommons org licenses by 3\.0
cc-by-sa-4.0 | creativecommons | 86 | 0.96 | creativecommons org licenses by sa 4\.0
cc-by-sa-3.0 | creativecommons | 86 | 0.96 | creativecommons org licenses by sa 3\.0
cc-by-nc-4.0 | creativecommons | 86 | 0.96 | creativecommons org licenses by nc 4\.0
cc-by-nd-4.0 | creativecommons | 86 | 0.96 | creativecommons org licenses by nd 4\.0
cc-by-nc-sa-4.0 | creativecommons | 87 | 0.96 | creativecommons org licenses by nc sa 4\.0
cc-by-nc-nd-4.0 | creativecommons | 87 | 0.96 | creativecommons org licenses by nc nd 4\.0
unlicense | unlicense | 85 | 0.95 | unlicense org
wtfpl | wtfpl | 85 | 0.95 | wtfpl net
boost-1.0 | boost | 85 | 0.95 | boost org license 1 0
# Sentences of the texts and notices
mit | granted | 70 | 0.9 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | sublicense | 68 | 0.8 | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | notice | 66 | 0.75 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
permissive | warranty | 50 | 0.5 | the software is provided as is without warranty of any kind
isc | permission | 70 | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | 65 | 0.8 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | 60 | 0.7 | redistributions of source code must retain the above copyright notice
bsd | redistributions | 60 | 0.7 | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | neither | 72 | 0.9 | neither the names? of (?:the )?(?:copyright holders?|author|university|project|company) nor the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-4-clause | advertising | 72 | 0.9 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | altered | 70 | 0.9 | altered source versions must be plainly marked as such and must not be misrepresented
zlib | misrepresented | 69 | 0.85 | the origin of this software must not be misrepresented
apache-2.0 | compliance | 70 | 0.9 | you may not use this file except in compliance with the license
apache | contributor | 65 | 0.85 | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | redistribute | 70 | 0.9 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
lgpl | redistribute | 72 | 0.9 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
gpl | merchantability | 50 | 0.5 | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | received | 68 | 0.85 | you should have received a copy of the gnu general public licen[sc]e
lgpl | received | 69 | 0.85 | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
agpl | received | 69 | 0.85 | you should have received a copy of the gnu affero general public licen[sc]e
gpl-2.0 | option | 71 | 0.85 | either version 2 of the licen[sc]e or at your option any later version
gpl-3.0 | option | 71 | 0.85 | either version 3 of the licen[sc]e or at your option any later version
lgpl-2.1 | option | 71 | 0.85 | either version 2\.1 of the licen[sc]e or at your option any later version
mpl-2.0 | subject | 70 | 0.92 | this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-1.1 | subject | 70 | 0.9 | the contents of this file are subject to the mozilla public licen[sc]e version 1\.1
epl-1.0 | accompanying | 70 | 0.85 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1\.0
epl-2.0 | accompanying | 70 | 0.85 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2\.0
boost-1.0 | boost | 70 | 0.9 | distributed under the boost software licen[sc]e
unlicense | unencumbered | 70 | 0.95 | this is free and unencumbered software released into the public domain
wtfpl | fuck | 70 | 0.95 | you just do what the fuck you want to
public-domain | domain | 55 | 0.7 | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | domain | 54 | 0.6 | this (?:work|file|code|software|text) is in the public domain
public-domain | copyright | 50 | 0.6 | no copyright is claimed
cc0 | waived | 60 | 0.8 | has waived all copyright and related or neighboring rights
proprietary | reserved | 50 | 0.4 | all rights reserved
proprietary | unauthorized | 60 | 0.7 | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|document|material|work|software)
proprietary | confidential | 55 | 0.6 | (?:strictly |proprietary and )confidential
proprietary | prior | 55 | 0.6 | without (?:the )?(?:express |prior )+written (?:permission|consent)
# Grants
mit | mit | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit
apache | apache | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache
gpl | gpl | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl | general | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public licen[sc]e
lgpl | lgpl | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?lgpl
agpl | agpl | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?agpl
bsd | bsd | 60 | 0.9 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?(?:terms of the )?bsd
mpl | mozilla | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mozilla public licen[sc]e
cc-by | attribution | 60 | 0.92 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?(?:terms of the )?creative commons attribution
cc | creative | 58 | 0.85 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?(?:terms of the )?creative commons
gpl | same | 58 | 0.6 | (?:licen[sc]ed|released|distributed) under the same terms as the linux kernel
artistic | same | 58 | 0.6 | (?:licen[sc]ed|released|distributed) under the same terms as perl itself
proprietary | commercial | 58 | 0.6 | (?:licen[sc]ed|released|distributed) under a commercial licen[sc]e
# Names
mit | licen | 40 | 0.85 | mit licen[sc]ed?
mit | expat | 40 | 0.8 | expat licen[sc]e
mit | x11 | 40 | 0.8 | x11 licen[sc]e
apache | apache | 40 | 0.85 | apache(?: software)? licen[sc]e
gpl | general | 39 | 0.8 | general public licen[sc]e
gpl | general | 40 | 0.85 | gnu general public licen[sc]e
gpl | gpl | 38 | 0.75 | gpl licen[sc]ed?
gpl | gnu | 38 | 0.75 | gnu gpl
lgpl | lesser | 42 | 0.85 | (?:gnu )?lesser general public licen[sc]e
lgpl | library | 42 | 0.85 | (?:gnu )?library general public licen[sc]e
lgpl | lgpl | 38 | 0.75 | lgpl licen[sc]ed?
agpl | affero | 42 | 0.85 | (?:gnu )?affero general public licen[sc]e
agpl | agpl | 38 | 0.75 | agpl licen[sc]ed?
bsd-2-clause | simplified | 42 | 0.85 | simplified bsd licen[sc]e
bsd-2-clause | clause | 42 | 0.88 | (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?
bsd-2-clause | freebsd | 42 | 0.8 | freebsd licen[sc]e
bsd-3-clause | bsd | 42 | 0.85 | (?:new|modified|revised) bsd licen[sc]e
bsd-3-clause | clause | 42 | 0.88 | (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?
bsd-4-clause | clause | 42 | 0.88 | (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?
bsd-4-clause | original | 42 | 0.8 | original bsd licen[sc]e
0bsd | zero | 42 | 0.85 | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?
bsd | bsd | 40 | 0.8 | bsd(?: style)? licen[sc]ed?
isc | isc | 40 | 0.8 | isc licen[sc]e
mpl | mozilla | 40 | 0.85 | mozilla public licen[sc]e
epl | eclipse | 40 | 0.85 | eclipse public licen[sc]e
cddl | development | 40 | 0.85 | common development and distribution licen[sc]e
eupl | european | 40 | 0.85 | european union public licen[sc]e
artistic | artistic | 40 | 0.8 | (?:perl )?artistic licen[sc]e
boost | boost | 40 | 0.85 | boost software licen[sc]e
busl | business | 40 | 0.8 | business source licen[sc]e
sspl | server | 40 | 0.8 | server side public licen[sc]e
zlib | zlib | 40 | 0.85 | zlib(?: libpng)? licen[sc]e
python | python | 40 | 0.85 | python(?: software foundation)? licen[sc]e
ruby | ruby | 40 | 0.75 | ruby licen[sc]e
php | php | 40 | 0.8 | php licen[sc]e
openssl | openssl | 40 | 0.8 | openssl licen[sc]e
ncsa | illinois | 40 | 0.85 | university of illinois(?: ncsa)? open source licen[sc]e
postgresql | postgresql | 40 | 0.85 | postgresql licen[sc]e
ms-pl | microsoft | 40 | 0.85 | microsoft public licen[sc]e
ms-rl | microsoft | 40 | 0.85 | microsoft reciprocal licen[sc]e
apsl | apple | 40 | 0.8 | apple public source licen[sc]e
wtfpl | fuck | 40 | 0.9 | do what the fuck you want to public licen[sc]e
unlicense | unlicense | 40 | 0.7 | the unlicense
ofl | font | 40 | 0.85 | (?:sil )?open font licen[sc]e
gfdl | documentation | 40 | 0.85 | (?:gnu )?free documentation licen[sc]e
odbl | database | 40 | 0.85 | open database licen[sc]e
upl | permissive | 40 | 0.85 | universal permissive licen[sc]e
cc0 | zero | 40 | 0.85 | creative commons zero
cc-by | attribution | 40 | 0.85 | creative commons attribution
cc-by-sa | attribution | 42 | 0.88 | creative commons attribution share ?alike
cc-by-nd | attribution | 42 | 0.88 | creative commons attribution no ?derivatives
cc-by-nc | attribution | 42 | 0.88 | creative commons attribution non ?commercial
cc-by-nc-sa | attribution | 43 | 0.88 | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | attribution | 43 | 0.88 | creative commons attribution non ?commercial no ?derivatives
cc | creative | 35 | 0.7 | creative commons licen[sc]e
proprietary | proprietary | 40 | 0.7 | proprietary licen[sc]e
proprietary | user | 40 | 0.7 | end user licen[sc]e agreement
proprietary | commercial | 40 | 0.6 | commercial licen[sc]e
# Fields of manifests and headers
mit | licen | 30 | 0.85 | licen[sc]es? mit
apache | licen | 30 | 0.85 | licen[sc]es? apache
gpl | licen | 30 | 0.85 | licen[sc]es? gpl
lgpl | licen | 30 | 0.85 | licen[sc]es? lgpl
agpl | licen | 30 | 0.85 | licen[sc]es? agpl
bsd | licen | 30 | 0.8 | licen[sc]es? bsd
isc | licen | 30 | 0.8 | licen[sc]es? isc
mpl | licen | 30 | 0.8 | licen[sc]es? mpl
proprietary | unlicensed | 30 | 0.7 | licen[sc]e unlicensed
mit | osi | 32 | 0.9 | license osi approved mit license
apache | osi | 32 | 0.9 | license osi approved apache software license
bsd | osi | 32 | 0.9 | license osi approved bsd license
gpl-2.0 | osi | 32 | 0.9 | license osi approved gnu general public license v2
gpl-3.0 | osi | 32 | 0.9 | license osi approved gnu general public license v3
lgpl-3.0 | osi | 32 | 0.9 | license osi approved gnu lesser general public license v3
mpl-2.0 | osi | 32 | 0.9 | license osi approved mozilla public license 2\.0
"""
