"""Signature rules for licence notices, written one by one, in order.

A line of RULES is a label, a confidence, a keyword and a regular expression, two spaces between. A
pattern matches whole words of a text in lower case with single spaces around them, so punctuation
and line breaks never stand between; it holds no capturing group. It runs only on texts that hold
its keyword, which every match contains. Of two detections of the same words the rule further up
wins.
"""

from __future__ import annotations

RULES = r"""
agpl-3.0  1.0  spdx  spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
agpl-1.0  1.0  spdx  spdx licen[cs]e identifier agpl 1 0(?: only| or later)?
lgpl-3.0  1.0  spdx  spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
lgpl-2.1  1.0  spdx  spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
lgpl-2.0  1.0  spdx  spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
gpl-3.0  1.0  spdx  spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gpl-2.0  1.0  spdx  spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-1.0  1.0  spdx  spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gfdl  1.0  spdx  spdx licen[cs]e identifier gfdl 1 [123](?: only| or later)?
apache-2.0  1.0  spdx  spdx licen[cs]e identifier apache 2 0
apache-1.1  1.0  spdx  spdx licen[cs]e identifier apache 1 1
mit-0  1.0  spdx  spdx licen[cs]e identifier mit 0
mit  1.0  spdx  spdx licen[cs]e identifier mit
x11  1.0  spdx  spdx licen[cs]e identifier x11
0bsd  1.0  spdx  spdx licen[cs]e identifier 0bsd
bsd-2-clause  1.0  spdx  spdx licen[cs]e identifier bsd 2 clause(?: patent| views)?
bsd-3-clause  1.0  spdx  spdx licen[cs]e identifier bsd 3 clause(?: clear)?
bsd-4-clause  1.0  spdx  spdx licen[cs]e identifier bsd 4 clause(?: uc)?
mpl-2.0  1.0  spdx  spdx licen[cs]e identifier mpl 2 0(?: no copyleft exception)?
mpl-1.1  1.0  spdx  spdx licen[cs]e identifier mpl 1 1
epl-2.0  1.0  spdx  spdx licen[cs]e identifier epl 2 0
epl-1.0  1.0  spdx  spdx licen[cs]e identifier epl 1 0
cddl-1.0  1.0  spdx  spdx licen[cs]e identifier cddl 1 [01]
isc  1.0  spdx  spdx licen[cs]e identifier isc
zlib  1.0  spdx  spdx licen[cs]e identifier zlib(?: acknowledgement)?
bsl-1.0  1.0  spdx  spdx licen[cs]e identifier bsl 1 0
busl-1.1  1.0  spdx  spdx licen[cs]e identifier busl 1 1
unlicense  1.0  spdx  spdx licen[cs]e identifier unlicense
wtfpl  1.0  spdx  spdx licen[cs]e identifier wtfpl
artistic-2.0  1.0  spdx  spdx licen[cs]e identifier artistic 2 0
artistic  1.0  spdx  spdx licen[cs]e identifier artistic 1 0(?: perl| cl8)?
psf-2.0  1.0  spdx  spdx licen[cs]e identifier (?:psf|python) 2 0
ofl-1.1  1.0  spdx  spdx licen[cs]e identifier ofl 1 1(?: rfn| no rfn)?
eupl  1.0  spdx  spdx licen[cs]e identifier eupl 1 [0-2]
ms-pl  1.0  spdx  spdx licen[cs]e identifier ms pl
ms-rl  1.0  spdx  spdx licen[cs]e identifier ms rl
cc0  1.0  spdx  spdx licen[cs]e identifier cc0 1 0
cc-by-nc-sa  1.0  spdx  spdx licen[cs]e identifier cc by nc sa [1-4] [05]
cc-by-nc-nd  1.0  spdx  spdx licen[cs]e identifier cc by nc nd [1-4] [05]
cc-by-nc  1.0  spdx  spdx licen[cs]e identifier cc by nc [1-4] [05]
cc-by-sa  1.0  spdx  spdx licen[cs]e identifier cc by sa [1-4] [05]
cc-by-nd  1.0  spdx  spdx licen[cs]e identifier cc by nd [1-4] [05]
cc-by  1.0  spdx  spdx licen[cs]e identifier cc by [1-4] [05]
odbl  1.0  spdx  spdx licen[cs]e identifier odbl 1 0
odc-by  1.0  spdx  spdx licen[cs]e identifier odc by 1 0
pddl  1.0  spdx  spdx licen[cs]e identifier pddl 1 0
agpl-3.0  0.95  affero  (?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation either)?(?: version| v)? 3(?: 0)?
agpl-3.0  0.9  affero  gnu affero general public licen[cs]e
agpl-3.0  0.9  agplv3  (?:gnu )?agplv3(?: only| or later)?
agpl-3.0  0.85  agpl  (?:gnu )?agpl(?: version| v)? 3(?: 0)?(?: only| or later)?
agpl  0.7  agpl  licen[cs]ed under (?:the )?(?:gnu )?agpl
agpl  0.6  agpl  agpl licen[cs]ed?
sspl-1.0  0.95  server side  server side public licen[cs]e(?: version| v)?(?: 1)?
lgpl-3.0  0.95  lesser  (?:gnu )?lesser general public licen[cs]e(?: version| v) 3(?: 0)?
lgpl-2.1  0.95  lesser  (?:gnu )?lesser general public licen[cs]e(?: version| v) 2 1
lgpl-2.1  0.9  lesser  (?:gnu )?lesser general public licen[cs]e as published by the free software foundation either version 2 1
lgpl-3.0  0.9  lesser  (?:gnu )?lesser general public licen[cs]e as published by the free software foundation either version 3
lgpl  0.8  lesser  (?:gnu )?lesser general public licen[cs]e
lgpl-2.0  0.9  library general  (?:gnu )?library general public licen[cs]e(?: version| v)?(?: 2)?(?: 0)?
lgpl-3.0  0.9  lgplv3  (?:gnu )?lgplv3(?: only| or later)?
lgpl-2.1  0.9  lgplv2  (?:gnu )?lgplv2 1(?: only| or later)?
lgpl-3.0  0.85  lgpl  (?:gnu )?lgpl(?: version| v)? 3(?: 0)?(?: only| or later)?
lgpl-2.1  0.85  lgpl  (?:gnu )?lgpl(?: version| v)? 2 1(?: only| or later)?
lgpl-2.0  0.85  lgpl  (?:gnu )?lgpl(?: version| v)? 2 0(?: only| or later)?
lgpl  0.7  lgpl  licen[cs]ed under (?:the )?(?:gnu )?lgpl
lgpl  0.6  lgpl  (?:gnu )?lgpl
gpl-3.0  1.0  general public  this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3
gpl-2.0  1.0  general public  this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2
gpl  0.95  general public  this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-3.0  0.95  general public  licen[cs]ed under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? 3(?: 0)?
gpl-2.0  0.95  general public  licen[cs]ed under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? 2(?: 0)?
gpl-1.0  0.95  general public  licen[cs]ed under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? 1(?: 0)?
gpl  0.9  general public  (?:licen[cs]ed|released|distributed|published) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e
gpl  0.85  general public  (?:covered by|subject to|governed by) (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e
gpl-3.0  0.9  general public  (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?
gpl-2.0  0.9  general public  (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?
gpl-1.0  0.9  general public  (?:gnu )?general public licen[cs]e(?: version| v)? 1(?: 0)?
gpl  0.8  general public  you should have received a copy of the gnu general public licen[cs]e along with
gpl  0.7  general public  (?:gnu )?general public licen[cs]e
gpl-3.0  0.9  gplv3  (?:gnu )?gplv3(?: only| or later)?
gpl-2.0  0.9  gplv2  (?:gnu )?gplv2(?: only| or later)?
gpl-3.0  0.85  gpl  (?:gnu )?gpl(?: version| v)? 3(?: 0)?(?: only| or later)?
gpl-2.0  0.85  gpl  (?:gnu )?gpl(?: version| v)? 2(?: 0)?(?: only| or later)?
gpl-1.0  0.85  gpl  (?:gnu )?gpl(?: version| v)? 1 0(?: only| or later)?
gpl  0.8  gpl  (?:licen[cs]ed|released|distributed) under (?:the )?(?:gnu )?gpl
gpl  0.7  gpl  (?:gnu )?gpl licen[cs]ed?
gpl  0.6  gnu gpl  gnu gpl
gpl-2.0  0.8  classpath  classpath exception(?: 2 0)?
gfdl  0.95  documentation  (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 [123]
gfdl  0.85  documentation  (?:gnu )?free documentation licen[cs]e
gfdl  0.95  invariant sections  with no invariant sections no front cover texts and no back cover texts
gfdl  0.7  gfdl  (?:gnu )?gfdl
apache-2.0  1.0  apache  licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache-2.0  0.95  apache  licen[cs]ed (?:to you )?under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?
apache-2.0  0.9  apache  (?:released|distributed|published|available|provided) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?
apache-2.0  0.9  apache  apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?
apache-2.0  0.85  apache  apache(?: version| v)? 2(?: 0)? licen[cs]ed?
apache-2.0  0.8  apache  licen[cs]ed under apache(?: version| v)? 2(?: 0)?
apache-1.1  0.9  apache  apache(?: software)? licen[cs]e(?: version| v)? 1 1
apache-1.0  0.9  apache  apache(?: software)? licen[cs]e(?: version| v)? 1 0
apache  0.75  apache  (?:licen[cs]ed|released|distributed) under (?:the )?apache(?: software)? licen[cs]e
apache  0.7  apache  apache(?: software)? licen[cs]e
apache-2.0  0.9  unless required  unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
mit  1.0  hereby granted  permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit  0.95  hereby granted  permission is hereby granted free of charge to any person obtaining a copy
mit  0.8  above copyright notice  the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit  0.95  mit licen  (?:this \w+ is )?licen[cs]ed under (?:the )?(?:terms of the )?mit licen[cs]e
mit  0.9  mit licen  (?:released|distributed|published|provided|available) under (?:the )?(?:terms of the )?mit licen[cs]e
mit  0.85  mit licen  (?:covered by|subject to|governed by) (?:the )?(?:terms of the )?mit licen[cs]e
mit  0.75  mit licen  (?:the )?mit licen[cs]ed?
mit  0.8  under mit  licen[cs]ed under mit
mit  0.75  licen  licen[cs]e mit
mit-0  0.9  attribution  mit no attribution licen[cs]e
mit  0.85  expat  (?:the )?expat licen[cs]e
x11  0.85  x11  (?:the )?(?:mit )?x11 licen[cs]e
0bsd  0.9  bsd  (?:zero clause|0 clause|free public) bsd(?: licen[cs]e)?
bsd-2-clause  1.0  disclaimer in the documentation  redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd  0.95  redistribution and use  redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd  0.85  redistribution and use  redistribution and use in source and binary forms
bsd  0.8  redistributions of source  redistributions of source code must retain the above copyright notice
bsd-3-clause  0.95  endorse or promote  may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause  0.95  advertising materials  all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause  0.9  bsd  (?:the )?simplified bsd licen[cs]e
bsd-2-clause  0.9  freebsd  (?:the )?freebsd licen[cs]e
bsd-2-clause  0.9  clause bsd  (?:the )?(?:2|two) clause bsd(?: style)? licen[cs]e
bsd-2-clause  0.9  bsd  (?:the )?bsd (?:2|two) clause licen[cs]e
bsd-3-clause  0.9  bsd  (?:the )?(?:new|modified|revised) bsd licen[cs]e
bsd-3-clause  0.9  clause bsd  (?:the )?(?:3|three) clause bsd(?: style)? licen[cs]e
bsd-3-clause  0.9  bsd  (?:the )?bsd (?:3|three) clause(?: new or revised)? licen[cs]e
bsd-4-clause  0.9  original bsd  (?:the )?original bsd licen[cs]e
bsd-4-clause  0.9  bsd  (?:the )?(?:bsd (?:4|four) clause|(?:4|four) clause bsd) licen[cs]e
bsd  0.85  bsd  (?:licen[cs]ed|released|distributed|published|available) under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[cs]e)?
bsd  0.7  bsd  (?:the )?bsd(?: style)? licen[cs]ed?
bsd  0.65  bsd  licen[cs]e bsd
mpl-2.0  1.0  mozilla  this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0  0.95  mozilla  (?:subject to the terms of )?the mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
mpl-2.0  0.9  mozilla  mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
mpl-1.1  0.9  mozilla  mozilla public licen[cs]e(?: version| v)? 1 1
mpl-1.0  0.9  mozilla  mozilla public licen[cs]e(?: version| v)? 1 0
mpl  0.8  mozilla  mozilla public licen[cs]e
mpl-2.0  0.8  mpl  (?:licen[cs]ed under (?:the )?)mpl(?: version| v)? 2(?: 0)?
mpl  0.7  mpl  licen[cs]ed under (?:the )?mpl
npl  0.85  netscape  netscape public licen[cs]e(?: version| v)?(?: 1 [01])?
epl-2.0  0.95  eclipse  eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
epl-1.0  0.95  eclipse  eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
epl  0.8  eclipse  eclipse public licen[cs]e
edl-1.0  0.85  eclipse  eclipse distribution licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
cddl-1.1  0.9  common development  common development and distribution licen[cs]e(?: version| v)? 1 1
cddl-1.0  0.9  common development  common development and distribution licen[cs]e(?: version| v)? 1 0
cddl  0.8  common development  common development and distribution licen[cs]e
cddl  0.75  cddl  licen[cs]ed under (?:the )?cddl(?: 1 [01])?
cddl  0.7  cddl  cddl licen[cs]ed?
cpl-1.0  0.85  common public  common public licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
cpal-1.0  0.9  common public attribution  common public attribution licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
ipl-1.0  0.9  ibm public  ibm public licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
isc  1.0  without fee  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
isc  0.95  any purpose  permission to use copy modify and or distribute this software for any purpose
isc  0.9  any purpose  permission to use copy modify and distribute this software for any purpose
isc  0.85  isc  (?:licen[cs]ed|released|distributed) under (?:the )?isc licen[cs]e
isc  0.75  isc licen  (?:the )?isc licen[cs]ed?
hpnd  0.85  its documentation  permission to use copy modify and distribute this software and its documentation
zlib  0.95  express or implied  this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib  0.95  misrepresented  the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib  0.85  zlib  (?:licen[cs]ed|released|distributed) under (?:the )?zlib(?: libpng)?(?: licen[cs]e)?
zlib  0.75  zlib  (?:the )?zlib(?: libpng)? licen[cs]e
libpng  0.8  png  (?:the )?(?:png reference library|libpng) licen[cs]e(?: version 2)?
ijg  0.85  independent jpeg  independent jpeg group licen[cs]e
bsl-1.0  0.95  boost  (?:distributed under the )?boost software licen[cs]e(?: version| v)? 1(?: 0)?
bsl-1.0  0.85  boost  boost software licen[cs]e
busl-1.1  0.9  business source  business source licen[cs]e(?: version| v)?(?: 1 1)?
elastic-2.0  0.9  elastic licen  elastic licen[cs]e(?: version| v)?(?: 2)?(?: 0)?
polyform  0.9  polyform  polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e(?: 1 0 0)?
commons-clause  0.9  commons clause  commons clause licen[cs]e condition(?: v1)?(?: 1)?(?: 0)?
unlicense  0.95  unencumbered  this is free and unencumbered software released into the public domain
unlicense  0.85  unlicense  (?:licen[cs]ed|released) under (?:the )?unlicense
unlicense  0.7  the unlicense  the unlicense
wtfpl  0.95  the fuck you want  do what the fuck you want to(?: public licen[cs]e)?
wtfpl  0.8  wtfpl  (?:licen[cs]ed under (?:the )?wtfpl|wtfpl licen[cs]ed?)
beerware  0.95  buy me a beer  you can (?:do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can )?buy me a beer in return
beerware  0.85  beer  (?:the )?beer ?ware licen[cs]e(?: revision 42)?
artistic-2.0  0.95  artistic  artistic licen[cs]e(?: version| v)? 2(?: 0)?
artistic  0.85  clarified artistic  (?:the )?clarified artistic licen[cs]e
artistic  0.75  artistic  artistic licen[cs]e
artistic  0.85  same terms as perl  licen[cs]ed under the same terms as perl(?: itself)?
psf-2.0  0.95  python software  python software foundation licen[cs]e(?: version| v)?(?: 2)?(?: 0)?
psf-2.0  0.8  psf  psf licen[cs]e(?: agreement)?(?: version 2)?
php-3.01  0.95  php  php licen[cs]e(?: version| v)? 3 01
php-3.0  0.95  php  php licen[cs]e(?: version| v)? 3 0
php  0.75  php  (?:the )?php licen[cs]e
ruby  0.75  ruby licen  (?:the )?ruby licen[cs]e
zpl-2.1  0.9  zope  zope public licen[cs]e(?: version| v)?(?: 2 [01])?
tcl  0.75  tcl  tcl tk licen[cs]e
w3c  0.85  w3c  w3c software(?: notice)?(?: and document)?(?: notice)?(?: and)? licen[cs]e
icu  0.8  icu  (?:the )?icu licen[cs]e
unicode  0.85  unicode  unicode(?: inc)? licen[cs]e(?: agreement)?(?: v3)?
openssl  0.9  openssl  (?:the )?(?:dual )?openssl(?: and ssleay)? licen[cs]e
curl  0.8  curl  (?:the )?curl licen[cs]e
ncsa  0.95  illinois  university of illinois(?: ncsa)? open source licen[cs]e
ncsa  0.75  ncsa  ncsa(?: open source)? licen[cs]e
ofl-1.1  0.95  sil open font  sil open font licen[cs]e(?: version| v)? 1 1
ofl-1.1  0.85  open font  (?:sil )?open font licen[cs]e
ofl-1.1  0.95  reserved font name  with reserved font name
eupl  0.95  european union  european union public licen[cs]e(?: version| v)?(?: 1 [0-2])?
eupl  0.75  eupl  licen[cs]ed under (?:the )?eupl(?: 1 [0-2])?
cecill  0.9  cecill  cecill(?: [abc])?(?: free software)? licen[cs]e(?: agreement)?
ms-pl  0.95  microsoft public  microsoft public licen[cs]e
ms-rl  0.95  microsoft reciprocal  microsoft reciprocal licen[cs]e
apsl-2.0  0.9  apple public  apple public source licen[cs]e(?: version| v)?(?: 2)?(?: 0)?
nasa-1.3  0.9  nasa  nasa open source agreement(?: version)? 1 3
qpl-1.0  0.85  q public  q public licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
sleepycat  0.85  sleepycat  sleepycat(?: public)? licen[cs]e
afl-3.0  0.95  academic free  academic free licen[cs]e(?: version| v)? 3(?: 0)?
afl  0.8  academic free  academic free licen[cs]e
osl-3.0  0.95  open software  open software licen[cs]e(?: version| v)? 3(?: 0)?
osl  0.8  open software  open software licen[cs]e
rpl-1.5  0.9  reciprocal public  reciprocal public licen[cs]e(?: version| v)?(?: 1)?(?: 5)?
mulan-psl-2.0  0.9  mulan  mulan permissive software licen[cs]e(?: version| v)?(?: 2)?
upl-1.0  0.9  universal permissive  universal permissive licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
blueoak-1.0.0  0.9  blue oak  blue oak model licen[cs]e(?: 1 0 0)?
hippocratic  0.9  hippocratic  hippocratic licen[cs]e(?: version)?(?: [123])?(?: [01])?
json  0.95  good not evil  the software shall be used for good not evil
postgresql  0.9  postgresql  (?:the )?postgresql licen[cs]e
vim  0.8  vim licen  (?:the )?vim licen[cs]e
odbl  0.95  database  open (?:data commons open )?database licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
odc-by  0.9  open data commons  open data commons attribution licen[cs]e(?: version| v)?(?: 1)?(?: 0)?
pddl  0.9  domain dedication  (?:open data commons )?public domain dedication and licen[cs]e
ogl-uk  0.9  open government  open government licen[cs]e(?: version| v)?(?: [123])?(?: 0)?
cdla-permissive  0.9  community data  community data licen[cs]e agreement permissive(?: version)?(?: [12])?(?: 0)?
cdla-sharing  0.9  community data  community data licen[cs]e agreement sharing(?: version)?(?: 1)?(?: 0)?
etalab  0.85  etalab  (?:etalab licen[cs]e ouverte|licen[cs]e ouverte etalab|etalab open licen[cs]e)(?: 2 0)?
cc0  0.95  cc0  cc0 1 0 universal(?: public domain dedication)?
cc0  0.9  cc0  (?:licen[cs]ed|released|dedicated|published) under (?:the )?(?:creative commons )?cc0(?: 1 0)?
cc0  0.85  creative commons zero  creative commons zero(?: v1 0)?(?: universal)?(?: licen[cs]e)?
cc0  0.7  cc0  cc0(?: 1 0)?
cc-pdm  0.85  public domain mark  public domain mark(?: 1 0)?
cc-by-nc-sa  0.95  cc by nc sa  licen[cs]ed under (?:a |the )?cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd  0.95  cc by nc nd  licen[cs]ed under (?:a |the )?cc by nc nd(?: [1-4] [05])?
cc-by-nc  0.95  cc by nc  licen[cs]ed under (?:a |the )?cc by nc(?: [1-4] [05])?
cc-by-sa  0.95  cc by sa  licen[cs]ed under (?:a |the )?cc by sa(?: [1-4] [05])?
cc-by-nd  0.95  cc by nd  licen[cs]ed under (?:a |the )?cc by nd(?: [1-4] [05])?
cc-by  0.95  cc by  licen[cs]ed under (?:a |the )?cc by(?: [1-4] [05])?
cc-by-nc-sa  0.9  cc by nc sa  (?:released|published|available|distributed) under (?:a |the )?cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd  0.9  cc by nc nd  (?:released|published|available|distributed) under (?:a |the )?cc by nc nd(?: [1-4] [05])?
cc-by-nc  0.9  cc by nc  (?:released|published|available|distributed) under (?:a |the )?cc by nc(?: [1-4] [05])?
cc-by-sa  0.9  cc by sa  (?:released|published|available|distributed) under (?:a |the )?cc by sa(?: [1-4] [05])?
cc-by-nd  0.9  cc by nd  (?:released|published|available|distributed) under (?:a |the )?cc by nd(?: [1-4] [05])?
cc-by  0.9  cc by  (?:released|published|available|distributed) under (?:a |the )?cc by(?: [1-4] [05])?
cc-by-nc-sa  0.8  cc by nc sa  cc by nc sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-nd  0.8  cc by nc nd  cc by nc nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc  0.8  cc by nc  cc by nc(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-sa  0.8  cc by sa  cc by sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nd  0.8  cc by nd  cc by nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by  0.75  cc by  cc by(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-sa  0.95  creative commons  creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-nc-nd  0.95  creative commons  creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-nc  0.95  creative commons  creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-sa  0.95  creative commons  creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-nd  0.95  creative commons  creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by  0.95  creative commons  creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-nc-sa  0.85  creative commons  creative commons attribution non ?commercial share ?alike
cc-by-nc-nd  0.85  creative commons  creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc  0.85  creative commons  creative commons attribution non ?commercial
cc-by-sa  0.85  creative commons  creative commons attribution share ?alike
cc-by-nd  0.85  creative commons  creative commons attribution no ?deriv(?:ative)?s
cc-by  0.8  creative commons  creative commons attribution
creative-commons  0.7  creative commons  (?:licen[cs]ed under )?(?:a )?creative commons licen[cs]e
cc-by  0.9  creativecommons org  creativecommons org licenses by [1-4] [05]
cc-by-sa  0.9  creativecommons org  creativecommons org licenses by sa [1-4] [05]
cc-by-nc  0.9  creativecommons org  creativecommons org licenses by nc [1-4] [05]
cc-by-nd  0.9  creativecommons org  creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa  0.9  creativecommons org  creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd  0.9  creativecommons org  creativecommons org licenses by nc nd [1-4] [05]
cc0  0.9  creativecommons org  creativecommons org publicdomain zero 1 0
gpl  0.85  gnu org  (?:www )?gnu org licen[cs]es gpl(?: [123] [01])?
lgpl  0.85  gnu org  (?:www )?gnu org licen[cs]es lgpl(?: [23] [01])?
agpl  0.85  gnu org  (?:www )?gnu org licen[cs]es agpl(?: 3 0)?
apache-2.0  0.9  apache org  (?:www )?apache org licen[cs]es licen[cs]e 2 0
mit  0.85  opensource org  (?:www )?opensource org licen[cs]es mit(?: license php)?
bsd  0.85  opensource org  (?:www )?opensource org licen[cs]es bsd [23] clause
openrail  0.95  openrail  (?:bigscience |creativeml |bigcode )?openrail(?: m)? licen[cs]e(?: v1)?
openrail  0.9  responsible ai  responsible ai licen[cs]e(?: agreement)?
public-domain  0.9  public domain  (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain  0.85  public domain  this (?:work|text|file|software|image|document) is in the public domain
public-domain  0.7  public domain  in the public domain
public-domain  0.85  no rights reserved  no rights reserved
reserved  0.8  all rights reserved  copyright (?:c )?[12][0-9]{3} (?:[^ ]+ ){1,6}all rights reserved
reserved  0.7  all rights reserved  all rights reserved
reserved  0.7  alle rechte  alle rechte vorbehalten
reserved  0.6  some rights reserved  some rights reserved
copyright  0.6  copyright  copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})?
copyright  0.55  copyright  copyright holders?
copyright  0.5  copyright  copyright (?:c )?by
copyright  0.5  copyrighted  copyrighted (?:material|work|by)
proprietary  0.9  proprietary  proprietary and confidential
proprietary  0.85  proprietary  confidential and proprietary
proprietary  0.85  prohibited  unauthori[sz]ed (?:copying|use|distribution|reproduction) (?:of this [^ ]+ )?(?:via any medium )?is (?:strictly )?prohibited
proprietary  0.85  written permission  may not be (?:reproduced|copied|distributed|republished)(?: or transmitted)?(?: in any form)? without (?:the )?(?:prior )?written permission
proprietary  0.8  reproduction  reproduction without permission is (?:strictly )?prohibited
proprietary  0.8  end user licen  end user licen[cs]e agreement
non-commercial  0.8  commercial use  for non ?commercial use only licen[cs]e
non-commercial  0.75  personal use  licen[cs]ed for personal use only
non-commercial  0.75  licen  licen[cs]ed for (?:academic|research|non ?commercial research) (?:use|purposes) only
dual  0.7  dual licen  dual licen[cs]ed under
any  0.5  see  see (?:the )?(?:file )?licen[cs]e(?: file| txt| md)? for (?:details|more information)
any  0.5  licensed under  licensed under the same (?:terms|license) as
any  0.5  found in the  (?:that|which) can be found in the licen[cs]e file
any  0.45  licence terms  (?:the )?licence terms and conditions
no-warranty  0.4  warranty  without warranty of any kind(?: express or implied)?
no-warranty  0.4  warranty  without even the implied warranty of merchantability or fitness for a particular purpose
no-warranty  0.4  warranties  without warranties or conditions of any kind
"""

#: Every match of a rule holds one of these in its text, and every "cc by" is matched by CC_BY.
ANCHORS = [
    "licen", "spdx", "gpl", "gfdl", "classpath", "invariant", "permission", "copyright", "redistribution", "advertising", "warrant", "misrepresented", "unencumbered", "fuck", "bsd", "beer",
    "zlib", "rights", "reserved", "rechte", "evil", "cc0", "creative", "domain", "proprietary", "prohibited", "nasa",
]
CC_BY = "cc[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+by"


def rules() -> list[dict]:
    """All rules: priority (a lower number wins a tie), label, keyword, pattern, confidence."""
    lines = [line.split("  ", 3) for line in RULES.strip().splitlines()]
    return [
        {"priority": k, "label": label, "keyword": keyword, "pattern": f"(?<= )(?:{pattern})(?= )", "confidence": float(sure)}
        for k, (label, sure, keyword, pattern) in enumerate(lines)
    ]
