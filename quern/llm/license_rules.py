"""The signature rules of the license scan.

One rule a line: label, priority and regex over lower-cased words joined by single spaces, under the keyword that a text
must hold for the rule to be tried. Numbers are words of their own: 2.0 is "2 0". A regex has no unbounded repetition, so
the longest match of a rule is known from its text. Names have priority 20, names with a version 40, license notices 50,
identifiers 60, sentences of license texts 70, and hints that name no license 10.
"""

from __future__ import annotations

_RULES = r"""
# general public
gpl 20 (?:the )?gnu general public licen[sc]e
gpl 20 gnu general public licen[sc]e gpl
gpl-1.0 40 gnu general public licen[sc]e (?:version |v )?1(?: 0)?
gpl-2.0 40 gnu general public licen[sc]e (?:version |v )?2(?: 0)?
gpl-2.0 40 gnu general public licen[sc]e v2(?: 0)?
gpl-2.0 45 version 2 of the gnu general public licen[sc]e
gpl-2.0 45 gnu general public licen[sc]e version 2 only
gpl-2.0 50 gnu general public licen[sc]e version 2 as published by the free software foundation
gpl-2.0-or-later 50 gnu general public licen[sc]e (?:version |v )?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-or-later 70 gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-3.0 40 gnu general public licen[sc]e (?:version |v )?3(?: 0)?
gpl-3.0 40 gnu general public licen[sc]e v3(?: 0)?
gpl-3.0 45 version 3 of the gnu general public licen[sc]e
gpl-3.0 45 gnu general public licen[sc]e version 3 only
gpl-3.0 70 gnu general public licen[sc]e version 3 29 june 2007
gpl-2.0 70 gnu general public licen[sc]e version 2 june 1991
gpl-3.0-or-later 50 gnu general public licen[sc]e (?:version |v )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later 70 gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl 50 under the terms of the gnu general public licen[sc]e
gpl 50 you should have received a copy of the gnu general public licen[sc]e along with this program
gpl 70 see the gnu general public licen[sc]e for more details
gpl 70 the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl 70 the licen[sc]es for most software are designed to take away your freedom to share and change it by contrast the gnu general public licen[sc]e
lgpl 20 (?:gnu )?lesser general public licen[sc]e
lgpl 20 (?:gnu )?library general public licen[sc]e
lgpl-2.0 40 (?:gnu )?library general public licen[sc]e (?:version |v )?2(?: 0)?
lgpl-2.1 40 (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1
lgpl-3.0 40 (?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-2.1-or-later 50 (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1 or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0-or-later 50 (?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
lgpl-2.1-or-later 70 lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
lgpl-2.0-or-later 70 library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
lgpl 70 see the gnu lesser general public licen[sc]e for more details
lgpl 50 you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:library|program)
# gpl
gpl 20 (?:gnu )?gpl
gpl-1.0 40 (?:gnu )?gpl (?:version |v )?1(?: 0)?
gpl-2.0 40 (?:gnu )?gpl (?:version |v )?2(?: 0)?
gpl-2.0 40 (?:gnu )?gpl ?v2(?: 0)?
gpl-2.0 45 (?:gnu )?gpl (?:version |v )?2(?: 0)? only
gpl-2.0-or-later 50 (?:gnu )?gpl (?:version |v ?)?2(?: 0)? or later
gpl-2.0-or-later 50 gpl 2 0 or later
gpl-2.0-or-later 50 gplv2 or later
gpl-3.0 40 (?:gnu )?gpl (?:version |v )?3(?: 0)?
gpl-3.0 40 (?:gnu )?gpl ?v3(?: 0)?
gpl-3.0 45 (?:gnu )?gpl (?:version |v )?3(?: 0)? only
gpl-3.0-or-later 50 (?:gnu )?gpl (?:version |v ?)?3(?: 0)? or later
gpl-3.0-or-later 50 gplv3 or later
gpl-2.0-with-classpath-exception 60 gpl 2 0 with classpath exception(?: 2 0)?
gpl 50 licen[sc]ed under (?:the )?(?:terms of the )?gpl
gpl 50 released under (?:the )?(?:terms of the )?gpl
gpl 50 distributed under (?:the )?(?:terms of the )?gpl
gpl-2.0 60 spdx licen[sc]e identifier gpl 2 0
gpl-2.0 65 spdx licen[sc]e identifier gpl 2 0 only
gpl-2.0-or-later 65 spdx licen[sc]e identifier gpl 2 0 or later
gpl-3.0 60 spdx licen[sc]e identifier gpl 3 0
gpl-3.0 65 spdx licen[sc]e identifier gpl 3 0 only
gpl-3.0-or-later 65 spdx licen[sc]e identifier gpl 3 0 or later
gpl-2.0 50 https? www gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0(?: html| txt)?
gpl-3.0 50 https? www gnu org licen[sc]es gpl 3 0(?: html| txt)?
gpl 45 https? www gnu org licen[sc]es gpl(?: html| txt)?
# lgpl
lgpl 20 (?:gnu )?lgpl
lgpl-2.0 40 (?:gnu )?lgpl (?:version |v )?2(?: 0)?
lgpl-2.0 40 (?:gnu )?lgplv2
lgpl-2.1 40 (?:gnu )?lgpl (?:version |v ?)?2 1
lgpl-2.1 40 (?:gnu )?lgplv2 1
lgpl-2.1 45 (?:gnu )?lgpl (?:version |v ?)?2 1 only
lgpl-2.1-or-later 50 (?:gnu )?lgpl (?:version |v ?)?2 1 or later
lgpl-3.0 40 (?:gnu )?lgpl (?:version |v )?3(?: 0)?
lgpl-3.0 40 (?:gnu )?lgplv3
lgpl-3.0 45 (?:gnu )?lgpl (?:version |v ?)?3(?: 0)? only
lgpl-3.0-or-later 50 (?:gnu )?lgpl (?:version |v ?)?3(?: 0)? or later
lgpl-2.1 60 spdx licen[sc]e identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later 65 spdx licen[sc]e identifier lgpl 2 1 or later
lgpl-3.0 60 spdx licen[sc]e identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later 65 spdx licen[sc]e identifier lgpl 3 0 or later
lgpl 50 licen[sc]ed under (?:the )?lgpl
lgpl 45 https? www gnu org licen[sc]es lgpl(?: html| txt)?
# affero
agpl 20 (?:gnu )?affero general public licen[sc]e
agpl-1.0 40 affero general public licen[sc]e (?:version |v )?1(?: 0)?
agpl-3.0 40 (?:gnu )?affero general public licen[sc]e (?:version |v )?3(?: 0)?
agpl-3.0 40 (?:gnu )?affero general public licen[sc]e v3
agpl-3.0-or-later 50 (?:gnu )?affero general public licen[sc]e (?:version |v )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
agpl-3.0-or-later 70 affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
agpl 70 see the gnu affero general public licen[sc]e for more details
agpl 70 the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
# agpl
agpl 20 (?:gnu )?agpl
agpl-3.0 40 (?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3.0 40 (?:gnu )?agplv3
agpl-3.0-or-later 50 (?:gnu )?agpl (?:version |v ?)?3(?: 0)? or later
agpl-3.0 60 spdx licen[sc]e identifier agpl 3 0(?: only)?
agpl-3.0-or-later 65 spdx licen[sc]e identifier agpl 3 0 or later
# free documentation
gfdl 20 (?:gnu )?free documentation licen[sc]e
gfdl-1.1 40 (?:gnu )?free documentation licen[sc]e (?:version |v )?1 1
gfdl-1.2 40 (?:gnu )?free documentation licen[sc]e (?:version |v )?1 2
gfdl-1.3 40 (?:gnu )?free documentation licen[sc]e (?:version |v )?1 3
gfdl-1.3-or-later 50 (?:gnu )?free documentation licen[sc]e (?:version |v )?1 3 or any later version
gfdl-1.2-or-later 50 (?:gnu )?free documentation licen[sc]e (?:version |v )?1 2 or any later version
gfdl 70 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl 70 with no invariant sections no front cover texts and no back cover texts a copy of the licen[sc]e is included in the section entitled gnu free documentation licen[sc]e
# apache
apache 20 (?:the )?apache licen[sc]e
apache 20 (?:the )?apache software licen[sc]e
apache-1.0 40 apache (?:software )?licen[sc]e (?:version |v ?)?1 0
apache-1.1 40 apache (?:software )?licen[sc]e (?:version |v ?)?1 1
apache-2.0 40 apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?
apache-2.0 40 apache 2 0(?: licen[sc]e)?
apache-2.0 45 licen[sc]ed under the apache licen[sc]e version 2 0
apache-2.0 50 licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
apache-2.0 50 https? www apache org licen[sc]es licen[sc]e 2 0(?: html| txt)?
apache-2.0 70 apache licen[sc]e version 2 0 january 2004
apache-2.0 60 spdx licen[sc]e identifier apache 2 0
apache-1.1 60 spdx licen[sc]e identifier apache 1 1
apache-1.1 70 this product includes software developed by the apache software foundation
apache 50 licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache 45 released under the apache licen[sc]e
apache-2.0 45 dual licen[sc]ed under apache 2 0
# you may not use this file
apache-2.0 70 you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at
# distributed on an
apache-2.0 70 distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind
# mozilla
mpl 20 mozilla public licen[sc]e
mpl-1.0 40 mozilla public licen[sc]e (?:version |v ?)?1 0
mpl-1.1 40 mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-2.0 40 mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
mpl-2.0 70 this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1 70 the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2.0 50 https? mozilla org mpl 2 0
mpl-1.1 50 https? www mozilla org mpl
# mpl
mpl 20 mpl
mpl-1.0 40 mpl (?:version |v ?)?1 0
mpl-1.1 40 mpl (?:version |v ?)?1 1
mpl-2.0 40 mpl (?:version |v ?)?2 0
mpl-2.0 45 mpl 2 0 no copyleft exception
mpl-1.1 60 spdx licen[sc]e identifier mpl 1 1
mpl-2.0 60 spdx licen[sc]e identifier mpl 2 0
mpl-1.1 50 version mpl 1 1 gpl 2 0 lgpl 2 1
# eclipse
epl 20 eclipse public licen[sc]e
epl-1.0 40 eclipse public licen[sc]e (?:version |v ?)?1 0
epl-2.0 40 eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
edl-1.0 40 eclipse distribution licen[sc]e (?:version |v ?)?1 0
epl-2.0 70 this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2 0
epl-1.0 70 made available under the terms of the eclipse public licen[sc]e v1 0
# epl
epl 20 epl
epl-1.0 40 epl (?:version |v ?)?1 0
epl-2.0 40 epl (?:version |v ?)?2 0
epl-1.0 60 spdx licen[sc]e identifier epl 1 0
epl-2.0 60 spdx licen[sc]e identifier epl 2 0
# development and distribution
cddl 20 common development and distribution licen[sc]e
cddl-1.0 40 common development and distribution licen[sc]e (?:cddl )?(?:version |v ?)?1 0
cddl-1.1 40 common development and distribution licen[sc]e (?:cddl )?(?:version |v ?)?1 1
cddl 70 the contents of this file are subject to the terms of the common development and distribution licen[sc]e
# cddl
cddl 20 cddl
cddl-1.0 40 cddl (?:version |v ?)?1 0
cddl-1.1 40 cddl (?:version |v ?)?1 1
cddl-1.0 60 spdx licen[sc]e identifier cddl 1 0
# common public
cpl-1.0 40 common public licen[sc]e(?: version)? 1 0
cpl 20 common public licen[sc]e
cpal-1.0 40 common public attribution licen[sc]e(?: version)? 1 0
# european union
eupl 20 european union public licen[sc]e
eupl-1.0 40 european union public licen[sc]e (?:version |v ?)?1 0
eupl-1.1 40 european union public licen[sc]e (?:version |v ?)?1 1
eupl-1.2 40 european union public licen[sc]e (?:version |v ?)?1 2
eupl-1.2 70 licen[sc]ed under the european union public licen[sc]e eupl v 1 2 only
# eupl
eupl 20 eupl
eupl-1.1 40 eupl (?:version |v ?)?1 1
eupl-1.2 40 eupl (?:version |v ?)?1 2
eupl-1.2 60 spdx licen[sc]e identifier eupl 1 2
# open software
osl 20 open software licen[sc]e
osl-1.0 40 open software licen[sc]e (?:version |v ?)?1 0
osl-2.0 40 open software licen[sc]e (?:version |v ?)?2 0
osl-2.1 40 open software licen[sc]e (?:version |v ?)?2 1
osl-3.0 40 open software licen[sc]e (?:version |v ?)?3 0
osl-3.0 45 open software licen[sc]e osl 3 0
# academic free
afl 20 academic free licen[sc]e
afl-1.2 40 academic free licen[sc]e (?:version |v ?)?1 2
afl-2.0 40 academic free licen[sc]e (?:version |v ?)?2 0
afl-2.1 40 academic free licen[sc]e (?:version |v ?)?2 1
afl-3.0 40 academic free licen[sc]e (?:version |v ?)?3 0
afl-3.0 70 licen[sc]ed under the academic free licen[sc]e version 3 0
# artistic
artistic 20 (?:the )?artistic licen[sc]e
artistic-1.0 40 artistic licen[sc]e (?:version |v ?)?1 0
artistic-2.0 40 artistic licen[sc]e (?:version |v ?)?2 0
artistic-1.0-perl 45 (?:the )?perl artistic licen[sc]e
artistic-1.0 60 spdx licen[sc]e identifier artistic 1 0
artistic-2.0 60 spdx licen[sc]e identifier artistic 2 0
# boost
bsl-1.0 30 boost software licen[sc]e
bsl-1.0 40 boost software licen[sc]e (?:version |v ?)?1 0
bsl-1.0 70 boost software licen[sc]e version 1 0 august 17th 2003
bsl-1.0 50 distributed under the boost software licen[sc]e version 1 0
# bsl
bsl-1.0 60 spdx licen[sc]e identifier bsl 1 0
# business source
busl 20 business source licen[sc]e
busl-1.1 40 business source licen[sc]e 1 1
# server side public
sspl 20 server side public licen[sc]e
sspl-1.0 40 server side public licen[sc]e (?:version |v ?)?1
# elastic
elastic-2.0 40 elastic licen[sc]e (?:version |v ?)?2(?: 0)?
elastic 20 elastic licen[sc]e
# cecill
cecill 20 cecill(?: licen[sc]e)?
cecill-1.0 40 cecill (?:licen[sc]e )?(?:version |v ?)?1 0
cecill-2.0 40 cecill (?:licen[sc]e )?(?:version |v ?)?2 0
cecill-2.1 40 cecill (?:licen[sc]e )?(?:version |v ?)?2 1
cecill-b 40 cecill b(?: licen[sc]e)?
cecill-c 40 cecill c(?: licen[sc]e)?
cecill-2.1 60 spdx licen[sc]e identifier cecill 2 1
# php
php 20 php licen[sc]e
php-3.0 40 php licen[sc]e (?:version |v ?)?3 0
php-3.01 40 php licen[sc]e (?:version |v ?)?3 01
php-3.01 70 this product includes php software freely available from https? www php net software
# python
psf 20 python software foundation licen[sc]e
psf 30 python licen[sc]e
psf-2.0 40 python software foundation licen[sc]e (?:version |v ?)?2
# under the same terms
perl 50 under the same terms as perl itself
ruby 45 under the same terms as ruby(?: itself)?
# ruby
ruby 30 (?:the )?ruby licen[sc]e
# latex
lppl 20 latex project public licen[sc]e
lppl-1.3c 40 latex project public licen[sc]e (?:version |v ?)?1 3c
lppl-1.3 70 this work may be distributed and or modified under the conditions of the latex project public licen[sc]e
# microsoft
ms-pl 40 microsoft public licen[sc]e
ms-rl 40 microsoft reciprocal licen[sc]e
ms-eula 40 microsoft software licen[sc]e terms
# open font
ofl 20 (?:sil )?open font licen[sc]e
ofl-1.0 40 (?:sil )?open font licen[sc]e (?:version |v ?)?1 0
ofl-1.1 40 (?:sil )?open font licen[sc]e (?:version |v ?)?1 1
ofl-1.1 70 this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1
# open database
odbl 20 (?:open data commons )?open database licen[sc]e
odbl-1.0 40 (?:open data commons )?open database licen[sc]e (?:odbl )?(?:version |v ?)?1 0
odbl-1.0 70 this database is made available under the open database licen[sc]e
# open data commons
odc-by-1.0 40 open data commons attribution licen[sc]e(?: v1 0)?
pddl-1.0 40 open data commons public domain dedication and licen[sc]e
# community data
cdla-permissive 40 community data licen[sc]e agreement permissive
cdla-sharing 40 community data licen[sc]e agreement sharing
# open government
ogl 20 open government licen[sc]e
ogl-2.0 40 open government licen[sc]e (?:version |v ?)?2 0
ogl-3.0 40 open government licen[sc]e (?:version |v ?)?3 0
# open game
ogl-1.0a 40 open game licen[sc]e version 1 0a
# cc
cc-by 20 cc by
cc-by-sa 20 cc by sa
cc-by-nc 20 cc by nc
cc-by-nd 20 cc by nd
cc-by-nc-sa 20 cc by nc sa
cc-by-nc-nd 20 cc by nc nd
cc-by-1.0 40 cc by 1 0
cc-by-2.0 40 cc by 2 0
cc-by-2.5 40 cc by 2 5
cc-by-3.0 40 cc by 3 0(?: unported)?
cc-by-4.0 40 cc by 4 0(?: international)?
cc-by-sa-1.0 40 cc by sa 1 0
cc-by-sa-2.0 40 cc by sa 2 0
cc-by-sa-2.5 40 cc by sa 2 5
cc-by-sa-3.0 40 cc by sa 3 0(?: unported)?
cc-by-sa-4.0 40 cc by sa 4 0(?: international)?
cc-by-nc-2.0 40 cc by nc 2 0
cc-by-nc-2.5 40 cc by nc 2 5
cc-by-nc-3.0 40 cc by nc 3 0(?: unported)?
cc-by-nc-4.0 40 cc by nc 4 0(?: international)?
cc-by-nd-2.0 40 cc by nd 2 0
cc-by-nd-3.0 40 cc by nd 3 0(?: unported)?
cc-by-nd-4.0 40 cc by nd 4 0(?: international)?
cc-by-nc-sa-2.0 40 cc by nc sa 2 0
cc-by-nc-sa-3.0 40 cc by nc sa 3 0(?: unported)?
cc-by-nc-sa-4.0 40 cc by nc sa 4 0(?: international)?
cc-by-nc-nd-2.0 40 cc by nc nd 2 0
cc-by-nc-nd-3.0 40 cc by nc nd 3 0(?: unported)?
cc-by-nc-nd-4.0 40 cc by nc nd 4 0(?: international)?
cc-by-4.0 60 spdx licen[sc]e identifier cc by 4 0
cc-by-sa-4.0 60 spdx licen[sc]e identifier cc by sa 4 0
cc-by-nc-4.0 60 spdx licen[sc]e identifier cc by nc 4 0
# cc0
cc0-1.0 30 cc0
cc0-1.0 40 cc0 1 0(?: universal)?
cc0-1.0 50 cc0 1 0 universal public domain dedication
cc0-1.0 60 spdx licen[sc]e identifier cc0 1 0
# creative commons
cc 15 creative commons(?: licen[sc]e)?
cc-by 20 creative commons attribution(?: licen[sc]e)?
cc-by-sa 20 creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nc 20 creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nd 20 creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?
cc-by-nc-sa 20 creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc-nd 20 creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)?
cc-by-2.0 40 creative commons attribution 2 0(?: generic)?(?: licen[sc]e)?
cc-by-2.5 40 creative commons attribution 2 5(?: generic)?(?: licen[sc]e)?
cc-by-3.0 40 creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-4.0 40 creative commons attribution 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-sa-2.0 40 creative commons attribution share ?alike 2 0(?: generic)?(?: licen[sc]e)?
cc-by-sa-2.5 40 creative commons attribution share ?alike 2 5(?: generic)?(?: licen[sc]e)?
cc-by-sa-3.0 40 creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-4.0 40 creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-3.0 40 creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-4.0 40 creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nd-3.0 40 creative commons attribution no ?deriv(?:ative)?s 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nd-4.0 40 creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-sa-3.0 40 creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-sa-4.0 40 creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-nd-3.0 40 creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-nd-4.0 40 creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc0-1.0 40 creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc 50 this work is licen[sc]ed under a creative commons
# creativecommons org
cc-by-2.0 50 https? creativecommons org licen[sc]es by 2 0
cc-by-3.0 50 https? creativecommons org licen[sc]es by 3 0
cc-by-4.0 50 https? creativecommons org licen[sc]es by 4 0
cc-by-sa-3.0 50 https? creativecommons org licen[sc]es by sa 3 0
cc-by-sa-4.0 50 https? creativecommons org licen[sc]es by sa 4 0
cc-by-nc-4.0 50 https? creativecommons org licen[sc]es by nc 4 0
cc-by-nd-4.0 50 https? creativecommons org licen[sc]es by nd 4 0
cc-by-nc-sa-4.0 50 https? creativecommons org licen[sc]es by nc sa 4 0
cc-by-nc-nd-4.0 50 https? creativecommons org licen[sc]es by nc nd 4 0
cc0-1.0 50 https? creativecommons org publicdomain zero 1 0
# mit
mit 30 (?:the )?mit licen[sc]e
mit 30 (?:the )?mit x11 licen[sc]e
mit 40 (?:the )?expat licen[sc]e mit
mit 45 licen[sc]ed under (?:the )?mit(?: licen[sc]e)?
mit 45 released under (?:the )?mit(?: licen[sc]e)?
mit 45 distributed under (?:the )?mit(?: licen[sc]e)?
mit 45 available under (?:the )?mit(?: licen[sc]e)?
mit 50 https? opensource org licen[sc]es mit
mit 60 spdx licen[sc]e identifier mit
mit-0 40 mit no attribution(?: licen[sc]e)?
mit-0 60 spdx licen[sc]e identifier mit 0
# permission is hereby granted
mit 70 permission is hereby granted free of charge to any person obtaining a copy
mit 75 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
bsl-1.0 75 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ofl-1.1 75 permission is hereby granted free of charge to any person obtaining a copy of the font software
# the above copyright notice
mit 70 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
# the software is provided
mit 70 the software is provided as is without warranty of any kind express or implied
isc 70 the software is provided as is and the author disclaims all warranties with regard to this software
# isc
isc 30 (?:the )?isc licen[sc]e
isc 45 licen[sc]ed under (?:the )?isc(?: licen[sc]e)?
isc 50 https? opensource org licen[sc]es isc
isc 60 spdx licen[sc]e identifier isc
# permission to use
isc 70 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 65 permission to use copy modify and or distribute this software for any purpose
hpnd 65 permission to use copy modify and distribute this software and its documentation for any purpose
# bsd
bsd 30 (?:the )?bsd licen[sc]e
bsd-3-clause 40 (?:the )?(?:new|modified|revised) bsd licen[sc]e
bsd-2-clause 40 (?:the )?(?:simplified|freebsd) bsd licen[sc]e
bsd-4-clause 40 (?:the )?original bsd licen[sc]e
bsd-1-clause 40 (?:bsd 1 clause|1 clause bsd)(?: licen[sc]e)?
bsd-2-clause 40 (?:bsd 2 clause|2 clause bsd)(?: licen[sc]e)?
bsd-3-clause 40 (?:bsd 3 clause|3 clause bsd)(?: licen[sc]e)?
bsd-4-clause 40 (?:bsd 4 clause|4 clause bsd)(?: licen[sc]e)?
0bsd 40 (?:0bsd|zero clause bsd)(?: licen[sc]e)?
bsd 45 (?:licen[sc]ed|released|distributed) under (?:the )?bsd(?: licen[sc]e)?
bsd 45 (?:licen[sc]ed|released|distributed) under a bsd style licen[sc]e
bsd-2-clause 60 spdx licen[sc]e identifier bsd 2 clause
bsd-3-clause 60 spdx licen[sc]e identifier bsd 3 clause
0bsd 60 spdx licen[sc]e identifier 0bsd
bsd-3-clause 50 https? opensource org licen[sc]es bsd 3 clause
bsd-2-clause 50 https? opensource org licen[sc]es bsd 2 clause
# redistribution and use
bsd 70 redistribution and use in source and binary forms with or without modification
bsd 75 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
# redistributions
bsd 70 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 70 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
# neither the name
bsd-3-clause 70 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
# all advertising materials
bsd-4-clause 70 all advertising materials mentioning features or use of this software must display the following acknowledgement
# zlib
zlib 30 (?:the )?zlib licen[sc]e
zlib 40 (?:the )?zlib libpng licen[sc]e
zlib 60 spdx licen[sc]e identifier zlib
# in no event will the authors
zlib 70 in no event will the authors be held liable for any damages arising from the use of this software
# libpng
libpng 30 libpng licen[sc]e
# unlicense
unlicense 30 (?:the )?unlicense
unlicense 45 (?:licen[sc]ed|released) under (?:the )?unlicense
unlicense 60 spdx licen[sc]e identifier unlicense
# free and unencumbered
unlicense 70 this is free and unencumbered software released into the public domain
# wtfpl
wtfpl 30 wtfpl
wtfpl 60 spdx licen[sc]e identifier wtfpl
# what the
wtfpl 40 do what the fuck you want to public licen[sc]e
# beerware
beerware 30 beerware(?: licen[sc]e)?
# w3c
w3c 30 w3c software (?:notice and )?licen[sc]e
# openssl
openssl 30 openssl licen[sc]e
# vim
vim 30 vim licen[sc]e
# x11
x11 30 x11 licen[sc]e
# unicode
unicode-dfs 30 unicode licen[sc]e agreement
# ncsa
ncsa 30 ncsa open source licen[sc]e
ncsa 40 university of illinois ncsa open source licen[sc]e
# public domain
public-domain 30 (?:released|placed|dedicated)(?: in| into| to)? the public domain
public-domain 25 in the public domain
public-domain 30 public domain dedication
# disclaims copyright
public-domain 45 the author hereby disclaims copyright to this source code
# all rights reserved
proprietary 30 all rights reserved
# proprietary
proprietary 35 proprietary and confidential
proprietary 35 confidential and proprietary
proprietary 30 proprietary licen[sc]e
# unauthorized copying
proprietary 35 unauthorized copying of this file via any medium is strictly prohibited
# may not be reproduced
proprietary 30 may not be reproduced without (?:prior )?written permission
# licensed under
unknown-license 10 licensed under(?: the)?
# released under
unknown-license 10 released under(?: the)?
# distributed under
unknown-license 10 distributed under(?: the)?
# spdx
busl-1.1 60 spdx licen[sc]e identifier busl 1 1
ofl-1.1 60 spdx licen[sc]e identifier ofl 1 1
osl-3.0 60 spdx licen[sc]e identifier osl 3 0
psf-2.0 60 spdx licen[sc]e identifier (?:psf|python) 2 0
unknown-license 12 spdx licen[sc]e identifier
"""


def families() -> dict[str, list[tuple[str, int, str]]]:
    """keyword: label, priority and regex of its rules."""
    out: dict[str, list[tuple[str, int, str]]] = {}
    keyword = ""
    for line in _RULES.strip().splitlines():
        if line.startswith("# "):
            keyword = line[2:]
        else:
            label, priority, rx = line.split(" ", 2)
            out.setdefault(keyword, []).append((label, int(priority), rx))
    return out


def most_words() -> int:
    """An upper bound of the words of any match; nothing in a regex repeats, so its spaces bound them."""
    return max(rx.count(" ") for rules in families().values() for *_, rx in rules) + 1
