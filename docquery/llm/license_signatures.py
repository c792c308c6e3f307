"""Signatures of licenses, written for this package: label, how sure a match is (in percent), and a pattern.

A pattern is read on a text's lower-cased words joined by single spaces, and matches whole words. The first part holds
sentences of license texts and of their notices, the second header lines and exceptions, the third version wordings.
"""

SIGNATURES = r"""
mit | 97 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 95 | permission is hereby granted free of charge to any person obtaining a copy
mit | 90 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | 88 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 80 | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
x11 | 90 | except as contained in this notice the name of (?:\S+ ){1,8}shall not be used in advertising or otherwise to promote the sale
mit-0 | 92 | mit no attribution(?: licen[cs]e)?
mit-cmu | 88 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | 86 | permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted without fee
hpnd | 80 | provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
isc | 95 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 85 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
isc | 90 | permission to use copy modify and or distribute this software for any purpose
isc | 78 | the software is provided as is and the author disclaims all warranties with regard to this software
bsd | 95 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 93 | redistribution and use in source and binary forms with or without modification
bsd-2-clause | 84 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 84 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3-clause | 93 | neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-3-clause | 88 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 95 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 85 | this product includes software developed by the university of california berkeley and its contributors
bsd-2-clause-views | 90 | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3-clause-clear | 92 | no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e
bsd-protection | 85 | bsd protection licen[cs]e
bsd-1-clause | 85 | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
bsd-source-code | 80 | bsd source code attribution
apache | 95 | licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache | 92 | you may not use this file except in compliance with the licen[cs]e
apache | 90 | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache | 90 | see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
apache | 88 | you may obtain a copy of the licen[cs]e at (?:https? )?www apache org licen[cs]es
apache | 86 | contributor licen[cs]e agreements see the notice file distributed with this work for additional information regarding copyright ownership
apache | 85 | grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you a perpetual worldwide
apache-1.1 | 88 | this product includes software developed by the apache software foundation
apache-1.1 | 80 | products derived from this software may not be called apache nor may apache appear in their name
gpl | 95 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | 92 | you should have received a copy of the gnu general public licen[cs]e along with this program
gpl | 88 | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gpl | 86 | the licen[cs]es for most software are designed to take away your freedom to share and change it
gpl | 85 | you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl | 82 | the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gpl | 80 | (?:it is|is) distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e
gpl-2.0 | 92 | as published by the free software foundation version 2 of the licen[cs]e
gpl-2.0-or-later | 94 | as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3.0 | 92 | as published by the free software foundation version 3 of the licen[cs]e
gpl-3.0-or-later | 94 | as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-1.0 | 88 | as published by the free software foundation either version 1 or at your option any later version
lgpl | 95 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl | 92 | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)
lgpl | 85 | this licen[cs]e the lesser general public licen[cs]e applies to some specially designated software packages typically libraries
lgpl-2.1-or-later | 94 | licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
agpl | 95 | under the terms of the gnu affero general public licen[cs]e as published by the free software foundation
agpl | 90 | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl | 85 | the gnu affero general public licen[cs]e is designed specifically to ensure that
gfdl | 94 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl | 85 | with no invariant sections no front cover texts and no back cover texts
mpl | 96 | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl | 90 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl | 90 | the contents of this file are subject to the mozilla public licen[cs]e version
mpl-2.0-no-copyleft-exception | 92 | this source code form is incompatible with secondary licen[cs]es
npl | 88 | the contents of this file are subject to the netscape public licen[cs]e
epl | 95 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
epl | 85 | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
edl | 90 | made available under the terms of the eclipse distribution licen[cs]e
cddl | 94 | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl | 88 | when distributing covered code include this cddl header in each file
cpl | 88 | the accompanying program is provided under the terms of this common public licen[cs]e
ipl | 86 | ibm public licen[cs]e(?: version 1 0)?
eupl | 94 | licen[cs]ed under the eupl(?: version 1 [012])?
eupl | 85 | the european union public licen[cs]e the eupl applies to the work
cecill | 90 | this software is governed by the cecill(?: [bc])? licen[cs]e under french law
cecill | 80 | cecill(?: [bc])?(?: free software)? licen[cs]e
artistic | 88 | the intent of this document is to state the conditions under which a package may be copied
artistic | 84 | you may make and give away verbatim copies of the (?:source form|standard version) of (?:the|this) package without restriction
perl | 86 | you can redistribute it and or modify it under the same terms as perl itself
clarified-artistic | 84 | clarified artistic licen[cs]e
zlib | 95 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | 92 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 85 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | 86 | the png reference library is supplied as is
libpng | 84 | libpng versions (?:\S+ ){1,12}are copyright
boost | 95 | distributed under the boost software licen[cs]e version 1 0
boost | 90 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
unlicense | 96 | this is free and unencumbered software released into the public domain
unlicense | 88 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 94 | you just do what the fuck you want to
wtfpl | 92 | do what the fuck you want to public licen[cs]e
beerware | 92 | if we meet some day and you think this stuff is worth it you can buy me a beer
beerware | 88 | the beer ?ware licen[cs]e
python | 90 | psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e to reproduce analyze test
python | 86 | python software foundation licen[cs]e version 2
cnri-python | 84 | cnri(?: open source)? licen[cs]e agreement
php | 90 | this source file is subject to version (?:2 02|3 0|3 01) of the php licen[cs]e
zend | 86 | this source file is subject to version 2 0 0 of the zend licen[cs]e
ruby | 84 | you may distribute the software in object code or binary form provided that you do at least one of the following
openssl | 90 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 90 | this product includes cryptographic software written by eric young
ssleay | 84 | ssleay licen[cs]e
postgresql | 88 | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ofl | 95 | this font software is licen[cs]ed under the sil open font licen[cs]e
ofl | 86 | the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects
ofl | 82 | reserved font names?
bitstream-vera | 88 | bitstream vera is a trademark of bitstream inc
ubuntu-font | 88 | ubuntu font licen[cs]e
ms-pl | 90 | this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
ms-rl | 85 | microsoft reciprocal licen[cs]e
upl | 90 | the universal permissive licen[cs]e
upl | 84 | to make have made use offer to sell sell import transfer the software and any larger works
ncsa | 88 | university of illinois ncsa open source licen[cs]e
ncsa | 84 | to deal with the software without restriction including without limitation the rights to use copy modify merge publish
osl | 90 | licen[cs]ed under the open software licen[cs]e version [123]
afl | 90 | licen[cs]ed under the academic free licen[cs]e version [123]
odbl | 92 | made available under the open database licen[cs]e
odbl | 84 | any rights in individual contents of the database are licen[cs]ed under the database contents licen[cs]e
odc-by | 88 | open data commons attribution licen[cs]e
pddl | 88 | open data commons public domain dedication and licen[cs]e
cdla-permissive | 88 | community data licen[cs]e agreement permissive
cdla-sharing | 88 | community data licen[cs]e agreement sharing
busl | 92 | use of this software is governed by the business source licen[cs]e
busl | 86 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
sspl | 92 | under the terms of the server side public licen[cs]e
sspl | 84 | if you make the functionality of the program or a modified version available to third parties as a service
elastic | 90 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 92 | commons clause licen[cs]e condition
commons-clause | 86 | the licen[cs]e does not grant to you the right to sell the software
polyform-noncommercial | 90 | polyform noncommercial licen[cs]e
polyform-small-business | 90 | polyform small business licen[cs]e
confluent-community | 88 | confluent community licen[cs]e
redis-source-available | 88 | redis source available licen[cs]e
mariadb-busl | 80 | mariadb business source licen[cs]e
blueoak | 92 | blue oak model licen[cs]e
mulan-psl | 90 | mulan (?:psl|permissive software licen[cs]e)
cc0 | 95 | to the extent possible under law (?:\S+ ){1,12}(?:has|have) waived all copyright and related or neighbou?ring rights
cc0 | 88 | cc0 1 0 universal(?: public domain dedication)?
cc-by | 92 | this work is licen[cs]ed under a creative commons attribution (?:[1-4] [05] )?(?:international |unported |generic )?licen[cs]e
cc-by-sa | 94 | this work is licen[cs]ed under a creative commons attribution share ?alike
cc-by-nc | 94 | this work is licen[cs]ed under a creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international |unported |generic )?licen[cs]e
cc-by-nc-sa | 94 | this work is licen[cs]ed under a creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | 94 | this work is licen[cs]ed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nd | 94 | this work is licen[cs]ed under a creative commons attribution no ?deriv(?:ative)?s
cc-by-sa | 88 | text is available under the creative commons attribution share ?alike licen[cs]e
cc-by | 86 | creativecommons org licen[cs]es by [1-4] [05]
cc-by-sa | 86 | creativecommons org licen[cs]es by sa [1-4] [05]
cc-by-nc | 86 | creativecommons org licen[cs]es by nc [1-4] [05]
cc-by-nc-sa | 86 | creativecommons org licen[cs]es by nc sa [1-4] [05]
cc-by-nd | 86 | creativecommons org licen[cs]es by nd [1-4] [05]
cc-by-nc-nd | 86 | creativecommons org licen[cs]es by nc nd [1-4] [05]
cc0 | 86 | creativecommons org publicdomain zero 1 0
public-domain | 86 | creativecommons org publicdomain mark 1 0
public-domain | 88 | the author disclaims copyright to this source code in place of a legal notice here is a blessing
public-domain | 84 | (?:placed|released|put|dedicated) (?:in|into|to) the public domain
public-domain | 80 | this (?:work|file|software|code|text) is in the public domain
public-domain | 70 | in the public domain
us-government-work | 82 | work of the (?:united states|u s) government
open-government | 88 | open government licen[cs]e(?: v?[123] 0)?
open-parliament | 84 | open parliament licen[cs]e
etalab | 84 | licence ouverte(?: open licen[cs]e)?
w3c | 90 | w3c software (?:notice and licen[cs]e|and document notice and licen[cs]e)
w3c | 84 | this work is being provided by the copyright holders under the following licen[cs]e
icu | 84 | icu licen[cs]e icu 1 8 1 and later
unicode | 88 | unicode (?:data files and software|licen[cs]e agreement data files and software|inc licen[cs]e agreement)
curl | 84 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
ntp | 78 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
sleepycat | 88 | sleepycat (?:software|licen[cs]e)
intel | 84 | intel simplified software licen[cs]e
nvidia | 82 | nvidia (?:software|source code) licen[cs]e
amd | 80 | amd plpa map c licen[cs]e
json | 92 | the software shall be used for good not evil
vim | 88 | vim licen[cs]e
tcl | 84 | tcl tk licen[cs]e
lppl | 92 | this work may be distributed and or modified under the conditions of the latex project public licen[cs]e
lppl | 84 | latex project public licen[cs]e
qpl | 86 | q public licen[cs]e
sun | 80 | sun (?:industry standards source|public) licen[cs]e
apple | 86 | apple public source licen[cs]e
nokia | 82 | nokia open source licen[cs]e
nasa | 84 | nasa open source agreement
reciprocal | 84 | reciprocal public licen[cs]e
cua | 80 | cua office public licen[cs]e
cpal | 84 | common public attribution licen[cs]e
motosoto | 78 | motosoto open source licen[cs]e
ecl | 84 | educational community licen[cs]e
simple-pl | 80 | simple public licen[cs]e
llama | 88 | llama [234](?: [0-9])? community licen[cs]e
gemma | 84 | gemma terms of use
openrail | 88 | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
openrail | 86 | (?:creativeml |bigscience )?open rail (?:m )?licen[cs]e
classpath-exception | 94 | linking this library statically or dynamically with other modules is making a combined work based on this library
classpath-exception | 90 | (?:with|gnu) classpath exception
autoconf-exception | 88 | as a special exception (?:\S+ ){1,20}configure script generated by autoconf
bison-exception | 88 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gcc-exception | 90 | gcc runtime library exception
linux-syscall-note | 90 | this copyright does not cover user programs that use kernel services by normal system calls
llvm-exception | 92 | (?:with|apache 2 0 with) llvm exceptions?
font-exception | 88 | as a special exception if you create a document which uses this font
openssl-exception | 86 | permission to link (?:the code of )?(?:\S+ ){1,8}with the openssl library
qt-exception | 84 | (?:qt|digia qt|nokia qt) lgpl exception
swi-exception | 80 | as a special exception if you link this library with other files compiled with
universal-foss-exception | 86 | universal foss exception
dual-license | 78 | (?:dual|double) licen[cs]ed under (?:the )?(?:\S+ ){1,4}(?:and|or)
multi-license | 76 | at your option (?:either|any) of the following licen[cs]es
commercial | 74 | (?:available under|requires|obtain|purchase) a commercial licen[cs]e
proprietary | 84 | this software is (?:the )?(?:confidential and )?proprietary(?: information)?
proprietary | 78 | unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:\S+ ){0,8}is strictly prohibited
proprietary | 76 | no part of this (?:publication|document|work|book) may be reproduced
proprietary | 74 | licen[cs]ed to you and not sold
proprietary | 72 | end user licen[cs]e agreement
proprietary | 40 | all rights reserved
"""


def signatures() -> list[tuple[str, float, str]]:
    """Label, sureness and pattern of every signature, in order."""
    rows = [line.split(" | ", 2) for line in SIGNATURES.strip().split("\n")]
    return [(label, int(sure) / 100, pattern) for label, sure, pattern in rows]
