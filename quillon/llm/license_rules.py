"""Signature rules of the license scan, by hand.

A text is seen as its lower-case words with single spaces between them, so
"GPL-2.0" reads "gpl 2 0".  RULES has, by family, lines of

    priority | label | keyword | regex

where the keyword must occur for the regex to be tried, and the regex stands
between spaces.  Of two detections, one inside the other, the one of higher
priority stays; see licenses.py.
"""

from __future__ import annotations

FAMILIES = r"""
30 | mit | mit license | mit license
30 | apache | apache license | apache license
30 | gpl | general public license | general public license
60 | mit | mit license | (?:the )?mit license mit
60 | mit | mit license | (?:licensed|released|distributed|available|subject) (?:under|to) (?:the )?(?:terms of the )?mit license
55 | mit | expat license | expat license
55 | mit | mit x11 | mit x11(?: license)?
55 | x11 | x11 license | x11 license
80 | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
70 | mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
65 | mit | the software is provided as is without warranty of any kind | the software is provided as is without warranty of any kind express or implied
70 | mit-0 | mit no attribution | mit no attribution(?: license)?
70 | mit-0 | mit 0 | (?:license |identifier )mit 0
75 | mit | spdx license identifier | spdx license identifier mit
70 | mit-advertising | all advertising materials | all advertising materials (?:mentioning )?enlightenment
70 | mit-cmu | cmu license | cmu license
50 | apache | apache software license | apache software license
70 | apache-1.0 | apache | apache (?:software )?license (?:version )?1 0
70 | apache-1.1 | apache | apache (?:software )?license (?:version )?1 1
70 | apache-2.0 | apache | apache (?:software )?license (?:version |v )?2(?: 0)?
70 | apache-2.0 | apache | apache (?:software )?license v2(?: 0)?
70 | apache-2.0 | apache | apache 2 0(?: license)?
70 | apache-2.0 | asl 2 0 | asl 2 0
75 | apache-2.0 | spdx license identifier | spdx license identifier apache 2 0
80 | apache-2.0 | you may not use this file except in compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance
75 | apache-2.0 | apache org licenses license 2 0 | apache org licenses license 2 0
60 | apache | apache license | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?apache license
60 | apache-2.0 | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
50 | gpl | gnu general public license | gnu general public license
50 | gpl | gnu gpl | gnu gpl
70 | gpl-1.0 | general public license | (?:gnu )?general public license (?:version |v )?1(?: 0)?
70 | gpl-2.0 | general public license | (?:gnu )?general public license (?:version |v )?2(?: 0)?
70 | gpl-3.0 | general public license | (?:gnu )?general public license (?:version |v )?3(?: 0)?
70 | gpl-2.0 | general public license | (?:gnu )?general public license v2(?: 0)?
70 | gpl-3.0 | general public license | (?:gnu )?general public license v3(?: 0)?
80 | gpl-2.0-or-later | either version 2 of the license | either version 2 of the license or (?:at your option )?any later version
80 | gpl-3.0-or-later | either version 3 of the license | either version 3 of the license or (?:at your option )?any later version
75 | gpl-2.0 | gpl | gpl ?v?2(?: 0)?(?: only)?
75 | gpl-3.0 | gpl | gpl ?v?3(?: 0)?(?: only)?
78 | gpl-2.0-or-later | gpl | gpl ?v?2(?: 0)? (?:or later|plus)
78 | gpl-3.0-or-later | gpl | gpl ?v?3(?: 0)? (?:or later|plus)
60 | gpl | general public license | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?general public license
60 | gpl | general public license | under the terms of the (?:gnu )?general public license
65 | gpl | gnu org licenses gpl | gnu org licenses gpl(?: html| txt)?
72 | gpl-3.0 | gnu org licenses gpl 3 0 | gnu org licenses gpl 3 0(?: html| txt)?
72 | gpl-2.0 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
82 | gpl-2.0-classpath | classpath exception | (?:gpl (?:v?2 )?)?(?:with (?:the )?)?classpath exception
82 | gpl-linking-exception | linking exception | (?:gpl )?(?:with )?linking exception
82 | gpl-font-exception | font exception | (?:gpl )?(?:with )?font exception
82 | gcc-exception | gcc runtime library exception | gcc runtime library exception(?: version)?(?: 3 1)?
82 | bison-exception | bison exception | bison exception(?: 2 2)?
60 | lgpl | lesser general public license | (?:gnu )?lesser general public license
60 | lgpl | library general public license | (?:gnu )?library general public license
75 | lgpl-2.0 | library general public license | (?:gnu )?library general public license (?:version |v )?2(?: 0)?
75 | lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )?2 1
75 | lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )?3(?: 0)?
77 | lgpl-2.1 | lgpl | lgpl ?v?2 1(?: only)?
77 | lgpl-3.0 | lgpl | lgpl ?v?3(?: 0)?(?: only)?
77 | lgpl-2.0 | lgpl | lgpl ?v?2 0(?: only)?
79 | lgpl-2.1-or-later | lgpl | lgpl ?v?2 1 or later
79 | lgpl-3.0-or-later | lgpl | lgpl ?v?3(?: 0)? or later
80 | lgpl-2.1-or-later | either version 2 1 of the license | either version 2 1 of the license or (?:at your option )?any later version
50 | lgpl | gnu lgpl | gnu lgpl
60 | agpl | affero general public license | (?:gnu )?affero general public license
75 | agpl-1.0 | affero general public license | affero general public license (?:version |v )?1(?: 0)?
75 | agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:version |v )?3(?: 0)?
77 | agpl-3.0 | agpl | agpl ?v?3(?: 0)?(?: only| or later)?
50 | agpl | gnu agpl | gnu agpl
60 | gfdl | free documentation license | (?:gnu )?free documentation license
75 | gfdl-1.1 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 1
75 | gfdl-1.2 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 2
75 | gfdl-1.3 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 3
50 | bsd | bsd license | (?:the )?bsd license
50 | bsd | bsd style license | bsd style license
60 | bsd | bsd license | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?bsd license
70 | 0bsd | 0bsd | 0bsd(?: license)?
70 | 0bsd | zero clause bsd | zero clause bsd(?: license)?
70 | bsd-1-clause | bsd 1 clause | bsd 1 clause(?: license)?
70 | bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license)?
70 | bsd-2-clause | simplified bsd | simplified bsd(?: license)?
70 | bsd-2-clause | freebsd license | freebsd license
70 | bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license)?
70 | bsd-3-clause | new bsd | new bsd license
70 | bsd-3-clause | modified bsd | modified bsd license
70 | bsd-3-clause | revised bsd | revised bsd license
70 | bsd-3-clause | 3 clause bsd | 3 clause bsd(?: license)?
70 | bsd-2-clause | 2 clause bsd | 2 clause bsd(?: license)?
70 | bsd-4-clause | bsd 4 clause | bsd 4 clause(?: license)?
70 | bsd-4-clause | original bsd | original bsd license
75 | bsd-3-clause-clear | bsd 3 clause clear | bsd 3 clause clear(?: license)?
75 | bsd-3-clause-lbnl | bsd 3 clause lbnl | bsd 3 clause lbnl
75 | bsd-2-clause-patent | bsd 2 clause plus patent | bsd 2 clause plus patent(?: license)?
75 | bsd-protection | bsd protection license | bsd protection license
78 | bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
82 | bsd-3-clause | neither the name of | neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse
82 | bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
50 | isc | isc license | (?:the )?isc license
78 | isc | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee
78 | ntp | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose
60 | mpl | mozilla public license | mozilla public license
75 | mpl-1.0 | mozilla public license | mozilla public license (?:version |v )?1 0
75 | mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
75 | mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2(?: 0)?
75 | mpl-2.0 | mpl 2 0 | mpl 2 0
75 | mpl-1.1 | mpl 1 1 | mpl 1 1
82 | mpl-2.0 | subject to the terms of the mozilla public license | subject to the terms of the mozilla public license v 2 0
60 | epl | eclipse public license | eclipse public license
75 | epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1 0
75 | epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2 0
75 | epl-1.0 | epl 1 0 | epl 1 0
75 | epl-2.0 | epl 2 0 | epl 2 0
75 | edl-1.0 | eclipse distribution license | eclipse distribution license(?: version| v)?(?: 1 0)?
60 | cpl-1.0 | common public license | common public license(?: version| v)?(?: 1 0)?
60 | ipl-1.0 | ibm public license | ibm public license(?: version| v)?(?: 1 0)?
60 | cddl | common development and distribution license | common development and distribution license
75 | cddl-1.0 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v )?1 0
75 | cddl-1.1 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v )?1 1
75 | cddl-1.0 | cddl 1 0 | cddl 1 0
75 | cddl-1.1 | cddl 1 1 | cddl 1 1
50 | cc | creative commons license | creative commons license
60 | cc-by | creative commons attribution | creative commons attribution
68 | cc-by-sa | attribution share alike | (?:creative commons )?attribution share alike
68 | cc-by-nd | attribution noderivatives | (?:creative commons )?attribution noderivatives
68 | cc-by-nc | attribution noncommercial | (?:creative commons )?attribution noncommercial
68 | cc-by-nc | attribution non commercial | (?:creative commons )?attribution non commercial
70 | cc-by-nc-sa | attribution noncommercial sharealike | (?:creative commons )?attribution noncommercial sharealike
70 | cc-by-nc-sa | attribution non commercial share alike | (?:creative commons )?attribution non commercial share alike
70 | cc-by-nc-nd | attribution noncommercial noderivatives | (?:creative commons )?attribution noncommercial noderivatives
70 | cc-by-nc-nd | attribution noncommercial noderivs | (?:creative commons )?attribution noncommercial noderivs
75 | cc-by-1.0 | cc by 1 0 | cc by 1 0
75 | cc-by-2.0 | cc by 2 0 | cc by 2 0
75 | cc-by-2.5 | cc by 2 5 | cc by 2 5
75 | cc-by-3.0 | cc by 3 0 | cc by 3 0
75 | cc-by-4.0 | cc by 4 0 | cc by 4 0
75 | cc-by-sa-1.0 | cc by sa 1 0 | cc by sa 1 0
75 | cc-by-sa-2.0 | cc by sa 2 0 | cc by sa 2 0
75 | cc-by-sa-2.5 | cc by sa 2 5 | cc by sa 2 5
75 | cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
75 | cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
75 | cc-by-nd-3.0 | cc by nd 3 0 | cc by nd 3 0
75 | cc-by-nd-4.0 | cc by nd 4 0 | cc by nd 4 0
75 | cc-by-nc-2.0 | cc by nc 2 0 | cc by nc 2 0
75 | cc-by-nc-3.0 | cc by nc 3 0 | cc by nc 3 0
75 | cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
77 | cc-by-nc-sa-3.0 | cc by nc sa 3 0 | cc by nc sa 3 0
77 | cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0
77 | cc-by-nc-nd-3.0 | cc by nc nd 3 0 | cc by nc nd 3 0
77 | cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0
75 | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
75 | cc0-1.0 | creative commons zero | creative commons zero(?: v?1 0)?(?: universal)?
72 | cc-by-4.0 | creativecommons org licenses by 4 0 | creativecommons org licenses by 4 0
72 | cc-by-3.0 | creativecommons org licenses by 3 0 | creativecommons org licenses by 3 0
74 | cc-by-sa-4.0 | creativecommons org licenses by sa 4 0 | creativecommons org licenses by sa 4 0
74 | cc-by-sa-3.0 | creativecommons org licenses by sa 3 0 | creativecommons org licenses by sa 3 0
74 | cc-by-nc-4.0 | creativecommons org licenses by nc 4 0 | creativecommons org licenses by nc 4 0
74 | cc0-1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
60 | public-domain | public domain | (?:placed|released|dedicated|is) (?:in|into|to) the public domain
60 | public-domain | public domain dedication | public domain dedication
75 | pddl-1.0 | open data commons public domain dedication | open data commons public domain dedication (?:and )?license
60 | unlicense | the unlicense | (?:under )?the unlicense
80 | unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
60 | wtfpl | wtfpl | wtfpl(?: version| v)?(?: 2)?
78 | wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
55 | artistic | artistic license | artistic license
75 | artistic-1.0 | artistic license | artistic license (?:version |v )?1 0
75 | artistic-2.0 | artistic license | artistic license (?:version |v )?2(?: 0)?
60 | artistic-or-gpl | same terms as perl itself | (?:under )?the same terms as perl itself
55 | zlib | zlib license | (?:the )?zlib license
70 | libpng | libpng license | libpng license(?: version)?(?: 2)?
78 | zlib | this software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
60 | bsl-1.0 | boost software license | boost software license(?: version| v)?(?: 1 0)?
60 | python-2.0 | python software foundation license | python software foundation license(?: version| v)?(?: 2)?
60 | python-2.0 | psf license | psf license(?: agreement)?
60 | php-3.01 | php license | (?:the )?php license(?: version| v)?(?: 3 01)?
55 | ruby | ruby license | ruby license
60 | openssl | openssl license | openssl license
65 | ssleay | ssleay license | (?:original )?ssleay license
60 | ofl-1.1 | sil open font license | sil open font license(?: version| v)?(?: 1 1)?
60 | ofl-1.1 | open font license | open font license
60 | eupl | european union public licen | european union public licen[cs]e
75 | eupl-1.1 | eupl | eupl ?v? ?1 1
75 | eupl-1.2 | eupl | eupl ?v? ?1 2
60 | cecill | cecill | cecill(?: license)?
70 | cecill-2.1 | cecill | cecill (?:v )?2 1
70 | cecill-b | cecill b | cecill b
70 | cecill-c | cecill c | cecill c
60 | ms-pl | microsoft public license | microsoft public license
60 | ms-rl | microsoft reciprocal license | microsoft reciprocal license
60 | ms-lpl | microsoft limited public license | microsoft limited public license
60 | odbl-1.0 | open database license | open database license(?: odbl)?(?: v)?(?: 1 0)?
60 | odc-by-1.0 | open data commons attribution license | open data commons attribution license(?: v)?(?: 1 0)?
60 | osl-3.0 | open software license | open software license(?: version| v)?(?: 3 0)?
60 | afl-3.0 | academic free license | academic free license(?: version| v)?(?: 3 0)?
60 | ecl-2.0 | educational community license | educational community license(?: version| v)?(?: 2 0)?
60 | ncsa | university of illinois ncsa open source license | university of illinois ncsa open source license
60 | upl-1.0 | universal permissive license | universal permissive license(?: v)?(?: 1 0)?
60 | postgresql | postgresql license | postgresql license
60 | vim | vim license | vim license
60 | tcl | tcl tk license | tcl tk license
60 | sleepycat | sleepycat license | sleepycat license
60 | qpl-1.0 | q public license | q public license(?: version| v)?(?: 1 0)?
60 | lppl | latex project public license | latex project public license(?: version| v)?(?: 1 3c?)?
60 | apsl-2.0 | apple public source license | apple public source license(?: version| v)?(?: 2 0)?
60 | npl-1.1 | netscape public license | netscape public license(?: version| v)?(?: 1 1)?
60 | spl-1.0 | sun public license | sun public license(?: version| v)?(?: 1 0)?
60 | sissl | sun industry standards source license | sun industry standards source license
60 | w3c | w3c software notice and license | w3c software notice and license
60 | w3c | w3c software license | w3c software license
60 | curl | curl license | curl license
60 | beerware | beer ware license | (?:the )?beer ware license
60 | json | software shall be used for good | (?:the )?software shall be used for good not evil
60 | blueoak-1.0.0 | blue oak model license | blue oak model license(?: 1 0 0)?
60 | hpnd | historical permission notice and disclaimer | historical permission notice and disclaimer
60 | elastic-2.0 | elastic license | elastic license(?: 2 0)?
60 | sspl-1.0 | server side public license | server side public license(?: v)?(?: 1)?
60 | busl-1.1 | business source license | business source license(?: 1 1)?
60 | polyform-nc-1.0 | polyform noncommercial license | polyform noncommercial license(?: 1 0 0)?
60 | commons-clause | commons clause | commons clause(?: license condition)?
60 | openrail | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
60 | unicode | unicode license agreement | unicode license agreement
60 | freetype | freetype license | freetype (?:project )?license
60 | ijg | independent jpeg group | (?:work of the )?independent jpeg group
60 | imagemagick | imagemagick license | imagemagick license
60 | info-zip | info zip license | info zip license
60 | mulan-psl-2.0 | mulan permissive software license | mulan permissive software license(?: v?2)?
60 | zpl-2.1 | zope public license | zope public license(?: version| v)?(?: 2 1)?
60 | cpal-1.0 | common public attribution license | common public attribution license(?: version| v)?(?: 1 0)?
60 | rpl-1.5 | reciprocal public license | reciprocal public license(?: version| v)?(?: 1 5)?
60 | ogl-uk-3.0 | open government licence | open government licence(?: v)?(?: 3 0)?
75 | mit-feh | this permission notice shall be included in all copies of the software | the above copyright notice and this permission notice shall be included in all copies of the software its documentation and marketing
75 | x11-modify-variant | distribute with modifications sublicense | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute distribute with modifications sublicense
72 | mit-old-style | provided that the above copyright notice appear in all copies | permission to use copy modify and distribute this software (?:and its documentation )?(?:for any purpose )?(?:is hereby granted )?(?:without fee )?(?:is hereby granted )?provided that the above copyright notice appear in all copies
76 | hpnd-sell | permission to use copy modify distribute and sell this software | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
75 | cmu-mach | carnegie mellon requests users of this software | carnegie mellon requests users of this software to return to
80 | apache-2.0 | unless required by applicable law or agreed to in writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
70 | apache-2.0 | see the license for the specific language governing | see the license for the specific language governing permissions and limitations under the license
78 | apache-2.0-llvm | llvm exception | apache (?:license )?(?:v|version )?2 0 with llvm exceptions?
78 | apache-1.1 | this product includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
82 | gpl | this program is free software you can redistribute it | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
84 | lgpl | this library is free software you can redistribute it | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
84 | agpl | this program is free software you can redistribute it | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
70 | gpl | you should have received a copy of the gnu general | you should have received a copy of the gnu general public license along with this (?:program|software|file|package)
72 | lgpl | you should have received a copy of the gnu l | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software|file)
72 | agpl | you should have received a copy of the gnu affero | you should have received a copy of the gnu affero general public license along with this (?:program|software|file)
68 | gpl | 59 temple place | free software foundation inc 59 temple place (?:suite 330 )?boston ma
68 | gpl | 51 franklin st | free software foundation inc 51 franklin st(?:reet)? (?:fifth floor )?boston ma
79 | gpl-2.0-only | version 2 of the license | gnu general public license as published by the free software foundation version 2 of the license
79 | gpl-3.0-only | version 3 of the license | gnu general public license as published by the free software foundation version 3 of the license
76 | gnu-all-permissive | copying and distribution of this file | copying and distribution of this file with or without modification are permitted in any medium without royalty
84 | gpl-openssl-exception | with the openssl library | as a special exception (?:the )?(?:copyright holders|authors?|you) (?:give permission|have permission|may|are permitted) to link (?:the code of )?(?:portions of )?this (?:program|code|software) with the openssl library
84 | gpl-linking-exception | as a special exception if you link this library | as a special exception if you link this library with other files
84 | gpl-2.0-classpath | linking this library statically or dynamically | linking this library statically or dynamically with other modules is making a combined work based on this library
84 | autoconf-exception | generated by autoconf | as a special exception (?:to the gnu general public license )?if you distribute this file as part of a program that contains a configuration script generated by autoconf
84 | libtool-exception | built using gnu libtool | if you distribute this file as part of a program or library that is built using gnu libtool
82 | foss-exception | foss exception | (?:universal )?foss exception(?: version)?(?: 1 0)?
70 | agpl-3.0 | remote network interaction | remote network interaction use with the gnu general public license
78 | gfdl | permission is granted to copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
70 | gfdl-invariants | invariant sections | with (?:no|the) invariant sections
72 | bsd | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions
72 | bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions
70 | bsd | in no event shall the | in no event shall (?:the )?(?:[^ ]+ ){1,8}be liable for any direct indirect incidental special exemplary or consequential damages
78 | bsd-4-clause-uc | university of california berkeley and its contributors | this product includes software developed by the university of california berkeley and its contributors
78 | bsd-source-code | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this condition and the following disclaimer
78 | zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
76 | zlib | this notice may not be removed or altered | this notice may not be removed or altered from any (?:source )?distribution
80 | bsl-1.0 | to any person or organization obtaining a copy | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
72 | bsl-1.0 | boost org license 1 0 | (?:http |https )?(?:www )?boost org license 1 0 txt
82 | mpl-2.0 | this source code form is subject to | this source code form is subject to the terms of the mozilla public license v 2 0
76 | mpl-2.0 | if a copy of the mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at
82 | mpl-1.1 | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
80 | npl-1.1 | the contents of this file are subject to the netscape | the contents of this file are subject to the netscape public license version 1 1
80 | cddl | the contents of this file are subject to the terms of the common | the contents of this file are subject to the terms of the common development and distribution license
80 | epl | this program and the accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
78 | edl-1.0 | eclipse org org documents edl | (?:www )?eclipse org org documents edl v10(?: html| php)?
76 | cc | this work is licensed under | this work is licensed under (?:a|the) creative commons (?:[^ ]+ ){1,6}license
66 | cc | to view a copy of this license visit | to view a copy of this license visit (?:http |https )?creativecommons org licenses
80 | cc0-1.0 | to the extent possible under law | to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights
76 | cc0-1.0 | dedicated all copyright | dedicated all copyright and related and neighboring rights to this (?:software|work) to the public domain worldwide
66 | cc-pd-mark | public domain mark | public domain mark(?: 1 0)?
68 | cc-sampling | sampling plus | (?:creative commons )?sampling plus(?: 1 0)?
80 | unlicense | anyone is free to copy modify publish use compile sell | anyone is free to copy modify publish use compile sell or distribute this software
72 | unlicense | unlicense org | (?:for more information please refer to )?(?:http |https )?unlicense org
80 | ofl-1.1 | this font software is licensed under | this font software is licensed under the sil open font license version 1 1
66 | ofl-1.1 | with reserved font name | with reserved font names?(?: [^ ]+)?
80 | python-2.0 | psf is making python available | psf is making python (?:[^ ]+ )?available to licensee on an as is basis
72 | python-cnri | cnri open source license agreement | (?:python )?cnri open source license agreement
72 | python-beopen | beopen python open source license | beopen python open source license agreement(?: version 1)?
80 | openssl | this product includes software developed by the openssl | this product includes software developed by the openssl project for use in the openssl toolkit
78 | ssleay | this product includes cryptographic software written by eric young | this product includes cryptographic software written by eric young
78 | php-3.01 | this product includes php software | this product includes php software freely available from
80 | beerware | you can do whatever you want with this stuff | as long as you retain this notice you can do whatever you want with this stuff
78 | vim | vim is charityware | vim is charityware you can use and copy it as much as you like
78 | sleepycat | complete source code for the db software | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
78 | ijg | this software is based in part on the work of the independent | this software is based in part on the work of the independent jpeg group
78 | freetype | portions of this software are copyright | portions of this software are copyright (?:[^ ]+ ){0,3}the freetype project
72 | unicode | unicode data files and software | unicode data files (?:and|or) software
66 | icu | icu license | (?:the )?icu license(?: icu 1 8 1 and later)?
66 | nasa-1.3 | nasa open source agreement | nasa open source agreement(?: version)?(?: 1 3)?
66 | intel | intel open source license | intel open source license
66 | sgi-b-2.0 | sgi free software license b | sgi free software license b(?: version)?(?: 2 0)?
66 | xfree86-1.1 | xfree86 license | xfree86 license(?: version)?(?: 1 1)?
66 | cern-ohl | cern open hardware licence | cern open hardware licence(?: version| v)?(?: 1 2| 2)?(?: permissive| strongly reciprocal| weakly reciprocal)?
66 | shl-2.1 | solderpad hardware licen | solderpad hardware licen[cs]e(?: version| v)?(?: 2 1| 0 51)?
66 | tapr-ohl-1.0 | tapr open hardware license | tapr open hardware license(?: version)?(?: 1 0)?
66 | lal-1.3 | free art license | free art license(?: 1 3)?
66 | lal-1.3 | licence art libre | licence art libre(?: 1 3)?
66 | etalab-2.0 | licence ouverte | licence ouverte(?: open licence)?(?: etalab)?(?: version)?(?: 2 0)?
66 | dl-de-by-2.0 | datenlizenz deutschland | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
66 | cdla-permissive | community data license agreement permissive | community data license agreement permissive(?: version)?(?: 1 0| 2 0)?
66 | cdla-sharing-1.0 | community data license agreement sharing | community data license agreement sharing(?: version)?(?: 1 0)?
74 | sspl-1.0 | available to third parties as a service | mak(?:e|ing) the functionality of the program or a modified version available to third parties as a service
74 | elastic-2.0 | as a hosted or managed service | you may not provide the software to third parties as a hosted or managed service
74 | commons-clause | the right to sell the software | does not (?:include|grant to you) the right to sell the software
70 | busl-1.1 | additional use grant | (?:parameters )?additional use grant(?: you may| none)?
66 | llama-2 | llama 2 community license | (?:the )?llama 2 community license(?: agreement)?
66 | llama-3 | llama 3 | (?:meta )?llama 3(?: 1| 2| 3)? community license(?: agreement)?
66 | gemma | gemma terms of use | gemma terms of use
70 | bigscience-rail-1.0 | bigscience rail license | bigscience rail license(?: v)?(?: 1 0)?
75 | gpl-2.0-only | spdx license identifier gpl | spdx license identifier gpl 2 0(?: only)?
76 | gpl-2.0-or-later | spdx license identifier gpl | spdx license identifier gpl 2 0 or later
75 | gpl-3.0-only | spdx license identifier gpl | spdx license identifier gpl 3 0(?: only)?
76 | gpl-3.0-or-later | spdx license identifier gpl | spdx license identifier gpl 3 0 or later
78 | lgpl-2.1 | spdx license identifier lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
78 | lgpl-3.0 | spdx license identifier lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
78 | agpl-3.0 | spdx license identifier agpl | spdx license identifier agpl 3 0(?: only| or later)?
76 | bsd-2-clause | spdx license identifier bsd | spdx license identifier bsd 2 clause
76 | bsd-3-clause | spdx license identifier bsd | spdx license identifier bsd 3 clause
75 | isc | spdx license identifier isc | spdx license identifier isc
76 | mpl-2.0 | spdx license identifier mpl | spdx license identifier mpl 2 0(?: no copyleft exception)?
76 | epl-2.0 | spdx license identifier epl | spdx license identifier epl 2 0
76 | cc0-1.0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
76 | cc-by-4.0 | spdx license identifier cc by | spdx license identifier cc by 4 0
78 | cc-by-sa-4.0 | spdx license identifier cc by sa | spdx license identifier cc by sa 4 0
75 | unlicense | spdx license identifier unlicense | spdx license identifier unlicense
75 | zlib | spdx license identifier zlib | spdx license identifier zlib
76 | bsl-1.0 | spdx license identifier bsl | spdx license identifier bsl 1 0
76 | 0bsd | spdx license identifier 0bsd | spdx license identifier 0bsd
76 | ofl-1.1 | spdx license identifier ofl | spdx license identifier ofl 1 1
20 | all-rights-reserved | all rights reserved | all rights reserved
25 | proprietary | proprietary and confidential | proprietary and confidential
"""


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, regex) in the order written; a label is used as it stands."""
    out = []
    for line in FAMILIES.strip().splitlines():
        priority, label, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append((int(priority), label, keyword, pattern))
    return out
