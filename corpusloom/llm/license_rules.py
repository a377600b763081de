"""The signature rules of the license scan, one to a line: kind, label, keyword, pattern.

A pattern is a regular expression over lower-cased words with single blanks between ("2.0" is "2 0"). Its keyword stands in
each of its matches, blanks written as "_". "<n>" stands for up to n words of any kind. Kinds in the order of their
priority: tag (an SPDX identifier), body (the license's own text), notice (a grant), version (a name with its version),
name, hint.
"""

RULES = r"""
tag agpl-1.0 identifier_agpl spdx license identifier agpl 1 0(?: only| or later)?
tag agpl-3.0 identifier_agpl spdx license identifier agpl 3 0(?: only| or later)?
tag lgpl-2.0 identifier_lgpl spdx license identifier lgpl 2 0(?: only| or later)?
tag lgpl-2.1 identifier_lgpl spdx license identifier lgpl 2 1(?: only| or later)?
tag lgpl-3.0 identifier_lgpl spdx license identifier lgpl 3 0(?: only| or later)?
tag gpl-1.0 identifier_gpl spdx license identifier gpl 1 0(?: only| or later)?
tag gpl-2.0 identifier_gpl spdx license identifier gpl 2 0(?: only| or later)?(?: with [^ ]+ exception(?: [^ ]+)?)?
tag gpl-3.0 identifier_gpl spdx license identifier gpl 3 0(?: only| or later)?(?: with [^ ]+ exception(?: [^ ]+)?)?
tag gfdl-1.2 identifier_gfdl spdx license identifier gfdl 1 2(?: only| or later)?
tag gfdl-1.3 identifier_gfdl spdx license identifier gfdl 1 3(?: only| or later)?
tag apache-1.1 identifier_apache spdx license identifier apache 1 1
tag apache-2.0 identifier_apache spdx license identifier apache 2 0
tag mit-0 identifier_mit spdx license identifier mit 0
tag mit identifier_mit spdx license identifier mit
tag x11 identifier_x11 spdx license identifier x11
tag isc identifier_isc spdx license identifier isc
tag 0bsd identifier_0bsd spdx license identifier 0bsd
tag bsd-1-clause identifier_bsd spdx license identifier bsd 1 clause
tag bsd-2-clause identifier_bsd spdx license identifier bsd 2 clause(?: patent)?
tag bsd-3-clause identifier_bsd spdx license identifier bsd 3 clause(?: clear)?
tag bsd-4-clause identifier_bsd spdx license identifier bsd 4 clause(?: uc)?
tag mpl-1.1 identifier_mpl spdx license identifier mpl 1 1
tag mpl-2.0 identifier_mpl spdx license identifier mpl 2 0
tag epl-1.0 identifier_epl spdx license identifier epl 1 0
tag epl-2.0 identifier_epl spdx license identifier epl 2 0
tag eupl-1.1 identifier_eupl spdx license identifier eupl 1 1
tag eupl-1.2 identifier_eupl spdx license identifier eupl 1 2
tag cddl-1.0 identifier_cddl spdx license identifier cddl 1 0
tag cddl-1.1 identifier_cddl spdx license identifier cddl 1 1
tag cc0-1.0 identifier_cc0 spdx license identifier cc0 1 0
tag cc-by-3.0 identifier_cc spdx license identifier cc by 3 0
tag cc-by-4.0 identifier_cc spdx license identifier cc by 4 0
tag cc-by-sa-3.0 identifier_cc spdx license identifier cc by sa 3 0
tag cc-by-sa-4.0 identifier_cc spdx license identifier cc by sa 4 0
tag cc-by-nd-4.0 identifier_cc spdx license identifier cc by nd 4 0
tag cc-by-nc-4.0 identifier_cc spdx license identifier cc by nc 4 0
tag cc-by-nc-sa-4.0 identifier_cc spdx license identifier cc by nc sa 4 0
tag cc-by-nc-nd-4.0 identifier_cc spdx license identifier cc by nc nd 4 0
tag unlicense identifier_unlicense spdx license identifier unlicense
tag wtfpl identifier_wtfpl spdx license identifier wtfpl
tag zlib identifier_zlib spdx license identifier zlib
tag bsl-1.0 identifier_bsl spdx license identifier bsl 1 0
tag busl-1.1 identifier_busl spdx license identifier busl 1 1
tag sspl-1.0 identifier_sspl spdx license identifier sspl 1 0
tag artistic-2.0 identifier_artistic spdx license identifier artistic 2 0
tag afl-3.0 identifier_afl spdx license identifier afl 3 0
tag osl-3.0 identifier_osl spdx license identifier osl 3 0
tag ofl-1.1 identifier_ofl spdx license identifier ofl 1 1
tag odbl-1.0 identifier_odbl spdx license identifier odbl 1 0
tag pddl-1.0 identifier_pddl spdx license identifier pddl 1 0
tag postgresql identifier_postgresql spdx license identifier postgresql
tag python-2.0 identifier_psf spdx license identifier psf 2 0
tag php-3.01 identifier_php spdx license identifier php 3 01
tag ncsa identifier_ncsa spdx license identifier ncsa
tag ms-pl identifier_ms spdx license identifier ms pl
tag ms-rl identifier_ms spdx license identifier ms rl
tag upl-1.0 identifier_upl spdx license identifier upl 1 0
tag ecl-2.0 identifier_ecl spdx license identifier ecl 2 0
tag cecill-2.1 identifier_cecill spdx license identifier cecill 2 1
body agpl-3.0 network_server the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software
body agpl-3.0 interacting_with_it_remotely your modified version must prominently offer all users interacting with it remotely through a computer network
body lgpl-3.0 lesser_general_public this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
body lgpl-2.1 first_released_version_of_the_lesser this is the first released version of the lesser gpl
body lgpl-2.0 first_released_version_of_the_library this is the first released version of the library gpl
body gpl-3.0 free_copyleft_license the gnu general public license is a free copyleft license for software and other kinds of works
body gpl-3.0 directly_or_secondarily_liable to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
body gpl-2.0 take_away_your_freedom the licenses for most software are designed to take away your freedom to share and change it
body gpl-2.0 most_ordinary_way if the modified program normally reads commands interactively when run you must cause it when started running for such interactive use in the most ordinary way
body gpl-1.0 mercy_of_those_companies the license agreements of most software companies try to keep users at the mercy of those companies
body gpl copyright_the_software we protect your rights with two steps 1 copyright the software
body gfdl functional_and_useful_document the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom
body gfdl invariant_sections with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
body apache-2.0 perpetual_worldwide each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except)
body apache-2.0 terms_and_conditions_for_use terms and conditions for use reproduction and distribution 1 definitions
body apache-2.0 attribution_notices you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices
body apache-2.0 warranties_or_conditions unless required by applicable law or agreed to in writing <4>(?:software|work) <16>without warranties or conditions of any kind
body apache-1.1 apache_software_foundation this product includes software developed by the apache software foundation
body apache-1.0 apache_group this product includes software developed by the apache group for use in the apache http server project
body mit permission_is_hereby_granted permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
body mit above_copyright_notice_and_this_permission the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
body mit to_deal_in_the_software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
body mit-0 permission_is_hereby_granted permission is hereby granted free of charge to any person obtaining a copy of this software <12>to deal in the software without restriction <30>to permit persons to whom the software is furnished to do so the software is provided as is
body x11 except_as_contained_in_this_notice except as contained in this notice the name of <12>shall not be used in advertising or otherwise to promote the sale
body isc with_or_without_fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
body 0bsd with_or_without_fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
body hpnd without_fee permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted
body isc fitness_in_no_event the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event
body bsd redistributions_of_source_code redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
body bsd redistributions_in_binary_form redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
body bsd source_and_binary_forms redistribution and use in source and binary forms with or without modification are permitted
body bsd-3-clause endorse_or_promote neither the names? of <12>nor the names of (?:its|their|the) <4>may be used to endorse or promote products derived from this software
body bsd-4-clause advertising_materials all advertising materials mentioning features or use of this software must display the following acknowledge?ment
body bsd-3-clause-clear patent_rights_are_granted no express or implied licenses to any party s patent rights are granted by this license
body bsd-2-clause-views official_policies the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
body mpl-2.0 source_code_form this source code form is subject to the terms of the mozilla public license v 2 0
body mpl-1.1 initial_developer the initial developer hereby grants you a world ?wide royalty free non exclusive license
body mpl-2.0 incompatible_with_secondary_licenses this source code form is incompatible with secondary licenses as defined by the mozilla public license
body epl eclipse_public_license the accompanying program is provided under the terms of this eclipse public license
body epl-2.0 eclipse_public_license the accompanying program is provided under the terms of this eclipse public license agreement
body cpl common_public_license the accompanying program is provided under the terms of this common public license
body eupl european_union_public this european union public licen[cs]e the eupl applies to the work
body cddl covered_software any covered software that you distribute or otherwise make available in executable form must also be made available in source code form
body cc0-1.0 affirmer_hereby to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives
body cc0-1.0 exclusive_copyright_and_related_rights the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights
body cc-by licensed_rights subject to the terms and conditions of this public license the licensor hereby grants you a worldwide royalty free non sublicensable non exclusive irrevocable license to exercise the licensed rights
body cc-by-sa adapter_s_license the adapter s license you apply must be a creative commons license with the same license elements
body cc-by-nc noncommercial_means noncommercial means not primarily intended for or directed towards commercial advantage or monetary compensation
body cc-by-nd not_share_adapted produce and reproduce but not share adapted material
body unlicense released_into_the_public_domain this is free and unencumbered software released into the public domain
body unlicense for_the_benefit_of_the_public we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
body wtfpl what_the_fuck you just do what the fuck you want to
body zlib origin_of_this_software the origin of this software must not be misrepresented you must not claim that you wrote the original software
body zlib altered_source_versions altered source versions must be plainly marked as such and must not be misrepresented as being the original software
body bsl-1.0 machine_executable_object_code unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
body busl-1.1 change_date effective on the change date or the fourth anniversary of the first publicly available distribution
body sspl-1.0 service_source_code you must make the service source code available via network download to everyone at no charge
body artistic-1.0 standard_version you may make and give away verbatim copies of the source form of the standard version of this package without restriction
body artistic-2.0 free_software_package this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
body afl-3.0 licensed_under_the_academic licensed under the academic free license version 3 0
body osl-3.0 licensed_under_the_open_software licensed under the open software license version 3 0
body ofl-1.1 font_software neither the font software nor any of its individual components in original or modified versions may be sold by itself
body ofl-1.1 reserved_font_name no modified version of the font software may use the reserved font name
body odbl-1.0 open_database_license the open database license odbl is a license agreement intended to allow users to freely share modify and use this database
body odc-by attribution_license the open data commons attribution license is a license agreement intended to allow users to freely share modify and use this database
body pddl-1.0 public_domain_dedication the open data commons public domain dedication and licen[cs]e is a document intended to allow you to freely share modify and use this work
body postgresql without_a_written_agreement permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
body python-2.0 python_software_foundation this license agreement is between the python software foundation psf and the individual or organization licensee
body php this_product_includes_php this product includes php software(?: freely)? available from
body ncsa university_of_illinois neither the names of <20>nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <10>university of illinois
body ms-pl licensed_patents each contributor grants you a non exclusive worldwide royalty free license under its licensed patents
body upl-1.0 lrgrwrks any piece of software and or hardware listed in the lrgrwrks txt file if one is included with the software
body curl advertising_or_otherwise except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise
body openssl openssl_toolkit this product includes software developed by the openssl project for use in the openssl toolkit
body json good_not_evil the software shall be used for good not evil
body beerware buy_me_a_beer you can buy me a beer in return
body vim copies_of_vim you can distribute unmodified copies of vim without restrictions
body ijg independent_jpeg_group this software is based in part on the work of the independent jpeg group
body libpng png_reference_library the png reference library is supplied as is
body gcc-exception special_exception as a special exception <24>(?:link|combine) <24>with (?:independent modules|works based on this library)
body classpath-exception combined_work linking this library statically or dynamically with other modules is making a combined work based on this library
body font-exception special_exception as a special exception if you create a document which uses this font
body warranty-disclaimer is_provided (?:the|this) (?:software|program|library|work|material) is provided(?: by(?: [^ ]+){1,12}?)? as is (?:and any express or implied warranties|without (?:any )?warrant(?:y|ies) of any kind)
body warranty-disclaimer without_even_the_implied without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
notice agpl-3.0 affero_general_public_license under the terms of the gnu affero general public license as published by the free software foundation <6>version 3
notice agpl affero_general_public_license under the(?: terms of the)?(?: gnu)? affero general public license
notice lgpl-2.1 lesser_general_public_license under the terms of the gnu lesser general public license as published by the free software foundation <6>version 2 1
notice lgpl-3.0 lesser_general_public_license under the terms of the gnu lesser general public license as published by the free software foundation <6>version 3
notice lgpl-2.0 library_general_public_license under the terms of the gnu library general public license as published by the free software foundation <6>version 2
notice lgpl lesser_general_public_license under the(?: terms of the)?(?: gnu)? lesser general public license
notice lgpl library_general_public_license under the(?: terms of the)?(?: gnu)? library general public license
notice gpl-2.0 general_public_license under the terms of the gnu general public license as published by the free software foundation <6>version 2
notice gpl-3.0 general_public_license under the terms of the gnu general public license as published by the free software foundation <6>version 3
notice gpl-2.0 general_public_license under the(?: terms of the)?(?: gnu)? general public license (?:v|version )2(?: 0)?(?: or later| only)?
notice gpl-3.0 general_public_license under the(?: terms of the)?(?: gnu)? general public license (?:v|version )3(?: 0)?(?: or later| only)?
notice gpl general_public_license under the(?: terms of the)?(?: gnu)? general public license
notice gpl under_the_gpl (?:licen[cs]ed|released|distributed|available|covered) <4>under the gpl
notice gfdl free_documentation_license under the terms of the gnu free documentation license
notice apache-2.0 apache_license licen[cs]ed under the apache license version 2 0(?: the license)?
notice apache-2.0 apache_license under the terms of the apache license version 2 0
notice apache apache_license (?:licen[cs]ed|released|distributed|available|provided|published|covered) <4>under (?:the )?(?:terms of )?(?:the )?apache license
notice mit mit_license (?:licen[cs]ed|released|distributed|available|provided|published|covered) <4>under (?:the )?(?:terms of )?(?:the )?mit license
notice mit expat_license (?:licen[cs]ed|released|distributed|available|provided) <4>under (?:the )?(?:terms of )?(?:the )?expat license
notice bsd bsd_license (?:licen[cs]ed|released|distributed|available|provided|covered) <4>under (?:the|a) <3>bsd license
notice bsd bsd_style use of this source code is governed by a bsd style license
notice mit mit_style use of this source code is governed by an mit style license
notice isc isc_license (?:licen[cs]ed|released|distributed|available|provided) <4>under the isc license
notice mpl-1.1 mozilla_public_license the contents of this file are subject to the mozilla public license version 1 1
notice mpl mozilla_public_license (?:licen[cs]ed|released|distributed|available|subject) <4>(?:under|to) (?:the )?(?:terms of )?(?:the )?mozilla public license
notice npl netscape_public_license the contents of this file are subject to the netscape public license
notice epl eclipse_public_license (?:this program and the accompanying materials <4>)?(?:are )?made available under the terms of the eclipse public license
notice cddl common_development the contents of this file are subject to the terms of the common development and distribution license
notice eupl european_union_public_licence licen[cs]ed under the(?: terms of the)? (?:eupl|european union public licence)
notice cc-by-sa creative_commons under (?:a|the)(?: terms of the)? creative commons attribution share ?alike <4>licen[cs]e
notice cc-by-nc-sa creative_commons under (?:a|the)(?: terms of the)? creative commons attribution non ?commercial share ?alike <4>licen[cs]e
notice cc-by-nc-nd creative_commons under (?:a|the)(?: terms of the)? creative commons attribution non ?commercial no ?deriv(?:ative|ative|ative work|ative works|atives|s)? <4>licen[cs]e
notice cc-by-nc creative_commons under (?:a|the)(?: terms of the)? creative commons attribution non ?commercial <4>licen[cs]e
notice cc-by-nd creative_commons under (?:a|the)(?: terms of the)? creative commons attribution no ?deriv(?:ative|ative work|ative works|atives|s)? <4>licen[cs]e
notice cc-by creative_commons under (?:a|the)(?: terms of the)? creative commons attribution <4>licen[cs]e
notice cc creative_commons (?:this work|text|content|except where otherwise noted) <8>under (?:a|the) creative commons
notice public-domain public_domain (?:placed|released|dedicated|donated) <4>(?:in|into|to) the public domain
notice artistic artistic_license under the(?: same)? terms (?:of|as) <6>artistic license
notice perl perl_itself you can redistribute it and or modify it under the same terms as perl itself
notice ruby ruby_s_license (?:redistribute|distributed|licen[cs]ed) <8>under (?:the )?ruby s license
notice postgresql postgresql_license (?:licen[cs]ed|released|distributed|available) <4>under the postgresql license
notice zlib zlib_license (?:licen[cs]ed|released|distributed|available) <4>under (?:the )?zlib license
notice bsl-1.0 boost_software_license distributed under the boost software license version 1 0
notice ofl-1.1 open_font_license this font software is licen[cs]ed under the sil open font license version 1 1
notice odbl open_database_license (?:is|are) made available under the open database license
notice unlicense unlicense (?:licen[cs]ed|released|distributed|available) <4>under the unlicense
version agpl-1.0 affero affero general public license (?:v|version )1(?: 0)?
version agpl-3.0 affero (?:gnu )?affero general public license (?:v|version )3(?: 0)?(?: or later| only)?
version agpl-3.0 agpl agpl(?: v| version)? ?v?3(?: 0)?(?: or later| only)?
version lgpl-2.0 library_general (?:gnu )?library general public license (?:v|version )2(?: 0)?
version lgpl-2.1 lesser_general (?:gnu )?lesser general public license (?:v|version )2 1(?: or later| only)?
version lgpl-3.0 lesser_general (?:gnu )?lesser general public license (?:v|version )3(?: 0)?(?: or later| only)?
version lgpl-2.1 lgpl lgpl(?: v| version)? ?v?2 1(?: or later| only)?
version lgpl-3.0 lgpl lgpl(?: v| version)? ?v?3(?: 0)?(?: or later| only)?
version gpl-1.0 general_public_license (?:gnu )?general public license (?:v|version )1(?: 0)?
version gpl-2.0 general_public_license (?:gnu )?general public license (?:v|version )2(?: 0)?(?: or later| only)?
version gpl-3.0 general_public_license (?:gnu )?general public license (?:v|version )3(?: 0)?(?: or later| only)?
version gpl-2.0 gpl (?:gnu )?gpl(?: v| version)? ?v?2(?: 0)?(?: or later| only)?
version gpl-3.0 gpl (?:gnu )?gpl(?: v| version)? ?v?3(?: 0)?(?: or later| only)?
version gfdl-1.2 documentation_license (?:gnu )?free documentation license (?:v|version )1 2
version gfdl-1.3 documentation_license (?:gnu )?free documentation license (?:v|version )1 3
version apache-1.0 apache apache(?: software)? license (?:v|version )?1 0
version apache-1.1 apache apache(?: software)? license (?:v|version )?1 1
version apache-2.0 apache apache(?: software)?(?: license)?(?: v| version)? ?v?2 0
version mpl-1.0 mozilla_public mozilla public license (?:v|version )?1 0
version mpl-1.1 mozilla_public mozilla public license (?:v|version )?1 1
version mpl-2.0 mozilla_public mozilla public license (?:v|version )?2 0
version mpl-2.0 mpl mpl(?: v| version)? ?v?2 0
version epl-1.0 eclipse_public eclipse public license (?:v|version )?1 0
version epl-2.0 eclipse_public eclipse public license (?:v|version )?2 0
version eupl-1.1 eupl eupl (?:v|version )?1 1
version eupl-1.2 eupl eupl (?:v|version )?1 2
version cddl-1.0 cddl cddl(?: v| version)? ?1 0
version cc-by-3.0 cc_by cc by 3 0
version cc-by-4.0 cc_by cc by 4 0
version cc-by-sa-3.0 cc_by_sa cc by sa 3 0
version cc-by-sa-4.0 cc_by_sa cc by sa 4 0
version cc-by-nd-3.0 cc_by_nd cc by nd 3 0
version cc-by-nd-4.0 cc_by_nd cc by nd 4 0
version cc-by-nc-3.0 cc_by_nc cc by nc 3 0
version cc-by-nc-4.0 cc_by_nc cc by nc 4 0
version cc-by-nc-sa-3.0 cc_by_nc_sa cc by nc sa 3 0
version cc-by-nc-sa-4.0 cc_by_nc_sa cc by nc sa 4 0
version cc-by-nc-nd-3.0 cc_by_nc_nd cc by nc nd 3 0
version cc-by-nc-nd-4.0 cc_by_nc_nd cc by nc nd 4 0
version cc-by-4.0 attribution creative commons attribution 4 0(?: international)?
version cc-by-sa-3.0 attribution creative commons attribution share ?alike 3 0(?: unported)?
version cc-by-sa-4.0 attribution creative commons attribution share ?alike 4 0(?: international)?
version cc-by-nc-4.0 attribution creative commons attribution non ?commercial 4 0(?: international)?
version cc-by-nc-sa-4.0 attribution creative commons attribution non ?commercial share ?alike 4 0(?: international)?
version cc-by-nd-4.0 attribution creative commons attribution no ?derivatives 4 0(?: international)?
version cc-by-nc-nd-4.0 attribution creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?
version cc0-1.0 cc0 cc0 1 0(?: universal)?
version bsd-2-clause bsd (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?
version bsd-3-clause bsd (?:bsd 3 clause|3 clause bsd|(?:new|revised|modified) bsd)(?: license)?
version bsd-4-clause bsd (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
version artistic-2.0 artistic_license artistic license 2 0
version bsl-1.0 boost_software_license boost software license(?: version)? 1 0
version ofl-1.1 open_font_license (?:sil )?open font license(?: version)? 1 1
version php-3.01 php_license php license(?: version)? 3 01
name agpl affero_general_public_license (?:gnu )?affero general public license
name lgpl lesser_general_public_license (?:gnu )?lesser general public license
name lgpl library_general_public_license (?:gnu )?library general public license
name gpl general_public_license (?:gnu )?general public license
name gpl gnu_gpl gnu gpl
name gfdl free_documentation_license (?:gnu )?free documentation license
name apache apache_license apache license
name apache apache_software_license apache software license
name mit mit_license (?:the )?mit license
name mit mit_licence (?:the )?mit licence
name mit expat_license (?:the )?expat license
name bsd bsd_license bsd license
name isc isc_license isc license
name mpl mozilla_public_license mozilla public license
name epl eclipse_public_license eclipse public license
name eupl european_union_public_licence european union public licence
name cddl common_development_and_distribution_license common development and distribution license
name cpl common_public_license common public license
name osl open_software_license open software license
name afl academic_free_license academic free license
name artistic artistic_license artistic license
name bsl boost_software_license boost software license
name ofl open_font_license (?:sil )?open font license
name odbl open_database_license open database license
name cc-by-nc-nd cc_by_nc_nd cc by nc nd
name cc-by-nc-sa cc_by_nc_sa cc by nc sa
name cc-by-nc cc_by_nc cc by nc
name cc-by-nd cc_by_nd cc by nd
name cc-by-sa cc_by_sa cc by sa
name cc-by cc_by cc by
name cc0 cc0 cc0
name cc creative_commons creative commons licen[cs]e
name unlicense the_unlicense the unlicense
name wtfpl wtfpl wtfpl
name zlib zlib_license zlib license
name ms-pl microsoft_public_license microsoft public license
name ms-rl microsoft_reciprocal_license microsoft reciprocal license
name ncsa ncsa_license ncsa(?: open source)? license
name postgresql postgresql_license postgresql license
name python python_software_foundation_license python software foundation license
name php php_license php license
name sspl server_side_public_license server side public license
name busl business_source_license business source license
name public-domain public_domain public domain
hint all-rights-reserved all_rights_reserved all rights reserved
hint copyright copyright copyright (?:c )?(?:19|20)[0-9][0-9]
hint see-license license_file see (?:the )?license file
hint see-license copying see (?:the file )?copying for
hint proprietary proprietary_and_confidential proprietary and confidential
hint non-commercial non_commercial for non commercial use only
hint no-redistribution may_not_be_reproduced may not be reproduced <6>without (?:prior )?written permission
"""
