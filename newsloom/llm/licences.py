"""Licence scans by sentence rules: sentences become identifiers, and ordered rules match their sequence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Kept

#: Known licence sentences as normalised, with # for a version, and their identifiers.
SENTENCES = {
    "mit license": "MIT_TITLE",
    "the mit license": "MIT_TITLE",
    "the mit license mit": "MIT_TITLE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT_WARRANTY",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT_LIABILITY",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_HEAD",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSD_ADVERT",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD_WARRANTY",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSD_LIABILITY",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSD_LIABILITY",
    "apache license version # january 2004": "APACHE_TITLE",
    "licensed under the apache license version # the license": "APACHE_HEAD",
    "the asf licenses this file to you under the apache license version # the license": "APACHE_HEAD",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE_BASIS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE_SEE",
    "gnu general public license version # june 1991": "GPL_TITLE",
    "gnu general public license version # 29 june 2007": "GPL_TITLE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version": "GPL_LATER",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version # as published by the free software foundation": "GPL_ONLY",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_WARRANTY",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_WARRANTY",
    "see the gnu general public license for more details": "GPL_SEE",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "LGPL_LATER",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "LGPL_LATER",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version # of the license or at your option any later version": "LGPL_LATER",
    "see the gnu lesser general public license for more details": "LGPL_SEE",
    "see the gnu library general public license for more details": "LGPL_SEE",
    "gnu lesser general public license version # february 1999": "LGPL_TITLE",
    "gnu lesser general public license version # 29 june 2007": "LGPL_TITLE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version # of the license or at your option any later version": "AGPL_LATER",
    "see the gnu affero general public license for more details": "AGPL_SEE",
    "gnu affero general public license version # 19 november 2007": "AGPL_TITLE",
    "this source code form is subject to the terms of the mozilla public license v #": "MPL_HEAD",
    "mozilla public license version #": "MPL_TITLE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v #": "EPL_HEAD",
    "this program and the accompanying materials are made available under the terms of the eclipse public license # which is available at https www eclipse org legal epl #": "EPL_HEAD",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v # which accompanies this distribution and is available at http www eclipse org legal epl v # html": "EPL_HEAD",
    "eclipse public license v #": "EPL_TITLE",
    "this work is licensed under a creative commons attribution # international license": "CC_BY",
    "this work is licensed under a creative commons attribution sharealike # international license": "CC_BY_SA",
    "this work is licensed under a creative commons attribution noncommercial # international license": "CC_BY_NC",
    "this work is licensed under a creative commons attribution noncommercial sharealike # international license": "CC_BY_NC_SA",
    "this work is licensed under a creative commons attribution noderivatives # international license": "CC_BY_ND",
    "this work is licensed under a creative commons attribution noncommercial noderivatives # international license": "CC_BY_NC_ND",
    "cc0 # universal": "CC_ZERO",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD_GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC_WARRANTY",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISC_LIABILITY",
    "this software is provided as is without any express or implied warranty": "ZLIB_WARRANTY",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZLIB_LIABILITY",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB_GRANT",
    "the origin of this software must not be misrepresented": "ZLIB_ORIGIN",
    "you must not claim that you wrote the original software": "ZLIB_CLAIM",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "ZLIB_ALTERED",
    "this notice may not be removed or altered from any source distribution": "ZLIB_NOTICE",
    "distributed under the boost software license version #": "BOOST_HEAD",
    "boost software license version # august 17th 2003": "BOOST_TITLE",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BOOST_GRANT",
    "the artistic license #": "ARTISTIC_TITLE",
    "artistic license #": "ARTISTIC_TITLE",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "VERBATIM",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "GPL3_PREAMBLE",
    "the licenses for most software are designed to take away your freedom to share and change it": "GPL2_PREAMBLE",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "AGPL3_PREAMBLE",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "APACHE_DEFINES",
    "terms and conditions for use reproduction and distribution": "APACHE_TERMS",
    "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software": "MPL_DEFINES",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "EPL_PROVIDED",
    "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement": "EPL_ACCEPTS",
    "do what the fuck you want to public license": "WTFPL_TITLE",
    "you just do what the fuck you want to": "WTFPL_TERM",
    "common development and distribution license cddl version #": "CDDL_TITLE",
    "european union public licence v #": "EUPL_TITLE",
    "openssl license": "OPENSSL_TITLE",
    "python software foundation license version #": "PSF_TITLE",
    "all rights reserved": "ALL_RIGHTS",
}
#: How short notices call a licence, as normalised, by identifier. v stands for each way to write a version.
CALLED = {
    "MIT_SHORT": ("mit", "mit license", "mit licence", "mit x11 license"),
    "APACHE_SHORT": ("apache license v", "apache v", "apache software license v", "apache public license v"),
    "GPL_SHORT": ("gnu general public license v", "gnu gpl v", "gpl v", "gnu public license v"),
    "LGPL_SHORT": ("gnu lesser general public license v", "gnu lgpl v", "lgpl v"),
    "AGPL_SHORT": ("gnu affero general public license v", "gnu agpl v", "agpl v"),
    "MPL_SHORT": ("mozilla public license v", "mpl v"),
    "EPL_SHORT": ("eclipse public license v", "epl v"),
    "ARTISTIC_SHORT": ("artistic license v", "perl artistic license v"),
    "EUPL_SHORT": ("european union public licence v", "european union public license v", "eupl v"),
    "CDDL_SHORT": ("common development and distribution license v", "cddl v"),
    "PSF_SHORT": ("python software foundation license v", "psf license v"),
    "BOOST_SHORT": ("boost software license v", "boost license v"),
    "BSD2_SHORT": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"),
    "BSD3_SHORT": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"),
    "BSD_CLAUSE": ("bsd # clause license", "bsd # clause"),
    "BSD_SHORT": ("bsd license", "bsd style license"),
    "ISC_SHORT": ("isc license",),
    "ZLIB_SHORT": ("zlib license", "zlib libpng license"),
    "WTFPL_SHORT": ("wtfpl", "wtfpl license", "do what the fuck you want to public license"),
    "OPENSSL_SHORT": ("openssl license",),
    "UNLICENSE": ("unlicense", "unlicense license"),
    "CC_ZERO": ("cc0 #", "cc0 # universal", "creative commons zero v"),
    "CC_BY": ("cc by #", "creative commons attribution # license"),
    "CC_BY_SA": ("cc by sa #", "creative commons attribution sharealike # license"),
    "CC_BY_NC": ("cc by nc #",),
    "CC_BY_NC_SA": ("cc by nc sa #",),
    "CC_BY_ND": ("cc by nd #",),
    "CC_BY_NC_ND": ("cc by nc nd #",),
}
VERSIONS = ("#", "v #", "version #")
#: Characters of a short notice at most.
NOTICE_CHARS = 200
#: What stands before and after a licence's name in a short notice, as normalised: up to so many words, a verb, and where the text is.
BEFORE = "(?:[a-z0-9]+ ){0,7}?(?:licensed|licenced|released|distributed|available|provided|published|offered|covered|governed) (?:under|by|with) (?:either (?:of )?|both )?(?:the |a |an )?(?:terms of (?:either (?:of )?|both )?(?:the |a |an )?)?"
AFTER = "(?: license| licence)?(?: only)?(?: (?:at your option|that can be found in .{1,80}|which can be found in .{1,80}|as found in .{1,80}|see .{1,80}|in the license file))?"
NOTICE = "licensed under "


def _called() -> dict[str, str]:
    """Short notices and their identifiers; of two licences, which an or or an and joins, those of the two that are commonly so offered."""
    bare = lambda name: re.sub(f"{AFTER}$", "", name)
    spelled = {i: [n[:-1] + v if n.endswith(" v") else n for n in names for v in (VERSIONS if n.endswith(" v") else ("",))] for i, names in CALLED.items()}
    out = {NOTICE + bare(n): i for i, names in spelled.items() for n in names}
    out |= {n.replace(" v #", "v #"): i for n, i in out.items()}  # gplv3
    for joint in ("or", "and"):
        for a in spelled["APACHE_SHORT"]:
            for the in ("", "the "):
                out |= {NOTICE + bare(f"{x} {joint} {the}{y}"): f"MIT_APACHE_{joint.upper()}" for m in ("mit", "mit license") for x, y in ((a, m), (m, a))}
    return out


#: Sentences that are read as they are.
KNOWN_WHOLE = tuple(SENTENCES)
SENTENCES |= _called()
#: Sequences of identifiers and the licence each stands for, in the order they are tried. An identifier with ?
#: may be missing; # is the version (of an SPDX tag: the expression) found in the first sentence of the match.
RULES = (
    ("MIT_TITLE? MIT_GRANT MIT_NOTICE MIT_WARRANTY MIT_LIABILITY?", "MIT"),
    ("BSD_HEAD BSD_SOURCE BSD_BINARY BSD_ADVERT BSD_ENDORSE BSD_WARRANTY BSD_LIABILITY?", "BSD-4-Clause"),
    ("BSD_HEAD BSD_SOURCE BSD_BINARY BSD_ENDORSE BSD_WARRANTY BSD_LIABILITY?", "BSD-3-Clause"),
    ("BSD_HEAD BSD_SOURCE BSD_BINARY BSD_WARRANTY BSD_LIABILITY?", "BSD-2-Clause"),
    ("APACHE_HEAD APACHE_COMPLY APACHE_COPY APACHE_BASIS APACHE_SEE", "Apache-#"),
    ("APACHE_HEAD APACHE_COMPLY APACHE_COPY", "Apache-#"),
    ("GPL_LATER GPL_WARRANTY? GPL_SEE?", "GPL-#-or-later"),
    ("GPL_ONLY GPL_WARRANTY? GPL_SEE?", "GPL-#-only"),
    ("GPL_SHORT", "GPL-#"),
    ("GPL_TITLE VERBATIM? GPL2_PREAMBLE? GPL3_PREAMBLE?", "GPL-#"),
    ("GPL2_PREAMBLE", "GPL-2"),
    ("GPL3_PREAMBLE", "GPL-3"),
    ("LGPL_LATER GPL_WARRANTY? LGPL_SEE?", "LGPL-#-or-later"),
    ("LGPL_SHORT", "LGPL-#"),
    ("LGPL_TITLE", "LGPL-#"),
    ("AGPL_LATER GPL_WARRANTY? AGPL_SEE?", "AGPL-#-or-later"),
    ("AGPL_SHORT", "AGPL-#"),
    ("AGPL_TITLE VERBATIM? AGPL3_PREAMBLE?", "AGPL-#"),
    ("AGPL3_PREAMBLE", "AGPL-3"),
    ("MPL_HEAD", "MPL-#"),
    ("MPL_SHORT", "MPL-#"),
    ("MPL_TITLE MPL_DEFINES?", "MPL-#"),
    ("MPL_DEFINES", "MPL-2.0"),
    ("EPL_HEAD", "EPL-#"),
    ("EPL_TITLE", "EPL-#"),
    ("EPL_SHORT", "EPL-#"),
    ("EPL_PROVIDED EPL_ACCEPTS?", "EPL"),
    ("MIT_APACHE_OR", "Apache-# OR MIT"),
    ("MIT_APACHE_AND", "Apache-# AND MIT"),
    ("APACHE_TITLE APACHE_TERMS? APACHE_DEFINES?", "Apache-#"),
    ("APACHE_TERMS? APACHE_DEFINES", "Apache-2.0"),
    ("APACHE_SHORT", "Apache-#"),
    ("MIT_SHORT", "MIT"),
    ("ARTISTIC_TITLE", "Artistic-#"),
    ("ARTISTIC_SHORT", "Artistic-#"),
    ("EUPL_TITLE", "EUPL-#"),
    ("EUPL_SHORT", "EUPL-#"),
    ("CDDL_TITLE", "CDDL-#"),
    ("CDDL_SHORT", "CDDL-#"),
    ("PSF_TITLE", "PSF-#"),
    ("PSF_SHORT", "PSF-#"),
    ("WTFPL_TITLE VERBATIM? WTFPL_TERM?", "WTFPL"),
    ("WTFPL_SHORT", "WTFPL"),
    ("OPENSSL_TITLE", "OpenSSL"),
    ("OPENSSL_SHORT", "OpenSSL"),
    ("BSD2_SHORT", "BSD-2-Clause"),
    ("BSD3_SHORT", "BSD-3-Clause"),
    ("BSD_CLAUSE", "BSD-#-Clause"),
    ("BSD_SHORT", "BSD"),
    ("ISC_SHORT", "ISC"),
    ("ZLIB_SHORT", "Zlib"),
    ("BOOST_SHORT", "BSL-#"),
    ("SPDX_TAG", "#"),
    ("CC_BY", "CC-BY-#"),
    ("CC_BY_SA", "CC-BY-SA-#"),
    ("CC_BY_NC", "CC-BY-NC-#"),
    ("CC_BY_NC_SA", "CC-BY-NC-SA-#"),
    ("CC_BY_ND", "CC-BY-ND-#"),
    ("CC_BY_NC_ND", "CC-BY-NC-ND-#"),
    ("CC_ZERO", "CC0-#"),
    ("UNLICENSE", "Unlicense"),
    ("ISC_GRANT ISC_WARRANTY? ISC_LIABILITY?", "ISC"),
    ("0BSD_GRANT ISC_WARRANTY ISC_LIABILITY?", "0BSD"),
    ("ZLIB_WARRANTY ZLIB_LIABILITY ZLIB_GRANT ZLIB_ORIGIN ZLIB_CLAIM ZLIB_ALTERED ZLIB_NOTICE", "Zlib"),
    ("BOOST_HEAD", "BSL-#"),
    ("BOOST_TITLE? BOOST_GRANT", "BSL-1.0"),
)
#: The most unknown sentences between two of one match.
GAP = 6
SPACE = r"[ \t\n\r\f\x0B]"
#: Where known sentences go on after . : or ; and white space: what follows, and what stands before.
GOES_ON = "you can redistribute|either version|without even the implied|nor the names of|loss of use|or business interruption"
WITHIN = rf"(?!{SPACE}+[^A-Za-z0-9]*(?i:{GOES_ON}))(?!(?<=\bv\.){SPACE}+[0-9])(?<!(?i:spdx-license-identifier):)"
#: The end of a sentence, a blank line (of comment marks at most), and what is no part of a normalised sentence.
END, BLANK, OTHER, VERSION = rf"([.!?:;]){WITHIN}({SPACE}+|$)", r"\n[^A-Za-z0-9\n]*\n", r"[^a-z0-9#]+", r"[0-9]+(?:\.[0-9]+)*"
#: Lines that are no part of the sentence around them: addresses, copyright notices and SPDX tags.
LONE = r"(?im)^([^A-Za-z0-9\n]*(?:https?://[^ \n]+[^A-Za-z0-9\n]*|copyright (?:\(c\)|©|[0-9]{4})[^\n]*|spdx-license-identifier:[^\n]*))$"
#: An SPDX tag's expression.
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
TAG = rf"(?i)spdx-license-identifier:[ \t]*({_ID}(?:[ \t]+(?:and|or|with)[ \t]+{_ID})*)"
#: The holder that a sentence names.
HOLDER = "^neither the name of .{1,200}? nor the names of "
_CUT, _TAGGED = "\x01", "spdx license identifier "


def normalise(sentence: Column) -> Column:
    """Lower case, versions as #, and single blanks between words. Comment marks, quotes and brackets go with the punctuation.

    A short notice is its licence's name after NOTICE: what has and does it before the name, and where the text is, is left out.
    """
    plain = F.translate(F.lower(sentence), "#", " ")
    plain = F.regexp_replace(plain, rf"(version{SPACE}+|licenses?[/ ]|v\.? ?|cc0 |-|by |nc |sa |nd |attribution |sharealike |commercial |derivatives |apache |gpl |mpl |epl |eupl |cddl )({VERSION})", "$1 # ")
    plain = F.trim(F.regexp_replace(plain, OTHER, " "))
    # As a lambda's argument the plain sentence is made once, not once for each of its uses.
    return F.get(F.transform(F.array(plain), _canonical), F.lit(0))


def _canonical(plain: Column) -> Column:
    """A plain sentence with its holder's name, or what surrounds a short notice, left out."""
    short = F.regexp_replace(F.regexp_replace(plain, f"^{BEFORE}", NOTICE), f"{AFTER}$", "")
    maybe = (F.length(plain) < NOTICE_CHARS) & (plain.contains(" under ") | plain.contains(" by ") | plain.contains(" with "))
    notice = maybe & plain.rlike(f"^{BEFORE}") & ~plain.isin(*KNOWN_WHOLE)
    named = F.when(plain.startswith("neither the name of "), F.regexp_replace(plain, HOLDER, "neither the name of the copyright holder nor the names of "))
    return F.when(notice, short).otherwise(F.coalesce(named, plain))


def sentences(text: Column) -> Column:
    """The sentences of a text in order, not normalised: cut after . ! ? : ; before white space, but not where known ones go on."""
    return F.split(F.regexp_replace(text, END, rf"$1{_CUT}"), _CUT)


def _lookup() -> Column:
    return F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))


def identifiers(text: Column) -> Column:
    """array<struct<id, version, place>> of the known sentences; place is the sentence's number.

    A sentence that is unknown as a whole is read paragraph by paragraph, as titles and copyright notices have no full stop,
    and an unknown paragraph line by line. LONE lines are paragraphs. A line that starts with an SPDX tag is known as that.
    """
    known, table = list(SENTENCES), _lookup()
    is_tag = lambda x: x.plain.startswith(_TAGGED) & ~F.trim(x.raw).contains("\n")
    is_known = lambda x: x.plain.isin(known) | is_tag(x)

    def units(s: Column, place: Column) -> Column:
        mark = lambda r: F.struct(normalise(r).alias("plain"), r.alias("raw"), place.alias("place"))
        lines = lambda p: F.filter(F.transform(F.split(p, "\n"), mark), is_known)
        parts = lambda p: F.when(normalise(p).isin(known), F.array(mark(p))).otherwise(lines(p))
        split = F.flatten(F.transform(F.split(F.regexp_replace(s, LONE, "\n$1\n"), BLANK), parts))
        return F.when(~s.contains("\n"), F.filter(F.array(mark(s)), is_known)).when(normalise(s).isin(known), F.array(mark(s))).otherwise(split)

    def named(x: Column) -> Column:
        whole = x.plain.isin(known)
        version = F.when(whole, F.regexp_extract(x.raw, rf"(?<!(?i:cc)){VERSION}", 0)).otherwise(F.regexp_extract(x.raw, TAG, 1))
        return F.struct(F.coalesce(F.element_at(table, x.plain), F.lit("SPDX_TAG")).alias("id"), version.alias("version"), x.place.alias("place"))

    return F.transform(F.flatten(F.transform(sentences(text), units)), named)


def _pattern(sequence: str) -> str:
    """Items are " id=version " each; the first one's version is group 1."""
    items = [(x.rstrip("?"), x.endswith("?")) for x in sequence.split()]
    version = next(i for i, (_, missing) in enumerate(items) if not missing)
    one = lambda i, x: f" {x}=([^ ]*) " if i == version else f" {x}=[^ ]* "
    return "".join(f"(?:{one(i, x)})?" if missing else one(i, x) for i, (x, missing) in enumerate(items))


def match(found: Column) -> Column:
    """array<string> of licences: each rule in turn takes its sequence, every time it comes, out of what earlier rules left.

    Sentences of one match have at most GAP unknown ones between any two that follow each other. Where a rule's licence names
    a version, it is that of the match's own first sentence.
    """

    def item(x: Column, i: Column) -> Column:
        far = (i > 0) & (x.place - F.get(found, i - 1).place > GAP + 1)
        return F.concat(F.when(far, F.lit("|")).otherwise(F.lit("")), F.lit(" "), x.id, F.lit("="), F.translate(x.version, " \t", "__"), F.lit(" "))

    rules = F.array(*(
        F.struct(F.lit(_pattern(seq)).alias("seq"), F.lit(f" {next(x for x in seq.split() if x[-1] != '?')}=").alias("head"), F.lit(name).alias("name"))
        for seq, name in RULES
    ))
    start = F.struct(F.array_join(F.transform(found, item), "").alias("left"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        names = F.transform(F.regexp_extract_all(acc["left"], rule["seq"], F.lit(1)), lambda v: F.replace(rule["name"], F.lit("#"), F.translate(v, "_", " ")))
        after = F.struct(F.regexp_replace(acc["left"], rule["seq"], F.lit("|")).alias("left"), F.concat(acc["names"], names).alias("names"))
        return F.when(F.contains(acc["left"], rule["head"]), after).otherwise(acc)

    return F.array_sort(F.array_distinct(F.aggregate(rules, start, step, lambda a: a["names"])))


def scan(df: DataFrame, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Kept columns and identifiers (array), licences (array, in order of name) of every whole text.

    Null and empty texts, and those without a known sentence, have empty arrays. An SPDX tag's licence is its
    whole expression. Repeated rows stay. Nothing is shuffled and no Python runs. Raises ValueError where a kept column is named like one of the result's.
    """
    kept = Kept(df, keep, ("identifiers", "licences"))
    found = df.select(*kept.columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).withColumn("__found", identifiers(F.col("__text")))
    made = found.withColumn("identifiers", F.transform("__found", lambda x: x.id)).withColumn("licences", F.when(F.size("__found") > 0, match(F.col("__found"))).otherwise(F.array().cast("array<string>"))).drop("__text", "__found")
    return kept.named(made)
