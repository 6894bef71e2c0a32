"""License scan by ordered signature rules, with DataFrame functions only.

Texts are reduced to ASCII-lowered words joined by one space. A rule is a regular expression over that
form, tried only where its keyword occurs. The rules are of three kinds, in order of priority: signatures quoted from
licenses' own notices and texts, names of license families in sentence forms, and general phrases. Detections are
intervals; one that lies within another goes if the other is longer or, for the same interval, has the higher priority.
The base phrases are counted beside the rules and always stay.

Null or empty text has no words, no labels and score 0; texts of any length are read whole (suppression compares the
detections of one text with each other). Repeated rows stay; labels of detections of the same interval and priority all stay.
An empty table gives an empty result. Further columns are kept, but for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label (followed by " name" where a family has two): (keyword, which every text of the name holds, name as a regular expression over words)
FAMILIES = {
    "mit": ("mit", "mit"), "apache-2": ("apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    "apache-1": ("apache", "apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    "gpl-1": ("1", "(?:gnu )?(?:gpl|general public license)(?: version)? v?1(?: 0)?"),
    "gpl-2": ("2", "(?:gnu )?(?:gpl|general public license)(?: version)? v?2(?: 0)?"),
    "gpl-3": ("3", "(?:gnu )?(?:gpl|general public license)(?: version)? v?3(?: 0)?"),
    "gpl": ("gnu", "gnu (?:gpl|general public license)"),
    "lgpl-2": ("2", "(?:gnu )?(?:lgpl|lesser general public license|library general public license)(?: version)? v?2(?: [01])?"),
    "lgpl-3": ("3", "(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?3(?: 0)?"),
    "lgpl": ("gnu", "gnu (?:lgpl|lesser general public license)"),
    "agpl-3": ("affero", "(?:gnu )?affero general public license(?: version)?(?: v?3(?: 0)?)?"),
    "fdl": ("documentation", "(?:gnu )?free documentation license(?: version)?(?: 1 [123])?"),
    "bsd-2": ("bsd", "(?:2 clause|two clause|simplified|freebsd) bsd|bsd 2 clause"),
    "bsd-3": ("bsd", "(?:3 clause|three clause|new|modified|revised) bsd|bsd 3 clause"),
    "bsd-4": ("bsd", "(?:4 clause|original) bsd|bsd 4 clause"), "bsd-0": ("0bsd", "0bsd"), "bsd": ("bsd", "bsd"),
    "isc": ("isc", "isc"), "mpl-1": ("mozilla", "mozilla public license(?: version)? 1(?: [01])?"),
    "mpl-2": ("mozilla", "mozilla public license(?: version)? 2(?: 0)?"),
    "epl-1": ("eclipse", "eclipse public license(?: version)?(?: v)? 1(?: 0)?"),
    "epl-2": ("eclipse", "eclipse public license(?: version)?(?: v)? 2(?: 0)?"),
    "eupl": ("european", "european union public licen[cs]e(?: version)?(?: 1 [12])?"),
    "cddl": ("distribution", "common development and distribution license"),
    "cpl": ("common", "common public license"), "artistic-1": ("artistic", "artistic license(?: version)? 1(?: 0)?"),
    "artistic-2": ("artistic", "artistic license(?: version)? 2(?: 0)?"),
    "boost": ("boost", "boost software license(?: version)?(?: 1 0)?"), "zlib": ("zlib", "zlib(?: libpng)?"),
    "unlicense": ("unlicense", "unlicense"), "wtfpl": ("wtfpl", "wtfpl"), "psf": ("python", "python software foundation"),
    "openssl": ("openssl", "openssl"), "php": ("php", "php"), "ofl": ("font", "sil open font license(?: version)?(?: 1 1)?"),
    "cc0": ("cc0", "cc0(?: 1 0)?"), "cc-by": ("attribution", "creative commons attribution(?: [1-4] 0)?"),
    "cc-by-sa": ("sa", "cc by sa(?: [1-4] 0)?"), "cc-by-sa name": ("sharealike", "creative commons attribution sharealike"),
    "cc-by-nc": ("nc", "cc by nc(?: [1-4] 0)?"), "cc-by-nd": ("nd", "cc by nd(?: [1-4] 0)?"),
    "cc-by-nc-sa": ("nc", "cc by nc sa(?: [1-4] 0)?"), "cc-by-nc-nd": ("nc", "cc by nc nd(?: [1-4] 0)?"),
    "odbl": ("database", "open database license"), "ms-pl": ("microsoft", "microsoft public license"),
}
#: (form around the name, keyword or None for the family's, priority, strength); every family takes each form.
FORMS = [
    ("spdx license identifier (?:{n})", "spdx", 5, 1.0),
    ("(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:{n})(?: licen[cs]e)?", None, 4, 0.95),
    ("subject to (?:the )?(?:terms of (?:the )?)?(?:{n})(?: licen[cs]e)?", None, 3, 0.9),
    ("licen[cs]e (?:{n})", None, 2, 0.8),
    ("(?:the )?(?:{n}) licen[cs]e", None, 1, 0.7),
]
#: Signatures from licenses' own notices and texts: label, keyword, expression over words, strength.
SIGNATURES = [
    ("gpl-1", "version 1 of the license", "gnu general public license as published by the free software foundation (?:either )?version 1 of the license(?: or at your option any later version)?", 1.0),
    ("gpl-2", "version 2 of the license", "gnu general public license as published by the free software foundation (?:either )?version 2 of the license(?: or at your option any later version)?", 1.0),
    ("gpl-3", "version 3 of the license", "gnu general public license as published by the free software foundation (?:either )?version 3 of the license(?: or at your option any later version)?", 1.0),
    ("gpl-2", "version 2", "gnu general public license version 2 as published by the free software foundation", 1.0),
    ("gpl-3", "version 3", "gnu general public license version 3 as published by the free software foundation", 1.0),
    ("gpl", "general public license", "under the terms of the gnu general public license as published by the free software foundation", 0.9),
    ("gpl-2", "gplv2", "gplv2(?: or later)?", 0.9), ("gpl-3", "gplv3", "gplv3(?: or later)?", 0.9), ("gpl-2", "gpl2", "gpl2", 0.8), ("gpl-3", "gpl3", "gpl3", 0.8),
    ("gpl-2", "gpl 2", "gpl 2(?: 0)?(?: only| or later)", 0.95), ("gpl-3", "gpl 3", "gpl 3(?: 0)?(?: only| or later)", 0.95), ("gpl-1", "gpl 1", "gpl 1(?: 0)?(?: only| or later)", 0.95),
    ("gpl-2", "june 1991", "gnu general public license version 2 june 1991", 1.0), ("gpl-3", "june 2007", "gnu general public license version 3 29 june 2007", 1.0),
    ("gpl", "received a copy of the gnu", "you should have received a copy of the gnu general public license along with", 0.9),
    ("lgpl-2", "version 2", "gnu (?:lesser|library) general public license as published by the free software foundation (?:either )?version 2(?: 1)? of the license(?: or at your option any later version)?", 1.0),
    ("lgpl-3", "version 3", "gnu lesser general public license as published by the free software foundation (?:either )?version 3 of the license(?: or at your option any later version)?", 1.0),
    ("lgpl-2", "lgplv2", "lgplv2(?: 1)?(?: or later)?", 0.9), ("lgpl-3", "lgplv3", "lgplv3(?: or later)?", 0.9), ("lgpl-2", "lgpl 2", "lgpl 2(?: [01])?(?: only| or later)", 0.95), ("lgpl-3", "lgpl 3", "lgpl 3(?: 0)?(?: only| or later)", 0.95),
    ("lgpl-2", "february 1999", "gnu lesser general public license version 2 1 february 1999", 1.0), ("lgpl-2", "june 1991", "gnu library general public license version 2 june 1991", 1.0),
    ("lgpl", "received a copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public license along with", 0.9),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation (?:either )?version 3 of the license(?: or at your option any later version)?", 1.0),
    ("agpl-3", "agplv3", "agplv3(?: or later)?", 0.9), ("agpl-3", "agpl 3", "agpl 3(?: 0)?(?: only| or later)?", 0.95), ("agpl-3", "november 2007", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("fdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: version 1 [123])?(?: or any later version)?", 1.0),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2", "licenses license 2 0", "(?:https? )?(?:www )?apache org licenses license 2 0", 0.95),
    ("apache-2", "asl", "asl(?: version)? 2(?: 0)?", 0.8), ("apache-2", "apache", "apache license version 2 0 january 2004", 1.0), ("apache-2", "apache", "apache 2(?: 0)?(?: license)?", 0.85),
    ("apache-2", "contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-1", "apache", "apache software license version 1 1", 1.0),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?", 1.0),
    ("mit", "mit", "(?:this software is )?(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mit(?: x11)?(?: expat)? licen[cs]e", 1.0),
    ("mit", "opensource", "opensource org licenses mit(?: license)?", 0.95), ("mit", "expat", "(?:the )?expat licen[cs]e", 0.8), ("mit", "mit", "dual licensed under (?:the )?mit", 0.8),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", "the software is provided as is", "the software is provided as is without warranty of any kind express or implied", 0.7),
    ("bsd-2", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.85),
    ("bsd-3", "neither the name", "neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 1.0),
    ("bsd-3", "bsd", "(?:use of this source code is )?governed by a bsd style license", 0.9), ("bsd-2", "bsd 2", "bsd 2 clause(?: license)?", 0.9), ("bsd-3", "bsd 3", "bsd 3 clause(?: license)?", 0.9),
    ("bsd-2", "opensource", "opensource org licenses bsd 2 clause", 0.95), ("bsd-3", "opensource", "opensource org licenses bsd 3 clause", 0.95), ("bsd", "bsd", "bsd licensed", 0.8),
    ("bsd-0", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8),
    ("isc", "permission notice appear", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("isc", "isc", "(?:the )?isc licen[cs]e", 0.9), ("isc", "opensource", "opensource org licenses isc", 0.95),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", 1.0), ("mpl-2", "mozilla", "mozilla public license v(?:ersion)? 2(?: 0)?", 0.95),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]", 1.0), ("mpl-2", "mpl", "mpl(?: v)? ?2(?: 0)?", 0.85), ("mpl-2", "mozilla org", "mozilla org mpl 2 0", 0.95),
    ("epl-1", "eclipse", "eclipse public license v(?:ersion)? ?1 0 which accompanies this distribution", 1.0), ("epl-1", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?1(?: 0)?", 1.0),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?2 0", 1.0), ("epl-2", "epl", "epl 2 0", 0.9), ("epl-1", "epl", "epl (?:v )?1 0", 0.9),
    ("eupl", "eupl", "(?:licensed under the )?eupl(?: version)?(?: v?1 [12])?", 0.95), ("cddl", "cddl", "cddl(?: 1 [01])?", 0.9),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cpl", "common public license", "common public license v(?:ersion)? ?1 0", 0.95), ("artistic-2", "artistic", "artistic license 2 0", 0.95), ("artistic-1", "perl itself", "same terms as perl itself", 0.6),
    ("boost", "boost", "distributed under the boost software license version 1 0", 1.0), ("boost", "bsl", "bsl 1 0", 0.85),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[cs]e", 0.9), ("zlib", "express or implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 1.0), ("unlicense", "unlicense", "unlicense org", 0.9),
    ("wtfpl", "what the", "do what the f[^ ]* you want to public license", 1.0), ("wtfpl", "wtfpl", "wtfpl", 0.8),
    ("psf", "python", "python software foundation license(?: version 2)?", 0.95), ("psf", "psf", "psf license(?: agreement)?", 0.85), ("openssl", "openssl", "this product includes software developed by the openssl project", 0.9),
    ("php", "php", "this source file is subject to version [23] [0-9]+ of the php license", 1.0), ("ruby", "ruby", "(?:the )?ruby licen[cs]e", 0.85), ("ofl", "open font", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9), ("cc0", "public domain", "creative commons public domain dedication", 0.9), ("cc0", "publicdomain", "creativecommons org publicdomain zero 1 0", 1.0),
    ("cc0", "waived all copyright", "waived all copyright and related or neighboring rights", 0.95),
    ("cc-by", "attribution", "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 0.95),
    ("cc-by-sa", "share", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 1.0),
    ("cc-by-nc", "commercial", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 1.0),
    ("cc-by-nd", "deriv", "creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 1.0),
    ("cc-by-nc-sa", "commercial", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 1.0),
    ("cc-by-nc-nd", "commercial", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 1.0),
    ("cc-by", "licenses by", "creativecommons org licenses by [1-4] [05]", 1.0), ("cc-by-sa", "licenses by sa", "creativecommons org licenses by sa [1-4] [05]", 1.0), ("cc-by-nc", "licenses by nc", "creativecommons org licenses by nc [1-4] [05]", 1.0),
    ("cc-by-nd", "licenses by nd", "creativecommons org licenses by nd [1-4] [05]", 1.0), ("cc-by-nc-sa", "licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05]", 1.0),
    ("cc-by-nc-nd", "licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05]", 1.0),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])", 0.9), ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?", 0.9), ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?", 0.9), ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?", 0.9),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?", 0.95), ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?", 0.95),
    ("odbl", "database", "(?:made available under the )?open (?:data commons )?(?:open )?database license(?: v?1 0)?", 0.95), ("odc-by", "data commons", "open data commons attribution license(?: v?1 0)?", 0.95), ("pddl", "data commons", "open data commons public domain dedication", 0.95),
    ("ms-pl", "microsoft", "microsoft public license(?: ms pl)?", 0.95), ("ms-rl", "microsoft", "microsoft reciprocal license(?: ms rl)?", 0.95), ("upl", "universal permissive", "universal permissive license(?: version)?(?: v? ?1 0)?", 0.95),
    ("bsl", "business source", "business source license(?: version)?(?: 1 1)?", 0.95), ("sspl", "server side", "server side public license(?: version)?(?: 1)?", 0.95), ("elastic", "elastic", "elastic license(?: 2 0)?", 0.9),
    ("commons-clause", "commons clause", "commons clause license condition(?: v1 0)?", 0.95), ("vim", "vim", "(?:the )?vim license", 0.85), ("beerware", "beer", "the beer ware license", 0.95), ("tex", "latex", "latex project public license(?: version)?(?: 1 [0-9][a-c]?)?", 0.95),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", 0.95), ("afl", "academic free", "academic free license(?: version)?(?: v? ?[123] [0-9])?", 0.95), ("osl", "open software", "open software license(?: version)?(?: v? ?[123] [0-9])?", 0.95),
    ("w3c", "w3c", "w3c software(?: notice)?(?: and document)? license", 0.95), ("ogl", "open government", "open government licen[cs]e(?: v[123] 0)?", 0.95), ("proprietary", "confidential", "confidential and proprietary", 0.7),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 0.95), ("proprietary", "written permission", "without (?:the )?(?:prior |express )*written permission of the copyright (?:holder|owner)s?", 0.7),
]
#: Rules without a version or name: (label, keyword, expression, priority, strength).
GENERAL = [
    ("all-rights-reserved", "reserved", "all rights reserved", 1, 0.6),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 2, 0.8),
    ("copyright", "copyright", "copyright (?:c )?[12][0-9]{3}", 0, 0.3),
    ("cc-by-nc", "nc", "cc by nc", 1, 0.8), ("cc-by-sa", "sa", "cc by sa", 1, 0.8), ("cc-by", "cc", "cc by [1-4] 0", 1, 0.8),
    ("mit", "provided as is", "the software is provided as is without warranty of any kind", 2, 0.6),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 4, 0.9),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 4, 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 3, 0.8),
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules, in order: each family in each form, then the signatures (which rank above all forms) and the general ones."""
    made = [
        (label.removesuffix(" name"), keyword or own, form.format(n=name), priority, strength)
        for label, (own, name) in FAMILIES.items() for form, keyword, priority, strength in FORMS
    ]
    return made + [(label, keyword, form, 6, strength) for label, keyword, form, strength in SIGNATURES] + GENERAL


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def normalised(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _detections(norm: Column) -> Column:
    """Intervals (in characters) of all rules in a text with a blank at both ends."""
    known = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(f"{key}").alias("key"), F.lit(f"(?<= )(?:{form})(?= )").alias("form"),
                 F.lit(priority).alias("priority"), F.lit(strength).alias("strength"))
        for label, key, form, priority, strength in rules()])

    def intervals(rule: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["form"], F.lit(0))
        gaps = F.transform(F.split(norm, rule["form"], -1), lambda g: F.length(g))
        sizes = F.transform(found, lambda f: F.length(f))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

        def step(s: Column, p: Column) -> Column:
            a = s["at"] + p["gap"]
            return F.struct((a + p["size"]).alias("at"), F.concat(
                s["spans"], F.array(F.struct(a.alias("a"), (a + p["size"]).alias("b")))).alias("spans"))

        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
        spans = F.when(F.size(sizes) > 0, F.aggregate(pairs, start, step)["spans"]).otherwise(start["spans"])
        return F.transform(spans, lambda s: F.struct(
            s["a"].alias("a"), s["b"].alias("b"), rule["priority"].alias("priority"), rule["label"].alias("label"),
            rule["strength"].alias("strength")))

    return F.flatten(F.transform(F.filter(known, lambda r: F.contains(norm, r["key"])), intervals))


def _kept(found: Column) -> Column:
    def beaten(x: Column) -> Column:
        return F.exists(found, lambda y: (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & (
            (y["b"] - y["a"] > x["b"] - x["a"]) | (y["priority"] > x["priority"])))
    return F.filter(found, lambda x: ~beaten(x))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """All columns of docs and those of the query's contract."""
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    columns = [c for c in docs.columns if c not in made]
    norm = docs.select(*columns, normalised(F.col("text")).alias("__norm"))
    texts = norm.withColumn("__norm", F.concat(F.lit(" "), F.col("__norm"), F.lit(" ")))
    n_words = F.when(F.col("__norm") == "  ", F.lit(0)).otherwise(_spaces(F.col("__norm")) - 1)
    # one word of every rule's shortest text, as a test makes sure
    gate = (r" (?:attribution|openssl|bsl|licen[cs]e[ds]?|licensing|unlicense|released|distributed|published|available|provided|subject|spdx|copyright|cc|reserved|domain|permission|redistribution|"
            r"a?l?gpl[v0-9]*|lgpl|mpl2?|epl|eupl|cddl|asl|apache|bsd|cc0|wtfpl|warranty|confidential|copying|creativecommons|opensource|perl|neither|advertising|altered|waived) ")
    detected = F.when(F.col("__norm").rlike(gate), _let(F.col("__norm"), lambda n: _let(_detections(n), _kept)))
    pieces = {p: F.when(F.contains("__norm", F.lit(f" {p} ")), F.split("__norm", f" {p}(?= )", -1)) for p in BASE}
    out = texts.select("*", n_words.cast("long").alias("n_words"), detected.alias("__found"),
                       *[c.alias(f"__p{i}") for i, c in enumerate(pieces.values())])
    count, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for i, (phrase, label) in enumerate(BASE.items()):
        p = F.col(f"__p{i}")
        count = count + F.coalesce(F.size(p) - 1, F.lit(0)).cast("long")
        firsts.append(_spaces(p[0]))
        after = _spaces(F.element_at(p, -1))
        lasts.append(F.col("n_words") - (after - 1) - len(phrase.split()))
        labels.append(F.when(p.isNotNull(), F.lit(label)))
    base = F.array_compact(F.array(*labels))
    own = F.coalesce(F.transform("__found", lambda x: x["label"]), F.array().cast("array<string>"))
    strength = F.coalesce(F.array_max(F.transform("__found", lambda x: x["strength"])), F.lit(0.0))
    return out.select(
        *columns, "n_words", count.alias("n_base"), F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(count > 0, F.lit(1.0)).otherwise(strength).alias("score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
