"""License scans by ordered signature rules.

Rules are regular expressions over the text's lower-cased words, each gated by sets of keywords of which one has to be among them.
Every document gets only the rules of which it has one set of keywords; detections that lie inside a better rule's are suppressed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._native import let, spaced_words

#: Phrases whose every place counts, whatever else covers it, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licenses by label: keywords (sets apart by |, any of which suffices), pattern of the name over words, and words of the license's own web address.
#: In patterns, V stands for a version such as "2 0" or "v3".
FAMILIES: dict[str, tuple[str, str, str]] = {
    "apache": ("apache", "apache(?: software)?", "apache org licenses"),
    "mit": ("mit license|mit licence|mit licensed|mit under|mit agreement|mit dedication|mit x11|mit expat", "mit(?: x11| expat)?", "opensource org licenses mit"),
    "bsd": ("bsd|freebsd", "(?:modified |simplified |new |revised |original )?(?:free)?bsd(?: [0234] clause)?", "opensource org licenses bsd"),
    "bsd-2-clause": ("bsd clause|bsd simplified", "(?:2 clause bsd|bsd 2 clause|simplified bsd)", "opensource org licenses bsd 2 clause"),
    "bsd-3-clause": ("bsd clause|bsd new|bsd revised", "(?:3 clause bsd|bsd 3 clause|new bsd|revised bsd)", "opensource org licenses bsd 3 clause"),
    "bsd-4-clause": ("bsd clause|bsd original", "(?:4 clause bsd|bsd 4 clause|original bsd)", "spdx org licenses bsd 4 clause"),
    "0bsd": ("0bsd", "0bsd", "spdx org licenses 0bsd"),
    "gpl": ("general public", "(?:gnu )?general public", "gnu org licenses gpl"),
    "gpl-short": ("gpl", "(?:gnu )?gpl", "gnu org copyleft gpl"),
    "lgpl": ("lesser general", "(?:gnu )?lesser general public", "gnu org licenses lgpl"),
    "lgpl-short": ("lgpl", "(?:gnu )?lgpl", "gnu org copyleft lesser"),
    "library-gpl": ("library general", "(?:gnu )?library general public", "gnu org licenses old licenses library"),
    "agpl": ("affero", "(?:gnu )?affero(?: general public)?", "gnu org licenses agpl"),
    "agpl-short": ("agpl", "(?:gnu )?agpl", "fsf org licensing agpl"),
    "gfdl": ("free documentation", "(?:gnu )?free documentation", "gnu org licenses fdl"),
    "gfdl-short": ("gfdl", "(?:gnu )?gfdl", "gnu org copyleft fdl"),
    "mpl": ("mozilla", "mozilla public", "mozilla org mpl"),
    "mpl-short": ("mpl", "mpl", "spdx org licenses mpl"),
    "epl": ("eclipse", "eclipse public", "eclipse org legal epl"),
    "edl": ("eclipse distribution", "eclipse distribution", "eclipse org licenses edl"),
    "cddl": ("cddl", "cddl", "opensource org licenses cddl"),
    "cddl-long": ("common development", "common development and distribution", "oracle com cddl"),
    "cpl": ("common public", "common public", "opensource org licenses cpl"),
    "ipl": ("ibm public", "ibm public", "opensource org licenses ibmpl"),
    "isc": ("isc", "isc", "opensource org licenses isc"),
    "zlib": ("zlib", "zlib(?: libpng)?", "zlib net zlib license"),
    "libpng": ("libpng", "libpng", "libpng org pub png src libpng license"),
    "boost": ("boost", "boost(?: software)?", "boost org license"),
    "artistic": ("artistic", "artistic", "perlfoundation org artistic license"),
    "python": ("python", "python(?: software foundation)?", "docs python org license"),
    "ruby": ("ruby", "ruby", "ruby lang org license"),
    "php": ("php", "php", "php net license"),
    "perl": ("perl", "(?:the same terms as )?perl(?: itself)?", "dev perl org licenses"),
    "w3c": ("w3c", "w3c(?: software)?(?: notice and)?", "w3 org consortium legal"),
    "unlicense": ("unlicense", "unlicense", "unlicense org"),
    "wtfpl": ("wtfpl", "wtfpl", "wtfpl net"),
    "openssl": ("openssl", "openssl", "openssl org source license"),
    "postgresql": ("postgresql", "postgresql", "postgresql org about licence"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "opensource org licenses ncsa"),
    "ms-pl": ("microsoft public", "microsoft public", "opensource org licenses ms pl"),
    "ms-rl": ("microsoft reciprocal", "microsoft reciprocal", "opensource org licenses ms rl"),
    "ofl": ("sil font", "sil open font", "scripts sil org ofl"),
    "ofl-short": ("ofl", "ofl", "openfontlicense org"),
    "eupl": ("eupl", "eupl", "joinup ec europa eu eupl"),
    "eupl-long": ("european union", "european union public", "eur lex europa eu eupl"),
    "cecill": ("cecill", "cecill(?: [abc])?", "cecill info licences"),
    "osl": ("open software", "open software", "opensource org licenses osl"),
    "afl": ("academic free", "academic free", "opensource org licenses afl"),
    "ecl": ("educational community", "educational community", "opensource org licenses ecl"),
    "upl": ("universal permissive", "universal permissive", "oss oracle com licenses upl"),
    "bsl": ("business source", "business source", "mariadb com bsl"),
    "sspl": ("server side public", "server side public", "mongodb com licensing server side public license"),
    "sspl-short": ("sspl", "sspl", "spdx org licenses sspl"),
    "elastic": ("elastic", "elastic", "elastic co licensing elastic license"),
    "odbl": ("open database", "open database", "opendatacommons org licenses odbl"),
    "odbl-short": ("odbl", "odbl", "spdx org licenses odbl"),
    "odc-by": ("open data commons", "open data commons attribution", "opendatacommons org licenses by"),
    "pddl": ("pddl", "pddl", "opendatacommons org licenses pddl"),
    "ogl": ("open government", "open government", "nationalarchives gov uk doc open government licence"),
    "openrail": ("openrail", "(?:creativeml )?openrail(?: m)?", "huggingface co spaces bigscience license"),
    "cc-by": ("cc by|cc attribution|creative commons by|creative commons attribution", "(?:creative commons|cc) (?:by|attribution)", "creativecommons org licenses by"),
    "cc-by-sa": ("cc sa|cc attribution|creative commons sa|creative commons attribution", "(?:creative commons|cc) (?:by sa|attribution share ?alike)", "creativecommons org licenses by sa"),
    "cc-by-nc": ("cc nc|cc attribution|creative commons nc|creative commons attribution", "(?:creative commons|cc) (?:by nc|attribution non ?commercial)", "creativecommons org licenses by nc"),
    "cc-by-nd": ("cc nd|cc attribution|creative commons nd|creative commons attribution", "(?:creative commons|cc) (?:by nd|attribution no ?deriv(?:ative)?s)", "creativecommons org licenses by nd"),
    "cc-by-nc-sa": ("cc nc sa|cc attribution|creative commons nc sa|creative commons attribution", "(?:creative commons|cc) (?:by nc sa|attribution non ?commercial share ?alike)", "creativecommons org licenses by nc sa"),
    "cc-by-nc-nd": ("cc nc nd|cc attribution|creative commons nc nd|creative commons attribution", "(?:creative commons|cc) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)", "creativecommons org licenses by nc nd"),
    "cc0": ("cc0", "cc0", "creativecommons org publicdomain zero"),
    "cc-long": ("creative commons", "creative commons", "creativecommons org licenses"),
    "public-domain": ("public domain", "public domain", "creativecommons org publicdomain mark"),
    "proprietary": ("proprietary", "proprietary(?: and confidential)?", ""),
}

#: Families whose names are other things too: they need the word license behind them, and no version alone makes a license.
OTHER_THINGS = {"apache", "mit", "bsd", "isc", "zlib", "libpng", "boost", "artistic", "python", "ruby", "php", "perl", "w3c", "openssl", "postgresql", "ncsa", "elastic", "public-domain", "proprietary", "osl", "odbl", "ogl", "bsl", "edl", "afl", "ecl"}
#: Of those, the ones that are named without that word behind "released under".
GRANTED_BARE = {"apache", "mit", "bsd", "isc", "zlib", "artistic", "boost", "public-domain", "odbl"}

#: Ways to say it: name, extra keywords, pattern around NAME and V, priority (a smaller one wins) and confidence.
FORMS = (
    ("tag", "spdx", "spdx license identifier NAME(?: only| or later)?V", 1, 1.0),
    ("grant", "under", "(?:licen[sc]ed|released|distributed|available|provided|published|covered|shared|offered|redistribut(?:ed|able)) under (?:the )?(?:terms of (?:the )?)?(?:a |an )?NAMELICENSEV", 2, 0.9),
    ("terms", "under terms", "under (?:the )?(?:terms|conditions|terms and conditions) of (?:the )?(?:a |an )?NAMELICENSEV", 2, 0.8),
    ("address", "org", "(?:https? )?(?:www )?ADDRESS", 2, 0.8),
    ("named", "", "NAME (?:licen[sc]e|agreement|dedication)V", 3, 0.7),
    ("adjective", "licensed", "NAMEV (?:dual )?licensed", 3, 0.7),
    ("field", "license", "(?:license|license type|license name|project license) NAMEV", 4, 0.6),
    ("versioned", "", "NAME(?: licen[sc]e)? (?:version |v ?)?\\d{1,2}(?: \\d{1,2})?", 4, 0.5),
)
#: A version behind a name, or nothing.
VERSION = "(?: (?:version |v ?)?\\d{1,2}(?: \\d{1,2}){0,2})?"

#: Identifiers behind "SPDX-License-Identifier", as words, of which the name in FAMILIES isn't the identifier: fixed values.
SPDX: dict[str, str] = {
    "epl": "epl (?:1 0|2 0)", "edl": "bsd 3 clause eclipse", "cpl": "cpl 1 0", "ipl": "ipl 1 0", "boost": "bsl 1 0", "bsl": "busl 1 1", "artistic": "artistic (?:1 0|2 0)(?: perl| cl8)?", "python": "(?:python|psf) 2 0",
    "php": "php 3 01?", "ms-pl": "ms pl", "ms-rl": "ms rl", "osl": "osl (?:1 0|1 1|2 0|2 1|3 0)", "afl": "afl (?:1 1|1 2|2 0|2 1|3 0)", "ecl": "ecl (?:1 0|2 0)", "upl": "upl 1 0", "elastic": "elastic 2 0",
    "ncsa": "ncsa", "odc-by": "odc by 1 0", "pddl": "pddl 1 0", "odbl": "odbl 1 0", "ogl": "ogl(?: uk)?(?: (?:1|2|3) 0)?", "cc0": "cc0 1 0", "cc-by": "cc by (?:1|2|3|4) [05]", "cc-by-sa": "cc by sa (?:1|2|3|4) [05]",
    "cc-by-nc": "cc by nc (?:1|2|3|4) [05]", "cc-by-nd": "cc by nd (?:1|2|3|4) [05]", "cc-by-nc-sa": "cc by nc sa (?:1|2|3|4) [05]", "cc-by-nc-nd": "cc by nc nd (?:1|2|3|4) [05]", "mit-0": "mit 0", "zlib": "zlib acknowledgement",
    "apsl": "apsl (?:1|2) [012]", "nasa": "nasa 1 3", "sleepycat": "sleepycat", "vim": "vim", "curl": "curl", "blueoak": "blueoak 1 0 0", "mulan": "mulanpsl (?:1|2) 0", "rpl": "rpl 1 [15]", "qpl": "qpl 1 0", "hpnd": "hpnd", "tcl": "tcl",
    "x11": "x11", "ftl": "ftl", "ijg": "ijg", "icu": "icu", "beerware": "beerware", "json": "json", "lppl": "lppl 1 [0123][ac]?", "catosl": "catosl 1 1", "cecill": "cecill (?:[abc]|1 0|1 1|2 0|2 1|b|c)", "opl": "(?:opl|opubl) 1 0",
}

#: Notices written by hand: label, sets of keywords (apart by |), pattern, priority, confidence.
NOTICES: tuple[tuple[str, str, str, int, float], ...] = (
    ("gpl", "gplv1|gplv2|gplv3", "(?:gnu )?gplv[123](?: [01])?(?: only| or later)?", 3, 0.7),
    ("lgpl", "lgplv2|lgplv3|lgplv21", "(?:gnu )?lgplv(?:2|21|3)(?: [01])?(?: only| or later)?", 3, 0.7),
    ("agpl", "agplv1|agplv3", "(?:gnu )?agplv[13](?: 0)?(?: only| or later)?", 3, 0.7),
    ("gpl", "free software|redistribute modify", "(?:is )?free software you (?:can|may) redistribute it and or modify it under the terms of the gnu general public license(?: version [123])?", 1, 1.0),
    ("lgpl", "lesser redistribute", "(?:is )?free software you (?:can|may) redistribute it and or modify it under the terms of the gnu lesser general public license(?: version (?:2|3))?", 1, 1.0),
    ("agpl", "affero redistribute", "(?:is )?free software you (?:can|may) redistribute it and or modify it under the terms of the gnu affero general public license(?: version 3)?", 1, 1.0),
    ("apache", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version)? v?(?:2 0|1 1)(?: licen[sc]ed?)?", 4, 0.5),
    ("apache", "apache asl|asl", "asl (?:v ?)?2(?: 0)?", 4, 0.5),
    ("mit", "mit style|mit like|mit type", "(?:an? )?mit (?:style|like|type) licen[sc]ed?", 3, 0.7),
    ("mit", "expat", "expat licen[sc]ed?", 3, 0.7),
    ("mit", "hereby granted charge", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?", 2, 0.9),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software", 2, 0.9),
    ("bsd", "bsd style|bsd like|bsd type", "(?:an? )?bsd (?:style|like|type) licen[sc]ed?", 3, 0.7),
    ("bsd", "redistribution binary forms", "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.9),
    ("bsd-3-clause", "neither endorse promote", "neither the name of .{1,120}? may be used to endorse or promote products", 2, 0.9),
    ("0bsd", "zero clause", "(?:bsd zero clause|zero clause bsd|free public license 1 0 0)(?: licen[sc]e)?", 3, 0.7),
    ("0bsd", "0 clause bsd", "(?:bsd 0 clause|0 clause bsd)(?: licen[sc]e)?", 3, 0.7),
    ("isc", "permission purpose fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 2, 0.9),
    ("zlib", "implied damages", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", 2, 0.9),
    ("boost", "boost accompanying", "boost software license version 1 0(?: see accompanying file)?", 2, 0.9),
    ("unlicense", "unlicense", "(?:the )?unlicense", 4, 0.5),
    ("unlicense", "unencumbered domain", "this is free and unencumbered software released into the public domain", 1, 1.0),
    ("wtfpl", "fuck public", "do what the fuck you want to public licen[sc]e", 2, 0.9),
    ("beerware", "beer ware|beerware", "(?:the )?beer ?ware licen[sc]e", 3, 0.7),
    ("cc0", "creative commons zero|cc zero", "(?:creative commons|cc) zero(?: v ?1(?: 0)?| 1 0)?(?: universal)?(?: licen[sc]e)?", 3, 0.7),
    ("cc0", "cc0", "cc0 (?:1 0 )?universal", 3, 0.7),
    ("cc-by", "attribution", "attribution (?:1|2|3|4) [05](?: international| unported| generic| licen[sc]e)", 3, 0.7),
    ("cc-by-sa", "attribution share|attribution sharealike", "attribution share ?alike (?:1|2|3|4) [05](?: international| unported| generic| licen[sc]e)?", 3, 0.7),
    ("cc-by-nc", "attribution noncommercial|attribution non", "attribution non ?commercial (?:1|2|3|4) [05](?: international| unported| generic| licen[sc]e)?", 3, 0.7),
    ("cc-by-nd", "attribution noderivatives|attribution noderivs|attribution no", "attribution no ?deriv(?:ative)?s (?:1|2|3|4) [05](?: international| unported| generic| licen[sc]e)?", 3, 0.7),
    ("cc-by-nc-sa", "attribution noncommercial|attribution non", "attribution non ?commercial share ?alike (?:1|2|3|4) [05](?: international| unported| generic| licen[sc]e)?", 3, 0.7),
    ("cc-by-nc-nd", "attribution noncommercial|attribution non", "attribution non ?commercial no ?deriv(?:ative)?s (?:1|2|3|4) [05](?: international| unported| generic| licen[sc]e)?", 3, 0.7),
    ("public-domain", "public domain", "(?:dedicated to|released into|placed in|placed into|is in|are in|donated to|belongs to|in) the public domain", 3, 0.7),
    ("mpl", "source form mozilla", "this source code form is subject to the terms of the mozilla public license v ?2 0", 1, 1.0),
    ("epl", "accompanying eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1, 1.0),
    ("perl", "same terms perl", "(?:under )?the same terms as perl(?: 5)?(?: itself)?", 2, 0.9),
    ("psf", "psf", "psf licen[sc]e(?: agreement)?", 3, 0.7),
    ("ruby", "ruby", "ruby s licen[sc]e", 3, 0.7),
    ("vim", "vim", "vim licen[sc]e", 3, 0.7),
    ("json", "good evil", "the software shall be used for good not evil", 2, 0.9),
    ("x11", "x11", "x11 licen[sc]e", 3, 0.7),
    ("hpnd", "historical permission", "historical permission notice and disclaimer", 3, 0.7),
    ("apsl", "apple source", "apple public source licen[sc]e", 3, 0.7),
    ("lppl", "latex|lppl", "(?:latex project public licen[sc]e|lppl)", 3, 0.7),
    ("mulan", "mulan", "mulan (?:psl|permissive software licen[sc]e)(?: v ?[12])?", 3, 0.7),
    ("blueoak", "blue oak", "blue oak model licen[sc]e", 3, 0.7),
    ("commons-clause", "commons clause", "commons clause(?: license condition)?", 3, 0.7),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter)", 3, 0.7),
    ("llama", "llama community", "llama [234]?(?: [123])? ?community licen[sc]e", 3, 0.7),
    ("gfdl", "invariant sections", "with no invariant sections", 3, 0.8),
    ("dual", "dual licensed|dually licensed", "dual(?:ly)? licensed", 5, 0.4),
    ("proprietary", "confidential proprietary|proprietary software", "(?:confidential and proprietary|proprietary and confidential|proprietary software)", 3, 0.7),
    ("proprietary", "unauthorized copying|unauthorised copying", "unauthori[sz]ed copying of this (?:file|software|document)", 3, 0.7),
    ("proprietary", "reproduced permission", "(?:may|must) not be reproduced(?: distributed)?(?: or transmitted)? .{0,60}?without (?:the )?(?:prior )?(?:written )?permission", 4, 0.5),
    ("eula", "end user agreement|end user license", "end user licen[sc]e agreement", 3, 0.7),
    ("noncommercial", "non commercial only|noncommercial only", "for non ?commercial (?:use|purposes|research) only", 4, 0.5),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?", 5, 0.3),
    ("no-warranty", "warranty kind", "(?:provided )?as is without warranty of any kind", 5, 0.4),
    ("permission-notice", "hereby granted", "permission is hereby granted free of charge", 3, 0.8),
    ("redistribution-clause", "redistribution forms", "redistribution and use in source and binary forms", 3, 0.8),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[tuple[str, ...], ...]  # any of these sets
    priority: int
    confidence: float
    base: bool = False


def default_rules() -> list[Rule]:
    """Base phrases, each license in each form that fits its name, SPDX identifiers, then notices written by hand."""
    rules = [Rule(label, phrase, (tuple(phrase.split()),), 0, 0.6, True) for phrase, label in BASE.items()]
    for family, (keywords, name, address) in FAMILIES.items():
        label = family.removesuffix("-short").removesuffix("-long")
        for form, extra, shape, priority, confidence in FORMS:
            if (form == "address" and not address) or (form == "versioned" and label in OTHER_THINGS) or (form == "field" and label in OTHER_THINGS - GRANTED_BARE):
                continue
            need = label in OTHER_THINGS - GRANTED_BARE and form in ("grant", "terms")
            shape = shape.replace("NAME", f"(?:{name})").replace("LICENSE", " licen[sc]e" if need else "(?: licen[sc]e)?").replace("ADDRESS", address).replace("V", VERSION)
            rules.append(Rule(label, shape, _sets(address if form == "address" else keywords, "" if form == "address" else extra), priority, confidence))
    for label, ident in SPDX.items():
        rules.append(Rule(label, f"spdx license identifier (?:{ident})(?: only| or later)?", (("spdx", "identifier"),), 1, 1.0))
    return rules + [Rule(label, pattern, _sets(keywords, ""), priority, confidence) for label, keywords, pattern, priority, confidence in NOTICES]


def _sets(keywords: str, extra: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(dict.fromkeys([*k.split(), *extra.split()])) for k in keywords.split("|"))


def _rule_table(rules: list[Rule]) -> Column:
    """The rules as one constant, which is read before the query runs."""
    rows = [{"label": r.label, "pattern": f"(?<= )(?:{r.pattern})(?= )", "keywords": r.keywords, "priority": r.priority, "confidence": r.confidence, "base": r.base} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,pattern:string,keywords:array<array<string>>,priority:int,confidence:double,base:boolean>>")


def _gaps(text: Column) -> Column:
    """Number of spaces."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """Detections of one rule: first word and the word after the last. Matches are marked in one pass of the pattern by a
    sign that no word has, so that every second piece between signs is one."""
    pieces = F.transform(F.split(F.regexp_replace(words, rule["pattern"], F.lit("\u0001$0\u0001")), "\u0001"), lambda x, i: F.struct(_gaps(x).alias("n"), (i % 2).alias("hit")))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("out"))
    here = lambda acc, x: F.array(F.struct(acc["at"].alias("first"), (acc["at"] + x["n"] + 1).alias("end")))
    step = lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["hit"] == 1, F.concat(acc["out"], here(acc, x))).otherwise(acc["out"]).alias("out"))
    found = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.transform(found, lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["base"].alias("base")))


def _unsuppressed(found: Column) -> Column:
    """Without detections that lie inside one of a better rule: smaller priority, then longer, then first by label."""
    beats = lambda e, d: (e["first"] <= d["first"]) & (e["end"] >= d["end"]) & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & ((e["end"] - e["first"]) > (d["end"] - d["first"]))))
    return F.filter(found, lambda d: d["base"] | ~F.exists(found, lambda e: ~e["base"] & beats(e, d)))


def scan_licenses(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Adds `n_words` (long) and `detections`: array of (first, end, label, priority, confidence, base), by place.

    first and end count words from 0. Base rules are kept wherever they stand and suppress nothing. Rows are neither
    moved nor dropped. Null and empty texts have no words and no detections; long texts are searched whole.
    """
    rules = rules or default_rules()
    keywords = F.array(*[F.lit(w) for w in sorted({w for r in rules for k in r.keywords for w in k})])
    out = df.withColumn("__spaced", spaced_words(F.col(text)))
    out = out.withColumn("__words", F.split("__spaced", " "))
    out = out.withColumn("n_words", (F.size("__words") - 2).cast("long")).withColumn("__has", F.array_intersect("__words", keywords)).drop("__words")
    out = out.withColumn("__rules", F.when(F.size("__has") > 0, F.filter(_rule_table(rules), lambda r: F.exists(r["keywords"], lambda k: F.size(F.array_except(k, F.col("__has"))) == 0))))
    out = out.withColumn("__found", F.when(F.size("__rules") > 0, F.flatten(F.transform("__rules", lambda r: _places(F.col("__spaced"), r)))))
    kept = F.when(F.size("__found") > 0, F.array_sort(_unsuppressed(F.col("__found"))))
    none = F.array().cast("array<struct<first:int,end:int,label:string,priority:int,confidence:double,base:boolean>>")
    return out.withColumn("detections", F.coalesce(kept, none)).drop("__spaced", "__has", "__rules", "__found")
