"""License scans by ordered signature rules, in DataFrame functions alone.

Hundreds of regexes, each with a keyword and a priority, are tried in order of priority.
A text is scanned only if a gate of a few plain substrings lets it through, and a rule
only if its own keyword, a run of its words, stands in the text's words. A detection whose
interval lies inside that of a kept detection of the same or a higher priority is suppressed;
within a priority the earlier and, from one start, the longer one comes first.

The base phrases (whole words, in a row) are counted in the text's words set apart by blanks
and their labels always stay. The score is the confidence of the best kept detection, raised
by further ones; 0 without any.

Defined cases: null counts as the empty text, which has no words, places or labels;
A-Z is lower-cased and nothing else; a phrase inside longer words is none; repeated rows
are judged alike; texts of any length are judged whole, in memory of a few times their size;
an empty table gives an empty result; other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Substrings without one of which no rule and no phrase can match (checked by a test).
GATE = ("licen", "copyright", "copyleft", "domain", "spdx", "cc0", "creative", "reserved", "provided", "redistribut", "gpl", "bsd", "neither", "permission", "released", "cc")
#: Two letters are too common: what begins with "cc" alone goes on with "by".
_CC = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"

_W = r"[\s\-_,.:;/()\"'*#]+"  # between words of a signature
_V = r"(?:v|ver|version)?\.?\s*"

#: Sentences of license bodies and of their notices: label, priority, confidence, words.
BODIES = (
    ("gpl", 31, 0.95, "you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", 31, 0.95, "you can redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("agpl", 31, 0.95, "you can redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("gpl", 36, 0.8, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", 36, 0.85, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", 31, 0.95, "permission is granted to copy distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("apache-2.0", 30, 0.95, "you may not use this file except in compliance with the license"),
    ("apache-2.0", 30, 0.95, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 31, 0.9, "each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license"),
    ("mit", 32, 0.9, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 33, 0.8, "the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", 30, 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("isc", 33, 0.8, "provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", 32, 0.9, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 32, 0.9, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 33, 0.85, "this software is provided by the copyright holders and contributors as is"),
    ("bsd-4-clause", 31, 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledgement redistribution"),
    ("boost", 30, 0.97, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 32, 0.9, "this software is provided as is without any express or implied warranty"),
    ("zlib", 32, 0.9, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", 30, 0.97, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 31, 0.9, "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary released"),
    ("mpl", 31, 0.95, "this source code form is subject to the terms of the mozilla public license"),
    ("epl", 31, 0.95, "are made available under the terms of the eclipse public license"),
    ("cddl", 31, 0.95, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("wtfpl", 31, 0.95, "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("artistic", 32, 0.9, "the copyright holder may make changes to the package or to this license"),
    ("psf", 31, 0.95, "this license agreement is between the python software foundation"),
    ("openssl", 31, 0.95, "this product includes software developed by the openssl project licensed"),
    ("postgresql", 31, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("x11", 32, 0.9, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ofl", 31, 0.95, "this font software is licensed under the sil open font license"),
    ("cc-by", 34, 0.8, "this work is licensed under a creative commons attribution"),
    ("cc0", 31, 0.95, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("odbl", 32, 0.9, "this database is made available under the open database license"),
    ("rail", 33, 0.85, "use-based restrictions which are specified in this license"),
    ("sspl", 33, 0.85, "if you make the functionality of the program available to third parties as a service under this license"),
    ("bsl", 33, 0.85, "effective on the change date the licensor hereby grants you rights under the terms of the change license"),
    ("copyleft", 66, 0.6, "released under a copyleft license"),
    ("proprietary", 66, 0.6, "may not be copied modified or distributed without the express written permission of"),
    ("proprietary", 66, 0.6, "unauthorized copying of this file via any medium is strictly prohibited without permission"),
    ("no-derivatives", 67, 0.5, "no part of this publication may be reproduced without the prior written permission of"),
)


def _words(text: str) -> str:
    return text.replace("/", " ").replace("-", " ").replace(" ", _W)


def rules() -> list[tuple[str, str, int, str, float]]:
    """(label, keyword, priority, regex, confidence), low numbers first."""
    out: list[tuple[str, str, int, str, float]] = []

    def add(label: str, keyword: str, priority: int, regex: str, confidence: float) -> None:
        out.append((label, keyword, priority, regex, confidence))

    # SPDX tags
    for name in ("mit", "isc", "zlib", "wtfpl", "unlicense", "0bsd", "ncsa", "x11", "curl", "ofl-1.1", "bsl-1.0", "postgresql", "python-2.0", "ruby", "vim", "artistic-2.0", "epl-1.0", "epl-2.0", "mpl-1.1", "mpl-2.0", "cddl-1.0", "eupl-1.2", "osl-3.0", "afl-3.0", "ms-pl", "ms-rl", "apache-1.1", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "cc0-1.0", "odbl-1.0", "pddl-1.0", "openssl", "php-3.01", "cecill-2.1", "blueoak-1.0.0", "upl-1.0", "mulanpsl-2.0"):
        add(name, f"spdx license identifier {name.split('-')[0].split('.')[0]}", 0, rf"spdx-license-identifier:\s*{name.replace('.', '[.]')}(?![\w.+-])", 1.0)
    for family in ("gpl", "lgpl", "agpl"):
        for version in ("1.0", "2.0", "2.1", "3.0"):
            for suffix in ("only", "or-later"):
                add(f"{family}-{version}-{suffix}", f"spdx license identifier {family}", 0, rf"spdx-license-identifier:\s*{family}-{version.replace('.', '[.]')}-{suffix}", 1.0)
    # the GNU family, by version and by what follows
    for label, name in (("gpl", "gnu general public licen[cs]e"), ("lgpl", "gnu (?:lesser|library) general public licen[cs]e"), ("agpl", "gnu affero general public licen[cs]e"), ("gfdl", "gnu free documentation licen[cs]e")):
        base, keyword = _words(name), "general public licen" if "(" in name else name.split("[")[0]
        add(label, keyword, 40, base, 0.9)
        for version in ("1", "2", "3"):
            add(f"{label}-{version}", keyword, 20, rf"{base}{_W}{_V}{version}(?:[.][0-9])?(?![0-9])", 0.97)
            add(f"{label}-{version}+", keyword, 10, rf"{base}(?s:.{{0,80}}?){_V}{version}(?s:.{{0,60}}?)or{_W}(?:\(at{_W}your{_W}option\){_W})?any{_W}later", 0.98)
    for label in ("gpl", "lgpl", "agpl"):
        for version in ("2", "3"):
            add(f"{label}-{version}", label, 30, rf"(?<![a-z0-9]){label}[\s-]*{_V}{version}(?![0-9])", 0.9)
        add(label, label, 50, rf"(?:licen[cs]ed|released|distributed|available){_W}under{_W}(?:the{_W})?{label}(?![a-z0-9])", 0.85)
    # Apache
    for version in ("1[.]0", "1[.]1", "2[.]0", "2"):
        number = version.replace("[.]", ".")
        add(f"apache-{number}", "apache", 20, rf"apache{_W}(?:software{_W})?licen[cs]e{_W}{_V}{version}(?![.]?[0-9])", 0.98)
        add(f"apache-{number}", "apache", 21, rf"apache[\s-]*{version}{_W}licen[cs]e", 0.95)
    add("apache-2.0", "apache org licenses", 22, r"apache\.org/licenses/license-2\.0", 0.97)
    add("apache", "apache", 40, _words("apache (?:software )?licen[cs]e"), 0.9)
    # Creative Commons, by short name, long name and address
    kinds = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
    for short, long in kinds.items():
        spaced = short.replace("-", r"[\s-]+")
        add(f"cc-{short}", f"cc {short.replace('-', ' ')}", 32, rf"(?<![a-z0-9])cc[\s-]+{spaced}(?![a-z0-9-])", 0.9)
        add(f"cc-{short}", f"creative commons {long}", 33, rf"creative{_W}commons{_W}{_words(long)}(?![\s-]+(?:share|non|no)[a-z])", 0.93)
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            escaped = version.replace(".", "[.]")
            add(f"cc-{short}-{version}", f"cc {short.replace('-', ' ')}", 22, rf"(?<![a-z0-9])cc[\s-]+{spaced}[\s-]+{_V}{escaped}(?![0-9])", 0.97)
            add(f"cc-{short}-{version}", f"creativecommons org licenses {short.replace('-', ' ')}", 12, rf"creativecommons\.org/licenses/{short}/{escaped}", 0.99)
            add(f"cc-{short}-{version}", f"creative commons {long}", 23, rf"creative{_W}commons{_W}{_words(long)}{_W}{escaped}", 0.98)
    add("cc0", "cc0", 20, r"(?<![a-z0-9])cc0(?![a-z0-9])", 0.95)
    add("cc0", "creativecommons org publicdomain", 12, r"creativecommons\.org/publicdomain/zero/1\.0", 0.99)
    # the BSD family
    for count, label in (("two|2", "bsd-2-clause"), ("three|3", "bsd-3-clause"), ("four|4", "bsd-4-clause")):
        add(label, "clause bsd", 20, rf"(?:{count})[\s-]*clause{_W}bsd", 0.96)
        add(label, "bsd", 20, rf"bsd[\s-]*(?:{count})[\s-]*clause", 0.96)
    for variant, label in (("new", "bsd-3-clause"), ("modified", "bsd-3-clause"), ("revised", "bsd-3-clause"), ("simplified", "bsd-2-clause"), ("freebsd", "bsd-2-clause"), ("original", "bsd-4-clause")):
        add(label, f"{variant} bsd licen", 25, rf"(?:{variant}){_W}bsd{_W}licen[cs]e", 0.95)
    add("bsd", "bsd licen", 40, _words("bsd licen[cs]e"), 0.9)
    add("bsd-3-clause", "neither the name of", 30, _words("neither the name of") + r"(?s:.{0,120}?)nor" + _W + _words("the names of (?:its|any) contributors"), 0.9)
    add("bsd", "redistribution and use in source", 31, _words("redistribution and use in source and binary forms with or without modification"), 0.9)
    # MIT, ISC and other short permissive ones
    add("mit", "mit licen", 30, rf"(?<![a-z0-9])mit{_W}licen[cs]e", 0.95)
    add("mit", "permission is hereby granted free", 31, _words("permission is hereby granted free of charge to any person obtaining a copy"), 0.97)
    add("mit", " mit ", 45, rf"(?:licen[cs]ed|released){_W}under{_W}(?:the{_W})?mit(?![a-z0-9])", 0.9)
    add("isc", "permission to use copy modify and", 31, _words("permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"), 0.95)
    for label, name in (("isc", "isc licen[cs]e"), ("zlib", "zlib licen[cs]e"), ("boost", "boost software licen[cs]e"), ("ncsa", "university of illinois ncsa open source licen[cs]e"), ("x11", "x11 licen[cs]e"), ("postgresql", "postgresql licen[cs]e"), ("psf", "python software foundation licen[cs]e"), ("php", "php licen[cs]e"), ("ruby", "ruby licen[cs]e"), ("vim", "vim licen[cs]e"), ("openssl", "openssl licen[cs]e"), ("ofl", "sil open font licen[cs]e"), ("beerware", "beer ware licen[cs]e"), ("artistic", "artistic licen[cs]e"), ("curl", "curl licen[cs]e"), ("unlicense", "the unlicense"), ("wtfpl", "do what the fuck you want to public licen[cs]e"), ("json", "json licen[cs]e"), ("blueoak", "blue oak model licen[cs]e"), ("upl", "universal permissive licen[cs]e")):
        add(label, name.split("[")[0], 35, _words(name), 0.92)
    # copyleft and data licenses
    for label, name in (("mpl", "mozilla public licen[cs]e"), ("epl", "eclipse public licen[cs]e"), ("cpl", "common public licen[cs]e"), ("cddl", "common development and distribution licen[cs]e"), ("eupl", "european union public licen[cs]e"), ("osl", "open software licen[cs]e"), ("afl", "academic free licen[cs]e"), ("ms-pl", "microsoft public licen[cs]e"), ("odbl", "open (?:data commons )?(?:open )?database licen[cs]e"), ("ogl", "open government licen[cs]e"), ("cecill", "cecill licen[cs]e"), ("sspl", "server side public licen[cs]e"), ("bsl", "business source licen[cs]e"), ("rail", "responsible ai licen[cs]e"), ("lppl", "latex project public licen[cs]e"), ("qpl", "q public licen[cs]e"), ("npl", "netscape public licen[cs]e"), ("apsl", "apple public source licen[cs]e"), ("pddl", "public domain dedication and licen[cs]e"), ("oldap", "openldap public licen[cs]e")):
        keyword = "database licen" if "(" in name else name.split("[")[0]
        add(label, keyword, 35, _words(name), 0.92)
        for version in ("1", "2", "3"):
            add(f"{label}-{version}", keyword, 20, rf"{_words(name)}{_W}{_V}{version}(?:[.][0-9])?(?![0-9])", 0.96)
    # notices
    add("public-domain", "the public domain", 60, rf"(?:released|placed|dedicated|is){_W}(?:in|into|to){_W}the{_W}public{_W}domain", 0.8)
    add("all-rights-reserved", "all rights reserved", 70, _words("all rights reserved"), 0.6)
    add("copyright", "copyright", 80, rf"copyright{_W}(?:\(c\)|©)?\s*(?:19|20)[0-9][0-9]", 0.4)
    add("no-warranty", "provided as is", 75, _words("provided as is") + rf"{_W}without{_W}warrant(?:y|ies)", 0.5)
    add("proprietary", "proprietary and confidential", 65, rf"proprietary{_W}and{_W}confidential(?s:.{{0,200}}?)licen[cs]e", 0.6)
    add("eula", "end user licen", 65, _words("end user licen[cs]e agreement"), 0.7)
    # sentences of license bodies
    for label, priority, confidence, text in BODIES:
        keyword = " ".join(text.replace("/", " ").replace("-", " ").split()[:5])
        add(label, keyword, priority, _words(text).replace("license", "licen[cs]e"), confidence)
    return out


def _lower(text) -> "F.Column":
    return F.translate(text, UPPER, LOWER)


def _count(words, text) -> "F.Column":
    """How often a text that overlaps no other place of itself stands in words."""
    return ((F.length(words) - F.length(F.replace(words, F.lit(text), F.lit("")))) / len(text)).cast("long")


def _apart(phrase: str) -> str:
    """A run of words as it stands in the words set apart: a blank on either side of each (blanks at its ends stay single)."""
    return re.sub(r"(?<=\S) (?=\S)", "  ", phrase)


_DETECTION = "struct<priority:int,lo:int,hi:int,label:string,confidence:double>"


def _intervals(low, rule) -> "F.Column":
    """Where a rule matches: structs of priority, first and last offset, label, confidence."""
    once = F.array(F.struct(F.split(low, rule["regex"], -1).alias("pieces"), F.regexp_extract_all(low, rule["regex"], F.lit(0)).alias("found")))
    none = F.array().cast(f"array<{_DETECTION}>")

    def fold(m):
        def step(s, i):
            lo = s["at"] + F.length(F.get(m["pieces"], i))
            hi = lo + F.length(F.get(m["found"], i))
            one = F.struct(rule["priority"].alias("priority"), lo.alias("lo"), hi.alias("hi"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
            return F.struct(hi.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.when(F.size(m["found"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m["found"]) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]).otherwise(none)

    return F.flatten(F.transform(once, fold))


def _suppress(found) -> "F.Column":
    """Keeps, in order of priority, start and falling length, what lies in no interval kept before it."""
    keyed = F.transform(found, lambda d: F.struct(d["priority"].alias("priority"), d["lo"].alias("lo"), (-d["hi"]).alias("back"), d["hi"].alias("hi"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    none = F.array().cast(f"array<{_DETECTION}>")

    def add(kept, d):
        one = F.struct(d["priority"].alias("priority"), d["lo"].alias("lo"), d["hi"].alias("hi"), d["label"].alias("label"), d["confidence"].alias("confidence"))
        return F.when(F.exists(kept, lambda k: (k["lo"] <= d["lo"]) & (k["hi"] >= d["hi"])), kept).otherwise(F.concat(kept, F.array(one)))

    return F.aggregate(F.array_sort(keyed), none, add)


def rule_groups() -> "F.Column":
    """All rules as one constant array: keywords as they stand in the words set apart, each with its rules."""
    groups: dict[str, list[dict]] = {}
    for row in sorted(rules(), key=lambda r: (r[2], r[0])):
        rule = dict(zip(("label", "keyword", "priority", "regex", "confidence"), row, strict=True))
        groups.setdefault(_apart(rule.pop("keyword")), []).append(rule)
    text = json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])
    return F.from_json(F.lit(text), "array<struct<keyword:string,rules:array<struct<label:string,priority:int,regex:string,confidence:double>>>>")


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, low (A-Z lower-cased, null before the gate), words (of low, set apart) and ``kept``, the detections left.

    Every step is a projection of its own, so that nothing is computed twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("folded", F.lower("text"))
    gate = F.col("folded").contains(GATE[0])
    for word in GATE[1:-1]:
        gate = gate | F.col("folded").contains(word)
    gate = gate | (F.col("folded").contains(GATE[-1]) & F.col("folded").rlike(_CC))
    out = out.select("doc_id", "text", F.when(gate, _lower(F.col("text"))).alias("low"))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", _GAP, "  ")), F.lit(" "))
    out = out.withColumn("words", words)
    tried = F.flatten(F.transform(F.filter(rule_groups(), lambda g: F.contains(F.col("words"), g["keyword"])), lambda g: g["rules"]))
    out = out.withColumn("tried", F.when(F.col("low").isNotNull(), tried))
    found = F.when(F.size("tried") > 0, F.flatten(F.transform("tried", lambda r: _intervals(F.col("low"), r))))
    out = out.withColumn("found", found)
    kept = F.when(F.size("found") > 0, _suppress(F.col("found"))).otherwise(F.array().cast(f"array<{_DETECTION}>"))
    return out.select("doc_id", "text", "low", "words", kept.alias("kept"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, kept."""
    out = detections(docs, id_col, text_col)
    out = out.select("doc_id", F.regexp_count("text", F.lit(ALNUM_WORD)).cast("long").alias("n_words"), "words", "kept")
    places = [F.coalesce(F.when(F.contains("words", F.lit(f" {_apart(p)} ")), _count(F.col("words"), f" {_apart(p)} ")), F.lit(0).cast("long")) for p, _ in PHRASES]
    out = out.select("*", *[n.alias(f"n{k}") for k, n in enumerate(places)])
    firsts, lasts, labels = [], [], []
    for k, (phrase, label) in enumerate(PHRASES):
        has, there = F.col(f"n{k}") > 0, f" {_apart(phrase)} "
        inside = lambda part: (_count(part, " ") / 2).cast("long")
        firsts.append(F.when(has, inside(F.substring_index("words", there, 1))))
        lasts.append(F.when(has, F.col("n_words") - len(phrase.split()) - inside(F.substring_index("words", there, -1))))
        labels.append(F.when(has, F.lit(label)))
    base = F.array_sort(F.array_compact(F.array(*labels)))
    n_base = sum((F.col(f"n{k}") for k in range(1, len(PHRASES))), F.col("n0"))
    out = out.select("doc_id", "n_words", n_base.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"), "kept")
    miss = F.aggregate("kept", F.lit(1.0), lambda m, d: m * (1 - d["confidence"]))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.col("kept.label")))), ",").alias("labels"), (1 - miss).alias("score"), "kept",
    )
