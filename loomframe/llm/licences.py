"""Licence notices by ordered signature rules, in DataFrame functions only.

A text becomes a line of lower-case words between single spaces. Rules are regular
expressions on that line: wordings of notices written by hand, and a table of licences in the
forms in which notices name them. A rule is tried in the texts that hold one of its keywords; every match of its
pattern holds one of them, so nothing is lost by that. Where detections overlap, one that
lies within another of the same or a better level gives way.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_or_empty
from .notices import WORDINGS, sure_words

#: What stands between words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are always counted: words, label, score.
BASE = (("cc by", "cc-by", 0.8), ("general public license", "gpl", 0.8), ("all rights reserved", "reserved", 0.5))


class Rule(NamedTuple):
    label: str
    level: int  # 1 wins over 2 and so on
    score: float
    keyword: str  # text that every match holds, maybe inside a word; empty if there is none
    pattern: str
    keywords: tuple[str, ...] = ()  # whole words, of which every match holds one; () if not known


#: label, words of its name, versions, keywords: one for each alternative of the name.
LICENCES = (
    ("apache", "apache(?: software)?", ("1 0", "1 1", "2 0"), ("apache",)),
    ("mit", "(?:mit|expat)", (), ("mit", "expat")),
    ("x11", "(?:x11|x consortium)", (), ("x11", "x consortium")),
    ("isc", "(?:isc|internet systems consortium)", (), ("isc", "internet systems consortium")),
    ("bsd", "(?:bsd|berkeley software distribution)", (), ("bsd", "berkeley software distribution")),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", (), ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd")),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", (), ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", (), ("bsd 4 clause", "4 clause bsd", "four clause bsd", "original bsd")),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", (), ("0bsd", "zero clause bsd", "bsd zero clause")),
    ("gpl", "(?:gnu )?(?:gpl|general public)", ("1 0", "2 0", "3 0", "2", "3"), ("gpl", "general public")),
    ("lgpl", "(?:gnu )?(?:lgpl|lesser general public|library general public)", ("2 0", "2 1", "3 0", "3"), ("lgpl", "lesser general public", "library general public")),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)", ("1 0", "3 0", "3"), ("agpl", "affero general public")),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation)", ("1 1", "1 2", "1 3"), ("gfdl", "free documentation")),
    ("mpl", "(?:mpl|mozilla public)", ("1 0", "1 1", "2 0"), ("mpl", "mozilla public")),
    ("epl", "(?:epl|eclipse public)", ("1 0", "2 0"), ("epl", "eclipse public")),
    ("cddl", "(?:cddl|common development and distribution)", ("1 0", "1 1"), ("cddl", "common development and distribution")),
    ("cpl", "(?:cpl|common public)", ("1 0",), ("cpl", "common public")),
    ("ipl", "ibm public", ("1 0",), ("ibm public",)),
    ("eupl", "(?:eupl|european union public)", ("1 0", "1 1", "1 2"), ("eupl", "european union public")),
    ("cecill", "cecill(?: free software)?", ("1 0", "2 0", "2 1"), ("cecill",)),
    ("osl", "(?:osl|open software)", ("1 0", "2 0", "2 1", "3 0"), ("osl", "open software")),
    ("afl", "(?:afl|academic free)", ("1 1", "2 0", "2 1", "3 0"), ("afl", "academic free")),
    ("artistic", "(?:perl )?artistic", ("1 0", "2 0"), ("artistic",)),
    ("zlib", "(?:zlib|zlib libpng)", (), ("zlib",)),
    ("libpng", "(?:libpng|png reference library)", ("2 0",), ("libpng", "png reference library")),
    ("boost", "boost(?: software)?", ("1 0",), ("boost",)),
    ("unlicense", "(?:the )?unlicense", (), ("unlicense",)),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", ("2 0",), ("wtfpl", "do what the fuck you want to public")),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", ("1 0",), ("cc0", "cc zero", "creative commons zero")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by sa", "creative commons attribution")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", ("2 0", "2 5", "3 0", "4 0"), ("cc by nd", "creative commons attribution")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", ("2 0", "2 5", "3 0", "4 0"), ("cc by nc", "creative commons attribution")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ("2 0", "2 5", "3 0", "4 0"), ("cc by nc sa", "creative commons attribution")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", ("2 0", "2 5", "3 0", "4 0"), ("cc by nc nd", "creative commons attribution")),
    ("cc-by", "(?:cc by|creative commons attribution)", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by", "creative commons attribution")),
    ("ofl", "(?:ofl|sil open font|open font)", ("1 0", "1 1"), ("ofl", "open font")),
    ("odbl", "(?:odbl|open database)", ("1 0",), ("odbl", "open database")),
    ("odc-by", "(?:odc by|open data commons attribution)", ("1 0",), ("odc by", "open data commons attribution")),
    ("pddl", "(?:pddl|open data commons public domain dedication and)", ("1 0",), ("pddl", "open data commons public domain dedication and")),
    ("ogl", "(?:ogl|open government)", ("1 0", "2 0", "3 0"), ("ogl", "open government")),
    ("python", "(?:python software foundation|psf)", ("2",), ("python software foundation", "psf")),
    ("php", "php", ("3 0", "3 01"), ("php",)),
    ("ruby", "ruby", (), ("ruby",)),
    ("postgresql", "postgresql", (), ("postgresql",)),
    ("openssl", "(?:openssl|ssleay)", (), ("openssl", "ssleay")),
    ("curl", "curl", (), ("curl",)),
    ("ncsa", "(?:ncsa|university of illinois ncsa)(?: open source)?", (), ("ncsa",)),
    ("ms-pl", "(?:ms pl|microsoft public)", (), ("ms pl", "microsoft public")),
    ("ms-rl", "(?:ms rl|microsoft reciprocal)", (), ("ms rl", "microsoft reciprocal")),
    ("sspl", "(?:sspl|server side public)", ("1",), ("sspl", "server side public")),
    ("busl", "(?:busl|business source)", ("1 1",), ("busl", "business source")),
    ("elastic", "elastic", ("2 0",), ("elastic",)),
    ("json", "json", (), ("json",)),
    ("qpl", "(?:qpl|q public)", ("1 0",), ("qpl", "q public")),
    ("w3c", "w3c(?: software)?(?: notice and)?", (), ("w3c",)),
    ("vim", "vim", (), ("vim",)),
    ("nasa", "nasa open source(?: agreement)?", ("1 3",), ("nasa open source",)),
    ("sleepycat", "(?:sleepycat|berkeley db)", (), ("sleepycat", "berkeley db")),
)

_UNDER = "(?:licensed|released|distributed|redistributed|provided|published|available|offered|covered) (?:by |under )(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_KIND = "(?: public)?(?: licen[cs]e| agreement)?"
_LATER = " or (?:at your option )?(?:any )?(?:later|newer|higher)(?: versions?)?"

#: Notices with wordings of their own.
NOTICES = (
    Rule("mit", 2, 0.95, "", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",)),
    Rule("mit", 3, 0.9, "", "the above copyright notice and this permission notice shall be included", ("the above copyright notice and this permission",)),
    Rule("bsd", 2, 0.9, "", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    Rule("bsd-3-clause", 2, 0.9, "", "neither the name (?:of )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse", ("may be used to endorse",)),
    Rule("isc", 2, 0.95, "", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    Rule("zlib", 2, 0.95, "", "this software is provided as is without any express or implied warranty", ("provided as is without any express",)),
    Rule("unlicense", 2, 0.95, "", "free and unencumbered software released into the public domain", ("free and unencumbered",)),
    Rule("public-domain", 3, 0.8, "", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain", ("public domain",)),
    Rule("public-domain", 5, 0.6, "", "in the public domain", ("public domain",)),
    Rule("apache-2.0", 2, 0.95, "", "apache org licenses license 2 0", ("apache org licenses",)),
    Rule("cc-by-4.0", 2, 0.95, "", "creativecommons org licenses by 4 0", ("creativecommons org",)),
    Rule("cc-by-sa-4.0", 2, 0.95, "", "creativecommons org licenses by sa 4 0", ("creativecommons org",)),
    Rule("cc0-1.0", 2, 0.95, "", "creativecommons org publicdomain zero 1 0", ("creativecommons org",)),
    Rule("mit", 2, 0.95, "", "opensource org licenses mit", ("opensource org",)),
    Rule("gpl", 2, 0.95, "", "gnu org licenses gpl", ("gnu org licenses",)),
    Rule("lgpl", 2, 0.95, "", "gnu org licenses lgpl", ("gnu org licenses",)),
    Rule("gpl", 3, 0.9, "", "under the terms of the gnu general public license as published by the free software foundation", ("free software foundation",)),
    Rule("proprietary", 4, 0.7, "", "(?:proprietary and confidential|confidential and proprietary)", ("proprietary",)),
    Rule("proprietary", 4, 0.7, "", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} is (?:strictly )?prohibited", ("prohibited",)),
    Rule("proprietary", 5, 0.6, "", "may not be (?:reproduced|copied|distributed)(?: [^ ]+){0,8} without (?:the )?(?:prior |express )*(?:written )?permission", ("may not be",)),
    Rule("warranty-disclaimer", 5, 0.4, "", "without warrant(?:y|ies) (?:of any kind|or conditions of any kind)", ("without warranty", "without warranties")),
    Rule("copyright-notice", 6, 0.4, "", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?", ("copyright",)),
    Rule("licence-reference", 6, 0.3, "", "see (?:the )?(?:file )?(?:licen[cs]e|copying)(?: file)?(?: txt| md)?(?: for (?:more )?(?:details|information|terms))?", ("license", "licence", "copying")),
    Rule("licence-reference", 6, 0.3, "", "spdx license identifier [^ ]+", ("spdx license identifier",)),
    Rule("licence-reference", 6, 0.2, "", "(?:licensed|released|distributed) under (?:the )?(?:[^ ]+ ){0,4}licen[cs]e", ("licensed under", "released under", "distributed under")),
)


def make_rules() -> list[Rule]:
    """The wordings by hand, then every licence in every form: identifier, grant, title, with
    and without version."""
    rules = [*NOTICES, *(Rule(label, level, score, "", pattern, sure_words(pattern)) for label, level, score, pattern in WORDINGS)]
    for label, name, versions, named in LICENCES:
        spdx = f"spdx license identifier {label.replace('-', ' ')}"
        for v in versions:
            dotted = f"{label}-{v.replace(' ', '.')}"
            rules += [
                Rule(dotted, 1, 1.0, "", f"{spdx} {v}", (spdx,)),
                Rule(dotted, 2, 0.95, "", f"{_UNDER}{name}{_KIND}(?: version| v)? {v}", named),
                Rule(dotted, 3, 0.9, "", f"{name}{_KIND}(?: version| v)? {v}", named),
            ]
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                rules += [
                    Rule(f"{dotted}-or-later", 1, 1.0, "", f"{spdx} {v} or later", (spdx,)),
                    Rule(f"{dotted}-or-later", 1, 0.95, "", f"{name}{_KIND}(?: version| v)? {v}{_LATER}", named),
                ]
        rules += [
            Rule(label, 1, 1.0, "", spdx, (spdx,)),
            Rule(label, 4, 0.8, "", f"{_UNDER}{name}{_KIND}", named),
            Rule(label, 5, 0.7, "", f"{name}(?: public)? licen[cs]e", named),
        ]
    return rules


#: No text is passed over before the keywords of the rules are looked for.
ANCHORS: tuple[str, ...] = ()

LEVELS = 6
_FOUND = "array<struct<start:int,behind:int,level:int,label:string,score:double>>"


def word_line(text: Column) -> Column:
    """Lower-case words between single spaces, a space at either end; ' ' if there is none.

    lower() also changes letters beyond ASCII; those stay parts of the same words.
    """
    words = F.trim(F.regexp_replace(F.lower(text), GAP, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("int")


#: Matches of a rule that are gathered in one array before it joins the others.
_TOGETHER = 256


def _whole_words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _matches(line: Column, rule: Column) -> Column:
    """start, behind (word numbers, the second one past the end), level, label, score of each match."""
    between = F.split(line, rule["pattern"], -1)
    found = F.regexp_extract_all(line, rule["pattern"], F.lit(0))
    none = F.array().cast(_FOUND)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + _spaces(pair["between"])
        behind = start + _spaces(pair["found"]) + 1
        row = F.struct(start.alias("start"), behind.alias("behind"), rule["level"].alias("level"), rule["label"].alias("label"), rule["score"].alias("score"))
        # The space behind a match starts the next piece and is counted there.
        return F.struct((behind - 1).alias("at"), F.concat(state["rows"], F.array(row)).alias("rows"))

    # The last piece, behind the last match, has no match of its own.
    pairs = F.slice(F.arrays_zip(between.alias("between"), found.alias("found")), 1, F.size(found))
    # An array grows by copying itself, so matches are gathered some hundreds at a time.
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(found) - 1, F.lit(0)) / F.lit(_TOGETHER)).cast("int")),
        lambda c: F.slice(pairs, c * _TOGETHER + 1, F.lit(_TOGETHER)),
    )

    def chunk(state: Column, mine: Column) -> Column:
        own = F.aggregate(mine, F.struct(state["at"].alias("at"), none.alias("rows")), step)
        return F.struct(own["at"].alias("at"), F.concat(state["parts"], F.array(own["rows"])).alias("parts"))

    start = F.struct(F.lit(-1).alias("at"), F.array().cast(f"array<{_FOUND}>").alias("parts"))
    return F.aggregate(chunks, start, chunk, lambda state: F.flatten(state["parts"]))


def _resolve(found: Column) -> Column:
    """Labels and best score of the detections that do not lie within a better or earlier one.

    found is sorted by start, longest first, best level first, so whatever holds a detection
    comes before it; the state is the furthest end so far per level.
    """

    def step(state: Column, d: Column) -> Column:
        hidden = F.array_max(F.slice(state["reach"], 1, d["level"])) >= d["behind"]
        reach = F.transform(state["reach"], lambda r, i: F.when(i == d["level"] - 1, F.greatest(r, d["behind"])).otherwise(r))
        return F.struct(
            reach.alias("reach"),
            F.when(hidden, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(hidden, state["score"]).otherwise(F.greatest(state["score"], d["score"])).alias("score"),
            (state["kept"] + F.when(hidden, 0).otherwise(1)).alias("kept"),
        )

    start = F.struct(
        F.array_repeat(F.lit(-1), LEVELS).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("kept")
    )
    return F.aggregate(found, start, step)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_found, found.

    n_base counts the places of the base phrases, first_word and last_word are their smallest
    and largest word number (null if there is none). labels adds those of the rules whose
    detections survive; n_found counts these, found has all detections before suppression as
    (start, behind, level, label, score). score is the best of the surviving rules and base
    phrases, 0 without any. A null text counts as empty; repeated rows each give a row; other
    columns of docs are not looked at. Nothing is shuffled. With anchors, rules are only tried
    in texts that hold one of them.
    """
    rules = make_rules() if rules is None else rules
    line = F.col("line")
    out = docs.select(F.col(id_col).alias("doc_id"), word_line(text_or_empty(text_col)).alias("line"))
    out = out.withColumn("n_words", (_spaces(line) - 1).cast("long"))

    for k, (phrase, _, _) in enumerate(BASE):
        cut = F.split(line, _whole_words(phrase), -1)
        out = out.withColumn(f"cut{k}", F.when(line.contains(f" {phrase} "), cut))
    counts = [F.coalesce(F.size(f"cut{k}") - 1, F.lit(0)) for k in range(len(BASE))]
    has = [F.col(f"cut{k}").isNotNull() for k in range(len(BASE))]
    first = [F.when(h, _spaces(F.col(f"cut{k}")[0]) - 1).cast("long") for k, h in enumerate(has)]
    last = [
        F.when(h, F.col("n_words") - len(phrase.split()) - (_spaces(F.element_at(f"cut{k}", -1)) - 1)).cast("long")
        for k, (h, (phrase, _, _)) in enumerate(zip(has, BASE, strict=True))
    ]

    # Per keyword its longest word, by which it is looked up among a text's words, and its rules.
    held: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        for keyword in r.keywords or ("",):
            held.setdefault(keyword, []).append(k)
    always = F.from_json(F.lit(json.dumps(held.pop("", []))), "array<int>")
    leads = {keyword: max(keyword.split(), key=len) for keyword in held}
    keywords = F.from_json(
        F.lit(json.dumps([{"lead": leads[keyword], "words": f" {keyword} ", "rules": ks} for keyword, ks in held.items()])),
        "array<struct<lead:string,words:string,rules:array<int>>>",
    )
    table = F.from_json(
        F.lit(json.dumps([r._replace(pattern=_whole_words(r.pattern))._asdict() for r in rules])),
        "array<struct<label:string,level:int,score:double,keyword:string,pattern:string>>",
    )
    gate = F.lit(not anchors)
    for anchor in anchors:
        gate = gate | line.contains(anchor)
    seen = F.array_intersect(F.split(line, " "), F.from_json(F.lit(json.dumps(sorted(set(leads.values())))), "array<string>"))
    out = out.withColumn("seen", F.when(gate, seen))
    present = F.filter(keywords, lambda k: F.array_contains(F.col("seen"), k["lead"]) & F.contains(line, k["words"]))
    present = F.when(F.size("seen") > 0, F.flatten(F.transform(present, lambda k: k["rules"]))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("present", F.when(gate, F.array_union(present, always)))
    tried = F.filter(F.transform(F.col("present"), lambda k: table[k]), lambda r: F.contains(line, r["keyword"]))
    found = F.array_sort(
        F.transform(
            F.flatten(F.transform(tried, lambda r: _matches(line, r))),
            lambda d: F.struct(d["start"].alias("start"), (-d["behind"]).alias("from_end"), d["level"].alias("level"), d["label"].alias("label"), d["score"].alias("score")),
        )
    )
    found = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["from_end"]).alias("behind"), d["level"].alias("level"), d["label"].alias("label"), d["score"].alias("score")))
    out = out.withColumn("found", F.when(F.size("present") > 0, found))
    out = out.withColumn("kept", F.when(F.size("found") > 0, _resolve(F.col("found"))))
    base_labels = F.filter(F.array(*(F.when(h, F.lit(b[1])) for h, b in zip(has, BASE, strict=True))), lambda x: x.isNotNull())
    all_labels = F.array_union(base_labels, F.coalesce(F.col("kept.labels"), F.array().cast("array<string>")))
    best = F.greatest(F.coalesce("kept.score", F.lit(0.0)), *(F.when(h, F.lit(b[2])).otherwise(F.lit(0.0)) for h, b in zip(has, BASE, strict=True)))
    return out.select(
        "doc_id",
        "n_words",
        sum(counts, F.lit(0)).cast("long").alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        best.alias("score"),
        F.coalesce(F.col("kept.kept"), F.lit(0)).alias("n_found"),
        F.coalesce("found", F.array().cast(_FOUND)).alias("found"),
    )
