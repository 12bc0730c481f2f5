import functools
import random
import re
from re import _parser

from loomframe.llm.licences import ANCHORS, BASE, GAP, Rule, make_rules, scan_licences
from loomframe.llm.notices import WORDINGS, sure_words

RULES = make_rules()


@functools.cache
def whole(pattern):
    """Kept here: there are more rules than re remembers patterns."""
    return re.compile(f"(?<= )(?:{pattern})(?= )")


def brute(text, rules=RULES, anchors=ANCHORS):
    line = " ".join(re.sub(GAP, " ", (text or "").lower()).split(" ")).strip(" ")
    line = f" {line} " if line else " "
    words = line.strip(" ").split(" ") if line.strip(" ") else []
    n_base, places, base, score = 0, [], set(), 0.0
    for phrase, label, worth in BASE:
        want = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        n_base, places = n_base + len(at), places + at
        if at:
            base.add(label)
            score = max(score, worth)
    found = []
    for r in rules:
        if r.keyword in line and (not anchors or any(a in line for a in anchors)):
            for m in whole(r.pattern).finditer(line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, r.level, r.label, r.score))

    def hides(e, j, d, i):
        if i == j or not (e[0] <= d[0] and e[1] >= d[1]):
            return False
        return e[2] < d[2] or e[2] == d[2] and ((e[:2] != d[:2]) or (e[3:], j) < (d[3:], i))

    left = [d for i, d in enumerate(found) if not any(hides(e, j, d, i) for j, e in enumerate(found))]
    labels = base | {d[3] for d in left}
    best = max([score, *(d[4] for d in left)])
    return (
        len(words), n_base, min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, len(left), len(found),
    )


def result(df, **options):
    return sorted(
        (
            (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_found, len(r.found))
            for r in scan_licences(df, **options).collect()
        ),
        key=repr,
    )


NOTICES = [
    "Licensed under the Apache License, Version 2.0. Foo cc by CC-BY cc by-sa 4.0",
    "GNU General Public License version 2 or any later version. All rights reserved. All Rights Reserved",
    "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "\u00fcn\u00ef copyright (c) 2019-2020 Foo. see LICENSE for details",
    "released under cc by nc sa 4 0 and the bsd 3 clause license; distributed under the terms of the GNU LGPL v2.1 or later",
    "cc by cc by cc by",
    "Copyright 2020. " * 300,
]


def test_rows_and_notices(spark, docs):
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(NOTICES)], "doc_id long, text string"))
    assert result(df) == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)


def test_corpus(corpus):
    assert result(corpus) == sorted(((r.doc_id, *brute(r.text)) for r in corpus.collect()), key=repr)


def test_suppression(spark):
    rules = [Rule("long", 2, 0.5, "a", "a b c"), Rule("inner", 3, 0.9, "b", "b"), Rule("better", 1, 0.4, "c", "c"), Rule("across", 2, 0.3, "c", "c d")]
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    got = result(df, rules=rules, anchors=())
    assert got == [(1, *brute("a b c d", rules, ()))]
    assert got[0][6] == "across,better,long"


def test_many_rules():
    assert len(RULES) > 300
    assert all(1 <= r.level <= 6 and 0 < r.score <= 1 for r in RULES)


def test_empty(empty):
    assert scan_licences(empty).collect() == []


def sample(parsed, rng):
    """A random text that a pattern matches."""
    out = ""
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind in ("NOT_LITERAL", "ANY"):
            out += "w"
        elif kind == "IN":
            what, one = rng.choice(value)
            out += "w" if str(what) == "NEGATE" else chr(one if str(what) == "LITERAL" else rng.randint(*one))
        elif kind == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif kind == "SUBPATTERN":
            out += sample(value[3], rng)
        elif kind == "MAX_REPEAT":
            out += "".join(sample(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 3))))
        else:
            raise ValueError(kind)
    return out


def test_no_rule_is_gated_away(spark):
    rng = random.Random(7)
    ungated = [r._replace(keyword="") for r in RULES]
    texts = [
        "released under the GNU GPL", "available under CC BY-SA 4.0", "released under the WTFPL", "released under CC0 1.0", "the SIL OFL 1.1", "MPL 2.0",
        "under the Expat licence", "an MS-PL license", "BUSL 1.1", "a ruby licence",
    ]
    for r in RULES:
        parsed = _parser.parse(r.pattern)
        for _ in range(6):
            text = sample(parsed, rng)
            assert re.fullmatch(r.pattern, text)
            assert r.keyword in text and any(f" {k} " in f" {text} " for k in r.keywords), (r, text)
            texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = result(df.repartition(4))
    assert got == sorted(((k, *brute(t, ungated, ())) for k, t in enumerate(texts)), key=repr)
    labels = {row[0]: row[6] for row in got}
    assert [labels[k] for k in range(10)] == ["gpl", "cc-by,cc-by-sa-4.0", "wtfpl", "cc0-1.0", "ofl-1.1", "mpl-2.0", "mit", "ms-pl", "busl-1.1", "ruby"]


def test_corpus_ungated(corpus):
    some = corpus.limit(40)
    ungated = [r._replace(keyword="") for r in RULES]
    assert result(some) == sorted(((r.doc_id, *brute(r.text, ungated, ())) for r in some.collect()), key=repr)


def test_very_long_text(spark):
    """Many matches of one rule in one text, past what is gathered at a time."""
    n = 3 * 256 + 5
    text = "x " + "all rights reserved and licensed under the mit license " * n
    row = scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (1 + 9 * n, n, 1, 1 + 9 * (n - 1))
    starts = sorted(f.start for f in row.found if f.label == "mit")
    assert len(starts) >= n and {s % 9 for s in starts} <= {(1 + k) % 9 for k in range(9)}
    firsts = sorted({s // 9 for s in starts})
    assert firsts == list(range(n)) or firsts == list(range(n + 1))


def test_every_wording_and_its_near_misses():
    """Each wording is met by texts made from it, and by none that lacks one of its sure words."""
    rng = random.Random(11)
    assert len(WORDINGS) + 25 >= 200 and len({w[3] for w in WORDINGS}) == len(WORDINGS)
    for label, level, score, pattern in WORDINGS:
        assert label and 1 <= level <= 6 and 0 < score <= 1
        (keyword,) = sure_words(pattern)
        for _ in range(8):
            text = f" {sample(_parser.parse(pattern), rng)} "
            assert whole(pattern).search(text) and f" {keyword} " in text
            for word in set(keyword.split()):
                assert not whole(pattern).search(text.replace(f" {keyword} ", f" {keyword} ".replace(f" {word} ", f" q{word} ", 1)))


def test_sure_words():
    assert sure_words("a b c") == ("a b c",)
    assert sure_words("see (?:the )?licen[cs]e file txt") == ("file txt",)
    assert sure_words("x(?:y (?:z)?)? long one") == ("long one",)
    assert sure_words("share ?alike of it") == ("of it",)
    assert sure_words("gplv[12]") == ()


KNOWN = {
    "// Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3.0-or-later",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1-or-later",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl-2.0",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd",
    "The Software shall be used for Good, not Evil.": "json",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": "boost-1.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
    "This module is free software; you can redistribute it and/or modify it under the same terms as Perl itself.": "artistic",
    "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "linux-syscall-note",
    "GPL v2 with Classpath exception": "classpath-exception",
    "The author disclaims copyright to this source code. In place of a legal notice, here is a blessing:": "blessing",
    "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.": "cc0-1.0",
    "Licensed under MIT OR Apache-2.0": "apache-2.0-or-mit",
    "This font software is licensed under the SIL Open Font License, Version 1.1.": "ofl-1.1",
    "For personal use only": "non-commercial",
    "This project is dual-licensed under terms of your choice": "dual-licence",
}

MISSES = [
    "the origin of this rumour must not be misrepresented",
    "the apache tribe signed no agreement",
    "she may not use this file in court",
    "the software shall be used for good",
    "a boost in software sales",
    "some rights were reserved for the king",
    "this library is free and open on sundays",
    "for personal reasons only",
    "here is a blessing",
]


def test_known_notices_and_misses(spark):
    texts = [*KNOWN, *MISSES]
    got = {r.doc_id: r.labels for r in scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        if text in KNOWN:
            assert KNOWN[text] in got[k].split(","), (text, got[k])
        else:
            assert got[k] == "", (text, got[k])
    assert sorted((k, labels) for k, labels in got.items()) == [(k, brute(t)[5]) for k, t in enumerate(texts)]
