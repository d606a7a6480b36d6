"""Quality, contamination, toxicity and licences."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest

from hopline.llm import decontamination, licences, quality, toxicity
from hopline.llm.decontamination import contamination_report, remove_benchmark_spans

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    on = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(on))


def test_base_counts(make, odd, prose):
    rows = odd + [(30, "é ü ñ\nline\nline \nline\n\n \nline"), (31, (prose(9, 7) + "\n") * 3), (32, "#a *b* |c| <d> 100%"), (33, prose(1, 12))]
    rows += [(34, f"{prose(92, 4000)} {prose(93, 9)} {prose(93, 9)} {prose(94, 4000)}")]
    got = quality.quality_report(make(rows, True)).collect()
    want = sorted(((i is None, i or 0), *brute_counts(t)) for i, t in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.quality_report(make([])).count() == 0


def test_estimation_finds_accurate_rules():
    r = np.random.default_rng(1)
    truth = r.random(5000) < 0.8
    accuracy = [0.95, 0.9, 0.6]
    votes = np.stack([np.where(r.random(5000) < a, truth, ~truth).astype(int) for a in accuracy], 1)
    share, chances = quality.estimate(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.8) < 0.05 and all(abs(g - a) < 0.06 for (g, _), a in zip(chances, accuracy))
    assert quality.estimate([]) == (0.5, [])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as good")
    both = quality.quality_report(docs).join(labels, "doc_id").select("kept", "good").collect()
    assert np.mean([r[0] == (r[1] == 1) for r in both]) > 0.9


def words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_contamination(rows, items, window=10):
    grams = {}
    for name, text in items:
        w = words(text)
        for k in ([tuple(w)] if 0 < len(w) < window else [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]):
            grams.setdefault(k, set()).add(name)
    sizes = sorted({len(k) for k in grams})
    out = []
    for i, text in rows:
        w, on, names = words(text), set(), set()
        for s in range(len(w)):
            for n in sizes:
                k = tuple(w[s : s + n])
                if len(k) == n and k in grams:
                    on |= set(range(s, s + n))
                    names |= {str(x) for x in grams[k] if x is not None}
        out.append(((i is None, i or 0), len(w), len(on), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(on)))
    return sorted(out)


@pytest.fixture
def leaks(spark, prose, odd):
    items = [(1, prose(50, 25)), (2, prose(51, 12)), (10, "only three words"), (3, prose(50, 25) + " tail"), (4, None), (5, ""), (None, prose(52, 15)), (6, "a b a b a b a b a b a b"), (7, "b a b")]
    shout = prose(51, 12).upper().replace(" ", ", ")
    rows = odd + [(28, f"{prose(90, 8000)} {prose(50, 25)} {prose(91, 8000)}")] + [(20, f"x {prose(50, 25)} y"), (21, f"start. {shout}! end"), (22, "here: Only THREE\nwords; there"), (23, prose(52, 15)), (24, " ".join(prose(50, 25).split()[:9])), (25, "a b a b a b a b a b a b a b a"), (26, prose(77, 30)), (27, f"{prose(80, 50)} {' '.join(prose(50, 25).split()[3:20])} {prose(81, 50)}")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


def test_contamination(make, leaks):
    rows, items, bench = leaks
    got = contamination_report(make(rows, True), bench).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_contamination(rows, items)


def test_contamination_block_by_block(make, leaks, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    rows, items, bench = leaks
    got = contamination_report(make(rows), bench).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_contamination(rows, items)


def test_no_benchmark_and_no_documents(spark, make, leaks):
    rows, _, bench = leaks
    none = spark.createDataFrame([], "item_id long, text string")
    assert not contamination_report(make(rows), none).where("contaminated").head(1)
    assert contamination_report(make([]), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [None, 100])
def test_spans_are_removed_and_the_rest_stays(make, leaks, prose, monkeypatch, block_bytes):
    rows, _, bench = leaks
    if block_bytes:
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    docs = make(rows, True).selectExpr("*", "'x' as found", "'y' as row")
    got = remove_benchmark_spans(docs, bench)
    assert got.columns == docs.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert 23 not in text and 20 not in text  # little but a test item
    assert text[26] == prose(77, 30) and text[22].startswith("here: ") and text[1] is None
    assert text[27] == f"{prose(80, 50)}  {prose(81, 50)}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    assert np.mean([r.toxic == r.predicted for r in got]) > 0.96
    assert np.mean([r.predicted for r in got if r.toxic == 0]) < 0.01 and np.mean([r.predicted for r in got if r.toxic == 1]) > 0.8
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_odd_rows(spark, make, odd):
    labels = spark.createDataFrame([(0, 0), (4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(make(odd, True), labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(make([]), labels.limit(0)).count() == 0


def test_calibration_never_falls():
    r = np.random.default_rng(2)
    margin = r.normal(size=500)
    y = (r.random(500) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    x, p = toxicity.isotonic(margin, y, np.ones(500))
    assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all() and 0 <= p[0] and p[-1] <= 1


def test_licences(make, odd):
    rows = [r for r in odd] + [
        (20, "Intro text.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (21, f"MIT License\n\nCopyright (c) someone\n\n{licences.SENTENCES['mit-grant']}:\n\n{licences.SENTENCES['mit-notice']}."),
        (22, "Licensed under CC BY-NC 4.0. All rights reserved."),
        (23, "This is about a driving license and nothing else."),
        (24, " ".join(f"{licences.SENTENCES[s]}." for s in ("bsd-source", "bsd-grant"))),
        (25, "# SPDX-License-Identifier: MIT\ncode"),
    ]
    got = {r.doc_id: r for r in licences.licence_scan(make(rows, True)).collect()}
    assert got[20].licences == "Apache-2.0" and got[21].licences == "MIT" and got[22].licences == "CC-BY-NC-4.0,all-rights-reserved"
    assert got[23].licences == "" and got[24].licences == "" and got[24].n_sentences == 2 and got[25].licences == "MIT" and got[1].n_sentences == 0
    assert licences.licence_scan(make([])).count() == 0


def test_every_rule_matches_its_own_sentences_and_needs_their_order():
    for licence, rule in licences.RULES:
        assert licence in licences.match_rules(list(enumerate(rule)))
        if len(rule) > 1:
            apart = [(n * (licences.GAP + 2), name) for n, name in enumerate(rule)]
            assert licences.match_rules(apart).count(licence) <= licences.match_rules(list(enumerate(rule))).count(licence)
    assert all(licences.normalised(text) == text for text in licences.SENTENCES.values())


def plain_features(text, lexicon):
    """The features again, one character and word at a time."""
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low)
    n, chars = max(1, len(words)), max(1, len(text))
    weights = [lexicon.weight(w) for w in words]
    near = sum(1 for i, w in enumerate(weights) if w and any(x in toxicity.SECOND_PERSON for x in words[max(0, i - 4) : i + 5]))
    masked = re.findall(r"[^\W\d_]+[0-9@$*#!|]+[^\W\d_]+", low)
    bare = [m.translate(str.maketrans("013457@$!|", "oieastasil")) for m in masked]
    stretched, i = 0, 0
    while i < len(low) - 2:
        if low[i] == low[i + 1] == low[i + 2] and re.fullmatch(r"[^\W\d_]", low[i]):
            stretched += 1
            i += 3
        else:
            i += 1
    return [
        sum(w > 0 for w in weights) / n, sum(w > 0 for w in weights), max(weights, default=0.0), sum(weights) / n,
        sum(w > 0 and x in toxicity.SEED_INSULTS for w, x in zip(weights, words)) / n, near / n,
        sum(w in toxicity.SECOND_PERSON for w in words) / n, sum(c.isupper() for c in text) / chars, sum(c == "!" for c in text) / chars,
        sum(c in ".,;:!?*#$%&|\"'" for c in text) / chars, sum(lexicon.weight(m) > 0 for m in bare), len(masked) / n, stretched / n, np.log1p(len(words)),
    ]


def test_features_against_plain_ones(odd):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "you": 4.0, "rotten": 3.5}, {"rott": 2.0, "stupi": 5.0})
    texts = [t or "" for _, t in odd] + ["You IDIOT!!! your sooooooo stupidly rott3n, id1ot $$", "ÄÖÜ éééé ßßß 111 ___ ''\"", "a!b you you idiot", "zzz zz z"]
    got = lexicon.matrix(texts)
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts])


def test_lexicon_counts_against_plain_ones(spark, prose):
    rows = [(f"{prose(i % 7, 12)} {'idiot rotters' if i % 3 == 0 else 'fine rotting'} {'rotted rotten' if i % 2 else ''}", int(i % 3 == 0), i % toxicity.FOLDS) for i in range(60)]
    sizes = {}
    for _, label, f in rows:
        sizes[label, f] = sizes.get((label, f), 0) + 1
    found = toxicity.term_counts(spark.createDataFrame(rows, "text string, toxic int, fold int"), 5)
    for without in (None, 0, 3):
        left = [(*toxicity.terms(t), label) for t, label, f in rows if f != without]
        bad, good = (Counter(x for words, stems, label in left for x in words | stems if label == want) for want in (1, 0))
        known = {w for words, _, label in left if label for w in words}
        counts = [(t, c, good[t], sum(w != t[:-1] and w.startswith(t[:-1]) for w in known) if t[-1] == "-" else 0) for t, c in bad.items()]
        want = toxicity.Lexicon.of(counts, sum(label for *_, label in left), sum(1 - label for *_, label in left))
        got = toxicity.lexicon(found, sizes, without)
        assert got.words == want.words and got.stems == want.stems and "idiot" in got.words


def test_posterior_against_plain_bayes(make, odd, prose):
    rows = odd + [(50 + i, prose(300 + i, 5 + 9 * i) + (". " if i % 2 else "!!! ") * (i % 5) + "\n" * (i % 3) + "# $ " * (i % 4)) for i in range(40)]
    counts = quality.count_table(make(rows))
    rules = quality.votes()
    voted = [(r, [r[k] for k in rules]) for r in counts.select("*", *(v.alias(k) for k, v in rules.items())).collect()]
    share, chances = quality.estimate(sorted(Counter(tuple(v) for _, v in voted).items(), key=lambda x: str(x[0])))
    want = []
    for r, v in voted:
        good, bad = share, 1 - share
        for x, (right_good, right_bad) in zip(v, chances):
            if x is not None:
                good *= right_good if x else 1 - right_good
                bad *= 1 - right_bad if x else right_bad
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        want.append((r.doc_id is None, r.doc_id or 0, round(good / (good + bad), 9), not failed and good >= bad))
    got = quality.quality_report(make(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.quality, 9), r.kept) for r in got) == sorted(want)


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This {what} is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {kind} as published by
the Free Software Foundation{tail}

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
LATER = """, either version {v} of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
NOTICES = [
    (APACHE, "Apache-2.0"),
    (GPL.format(what="program", colon=":", kind="General Public License", tail=LATER.format(v=3)), "GPL-3.0-or-later"),
    (GPL.format(what="program", colon=";", kind="General Public License", tail=LATER.format(v=2)), "GPL-2.0-or-later"),
    (GPL.format(what="program", colon=";", kind="General Public License", tail=" version 2."), "GPL-2.0-only"),
    (GPL.format(what="library", colon=";", kind="Lesser General Public License", tail=LATER.format(v="2.1")), "LGPL-2.1-or-later"),
    (GPL.format(what="program", colon=":", kind="Affero General Public License", tail=LATER.format(v=3)), "AGPL-3.0-or-later"),
    (MPL, "MPL-2.0"),
    (MIT, "MIT"),
    (BSD, "BSD-2-Clause"),
    (BSD + BSD_3, "BSD-3-Clause"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "GPL-2.0-only,BSD-3-Clause"),
    ("# SPDX-License-Identifier: Apache-2.0+ AND MIT and more", "Apache-2.0+,MIT"),
    ("All rights\nreserved.", "all-rights-reserved"),
]


def commented(text, lead):
    return "\n".join(f"{lead}{line}".rstrip() for line in text.split("\n"))


@pytest.mark.parametrize("notice, licence", NOTICES)
def test_public_notices_as_they_stand(notice, licence):
    for text in (notice, f"Some prose. More\n\n{notice}\n\nAnd the end.", commented(notice, " * ") if "SPDX" not in notice else notice, commented(notice, "# ")):
        assert ",".join(dict.fromkeys(licences.match_rules(licences.sentence_ids(text)))) == licence


def test_known_sentences_against_a_plain_search(prose):
    """Every known sentence that stands between two breaks of a text is found, whatever its line breaks."""
    r = np.random.default_rng(5)
    for name, sentence in licences.SENTENCES.items():
        words = sentence.split()
        wrapped = "".join(w + ("\n" if r.random() < 0.2 else " ") for w in words).strip()
        for text in (f"{prose(1, 8)}.\n{wrapped}. {prose(2, 5)}", f"{prose(3, 4)}\n\n{wrapped.upper() if name != 'x' else wrapped}\n\n{prose(4, 4)}", wrapped):
            assert [n for _, n in licences.sentence_ids(text)] == [name]
        assert licences.sentence_ids(f"{prose(5, 6)} {' '.join(words)} {prose(6, 6)}") == []
