import re

import numpy as np
import pytest

from tidemark.llm import license_scan as L


def scan_text(text, model):
    """licence, n_notices and families of one text by plain loops, without a gate."""
    best, notices, families = None, set(), set()
    for k, paragraph in enumerate(re.split(L.PARAGRAPH_END, text or "")):
        words = re.findall(r"[a-z]+?(?=v[0-9])|[a-z]+|[0-9]+", paragraph.lower())
        for s in range(0, max(1, len(words) - L.WINDOW + L.STEP), L.STEP):
            part = words[s : s + L.WINDOW]
            if not part:
                continue
            grams = {tuple(part[i : i + n]) for n in (1, 2, 3) for i in range(len(part)) if i + n <= len(part)}
            score = np.array(model.bias) + sum((np.array(model.weights[" ".join(g)]) for g in grams if " ".join(g) in model.weights), np.zeros(len(L.CLASSES)))
            p = np.exp(score / model.temperature - (score / model.temperature).max())
            p /= p.sum()
            if p[-1] >= 0.5:
                continue
            notices.add(k)
            top = int(np.argmax(p[: len(L.FAMILIES)]))
            family, joined = L.FAMILIES[top], {" ".join(part[i : i + 3]) for i in range(max(1, len(part) - 2))}
            coverage = max(len(joined & t) / len(t) for f, t in L.confirming() if f == family)
            if family.startswith("CC-BY") and any(r in joined for r in L.REFUTES):
                coverage = 0.0
            sure = bool(p[top] >= model.threshold and coverage >= L.COVERAGE)
            if sure:
                families.add(family)
            best = max(best or (False, 0, 0, ""), (sure, p[top], coverage, family))
    return "none" if best is None else best[3] if best[0] else "unknown", len(notices), ",".join(sorted(families))


def test_matches_brute_force(documents, texts):
    model = L.trained()
    for r in L.scan(documents).collect():
        assert (r.licence, r.n_notices, r.families) == scan_text(texts[r.doc_id], model)


@pytest.mark.parametrize(("text", "licence"), [("Released under the MIT License.", "MIT"), ("x y.\nLicensed under the Apache License, Version 2.0.\nz", "Apache-2.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under the Foobar License", "unknown"), ("His driving licence expired last year.", "none"), ("das kommt mit der Post", "none")])
def test_notices(text, licence):
    assert scan_text(text, L.trained())[0] == licence


def test_long_paragraph_is_scanned_to_its_end(spark):
    df = spark.createDataFrame([(1, "word " * 5000 + "released under the mit license")], "doc_id long, text string")
    assert L.scan(df).first().licence == "MIT"


def test_held_out_accuracy():
    import random

    model, right, rows = L.trained(), 0, L._examples(random.Random(99), 4)
    for words, c in rows:
        p = model.probabilities(words)
        f = p[: len(L.FAMILIES)].argmax()
        right += L.CLASSES[c] == ("none" if p[-1] >= 0.5 else L.FAMILIES[f] if p[f] >= model.threshold else "unknown")
    assert right / len(rows) > 0.9


def test_odd_rows(odd, empty):
    got = L.scan(odd).collect()
    assert len(got) == odd.count() and {r.licence for r in got} == {"none"} and sum(r.doc_id == 1 for r in got) == 2
    assert L.scan(empty).count() == 0


SPELLINGS = ["This program is distributed under GPLv3", "GPLv2 or later", "Distributed under AGPLv3", "Available as Apache2", "an MIT-licensed library", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "SPDX-License-Identifier: Frobnitz-7.3", "(c) 2020, sublicensing under LGPLv2.1+ only", "covered by the MPLv2"]


@pytest.mark.parametrize("text", SPELLINGS)
def test_other_spellings_are_notices(text):
    assert scan_text(text, L.trained())[0] != "none"


@pytest.mark.parametrize(("text", "licence"), [("SPDX-License-Identifier: GPL-2.0-only", "GPL"), ("Distributed under AGPLv3", "AGPL"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL"), ("SPDX-License-Identifier: EPL-2.0", "unknown"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "unknown"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC"), ("SPDX-License-Identifier: Frobnitz-7.3", "unknown")])
def test_other_spellings_by_family(text, licence):
    assert scan_text(text, L.trained())[0] == licence


def test_gate_passes_every_word_with_a_feature(spark):
    rows = [(i, t) for i, t in enumerate([*SPELLINGS, "x GPLv3", "3mit", "MPL2", "unlicensed", "Relicensed GPLx", "copyrighted"])]
    got = {r.doc_id: (r.licence, r.n_notices, r.families) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: scan_text(t, L.trained()) for i, t in rows}


#: Paragraphs as people write them, none made by the training's generator.
OUTSIDE = [
    ("MIT", "This package is MIT licensed; see the file LICENSE for the full text."), ("MIT", "Copyright (c) 2019 Jane Roe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."), ("MIT", "You can use it freely: the whole project is released under the MIT License, so have fun with it."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."), ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("GPL", "foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."), ("GPL", "bar is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."), ("GPL", "The kernel modules are GPLv2, everything else is ours."),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see the web site."), ("AGPL", "Our server is licensed under the GNU Affero General Public License version 3."), ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), ("BSD", "Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."), ("Unlicense", "This is free and unencumbered software released into the public domain."), ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."), ("CC-BY", "Photos: Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Except where noted, this site is licensed under CC BY-NC 4.0."), ("CC0", "The data are in the public domain under CC0 1.0."), ("proprietary", "Copyright 2021 Acme Corp. All rights reserved."), ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."), ("unknown", "This work is licensed under the Frobnicate Public License, version 7."), ("unknown", "Use of the data is governed by the Springfield Community License Agreement."),
    *[("none", t) for t in (
        "My driving licence was renewed last week and the office was very slow.", "The software crashed twice while I was copying the file to another disk.", "Permission to land was given after twenty minutes over the airport.", "He sold the copyright of his songs to a publisher in London.", "The Apache are a group of tribes of the south-west.", "She studied physics at MIT before she moved to Zurich.",
        "The warranty of the washing machine covers parts for two years.", "The terms of the agreement were not made public.", "The public domain of the crown was sold in 1803.", "You can download the source code and compile it with make.", "In no event did the players leave the field.", "The authors thank the reviewers for their comments.", "We distribute food to all who come.", "The creative team met the commons committee at noon.",
        "The bird is free to go wherever it wants.", "The results are provided in table three, with and without correction.", "Conditions apply to members only, ask at the desk.", "His work was used without his knowledge.", "The version of the program in the archive is old.", "Der Zug kommt mit Verspätung an, sagt der Schaffner.", "Le chat dort sur la chaise et le chien dans le jardin.", "This chapter is about the general theory and its limits.", "Any person found on the track will be fined.", "The names of the winners are published on Monday.", "All visitors must sign the book; no exceptions are made.",
    )],
]


def test_paragraphs_from_outside(spark):
    rows = [(i, text) for i, (_, text) in enumerate(OUTSIDE)]
    got = {r.doc_id: r.licence for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(OUTSIDE[i][0], got[i]) for i in got]
    right = sum(a == b != "none" for a, b in pairs)
    precision, recall = right / sum(b != "none" for _, b in pairs), right / sum(a != "none" for a, _ in pairs)
    assert precision >= 0.9 and recall >= 0.9, [(a, b, OUTSIDE[i][1]) for i, (a, b) in enumerate(pairs) if a != b]


def test_the_gate_is_exact():
    """A paragraph without a word of the gate has no n-gram that speaks for a licence."""
    model = L.trained()
    gate = re.compile(model.gate)
    for gram, w in model.weights.items():
        assert max(w) <= w[-1] or gate.search(gram), gram
    assert scan_text("nothing of that kind", model)[0] == "none" and model.probabilities([])[-1] > 0.5
