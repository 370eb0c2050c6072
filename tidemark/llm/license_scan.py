"""Licence scans: a sparse word n-gram classifier of paragraphs, confirmed by comparison with templates.

The classifier is a softmax regression over word 1- to 3-grams with a learned intercept, trained on the driver on
variations of the templates below, on sentences of other kinds, and on licences of unknown name. Its features are all
n-grams that are far commoner in licences than elsewhere; an L1 penalty keeps few of them. A held-out part sets the
temperature and the probability under which a licence-like paragraph counts as ``unknown``. A predicted family stands only
if enough of one of its templates is in the paragraph.

Scanning uses DataFrame operations alone. A paragraph without any n-gram that speaks for some class more than for
``none`` scores at least as surely ``none`` as an empty one, and the intercept makes that ``none``. ``LicenseModel.gate``
finds these n-grams, so texts without one are settled by one regular expression, exactly, and only the others are taken
apart. The weights, whose number the training texts bound, are broadcast.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import staged, table

#: Licence notices by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license", "You may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied", "See the License for the specific language governing permissions and limitations under the License", "Apache License Version 2.0, January 2004", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work", "Apache-2.0 licensed"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program", "either version 3 of the License, or (at your option) any later version", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details"],
    "LGPL": ["Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-only", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "This library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU Lesser General Public License for more details", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "AGPL": ["Licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL license", "under the terms of the GNU Affero General Public License version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "BSD": ["Licensed under the BSD license", "Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["Released under CC0 1.0", "CC0 1.0 Universal public domain dedication", "To the extent possible under law, the author has waived all copyright and related rights to this work", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "proprietary": ["All rights reserved", "Copyright, all rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited", "Proprietary and confidential", "No part of this publication may be reproduced without the prior written permission of the copyright holder", "This software is the confidential and proprietary information of its owner and may not be copied or disclosed without written consent"],
}
#: Uses of the same words that are no licence.
OTHERWISE = ["his driving licence expired last year", "the poet took some licence with the truth", "a fishing license costs ten pounds", "she holds a pilot licence", "the lecture on copyright law was long", "copyright disputes are common in music", "the apache helicopter landed", "the apache people lived in the desert", "a gnu grazed on the plain", "students of mit built the robot", "the house of commons met today", "his rights were respected", "human rights are universal", "she asked permission to leave", "the file is in the drawer", "this software is slow", "a free copy of the newspaper", "the public domain of the state", "the car has a warranty of two years", "the terms of the treaty were harsh", "the restaurant is licensed to sell wine", "an unlicensed driver was fined", "a proprietary blend of herbs", "the village commons were enclosed", "the cc line of the mail", "creative writing classes start in may", "attribution of the painting is uncertain", "the redistribution of wealth"]
#: Sentences of all kinds that are no licence.
PLAIN = [
    "the software is installed by the setup program and updated every month", "copy the file to the folder and restart the service", "the source code of the module is in the first directory", "open the document and select the text to be changed",
    "the conditions on the mountain were worse than expected", "the following table lists the values of each parameter", "any person who wants to join the walk should bring water", "he was provided with food and a place to sleep", "the above figure shows the results of the second test",
    "no part of the house was dry after the storm", "the author of the novel lives in a small town", "the names of the contributors are listed on the last page", "in the event of a fire use the stairs", "the damages caused by the flood are still being counted", "she signed a contract with the club for two years",
    "the purpose of this chapter is to explain how the index is built", "the notice on the door said that the shop was closed", "the program runs without errors on both machines", "the work of the committee will continue in the spring", "a version of the story was published in a magazine",
    "we distribute the load over several machines and merge the results", "the library opens at nine and closes at six", "public transport is free for children under ten", "the general told the press that the war was over", "the law was passed with a small majority", "the use of water is limited in the dry months",
    "the king granted the land to his brother", "modify the settings in the menu before you publish the page", "the goods were sold to a dealer in the city", "the tool reads the data and writes a report", "binary numbers are made of zeros and ones", "all of the members agreed to the new terms", "the band released its second album in march",
    "it is the policy of the school to inform parents", "the subject of the talk was the history of the region", "the holder of the record is a young runner from the north", "his claim was not believed by the court", "the kind of wood that is used for boats", "the materials were brought by train", "more details can be found on the next page",
]
FAMILIES = list(TEMPLATES)
CLASSES = [*FAMILIES, "unknown", "none"]

#: Names in short spellings such as GPLv3 or Apache2, which classify, and what then confirms the family.
SHORT = {"MIT": ["MIT"], "Apache-2.0": ["Apache2", "Apache-2.0", "ASL 2.0"], "GPL": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-2.0-only"], "LGPL": ["LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1-or-later"], "AGPL": ["AGPL", "AGPLv3", "AGPL-3.0"], "BSD": ["BSD", "BSD-2-Clause", "BSD-3-Clause"], "MPL-2.0": ["MPL2", "MPL-2.0", "MPLv2"], "ISC": ["ISC"]}
CONFIRMS = {"MIT": ["license identifier mit"], "Apache-2.0": ["identifier apache 2"], "GPL": ["license identifier gpl", "gpl v 2", "gpl v 3"], "LGPL": ["license identifier lgpl", "lgpl v 2", "lgpl v 3"], "AGPL": ["license identifier agpl", "agpl v 3"], "BSD": ["license identifier bsd", "bsd 2 clause", "bsd 3 clause"], "MPL-2.0": ["identifier mpl 2"], "ISC": ["license identifier isc"]}
#: Word 3-grams of licences with more conditions, which have most of the words of a CC-BY-... family.
REFUTES = ["by nc sa", "by nc nd", "attribution noncommercial sharealike", "attribution noncommercial noderivatives"]
#: Names of licences that are no family here.
OTHERS = ["EPL-2.0", "EPL-1.0", "EUPL-1.2", "CDDL-1.0", "WTFPL", "Zlib", "BSL-1.0", "OFL-1.1", "MS-PL", "Artistic-2.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-3.0", "ODbL-1.0", "OSL-3.0", "AFL-3.0", "PSF-2.0", "Python-2.0", "NCSA", "X11", "Vim", "Ruby"]

#: A word is letters or digits alone; the v of a version ends the word before it: gplv3 is gpl, v, 3.
WORD = r"[a-z]+?(?=v[0-9])|[a-z]+|[0-9]+"
#: Paragraphs end at empty lines, and at line ends after a sentence.
PARAGRAPH_END = r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n"
#: Longer paragraphs are scanned in windows of so many words, so far apart.
WINDOW, STEP = 160, 120
#: A feature is in so many training paragraphs, so many times oftener in licences than elsewhere; the L1 penalty.
LEAST_COUNT, LEAST_ODDS, PENALTY, STEPS = 4, 5.0, 5e-4, 120
#: Words that say nothing by themselves; a feature has another one, of two letters at least
#: or, alone, of three.
EMPTY = frozenset("a an the this that these those it its he she they we you his her their our your who which what and or but nor not no if as at by for from in into of off on onto out over to up upon with without under within about after before all any both each either even every few more most neither none only other others own same so some such than then there too very when where while is are was were be been being has have had do does did may might can could shall should will would must how however here new first one two also just like well see use used using make made him them us me my anyone part use get including included include".split())
#: The share of a template's word 3-grams that confirms it.
COVERAGE = 0.6


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _atoms(gram: str) -> list[str]:
    """Regular expressions of the letters of an n-gram, of what may lie between its words in a text, and of its end."""
    words = gram.split()
    out = list(words[0])
    for a, b in zip(words, words[1:], strict=False):
        out += ["[^a-z0-9]*" if b == "v" or a[-1].isdigit() != b[0].isdigit() else "[^a-z0-9]+", *b]
    return [*out, "(?![0-9])" if out[-1].isdigit() else "(?:(?![a-z])|(?=v[0-9]))"]


def any_of(grams: set[str]) -> str:
    """A regular expression, shaped as a tree, for any of some n-grams in a lower-case text."""

    def branch(some: list[list[str]]) -> str:
        tree: dict = {}
        for atoms in some:
            node = tree
            for a in atoms:
                node = node.setdefault(a, {})

        def text(node: dict) -> str:
            more = [a + text(node[a]) for a in sorted(node)]
            return more[0] if len(more) == 1 else f"(?:{'|'.join(more)})" if more else ""

        return text(tree)

    kinds: dict[str, list[list[str]]] = {}
    for g in sorted(grams):  # a v that begins an n-gram may end a word: gplv3
        start = "" if g.split()[0] == "v" else "(?<![0-9])" if g[0].isdigit() else "(?<![a-z])"
        kinds.setdefault(start, []).append(_atoms(g))
    return "(?:" + "|".join(start + branch(some) for start, some in kinds.items()) + ")"


def least_grams(grams: set[str]) -> set[str]:
    """Those that hold no other one."""

    def parts(g: str) -> set[str]:
        words = g.split()
        return {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)} - {g}

    return {g for g in grams if parts(g).isdisjoint(grams)}


def confirming() -> list[tuple[str, set[str]]]:
    """Families with the shingles of each text that confirms them."""
    return [(f, shingles_of(words_of(t))) for f in FAMILIES for t in [*TEMPLATES[f], *CONFIRMS.get(f, [])]]


def shingles_of(words: list[str]) -> set[str]:
    """Word 3-grams; the whole of a shorter text."""
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


@dataclass(frozen=True)
class LicenseModel:
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    threshold: float
    gate: str  #: finds any n-gram that speaks for some class more than for none, in lower-case text

    def probabilities(self, words: list[str]) -> np.ndarray:
        s = np.array(self.bias)
        for g in grams_of(words):
            if g in self.weights:
                s = s + np.array(self.weights[g])
        e = np.exp((s - s.max()) / self.temperature)
        return e / e.sum()


def _examples(rng: random.Random, each: int) -> list[tuple[list[str], int]]:
    """Varied training paragraphs and their classes."""
    filler = "the of and to in a for with this that code work file page text project author data from all rest is are der die das und mit von le la les de et el los que en mit".split()
    invented = ["".join(rng.choices("bdfgklmnprstvz", k=1)[0] + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]

    def vary(words: list[str], drop: float) -> list[str]:
        words = [w for w in words if rng.random() >= drop] or words
        pad = lambda: rng.choices(filler + invented, k=rng.choice((0, 0, 2, 6, 20)))
        return pad() + words + pad()

    rows = []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            rows += [(vary(words_of(t), rng.choice((0, 0, 0.05, 0.1))), k) for _ in range(each)]
    forms = ["licensed under the {} license", "released under the {} public license version {}", "this work is licensed under the {} {} license", "spdx-license-identifier {}-1.0", "distributed under the {} community license agreement", "see the {} licence for the terms of use", "copyright {} {}", "use is governed by the {} license"]
    for _ in range(6 * each):
        rows.append((vary(words_of(rng.choice(forms).format(rng.choice(invented), rng.choice(invented))), 0), CLASSES.index("unknown")))
    short = ["distributed under {}", "available as {}", "{} licensed", "a {} licensed library", "license {}", "the license is {}", "{} or later", "released under {}", "spdx-license-identifier {}", "spdx-license-identifier {}-or-later", "code under {} only"]
    for _ in range(24 * each):
        family = rng.choice(list(SHORT))
        rows.append((vary(words_of(rng.choice(short).format(rng.choice(SHORT[family]))), 0), FAMILIES.index(family)))
        rows.append((vary(words_of(rng.choice(short).format(rng.choice(OTHERS))), 0), CLASSES.index("unknown")))
    for _ in range(4 * each):
        rows.append((vary(words_of(f"spdx-license-identifier {rng.choice(invented)}-{rng.randint(1, 9)}.{rng.randint(0, 9)}"), 0), CLASSES.index("unknown")))
    for t in OTHERWISE:
        rows += [(vary(words_of(t), 0), CLASSES.index("none")) for _ in range(each // 2)]
    for t in PLAIN:
        rows += [(vary(words_of(t), rng.choice((0, 0, 0.1))), CLASSES.index("none")) for _ in range(each // 2)]
    rows += [([w for t in rng.sample(PLAIN, rng.randint(1, 5)) for w in words_of(t)], CLASSES.index("none")) for _ in range(8 * each)]
    rows += [(rng.choices(filler + invented, k=rng.randint(3, 60)), CLASSES.index("none")) for _ in range(4 * each)]
    return rows


def regression(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights of a softmax regression with an L1 penalty on all but the last feature, by accelerated proximal steps."""
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(20):  # the largest eigenvalue of x'x / n bounds the curvature
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 2.0 / (float(np.linalg.norm(x @ v)) ** 2 / len(x) * 1.05)
    w = ahead = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    t = 1.0
    for _ in range(steps):
        s = x @ ahead
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - rate * (x.T @ (p - y) / len(x))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w


@lru_cache(maxsize=1)
def trained(seed: int = 5) -> LicenseModel:
    """Fits the regression, then calibrates it on held-out examples."""
    rng = random.Random(seed)
    train, held = _examples(rng, 12), _examples(rng, 5)
    none = CLASSES.index("none")
    count, plain = Counter(), Counter()
    sets = [grams_of(w) for w, _ in train]
    for s, (_, c) in zip(sets, train, strict=True):
        (plain if c == none else count).update(s)
    others = sum(c == none for _, c in train)
    scale = others / (len(train) - others)
    telling = lambda g: [u for u in g.split() if u not in EMPTY and re.match("[a-z]{2}" if " " in g else "[a-z]{3}", u)]
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n >= LEAST_COUNT and n * scale >= LEAST_ODDS * (plain[g] + 0.5) and telling(g)))}
    x = np.zeros((len(train), len(vocabulary) + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, s in enumerate(sets):
        x[i, [vocabulary[g] for g in s if g in vocabulary]] = 1
    w = regression(x, np.eye(len(CLASSES), dtype=np.float32)[[c for _, c in train]]).astype(float)
    weights = {g: tuple(w[i].tolist()) for g, i in vocabulary.items() if w[i].any()}
    bias = w[-1] - w[-1].max()
    if np.exp(bias).sum() > 2 * np.exp(bias[none]):
        raise ValueError("a paragraph without a feature must be none")

    gate = any_of(least_grams({g for g, v in weights.items() if max(v) > v[none]}))
    model = LicenseModel(weights, tuple(bias.tolist()), 1.0, 0.0, gate)
    found = [(model.probabilities(words), c) for words, c in held]

    def loss(t: float) -> float:
        total = 0.0
        for p, c in found:
            q = np.power(p, 1 / t)
            total -= np.log(q[c] / q.sum() + 1e-12)
        return total

    # not above 1: there a paragraph without features could lose its majority for none
    temperature = min((0.5, 0.6, 0.7, 0.85, 1.0), key=loss)
    model = replace(model, temperature=temperature)
    stranger = [model.probabilities(words)[: len(FAMILIES)].max() for words, c in held if CLASSES[c] == "unknown"]
    return replace(model, threshold=float(max(0.5, np.quantile(stranger, 0.98))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row per document: doc_id, licence, probability, coverage, n_notices, families.

    ``licence`` is the family of the likeliest confirmed paragraph, else ``unknown`` if any paragraph is licence-like,
    else ``none``; ``probability`` and ``coverage`` are that paragraph's (null for none), ``n_notices`` counts
    licence-like paragraphs and ``families`` lists the confirmed families, sorted, comma-separated. Of equally likely
    families the first in ``FAMILIES`` is a paragraph's; of equally likely paragraphs the one with more of a template, then
    the later family by name, is the document's. Texts of any length are scanned whole, long paragraphs in windows that
    overlap. Null and empty texts have no notice. A null id stays null, repeated rows give repeated rows, other columns
    are ignored; an empty table gives an empty result.
    """
    spark, model = docs.sparkSession, model or trained()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.when(F.lower(text_col).rlike(model.gate), F.col(text_col)).alias("text"))
    rows = staged(rows, "licence-rows")

    parts = rows.where("text is not null").select("row", F.posexplode(F.split("text", PARAGRAPH_END)).alias("part", "paragraph")).where(F.lower("paragraph").rlike(model.gate))
    parts = parts.withColumn("words", F.regexp_extract_all(F.lower("paragraph"), F.lit(WORD), F.lit(0))).drop("paragraph")
    starts = F.expr(f"sequence(0, greatest(0, cast(ceil((size(words) - {WINDOW}) / {STEP}) as int)))")
    parts = parts.select("row", "part", F.posexplode(starts).alias("window", "k"), "words").withColumn("words", F.expr(f"slice(words, k * {STEP} + 1, {WINDOW})")).drop("k")

    def n_grams(n: int):
        return F.expr(f"transform(sequence(1, greatest(1, size(words) - {n - 1})), i -> array_join(slice(words, i, {n}), ' '))")

    key = ["row", "part", "window"]
    parts = parts.where("size(words) > 0").withColumn("shingles", F.array_distinct(n_grams(3)))
    parts = staged(parts, "licence-parts")  # few: only paragraphs with a word of the gate
    weights = spark.createDataFrame([(g, *w) for g, w in model.weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(len(CLASSES))))
    grams = parts.select(*key, F.explode(F.array_distinct(F.concat(n_grams(1), n_grams(2), n_grams(3)))).alias("gram"))
    sums = grams.join(F.broadcast(weights), "gram").groupBy(*key).agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(CLASSES))])
    exps = F.transform(F.array(*[(F.col(f"s{i}") + b) / model.temperature for i, b in enumerate(model.bias)]), F.exp)
    scored = sums.select(*key, exps.alias("e")).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    family = F.slice("e", 1, len(FAMILIES))
    best = F.array_max(family)
    scored = scored.select(*key, (best / F.col("z")).alias("probability"), F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(family, best).cast("int")).alias("family"), (F.element_at("e", -1) / F.col("z")).alias("none"))
    scored = scored.where("none < 0.5")

    templates = spark.createDataFrame([(f, sorted(t)) for f, t in confirming()], "family string, template array<string>")
    likely = scored.join(parts.select(*key, "shingles"), key)
    compared = likely.join(F.broadcast(templates), "family").withColumn("coverage", F.when(F.col("family").startswith("CC-BY") & F.arrays_overlap("shingles", F.array(*map(F.lit, REFUTES))), 0.0).otherwise(F.size(F.array_intersect("shingles", "template")) / F.size("template")))
    notices = compared.groupBy(*key, "family", "probability").agg(F.max("coverage").alias("coverage"))
    notices = notices.withColumn("confirmed", (F.col("probability") >= model.threshold) & (F.col("coverage") >= COVERAGE))

    rank = F.struct("confirmed", "probability", "coverage", "family")
    found = notices.groupBy("row").agg(F.max(rank).alias("best"), F.countDistinct("part").alias("n_notices"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"))
    out = rows.drop("text").join(found, "row", "left")
    licence = F.when(F.col("best").isNull(), "none").when(F.col("best.confirmed"), F.col("best.family")).otherwise("unknown")
    return out.select("doc_id", licence.alias("licence"), F.col("best.probability").alias("probability"), F.col("best.coverage").alias("coverage"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
