"""The licence classifier on held-out notices, and its scan against a plain search."""

import re

import pyarrow as pa
import pytest

from ledgerloom.llm import license_scan as L


@pytest.fixture(scope="module")
def model(spark, sf):
    return L.train(spark.read.parquet(f"{sf}/documents.parquet"))


HELD_OUT = {
    "Code in this folder: Apache License, Version 2.0, unless stated otherwise": "Apache-2.0",
    "our data is offered under CC BY-NC 4.0 only": "CC-BY-NC",
    "our data is offered under CC BY 4.0 only": "CC-BY",
    "Project files use the MIT License": "MIT",
    "redistribute it and modify it under the terms of the GNU General Public License": "GPL",
    "redistribute it and modify it under the terms of the GNU Lesser General Public License": "LGPL",
    "Redistribution and use in source and binary forms are permitted provided that the following conditions are met": "BSD",
    "a summer day by the river": None,
    "he lost his driver license": None,
    "": None,
}


def test_held_out_notices(spark, model):
    docs = spark.createDataFrame([(i, f"first line\n{t}\nlast", "x") for i, t in enumerate(HELD_OUT)] + [(None, None, ""), (5, "", "")], "doc_id long, text string, family string")
    got = {r.doc_id: r for r in L.scan_licences(docs, model).collect()}
    assert {i: r.family for i, r in got.items()} == {i: f for i, f in enumerate(HELD_OUT.values()) if f}
    assert all(r.paragraph == 1 and r.confirmed and 0 < r.probability <= 1 for r in got.values())
    assert L.scan_licences(docs.limit(0), model).count() == 0


PARAGRAPHS = {
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.': "MIT",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "MIT",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSD",
    "Neither the name of Example Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.': "Apache-2.0",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.": "GPL",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.": "LGPL",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "Unlicense",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": "Zlib",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "This program is made available under the Eclipse Public License 2.0": None,
    "Eclipse Public License 2.0": None,
    'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.': None,
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice appears.": None,
    "Redistribution of this software in source or binary form, with or without modification, is forbidden.": None,
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.": "BSD",
    "The parties agree that the terms of this contract shall remain confidential without limitation.": None,
    "All rights to the photographs remain with the author.": None,
}


def test_paragraphs_of_real_licences(spark, model):
    docs = spark.createDataFrame([(i, f"# Title\n\n{t}\n\nend") for i, t in enumerate(PARAGRAPHS)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licences(docs, model).collect()}
    assert {i: r.family for i, r in got.items() if r.confirmed} == {i: f for i, f in enumerate(PARAGRAPHS.values()) if f}
    assert not any(r.confirmed for i, r in got.items() if list(PARAGRAPHS.values())[i] is None)


def test_repeated_rows_ties_and_long_lines(spark, model):
    notice = "Released under the MIT License."
    long = " ".join(["word"] * 400_000)
    docs = spark.createDataFrame([(1, notice), (1, notice), (2, f"{long}\n{notice}\n{notice}"), (3, f"{long} {notice}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in L.scan_licences(docs, model).where("confirmed").collect())
    assert got[:4] == [(1, 0, "MIT"), (1, 0, "MIT"), (2, 1, "MIT"), (2, 2, "MIT")]


def test_calibration_and_templates_equal_plain_computation(model):
    """Templates' distances by dynamic programming; probabilities are a distribution, and the least mass keeps ordinary paragraphs out."""
    grams = L.Grams()
    templates = L.Templates(grams)
    for text, family in PARAGRAPHS.items():
        words = grams.words(text)
        rows, logits = model.logits(grams, pa.array([text]))
        if len(rows):
            p = model.probabilities(logits)[0]
            assert abs(p.sum() - 1) < 1e-5 and (family is None) == (not (p[:-1].max() >= model.least and templates.closest(model.families[int(p[:-1].argmax())], words)[1] <= L.CONFIRM))
        if family:
            best = min((plain_distance(w, words) / len(w), t) for t, w in templates.of[family])
            assert templates.closest(family, words)[1] == pytest.approx(best[0])


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_scan_finds_planted_lines(spark, sf, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {"GNU General Public License, version 3": "GPL", "CC BY-NC 4.0": "CC-BY-NC", "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0"}
    want = {(r.doc_id, i, family) for r in docs.collect() for i, line in enumerate((r.text or "").split("\n")) for name, family in known.items() if name in line}
    got = {(r.doc_id, r.paragraph, r.family) for r in L.scan_licences(docs, model).where("confirmed").collect()}
    assert len(want) > 10 and got == want


def test_probabilities_equal_plain_sums(model):
    grams = L.Grams()
    texts = [*HELD_OUT, "Released under the MIT License."]
    rows, logits = model.logits(grams, pa.array(texts))
    number = {int(k): i for i, k in enumerate(model.keys)}
    for row, got in zip(rows, logits, strict=True):
        words = grams.words(texts[row])
        own = {int(h) for n in (1, 2, 3) for h in L.runs(L.np.array(words, L.np.uint64), n)}
        want = model.bias + sum(model.weights[number[h]] for h in own if h in number)
        assert got == pytest.approx(want, abs=1e-4)
    assert all(re.search(r"\w", texts[i]) for i in rows)


WRAPPED = {
    "Copyright 2020\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights": ("MIT", 1),
    "# Redistribution and use in source and\n# binary forms, with or without\n# modification, are permitted provided\n# that the following conditions are met:\n#\n# 1. Keep this": ("BSD", 0),
    "a summer day\nby the river\nunder the GNU General Public\nLicense as it stands": ("GPL", 2),
    "first\nreleased under the GNU Lesser\nGeneral Public License": ("LGPL", 1),
    "first\nlicensed under the Mozilla\n  Public\n License, version 2.0.": ("MPL", 1),
    "about the GNU General\n\nPublic License of another": None,
    "a summer day\nby the river\nhe lost his driver\nlicense": None,
}


def test_notices_over_line_breaks(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(WRAPPED)] + [(99, "")], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.family, r.paragraph) for r in L.scan_licences(docs, model).where("confirmed").collect()]
    assert sorted(got) == [(i, *want) for i, want in enumerate(WRAPPED.values()) if want]


def test_training_sample_is_by_hash_of_whole_texts(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(L, "fit", lambda texts, classes, ordinary: taken.extend(ordinary))
    texts = ["hot copy"] * 50 + [f"{'w ' * 3000}\ntail {i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    L.train(docs, sample=10)
    assert len({p for p in taken if p.startswith("tail")}) >= 9 and taken.count("hot copy") <= 1
    first = list(taken)
    taken.clear()
    L.train(docs.repartition(7), sample=10)
    assert taken == first
