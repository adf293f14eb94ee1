import textwrap

import pytest

from sparkvec.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    plain = spark.createDataFrame([("The house by the river is old and the road to it is long.\nNobody can say how old.",)] * 20, "text string")
    return licenses.fit(plain)


def families(spark, model, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: [(x.line, x.family) for x in r.found] for r in licenses.paragraphs(rows, model).collect()}


def test_templates_case_and_separators(spark, model):
    for family, templates in licenses.TEMPLATES.items():
        got = families(spark, model, [f"First line.\n{t}" for t in templates] + [t.upper().replace(" ", "!! ") for t in templates])
        assert all(x and x[0][1] == family for x in got.values()), (family, got)


def test_none_and_unknown(spark, model):
    got = families(spark, model, [None, "", "the old road", "Licensed under the terms of the Frobnitz Free Software License, version 7, published by the foundation"])
    assert got[0] == got[1] == got[2] == [] and got[3] == [(0, "unknown")]


def test_scan_columns(spark, docs, clashing):
    rows = {r.doc_id: r for r in licenses.scan(clashing).collect()}
    assert rows[8].families == "mit" and rows[8].lines == "0:mit" and rows[8].n_paragraphs == 2
    assert rows[4].n_paragraphs == 0 and rows[4].families == ""
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(docs.limit(0)).count() == 0


def test_scores_equal_plain_arithmetic(spark, model):
    """The SQL probabilities are those of the model."""
    text = "This work is licensed under the GNU General Public License"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    p = licenses.paragraphs(rows, model).first().found[0].p
    assert p == pytest.approx(model.probabilities(text.lower().split())[model.families.index("gpl")], abs=1e-5)


def test_wrapped_notices(spark, model):
    """Standard notices wrapped at two widths, in a block of their own and as a comment with more text."""
    whole = [(family, t) for family, templates in licenses.TEMPLATES.items() for t in templates if len(t) > 100]
    texts, expected = [], []
    for width in (30, 75):
        for family, t in whole:
            lines = textwrap.wrap(t, width)
            texts += ["The old house.\n\n" + "\n".join(lines) + "\n\nThe long road.", "\n".join(f" * {x}" for x in lines) + "\n * Nobody can say how old the house is."]
            expected += [(family, 2), (family, 0)]
    texts.append("\n\n".join(textwrap.wrap(licenses.TEMPLATES["mit"][1], 30)))
    got = families(spark, model, texts)
    for i, (family, line) in enumerate(expected):
        assert [x for x in got[i] if x[1] != "unknown"] == [(line, family)], (texts[i], got[i])
    assert "mit" not in [f for _, f in got[len(expected)]]


#: Notices as they stand in files, none of them a template.
HELD_OUT = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice"),
    ("cc-by", "This article is licensed under a Creative Commons Attribution 4.0 International License, which permits use and sharing."),
    ("cc-by-nc", "Except where noted, this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "The text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License (CC BY-SA)."),
    ("cc0", "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the address below"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"),
    ("reserved", "Copyright 2019 Example Press. All rights reserved. No part of this publication may be reproduced in any form without permission."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy it."),
]
PLAIN = ["The public house by the river was free to all.", "He gave her permission to copy the general map.", "Software is hard and the work is long; use it with care.", "The foundation of the old bridge was published in a book.", "All roads are reserved for the terms of winter."]


def test_held_out_notices(spark, model):
    """Recall over notices that were not trained on, on one line and wrapped, and no licence where there is none."""
    texts = [t for _, t in HELD_OUT] + ["\n".join(textwrap.wrap(t, 72)) for _, t in HELD_OUT] + PLAIN
    got = families(spark, model, texts)
    expected = [f for f, _ in HELD_OUT] * 2
    hit = [any(f == x for _, x in got[i]) for i, f in enumerate(expected)]
    assert sum(hit) >= 0.9 * len(hit), [(f, got[i]) for i, f in enumerate(expected) if not hit[i]]
    wrong = [(f, got[i]) for i, f in enumerate(expected) if {x for _, x in got[i]} - {f, "unknown"}]
    assert not wrong
    assert not [x for i in range(len(expected), len(texts)) for _, x in got[i] if x != "unknown"]


def test_words_are_counted_over_all_lines(spark, model):
    texts = ["the license\nthe old road\n\n  \nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"] * 30 + [None, "", "The THE the"]
    total, often = licenses.line_counts(spark.createDataFrame([(t,) for t in texts], "text string"), model.templates)
    assert total == 61 and often["the"] == 61 and often["license"] == 30 and "granted" not in often
