"""License scans: SQL against the model in Python, and notices among ordinary text."""

from __future__ import annotations

import re

import numpy as np
import pytest

from normlearn.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    return L.train()


def expected(text, model, least=0.5):
    """Notices of a text by the model's own formula."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        words = L.words_of(line)
        p = model.probabilities(words)
        family = model.classes[int(np.argmax(p))]
        if family != L.UNKNOWN and p.max() >= least:
            sure = any(
                len(set(L.words_of(n)) & set(words)) >= 0.75 * len(set(L.words_of(n)))
                and len(set(L.pairs_of(L.words_of(n))) & set(L.pairs_of(words))) >= 0.5 * len(set(L.pairs_of(L.words_of(n))))
                for n in L.NOTICES[family]
            )
            out.append((k, family, sure))
    return out


@pytest.mark.parametrize("which", ["edge_docs", "documents", "no_docs"])
def test_rows_are_the_models(request, model, which):
    docs = request.getfixturevalue(which)
    found = L.licenses(docs, model).collect()
    assert len(found) == docs.count()
    for_id = {}
    for r in docs.collect():
        for_id.setdefault(r.doc_id, []).append(expected(r.text, model))
    for r in found:
        assert [(n.line, n.family, n.confirmed) for n in r.notices] in for_id[r.doc_id]
        assert r.n_notices == len(r.notices) and r.n_confirmed == sum(n.confirmed for n in r.notices)
        assert r.families == ",".join(sorted({n.family for n in r.notices if n.confirmed}))


def test_planted_notices_are_found(documents, model):
    patterns = {
        "apache-2.0": "Licensed under the Apache License", "mit": "Released under the MIT License", "cc-by-nc": "CC BY-NC 4.0",
        "gpl": "GNU General Public License", "proprietary": "All rights reserved",
    }
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in L.licenses(documents, model).collect():
        assert r.families == ",".join(sorted(f for f, p in patterns.items() if p in texts[r.doc_id]))


def test_notices_in_other_words(shipped, model):
    lines = {
        "Copyright 2020 Somebody. All rights reserved.": "proprietary",
        "// SPDX-License-Identifier: MIT": "mit",
        "released under the mit licence": "mit",
        "Licensed under the Apache License, Version 2.0 (the License)": "apache-2.0",
        "* This program: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
        "This text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "the new license plates arrived": "unknown",
        "your table is reserved": "unknown",
    }
    docs = shipped.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.doc_id: r.families or "unknown" for r in L.licenses(docs, model).collect()}
    right = sum(found[k] == family for k, family in enumerate(lines.values()))
    assert right >= 7


def test_training_repeats(model):
    L.train.cache_clear()
    assert L.train() == model


def test_lines_without_an_anchor_are_unknown(model):
    assert model.classes[int(np.argmax(model.bias))] == L.UNKNOWN
    assert all(set(f.split()) & set(L.ANCHORS) for f in model.weights)
    assert not re.search(r"\s", "".join(L.ANCHORS))


def test_plan_has_no_python(edge_docs, model):
    plan = L.licenses(edge_docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_wrapped_notices_are_found_once(shipped, model):
    header = [
        "This program is free software: you can redistribute it and/or modify",
        "it under the terms of the GNU General Public License as published by",
        "the Free Software Foundation, either version 3 of the License, or",
    ]
    long = " ".join(["filler"] * 500)
    texts = {
        "\n".join(["some code", *header]): "gpl",
        "\n".join(["/*", *[f" * {x}" for x in header], " */"]): "gpl",
        f"{long} {header[0]}\n{header[1]} {long}": "gpl",
        f"{header[0]}\n\n{header[1]}": "",
        "a first line\nLicensed under the Apache\nLicense, Version 2.0\nand a last": "apache-2.0",
        "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of\nthis software": "mit",
        "all of us went\nhome, rights and tables\nwere not reserved": "",
    }
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in L.licenses(docs, model).collect()}
    assert [found[k].families for k in range(len(texts))] == list(texts.values())
    assert all(found[k].n_confirmed == (1 if family else 0) for k, family in enumerate(texts.values()))


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("SPDX-License-Identifier: EPL-2.0", "epl"),
        ("# SPDX-License-Identifier: AGPL-3.0", "agpl"),
        ("This is licensed under the GNU Affero General Public License", "agpl"),
        ("Dieses Werk ist lizenziert unter CC BY-SA 4.0.", "cc-by-sa"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files", "mit"),
        ("Released under the MIT licence", "mit"),
        ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License", "lgpl"),
        ("This program is free software: you can redistribute it and/or modify", ""),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", "isc"),
        ("Distributed under the Boost Software License, Version 1.0", ""),
        ("Licensed under the Open Software License version 3.0", ""),
        ("SPDX-License-Identifier: WTFPL", ""),
        ("License the Apache under, 2.0 Licensed Version", ""),
        ("we asked for permission, free of charge, and any person got a copy of the software", ""),
    ],
)
def test_families_and_other_licences(shipped, model, text, family):
    docs = shipped.createDataFrame([(1, f"some words\n{text}\nmore words")], "doc_id long, text string")
    assert L.licenses(docs, model).first().families == family


def test_no_confirmed_line_lacks_an_anchor():
    """Whatever a paragraph lacks of a notice, the words it must hold have an anchor among them."""
    import math

    for notice in [n for family in L.NOTICES.values() for n in family]:
        words = set(L.words_of(notice))
        assert len(words - set(L.ANCHORS)) < math.ceil(L.MOST * len(words))
