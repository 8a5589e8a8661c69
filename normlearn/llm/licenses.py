"""Licence notices in documents, by a trained paragraph classifier.

A paragraph is a line, or up to SPAN adjacent lines that are not blank, as notices
are wrapped; comment marks are no words, and "licence" counts as "license".  Of a
line before or after a break only the REACH words next to it count.  A paragraph of
several lines is a notice where it is confirmed and no shorter run of its lines is,
for the same family; of such paragraphs that share a line the first counts.  Words
and pairs of words are features of a sparse multinomial logistic regression whose
classes are licence families and unknown.
The model is trained here, from the notices below with words dropped, added and
cut off, and, for the class unknown, from ordinary lines and notices of licences
that are no family; a temperature fitted on lines kept apart, those of other
licences among them, calibrates its probabilities.  A family predicted with at least
``least`` probability is confirmed where the paragraph holds most words of one of its
notices, and most of the notice's pairs of adjacent words, so their order counts.

Lines are scored where they hold an anchor.  Anchors follow from the notices: of each
notice, so many of its rarest words that a paragraph cannot hold most of the notice
and none of them.  So no line that could be confirmed alone is passed over.  Scoring
is one projection of DataFrame functions, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

#: Common short notices of each family.
NOTICES: Mapping[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the Apache License",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Released under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl": (
        "made available under the terms of the Eclipse Public License",
        "Licensed under the Eclipse Public License",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "lizenziert unter CC BY 4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "lizenziert unter CC BY-SA 4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "lizenziert unter CC BY-NC 4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0",
    ),
    "proprietary": (
        "All rights reserved",
        "Copyright, all rights reserved, unauthorized copying of this file is strictly prohibited",
    ),
}

#: Notices of licences that are no family here.
OTHERS = (
    "Distributed under the Boost Software License, Version 1.0",
    "Licensed under the European Union Public License",
    "This package is licensed under the Artistic License 2.0",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: BSL-1.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "Licensed under the Open Data Commons Open Database License",
    "Licensed under the Microsoft Public License",
    "Released under the Academic Free License version 3.0",
    "made available under the Community Data License Agreement",
)

#: Words too common to be anchors, where a notice has others.
COMMON = (
    "a", "all", "and", "and-or", "any", "are", "available", "by", "charge", "copy", "except", "extent", "fee", "file", "for", "form",
    "forms", "free", "general", "has", "in", "international", "into", "is", "it", "law", "made", "may", "modify", "not",
    "obtaining", "of", "or", "person", "possible", "public", "purpose", "rights", "source", "subject", "terms", "the", "this",
    "to", "under", "unter", "use", "version", "with", "without", "work", "you", "code", "author",
)

#: Ordinary lines with anchor words, for the class unknown.
ORDINARY = (
    "the driver lost his license after the accident",
    "she asked for permission to leave the room early",
    "all tables are reserved for tonight",
    "the software was slow and the domain name had expired",
    "a fishing license is needed on this lake",
    "smoking is not permitted in the building",
    "the government plans a redistribution of land",
    "copying the answers is cheating",
    "the house of commons met on monday",
    "a gnu crossed the road while the apache helicopter landed",
    "the public license office is open from nine to five",
    "he wrote about copyright in general",
    "rights and duties of all members",
)

SPAN = 4  # lines of a wrapped notice
REACH = 40  # words; twice those of the longest notice
WORD = r"[a-z0-9][a-z0-9+-]*"
MOST, MOST_PAIRS = 0.75, 0.5  # of a notice's words and pairs of adjacent words, in a paragraph that confirms it


def words_of(line: str) -> list[str]:
    return re.findall(WORD, line.lower().replace("licence", "license"))


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _anchors() -> tuple[str, ...]:
    """Of each notice one word more than a paragraph may lack: first the words that are not common, then the longer ones."""
    out: set[str] = set()
    for notice in [n for family in NOTICES.values() for n in family]:
        words = set(words_of(notice))
        lacking = len(words) - math.ceil(MOST * len(words))
        ranked = sorted(words, key=lambda w: (w in COMMON or w.isdigit(), w not in out, -len(w), w))
        out.update(ranked[: lacking + 1])
    return tuple(sorted(out))


ANCHORS = _anchors()


def features_of(words: list[str]) -> set[str]:
    """Words and pairs of adjacent words that hold an anchor."""
    return {w for w in words if w in ANCHORS} | {p for p in pairs_of(words) if not set(p.split()).isdisjoint(ANCHORS)}


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]  # unknown is the first
    bias: tuple[float, ...]
    weights: Mapping[str, tuple[float, ...]]

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[f]) for f in features_of(words) if f in self.weights), 0.0)
        e = np.exp(z - z.max())
        return e / e.sum()


def _variants(line: str, filler: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """The words of ``line`` whole, then with words dropped, cut off or added around them."""
    words = words_of(line)
    out = [words]
    while len(out) < n:
        kept = [w for w in words if rng.random() > 0.1] if len(words) > 4 else list(words)
        if rng.random() < 0.2 and len(kept) > 6:
            kept = kept[: max(4, int(len(kept) * rng.uniform(0.6, 1)))]
        around = rng.choice(filler, int(rng.integers(0, 6))).tolist()
        cut = int(rng.integers(0, len(around) + 1))
        out.append(around[:cut] + kept + around[cut:])
    return out


@lru_cache(1)
def train(variants: int = 40, rounds: int = 400, l2: float = 2e-3, seed: int = 3) -> LicenseModel:
    """The model, the same in every run."""
    rng = np.random.default_rng(seed)
    classes = (UNKNOWN, *NOTICES)
    filler = [f"{a}{b}" for a in ("to", "ren", "sal", "mi", "dor") for b in ("ka", "len", "tis", "un", "be")]
    rows: list[tuple[list[str], int]] = []
    for k, name in enumerate(classes[1:], 1):
        rows += [(v, k) for line in NOTICES[name] for v in _variants(line, filler, rng, variants)]
    rows += [(v, 0) for line in (*ORDINARY, *OTHERS) for v in _variants(line, filler, rng, variants)]
    for anchor in ANCHORS:  # an anchor alone among other words says little
        rows += [(rng.choice(filler, 4).tolist() + [anchor] + rng.choice(filler, 4).tolist(), 0) for _ in range(variants // 4)]
    rows += [(rng.choice(filler, 8).tolist(), 0) for _ in range(20 * variants)]
    known = sorted({f for words, _ in rows for f in features_of(words) if not set(f.split()) & set(filler)})
    at = {f: k for k, f in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1))
    x[:, -1] = 1
    for r, (words, _) in enumerate(rows):
        x[r, [at[f] for f in features_of(words) if f in at]] = 1
    y = np.eye(len(classes))[[k for _, k in rows]]
    apart = rng.random(len(rows)) < 0.2
    w, speed = np.zeros((len(known) + 1, len(classes))), np.zeros((len(known) + 1, len(classes)))
    fit_x, fit_y = x[~apart], y[~apart]
    for _ in range(rounds):  # gradient descent with momentum
        z = fit_x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 2.0 * (fit_x.T @ (p - fit_y) / len(fit_x) + l2 * w)
        w += speed
    z = x[apart] @ w
    best = min(np.linspace(0.3, 3, 28), key=lambda t: -_likelihood(z * t, y[apart]))
    w *= best
    weights = {f: tuple(np.round(w[k], 6).tolist()) for f, k in at.items() if np.abs(w[k]).max() > 0.02}
    return LicenseModel(classes, tuple(np.round(w[-1], 6).tolist()), weights)


def _likelihood(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float(((z - np.log(np.exp(z).sum(1, keepdims=True))) * y).sum())


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(line), F.lit("licence"), F.lit("license")), F.lit(f"({WORD})"))


def _enough(notice: Column, words: Column) -> Column:
    return F.size(F.array_intersect(notice, words)) >= MOST * F.size(notice)


def _pairs(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))


def _in_order(pairs: Column, words: Column) -> Column:
    """Whether most pairs of a notice are in a paragraph."""
    return F.size(F.array_intersect(pairs, _pairs(words))) >= MOST_PAIRS * F.size(pairs)


def _notice(notice: str) -> Column:
    """struct(words, pairs) of a notice, each once."""
    words = words_of(notice)
    array = lambda x: F.array(*map(F.lit, sorted(set(x)))).cast("array<string>")
    return F.struct(array(words).alias("words"), array(pairs_of(words)).alias("pairs"))


def _classes(words: Column, model: LicenseModel, least: float) -> Column:
    """struct(family, probability, confirmed) of a paragraph; family is unknown below ``least``."""
    anchors = F.array(*map(F.lit, ANCHORS))
    table = F.create_map(*[c for f in sorted(model.weights) for c in (F.lit(f), _doubles(model.weights[f]))])
    notices = F.create_map(
        *[
            c
            for name in model.classes[1:]
            for c in (F.lit(name), F.array(*[_notice(n) for n in NOTICES[name]]))
        ]
    )
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def classified(w: Column) -> Column:
        has = lambda g: F.array_contains(anchors, g)
        one = F.filter(w, has)
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(has(a) | has(b), F.concat_ws(" ", a, b)))
        grams = F.array_distinct(F.concat(one, F.array_compact(pairs)))
        z = F.aggregate(grams, _doubles(model.bias), lambda s, g: F.coalesce(plus(s, F.try_element_at(table, g)), s))
        return F.transform(F.array(z), lambda s: probable(s, w))[0]

    def probable(z: Column, w: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        p = F.lit(1.0) / total
        name = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position(z, top).cast("int"))
        family = F.when(p >= least, name).otherwise(F.lit(UNKNOWN))
        holds = lambda n: _enough(n["words"], w) & _in_order(n["pairs"], w)
        sure = F.coalesce(F.exists(F.try_element_at(notices, family), holds), F.lit(False))
        return F.struct(family.alias("family"), p.alias("probability"), sure.alias("confirmed"))

    return F.transform(F.array(words), classified)[0]


def _wrapped(every: Column, lines: Column, model: LicenseModel, least: float) -> Column:
    """Confirmed notices over two lines or more: line, last, family, probability.

    ``every`` has the words of all lines, ``lines`` those with an anchor.
    """
    notices = F.array(
        *[F.array(*map(F.lit, sorted(set(words_of(n))))) for name in model.classes[1:] for n in NOTICES[name]]
    )

    def cut(first: Column, n: Column) -> Column:
        """The words of ``n`` lines, of the outer ones those next to the others."""
        inner = F.slice(every, first + 2, F.greatest(n - 2, F.lit(0)))
        head, tail = F.element_at(every, first + 1), F.element_at(every, first + n)
        head = F.slice(head, F.greatest(F.size(head) - (REACH - 1), F.lit(1)), F.lit(REACH))
        whole = F.concat(head, F.flatten(inner), F.slice(tail, F.lit(1), F.lit(REACH)))
        blank = F.exists(F.slice(every, first + 1, n), lambda w: F.size(w) == 0)
        long = F.exists(inner, lambda w: F.size(w) > REACH)
        return F.when(blank | long, F.array().cast("array<string>")).otherwise(whole)

    # what all lines around do not hold, no window of them does
    around = lambda x: F.flatten(
        F.slice(every, F.greatest(x["line"] - (SPAN - 2), F.lit(1)), F.lit(2 * SPAN - 1))
    )
    near = F.filter(lines, lambda x: F.exists(notices, lambda n: _enough(n, around(x))))
    offsets = F.array(*[F.struct(F.lit(b).alias("back"), F.lit(n).alias("n")) for n in range(2, SPAN + 1) for b in range(n)])
    windows = F.transform(
        near, lambda x: F.transform(offsets, lambda o: F.struct((x["line"] - o["back"]).alias("line"), o["n"].alias("n")))
    )
    windows = F.filter(
        F.array_distinct(F.flatten(windows)), lambda x: (x["line"] >= 0) & (x["line"] + x["n"] <= F.size(every))
    )
    worded = F.transform(windows, lambda x: F.struct(x["line"], x["n"], cut(x["line"], x["n"]).alias("words")))
    worded = F.filter(worded, lambda x: F.exists(notices, lambda n: _enough(n, x["words"])))
    found = F.transform(
        worded,
        lambda x: F.struct(x["line"].alias("line"), (x["line"] + x["n"] - 1).alias("last"), _classes(x["words"], model, least).alias("c")),
    )
    found = F.filter(found, lambda x: (x["c"]["family"] != UNKNOWN) & x["c"]["confirmed"])
    return F.transform(found, lambda x: F.struct(x["line"], x["last"], x["c"]["family"].alias("family"), x["c"]["probability"].alias("probability")))


def licenses(
    docs: DataFrame, model: LicenseModel | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_notices, families, probability, n_confirmed, notices.

    ``notices`` has line (the first, from 0), family, probability and confirmed for
    each line that the model gives to a family, and for each confirmed notice that
    is wrapped over lines; ``families`` the confirmed ones, sorted and
    joined by commas; ``probability`` is the largest of a confirmed notice, else 0.
    Null, empty and other texts without a notice have empty lists.  Null ids stay
    null, repeated rows are scanned each, an empty table gives an empty result, and
    other columns are ignored.
    """
    model = model or train()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # an anchor as a word of its own: not inside a longer one
    anchor = r"(?<![a-z0-9+-])(" + "|".join(sorted(map(re.escape, ANCHORS), key=len, reverse=True)) + r")(?![a-z0-9+-])"
    lines = F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("line"), x.alias("text")))
    lines = F.filter(lines, lambda x: F.replace(F.lower(x["text"]), F.lit("licence"), F.lit("license")).rlike(anchor))
    plain = F.replace(F.lower(text), F.lit("licence"), F.lit("license"))
    has = plain.rlike("|".join(sorted(map(re.escape, ANCHORS))))
    no_lines = F.array().cast("array<struct<line:int,text:string>>")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("__text"), F.when(has, lines).otherwise(no_lines).alias("__lines")
    )
    some = F.size("__lines") > 0
    found = F.transform(
        "__lines", lambda x: F.struct(x["line"].alias("line"), _classes(_words(x["text"]), model, least).alias("c"))
    )
    found = F.filter(found, lambda x: x["c"]["family"] != UNKNOWN)
    kind = "array<struct<line:int,family:string,probability:double,confirmed:boolean>>"
    wide = "array<struct<line:int,last:int,family:string,probability:double>>"
    flat = F.transform(
        found,
        lambda x: F.struct(x["line"], x["c"]["family"], x["c"]["probability"], x["c"]["confirmed"]),
    ).cast(kind)
    every = F.transform(F.split("__text", "\n"), _words)
    # bound once, not once for each use
    more = F.flatten(F.transform(F.array(every), lambda w: _wrapped(w, F.col("__lines"), model, least)))
    rows = rows.select(
        "doc_id",
        F.when(some, flat).otherwise(F.array().cast(kind)).alias("__single"),
        F.when(some, more.cast(wide)).otherwise(F.array().cast(wide)).alias("__more"),
    )

    def shorter(x: Column) -> Column:
        inside = lambda y: (y["line"] >= x["line"]) & (y["family"] == x["family"])
        one = F.exists("__single", lambda y: y["confirmed"] & inside(y) & (y["line"] <= x["last"]))
        less = lambda y: inside(y) & (y["last"] <= x["last"]) & (y["last"] - y["line"] < x["last"] - x["line"])
        return one | F.exists("__more", less)

    def first(held: Column, x: Column) -> Column:
        """``held``, and ``x`` if it shares no line with those of its family."""
        meets = F.exists(held, lambda y: (y["family"] == x["family"]) & (y["last"] >= x["line"]))
        return F.when(meets, held).otherwise(F.concat(held, F.array(x)))

    spans = F.array_sort(F.filter("__more", lambda x: ~shorter(x)))
    spans = F.aggregate(spans, F.array().cast(wide), first)
    wrapped = F.transform(
        spans, lambda x: F.struct(x["line"], x["family"], x["probability"], F.lit(True))
    ).cast(kind)
    rows = rows.select("doc_id", F.array_sort(F.concat("__single", wrapped)).alias("notices"))
    sure = F.filter("notices", lambda x: x["confirmed"])
    return rows.select(
        "doc_id",
        F.size("notices").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
        F.size(sure).alias("n_confirmed"),
        "notices",
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    found = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_notices", "families", F.round("probability", 6).alias("probability"), "n_confirmed")
