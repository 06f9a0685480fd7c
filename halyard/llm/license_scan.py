"""Licence families of paragraphs, in Spark operations only.

A multinomial logistic regression over sparse word one- and two-grams tells
licence families and an unknown class apart. It is fitted on the notices below,
whole and in parts, against a bounded sample of the corpus's own paragraphs
and some sentences that only speak of licences; a temperature fitted on held-out
rows calibrates its probabilities, and a paragraph below ``sure`` is unknown.
A prediction is confirmed by comparison with the family's templates: the share
of a template's words that the paragraph holds.

Every line is a paragraph, and so is every block of several lines between blank
ones, which counts from its first line and is reported where none of its lines
has the family itself. All with a gram that the model knows are classified; no others can have a family.
The corpus's sample leaves out paragraphs that resemble a template.

Words that more than one in fifty of the sample's paragraphs have are no features, unless
they name a family, nor are pairs of two such words; they only count in the comparison with templates. So a text
without a word that the model knows has no paragraph to classify, and is let go before its lines are cut.

Defined cases: null and empty texts have no paragraphs of interest; repeated
rows and lines are reported one by one; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Short public notices by family.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Distributed under the terms of the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2 or later", "SPDX-License-Identifier: GPL-3.0-only"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0", "Creative Commons Attribution-NonCommercial license applies to this work", "Text available under CC0 1.0 Universal public domain dedication"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
#: Sentences with the same words that give no licence.
SPEAKING_OF = ["He lost his driving licence last year.", "Permission was denied by the office.", "The copyright office is closed on public holidays.", "A licence to fish costs ten dollars.", "All rights reserved.", "Copyright 2020 the authors.", "You need permission to redistribute this work.", "The software comes without warranty of any kind.", "License plate number and registration", "Please read the license before use", "the city was released from the general public version", "Mozilla and Apache are names of software foundations", "The GNU project began long ago", "MIT is a university", "public version of the work under the international terms"]
UNKNOWN = "unknown"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct one- and two-grams."""
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(words, pairs))


def py_grams(text: str) -> list[str]:
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))


def fit(negatives: list[str], epochs: int = 300, ridge: float = 2e-3) -> tuple[dict[str, list[float]], list[float], float, list[str]]:
    """(weights of each gram by class, intercepts, temperature, classes)."""
    classes = [UNKNOWN, *NOTICES]
    rows: list[tuple[list[str], int]] = []
    for k, name in enumerate(classes[1:], 1):
        for notice in NOTICES[name]:
            g = py_grams(notice)
            rows += [(g, k)] * 4 + [(py_grams(notice + " " + SPEAKING_OF[len(rows) % len(SPEAKING_OF)]), k)]
    rows += [(py_grams(x), 0) for x in [*SPEAKING_OF * 3, *negatives] if x]
    common = common_words(negatives)
    vocabulary = {g: i for i, g in enumerate(sorted({g for r, k in rows if k for g in r if not common.issuperset(g.split())}))}
    x, y = np.zeros((len(rows), len(vocabulary))), np.array([k for _, k in rows])
    for i, (r, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in r if g in vocabulary]] = 1
    hold = np.arange(len(rows)) % 5 == 4

    def descend(x, y):
        w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
        one = np.eye(len(classes))[y]
        weigh = (1 / np.maximum(np.bincount(y, minlength=len(classes)), 1))[y]
        weigh = weigh / weigh.sum() * len(y)
        for _ in range(epochs):
            p = softmax(x @ w + b)
            g = (p - one) * weigh[:, None] / len(y)
            w -= 2.0 * (x.T @ g + ridge * w)
            b -= 2.0 * g.sum(axis=0)
        return w, b

    w, b = descend(x[~hold], y[~hold])
    logits = x[hold] @ w + b
    temperature = min((t / 10 for t in range(2, 31)), key=lambda t: -np.log(softmax(logits / t)[np.arange(hold.sum()), y[hold]] + 1e-9).sum())
    w, b = descend(x, y)
    return {g: w[i].tolist() for g, i in vocabulary.items()}, b.tolist(), temperature, classes


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _template(notice: str) -> list[str]:
    return sorted({w for w in re.split("[^a-z0-9]+", notice.lower()) if w and not w.isdigit()})


def common_words(negatives: list[str], share: float = 0.02) -> set[str]:
    """Words that more than this share of the paragraphs have, and three at least, but for the families' names."""
    counts = Counter(g for x in negatives for g in py_grams(x) if " " not in g)
    return {w for w, n in counts.items() if n > max(share * len(negatives), 2)} - set(NOTICES)


def paragraphs(docs: DataFrame, *columns) -> DataFrame:
    """(columns, paragraph, last, line): each line, and each block of several lines; paragraph and last are its first and last line."""
    full = lambda x: F.coalesce(x.rlike(r"\S"), F.lit(False))
    lines = F.col("_lines")
    edge = lambda step: F.filter(F.transform(lines, lambda x, i: F.when(full(x) & ~full(F.get(lines, i + step)), i)), lambda i: i.isNotNull())
    ends = edge(1)
    piece = lambda a, b, x: F.struct(a.alias("paragraph"), b.alias("last"), x.alias("line"))
    blocks = F.transform(F.arrays_zip(edge(-1).alias("a"), ends.alias("b")), lambda z: piece(z.a, z.b, F.array_join(F.slice(lines, z.a + 1, z.b - z.a + 1), "\n")))
    pieces = F.concat(F.transform(lines, lambda x, i: piece(i, i, x)), F.filter(blocks, lambda z: z["last"] > z.paragraph))
    return docs.select(*columns, F.split("text", "\n").alias("_lines")).select("*", F.inline(pieces)).drop("_lines").where(full(F.col("line")))


def sample_paragraphs(docs: DataFrame, n_docs: int, n: int, same: float = 0.6) -> list[str]:
    """At most ``n`` paragraphs of at most ``n_docs`` documents, those with the lowest hashes of their ids, without those that resemble a template."""
    ids = docs.select(F.col("doc_id").alias("_id")).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(n_docs).distinct()
    lines = paragraphs(docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"], "left_semi"), "doc_id")
    lines = lines.select("doc_id", "paragraph", "last", F.substring("line", 1, 2000).alias("line"))
    templates = [set(_template(x)) for v in NOTICES.values() for x in v]
    found = [r.line for r in lines.orderBy("doc_id", "paragraph", "last", "line").limit(n).collect()]
    return [x for x in found if not any(len(t.intersection(_template(x))) >= same * len(t) for t in templates)]


def scan_licenses(docs: DataFrame, sure: float = 0.5, same: float = 0.6, n_docs: int = 64, n_negatives: int = 400) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of each paragraph with a licence; paragraphs count from 0."""
    spark = docs.sparkSession
    weights, bias, temperature, classes = fit(sample_paragraphs(docs, n_docs, n_negatives, same))
    known = F.array(*(F.lit(g) for g in weights if " " not in g))
    templates = [(k, _template(x)) for k, v in NOTICES.items() for x in v]
    uncounted = {w for _, t in templates for w in t} - set(weights)
    # both tables are as large as the notices above, whatever the corpus
    table = spark.createDataFrame([*weights.items(), *((w, [0.0] * len(classes)) for w in sorted(uncounted))], "gram string, w array<double>")
    notices = spark.createDataFrame(templates, "family string, template array<string>")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), known))
    lines = paragraphs(rows, "doc_id", "row").select("doc_id", "row", "paragraph", "last", _words(F.col("line")).alias("words"))
    lines = lines.where(F.arrays_overlap("words", known))
    found = lines.select("doc_id", "row", "paragraph", "last", F.explode(grams(F.col("words"))).alias("gram")).join(F.broadcast(table), "gram")
    # the words of a template are all among the known grams
    sums = found.groupBy("row", "paragraph", "last").agg(F.first("doc_id").alias("doc_id"), F.collect_list("gram").alias("words"), *(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(classes))))
    z = F.array(*((F.col(f"z{i}") + bias[i]) / temperature for i in range(len(classes))))
    kept = ["doc_id", "row", "paragraph", "last", "words"]
    logits = sums.select(*kept, z.alias("z")).withColumn("top", F.array_max("z"))
    family = F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", F.col("top")).cast("int"))
    p = 1 / F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    named = logits.select(*kept, family.alias("family"), p.alias("p")).where((F.col("family") != UNKNOWN) & (F.col("p") >= sure))
    after = W.partitionBy("row", "family").orderBy("paragraph").rangeBetween(0, W.unboundedFollowing)
    own = F.min(F.when(F.col("paragraph") == F.col("last"), F.col("paragraph"))).over(after)
    named = named.withColumn("own", own).where("paragraph = last or own is null or own > last")
    with_words = named.join(F.broadcast(notices.groupBy("family").agg(F.collect_list("template").alias("templates"))), "family")
    similarity = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("words"))) / F.size(t)))
    out = with_words.withColumn("similarity", similarity)
    return out.select("doc_id", "paragraph", "family", F.col("p").alias("probability"), "similarity", (F.col("similarity") >= same).alias("confirmed"))
