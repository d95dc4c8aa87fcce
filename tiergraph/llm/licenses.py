"""Licence scans by a trained paragraph classifier, in DataFrame functions alone.

A paragraph is a line of a text, or a run of adjoining lines (a wrapped statement), as far as each of them has
a word triple in common with a template.  A multinomial logistic regression over its distinct words and word
pairs tells the licence family or "unknown".  It is fitted on the driver on SAMPLE paragraphs that are made
from the family templates below (whole, in part, and with other words around) and from prose of no licence.
Its probabilities are calibrated by a temperature, and a paragraph below the calibrated threshold is unknown.
A prediction counts only if a template of that family confirms it: at least CONFIRM of the word triples of
the shorter of the two are common to both.  So a line without any triple of a template cannot be confirmed,
and adds nothing to a run that can.

One scan of the texts stores such lines.  Scoring is joins: distinct paragraphs, known by a hash, are cut
into features, joined with the weights (a table of a size fixed by the templates) and summed.  Equal
paragraphs are scored once, whatever number of documents share them, and the verdicts return by a salted
join on the hash.  A run's families count once for the run.

Defined cases: null and empty texts have no paragraphs; repeated rows get the same result each; a null
doc_id is kept; an empty table gives an empty result; other columns play no part; paragraphs of any length
are read whole; a line of one or two words parts a run.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.llm.tables import named, staged

#: Statements by which the licence families are declared.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["Copyright, all rights reserved. No part of this work may be reproduced without written permission.", "All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]

#: The classifier's sample (its bound), its seed, and what confirms a family.
SAMPLE, SEED, STEPS, CONFIRM = 1600, 11, 150, 0.6

#: Words of which n_cues tells; confirmed paragraphs need none of them.  The pattern finds them in any case.
CUE = "(?i)licen[cs]|copyright|permission|redistribut|warrant|rights reserved|spdx|public domain|unauthorized copying"
WORDS = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SALTS = 16


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def grams(words: list[str]) -> set[str]:
    """Distinct words and pairs."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def triples(words: list[str]) -> set[str]:
    """Distinct triples; fewer words are one whole."""
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


@lru_cache(maxsize=1)
def classifier() -> tuple[dict[str, list[float]], list[float], float, float]:
    """Feature weights by family, biases, temperature, threshold."""
    rng = random.Random(SEED)
    parts = "the of and to er in on that re is for are with this work file terms version under part free use code rights driver state city new holder expired office".split()

    def filler(n: int) -> list[str]:
        return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) if rng.random() < 0.6 else rng.choice(parts) for _ in range(n)]

    loose = ["license", "licence", "licensed", "copyright", "permission", "permissions", "warranty", "public", "domain", "general"]
    rows: list[tuple[set[str], int]] = []
    for k in range(SAMPLE):
        label = k % (len(FAMILIES) + 4)
        if label < len(FAMILIES) - 1:
            own = words_of(rng.choice(TEMPLATES[FAMILIES[label]]))
            if rng.random() < 0.25 and len(own) > 12:
                cut = rng.randint(0, len(own) // 4)
                own = own[cut : len(own) - rng.randint(0, len(own) // 4)]
            own = filler(rng.choice([0, 0, 2, 5])) + own + filler(rng.choice([0, 0, 2, 6]))
        else:
            label = len(FAMILIES) - 1
            own = filler(rng.randint(3, 30))
            for _ in range(rng.choice([0, 1, 1, 2])):
                own.insert(rng.randint(0, len(own)), rng.choice(loose))
        rows.append((grams(own), label))
    train, check = rows[: 4 * SAMPLE // 5], rows[4 * SAMPLE // 5 :]
    declared = set().union(*(grams(words_of(t)) for own in TEMPLATES.values() for t in own))
    index = {f: i for i, f in enumerate(sorted(declared | set(loose)))}

    def matrix(of: list[tuple[set[str], int]]) -> np.ndarray:
        out = np.zeros((len(of), len(index)))
        for i, (own, _) in enumerate(of):
            out[i, [index[f] for f in own if f in index]] = 1
        return out

    x, y = matrix(train), np.eye(len(FAMILIES))[[r for _, r in train]]
    w, b = np.zeros((len(index), len(FAMILIES))), np.zeros(len(FAMILIES))
    mw, vw = np.zeros_like(w), np.zeros_like(w)

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for n in range(1, STEPS + 1):
        error = y - softmax(x @ w + b)
        g = x.T @ error / len(x) - 1e-3 * w
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        w += 0.1 * (mw / (1 - 0.9**n)) / (np.sqrt(vw / (1 - 0.99**n)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - 1e-4, 0)  # keeps the weights sparse
        b += 0.5 * error.mean(0)
    z, truth = matrix(check) @ w + b, np.array([r for _, r in check])
    losses = {t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    heat = min(losses, key=losses.get)
    p = softmax(z / heat)[:, :-1].max(1)
    none = p[truth == len(FAMILIES) - 1]
    threshold = max(0.5, float(np.quantile(none, 0.995)) if len(none) else 0.5)
    return {f: [round(float(v), 6) for v in w[i]] for f, i in index.items()}, [round(float(v), 6) for v in b], float(heat), min(threshold, 0.95)


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def classify(paragraphs: DataFrame) -> DataFrame:
    """Verdicts for distinct paragraphs (columns key and para): key, family, probability."""
    spark = paragraphs.sparkSession
    weights, bias, heat, threshold = classifier()
    wide = _inline(spark, [{"g": f, "w": v} for f, v in weights.items() if any(v)], "g string, w array<double>")
    cut = paragraphs.select("key", F.regexp_extract_all(F.lower("para"), F.lit(WORDS), F.lit(0)).alias("ws"))
    pairs = F.expr("CASE WHEN size(ws) > 1 THEN zip_with(slice(ws, 1, size(ws) - 1), slice(ws, 2, size(ws) - 1), (a, b) -> concat(a, ' ', b)) ELSE array() END")
    features = cut.select("key", F.explode(F.array_distinct(F.concat("ws", pairs))).alias("g"))
    sums = features.join(F.broadcast(wide), "g").groupBy("key").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(FAMILIES))])
    z = F.array(*[(F.col(f"z{i}") + F.lit(bias[i])) / F.lit(heat) for i in range(len(FAMILIES))])
    shifted = sums.select("key", z.alias("z")).withColumn("e", F.expr("transform(z, x -> exp(x - array_max(z)))"))
    total = F.expr("aggregate(e, 0D, (a, x) -> a + x)")
    known = len(FAMILIES) - 1
    best = shifted.select("key", (F.expr(f"array_max(slice(e, 1, {known}))") / total).alias("probability"), F.expr(f"array_position(e, array_max(slice(e, 1, {known})))").alias("at"), F.expr("array_position(e, array_max(e))").alias("top"))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    guessed = best.where((F.col("top") <= known) & (F.col("probability") >= threshold)).select("key", F.element_at(names, F.col("at").cast("int")).alias("family"), "probability")

    rows = [{"family": f, "nth": i, "size": len(triples(words_of(t))), "t": g} for f, own in TEMPLATES.items() for i, t in enumerate(own) for g in sorted(triples(words_of(t)))]
    templates = _inline(spark, rows, "family string, nth int, size int, t string")
    triple = F.expr("CASE WHEN size(ws) = 0 THEN array() ELSE array_distinct(transform(sequence(1, greatest(1, size(ws) - 2)), i -> array_join(slice(ws, i, 3), ' '))) END")
    own = cut.select("key", triple.alias("ts"))
    shared = own.select("key", F.size("ts").alias("own"), F.explode("ts").alias("t")).join(F.broadcast(templates), "t").groupBy("key", "family", "nth", "size", "own").agg(F.count("*").alias("common"))
    backed = shared.where(F.col("common") >= CONFIRM * F.least("size", "own")).select("key", "family").distinct()
    return guessed.join(backed, ["key", "family"])


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_cues (lines with a cue word), n_licenses (families confirmed, by run), families, probability (least)."""
    own = docs.select(F.col(named(doc_id)).alias("doc_id"), F.col(named(text)).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    known = sorted(set().union(*(triples(words_of(t)) for ts in TEMPLATES.values() for t in ts)))
    # The words are a lambda's variable, so that they are cut once, also where the filter is pushed down.
    words = F.array(F.regexp_extract_all(F.lower("para"), F.lit(WORDS), F.lit(0)))
    near = F.exists(words, lambda ws: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - 2)), lambda i: F.array_join(F.slice(ws, i, F.lit(3)), " ").isin(known)))
    split = own.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("place", "para"))
    lines = staged(split.withColumns({"cue": F.col("para").rlike(CUE), "near": near}).where("cue OR near").distinct(), "lines")

    placed = Window.partitionBy("doc_id", "th").orderBy("place")
    runs = lines.where("near").withColumn("run", F.col("place") - F.row_number().over(placed))
    ordered = F.array_sort(F.collect_list(F.struct("place", "para")))
    joined = runs.groupBy("doc_id", "th", "run").agg(F.array_join(F.transform(ordered, lambda x: x["para"]), " ").alias("para"), F.count("*").alias("n")).where("n > 1")
    units = runs.select("doc_id", "th", "run", "para").union(joined.select("doc_id", "th", "run", "para")).withColumn("key", F.sha2("para", 256)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th", "run"), F.lit(SALTS)))
    verdicts = classify(units.select("key", "para").distinct()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    told = units.select("doc_id", "th", "run", "key", "salt").join(verdicts, ["key", "salt"])
    rows = told.select("doc_id", "th", F.lit(0).alias("cue"), F.struct("run", "family").alias("found"), "family", "probability")
    cues = lines.where("cue").select("doc_id", "th", F.lit(1).alias("cue"), F.lit(None).cast(rows.schema["found"].dataType).alias("found"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("probability"))
    per = rows.union(cues).groupBy("doc_id", "th").agg(F.sum("cue").alias("n_cues"), F.count_distinct("found").alias("n_licenses"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.min("probability").alias("probability"))
    per = per.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "n_cues", "n_licenses", "families", "probability")
    out = own.select("doc_id", "th").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_cues", zero).alias("n_cues"), F.coalesce("n_licenses", zero).alias("n_licenses"), F.coalesce("families", F.lit("")).alias("families"), "probability")
