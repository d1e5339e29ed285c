"""Licence scans: a trained paragraph classifier with template confirmation.

Paragraphs end at blank lines.  Their passages are the lines (of long ones, overlapping
windows) and the words around each line break, so a notice may be wrapped.  A
multinomial logistic regression with L1 penalty over the words and word pairs of the
templates names a passage's licence family or none.  It learns from the notice sentences
of `TEMPLATES` (each also with any one word left out) and, as the unknown class, from
half of all passages of the corpus; equal passages are one row with their number, and
together they weigh `UNKNOWN_WEIGHT` template rows at any size of the corpus.  The
unknown class is calibrated on the other half: a family must reach the probability that
at most `FALSE_RATE` of its passages exceed, and at least 0.5.  A named passage is confirmed by comparison with the family's templates: at
least `CONFIRM` of a template's words and word pairs must occur in it, a pair among them;
else its family is `unknown`.  A reservation of all rights is a family that grants nothing.

Most passages need no scoring.  The weights give a set of cue words such that all other
words and pairs together can't lift any family to its limit (`cues`), so a passage
without a cue can't be named; only paragraphs and passages with a cue are scored.
Words and pairs that are in no template neither weigh nor confirm anything, so passages
keep those of the templates alone.

Only DataFrame, SQL and Spark ML functions are used.

Edge cases: null and empty texts have no paragraphs and no licence; repeated
paragraphs count each; rows are told apart by id and text, so only equal rows share
findings, with or without an id; an empty table gives no rows (the model then learns
from the templates and one made-up background line); other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hookline.llm import common as C

#: Notice sentences of public licences, by family (fixed values).
TEMPLATES = {
    "MIT": [
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License);",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance",
        "This project is released under the Apache 2.0 license.",
    ],
    "GPL": [
        "GNU General Public License, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU General Public License version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License",
        "Released under the GNU General Public License, version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "This work is licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "All-Rights-Reserved": [
        "Copyright. All rights reserved.",
        "All rights are reserved by the copyright holder.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means "
        "without the prior written permission of the publisher",
        "This software is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    ],
}
FAMILIES = list(TEMPLATES)
#: The family that reserves rights and is no licence.
RESERVED = "All-Rights-Reserved"

#: Weight of all passages that teach the unknown class, in rows of the templates.
UNKNOWN_WEIGHT = 3_000.0
FALSE_RATE = 0.001
#: Probabilities are counted in steps of one over this to find the limit.
LIMIT_STEPS = 1_000_000
CONFIRM = 0.6
#: Words on each side of a line break, and half the words of a window of a long line (no template is longer).
REACH = 32
#: Word that stands for a line break: a digit beside a mathematical one, which texts don't join.
_BREAK = "0\U0001D7D8"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), "")


def grams(w: Column) -> Column:
    """Distinct words and word pairs of a word array."""
    n = F.size(w)
    pairs = F.when(
        n >= 2, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, pairs))


def passages(docs: DataFrame, cue_words: list[str] | None = None) -> DataFrame:
    """key, paragraph, line (0-based within the paragraph), seam (the words around the
    break before this line), grams of the passages (with a cue word, if some are given)
    that are grams of a template."""
    known = _counter(docs.sparkSession).vocabulary
    single, double = ([g for g in known if (" " in g) == pair] for pair in (False, True))
    with_cue = lambda w: F.lit(True) if cue_words is None else F.arrays_overlap(w, F.lit(cue_words))
    found = docs.select("key", F.posexplode(F.split("text", "\n\\s*\n")).alias("paragraph", "part"))
    # Words with a mark at every line break; the marks' places give the words before each break.
    marked = words(F.regexp_replace("part", "\n", f" {_BREAK} "))
    mark = F.lit(_BREAK)
    found = found.select("key", "paragraph", marked.alias("marked"))
    if cue_words is not None:  # emptied, for a filter would split the text twice
        found = found.withColumn("marked", F.when(with_cue(F.col("marked")), F.col("marked")).otherwise(F.array().cast("array<string>")))
    found = found.select(
        "key", "paragraph", F.array_remove("marked", mark).alias("words"),
        F.filter(F.transform("marked", lambda w, i: F.when(w == mark, i).otherwise(-1)), lambda i: i >= 0).alias("marks"),
    )
    ends = F.transform("marks", lambda m, j: m - j)
    found = found.select(
        "key", "paragraph", F.transform("words", lambda w: F.when(w.isin(single), w)).alias("words"),
        F.concat(F.array(F.lit(0)), ends, F.array(F.size("words"))).alias("ends"))
    # The pair that begins at each word; null, as the words are, where no template has it.
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    found = found.select("key", "paragraph", "ends", "words", F.transform(pairs, lambda p: F.when(p.isin(double), p)).alias("pairs"))
    at = lambda i: F.element_at("ends", i)
    unit = lambda line, seam, begin, n: F.struct(
        line.alias("line"), F.lit(seam).alias("seam"), begin.alias("begin"), n.alias("n"))
    # Windows of a line: each begins REACH words after the last one and has twice as many.
    lines = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda k: F.transform(
        F.sequence(at(k), F.greatest(at(k), at(k + 1) - REACH - 1), F.lit(REACH)),
        lambda b: unit(k - 1, False, b, F.least(F.lit(2 * REACH), at(k + 1) - b)),
    )))
    # Breaks between words: the last break of several at one place.
    seams = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("ends") - 1)), lambda k: F.when(
        (k < F.size("ends")) & (at(k) > 0) & (at(k) < F.try_element_at("ends", k + 1)),
        unit(k - 1, True, F.greatest(F.lit(0), at(k) - REACH), F.least(at(k), F.lit(REACH)) + REACH),
    )), lambda u: u.isNotNull())
    # Sliced before the explode, which would copy all words for each passage.
    taken = F.transform(F.filter(F.concat(lines, seams), lambda u: u["n"] > 0), lambda u: F.struct(
        u["line"].alias("line"), u["seam"].alias("seam"), F.array_distinct(F.array_compact(F.concat(
            F.slice("words", u["begin"] + 1, u["n"]), F.slice("pairs", u["begin"] + 1, u["n"] - 1)))).alias("grams")))
    units = found.select("key", "paragraph", F.explode(taken).alias("u")).where(with_cue(F.col("u.grams")))
    return units.select("key", "paragraph", "u.line", "u.seam", "u.grams")


def templates(spark: SparkSession) -> DataFrame:
    """label (1-based family), words, grams of each template."""
    rows = [(k + 1, t) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    found = spark.createDataFrame(rows, "label int, line string").select("label", words(F.col("line")).alias("words"))
    return found.withColumn("grams", grams(F.col("words")))


def _likeness(own: Column, template: Column) -> Column:
    """Share of a template's grams that occur among `own`; 0 without a word pair."""
    both = F.array_intersect(own, template)
    return F.when(F.exists(both, lambda g: g.contains(" ")), F.size(both) / F.size(template)).otherwise(0.0)


def _counter(spark: SparkSession) -> CountVectorizerModel:
    """Passages' grams as coordinates: the grams of the templates."""
    known = templates(spark).select(F.explode("grams").alias("gram")).distinct().collect()  # of fixed values
    vocabulary = sorted(r.gram for r in known)
    return CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)


def background(docs: DataFrame) -> DataFrame:
    """grams, teach, n: the passages of all `docs` (key, text) that are no licence notices
    themselves, equal ones of a half as one row with their number, and a made-up one."""
    spark = docs.sparkSession
    counted = passages(docs).groupBy(
        F.array_sort("grams").alias("grams"), (F.xxhash64("key", "paragraph", "line") % 2 == 0).alias("teach")
    ).agg(F.count(F.lit(1)).alias("n"))
    near = templates(spark).agg(F.collect_list("grams").alias("all"))
    plain = counted.join(F.broadcast(near), how="left").where(
        ~F.exists("all", lambda t: _likeness(F.col("grams"), t) >= 0.5)).drop("all")
    made_up = spark.createDataFrame([(["no"], True, 1)], "grams array<string>, teach boolean, n long")
    return plain.unionByName(made_up)


def train(docs: DataFrame):
    """(model, calibrated probability limit) from the templates and the passages of all
    `docs` (key, text)."""
    spark = docs.sparkSession
    known = templates(spark)
    without = known.select(
        "label",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.size("words")),
            lambda i: F.filter("words", lambda w, k: k != i),  # the last place leaves all words
        )).alias("words"),
    ).select("label", grams(F.col("words")).alias("grams"), F.lit(1.0).alias("weight"))
    plain = C.stage(background(docs), "background")
    n = plain.groupBy("teach").agg(F.sum("n").alias("n"))
    total = {r.teach: r.n for r in n.collect()}  # two rows
    taught = plain.where("teach").select(
        F.lit(0).alias("label"), "grams", (F.col("n") * F.lit(UNKNOWN_WEIGHT / total[True])).alias("weight"))
    counted = _counter(spark)
    regression = LogisticRegression(
        labelCol="label", family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=60, standardization=False,
        weightCol="weight",
    )
    rows = counted.transform(without.unionByName(taught)).select("label", "features", "weight")
    model = regression.fit(C.stage(rows, "notices"))
    held = model.transform(counted.transform(plain.where(~F.col("teach"))))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
    # Only probabilities above 0.5 matter, in at most `LIMIT_STEPS` / 2 steps.
    steps = held.select("n", best.alias("best")).where("best > 0.5").groupBy(F.floor(F.col("best") * LIMIT_STEPS).alias("step")).agg(
        F.sum("n").alias("n"), F.max("best").alias("best"))
    above = F.sum("n").over(Window.partitionBy().orderBy(F.desc("step")))
    row = steps.withColumn("above", above).where(F.col("above") > FALSE_RATE * total.get(False, 0)).agg(F.max("best")).first()
    return model, max(0.5, row[0] or 0.0)


def cues(weights: np.ndarray, intercepts: np.ndarray, vocabulary: list[str], limit: float) -> list[str] | None:
    """Words without which no passage reaches the limit for any family (None: there are none).

    A family of probability `limit` or more has odds of limit / (1 - limit) at least
    against class 0; grams that aren't in the vocabulary weigh nothing.  Cues are taken,
    the heaviest first, until the positive weights of all other grams fall short."""
    gain = np.maximum(weights[1:] - weights[0], 0.0)
    need = math.log(limit / (1 - limit)) - (intercepts[1:] - intercepts[0]) - 1e-6 if limit < 1 else np.full(len(gain), np.inf)
    if (need <= 0).any():
        return None
    of = [g.split(" ") for g in vocabulary]
    heavy: dict[str, float] = {}
    for own, g in zip(of, gain.max(axis=0)):
        for w in own:
            heavy[w] = max(heavy.get(w, 0.0), float(g))
    out: list[str] = []
    left = np.ones(len(of), bool)
    for w in sorted(heavy, key=lambda w: (-heavy[w], w)):
        if (gain[:, left].sum(axis=1) < need).all():
            break
        out.append(w)
        left &= np.array([w not in own for own in of])
    return out


def findings(docs: DataFrame, model, limit: float) -> DataFrame:
    """key, paragraph, line, seam, family (or `unknown`), probability, likeness of the
    passages of `docs` (key, text) that the classifier names."""
    spark = docs.sparkSession
    counted = _counter(spark)
    some = cues(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), counted.vocabulary, limit)
    scored = model.transform(counted.transform(passages(docs, some))).select(
        "key", "paragraph", "line", "seam", "grams", F.col("prediction").cast("int").alias("label"),
        F.array_max(vector_to_array("probability")).alias("probability"),
    )
    named = scored.where((F.col("label") > 0) & (F.col("probability") >= limit))
    known = templates(spark).groupBy("label").agg(F.collect_list("grams").alias("templates"))
    like = F.array_max(F.transform("templates", lambda t: _likeness(F.col("grams"), t)))
    confirmed = named.join(F.broadcast(known), "label").withColumn("likeness", like)
    names = F.array(*(F.lit(f) for f in FAMILIES))
    family = F.when(F.col("likeness") >= CONFIRM, F.element_at(names, F.col("label"))).otherwise("unknown")
    return confirmed.select("key", "paragraph", "line", "seam", family.alias("family"), "probability", "likeness")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, license (all families found, sorted and comma-joined; empty if none), grants
    (those of them that grant a licence: without the reservation of all rights), n_notices
    (confirmed lines, and confirmed line breaks beside no such line), n_unknown (named but
    not confirmed, likewise), probability (highest of the confirmed ones, else null)."""
    docs = docs.select("doc_id", "text", C.row_key().alias("key"))
    model, limit = train(docs.select("key", "text"))
    sure = F.col("family") != "unknown"
    names = F.col("family")
    found = findings(docs.select("key", "text"), model, limit).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(sure, names))), ",").alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure & (names != RESERVED), names))), ",").alias("grants"),
        F.collect_set(F.struct("family", "paragraph", "line", "seam")).alias("at"),
        F.max(F.when(sure, F.col("probability"))).alias("probability"),
    )
    beside = lambda a, b: (
        (a["family"] == b["family"]) & (a["paragraph"] == b["paragraph"])
        & ((b["line"] == a["line"] - 1) | (~b["seam"] & (b["line"] == a["line"])))
    )
    own = F.filter("at", lambda a: ~a["seam"] | ~F.exists("at", lambda b: beside(a, b)))
    found = found.withColumn("own", own).withColumns({
        "n_notices": F.size(F.filter("own", lambda a: a["family"] != "unknown")).cast("bigint"),
        "n_unknown": F.size(F.filter("own", lambda a: a["family"] == "unknown")).cast("bigint"),
    })
    zero = F.lit(0).cast("bigint")
    return docs.select("doc_id", "key").join(found, "key", "left").select(
        "doc_id", F.coalesce("license", F.lit("")).alias("license"),
        F.coalesce("grants", F.lit("")).alias("grants"), F.coalesce("n_notices", zero).alias("n_notices"),
        F.coalesce("n_unknown", zero).alias("n_unknown"), "probability",
    )
