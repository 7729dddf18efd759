"""Licence scans by a trained paragraph classifier, with DataFrame and ML functions only.

A paragraph is a line. A multinomial logistic regression over word 1- to 3-grams of the licence notices below scores it;
its training set is the notices, their usual lead-ins with every name, near misses and every paragraph of the documents
that holds no licence cue as class ``unknown``. Paragraphs of one set of n-grams are one row with a weight; n-grams
are made of marks (the notices' words in place, a bar for each run of others) of distinct paragraphs. The chance that a notice needs is set on a held-out part, so that at most 1 in 100 paragraphs without
a licence that share n-grams with notices reaches it. A prediction counts as confirmed if the paragraph's n-grams also
agree with a notice of the family.

The trained weights say which paragraphs need no score: ``gate`` chooses words such that all n-grams without any of them
together can't lift a family to the chance needed. A paragraph without a word of the gate is of class unknown.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propagon.llm.common import saved

#: Names under which licence families go, and sentences of their notices.
NAMES = {
    "mit": ["MIT License", "MIT licence", "Expat License"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2 License"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPLv2", "GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL v3", "LGPL-2.1"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL v3", "AGPL-3.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "cc0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero"],
    "isc": ["ISC License", "ISC licence"],
    "unlicense": ["Unlicense", "public domain"],
    "proprietary": ["proprietary license"],
}
SENTENCES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "apache-2.0": ["you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher", "Unauthorized copying of this file is strictly prohibited", "This software is proprietary and confidential"],
}
LEADS = ["", "Licensed under the", "Licensed under", "Released under the", "This work is licensed under the", "This work is licensed under a", "This project is licensed under the terms of the", "Distributed under the", "Available under the", "SPDX-License-Identifier:", "Code is covered by the", "published under the"]
NEAR_MISSES = ["driving licence rules", "the driver's license was renewed", "a fishing license is required", "he was released under bail", "licensed under state law to practise medicine", "published under a pen name", "the public domain", "permission to land was granted", "under the general terms of the agreement", "common rights of the public", "version 2.0 of the plan", "version 3 was released", "the gnu is an antelope", "software of the company", "a creative mind", "copyright law was reformed", "all rights of the child", "they may not use this road", "the source of the river", "the file was published", "free of charge for any person", "the author was a professor at MIT", "an apache helicopter", "a license plate", "licensed premises", "the licence fee"]
#: Paragraphs that hold any of these are no examples of class unknown; scans don't use it.
CUES = r"(?i)licen[cs]e|copyright|permission|public domain|creative commons|rights reserved|redistribut|source code form|spdx|gpl|\bmpl\b|\bbsd\b|\bcc[ -]?(by|0)|\bgnu\b|proprietary|unauthori[sz]ed|free software"
#: What every match of CUES holds, in lower case.
CUE_PARTS = ["licen", "copyright", "permission", "public domain", "creative commons", "rights reserved", "redistribut", "source code form", "spdx", "gpl", "mpl", "bsd", "ccby", "cc by", "cc-by", "cc0", "cc 0", "cc-0", "gnu", "proprietary", "unauthori", "free software"]
#: All paragraphs of documents together weigh as much as so many rows against the notices, or as their number if that is less.
PLAIN_WEIGHT = 2_000
REGULARISATION = 0.002
CONFIRMED = 0.5


def words(p: Column) -> Column:
    """Words, lower case, without punctuation at their end."""
    return F.regexp_extract_all(F.lower(p), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}.+/'-]*[\p{L}\p{N}+])?"), 0)


def has_cue(p: Column) -> Column:
    """Whether CUES matches; few paragraphs hold a part of a match, so the expression sees only those."""
    low = F.lower(p)
    return functools.reduce(operator.or_, (F.contains(low, F.lit(x)) for x in CUE_PARTS)) & p.rlike(CUES)


def marks(w: Column, known: list[str]) -> Column:
    """The words that are ``known``, in order, with one bar for every run of others: n-grams of known words stay as they are."""
    kept = F.transform(w, lambda x: F.when(x.isin(known), x))
    return F.regexp_replace(F.array_join(kept, " ", "|"), r"\|(?: \|)+", "|")


def grams(w: Column) -> Column:
    """Distinct 1- to 3-grams of an array of words."""
    two = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    three = F.when(F.size(w) > 2, F.zip_with(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 2), F.slice(w, F.lit(2), F.size(w) - 2), lambda a, b: F.concat_ws(" ", a, b)), F.slice(w, F.lit(3), F.size(w) - 2), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, two, three))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice): names with every lead-in, and sentences."""
    rows = [(f, f"{lead} {name}".strip()) for f, names in NAMES.items() for name in names for lead in LEADS]
    rows += [(f, s) for f, sentences in SENTENCES.items() for s in sentences]
    return spark.createDataFrame(rows, "family string, notice string").dropDuplicates(["notice"])


def lines(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep``, paragraph and p: the lines of whole texts, numbered from 0."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "p"))


class Classifier:
    """Families, and per n-gram one weight for each; the chance needed for a prediction; the words of the gate."""

    def __init__(self, families: list[str], bias: list[float], weights: dict[str, list[float]], needed: float, often: dict[str, float]):
        self.families, self.bias, self.weights, self.needed = families, bias, weights, needed
        self.gate = gate(bias, weights, needed, often)


def gate(bias: list[float], weights: dict[str, list[float]], needed: float, often: dict[str, float]) -> list[str] | None:
    """Words such that no paragraph without any of them can reach the chance needed; None if only a score can tell.

    A family reaches it only if its log-odds to class unknown reach those of ``needed``. The n-grams that hold no word of
    the gate may not get there together, whichever of them a paragraph holds. Words are added by what they take from
    that sum against how many plain paragraphs (``often``) hold them, so that the gate stays among rare words.
    """
    least = math.log(needed / (1 - needed))
    over = [b - bias[0] - least for b in bias[1:]]
    if max(over) >= 0:
        return None
    lift = {g: [max(0.0, x - w[0]) for x in w[1:]] for g, w in weights.items()}
    holds: dict[str, set[str]] = {}
    for g in lift:
        for w in g.split(" "):
            holds.setdefault(w, set()).add(g)
    share = {w: [sum(x) for x in zip(*(lift[g] for g in gs))] for w, gs in holds.items()}
    left = [o + sum(x) for o, x in zip(over, zip(*lift.values()))]
    chosen = []
    while max(left) >= 0:
        gain = {w: sum(min(x, max(0.0, o + 1e-6)) for x, o in zip(v, left)) / (1 + often.get(w, 0)) for w, v in share.items()}
        best = max(gain, key=lambda w: (gain[w], w))
        chosen.append(best)
        for g in list(holds[best]):
            left = [o - x for o, x in zip(left, lift[g])]
            for w in set(g.split(" ")):
                holds[w].discard(g)
                share[w] = [s - x for s, x in zip(share[w], lift[g])]
        del share[best]
    return sorted(chosen)


def weighted_rank(rows: DataFrame, share: float) -> float | None:
    """The value v at place ceil(share * sum of c) of (v, c): bins are refined until one value is left, so it is exact."""
    bounds = rows.agg(F.min("v"), F.max("v"), F.sum("c")).first()
    low, high, left = bounds[0], bounds[1], math.ceil(round(share * (bounds[2] or 0), 6))
    while low is not None and low < high:
        place = F.floor((F.col("v") - low) / (high - low) * 1_000)
        bins = rows.where(F.col("v").between(low, high)).groupBy(place.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()  # 1,001 at most
        for r in bins:
            low, high = r["low"], r["high"]
            if left <= r["c"]:
                break
            left -= r["c"]
    return low


def feature_sets(plain: DataFrame, vocabulary: list[str], terms: CountVectorizerModel) -> DataFrame:
    """(features, fold, near, n): how many different paragraphs (p) of ``plain`` hold just these n-grams of the notices."""
    single = [g for g in vocabulary if " " not in g]
    each = plain.where("p is not null").select(F.xxhash64("p").alias("h"), marks(words(F.col("p")), single).alias("s")).distinct()
    # written, since n-grams of an expression would make its words anew for every element
    each = saved(each.groupBy(F.split("s", " ").alias("w"), F.pmod("h", F.lit(5)).alias("fold")).agg(F.count("*").alias("n")), "marks")
    each = each.withColumn("near", F.exists("w", lambda x: ~x.isin("", "|")))
    each = each.withColumn("g", F.when(F.col("near"), grams(F.col("w"))).otherwise(F.array().cast("array<string>")))
    return terms.transform(each).groupBy("features", "fold", "near").agg(F.sum("n").alias("n"))


def train(spark: SparkSession, plain: DataFrame) -> Classifier:
    """``plain``: paragraphs (p) without licences; all train, equal ones once."""
    known = notices(spark)
    vocabulary = sorted(r[0] for r in known.select(F.explode(grams(words(F.col("notice"))))).distinct().collect())  # of the fixed notices
    terms = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="features", binary=True)
    negative = saved(feature_sets(plain, vocabulary, terms), "plain")
    n = negative.agg(F.sum("n")).first()[0] or 0
    weight = min(1.0, PLAIN_WEIGHT / max(1, n))
    misses = spark.createDataFrame([(m,) for m in NEAR_MISSES], "notice string").select(F.lit("unknown").alias("family"), "notice")
    rows = known.union(misses).withColumn("g", grams(words(F.col("notice"))))
    families = ["unknown", *NAMES]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    fixed = terms.transform(rows.select("g", label.cast("double").alias("label"), F.pmod(F.xxhash64("notice"), F.lit(5)).alias("fold"))).coalesce(1)
    fixed = fixed.select("features", "label", "fold", (F.size(F.array_intersect("g", F.array(*map(F.lit, vocabulary)))) > 0).alias("near"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("weight"))
    x = fixed.union(negative.select("features", F.lit(0.0).alias("label"), "fold", "near", "n", (F.col("n") * weight).alias("weight")))
    x = saved(x, "notices")
    model = LogisticRegression(family="multinomial", regParam=REGULARISATION, maxIter=60, weightCol="weight")
    part = model.fit(x.where("fold <> 0"))
    held = part.transform(x.where("fold = 0 and label = 0 and near")).select((F.lit(1) - vector_to_array("probability")[0]).alias("v"), F.col("n").alias("c"))
    needed = max(0.5, min(0.9, weighted_rank(saved(held, "held"), 0.99) or 0.5))
    full = model.fit(x)
    w, b = full.coefficientMatrix.toArray(), full.interceptVector.toArray()
    share = x.where("label = 0").select(Summarizer.mean(F.col("features"), F.col("weight")), F.sum("weight")).first()
    often = {g: float(share[0][i]) * share[1] for i, g in enumerate(vocabulary) if " " not in g}
    return Classifier(families, b.tolist(), {g: w[:, i].tolist() for i, g in enumerate(vocabulary)}, needed, often)


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, paragraph, family, probability, similarity and confirmed: one row for each paragraph that passes the gate.

    ``family`` is unknown if no family reaches the chance needed; such rows have no similarity and are not confirmed, and
    no paragraph outside the gate can reach it. Null and empty texts have no such paragraph. Repeated rows and null ids
    each keep theirs; of equal chances the earlier family of ``NAMES`` counts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = len(model.families)
    weights = F.broadcast(spark.createDataFrame(list(model.weights.items()), "gram string, w array<double>"))  # of the fixed notices
    found = lines(docs, text, F.col(id_col)).withColumn("w", words(F.col("p")))
    found = found.where(F.size("w") > 0 if model.gate is None else F.exists("w", lambda x: x.isin(model.gate)))
    found = saved(found.select(id_col, "paragraph", grams(F.col("w")).alias("g"), F.xxhash64("p").alias("k")), "paragraphs")
    # equal paragraphs are scored once
    each = found.groupBy("k").agg(F.first("g").alias("g"))
    summed = each.select("k", F.explode_outer("g").alias("gram")).join(weights, "gram", "left").groupBy("k").agg(*(F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)))
    odds = F.array(*(F.col(f"s{i}") + model.bias[i] for i in range(n)))
    top = F.array_max(odds)
    chance = F.transform(odds, lambda v: F.exp(v - top))
    scored = summed.select("k", chance.alias("e")).withColumn("prob", F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    best = F.element_at(F.array(*map(F.lit, model.families)), F.array_position("e", F.array_max("e")).cast("int"))
    scored = scored.select("k", F.when(F.col("prob") >= model.needed, best).otherwise("unknown").alias("family"), F.col("prob").alias("probability"))
    known = notices(spark).groupBy("family").agg(F.collect_list(grams(words(F.col("notice")))).alias("t"))
    near = each.join(scored, "k").join(F.broadcast(known), "family", "left")
    alike = F.array_max(F.transform("t", lambda t: F.size(F.array_intersect("g", t)) / F.least(F.size("g"), F.size(t))))
    judged = near.select("k", "family", "probability", F.round(alike, 6).alias("similarity"))
    return found.select(id_col, "paragraph", "k").join(judged, "k").select(id_col, "paragraph", "family", F.round("probability", 6).alias("probability"), "similarity", F.coalesce(F.col("similarity") >= CONFIRMED, F.lit(False)).alias("confirmed"))


def licences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``scan`` with a classifier whose class unknown has also seen paragraphs of these documents that hold no cue."""
    plain = lines(docs, text).where(~has_cue(F.col("p")))
    return scan(docs, train(docs.sparkSession, plain), id_col, text)
