"""Licence notices in job logs: a trained paragraph classifier, confirmed by templates."""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Opening notices by family, as their licences ask for them or as they are commonly written.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ],
    "creative_commons": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved. Unauthorized copying of this file is prohibited.",
    ],
}
FAMILIES = [*TEMPLATES, UNKNOWN]
GRAM = 2
SAMPLE_PARAGRAPHS = 4000
VARIANTS = 60
TARGET_PRECISION = 0.99
LEAST_PROBABILITY = 0.5
CONFIRMED = 0.6
CUE_MARGIN = 1.0


def words(paragraph: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(paragraph), "[^a-z0-9.]+|[.](?![0-9])", " ")
    return F.filter(F.split(F.trim(cleaned), " +"), lambda w: w != "")


def grams(tokens: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.array_distinct(F.concat(tokens, pairs))


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(f, n, t) for f, texts in TEMPLATES.items() for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, n int, paragraph string")


def training_rows(spark: SparkSession, paragraphs: DataFrame) -> DataFrame:
    """label, tokens, part: variants of the templates, and a bounded sample of ordinary paragraphs.

    A variant leaves out words at random (by hash) or stops early. Ordinary paragraphs are the SAMPLE_PARAGRAPHS
    with the lowest hash; those that share half of their words and pairs with a template are left out.
    """
    luck = lambda *by: F.pmod(F.xxhash64(*by), F.lit(1000)) / 1000.0
    variants = (
        _template_rows(spark).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
        .withColumn("t", words(F.col("paragraph")))
        .withColumn("drop", F.when(F.col("v") == 0, 0.0).otherwise(luck("family", "n", "v", F.lit("d")) * 0.25))
        .withColumn("tokens", F.filter("t", lambda w, i: luck("family", "n", "v", w, i) >= F.col("drop")))
        .withColumn("kept", F.greatest(F.lit(3), F.ceil(F.size("tokens") * F.when(F.col("v") % 3 == 0, 1.0).otherwise(0.4 + 0.6 * luck("family", "n", "v", F.lit("k"))))))
        .withColumn("tokens", F.slice("tokens", F.lit(1), F.col("kept").cast("int")))
        .select("family", grams(F.col("tokens")).alias("tokens"), (luck("family", "n", "v", F.lit("p")) < 0.3).alias("held"))
    )
    ordinary = (
        paragraphs.select("paragraph").orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE_PARAGRAPHS)
        .select(F.lit(UNKNOWN).alias("family"), grams(words(F.col("paragraph"))).alias("tokens"), (luck("paragraph") < 0.3).alias("held"))
        .where(template_overlap(F.col("tokens"))["overlap"] < 0.5)
    )
    names = F.array(*[F.lit(f) for f in FAMILIES])
    return variants.unionByName(ordinary).withColumn("label", (F.array_position(names, F.col("family")) - 1).cast("double"))


def template_overlap(tokens: Column) -> Column:
    """struct(overlap, template_family): the largest share of a paragraph's words and pairs, or of a
    template's, that the other has too; the first family on a tie."""
    found = []
    for order, (family, texts) in enumerate(TEMPLATES.items()):
        for text in texts:
            own = template_grams(text)
            shared = F.size(F.array_intersect(tokens, F.lit(own)))
            share = F.greatest(F.try_divide(shared, F.size(tokens)), shared / len(own))
            found.append(F.struct(F.coalesce(share, F.lit(0.0)).alias("overlap"), F.lit(-order).alias("order"), F.lit(family).alias("template_family")))
    return F.greatest(*found)


class LicenceClassifier:
    """The fitted pieces: n-gram vocabulary, logistic regression, least probability per family, cue words."""

    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel, least: dict[str, float], cues: list[str]):
        self.vectors, self.model, self.least, self.cues = vectors, model, least, cues


def template_grams(text: str) -> list[str]:
    """What grams(words(text)) gives, for a template."""
    t = re.sub(r"[^a-z0-9.]+|[.](?![0-9])", " ", text.lower()).split()
    return list(dict.fromkeys([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]))


def vocabulary() -> list[str]:
    """All words and pairs of the templates. Other words have no weight."""
    return sorted({g for texts in TEMPLATES.values() for text in texts for g in template_grams(text)})


def cue_words(terms: list[str], model: LogisticRegressionModel) -> list[str]:
    """Words one of which every paragraph holds that can reach a family's log odds of -CUE_MARGIN.

    Without a cue word only the other terms count, each once; words are made cues, the strongest first, until
    the sum of all that is left cannot reach that margin over `unknown` for any family.
    """
    weights = model.coefficientMatrix.toArray()
    bias = model.interceptVector.toArray()
    over = weights[:-1] - weights[-1]
    start = bias[:-1] - bias[-1]
    singles = sorted((t for t in terms if " " not in t), key=lambda t: (-over[:, terms.index(t)].max(), t))
    cues: list[str] = []
    for word in [None, *singles]:
        if word is not None:
            cues.append(word)
        free = [i for i, t in enumerate(terms) if not set(t.split()) & set(cues)]
        if (start + over[:, free].clip(min=0).sum(axis=1) < -CUE_MARGIN).all():
            break
    return cues


def learn_licences(spark: SparkSession, paragraphs: DataFrame) -> LicenceClassifier:
    """Fit on template variants and ordinary paragraphs; calibrate `unknown` on the held-out part.

    A family's least probability is the lowest, LEAST_PROBABILITY at least, from which on held-out rows
    of that prediction are right in TARGET_PRECISION of all cases.
    """
    terms = vocabulary()
    vectors = CountVectorizerModel.from_vocabulary(terms, "tokens", "features")
    vectors.setBinary(True)
    rows = vectors.transform(training_rows(spark, paragraphs)).select("label", "features", "held", "family")
    fit = rows.where("not held").coalesce(1).persist()
    model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=40, featuresCol="features").fit(fit)
    fit.unpersist()
    judged = _predicted(model.transform(rows.where("held"))).select(
        "family", "predicted", F.floor(F.col("probability") * 100).cast("int").alias("percent")
    )
    counts = judged.groupBy("predicted", "percent").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("family") == F.col("predicted")).alias("right")
    ).collect()  # at most a hundred rows for each family
    least = {}
    for family in TEMPLATES:
        n = right = 0
        least[family] = 1.0
        for r in sorted((c for c in counts if c["predicted"] == family), key=lambda c: -c["percent"]):
            n, right = n + r["n"], right + r["right"]
            if right >= TARGET_PRECISION * n and r["percent"] >= 100 * LEAST_PROBABILITY:
                least[family] = r["percent"] / 100
    return LicenceClassifier(vectors, model, least, cue_words(terms, model))


def _predicted(scored: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(f) for f in FAMILIES])
    return scored.withColumn("p", vector_to_array("probability")).withColumn("probability", F.array_max("p")).withColumn(
        "predicted", F.element_at(names, F.array_position("p", F.col("probability")).cast("int"))
    )


def paragraphs_of(logs: DataFrame, job_id: str = "job_id", log: str = "log") -> DataFrame:
    """job_id, paragraph_no (from 0), paragraph: the lines of every log that hold a letter."""
    return logs.select(F.col(job_id).alias("job_id"), F.posexplode(F.split(F.col(log), "\n")).alias("paragraph_no", "paragraph")).where(
        F.col("paragraph").rlike(r"\p{L}")
    )


def scan_licences(logs: DataFrame, classifier: LicenceClassifier, job_id: str = "job_id", log: str = "log") -> DataFrame:
    """Licence notices in job logs, a row for each paragraph (line) that looks like one.

    A paragraph's words and word pairs go through the logistic regression. Below the family's calibrated
    probability, or where no template of the predicted family shares CONFIRMED of its words, the family
    is 'unknown' and `confirmed` false. Paragraphs that the regression takes for ordinary text have no row.
    Only paragraphs with a cue word are scored: no other can be predicted a licence (see cue_words).

    NULL and empty logs have no paragraphs; repeated rows are scanned each; other columns are not looked
    at. A log's own text is all that is needed, so nothing is shuffled. Returns job_id, paragraph_no, family,
    predicted, probability, overlap, confirmed.
    """
    cue = F.lit(r"(?i)\b(?:" + "|".join(re.escape(w) for w in classifier.cues) + r")\b") if classifier.cues else F.lit("")
    likely = paragraphs_of(logs.where(F.regexp(F.col(log), cue)), job_id, log)
    likely = likely.where(F.regexp(F.col("paragraph"), cue))
    tokens = likely.withColumn("tokens", grams(words(F.col("paragraph"))))
    scored = _predicted(classifier.model.transform(classifier.vectors.transform(tokens)))
    least = F.coalesce(*[F.when(F.col("predicted") == f, F.lit(p)) for f, p in classifier.least.items()])
    found = scored.where(F.col("predicted") != UNKNOWN).withColumn("t", template_overlap(F.col("tokens")))
    sure = (
        (F.col("probability") >= least) & (F.col("t.overlap") >= CONFIRMED) & (F.col("t.template_family") == F.col("predicted"))
    )
    return found.select(
        "job_id", "paragraph_no", F.when(sure, F.col("predicted")).otherwise(UNKNOWN).alias("family"), "predicted",
        "probability", F.col("t.overlap").alias("overlap"), sure.alias("confirmed"),
    )
