"""License scans (operator 5): a trained paragraph classifier, with DataFrame and SQL functions only.

A paragraph is a line, or a sentence wrapped over several lines between blank ones. Features are word 1- to 3-grams that hold a
cue word; cue words are all words of the training phrases but function words, however frequent in the corpus, so a paragraph without
one has no feature and is no licence. That makes the search for cue words an exact filter: the classifier sees every paragraph that
could score, and its weights judge the frequent words.

The classifier is a multinomial logistic regression with sparse (L1) weights, fitted on phrases of each family, on names and phrases of
licences of no known family (class `unknown`), and on ordinary uses of the same words and background paragraphs (class `none`).
A temperature fitted on held-out phrases calibrates its probabilities. A family stands if its calibrated probability is at least
`ACCEPT` and the words of one of its templates lie in the paragraph to `CONFIRM`; a paragraph that is no `none` but fails
either is `unknown`.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.components import staged

NONE, UNKNOWN = "none", "unknown"
ACCEPT, CONFIRM = 0.5, 0.8
BACKGROUND_ROWS = 2_000
"""Background paragraphs come from at most about so many documents, by a hash of doc_id; a bounded, documented sample."""
TEMPERATURES = tuple(0.25 * 2 ** (k / 2) for k in range(10))

# Licence families, their names and the key phrases of their notices.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0", "licensed under the Apache License"],
    "mit": ["MIT License", "the MIT licence", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX MIT license"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0-or-later license", "GPLv2 license"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1 license", "GNU LGPL v3"],
    "agpl": ["GNU Affero General Public License", "AGPL-3.0 license", "GNU AGPL v3"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause license", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "mpl": ["Mozilla Public License, v. 2.0", "MPL-2.0 license", "Mozilla Public License"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0 license", "CC BY 3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 4.0", "CC-BY-SA-3.0 license", "CC BY-SA 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC 4.0", "CC-BY-NC-4.0 license", "CC BY-NC 3.0"],
    "cc0": ["CC0 1.0 Universal", "dedicated to the public domain under CC0", "Creative Commons Zero license"],
    "proprietary": ["All rights reserved", "Unauthorized copying of this file is strictly prohibited", "proprietary and confidential, all rights reserved"],
}
# Names of other licences, which teach the class `unknown` what any licence's name looks like.
UNKNOWN_NAMES = ["ISC License", "The Unlicense", "Eclipse Public License 2.0", "EPL-2.0 license", "EUPL-1.2", "Boost Software License 1.0", "zlib License", "Open Database License (ODbL) v1.0", "ODbL-1.0", "SIL Open Font License 1.1", "OFL-1.1 license", "Artistic License 2.0", "CDDL-1.0", "PostgreSQL License", "Python Software Foundation License", "Common Public License Version 1.0", "Microsoft Reciprocal License", "Open Government Licence v3.0"]
FRAMES = ["{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}", "Distributed under the terms of the {}", "SPDX-License-Identifier: {}", "Copyright (c) 2020 the authors. {}.", "The code is available under the {}; see the LICENSE file.", "This project is released under {} terms"]
OTHER = ["Licensed under the Example Vendor License.", "This software is subject to a custom licence agreement", "See the LICENSE file for details", "Released under the Garden Tools License", "Distributed under the terms of the Harbour Data Licence, version 1", "Use is governed by the end user license agreement", "Licensed under terms to be agreed", "This dataset is licensed under a research-only licence", "Copyright held by the authors", "SPDX-License-Identifier: LicenseRef-Custom"]
ORDINARY = ["She renewed her driving license at the office", "the license plate of the car", "He was licensed as a doctor last year", "they released the new version of the film", "under the terms of the treaty", "the Apache helicopter landed", "students at MIT built a robot", "a general public meeting was held", "the public library is open", "creative work is common in schools", "a license fee must be paid for television", "permission was granted by the mayor", "all tickets were reserved", "the rights of workers are protected", "copyright law changed in the last century", "he attributed it to the commons", "the file is on the desk", "see the details of the project", "zero degrees in the universal scale", "version 2.0 of the report", "a clause in the contract"]

ORDINARY_KINDS = ["driving", "driver's", "fishing", "hunting", "marriage", "pilot", "radio", "teaching"]
ORDINARY_FRAMES = ["renewed the {} license at the office", "the {} license was taken away", "a {} license costs money", "he holds a {} licence"]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column, cues: Column) -> Column:
    """1- to 3-grams that hold a cue word."""

    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(cues, w), i + 1)), lambda i: i.isNotNull())

    def runs(k: int) -> Column:
        places = F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(i - (k - 1), i)))), lambda i: (i >= 1) & (i <= F.size(words) - (k - 1)))
        return F.transform(places, lambda i: F.concat_ws(" ", F.slice(words, i, k)))

    return F.concat(runs(1), runs(2), runs(3))


def training_phrases(spark: SparkSession) -> DataFrame:
    """label, text of the fixed phrases."""
    rows = [(family, frame.format(t)) for family, ts in TEMPLATES.items() for t in ts for frame in FRAMES]
    rows += [(UNKNOWN, frame.format(name)) for name in UNKNOWN_NAMES for frame in FRAMES]
    rows += [(NONE, frame.format(kind)) for kind in ORDINARY_KINDS for frame in ORDINARY_FRAMES]
    rows += [(UNKNOWN, t) for t in OTHER] * 3 + [(NONE, t) for t in ORDINARY] * 3
    return spark.createDataFrame(rows, "label string, text string").coalesce(1)


def units(docs: DataFrame) -> DataFrame:
    """doc_id, row (of docs), paragraph (first line, from 0), last (line), text: every line, and every sentence that goes over a line's end."""
    clean = F.translate("text", "\x01\x02", "  ")
    marked = F.transform(F.split(clean, "\n"), lambda line, i: F.when(line.rlike(r"^\s*$"), F.lit("\x02")).otherwise(F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x01"), line)))
    cut = F.split(F.array_join(marked, "\n"), r"\x02|(?<=[.!?])\s+(?=(?:\x01\d+\x01)?\s*\p{Lu})")
    wrapped = F.filter(F.transform(cut, lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x.contains("\n"))
    number = lambda x, at: F.element_at(F.split(x, "\x01"), at).cast("int")
    # a piece that starts inside a line has the number of the next line first
    sentences = F.transform(wrapped, lambda x: F.struct((number(x, 2) - F.when(x.startswith("\x01"), 0).otherwise(1)).alias("paragraph"), number(x, -2).alias("last"), F.regexp_replace(x, r"\n?\x01\d+\x01", " ").alias("text")))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("paragraph"), i.alias("last"), line.alias("text")))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # before the rows are taken apart
    return numbered.select("doc_id", "row", F.inline(F.concat(lines, sentences)))


def background(docs: DataFrame, rows: int = BACKGROUND_ROWS) -> DataFrame:
    """Paragraphs (as of units) of a bounded sample of documents."""
    total = docs.count()
    share = min(1.0, rows / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("licence background")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    return units(sample).where(F.trim("text") != "")


def _templates() -> Column:
    return F.create_map(*[x for k, ts in TEMPLATES.items() for x in (F.lit(k), F.array(*[tokens(F.lit(t)) for t in ts]))])


def share(template: Column, words: Column) -> Column:
    """The share of a template's words that are among words."""
    return F.size(F.array_intersect(template, words)) / F.size(F.array_distinct(template))


class Scanner:
    """A fitted classifier: cue words, vocabulary, weights, labels and temperature."""

    def __init__(self, cues: list[str], vectors: CountVectorizerModel, model: LogisticRegressionModel, labels: list[str], temperature: float):
        self.cues, self.vectors, self.model, self.labels, self.temperature = cues, vectors, model, labels, temperature

    def cued(self, paragraphs: DataFrame) -> DataFrame:
        """Paragraphs (text) that hold a cue word; the others have no feature."""
        words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
        return paragraphs.where(F.arrays_overlap(words, F.array(*map(F.lit, self.cues))))

    def scored(self, paragraphs: DataFrame) -> DataFrame:
        """Adds words, none and most (calibrated probabilities of no licence and of the likeliest family) and guess (that family)."""
        rows = staged(paragraphs.withColumn("words", tokens(F.col("text"))), "licence-words")  # else the words are made anew for each n-gram
        rows = rows.withColumn("grams", grams(F.col("words"), F.array(*map(F.lit, self.cues))))
        rows = PipelineModel([self.vectors, self.model]).transform(rows).select(*paragraphs.columns, "words", vector_to_array("probability").alias("p"))
        rows = staged(rows, "licence-scores")
        heated = lambda x: F.pow(x, F.lit(1 / self.temperature))
        rows = rows.withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + heated(x))).withColumn("family", F.slice("p", 3, len(self.labels) - 2)).withColumn("top", F.array_max("family"))
        guess = F.element_at(F.array(*map(F.lit, self.labels)), (F.array_position("family", F.col("top")) + 2).cast("int"))
        return rows.select(*paragraphs.columns, "words", (heated(F.element_at("p", 1)) / F.col("total")).alias("none"), (heated(F.col("top")) / F.col("total")).alias("most"), guess.alias("guess"))


def train(docs: DataFrame) -> Scanner:
    """Fit on the fixed phrases and a bounded background sample of docs (doc_id, text)."""
    spark = docs.sparkSession
    phrases = staged(training_phrases(spark).withColumn("words", tokens(F.col("text"))), "licence-phrases")
    plain = staged(background(docs.select("doc_id", "text")).withColumn("label", F.lit(NONE)).withColumn("words", tokens(F.col("text"))), "licence-background")
    cues = sorted(r["w"] for r in phrases.where(F.col("label") != NONE).select(F.explode("words").alias("w")).distinct().collect() if len(r["w"]) > 1 and r["w"] not in _never())
    labels = [NONE, UNKNOWN, *TEMPLATES]
    number = F.element_at(F.create_map(*[x for k, v in enumerate(labels) for x in (F.lit(v), F.lit(float(k)))]), F.col("label"))
    # what names a licence or repeats a template isn't known to be none, nor is a line of such a sentence
    plain = staged(plain.withColumn("marked", F.arrays_overlap("words", F.array(*map(F.lit, _names()))) | F.exists(F.flatten(F.map_values(_templates())), lambda t: share(t, F.col("words")) >= CONFIRM)), "licence-marked")
    m = plain.where("marked AND last > paragraph").select(F.col("row").alias("in_row"), F.col("paragraph").alias("first_line"), F.col("last").alias("last_line"))
    within = (F.col("row") == F.col("in_row")) & (F.col("paragraph") >= F.col("first_line")) & (F.col("last") <= F.col("last_line"))
    unmarked = plain.where("NOT marked AND last = paragraph").join(m, within, "left_anti").select("label", "text", "words")
    chosen = unmarked.orderBy(F.xxhash64("text", F.lit("licence background")), F.md5("text")).limit(BACKGROUND_ROWS)  # whatever the partitioning
    rows = phrases.unionByName(chosen).select(number.alias("label"), "text", grams(F.col("words"), F.array(*map(F.lit, cues))).alias("grams"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(5))).coalesce(2).cache()
    vectors = CountVectorizer(inputCol="grams", outputCol="features", minDF=2, binary=True, vocabSize=1 << 14).fit(rows)
    model = LogisticRegression(family="multinomial", regParam=2e-5, elasticNetParam=0.5, maxIter=100, standardization=False).fit(vectors.transform(rows.where("fold > 0")).select("label", "features"))
    held = model.transform(vectors.transform(rows.where("fold = 0"))).select(F.col("label").cast("int").alias("label"), vector_to_array("probability").alias("p"))
    loss = lambda t: F.avg(F.log(F.aggregate("p", F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(1 / t)))) - F.log(F.greatest(F.element_at("p", F.col("label") + 1), F.lit(1e-300))) / t)
    losses = held.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]).first()
    rows.unpersist()
    best = min(range(len(TEMPERATURES)), key=lambda k: losses[k] if losses[k] is not None and math.isfinite(losses[k]) else math.inf)
    return Scanner(cues, vectors, model, labels, TEMPERATURES[best])


def _names() -> list[str]:
    """Words that name a licence or stand in notices only; background paragraphs with one are not taken for ordinary ones."""
    return ["license", "licence", "licensed", "licenses", "copyright", "reserved", "spdx", "apache", "gnu", "mit", "cc", "gpl", "gplv2", "gplv3", "lgpl", "agpl", "affero", "bsd", "mpl", "mozilla", "cc0", "sharealike", "noncommercial", "unlicense", "isc", "epl", "eupl", "zlib", "odbl", "ofl", "cddl", "redistribution", "redistributions", "hereby"]


def _never() -> set[str]:
    """Function words of the phrases, of no use as cues in any corpus."""
    return {"the", "of", "to", "is", "in", "or", "and", "by", "on", "under", "this", "see", "for", "with", "are", "at", "be", "any", "as", "an"}


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, paragraph, family, probability, overlap, confirmed: one row for each paragraph that isn't `none`.

    docs has doc_id and text; other columns are left aside. paragraph counts lines from 0; a wrapped sentence has that of its first
    line. It gives a row for a family that none of its lines confirms, and stands for those of its lines that guess this family without
    confirming it; where it confirms none, it gives a row only if its lines give none. probability is that of the family, or of
    not being `none` for `unknown`; overlap is the largest share of a template's words, of the predicted family, that the paragraph
    has. Null and empty texts and empty tables give no rows; repeated rows give theirs each; null ids are kept.
    """
    rows = scanner.scored(scanner.cued(units(docs))).where(F.col("none") < 0.5)
    overlap = F.array_max(F.transform(F.element_at(_templates(), F.col("guess")), lambda t: share(t, F.col("words"))))
    rows = rows.withColumn("overlap", overlap).withColumn("stands", (F.col("most") >= ACCEPT) & (F.col("overlap") >= CONFIRM))
    found = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("paragraph", "last", "guess", "stands", "most", "none", "overlap")).alias("all"))
    found = found.withColumn("sentences", F.filter("all", lambda u: u["last"] > u["paragraph"])).withColumn("lines", F.filter("all", lambda u: u["last"] == u["paragraph"]))
    inside = lambda line, x: (line["paragraph"] >= x["paragraph"]) & (line["last"] <= x["last"])
    lines = F.filter("lines", lambda u: u["stands"] | ~F.exists("sentences", lambda x: x["stands"] & inside(u, x) & (u["guess"] == x["guess"])))
    sentences = F.filter("sentences", lambda x: ~F.exists("lines", lambda u: inside(u, x) & (~x["stands"] | u["stands"] & (u["guess"] == x["guess"]))))
    stands = F.col("stands")
    return found.select("doc_id", F.inline(F.concat(lines, sentences))).select(
        "doc_id", "paragraph", F.when(stands, F.col("guess")).otherwise(UNKNOWN).alias("family"),
        F.when(stands, F.col("most")).otherwise(1 - F.col("none")).alias("probability"), "overlap", stands.alias("confirmed"),
    )
