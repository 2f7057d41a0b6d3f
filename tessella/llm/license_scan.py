"""License scan: a paragraph classifier trained on templates, whose predictions a template comparison confirms.

A document is cut into paragraphs: comment marks are taken off its lines, lines of at most ``WRAPPED`` characters that
follow each other without a blank line between them are joined, as hard-wrapped notices need, and each such line also
stays a paragraph of its own, as notices of one line stand between other lines. A paragraph of more than ``WINDOW`` words is
scored in overlapping windows. Every window goes through the classifier; there is no filter of words before it.

The classifier is a multinomial logistic regression on the presence of word 1- to 3-grams. Its known classes are fitted
on windows of the templates below, and "unknown" on single template words and on a bounded sample of the documents' own
windows that share next to nothing with a template. A first fit leaves some templates out; on their windows, and on windows
of the sample that it hasn't seen, a temperature is chosen that calibrates its probabilities. The same unseen windows give
the bound of the unknown class: a window is taken for a licence where the calibrated probability that it isn't unknown is
above what all but the share ``accepted`` of the sample's unseen windows have. Such a window's best family is confirmed where
a template of it shares enough of its word pairs with the window, one of them a pair that only this family has, and where no
negation stands before the grant.

The clauses that all BSD licences share are a family of their own. In a document's result it stands for bsd-2-clause, unless
the document has a clause or name of bsd-3-clause too.

All steps are DataFrame expressions and Spark ML's transformers, which run in the JVM.

Defined cases: a null or empty text has no paragraph and no licence; a very long text is scanned whole, window by window;
several licences in one document give its families in alphabetical order; a paragraph that a document repeats counts once;
repeated rows are scanned one by one; rows that share an id share their result; an empty table gives an empty result; other
columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import drop_stash, stash

UNKNOWN = "unknown"
#: Number of the sample's windows among the templates.
SAMPLE = -2
#: Characters of a line that may be a part of a wrapped paragraph; words of a window, and of the step to the next one.
WRAPPED, WINDOW, STEP = 100, 64, 48
#: Marks of comments, and blanks, at a line's start. Those at its end are no words and need no care.
COMMENT = r"(?m)^[ \t\r]*+(?:(?:/\*+|\*+/?|//+!?|#+|--+|;+|%+|<!--|\.\.|(?i:rem|dnl)\b)[ \t\r]*+)*+"
#: A line's end between two lines that are short and not blank.
JOINT = rf"\n(?<=(?:^|\n)[^\n]{{1,{WRAPPED}}}\n)(?=[^\n]{{1,{WRAPPED}}}(?:\n|$))"
#: Short notices and opening words of public licences, by family.
TEMPLATES = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is licensed under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "License :: OSI Approved :: Apache Software License",
    ],
    "artistic-2.0": [
        "This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)",
        "Released under the Artistic License 2.0.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "License :: OSI Approved :: BSD License",
    ],
    "bsd-2-clause": [
        "Released under the BSD 2-Clause License.",
        "This project is licensed under the BSD 2-Clause Simplified License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPL v3.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "License :: OSI Approved :: MIT License",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ofl-1.1": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    # these speak of licences and grant none
    UNKNOWN: [
        "The driver had lost his license and walked home.",
        "A licence to practise medicine is granted by the state board after the examination.",
        "The court held that the license agreement was void.",
        "She paid the annual license fee for the television.",
        "Copyright law protects authors for seventy years after death.",
        "All rights reserved. Copyright by the publisher.",
        "Please read the license before you install the program.",
        "The company licensed the patent to a competitor in the general market.",
        "You may not redistribute the newspaper without written consent.",
        "The hotel bar is licensed to serve wine and spirits until midnight.",
        "The photograph is in the public eye, and public domain names are sold at auction.",
        "Creative commons rooms are open to students of the college.",
        "License plates of the version used before the war are rare.",
        "Ask the author which license applies to the terms of this work.",
        "The software license server is not available, contact the administrator.",
    ],
}
CLASSES = sorted(TEMPLATES)
#: The header that names a licence by its short identifier, and its other form.
IDENTIFIER, HEADER = "SPDX-License-Identifier: ", "License: "
#: A negation right before the grant.
NEGATED = r"\b(?:not|never|no longer)(?: be| been| yet)? (?:licensed|released|distributed|dedicated|available)\b"
#: The family of shared clauses: what it stands for, and what takes its place where both are found.
SHARED, STANDS_FOR, STRONGER = "bsd", "bsd-2-clause", "bsd-3-clause"


@dataclass(frozen=True)
class Model:
    """The vocabulary and weights of the fit on all templates; the temperature, and the least probability of not being unknown,
    both found on windows held out."""

    vectors: CountVectorizerModel
    classifier: LogisticRegressionModel
    heat: float
    least: float


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"), F.lit(0))


def windows(words: Column) -> Column:
    """Windows of at most WINDOW words, a new one each STEP words."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (WINDOW - STEP)), F.lit(STEP))
    return F.when(F.size(words) == 0, F.array().cast("array<array<string>>")).when(F.size(words) <= WINDOW, F.array(words)).otherwise(F.transform(starts, lambda a: F.slice(words, a, WINDOW)))


def document_windows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, line, w): the windows of all distinct paragraphs of each document: of the joined lines of wrapped blocks, and
    of the single lines. line is the paragraph's place among them."""
    rows = docs.select(F.col(key).alias("id"), F.regexp_replace(F.col(text).cast("string"), COMMENT, "").alias("bare"))
    rows = rows.withColumn("joined", F.regexp_replace("bare", JOINT, " "))
    both = F.when(F.col("bare") == F.col("joined"), F.split("bare", "\n")).otherwise(F.concat(F.split("joined", "\n"), F.split("bare", "\n")))
    rows = rows.select("id", F.posexplode(F.array_distinct(both)).alias("line", "p")).where(F.length("p") > 0)
    rows = rows.select("id", "line", words_of(F.col("p")).alias("w"))
    return rows.select("id", "line", F.explode(windows(F.col("w"))).alias("w"))


def with_grams(rows: DataFrame) -> DataFrame:
    """rows (.., w) with their word 1- to 3-grams."""
    for n in (2, 3):
        rows = NGram(n=n, inputCol="w", outputCol=f"w{n}").transform(rows)
    return rows.withColumn("grams", F.concat("w", "w2", "w3")).drop("w2", "w3")


def pairs_of(words: Column) -> Column:
    """Distinct neighbouring words; a single word counts by itself."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, 2), " ")))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of given values."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def all_templates() -> dict[str, list[str]]:
    """The templates, and each short identifier in its other header."""
    return {f: ts + [HEADER + t.removeprefix(IDENTIFIER) for t in ts if t.startswith(IDENTIFIER)] for f, ts in TEMPLATES.items()}


def templates(spark: SparkSession) -> DataFrame:
    rows = [{"family": f, "n": i, "t": t} for f, ts in all_templates().items() for i, t in enumerate(ts)]
    return _table(spark, rows, "family: string, n: int, t: string").withColumn("w", words_of(F.col("t"))).drop("t")


def template_windows(spark: SparkSession, each: int = 40) -> DataFrame:
    """(family, n, w, held): at most each windows of template n, of at least 60 percent of its words, and single words
    as "unknown". Every third template of a family is held out, with all its windows."""
    held = (F.col("n") % 3 == 1) & (F.col("family") != UNKNOWN)
    spans = templates(spark).withColumn("a", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.size("w") * 0.4).cast("int")))))
    spans = spans.withColumn("b", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.size("w") * 0.6).cast("int")), F.size("w") - F.col("a") + 1)))
    order = Window.partitionBy("family", "n").orderBy(F.xxhash64("family", "n", "a", "b"))
    spans = spans.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each)
    spans = spans.select("family", "n", F.slice("w", F.col("a"), F.col("b")).alias("w"), held.alias("held"))
    singles = templates(spark).where(F.col("family") != UNKNOWN).select(F.explode("w").alias("w")).distinct()
    return spans.unionByName(singles.select(F.lit(UNKNOWN).alias("family"), F.lit(-1).alias("n"), F.array("w").alias("w"), F.lit(False).alias("held")))


def unknown_windows(docs: DataFrame, text: str, key: str, documents: int, rows: int) -> DataFrame:
    """(family, n, w, held): at most rows windows of about documents documents, drawn by a hash of their id, that hold less
    than a fifth of any template's word pairs. A quarter of them is held out."""
    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64(key, F.lit("licence")), F.lit(max(1, total // documents))) == 0).limit(2 * documents)
    found = document_windows(some, text, key).withColumn("h", F.xxhash64("id", "line", F.array_join("w", " ")))
    found = found.orderBy("h").limit(rows)
    shapes = template_pairs(docs.sparkSession)
    hits = found.select("h", F.explode(pairs_of(F.col("w"))).alias("gram")).join(F.broadcast(shapes), "gram")  # bounded by the templates
    near = hits.groupBy("h", "family", "n", "size").agg(F.count("*").alias("hits")).where(F.col("hits") >= 0.2 * F.col("size")).select("h").distinct()
    return found.join(near, "h", "left_anti").select(F.lit(UNKNOWN).alias("family"), F.lit(SAMPLE).alias("n"), "w", (F.pmod("h", F.lit(4)) == 0).alias("held"))


def template_pairs(spark: SparkSession) -> DataFrame:
    """(family, n, size, gram, own): the word pairs of each template that grants a licence; own where no other family's
    templates have the pair."""
    shapes = templates(spark).where(F.col("family") != UNKNOWN).select("family", "n", pairs_of(F.col("w")).alias("g"))
    flat = shapes.select("family", "n", F.size("g").alias("size"), F.explode("g").alias("gram"))
    owners = flat.groupBy("gram").agg((F.count_distinct("family") == 1).alias("own"))
    return flat.join(F.broadcast(owners), "gram")


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", iterations: int = 40, penalty: float = 0.0003, unknown_documents: int = 400, unknown_rows: int = 2000, accepted: float = 0.01) -> Model:
    """The model of the templates and of at most unknown_rows windows of about unknown_documents of docs; the share accepted of the
    sample's unseen windows is above its bound."""
    spark = docs.sparkSession
    rows = template_windows(spark).unionByName(unknown_windows(docs, text, key, unknown_documents, unknown_rows))
    rows = stash(with_grams(rows.coalesce(1)), "licence-windows")
    number = F.coalesce(*[F.when(F.col("family") == c, F.lit(float(i))) for i, c in enumerate(CLASSES)])

    def learn(train: DataFrame) -> tuple[CountVectorizerModel, LogisticRegressionModel]:
        # the vocabulary is that of the templates: their number bounds it
        vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=1 << 15).fit(train.where(F.col("n") != SAMPLE))
        sizes = train.groupBy("family", "n").agg(F.count("*").alias("windows"))
        kinds = sizes.groupBy("family").agg(F.count("*").alias("kinds"))
        # each template weighs the same within its family, and each family as much as another; the sample counts for two
        share = 1000 / F.col("kinds") / F.col("windows") * F.when(F.col("n") == SAMPLE, 2 * F.col("kinds")).otherwise(1)
        weighted = train.join(F.broadcast(sizes), ["family", "n"]).join(F.broadcast(kinds), "family")  # a row a template
        ready = stash(vectors.transform(weighted).select("features", number.alias("label"), share.alias("weight")).coalesce(1), "licence-vectors")
        model = LogisticRegression(maxIter=iterations, regParam=penalty, family="multinomial", weightCol="weight", standardization=False).fit(ready)
        drop_stash(ready)
        return vectors, model

    vectors, model = learn(rows.where("not held"))
    scored = model.transform(vectors.transform(rows.where("held"))).select(vector_to_array("rawPrediction").alias("z"), number.cast("int").alias("y"))
    unseen = stash(scored, "licence-held")
    heats = unseen.withColumn("heat", F.explode(F.array(*[F.lit(x / 10) for x in (5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 40)])))
    loss = -F.log(F.greatest(softmax("z", "heat")[F.col("y")], F.lit(1e-12)))
    heat = heats.select("heat", loss.alias("loss")).groupBy("heat").agg(F.sum("loss").alias("loss")).orderBy("loss", "heat").first()[0]
    # a documents table without words leaves no sample: then it takes more than an even chance
    strange = unseen.where(F.col("y") == CLASSES.index(UNKNOWN)).agg(F.percentile(not_unknown(F.lit(heat)), F.lit(1 - accepted))).first()[0]
    vectors, model = learn(rows)
    drop_stash(rows, unseen)
    return Model(vectors, model.setProbabilityCol(""), heat, 0.5 if strange is None else strange)


def softmax(z: str, heat: Column | str) -> Column:
    heat = F.col(heat) if isinstance(heat, str) else heat
    top = F.array_max(z)
    powers = F.transform(z, lambda x: F.exp((x - top) / heat))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def not_unknown(heat: Column) -> Column:
    """Calibrated probability that a window (z) isn't of the unknown class, in one pass over the classes. z is bound to a variable, as
    Spark would otherwise score the window again for each class."""
    unknown = CLASSES.index(UNKNOWN)
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - z[unknown]) / heat))
    return F.transform(F.array("z"), lambda z: 1 - 1 / total(z))[0]


def license_paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", shared: float = 0.6, model: Model | None = None) -> DataFrame:
    """(key, line, family, probability, template_share, confirmed) of each window that the classifier doesn't take for unknown;
    probability is that of not being unknown."""
    spark = docs.sparkSession
    model = model or fit(docs, text, key)
    scored = model.classifier.transform(model.vectors.transform(with_grams(document_windows(docs, text, key))))
    scored = scored.select("id", "line", "w", vector_to_array("rawPrediction").alias("z")).withColumn("probability", not_unknown(F.lit(model.heat)))
    scored = scored.where(F.col("probability") > model.least)
    grants = F.array(*[F.struct(F.col("z")[i].alias("z"), F.lit(c).alias("f")) for i, c in enumerate(CLASSES) if c != UNKNOWN])
    negated = F.array_join("w", " ").rlike(NEGATED)
    scored = scored.select("id", "line", "w", F.array_max(grants)["f"].alias("family"), "probability", negated.alias("negated"))
    found = stash(scored.withColumn("uid", F.monotonically_increasing_id()), "licence-found")
    # share of a template's word pairs that the window holds, one of them at least its family's own
    own = found.select("uid", "family", F.explode(pairs_of(F.col("w"))).alias("gram"))
    hits = own.join(F.broadcast(template_pairs(spark)), ["family", "gram"])  # bounded by the templates
    hits = hits.groupBy("uid", "n", "size").agg(F.count("*").alias("hits"), F.max("own").alias("own")).where("own")
    share = hits.groupBy("uid").agg(F.max(F.col("hits") / F.col("size")).alias("template_share"))
    out = found.select("uid", "id", "line", "family", "probability", "negated").join(share, "uid", "left")
    out = out.withColumn("template_share", F.coalesce("template_share", F.lit(0.0)))
    known = ~F.col("negated") & (F.col("template_share") >= shared)
    return out.select(F.col("id").alias(key), "line", "family", "probability", "template_share", known.alias("confirmed"))


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, n_candidates, n_confirmed, families, probability) of each document: families is null without a licence,
    probability that of its surest confirmed paragraph."""
    found = license_paragraphs(docs, text, key, **options)
    sure = F.col("confirmed")
    found = found.groupBy(F.col(key).alias("_id")).agg(
        F.count("*").alias("n_candidates"),
        F.count_if(sure).alias("n_confirmed"),
        F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("families"),  # at most one a family
        F.max(F.when(sure, F.col("probability"))).alias("probability"),
    )
    out = docs.select(key).join(stash(found, "licences"), F.col(key).eqNullSafe(F.col("_id")), "left")
    zero = F.lit(0).cast("bigint")
    plain = F.transform("families", lambda f: F.when(f != SHARED, f).when(~F.array_contains("families", STRONGER), STANDS_FOR))
    plain = F.array_sort(F.array_distinct(F.filter(plain, lambda f: f.isNotNull())))
    names = F.when(F.size(plain) > 0, F.array_join(plain, ","))
    return out.select(key, F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), names.alias("families"), F.round("probability", 4).alias("probability"))
