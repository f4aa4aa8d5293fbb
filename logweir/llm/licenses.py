"""License scans, native: a trained paragraph classifier over sparse word n-grams.

Model. Multinomial logistic regression over word unigrams and bigrams with a class for each licence
family and one for everything else. It is trained here, on the driver, from notices of each family
(varied by dropping and adding words) against general sentences and at most ``SAMPLE`` paragraphs of
the documents, drawn from all of them, of which training reads ``SAMPLE_CHARS`` characters each. Which
words of notices are common, and so speak for nothing, is counted over every paragraph of every
document that holds no licence phrase. Temperature and the bias of the unknown class are calibrated on
notices whose wordings a first fit has not seen: a paragraph is a candidate where the licence classes
together have probability 0.5 or more. Weights are then pruned to the ``FEATURES`` strongest n-grams,
a bounded table.

Confirmation. A candidate is compared with the whole notices of its family, as templates: the share of
a template's n-grams that the paragraph holds, each weighed by the rarity of its rarest word in the
corpus. The family stands if one template is covered by ``COVER``, unless the words before "license" name one
that no notice knows, which speaks against every family; else it is an unknown licence.

Plan. Only DataFrame functions run on the executors. A paragraph is a run of lines without a blank one
between them, so a notice that is wrapped is seen whole. A paragraph that has none
of the words that speak for a licence cannot pass the threshold, so one regular expression drops it
first, before anything is exploded; for what is left, features are looked up in a map literal and
summed by higher-order functions. Results are added up for each document by an aggregation that
combines before its exchange. Equal paragraphs score alike and are never gathered.

Edge cases. A null or empty text has no paragraphs. Rows that repeat
a doc_id are returned one by one. Null doc_ids are scanned like others. Very long paragraphs are
scanned whole. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import ascii_lower, least_hashes, table

SAMPLE, SAMPLE_CHARS, FEATURES, COVER, THRESHOLD = 1500, 4000, 1200, 0.6, 0.5
#: What parts paragraphs, and words around a notice in training.
BREAK, AROUND = "\n[ \t\r\x0b\x0c]*\n\\s*", (0, 4, 12, 60, 400)
#: Share of background paragraphs from which on a word is common.
COMMON = 0.005
OTHER = "none"
# Public notices of each family, a paragraph each, which are its templates.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
        "This code is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Distributed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "Distributed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This service is distributed under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Shared under CC BY-NC-SA 4.0 for non-commercial use.",
    ],
    "cc-by-sa": [
        "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License.",
        "Licensed under CC BY-SA 3.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This article is distributed under a Creative Commons Attribution 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "This material is proprietary and confidential; unauthorized copying is prohibited.",
    ],
}
#: Phrases that leave no doubt; paragraphs that hold one are not counted as general text.
KEYS = {
    "apache": ["apache license", "apache 2.0", "apache-2.0"],
    "mit": ["mit license", "permission is hereby granted free of charge", "license-identifier mit"],
    "gpl": ["gnu general public license", "gpl version", "gpl-3.0-or-later", "gpl-2.0", "gpl-3.0"],
    "lgpl": ["gnu lesser general public license", "lgpl version", "lgpl-2.1-only", "lgpl-3.0"],
    "agpl": ["gnu affero general public license", "agpl version", "agpl-3.0-only"],
    "bsd": ["redistribution and use in source and binary forms", "bsd 3-clause", "bsd-style license", "bsd-2-clause", "bsd license"],
    "mpl": ["mozilla public license", "mpl-2.0"],
    "cc-by-nc": ["cc by-nc", "cc by-nc-sa", "creative commons attribution-noncommercial"],
    "cc-by-sa": ["cc by-sa", "creative commons attribution-sharealike"],
    "cc-by": ["cc by", "creative commons attribution"],
    "public-domain": ["public domain", "cc0 1.0", "cc0-1.0"],
    "proprietary": ["all rights reserved", "proprietary and confidential"],
}
GENERAL = [
    "He renewed his driver license at the office in town.",
    "The restaurant lost its license to sell beer.",
    "A version of this story was released last year under another name.",
    "The general public was free to use the source of the river.",
    "The Apache helicopter landed under cover of the night.",
    "Students at MIT released a study of common birds.",
    "The work is done, and all of it is under review.",
    "The following conditions are met by few of the documents.",
    "Terms of the contract were published by the foundation.",
    "She was granted permission to copy the letter free of charge.",
    "Software is written by people and read by machines.",
    "The rights of others are reserved for another chapter.",
    "In the public garden a gnu was seen among lesser animals.",
    "Creative people share an attribution to common sources.",
]
#: Words that a licence's name stands before, and how far before.
LICENCE, NAME = ["license", "licence", "licenses", "licences"], 3
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
PHRASE = "(?<![a-z0-9])(?:" + "|".join(re.escape(k) for keys in KEYS.values() for k in keys) + ")"


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _vocabulary() -> tuple[set[str], set[str]]:
    """The words of all notices, and those that notices of several families have."""
    held = Counter(w for notices in NOTICES.values() for w in {w for notice in notices for w in tokens(notice)})
    return set(held), {w for w, n in held.items() if n > 1}


def other_name(words: list[str]) -> bool:
    """Whether every licence that is named is one that no notice knows: of the words before "license",
    the nearest that several families do not share is in no notice."""
    known, shared = _vocabulary()
    marks = [i for i, w in enumerate(words) if w in LICENCE]
    deciding = [next((w for w in reversed(words[max(0, i - NAME) : i]) if w not in shared), None) for i in marks]
    return bool(marks) and all(w is not None and w not in known for w in deciding)


def rarity(word_counts: dict[str, int], counted: int) -> dict[str, float]:
    """The weight of each n-gram of the notices: how rare its rarest word is in general text."""
    own = {g for notices in NOTICES.values() for notice in notices for g in grams(tokens(notice))}
    return {g: round(max(math.log((counted + 2) / (word_counts.get(w, 0) + 1)) for w in g.split()), 4) for g in own}


class Model:
    """Pruned weights: n-gram to one weight a class; classes are families in order, then OTHER."""

    def __init__(self, weights: dict[str, list[float]], bias: list[float], cues: list[str], rare: dict[str, float]):
        """cues: each n-gram that lifts some family over OTHER has one of these words, so that a
        paragraph without any scores no more than the biases give. rare: weights of templates' n-grams."""
        self.weights, self.bias, self.cues, self.rare, self.classes = weights, bias, cues, rare, [*NOTICES, OTHER]
        if self.probabilities("")[-1] <= 1 - THRESHOLD:
            raise ValueError("the biases alone pass the threshold")

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias)
        for g in sorted(grams(tokens(text))):
            z = z + np.array(self.weights.get(g, 0.0))
        e = np.exp(z - z.max())
        return e / e.sum()

    def coverage(self, family: str, text: str) -> float:
        """The best cover of a template of the family."""
        have = grams(tokens(text))
        return max(sum(self.rare[g] for g in need & have) / sum(self.rare[g] for g in need) for need in (grams(tokens(n)) for n in NOTICES[family]))


def holds_phrase(words: list[str]) -> bool:
    """Whether words hold a key phrase, at the start of a word."""
    return re.search(PHRASE, " ".join(words)) is not None


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _shares(y: np.ndarray) -> np.ndarray:
    """What each row counts: families alike, and all of them together as much as the class of no licence."""
    share = y / np.maximum(y.sum(axis=0), 1)
    share[:, -1] *= y.shape[1] - 1
    share = share.sum(axis=1)
    return share / share.sum()


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by gradient steps with momentum."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    share, speed = _shares(y)[:, None], np.zeros_like(w)
    for _ in range(300):
        speed = 0.9 * speed - 4.0 * (x.T @ (share * (_softmax(x @ w) - y)) + 1e-4 * w)
        w += speed
    return w


def train(paragraphs: list[str], spread: tuple[dict[str, int], int] | None = None, *, seed: int = 7, features: int = FEATURES) -> Model:
    """Fits on varied notices against general and sampled paragraphs.

    spread: what ``word_spread`` counted over the corpus; without it, the paragraphs are counted."""
    rng, rows, labels, unseen = random.Random(seed), [], [], []
    background = [tokens(p) for p in [*GENERAL * 8, *paragraphs]]
    background = [b for b in background if b and not holds_phrase(b)]
    for c, notices in enumerate(NOTICES.values()):
        for n, notice in enumerate(notices):
            words = tokens(notice)
            for k in range(24):
                own = [w for w in words if k == 0 or rng.random() > 0.08]
                around = rng.choice(background)[: rng.choice(AROUND)] if k % 3 else []
                rows.append([*around, *own] if k % 2 else [*own, *around])
                labels.append(c)
                # One wording of each family is new to the fit that calibrates.
                unseen.append(n == len(notices) - 1)
    rows += background
    labels += [len(NOTICES)] * len(background)
    unseen += [k % 5 == 4 for k in range(len(background))]
    # Only n-grams of notices can speak for a licence; the bias speaks for everything else. Those
    # made of words that are common anywhere speak for nothing.
    if spread is None:
        plain = [w for w in map(tokens, paragraphs) if not holds_phrase(w)]
        spread = Counter(word for w in plain for word in set(w)), len(plain)
    held_by, counted = spread
    rare = lambda word: not word.isdigit() and held_by.get(word, 0) <= COMMON * counted
    vocabulary = sorted({g for notices in NOTICES.values() for notice in notices for g in grams(tokens(notice)) if any(map(rare, g.split()))})
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [index[g] for g in grams(r) if g in index]] = 1
    y, held = np.eye(len(NOTICES) + 1, dtype=np.float32)[labels], np.array(unseen)
    guess = x[held] @ _fit(x[~held], y[~held])
    best = min(((t, b) for t in (0.5, 0.75, 1.0, 1.5, 2.0) for b in (0.0, 1.0, 2.0, 3.0)), key=lambda tb: _loss(guess, y[held], *tb))
    w = _fit(x, y)
    strong = np.argsort(-(w[:-1, :-1].max(axis=1) - w[:-1, -1]), kind="stable")[:features]
    kept = np.zeros(len(w), bool)
    kept[strong] = True
    kept[-1] = True
    w[~kept] = 0
    w = w * best[0]
    w[-1, -1] += best[1]
    cues = {min(vocabulary[i].split(), key=lambda word: (held_by.get(word, 0), word)) for i in strong if w[i, :-1].max() > w[i, -1]}
    return Model({vocabulary[i]: [round(float(v), 4) for v in w[i]] for i in strong}, [round(float(v), 4) for v in w[-1]], sorted(cues), rarity(held_by, counted))


def _loss(z: np.ndarray, y: np.ndarray, temperature: float, bias: float) -> float:
    z = z * temperature
    z[:, -1] += bias
    z = z - z.max(axis=1, keepdims=True)
    own = -(y * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum(axis=1)
    return float((own * _shares(y)).sum())


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classified(paragraphs: DataFrame, model: Model, *, threshold: float = THRESHOLD, cover: float = COVER) -> DataFrame:
    """Adds family (null: no licence; "unknown": a licence of no confirmed family) and probability
    to rows with a column ``paragraph``."""
    words = F.regexp_extract_all(_lower(F.col("paragraph")), F.lit(f"({WORD})"), 1)
    pairs = F.zip_with(F.slice("__w", 1, F.greatest(F.size("__w") - 1, F.lit(0))), F.slice("__w", 2, F.greatest(F.size("__w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    lookup = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    bias = F.array(*[F.lit(v) for v in model.bias])
    rows = paragraphs.withColumn("__w", words)
    # The vocabulary first, by a hashed intersection, then weights of the few n-grams that are left.
    known = F.array_intersect(F.array_union(F.col("__w"), pairs), F.from_json(F.lit(json.dumps(sorted(model.weights))), "array<string>"))
    rows = rows.withColumn("__g", F.array_union("__w", pairs)).withColumn("__z", F.aggregate(known, bias, lambda z, g: F.zip_with(z, F.element_at(lookup, g), lambda a, b: a + b)))
    top = F.array_max("__z")
    rows = rows.withColumn("__p", F.transform("__z", lambda z: F.exp(z - top)))
    total = F.aggregate("__p", F.lit(0.0), lambda s, p: s + p)
    rows = rows.withColumn("probability", 1 - F.element_at("__p", len(model.classes)) / total)
    families = F.slice("__p", 1, len(model.classes) - 1)
    best = F.array_position(families, F.array_max(families)).cast("int")
    guess = F.element_at(F.array(*[F.lit(c) for c in NOTICES]), best)
    rare = F.from_json(F.lit(json.dumps(model.rare)), "map<string,double>")
    confirmed = F.lit(False)
    for family, notices in NOTICES.items():
        shares = []
        for notice in notices:
            need = sorted(grams(tokens(notice)))
            held = F.aggregate(F.array_intersect("__g", F.array(*map(F.lit, need))), F.lit(0.0), lambda s, g: s + F.element_at(rare, g))
            shares.append(held / sum(model.rare[g] for g in need))
        confirmed = F.when(F.col("__guess") == family, F.greatest(*shares) >= cover).otherwise(confirmed)
    known, shared = ([*map(F.lit, sorted(v))] for v in _vocabulary())
    known, shared = F.array(*known), F.array(*shared)
    places = F.when(F.size("__w") > 0, F.sequence(F.lit(1), F.size("__w"))).otherwise(F.array().cast("array<int>"))
    marks = F.filter(places, lambda i: F.element_at("__w", i).isin(LICENCE))

    def strange(i: Column) -> Column:
        before = F.reverse(F.slice("__w", F.greatest(i - NAME, F.lit(1)), F.least(i - 1, F.lit(NAME))))
        deciding = F.get(F.filter(before, lambda w: ~F.array_contains(shared, w)), F.lit(0))
        return F.coalesce(~F.array_contains(known, deciding), F.lit(False))

    confirmed = confirmed & ~((F.size(marks) > 0) & F.forall(marks, strange))
    rows = rows.withColumn("__guess", guess)
    family = F.when(F.col("probability") >= threshold, F.when(confirmed, F.col("__guess")).otherwise("unknown"))
    return rows.withColumn("family", family).drop("__w", "__g", "__z", "__p", "__guess")


def candidates(text: Column, model: Model) -> Column:
    """The paragraphs of a text that may pass the threshold."""
    cue = "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in model.cues) + ")(?![a-z0-9])"
    return F.filter(paragraphs_of(text), lambda p: p.rlike(cue))


def paragraphs_of(text: Column) -> Column:
    """Runs of lines that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK, -1), lambda p: p.rlike("[^ \\t\\r\\n\\x0b\\x0c]"))


def _lines(docs: DataFrame) -> DataFrame:
    """Every paragraph of every row, with its place."""
    return docs.select("doc_id", F.posexplode(paragraphs_of(F.col("text"))).alias("pos", "p"))


def word_spread(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many paragraphs each word of the notices is, and the number of paragraphs; those that
    hold a licence phrase count in neither."""
    own = sorted({w for notices in NOTICES.values() for notice in notices for w in tokens(notice)})
    rows = _lines(docs).select(F.regexp_extract_all(ascii_lower(F.col("p")), F.lit(f"({WORD})"), 1).alias("w"))
    # The empty word stands for the paragraph. An outer explode infers no filter, which would be
    # pushed down and extract the words twice.
    held = F.when(~F.array_join("w", " ").rlike(PHRASE), F.concat(F.array_intersect("w", F.array(*map(F.lit, own))), F.array(F.lit(""))))
    counts = rows.select(F.explode_outer(held).alias("word")).groupBy("word").count().where("word IS NOT NULL")
    found = {r["word"]: r["count"] for r in counts.collect()}
    return found, found.pop("", 0)


def sample_paragraphs(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """A bounded sample of all paragraphs, those with the least hashes."""
    rows = _lines(docs).select(F.xxhash64("doc_id", "pos", "p").alias("h"), F.substring("p", 1, SAMPLE_CHARS).alias("p"))
    return [r["p"] for r in least_hashes(rows, "h", size).collect()]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """For each row: doc_id, n_paragraphs, n_licence, n_unknown, families, best probability."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__row"), "text")
    found = classified(keyed.select("doc_id", "__row", F.explode(candidates(F.col("text"), model)).alias("paragraph")), model)
    # Repeated rows classify the same paragraphs; min over equal rows keeps counts a row's own.
    # No filter on family: pushed below the projections it would compute all of them twice.
    per = found.groupBy("doc_id", "__row").agg(
        F.count("family").alias("hits"), F.count_if(F.col("family") == "unknown").alias("unknown"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability")
    ).withColumnsRenamed({"doc_id": "__d", "__row": "__r"})
    lines = F.size(paragraphs_of(F.col("text")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("__row"), lines.cast("long").alias("n_paragraphs"))
    copies = rows.groupBy("doc_id", "__row").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").withColumnsRenamed({"doc_id": "__d2", "__row": "__r2"})
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["__d"]) & (rows["__row"] == per["__r"]), "left")
    out = out.join(copies, out["doc_id"].eqNullSafe(copies["__d2"]) & (out["__row"] == copies["__r2"]), "left")
    times = F.coalesce("copies", F.lit(1))
    return out.select(
        "doc_id", "n_paragraphs",
        F.coalesce((F.col("hits") / times).cast("long"), F.lit(0)).alias("n_licence"),
        F.coalesce((F.col("unknown") / times).cast("long"), F.lit(0)).alias("n_unknown"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.round(F.coalesce("probability", F.lit(0.0)), 6).alias("probability"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(sample_paragraphs(docs), word_spread(docs)))
