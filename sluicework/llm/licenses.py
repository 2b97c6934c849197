"""Licence scans by sparse TF-IDF cosine to templates, and inheritance from the nearest directory above.

Every sentence of every text is compared with the short notices; every paragraph and every text as a whole, with
the standard headers and full licence texts; SPDX lines are read as they are.  A sentence that is as near as ``THRESHOLD``
to a template shares one of its telling words: words on the list ``COMMON`` carry so little of every
template's weight that they can't reach the threshold alone (Cauchy-Schwarz; checked when the templates are
weighed).  So only sentences with a telling word are split into words; all others have been decided.

Everything is DataFrame operations; the weighed templates are a constant table.
"""

from __future__ import annotations

import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, settled

THRESHOLD = 0.7

# Short notices of common licences by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution 4.0 International."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under Creative Commons Attribution ShareAlike 4.0 International."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Words too common to point to a licence.
COMMON = ("all", "and", "by", "into", "is", "of", "or", "the", "this", "to", "under", "0", "1", "2", "3", "4")

# Standard headers that don't begin with a short notice, one distinguishing paragraph each.
_GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
HEADERS = (
    ("AGPL-3.0", _GNU.format("program", "Affero ", 3)),
    ("GPL-2.0", _GNU.format("program", "", 2)),
    ("GPL-3.0", _GNU.format("program", "", 3)),
    ("LGPL-3.0", _GNU.format("library", "Lesser ", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((n, f"Distributed under the {t} license, see the file LICENSE for details.") for n, t in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("Apache-2.0", "Apache 2.0"))),
)
#: Full texts, a file for each licence.
TEXTS = Path(__file__).resolve().parent / "licence_texts"
# Words that count nothing in headers and full texts.
STOP = frozenset("a all an and any are as at be been by can do does for from has have if in into is it its may must no not of on or other our shall should such that the their then there these they this those to under upon was we were what when where which who will with without would you your".split())
# Numbers and a German word, which tell of a licence only where the others don't carry enough weight.
EVERYDAY = frozenset(("0", "1", "2", "3", "mit"))
#: Parts of a file between lines without a letter or digit.
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"
TAG = "SPDX-License-Identifier:"

SENTENCE = r"\n|(?<=[.!?;])[ \t]+"
TOKEN = "[^a-z0-9]+"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(TOKEN, text.lower()) if w]


def weigh(templates: tuple = TEMPLATES) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """(unit vector of each template, idf of each word, idf of words in no template); smoothed idf over the templates."""
    bags = {name: tokens(t) for name, t in templates}
    n = len(bags)
    df = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}
    vectors = {}
    for name, b in bags.items():
        v = {w: b.count(w) * idf[w] for w in b}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[name] = {w: x / norm for w, x in v.items()}
    for name, v in vectors.items():
        if math.sqrt(sum(x * x for w, x in v.items() if w in COMMON)) >= THRESHOLD:
            raise ValueError(f"the common words alone could match {name}")
    return vectors, idf, math.log(1 + n) + 1


@cache
def weigh_long() -> tuple[list[tuple[str, str, float]], dict[str, float], float, frozenset[str]]:
    """(weights (word, template, weight) of headers and full texts, idf, idf of unseen words, telling words).

    A template is named ``licence#number``.  Its telling words are its heaviest ones, everyday words last, until
    the others can't reach the threshold (Cauchy-Schwarz).
    """
    texts = [*HEADERS, *((p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt")))]
    bags = {f"{name}#{i}": [w for w in tokens(t) if w not in STOP] for i, (name, t) in enumerate(texts)}
    df = {w: sum(w in set(b) for b in bags.values()) for w in {w for b in bags.values() for w in b}}
    idf = {w: math.log((1 + len(bags)) / (1 + d)) + 1 for w, d in df.items()}
    weights, telling = [], set()
    for name, b in bags.items():
        v = {w: b.count(w) * idf[w] for w in set(b)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda e: (e[0] in EVERYDAY, -e[1], e[0])):
            weights.append((w, name, x / norm))
            if rest >= THRESHOLD**2 - 1e-6:
                telling.add(w)
                rest -= (x / norm) ** 2
    return weights, idf, math.log(1 + len(bags)) + 1, frozenset(telling)


def long_matches(files: DataFrame, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, at, score, licence) of paragraphs and whole files (at = 0) near a header or full text, and of SPDX lines."""
    weights, idf, unseen, telling = weigh_long()
    spark = files.sparkSession
    known = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', {x!r}D)" for w, x in sorted(idf.items())) + " AS t(w, idf)")
    weight = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', '{n}', {x!r}D)" for w, n, x in sorted(weights)) + " AS t(w, template, weight)")
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(telling)) + r")(?![a-z0-9])"
    part = F.split(text_col, PARAGRAPH)
    units = F.concat(F.transform(part, lambda s, i: F.struct(i.alias("at"), F.lit(False).alias("whole"), s.alias("s"))), F.when(F.size(part) > 1, F.array(F.struct(F.lit(0).alias("at"), F.lit(True).alias("whole"), F.col(text_col).alias("s")))).otherwise(F.array()))
    unit = files.where(F.col(text_col).rlike(pattern)).select(*keys, F.explode(units).alias("u")).select(*keys, "u.*").where(F.col("s").rlike(pattern))
    by = (*keys, "at", "whole")
    word = unit.select(*by, F.explode(F.split(F.lower("s"), TOKEN)).alias("w")).where((F.col("w") != "") & ~F.col("w").isin(*sorted(STOP)))
    tf = word.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("tf"))
    x = tf.join(F.broadcast(known), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))  # a constant table
    norm = x.groupBy(*by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = x.where("idf is not null").join(F.broadcast(weight), "w").groupBy(*by, "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot")).where(f"dot >= {THRESHOLD}")
    near = dot.join(norm, list(by)).select(*keys, "at", F.round(F.col("dot") / F.col("norm"), 9).alias("score"), F.substring_index("template", "#", 1).alias("licence")).where(F.col("score") >= THRESHOLD)
    ids = {n.lower(): n for n, _ in TEMPLATES}
    # every identifier of every line that has the tag; words of the expression itself name no licence
    line = files.where(F.col(text_col).contains(TAG)).select(*keys, F.posexplode(F.split(text_col, "\n")).alias("at", "s")).where(F.col("s").contains(TAG))
    each = line.select(*keys, "at", F.explode(F.regexp_extract_all(F.substring_index("s", TAG, -1), F.lit(r"[A-Za-z0-9.+-]*[A-Za-z0-9+]"), F.lit(0))).alias("name"))
    spdx = each.select(*keys, "at", F.regexp_replace(F.lower("name"), r"(-only|-or-later|\+)$", "").alias("name")).distinct()
    named = spdx.where(F.col("name").isin(*ids)).select(*keys, "at", F.lit(1.0).alias("score"), F.element_at(F.create_map(*(F.lit(v) for e in ids.items() for v in e)), F.col("name")).alias("licence"))
    return near.unionByName(named)


def telling_pattern(idf: dict[str, float]) -> str:
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(w for w in idf if w not in COMMON)) + r")(?![a-z0-9])"


def template_matches(files: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("path", "th")) -> DataFrame:
    """Keys, ``licence``, ``score``, ``first``, ``every``: the best template of each file that reaches the threshold, and all that do, by name.

    A licence comes before "All rights reserved.", a line of many of them.  Ties go to the licence that comes first by name, then to the earlier sentence; ``first`` tells that the
    sentence or paragraph is the file's first, or that it is the whole file.
    """
    vectors, idf, unseen = weigh()
    names = sorted(vectors)
    telling = telling_pattern(idf)
    spark = files.sparkSession
    values = ", ".join(f"('{w}', {idf[w]!r}D, array({', '.join(f'{vectors[n].get(w, 0.0)!r}D' for n in names)}))" for w in sorted(idf))
    words = spark.sql(f"SELECT * FROM VALUES {values} AS t(w, idf, weights)")
    sentence = files.where(F.col(text_col).rlike(telling)).select(*keys, F.posexplode(F.split(text_col, SENTENCE)).alias("at", "s")).where(F.col("s").rlike(telling))
    word = sentence.select(*keys, "at", F.explode(F.split(F.lower("s"), TOKEN)).alias("w")).where("w <> ''")
    tf = word.groupBy(*keys, "at", "w").agg(F.count(F.lit(1)).alias("tf"))
    x = tf.join(F.broadcast(words), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))  # a constant table
    dots = [F.round(F.sum(F.coalesce(F.get("weights", F.lit(i)), F.lit(0.0)) * F.col("x")) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 9).alias(f"_{i}") for i in range(len(names))]
    scored = x.groupBy(*keys, "at").agg(*dots)
    best = F.greatest(*(F.col(f"_{i}") for i in range(len(names))))
    name: Column = F.lit(None).cast("string")
    for i in reversed(range(len(names))):
        name = F.when(F.col(f"_{i}") == best, F.lit(names[i])).otherwise(name)
    hit = scored.select(*keys, "at", best.alias("score"), name.alias("licence")).where(F.col("score") >= THRESHOLD)
    hit = hit.unionByName(long_matches(files, text_col, keys))
    top = hit.groupBy(*keys).agg(F.min(F.struct((F.col("licence") == "Proprietary").alias("p"), (-F.col("score")).alias("s"), "licence", "at")).alias("b"), F.array_sort(F.collect_set("licence")).alias("every"))
    return top.select(*keys, "b.licence", (-F.col("b.s")).alias("score"), (F.col("b.at") == 0).alias("first"), "every")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", is_licence_file: Column | None = None) -> DataFrame:
    """``files`` without their text, with ``own_licence``, ``score``, ``own_licences``, ``inherited_licence``, ``inherited_from`` and ``licence``.

    A licence file gives its licence to its directory and all below that have none nearer: files that match
    and satisfy ``is_licence_file`` (a condition over ``path`` and ``first``; by default a base name that
    starts with LICENSE, LICENCE or COPYING).  Of several in a directory the first path counts.  A file's own
    match comes before what it inherits.  ``own_licence`` is the best match alone, ``own_licences`` are all of a file,
    those of SPDX expressions included.  Null texts have no match; files with a null path keep their own match, but
    give and inherit nothing.  Repeated paths are files each.  Columns named like those added are replaced.  Nearest
    directories are found for directories, not files, by joins over their ancestors.
    """
    cond = is_licence_file if is_licence_file is not None else F.regexp_extract("path", "[^/]*$", 0).rlike("^(?i)(LICEN[SC]E|COPYING)")
    added = ("own_licence", "score", "own_licences", "inherited_licence", "inherited_from", "licence", "path")
    rest = [c for c in files.columns if c not in (text_col, path_col, *added)]
    # the caller's columns travel as one struct, so that none meets a name used here
    keyed = files.select(packed(files, text_col, path_col, *added).alias("_row"), F.col(f"`{path_col}`").cast("string").alias("path"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("_text"))
    # read twice below, and small
    found = settled(template_matches(keyed.where("_text is not null"), "_text"))
    given = found.where(cond & F.col("path").isNotNull()).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.min_by("licence", F.struct("path", "licence")).alias("licence"))
    narrow = keyed.drop("_text").withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    dirs = narrow.select("dir").where("dir is not null").distinct()
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))
    above = dirs.select("dir", F.posexplode(steps).alias("depth", "up"))
    nearest = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("licence", "up"), F.col("depth")).alias("n"))
    own = found.select(F.col("path").alias("_path"), F.col("th").alias("_th"), F.col("licence").alias("own_licence"), "score", F.col("every").alias("own_licences"))
    out = narrow.join(own, narrow["path"].eqNullSafe(own["_path"]) & (narrow["th"] == own["_th"]), "left").join(nearest, "dir", "left")
    columns = [F.col(f"_row.`{c}`") for c in rest]
    return out.select(*columns, "path", "own_licence", "score", "own_licences", F.col("n.licence").alias("inherited_licence"), F.col("n.up").alias("inherited_from"), F.coalesce("own_licence", "n.licence").alias("licence"))
