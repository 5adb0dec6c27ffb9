"""License scans by sparse TF-IDF cosine and directory inheritance (operator 5). DataFrame functions only.

1. Units: every text that mentions a licence, a copyright or the like is compared as a whole, and so are its header blocks
   (paragraphs that mention one, neighbouring ones joined, and lines joined with their neighbours around a
   mention) and the sentences that mention one, by line and across wrapped lines. Marks at the start of lines
   (comment signs, indents) don't count, nor do blank lines inside a block of comments.
2. Each distinct unit is a sparse vector of its words' TF-IDF, with document frequencies over the distinct units and
   the templates. Its cosine with each template is a join by term and a grouped sum; terms that no template has
   only lengthen the vector. A unit that very many files share is compared once.
3. A unit's licence is that of its most similar template, from ``MIN_SIMILARITY`` on. A file's licence is that of its
   unit with the longest projection on its template (cosine times length), so that a whole licence text or header
   counts before a sentence of it that several licences share.
   A licence file (by its name, because such sentences are at least half of its words, or because the whole text is
   similar to a whole licence text) is the statement of its directory.
4. A file without one inherits from the nearest ancestor directory with a licence file: the distinct
   directories are joined with their ancestors' paths, the longest match wins, and files join their directory.

The templates below are a bounded table: sentences, standard headers, and the licence texts in ``license_texts``. Ties
go to the smaller licence name. In
one directory the licence of most licence files counts, ties to the smaller name.

A null text counts as empty; a null path has no directory and inherits nothing; repeated paths are each judged
for themselves. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import saved

MIN_SIMILARITY = 0.45

#: Licence names and texts of notices and first paragraphs.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "licensed under the 2-clause BSD license"),
    ("BSD-3-Clause", "licensed under the 3-clause BSD license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright. All rights reserved"),
    ("Proprietary", "Confidential and proprietary, unauthorized copying is strictly prohibited"),
)

#: GNU licences: name in our table, name in the header, version, what the header calls the work.
GNU = (
    ("GPL-2.0", "General Public License", "2", "program"),
    ("GPL-3.0", "General Public License", "3", "program"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0", "Lesser General Public License", "3", "library"),
    ("AGPL-3.0", "Affero General Public License", "3", "program"),
)

#: Standard headers that aren't GNU's.
HEADERS = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)

#: The AGPL's own parts; the rest of its text is the GPL's.
_AFFERO = (
    "GNU Affero General Public License Version 3, 19 November 2007. The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
    "specifically designed to ensure cooperation with the community in the case of network server software. A secondary benefit of defending all users' freedom is that improvements made in "
    "alternate versions of the program, if they receive widespread use, become available for other developers to incorporate. The GNU Affero General Public License is designed specifically to "
    "ensure that, in such cases, the modified source code becomes available to the community. It requires the operator of a network server to provide the source code of the modified version "
    "running there to the users of that server. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, "
    "your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
    "Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."
)


def _headers() -> list[tuple[str, str]]:
    """Standard headers: of GNU's the notice, the notice with its version only, and all three paragraphs."""
    out = list(HEADERS)
    for license, name, version, work in GNU:
        grant = f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
        later = f"{grant}; either version {version} of the License, or (at your option) any later version."
        rest = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {work}. If not, see https://www.gnu.org/licenses/."
        out += [(license, later), (license, f"{grant}; version {version} of the License."), (license, f"{later} {rest}")]
    return out


def _texts() -> list[tuple[str, str]]:
    """Whole licence texts."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    gpl = texts["GPL-3.0"]
    shared = gpl[gpl.index("For the developers' and") : gpl.index("13. Use with")] + gpl[gpl.index("14. Revised") :]
    return [*texts.items(), ("AGPL-3.0", _AFFERO + shared.replace("GNU General", "GNU Affero General"))]


def templates() -> list[tuple[str, str, bool]]:
    """(license, notice, whether it is a whole licence text)."""
    named = [(license, f"licensed under the GNU {name}, version {version}", False) for license, name, version, _ in GNU]
    return [*((*t, False) for t in TEMPLATES), *named, *((*t, False) for t in _identifiers()), *((*t, False) for t in _headers()), *((*t, True) for t in _texts())]


#: Identifiers of the SPDX list for the licences above that aren't the licence's name itself.
IDENTIFIERS = (
    ("GPL-2.0", "GPL-2.0-only"),
    ("GPL-2.0", "GPL-2.0-or-later"),
    ("GPL-3.0", "GPL-3.0-only"),
    ("GPL-3.0", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1-only"),
    ("LGPL-2.1", "LGPL-2.1-or-later"),
    ("LGPL-3.0", "LGPL-3.0-only"),
    ("LGPL-3.0", "LGPL-3.0-or-later"),
    ("AGPL-3.0", "AGPL-3.0-only"),
    ("AGPL-3.0", "AGPL-3.0-or-later"),
)


def _identifiers() -> list[tuple[str, str]]:
    """Lines that name a licence by its identifier."""
    names = dict.fromkeys(license for license, *_ in (*TEMPLATES, *GNU) if license != "Proprietary")
    return [(license, f"SPDX-License-Identifier: {name}") for license, name in (*((n, n) for n in names), *IDENTIFIERS)]


#: What a sentence must hold to be a candidate, in lower case.
MENTIONS = ("licen", "copyright", "rights reserved", "public domain", "permission", "redistribut", "creative commons", "proprietary", "spdx")


def _mentions(text: Column) -> Column:
    found = F.lit(False)
    for m in MENTIONS:
        found = found | F.contains(text, F.lit(m))
    return found


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+-]+", " "), r"[. ]*(?: |$)[. ]*"), lambda t: t != "")


def _marked(array: Column, mark: str) -> Column:
    """The items joined by newlines, those without a mention replaced by ``mark``."""
    return F.array_join(F.transform(array, lambda x: F.when(_mentions(x), x).otherwise(F.lit(mark))), "\n")


def _units(lowered: Column, sentences: Column) -> Column:
    """What is compared of a text: sentences by line, sentences across wrapped lines, paragraphs, runs of paragraphs, and
    lines with their neighbours."""
    plain = F.regexp_replace(F.regexp_replace(lowered, "[\r\u0001-\u0003]", " "), r"(?m)^[^\p{L}\p{N}\n]+", "")
    paragraphs = F.filter(F.split(plain, r"\n\s*\n"), lambda p: p != "")
    wrapped = F.flatten(F.transform(F.filter(paragraphs, _mentions), lambda p: F.split(F.regexp_replace(p, r"\n", " "), r"(?<=[.;!?])\s+")))
    runs = F.split(_marked(paragraphs, "\u0001"), "\u0001")
    ends = F.transform(F.split(plain, r"\n"), lambda x: F.when(_mentions(x), F.concat(F.lit("\u0002"), x, F.lit("\u0002"))).otherwise(F.concat(F.lit("\u0001"), x, F.lit("\u0001"))))
    far = F.regexp_replace(F.array_join(ends, "\n"), "(?<!\u0002\n)\u0001[^\u0001]*\u0001(?!\n\u0002)", "\u0003")
    around = F.split(F.regexp_replace(far, "[\u0001\u0002]", ""), "\u0003")
    return F.concat(sentences, F.filter(F.concat(wrapped, paragraphs, runs, around), _mentions))


def _weights(vectors: DataFrame, frequency: DataFrame, n: int, key: str) -> DataFrame:
    """Normalised TF-IDF: key, term, w, norm."""
    idf = F.log((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighted = vectors.join(frequency, "term", "left").withColumn("w", F.col("tf") * idf).select(key, "term", "w")
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"), "norm")


def scan_licenses(files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """file_id, path, license, similarity, origin (header, file, inherited, none), from_directory."""
    files = files.select(F.col(id_col).alias("file_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = files.sparkSession
    keyed = F.xxhash64("file_id", "path", "text").alias("file")
    lowered = files.select(keyed, F.lower("text").alias("lowered")).filter(_mentions(F.col("lowered")))
    parts = F.filter(F.split("lowered", r"\n|(?<=[.;!?])\s+"), lambda s: _mentions(s))
    whole = F.size(F.filter(F.split(F.col("lowered"), r"\s+"), lambda t: t != "")).alias("n_words")
    cut = lowered.select("file", "lowered", whole, parts.alias("sentences"))
    spoken = F.aggregate("sentences", F.lit(0), lambda a, x: a + F.size(_terms(x))).alias("spoken")
    stripped = F.regexp_replace("lowered", r"(?m)^[^\p{L}\p{N}\n]+", "")
    pieces = F.transform(_units(F.col("lowered"), F.col("sentences")), lambda x: F.struct(x.alias("unit"), F.lit(False).alias("whole")))
    units = F.concat(F.array(F.struct(stripped.alias("unit"), F.lit(True).alias("whole"))), pieces)
    exploded = cut.select("file", "n_words", spoken, F.explode(units).alias("u"))
    terms = exploded.select("file", "n_words", "spoken", "u.whole", _terms(F.col("u.unit")).alias("terms")).filter(F.size("terms") > 0)
    terms = terms.withColumn("unit", F.md5(F.array_join("terms", " ")))
    terms = saved(terms.groupBy("file", "unit").agg(F.max("whole").alias("whole"), F.first("n_words").alias("n_words"), F.first("spoken").alias("spoken"), F.first("terms").alias("terms")), "license-units")
    distinct = terms.select("unit", "terms").dropDuplicates(["unit"])

    names = spark.createDataFrame([(i, *t) for i, t in enumerate(templates())], "template int, license string, notice string, full boolean")
    template_terms = names.select("template", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    vectors = saved(distinct.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf")), "license-terms")
    frequency = saved(vectors.select("term").unionByName(template_terms.select("term")).groupBy("term").agg(F.count("*").alias("df")), "license-frequency")
    n = vectors.select("unit").distinct().count() + names.count()
    own = _weights(vectors, frequency, n, "unit")
    known = F.broadcast(_weights(template_terms, frequency, n, "template").select("template", "term", F.col("w").alias("tw")))  # a bounded table
    cosine = own.join(known, "term").groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("similarity"), F.max("norm").alias("norm"))
    named = cosine.join(F.broadcast(names.select("template", "license", "full")), "template")
    best = named.groupBy("unit").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), "license", (~F.col("full")).alias("part"), "norm")).alias("best"))
    matched = saved(best.select("unit", F.col("best.license").alias("license"), (-F.col("best.s")).alias("similarity"), (~F.col("best.part")).alias("full"), F.col("best.norm").alias("norm")).filter(F.col("similarity") >= min_similarity), "license-matched")
    told = terms.select("file", "unit", "whole", "n_words", "spoken").join(matched, "unit")
    longest = F.struct((-F.round(F.col("similarity") * F.col("norm"), 6)).alias("p"), "license", (-F.col("similarity")).alias("s"))
    found = told.groupBy("file").agg(F.min(longest).alias("best"), F.max(F.col("whole") & F.col("full")).alias("as_whole"), F.first("n_words").alias("n_words"), F.first("spoken").alias("spoken"))
    found = saved(found.select("file", F.col("best.license").alias("license"), (-F.col("best.s")).alias("similarity"), "as_whole", "n_words", "spoken"), "license-found")

    base = F.lower(F.element_at(F.split(F.col("path"), "/"), -1))
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    placed = files.select("file_id", "path", keyed, directory.alias("directory"), base.rlike(r"^(licen[sc]e|copying|notice|unlicense)([._-].*)?$").alias("by_name"))
    rows = placed.join(found, "file", "left")
    is_file = F.col("license").isNotNull() & (F.coalesce("by_name", F.lit(False)) | (F.col("spoken") * 2 >= F.col("n_words")) | F.col("as_whole"))
    rows = saved(rows.withColumn("is_file", is_file).select("file_id", "path", "directory", "license", "similarity", "is_file"), "license-rows")

    votes = rows.filter("is_file and directory is not null").groupBy("directory", "license").agg(F.count("*").alias("n"))
    stated = saved(votes.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).getField("license").alias("stated")), "license-stated")
    parts = F.split("directory", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))
    distinct = rows.filter("directory is not null").select("directory").distinct()
    paths = distinct.select("directory", F.explode(F.concat(prefixes, F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("ancestor"))))).alias("p")).select("directory", "p.depth", "p.ancestor")
    above = paths.join(stated.select(F.col("directory").alias("ancestor"), "stated"), "ancestor")
    nearest = saved(above.groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "stated")).alias("top")).select("directory", F.col("top.ancestor").alias("ancestor"), F.col("top.stated").alias("stated")), "license-nearest")
    joined = rows.join(nearest, "directory", "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("stated").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "file_id",
        "path",
        F.coalesce("license", "stated").alias("license"),
        F.round("similarity", 6).alias("similarity"),
        origin.alias("origin"),
        F.when(F.col("license").isNull(), F.col("ancestor")).alias("from_directory"),
    )
