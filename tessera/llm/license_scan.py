"""Licence scan: sparse TF-IDF cosine of lines, blocks and whole files to licences, inheritance from the nearest directory.

DataFrame operations only. Of each file with a licence cue its lines, paragraphs, header comment and whole text are sparse
vectors of their words. Their cosines to all notices and to all headers and full texts of licences come from one broadcast
join of their words with the templates' weights. A file that consists mostly of licence is a licence file and
speaks for its directory; a file without a licence of its own inherits from the nearest directory above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_join, materialize

#: Licence notices by identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "proprietary": "All rights reserved. No part may be reproduced without permission.",
}
#: Names of licences, as notices give them after one of ``GRANTS``; SPDX identifiers follow from the templates.
NAMES = {
    "MIT": ["mit license", "mit licence"],
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache-2.0 license"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3.0", "gpl-3.0 license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu general public license v2.0", "gpl-2.0 license"],
    "CC-BY-NC-4.0": ["creative commons attribution-noncommercial 4.0", "cc by-nc 4.0 license"],
    "CC-BY-4.0": ["creative commons attribution 4.0", "cc by 4.0 license"],
    "CC-BY-SA-4.0": ["creative commons attribution-sharealike 4.0", "cc by-sa 4.0 license"],
    "BSD-3-Clause": ["bsd 3-clause license", "3-clause bsd license", "bsd-3-clause license"],
}
GRANTS = ["under the", "under a", "terms of the", "governed by the"]
#: Reservations of rights count where the file has no other licence: many granting notices begin with one.
RESERVED = {"proprietary": ["all rights reserved"]}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope "
    "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
    "the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this "
    "program. If not, see <https://www.gnu.org/licenses/>."
)
_CC = (
    "This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit "
    "http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
#: What headers of source files say.
HEADERS = {
    "Apache-2.0": [
        _APACHE,
        _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    **{f"{x}-{v}": [_GNU.format(n, v[0] if v[2] == "0" else v), _GNU.format(n, v[0] if v[2] == "0" else v).split(" This program is distributed")[0]]
       for x, n, v in [("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0")]},
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MIT": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": [_CC.format("Attribution", "by")],
    "CC-BY-SA-4.0": [_CC.format("Attribution-ShareAlike", "by-sa")],
    "CC-BY-NC-4.0": [_CC.format("Attribution-NonCommercial", "by-nc")],
}


@cache
def standard_texts() -> dict[str, list[str]]:
    """Headers and full texts of each licence."""
    full = {f.stem: [f.read_text()] for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    return {k: HEADERS.get(k, []) + full.get(k, []) for k in sorted(HEADERS.keys() | full.keys())}


#: A file, and a part of it, takes part if it has one of these or a word that stands for a template without any.
CUES = r"(?i)licen[cs]|copyright|all\s+rights\s+reserved|redistribut|spdx|reproduced|hereby\s+granted|general\s+public|creative\s+commons"
#: Parts of fewer words are compared with notices only.
LONG_WORDS = 16
MIN_COSINE = 0.6
#: A file is a licence file if its licence lines hold at least this share of its words.
FILE_SHARE = 0.3
MAX_TEMPLATES = 200
_SPLIT = r"[^a-z0-9.\-]+"
_PARAGRAPH = r"\n[^\p{L}\p{N}]*\n"
_BLOCK_COMMENT = r"""(?s)^\s*(?:/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|'{3}.*?'{3})"""
_COMMENT_LINE = r"(?i)^\s*(?:$|#|//|/?\*|--|;|%|!|\"|'|\.\.|(?:rem|dnl)\b)"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".-") for x in re.split(_SPLIT, text.lower())) if w]


def _words(line: Column) -> Column:
    raw = F.transform(F.split(F.lower(line), _SPLIT), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", ""))
    return F.filter(raw, lambda w: w != "")


def template_weights(templates: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """idf of each word of the templates, and each template's unit vector (log-scaled counts times idf)."""
    bags = {k: Counter(words_of(v)) for k, v in sorted(templates.items())}
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in sorted(df.items())}
    unit = {}
    for k, b in bags.items():
        v = {w: (1 + math.log(c)) * idf[w] for w, c in sorted(b.items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[k] = {w: x / norm for w, x in v.items()}
    return idf, unit


def _held(words: Column, phrases: list[str]) -> Column:
    """Number of words of the first of the phrases that is a run of whole words of ``words``; null without one."""
    said = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrase = F.regexp_extract(said, f" ({'|'.join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))}) ", 1)
    return F.when(phrase != "", F.size(F.split(phrase, " ")))


def phrases_of(license_id: str) -> list[str]:
    """Phrases that name a licence wherever a line holds them."""
    spdx = [f"spdx-license-identifier {license_id.lower()}{x}" for x in ("", "-only", "-or-later")]
    return spdx + [f"{g} {n}" for g in GRANTS for n in NAMES.get(license_id, [])]


def cues_of(texts: list[str]) -> str:
    """The cues, with the longest word of each template that has none of them."""
    return "|".join([CUES, *sorted({re.escape(max(words_of(t), key=len)) for t in texts if not re.search(CUES, t) and words_of(t)})])


def _bag(words: Column) -> Column:
    """``w, tf`` of each distinct word of a sorted list."""
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.element_at(words, i) != F.element_at(words, F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, 2, F.size(words)), F.array(F.size(words) + 1))
    return F.zip_with(starts, ends, lambda i, j: F.struct(F.element_at(words, i).alias("w"), (1 + F.log((j - i).cast("double"))).alias("tf")))


def _parts(text: Column) -> Column:
    """``line, part``: each line, then the paragraphs, the header comment and the whole text where they are not lines."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    lines = F.split(text, "\n")
    end = F.array_position(F.transform(lines, lambda x: ~x.rlike(_COMMENT_LINE)), True)
    head = F.array_join(F.when(end == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))), "\n")
    blocks = F.concat(F.split(text, _PARAGRAPH), F.array(head, F.regexp_extract(text, _BLOCK_COMMENT, 0), text))
    return F.concat(
        F.transform(lines, lambda x: F.struct(F.lit(True).alias("line"), x.alias("part"))),
        F.transform(F.array_except(blocks, lines), lambda x: F.struct(F.lit(False).alias("line"), x.alias("part"))),
    )


def match_parts(files: DataFrame, templates: dict[str, str], texts: dict[str, list[str]]) -> DataFrame:
    """``id, path, line, license_id, score, rank, share`` for each licence part of ``files`` (id, path, text).

    ``rank`` is 2 for headers and full texts, which may mention other licences; 1 for notices, and for lines that hold a
    phrase of a licence as it stands, which score 1; 0 for a mere reservation of rights.
    """
    long = {f"{k}\n{i}": t for k, v in texts.items() for i, t in enumerate(v)}
    spaces = [(template_weights(t), math.log(1 + len(t)) + 1) if t else (({}, {}), 1.0) for t in (templates, long)]
    (idf, unit), unseen = spaces[0]
    (long_idf, long_unit), long_unseen = spaces[1]
    vectors = [(1, k, v, idf) for k, v in unit.items()] + [(2, k.split("\n")[0], v, long_idf) for k, v in long_unit.items()]
    vocabulary = sorted(idf.keys() | long_idf.keys())
    table = pa.table(
        {
            "w": pa.array(vocabulary, pa.string()),
            "idf": pa.array([idf.get(w, unseen) for w in vocabulary], pa.float64()),
            "long_idf": pa.array([long_idf.get(w, long_unseen) for w in vocabulary], pa.float64()),
            "to": pa.array([[v.get(w, 0.0) * i.get(w, 0.0) for _, _, v, i in vectors] for w in vocabulary], pa.list_(pa.float64())),
        }
    )
    weights = F.broadcast(files.sparkSession.createDataFrame(table))

    cue = cues_of([*templates.values(), *long.values()])
    parts = files.where(F.col("text").rlike(cue)).select("id", "path", F.size(_words(F.col("text"))).alias("total"), F.explode(F.filter(_parts(F.col("text")), lambda x: x["part"].rlike(cue))).alias("p"))
    parts = parts.select("id", "path", "total", F.col("p")["line"].alias("line"), _words(F.col("p")["part"]).alias("words")).where(F.size("words") > 0)
    phrases = [(1, k, phrases_of(k)) for k in sorted(templates.keys() | texts.keys())] + [(0, k, RESERVED[k]) for k in sorted(RESERVED.keys() & unit.keys())]
    held = [(F.lit(rank).alias("rank"), F.lit(k).alias("license_id"), _held(F.col("words"), v).alias("of")) for rank, k, v in phrases]
    named = [F.when(of.isNotNull(), F.struct(rank, k, of)) for rank, k, of in held]
    keys = ["row", "id", "path", "total", "line", "n", "named"]
    parts = parts.select(
        F.monotonically_increasing_id().alias("row"), "id", "path", "total", "line", F.size("words").alias("n"), F.array_max(F.array(*named)).alias("named"), F.array_sort("words").alias("words")
    )
    bags = parts.select(*keys, F.explode(_bag(F.col("words"))).alias("b")).select(*keys, F.col("b")["w"].alias("w"), F.col("b")["tf"].alias("tf"))
    sums = [F.sum(F.pow(F.col("tf") * F.coalesce(F.col(c), F.lit(u)), F.lit(2.0))).alias(f"norm{r}") for r, c, u in ((1, "idf", unseen), (2, "long_idf", long_unseen))]
    sums += [F.sum(F.col("tf") * F.coalesce(F.col("to")[k], F.lit(0.0))).alias(f"dot{k}") for k in range(len(vectors))]
    scored = bags.join(weights, "w", "left").groupBy(*keys).agg(*sums)

    best = []
    for k, (rank, name, _, _) in enumerate(vectors):
        score = F.round(F.col(f"dot{k}") / F.sqrt(F.col(f"norm{rank}")), 9)
        fits = (score >= MIN_COSINE) & (F.lit(True) if rank == 1 else F.col("n") >= LONG_WORDS)
        best.append(F.when(fits, F.struct(F.lit(rank).alias("rank"), score.alias("score"), F.lit(name).alias("license_id"), F.col("n").alias("of"))))
    said = F.struct(F.col("named")["rank"].alias("rank"), F.lit(1.0).alias("score"), F.col("named")["license_id"].alias("license_id"), F.col("named")["of"].alias("of"))
    best.append(F.when(F.col("named").isNotNull(), said))
    # a line that is a notice as a whole counts with all its words even where a phrase of it decides
    of = F.array_max(F.transform(F.filter(F.array(*best), lambda x: x.isNotNull()), lambda x: x["of"]))
    found = scored.select("id", "path", "line", "total", F.array_max(F.array(*best)).alias("best"), of.alias("of")).where("best is not null")
    return found.select("id", "path", "line", *[F.col("best")[k].alias(k) for k in ("license_id", "score", "rank")], (F.col("of") / F.col("total")).alias("share"))


def license_scan(
    files: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "id",
    path_col: str = "path",
    text_col: str = "text",
    texts: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``id, path, license_id, score, found_in, from_path`` for each row of ``files``.

    ``templates`` are one-line notices, ``texts`` headers and full texts (the standard ones unless given).
    ``found_in`` is ``header`` (a part of the file), ``license_file`` (the file is mostly licence), ``inherited`` (from the
    nearest directory above, ``from_path``) or null (none). Of several parts the one with the highest score counts (headers and
    full texts before notices, these before reservations of rights), then the licence last in the alphabet; of several licence files of a directory likewise, then the least id.

    Null and empty texts have no lines. A null path inherits nothing and speaks for no directory. Rows that repeat an
    id are one file: each gets the result of all its rows. Rows without id get null. Other columns are ignored.
    """
    if not 0 < len(templates) <= MAX_TEMPLATES:
        raise ValueError(f"1 to {MAX_TEMPLATES} templates")
    files = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = match_parts(files.where("id is not null"), templates, standard_texts() if texts is None else texts)
    own = found.groupBy("id").agg(
        F.max(F.struct("rank", "score", "license_id")).alias("best"),
        F.greatest(F.max("share"), F.sum(F.when(F.col("line"), F.col("share")))).alias("share"),
        F.max("path").alias("path"),
    )
    own = own.select("id", "path", F.col("best")["license_id"].alias("license_id"), F.col("best")["score"].alias("score"), (F.col("share") >= FILE_SHARE).alias("is_file"))
    own = materialize(own, "licence-lines")
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    speaks = (
        own.where("is_file")
        .withColumn("dir", parent)
        .where("dir is not null")
        .groupBy("dir")
        .agg(F.max_by(F.struct("license_id", "score", "path"), F.struct("score", "license_id", -F.col("id"))).alias("given"))
    )
    # a directory's ancestors, itself included: the longest that speaks is the nearest
    folders = files.select(parent.alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    ups = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    )
    up = folders.select(F.col("dir").alias("of"), F.explode(F.array_distinct(ups)).alias("dir"))
    near = fresh_join(up, speaks, ["dir"], "inner").groupBy("of").agg(F.max_by("given", F.length("dir")).alias("given"))
    rows = files.select("id", "path", parent.alias("of"))
    rows = fresh_join(rows, own.drop("path"), ["id"], "left")
    rows = fresh_join(rows, near, ["of"], "left")
    mine, theirs = F.col("license_id").isNotNull(), F.col("given").isNotNull() & F.col("id").isNotNull()
    return rows.select(
        "id",
        "path",
        F.when(mine, F.col("license_id")).when(theirs, F.col("given")["license_id"]).alias("license_id"),
        F.when(mine, F.col("score")).when(theirs, F.col("given")["score"]).alias("score"),
        F.when(mine & F.col("is_file"), "license_file").when(mine, "header").when(theirs, "inherited").alias("found_in"),
        F.when(~mine & theirs, F.col("given")["path"]).alias("from_path"),
    )


def tree(docs: DataFrame) -> DataFrame:
    """``documents`` has no paths: its sources are taken as top folders, with folders for languages and for id ranges."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), (F.floor(F.col("doc_id") / 1000)).cast("string"))
    return docs.select("doc_id", F.concat(place, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(tree(spark.read.parquet(f"{sf_dir}/documents.parquet")), id_col="doc_id")
    return out.select(F.col("id").alias("doc_id"), "path", "license_id", F.round("score", 6).alias("score"), "found_in", "from_path")
