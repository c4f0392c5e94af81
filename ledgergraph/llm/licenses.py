"""License scans: an exact set-similarity join of text blocks with license templates.

A block matches a template that has at least ``THRESHOLD`` of its distinct words there, and all of them if they are fewer
than ``FEW``. Words are ordered by the number of documents that hold them, rarest first. A template of n words that needs k of them can
spare n - k, so a matching block holds one of the template's first n - k + 1 words (prefix filter); it has k template words
at all (length filter); and from the first common word on, k words have to remain on both sides (positional filter). What
passes is counted exactly. Built-in functions only; the templates and their words are bounded by this module.

Blocks are as long as the templates ask for: a template of up to s words (16, 32, 64, ...) is looked for in blocks of 2 s
words every s words, so that every run of s words lies in one block, however long a template is.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.llm.common import numbered, stored

THRESHOLD = 0.8
FEW = 10
SHORTEST_BLOCK = 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels, and passages of public licenses and notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("reserved", "All rights reserved."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
            "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
            "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
            "software without specific prior written permission."),
    ("bsd", "Released under the BSD License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."),
    ("cc-by-nc", "You may not use the material for commercial purposes. A commercial use is one primarily intended for commercial advantage or monetary "
                 "compensation."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "You must give appropriate credit, provide a link to the license, and indicate if changes were made. You may do so in any reasonable "
              "manner, but not in any way that suggests the licensor endorses you or your use."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
                  "any means."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                "https://www.eclipse.org/legal/epl-2.0"),
]


def needed(own: list[str], threshold: float = THRESHOLD) -> int:
    """How many of a template's distinct words a block must hold."""
    return len(own) if len(own) < FEW else math.ceil(threshold * len(own) - 1e-9)


def block_size(text: str) -> int:
    """The step of the blocks in which a template is looked for: its words, repeats included, rounded up."""
    return max(SHORTEST_BLOCK, 1 << (len(words_in(text)) - 1).bit_length())


def words_in(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def lowered_words(text: Column) -> Column:
    """Words of a text with A-Z lowered; a null text has none."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), capitals, capitals.lower()), F.lit(WORD), F.lit(0))


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Numbers of the words where a phrase starts; words are looked at one by one only in texts that hold it."""
    parts = phrase.split()

    def starts(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return test

    return (F.when(joined.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts))
            .otherwise(F.array().cast("array<int>")))


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents with each word of the templates; one row per word of this module."""
    held = docs.select(F.explode(F.array_intersect(lowered_words(F.col("text")), _literals(vocabulary))).alias("word"))
    return {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses of every document.

    Returns doc_id, n_words, n_base (places of ``PHRASES``), first_word and last_word (their smallest and largest
    start, words counted from 0, else null), base_labels, labels (with those of matching templates; both distinct,
    sorted, comma-joined, empty for none) and score (the best containment of a matching template, 1 with a phrase, 0
    without either). Null texts count as empty; each repeated row and null id is scanned by itself; an empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    sets = [(label, sorted(set(words_in(text))), block_size(text)) for label, text in templates or TEMPLATES if words_in(text)]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    count = word_frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, whole, prefix, of_size = [], [], {}, {}
    for t, (label, s, size) in enumerate(sets):
        need = needed(s, threshold)
        s.sort(key=rank.__getitem__)
        whole.append((t, label, s, need))
        index += [(w, size, t, len(s) - j, need) for j, w in enumerate(s[:len(s) - need + 1])]
        prefix.setdefault(size, set()).update(s[:len(s) - need + 1])
        of_size.setdefault(size, set()).update(s)

    words, joined = F.col("words"), F.col("joined")
    base = (numbered(docs.select("doc_id", "text"))
            .select("row", F.col("doc_id").cast("long").alias("doc_id"), lowered_words(F.col("text")).alias("words"))
            .withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    places = F.flatten(F.array(*[_places(words, joined, p) for p in PHRASES]))
    found = F.array(*[F.when(joined.contains(f" {p} "), F.lit(label)) for p, label in PHRASES.items()])

    def tiles(size: int) -> Column:
        """The words of templates in each block of one size, in their order, for blocks with a word that may begin a match."""
        first, own = _literals(sorted(prefix[size])), _literals([w for w in order if w in of_size[size]])
        tile = lambda i: F.struct(F.lit(size).alias("size"), F.array_intersect(own, F.slice(words, i * size + 1, 2 * size)).alias("held"))
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int")), tile)
        return F.when(F.arrays_overlap(words, first), F.filter(some, lambda b: F.arrays_overlap(b["held"], first)))

    blocks = F.flatten(F.array_compact(F.array(*[tiles(size) for size in sorted(prefix)])))
    rows = stored(base.select("row", "doc_id", F.size(words).cast("long").alias("n_words"), places.alias("places"),
                              F.array_compact(found).alias("base"), blocks.alias("blocks")), "license-blocks")

    spark = docs.sparkSession
    index = F.broadcast(spark.createDataFrame(index, "word string, size int, template int, after int, need int"))
    whole = F.broadcast(spark.createDataFrame(whole, "template int, label string, own array<string>, need int"))
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.size", "b.held")
    near = (blocks.select("row", "block", "size", "held", F.posexplode("held").alias("at", "word")).join(index, ["word", "size"])
            .where((F.size("held") >= F.col("need")) & (F.least(F.size("held") - F.col("at"), "after") >= F.col("need")))
            .select("row", "block", "held", "template").distinct())
    shared = F.size(F.array_intersect("held", "own"))
    matched = (near.join(whole, "template").where(shared >= F.col("need"))
               .groupBy("row").agg(F.collect_set("label").alias("more"), F.max(shared / F.size("own")).alias("best")))
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.join(matched, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), text_of(F.col("base")).alias("base_labels"),
        text_of(F.array_union("base", more)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def check_sql() -> str:
    """The same rows by comparing every block with every template, for an engine without the filters."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    sets = [(label, sorted(set(words_in(text))), block_size(text)) for label, text in TEMPLATES]
    wanted = ", ".join(f"('{label}', {quoted(own)}, {needed(own)}, {size})" for label, own, size in sets)
    sizes = ", ".join(f"({size})" for size in sorted({size for *_, size in sets}))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '{WORD}') AS w FROM documents),
places AS (SELECT row, i, label FROM (SELECT row, w, unnest(range(len(w))) AS i FROM d) JOIN (VALUES {phrases}) AS p(phrase, label)
    ON w[i + 1 : i + len(phrase)] = phrase),
base AS (SELECT row, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY row),
blocks AS (SELECT row, size, w[i + 1 : i + 2 * size] AS b FROM (SELECT row, size, w, unnest(range(0, len(w), size)) AS i
  FROM d, (VALUES {sizes}) AS z(size))),
shares AS (SELECT row, label, len(list_intersect(own, b)) AS shared, len(own) AS n, need FROM blocks
  JOIN (VALUES {wanted}) AS t(label, own, need, size) USING (size)),
matched AS (SELECT row, list(DISTINCT label) AS labels, max(shared / n) AS best FROM shares WHERE shared >= need GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(matched.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base ON d.row = base.row LEFT JOIN matched ON d.row = matched.row"""
