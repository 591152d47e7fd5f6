"""License scans by diagonal voting, in DataFrame functions alone.

Every text is lower-cased (A-Z) and split into words; the rolling hashes of its k-grams at every
position are joined with the positions of the same k-grams in the templates. A match at text position
p and template position t votes for the diagonal p - t. Votes are counted by (text, template,
diagonal); neighbouring diagonals (small insertions or deletions) are merged into spans. A span is
verified by its words: every match was compared word by word, template positions that several
diagonals of a span hold count once, and enough of the template's k-grams must be there.

Two kinds of templates: phrases (short; all their k-grams must lie on one diagonal: the base places)
and bodies (running text of licenses: notices, and whole short licenses; the method's labels).
Templates are constants of a few thousand k-grams, so positions whose hash is none of theirs are left
out while still in the text's array, and the joined side is broadcast.

Defined cases: null and empty texts have no words, no labels and score 0; texts of any length are read
whole. Rows are told apart by id and text: rows with equal id and text get equal results, null ids
included. Labels that tie are all given, in order. An empty table gives no rows. Only the two named
columns are read, so others may have any names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import cut, literal_table

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Well-known license notices and short licenses, by label, as their words go.
BODIES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "released under the MIT license"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 4  # words of a body's k-grams; phrases use their pairs of words
DRIFT = 3  # neighbouring diagonals that are merged
COVER = 0.5  # part of a body's k-grams that a span must hold


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """The same on the driver, for templates."""
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_rows(phrases: dict, bodies: list) -> list[tuple]:
    """(template, label, phrase?, grams, position, first pair of words, second pair or "")."""
    out, n = [], 0
    for kind, items in ((True, list(phrases.items())), (False, [(text, label) for label, text in bodies])):
        for text, label in items:
            w, k = plain_words(text), 2 if kind else GRAM
            grams = [(i, " ".join(w[i : i + 2]), "" if kind else " ".join(w[i + 2 : i + k])) for i in range(len(w) - k + 1)]
            out += [(n, label, kind, len(grams), *g) for g in grams]
            n += 1
    return out


def templates(spark: SparkSession, phrases: dict = PHRASES, bodies: list = BODIES) -> DataFrame:
    schema = "template int, label string, phrase boolean, grams int, at int, one string, two string"
    return literal_table(spark, template_rows(phrases, bodies), schema).withColumn("h", F.xxhash64("one", "two"))


def matches(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (key, text): verified k-gram matches (key, template, label, phrase, grams, at, pos)."""
    wanted = {kind: [r["h"] for r in known.where(F.col("phrase") == kind).select("h").distinct().collect()] for kind in (True, False)}  # constants
    words = docs.select("key", words_of(F.col("text")).alias("w")).where(F.size("w") > 1)
    # Pairs, then pairs of pairs: the rolling k-grams of every position, with null behind the end.
    pairs = words.select("key", F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)).alias("p"))
    four = F.zip_with("p", F.slice("p", F.lit(3), F.size("p")), lambda a, b: F.struct(a.alias("one"), b.alias("two"), F.xxhash64(a, F.lit("")).alias("h2"), F.xxhash64(a, b).alias("h4")))
    placed = F.transform(four, lambda g, i: F.struct(i.alias("pos"), g.alias("g")))
    held = F.filter(placed, lambda x: x["g"]["h2"].isin(wanted[True]) | x["g"]["h4"].isin(wanted[False]))
    grams = pairs.select("key", F.explode(held).alias("x")).select("key", "x.pos", "x.g.*")
    both = F.array(F.struct(F.col("h2").alias("h"), F.lit("").alias("second")), F.struct(F.col("h4").alias("h"), F.col("two").alias("second")))
    grams = grams.select("key", "pos", F.col("one").alias("first"), F.explode(both).alias("x")).select("key", "pos", "first", "x.*").where("second is not null")
    # Equal hashes are compared word by word here.
    return grams.join(F.broadcast(known), "h").where("first = one and second = two").select("key", "template", "label", "phrase", "grams", "at", "pos")


def spans(found: DataFrame, phrase: bool) -> DataFrame:
    """Merged diagonals with enough votes: key, template, label, votes, grams (and diagonal: its start)."""
    found = found.where(F.col("phrase") if phrase else ~F.col("phrase"))
    diagonal = found.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("key", "template", "label", "grams", "diagonal")
    votes = diagonal.agg(F.collect_set("at").alias("held"))  # positions of one template
    if phrase:
        return votes.where("size(held) = grams")
    near = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > DRIFT, F.lit(True))
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("key", "template", "label", "grams", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("votes"))
    return merged.where(F.col("votes") >= F.ceil(F.col("grams") * COVER)).drop("run")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict = PHRASES, bodies: list = BODIES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = F.struct(F.xxhash64("id", "text").alias("a"), F.hash("text", F.lit(7), "id").alias("b"))
    found = matches(rows.select(key.alias("key"), "text"), templates(docs.sparkSession, phrases, bodies))
    found = cut(found, "grams")  # both kinds of spans read it; without a table each would scan all texts
    base = spans(found, True).groupBy("key").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base"), F.lit(0.0).alias("cover"))
    body = spans(found, False).groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.col("votes") / F.col("grams")).alias("cover"))
    none = F.array().cast("array<string>")
    both = base.drop("cover").join(body, "key", "full")
    joined = F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("more", none)))
    both = both.select("key", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"), F.array_join(joined, ",").alias("labels"), F.greatest(F.when(F.col("n_base") > 0, 0.5).otherwise(0.0), F.coalesce("cover", F.lit(0.0))).alias("score"))
    sizes = rows.select("id", key.alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(both, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
