"""License scans by a positional rare-token index, in DataFrame functions only.

The index has of each template its words of the highest inverse document frequency over all files, and where they stand in
it. Every file's licence words are looked up there; each posting votes for a template and the place where that would begin
in the file. The votes that agree, but for DRIFT words put in or left out, have a share of the template's weight in the
index, whether or not the file has the other words. A template is found if the share is high enough and then its mandatory
key phrases occur. Texts are read once; what is shuffled are the places of licence words and the words of files with a
candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialise

#: Phrases that are found wherever they stand, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, template, mandatory key phrases. Words are in the form that texts are brought into.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license", "version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["licensed under the apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["governing permissions and limitations under the license"]),
    ("bsd-2-clause", "bsd 2 clause license", ["bsd 2 clause license"]),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("bsd-3-clause", "bsd 3 clause license", ["bsd 3 clause license"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("bsl-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["boost software license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under creative commons cc0 1 0 universal", ["cc0 1 0"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("eupl-1.2", "licensed under the eupl", ["under the eupl"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published", "version 2 of the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published", "version 3 of the license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["distribute this software for any purpose with or without fee"]),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "released under the mit license", ["released under the mit license"]),
    ("mit", "licensed under the mit license", ["licensed under the mit license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
]
#: A line that names a licence by its identifier is a template of its own for each label.
TEMPLATES += [(label, text, [text]) for label in sorted({t[0] for t in TEMPLATES}) for text in ["spdx license identifier " + label.replace("-", " ").replace(".", " ")]]
#: Words of no use for an index.
COMMON = frozenset("a above all and any are as at be by can either for from if in is it its later may must no nor not of on one option or other see that the this to under use was will with without you your".split())
#: So many files that are found by the index have their texts looked up by broadcast; more by a shuffle.
FEW_FILES = 1_000_000
#: So many of each template's words, those with the highest inverse document frequency, are in the index.
RAREST = 16
#: Votes agree if their places differ by less; texts put a name or a line's mark between a template's words.
DRIFT = 16
#: Share of a template's weight in the index that must agree.
SHARE = 0.6

LETTERS = "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_text(text: str = "text") -> Column:
    """The words of a text with one space between, A-Z in lower case."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), LETTERS.upper(), LETTERS)
    return F.trim(F.regexp_replace(low, NOT_WORD, " "))


def _spaces(x: Column) -> Column:
    return (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def index_of(idf: dict[str, float]) -> list[tuple[str, int, int, float, float]]:
    """Postings (word, template, at, weight, weight of the template) of each template's RAREST words; ties by word."""
    rows = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        picked = set(sorted(set(words) - COMMON, key=lambda w: (-idf[w], w))[:RAREST])
        places = [(w, t, at, idf[w]) for at, w in enumerate(words) if w in picked]
        rows += [(*x, sum(p[3] for p in places)) for x in places]
    return rows


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places count from 0 and are null without a base phrase; label lists are distinct, sorted, joined with commas, empty if
    none. score is the best found template's share, 0.5 where only base phrases occur, 0 without any. A null text is empty.
    Rows that repeat an id and its text get the same result each; null ids keep their own. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()} - COMMON)
    phrase = "(?<= )(?:" + "|".join(BASE) + ")(?= )"

    norm = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), normal_text().alias("norm"))
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    maybe = F.contains("norm", F.lit("license")) | F.contains("norm", F.lit("cc by"))
    rows = norm.withColumn("padded", padded).withColumn("found", F.when(maybe, F.regexp_extract_all("padded", F.lit(phrase), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n_words", F.when(F.col("norm") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("norm")) + 1))
    around = F.split("padded", phrase)
    last_phrase = F.element_at("found", -1)
    any_base = F.size("found") > 0
    words = F.split("norm", " ")
    digest = rows.select(
        "doc_id", "row", "n_words", F.size("found").cast("long").alias("n_base"),
        F.when(any_base, _spaces(F.element_at(around, 1)) - 1).alias("first_word"),
        F.when(any_base, F.col("n_words") - (_spaces(F.element_at(around, -1)) - 1) - (_spaces(last_phrase) + 1)).alias("last_word"),
        F.transform(F.array_distinct("found"), lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), p)).alias("base"),
        F.array_intersect(words, F.lit(vocabulary)).alias("licence_words"), "norm",
    )
    # The text stays with the files that have a word of any template.
    digest = materialise(digest.withColumn("norm", F.when(F.size("licence_words") > 0, F.col("norm"))), "licence-digest")

    total = digest.count()
    counts = {r["word"]: r["df"] for r in digest.select(F.explode("licence_words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}  # of the templates' words
    postings = index_of({w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 0.01 for w in vocabulary})
    index = F.broadcast(spark.createDataFrame(postings, "word string, template int, at int, weight double, whole double"))
    indexed = sorted({p[0] for p in postings})

    files = digest.filter("norm is not null").filter(F.arrays_overlap("licence_words", F.lit(indexed)))
    looked = files.select("row", F.posexplode(F.split("norm", " ")).alias("place", "word")).join(index, "word")
    # A place counts in two ranges that overlap, so that votes that differ by less than half of DRIFT meet in one.
    start = F.col("place") - F.col("at")
    votes = looked.withColumn("range", F.explode(F.array(2 * F.floor(start / DRIFT), 2 * F.floor((start + DRIFT // 2) / DRIFT) + 1)))
    agreed = votes.groupBy("row", "template", "range", "whole").agg(F.collect_set(F.struct("at", "weight")).alias("hit"))
    share = F.least(F.lit(1.0), F.aggregate("hit", F.lit(0.0), lambda a, h: a + h["weight"]) / F.col("whole"))
    able = materialise(agreed.groupBy("row", "template").agg(F.max(share).alias("share")).filter(F.col("share") >= SHARE), "licence-candidates")
    wanted = able.select("row").distinct()
    texts = files.join(F.broadcast(wanted) if wanted.count() <= FEW_FILES else wanted, "row", "left_semi").select("row", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("padded"))
    keys = F.array(*[F.array(*[F.lit(f" {k} ") for k in t[2]]) for t in TEMPLATES])
    verified = able.join(texts, "row").filter(F.forall(F.element_at(keys, F.col("template") + 1), lambda k: F.contains("padded", k)))
    names = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    method = verified.groupBy("row").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("method"), F.max("share").alias("share"))

    out = digest.drop("norm", "licence_words").join(method, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("method", F.array().cast("array<string>"))))
    score = F.coalesce("share", F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
