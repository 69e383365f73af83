"""License notices by an exact set-similarity join of text blocks with templates.

Blocks are cut for each template of n words: a paragraph (lines up to a blank one, so a notice may wrap) of at most
n words, and in a longer one every n consecutive words, which at its ends may be fewer. A block matches if it holds
at least `threshold` of the template's d distinct words, k = ceil(threshold d). Template words are ordered by how
many documents of the whole corpus have them, rarest first. Then

  prefix: a match holds one of the template's first d - k + 1 words, so only blocks around their places are made;
  length: a paragraph that matches has k words at least, and so have the words within n places of such a place;
  position: of the template's words from that one on, with those before it that the text has near, k are left.

Blocks that pass are checked by intersection, so every block above the threshold is found and no other.
Templates are few and fixed, hence broadcast; only their words' counts come to the driver. Everything is
DataFrame functions.

Defined results: a null text counts as empty and has no words; repeated rows each give a row; a null id
stays null; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, text_or_empty

THRESHOLD = 0.8

#: Phrases that carry a label wherever their words stand in a row.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license notices, short ones and the texts that stand in files.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-2.0": "this program is free software under the terms of the gnu general public license version 2",
    "lgpl": "licensed under the gnu lesser general public license",
    "agpl": "licensed under the gnu affero general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version of the license or at your option any later version "
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
    "fitness for a particular purpose see the gnu general public license for more details",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
    "file you can obtain one at http mozilla org mpl 2 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to "
    "this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
    "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
    "action arising out of or in connection with the use or performance of this software",
    "bsd-3-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
    "other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
    "the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely",
}

#: What parts words: every letter below 0x80 but digits and lower-case letters. What parts paragraphs: a blank line.
_GAP, _BLANK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"\n[ \t\r]*\n"


def _words(text: Column) -> Column:
    """Words in order, empty texts at the ends left in. lower() also changes letters beyond A-Z, which starts, ends and joins no word."""
    return F.split(F.lower(text), _GAP)


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)]))


def _base(words: Column, low: Column) -> dict[str, Column]:
    """Places of the phrases, looked for only in texts that hold the letters of their first and last word."""
    none = F.array().cast("array<int>")
    may = lambda p: low.contains(p.split(" ")[0]) & low.contains(p.split(" ")[-1]) & F.array_contains(words, p.split(" ")[-1])
    found = {p: F.when(may(p), _places(words, p)).otherwise(none) for p in PHRASES}
    return {"places": F.flatten(F.array(*found.values())), "base": F.array_sort(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(PHRASES[p])) for p, c in found.items()])))}


def word_ranks(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> list[str]:
    """The vocabulary by the number of documents that hold a word, rarest first; ties by the word."""
    words = F.array(*map(F.lit, vocabulary))
    held = docs.select(F.explode(F.array_intersect(words, _words(text_or_empty(text_col)))).alias("w"))
    counts = {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}  # at most one row a template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_prefixes(order: list[str], templates: dict[str, str], threshold: float) -> list[tuple]:
    """(label, n, k, words in order, prefix word, its place) for every prefix word of every template; n counts repeats."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for label, notice in templates.items():
        words = sorted(set(notice.split()), key=rank.__getitem__)
        k = max(1, math.ceil(threshold * len(words) - 1e-9))
        out += [(label, len(notice.split()), k, words, w, i) for i, w in enumerate(words[: len(words) - k + 1])]
    return out


def scanned(docs: DataFrame, firsts: list[str], id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: (id, h, n_words, places, base, t), h telling texts of one id apart.

    t is the lower-cased text where it holds a prefix word of any template, else null.
    """
    text = text_or_empty(text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), F.lower(text).alias("t"))
    rows = rows.withColumn("w", F.split("t", _GAP))
    # only the first and the last part can be empty
    w = F.col("w")
    rows = rows.withColumn("w", F.when(F.element_at(w, 1) == "", F.slice(w, F.lit(2), F.size(w))).otherwise(w))
    w = F.col("w")
    rows = rows.withColumn("w", F.when((F.size(w) > 0) & (F.get(w, F.size(w) - 1) == ""), F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w))
    held = F.when(F.arrays_overlap(F.array(*map(F.lit, firsts)), F.col("w")), F.col("t"))
    return rows.select("id", "h", F.size("w").cast("long").alias("n_words"), *[c.alias(k) for k, c in _base(F.col("w"), F.col("t")).items()], held.alias("t"))


def matches(rows: DataFrame, prefixes: list[tuple]) -> DataFrame:
    """(id, h, label, containment) of the best block of each template, where one is at or above the threshold in scanned rows."""
    least = min(p[2] for p in prefixes)
    index = rows.sparkSession.createDataFrame(prefixes, "label string, n int, k int, words array<string>, w string, i int")
    firsts = F.array(*[F.lit(w) for w in sorted({p[4] for p in prefixes})])
    parts = rows.where("t is not null").select("id", "h", F.explode(F.split("t", _BLANK)).alias("part"))
    parts = parts.select("id", "h", F.filter(F.split("part", _GAP), lambda x: x != "").alias("ws")).where((F.size("ws") >= least) & F.arrays_overlap(firsts, "ws"))
    places = F.filter(F.transform("ws", lambda w, p: F.struct(p.alias("p"), w.alias("w"))), lambda x: F.array_contains(firsts, x["w"]))
    probes = parts.select("id", "h", "ws", F.inline(places)).join(F.broadcast(index), "w").where(F.size("ws") >= F.col("k"))
    # the words within n places of the prefix word, and where that one stands among them
    start = F.greatest(F.lit(0), F.col("p") - F.col("n") + 1)
    near = probes.select("id", "h", "label", "n", "k", "words", "i", (F.col("p") - start).alias("at"), F.slice("ws", start + 1, F.col("p") + F.col("n") - start).alias("near"))
    before = F.size(F.array_intersect(F.slice("words", F.lit(1), F.col("i")), "near"))
    near = near.where((F.size("near") >= F.col("k")) & (F.size(F.array_intersect("words", "near")) >= F.col("k")) & (before + F.size("words") - F.col("i") >= F.col("k")))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("n") + 1), F.col("at"))
    most = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect("words", F.slice("near", s + 1, F.col("n"))))))
    best = near.withColumn("shared", most).where("shared >= k").select("id", "h", "label", (F.col("shared") / F.size("words")).alias("containment"))
    return best.groupBy("id", "h", "label").agg(F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    score is 1 where a phrase stands, else the best containment of a matched template, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    order = word_ranks(docs, sorted({w for t in templates.values() for w in t.split()}), text_col)
    prefixes = template_prefixes(order, templates, threshold)
    rows = staged(scanned(docs, sorted({p[4] for p in prefixes}), id_col, text_col))
    found = matches(rows, prefixes)
    best = found.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = rows.join(best, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
