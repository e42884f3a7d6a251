"""License scan with a positional rare-token index, in DataFrame functions only.

Templates are word sequences with a label and mandatory key phrases.  The IDF
of every template word is counted over all documents.  The index has a posting
for each template under its rarest word, with that word's position and the
positions and weights of its other rare words.  Each place of an indexed word
in a file, intersected with the word's postings, fixes an offset of a template
(position in the file less position in the template); the offset is voted for
by the weights of the rare words that stand where it says, and enough votes,
with the key phrases standing whole inside the covered stretch, confirm it.  A
base phrase is a template all of whose words are mandatory, so every place of
it is found.

The postings are a constant of the plan, as long as the catalogue; words are
looked up in hashed sets.  Only the counts of template words reach the driver;
the documents are read twice and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())


# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Own catalogue: paragraphs of well-known public licences and their usual notices, with the phrases that must be there.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
ZLIB_GRANT = """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must
not claim that you wrote the original software."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."""
LGPL_NOTICE = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation"""
AGPL_NOTICE = """it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at"""
BOOST_GRANT = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software"""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""

CATALOGUE = (
    Template("mit", MIT_GRANT, ("permission is hereby granted", "free of charge", "without limitation the rights")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("isc", ISC_GRANT, ("with or without fee", "permission notice appear in all copies")),
    Template("bsd", BSD_GRANT, ("redistribution and use", "source and binary forms", "list of conditions")),
    Template("zlib", ZLIB_GRANT, ("alter it and redistribute it freely", "must not be misrepresented")),
    Template("apache-2", APACHE_NOTICE, ("apache license", "version 2 0", "in compliance with the license")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    Template("gpl-3", GPL_NOTICE.format(n=3), ("gnu general public license", "version 3")),
    Template("gpl-2", GPL_NOTICE.format(n=2), ("gnu general public license", "version 2")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", LGPL_NOTICE, ("gnu lesser general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    Template("agpl", AGPL_NOTICE, ("gnu affero general public license",)),
    Template("mpl-2", MPL_NOTICE, ("mozilla public license", "v 2 0")),
    Template("boost", BOOST_GRANT, ("any person or organization", "prepare derivative works")),
    Template("unlicense", UNLICENSE, ("free and unencumbered", "public domain")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "4 0")),
)


def words_of(text: Column) -> Column:
    """Array of a text's words; a null text has none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def word_weights(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each word of the vocabulary over all rows of words (column words)."""
    held = words.select(F.explode(F.array_append(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))), F.lit(""))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most
    total = counts.get("", 0)
    return {w: log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def postings(base: list[Template], catalogue: tuple[Template, ...], weight: dict[str, float], rare: int) -> tuple[list[str], Column]:
    """The indexed words, and an array of postings.

    A posting: w and rel, its word and that word's position; base, whether all
    words must stand; label; size; need, the positions, words and shares of the
    vote of the template's rare words (of all words for a base phrase); keys,
    the mandatory phrases between blanks.  Of words of one IDF, the smaller is
    rarer; of places of a word in a template, the first counts.
    """
    rows, anchors = [], set()
    for t, is_base in [*((t, True) for t in base), *((t, False) for t in catalogue)]:
        best = sorted(set(t.words), key=lambda w: (-weight[w], w))[:rare]
        anchors.add(best[0])
        need = list(enumerate(t.words)) if is_base else [(t.words.index(w), w) for w in best]
        shares = [1.0 if is_base else max(weight[w], 1e-6) for _, w in need]
        entries = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(w).alias("w"), F.lit(x / sum(shares)).alias("share")) for (i, w), x in zip(need, shares, strict=True)))
        keys = _array([] if is_base else [f" {k} " for k in t.keys])
        rows.append(F.struct(F.lit(best[0]).alias("w"), F.lit(t.words.index(best[0])).alias("rel"), F.lit(is_base).alias("base"), F.lit(t.label).alias("label"), F.lit(len(t.words)).alias("size"), entries.alias("need"), keys.cast("array<string>").alias("keys")))
    return sorted(anchors), F.array(*rows)


def _found(words: Column, anchors: list[str], index: Column, least_vote: float) -> Column:
    """Confirmed places in a text: structs base, label, start, vote, one for each posting that a place of an indexed word confirms."""
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull())

    def stands(start: Column) -> Callable[[Column, Column], Column]:
        return lambda vote, e: vote + F.when(F.coalesce(F.try_element_at(words, (start + e["at"] + 1).cast("int")) == e["w"], F.lit(False)), e["share"]).otherwise(F.lit(0.0))

    def confirmed(start: Column, q: Column) -> Column:
        vote = F.aggregate(q["need"], F.lit(0.0), stands(start))
        inside = F.concat(F.lit(" "), F.array_join(F.slice(words, start + 1, q["size"] + 2), " "), F.lit(" "))
        least = F.when(q["base"], 1 - 1e-9).otherwise(least_vote)  # all words of a base phrase
        whole = (vote >= least) & F.forall(q["keys"], lambda k: F.contains(inside, k))
        return F.when(whole, F.struct(q["base"].alias("base"), q["label"].alias("label"), start.alias("start"), vote.alias("vote")))

    def of_place(p: Column) -> Column:
        mine = F.filter(index, lambda q: (q["w"] == p["w"]) & (q["rel"] <= p["i"]))
        return F.array_compact(F.transform(mine, lambda q: confirmed(p["i"] - q["rel"], q)))

    return F.flatten(F.transform(places, of_place))


def license_scan(
    docs: DataFrame,
    base: dict[str, str] = BASE,
    catalogue: tuple[Template, ...] = CATALOGUE,
    rare: int = 4,
    least_vote: float = 0.75,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are the
    smallest and largest start of one (words from 0), null without any.  labels
    adds to base_labels those of confirmed templates, all distinct, sorted and
    joined by commas.  score is 1 with a base phrase, else the best vote of a
    confirmed template, else 0.  Null, empty and wordless texts have 0 words
    and no label.  Repeated rows are reported each; an empty table has no rows.
    Templates of equal votes all count.
    """
    phrases = [Template(label, phrase, (phrase,)) for phrase, label in base.items()]
    vocabulary = sorted({w for t in (*phrases, *catalogue) for w in t.words})
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("words"))
    anchors, index = postings(phrases, catalogue, word_weights(read, vocabulary), rare)
    none = F.array().cast("array<struct<base:boolean,label:string,start:int,vote:double>>")
    some = F.when(F.exists("words", lambda w: w.isin(anchors)), _found(F.col("words"), anchors, index, least_vote)).otherwise(none)
    out = read.select("doc_id", F.size("words").cast("long").alias("n_words"), some.alias("found"))
    starts = F.transform(F.filter("found", lambda x: x["base"]), lambda x: x["start"].cast("long"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    best = F.coalesce(F.array_max(F.transform("found", lambda x: F.when(x["base"], 1.0).otherwise(x["vote"]))), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(F.filter("found", lambda x: x["base"]), lambda x: x["label"])).alias("base_labels"),
        joined(F.transform("found", lambda x: x["label"])).alias("labels"),
        F.least(best, F.lit(1.0)).alias("score"),
    )
