"""License scans: a positional index of rare licence words, verified by mandatory key phrases.

The words of the licence templates form a vocabulary; how many texts hold each gives its IDF over the whole table. Each
template, of which a label has several (passages of its text, its notice, its short names), is posted under its words of high IDF with their positions. A file looks up the rare words it holds;
postings that agree in relative position (place in the file less place in the template) add up their IDF, and the best
offset's share of the template's whole weight is its score. A template is reported if the score reaches a limit and one of
its key phrases stands in the text, consecutively. Base phrases are found in the same words, consecutively.

Nulls, ties, empty inputs: a null text is empty: no words, no labels, score 0; rows that repeat are judged alike;
of equally good offsets the first counts, they only give scores; an empty table gives an empty result. Other columns are
ignored. Very long texts are scanned whole; a file's postings are only the rare licence words in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.shared import alnum_words, stash

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

GPL = "is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version"
FSF = "gnu general public license as published by the free software foundation "
ISC = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
#: Label, mandatory key phrases (one of them must stand in the text), notice as templates of this scan. A label may
#: have several: one-line notices, and the standard headers and permission texts, which need no title.
TEMPLATES = (
    ("apache-2.0", ("apache license version 2 0",), "licensed under the apache license version 2 0"),
    ("gpl-2.0", ("gnu general public license version 2", "gnu gpl version 2"), "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", ("gnu general public license version 3", "gnu gpl version 3"), "this work is licensed under the gnu general public license version 3"),
    ("lgpl", ("gnu lesser general public license",), "licensed under the gnu lesser general public license"),
    ("agpl-3.0", ("gnu affero general public license",), "licensed under the gnu affero general public license version 3"),
    ("mit", ("the mit license", "mit license"), "released under the mit license"),
    ("bsd", ("bsd license", "redistribution and use in source and binary forms"), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", ("cc by 4 0", "creative commons attribution 4 0"), "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", ("cc by sa 4 0",), "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", ("cc by nd 4 0",), "licensed under cc by nd 4 0"),
    ("cc0", ("cc0 1 0", "cc0"), "dedicated to the public domain under cc0 1 0"),
    ("isc", ("isc license",), "released under the isc license"),
    ("unlicense", ("the unlicense", "free and unencumbered software"), "this is free and unencumbered software released into the public domain"),
    ("gpl-2.0", (FSF + "either version 2", FSF + "version 2"), GPL.format("")),
    ("gpl-3.0", (FSF + "either version 3", FSF + "version 3"), GPL.format("")),
    ("lgpl", ("gnu lesser general public license",), GPL.format("lesser ")),
    ("lgpl", ("gnu library general public license",), GPL.format("library ")),
    ("agpl-3.0", ("gnu affero general public license",), GPL.format("affero ")),
    ("apache-2.0", ("apache license version 2 0", "apache org licenses license 2 0"), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction", "permit persons to whom the software is furnished to do so"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("isc", (ISC.format("and or"), "for any purpose with or without fee is hereby granted", "copyright notice and this permission notice appear in all copies"), ISC.format("and or")),
    ("isc", (ISC.format("and"), "for any purpose with or without fee is hereby granted", "copyright notice and this permission notice appear in all copies"), ISC.format("and")),
    ("bsd", ("redistributions in binary form must reproduce the above copyright notice",), "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl-2.0", ("gplv2",), "gplv2"),
    ("gpl-2.0", ("gpl v2",), "gpl v2"),
    ("gpl-3.0", ("gplv3",), "gplv3"),
    ("gpl-3.0", ("gpl v3",), "gpl v3"),
    ("lgpl", ("lgplv2",), "lgplv2"),
    ("lgpl", ("lgplv3",), "lgplv3"),
    ("agpl-3.0", ("agplv3",), "agplv3"),
    ("cc-by-4.0", ("creative commons attribution 4 0",), "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", ("creative commons attribution sharealike 4 0",), "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", ("creative commons attribution noncommercial 4 0",), "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd-4.0", ("creative commons attribution noderivatives 4 0",), "creative commons attribution noderivatives 4 0"),
    ("mit", ("shall be included in all copies or substantial portions of the software",), "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", ("particular purpose and noninfringement", "in no event shall the authors or copyright holders be liable"), "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", ("the author disclaims all warranties with regard to this software", "all implied warranties of merchantability and fitness in no event shall the author be liable"), "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("bsd", ("redistributions of source code must retain", "retain the above copyright notice this list of conditions"), "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", ("this software is provided by the copyright holders and contributors as is", "in no event shall the copyright holder or contributors be liable"), "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("zlib", ("without any express or implied warranty in no event will the authors be held liable", "to alter it and redistribute it freely"), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1.0", ("to any person or organization obtaining", "accompanying documentation covered by this license"), "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("gpl-2.0", ("licenses for most software are designed to take away your freedom", "general public license is intended to guarantee your freedom"), "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-3.0", ("gnu general public license is a free copyleft license",), "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", ("ensure cooperation with the community", "in the case of network server software"), "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("apache-2.0", ("each contributor hereby grants to you", "royalty free irrevocable copyright license", "reproduce prepare derivative works of publicly display"), "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work"),
    ("mpl-2.0", ("source code form is subject to the terms", "terms of the mozilla public license", "if a copy of the mpl was not distributed"), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", ("anyone is free to copy modify publish use compile", "either in source code form or as a compiled binary"), "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", ("has dedicated the work to the public domain", "all of his or her rights to the work", "the person who associated a work with this deed"), "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
)
#: The same licences by their short names, as in "SPDX-License-Identifier: Apache-2.0".
TEMPLATES += tuple((label, (f"spdx license identifier {own}",), f"spdx license identifier {own}") for label in sorted({t[0] for t in TEMPLATES}) for own in [label.replace("-", " ").replace(".", " ")])
#: Words of the templates that any text may hold; they are never looked up.
COMMON = "a all and any are as at be by can do either except for from in including into is it may must not of on or other so terms that the this to under use used version v whom with without work you 0 1 2 3 4".split()


def starts(words: Column, phrase: str) -> Column:
    """The places, from 0, where the phrase's words stand consecutively."""
    own = phrase.split()
    spot = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(own), F.lit(0))), lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(own)))), lambda i: i.cast("long"))
    return F.when(F.size(words) >= len(own), spot).otherwise(F.array().cast("array<bigint>"))


def vocabulary(templates: tuple) -> list[tuple[str, int, int]]:
    """(word, number of the template, position) of every template word that isn't common."""
    return [(w, t, i) for t, (_, _, notice) in enumerate(templates) for i, w in enumerate(notice.split()) if w not in COMMON]


def scan(docs: DataFrame, templates: tuple = TEMPLATES, base: dict[str, str] = BASE, least_score: float = 0.6, rare_share: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, base (struct of start and label, in order), found (struct of label and score), score (the best).

    rare_share: a template's words are posted from its rarest on, until they hold this share of its weight.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.coalesce(F.md5("text"), F.lit("")), "doc_id")
    terms = spark.createDataFrame(vocabulary(templates), "word string, template int, place int")
    # phrases are sought only in texts that hold the longest word of one
    anchors = sorted({max(p.split(), key=len) for p in (*base, *(p for _, ps, _ in templates for p in ps))})
    # a text without any of these words has no postings: one pass over its words tells
    known = sorted({w for w, _, _ in vocabulary(templates)} | {w for p in (*base, *(p for _, ps, _ in templates for p in ps)) for w in p.split() if w not in COMMON})
    words = F.transform(F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(known)), lambda x: x)
    marked = lambda p, label: F.transform(starts(F.col("words"), p), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    marks = F.array_sort(F.concat(*[marked(p, label) for p, label in base.items()]))
    phrases = sorted({p for _, ps, _ in templates for p in ps})
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    held_phrases = F.filter(F.array(*[F.when(F.col("joined").contains(f" {p} "), F.lit(p)) for p in phrases]), lambda p: p.isNotNull())
    rows = docs.select("doc_id", key.alias("key"), alnum_words(F.col("text")).alias("words")).withColumns({"any": F.arrays_overlap("words", F.array(*map(F.lit, known))), "near": F.arrays_overlap("words", F.array(*map(F.lit, anchors)))}).withColumn("joined", F.when(F.col("near"), joined))
    rows = stash(rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.when(F.col("near"), marks).alias("base"), F.when(F.col("near"), held_phrases).alias("phrases"), F.when(F.col("any"), words).alias("spots")), "licence-words")
    spots = rows.where("spots is not null").dropDuplicates(["key"]).select("key", F.coalesce(F.size("phrases") > 0, F.lit(False)).alias("may"), F.explode("spots").alias("s")).select("key", "may", "s.at", "s.word")
    texts = rows.count()
    held = spots.select("key", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    weighed = stash(terms.join(F.broadcast(held), "word", "left").withColumn("idf", F.log((F.lit(texts) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1), "licence-idf")
    each = weighed.withColumn("whole", F.sum("idf").over(Window.partitionBy("template"))).withColumn("rarer", F.coalesce(F.sum("idf").over(Window.partitionBy("template").orderBy(F.desc("idf"), "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    index = F.broadcast(stash(each, "licence-index"))
    shift = (F.col("at") - F.col("place")).alias("shift")
    likely = spots.where("may").drop("may")  # without a key phrase nothing is reported, so only these are lined up
    rare = likely.join(index.where(F.col("rarer") < F.col("whole") * rare_share), "word").select("key", "template", shift).distinct()
    lined = likely.join(index, "word").select("key", "template", shift, "place", "idf", "whole").join(rare, ["key", "template", "shift"], "left_semi").distinct()
    best = lined.groupBy("key", "template", "shift").agg((F.sum("idf") / F.max("whole")).alias("score")).groupBy("key", "template").agg(F.max("score").alias("score"))
    found = best.where(F.col("score") >= least_score).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("template", F.least("score", F.lit(1.0)).alias("score")))).alias("lined"))
    out = rows.select("doc_id", "key", "n_words", F.coalesce("base", F.array().cast("array<struct<start:bigint,label:string>>")).alias("base"), F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases")).join(found, "key", "left")
    must = F.array(*[F.array(*map(F.lit, ps)) for _, ps, _ in templates])
    own = F.filter(F.coalesce("lined", F.array().cast("array<struct<template:int,score:double>>")), lambda x: F.arrays_overlap(F.get(must, x["template"]), F.col("phrases")))
    named = F.transform(own, lambda x: F.struct(F.get(F.array(*[F.lit(label) for label, _, _ in templates]), x["template"]).alias("label"), x["score"].alias("score")))
    out = out.withColumn("named", named)
    # a label has the score of its best template
    sure = F.transform(F.array_sort(F.array_distinct(F.transform("named", lambda x: x["label"]))), lambda label: F.struct(label.alias("label"), F.array_max(F.transform(F.filter("named", lambda x: x["label"] == label), lambda x: x["score"])).alias("score")))
    return out.select("doc_id", "n_words", "base", sure.alias("found")).withColumn("score", F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    places, base = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    both = F.concat(base, F.transform("found", lambda x: x["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(base).alias("base_labels"), joined(both).alias("labels"), "score")
