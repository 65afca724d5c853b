"""License scan by a positional rare-token index, in DataFrame functions alone.

The index holds a few licence templates. Each word of a template has a posting (template, position) and an inverse
document frequency over the templates; a template's anchors are its rarest words. A file is looked up by the anchors
it holds: every occurrence gives the starts that the postings imply, the starts of a template's anchors are
intersected, and at each start that at least two anchors agree on (one, for the short base phrases) the mandatory key
phrase must stand at its own relative position. The index is a constant of the plan, so there is no shuffle, no
broadcast and no state; a file of any length costs one pass over its words.

Words are maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`, after lower-casing A-Z. The base phrases are exact:
all their places are reported. `score` is the largest share, by idf, of a template's words that stand at a verified
start; base phrases that stand whole count 1.

Defined results: null text is empty; a file without words has n_words 0, null places, empty labels, score 0. Repeated
rows and null ids are scanned like any others; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import lower_ascii, no_null

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, template words, mandatory key phrase. Openings of public licence texts.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "conditions under which a package may be copied"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work to the public domain"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("mit", "released under the mit license", "the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
]
ANCHORS = 3


def _index() -> tuple[dict[str, float], list[tuple[str, list[str], list[int], int, list[str], int]]]:
    """idf, and for each template: label, words, anchor positions, phrase position, phrase, least anchors at one start."""
    texts = [(label, phrase.split(), phrase.split(), 1) for phrase, label in BASE.items()]
    texts += [(label, text.split(), phrase.split(), 2) for label, text, phrase in TEMPLATES]
    count = Counter(w for _, words, _, _ in texts for w in set(words))
    idf = {w: math.log((1 + len(texts)) / n) for w, n in count.items()}
    index = []
    for label, words, phrase, least in texts:
        first = {w: words.index(w) for w in words}
        rarest = sorted(first, key=lambda w: (-idf[w], first[w]))[: 1 if least == 1 else ANCHORS]
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        index.append((label, words, sorted(first[w] for w in rarest), at, phrase, least))
    return idf, index


def _literal(values) -> Column:
    return F.array(*map(F.lit, values))


def _index_column() -> Column:
    """The index as one constant: an array of templates."""
    idf, index = _index()
    rows = []
    for label, words, at, phrase_at, phrase, _ in index:
        anchors = F.array(*[F.struct(F.lit(words[q]).alias("word"), F.lit(q).alias("at")) for q in at])
        parts = {"label": F.lit(label), "words": _literal(words), "idf": _literal([idf[w] for w in words]), "total": F.lit(sum(idf[w] for w in words)), "anchors": anchors, "at": F.lit(phrase_at), "phrase": _literal(phrase)}
        rows.append(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return F.array(*rows)


def _starts(words: Column, hits: Column):
    """template -> the verified starts of a template."""

    def implied(t: Column, k: int) -> Column:
        """Where the template would start, by each occurrence of one of its anchors."""
        anchor = F.get(t["anchors"], F.lit(k))
        return F.transform(F.filter(hits, lambda p: F.get(words, p) == anchor["word"]), lambda p: p - anchor["at"])

    def of(t: Column) -> Column:
        one, two, three = (implied(t, k) for k in range(ANCHORS))
        agreed = F.array_union(F.array_union(F.array_intersect(one, two), F.array_intersect(one, three)), F.array_intersect(two, three))
        starts = F.when(F.size(t["anchors"]) == 1, one).otherwise(agreed)
        # a template may begin before the file, its key phrase may not
        return F.filter(starts, lambda s: (s + t["at"] >= 0) & (F.slice(words, F.greatest(s + t["at"], F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"]))

    return of


def _shares(words: Column):
    """template, starts -> the largest share, by idf, of the template's words that stand at one of its starts."""

    def at(t: Column, s: Column) -> Column:
        stands = lambda i: (s + i >= 0) & (F.get(words, F.greatest(s + i, F.lit(0))) == F.get(t["words"], i))
        return F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda total, i: total + F.when(stands(i), F.get(t["idf"], i)).otherwise(0.0)) / t["total"]

    return lambda t, starts: F.coalesce(F.array_max(F.transform(starts, lambda s: at(t, s))), F.lit(0.0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of docs."""
    _, index = _index()
    anchors = sorted({words[q] for _, words, at, _, _, _ in index for q in at})
    words, hits, starts, templates = F.col("words"), F.col("hits"), F.col("starts"), _index_column()
    split = F.array_remove(F.split(lower_ascii(no_null(F.col(text_col))), SEPARATORS), "")
    frame = docs.select(F.col(id_col).alias("doc_id"), split.alias("words")).withColumn("n", F.size("words"))
    # where the licence words of the highest idf stand: nearly always nowhere
    frame = frame.withColumn("hits", F.when(F.col("n") > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.get(words, i).isin(anchors))).otherwise(F.array().cast("array<int>")))
    frame = frame.withColumn("starts", F.transform(templates, _starts(words, hits)))
    n_base = len(BASE)
    base = F.flatten(F.slice(starts, 1, n_base))
    found = F.zip_with(templates, starts, lambda t, s: F.when(F.size(s) > 0, t["label"]))
    sorted_labels = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")
    return frame.withColumn("base", base).withColumn("found", found).select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        sorted_labels(F.slice("found", 1, n_base)).alias("base_labels"),
        sorted_labels(F.col("found")).alias("labels"),
        F.round(F.array_max(F.zip_with(templates, starts, _shares(words))), 6).alias("score"),
    )


def duckdb_sql() -> str:
    """The same by trying every start of every template."""
    idf, index = _index()
    cols, shares = [], []
    for k, (_, template, at, phrase_at, phrase, least) in enumerate(index):
        get = lambda i: f"CASE WHEN s + {i} >= 0 THEN w[s + {i + 1}] END"
        anchors = " + ".join(f"coalesce(({get(q)} = '{template[q]}')::int, 0)" for q in at)
        stands = " AND ".join(f"coalesce({get(phrase_at + i)} = '{x}', false)" for i, x in enumerate(phrase))
        cols.append(f"list_filter(range(-{len(template)}, len(w)), lambda s: ({anchors}) >= {least} AND {stands}) AS s{k}")
        total = sum(idf[x] for x in template)
        each = " + ".join(f"CASE WHEN coalesce({get(i)} = '{x}', false) THEN {idf[x]!r}::double ELSE 0 END" for i, x in enumerate(template))
        shares.append(f"coalesce(list_max(list_transform(s{k}, lambda s: ({each}) / {total!r}::double)), 0)")
    n = len(BASE)
    found = lambda upto: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{index[k][0]}' END" for k in range(upto)) + "], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, w, {", ".join(cols)} FROM t),
v AS (SELECT *, {" || ".join(f"s{k}" for k in range(n))} AS base FROM u)
SELECT doc_id, len(w) AS n_words, len(base) AS n_base, list_min(base) AS first_word, list_max(base) AS last_word,
       {found(n)} AS base_labels, {found(len(index))} AS labels, round(greatest({", ".join(shares)}), 6) AS score
FROM v
"""
