"""License scans: exact set-similarity of text blocks with license templates.

Only DataFrame functions run here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words once A-Z are lower-cased (fixed value); texts are matched without regard to the case of A-Z instead.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Phrases and labels that are looked for word by word.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, statement): short statements by which texts declare a license.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1.0 universal public domain dedication"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("proprietary", "proprietary and confidential unauthorized copying of this file is strictly prohibited"),
    # notices as they stand at the head of files and in license texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
)
CONTAINMENT = 0.9
#: Words of a window for each word of a template, so that as many others may stand between.
SPAN = 2


def normal(text: Column) -> Column:
    """Words joined by single spaces, with one before and after; a single space if there are none."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")), F.lit(" "))


def _count(words: Column) -> Column:
    """Words of a normal form."""
    return F.when(F.btrim(words) == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) - 1).cast("long")


def token_sets(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(said.replace(".", " ").split()))) for label, said in templates]


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates stands in all texts; at most one row a word reaches the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.regexp_replace("text", GAP, " ")), " ")).alias("w"))
    return {r["w"]: r["n"] for r in words.where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count("*").alias("n")).collect()}


def prefix_index(sets: list[tuple[str, list[str]]], rank: dict[str, int], containment: float) -> dict[str, list[tuple[int, int]]]:
    """Of each prefix token, the templates and its position: a block that holds ceil(c * size)
    of a template's tokens holds one of its size - ceil(c * size) + 1 rarest."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, tokens) in enumerate(sets):
        need = math.ceil(containment * len(tokens) - 1e-9)
        for at, token in enumerate(sorted(tokens, key=lambda x: rank[x])[: len(tokens) - need + 1]):
            index.setdefault(token, []).append((t, at))
    return index


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Every row of docs as (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    A text gets a template's label if a window of SPAN times as many words as the template has,
    over line ends, holds at least ``containment`` of the template's distinct words. Words are
    ranked by their count over all texts; the rarest words of a template (its prefix) find where
    windows may stand. Of a prefix word only windows in which it is the template's rarest count, so its place
    in the template and the number of no rarer words around it bound the overlap before windows are counted; what is looked at
    around it is as long as two windows, whatever the text's length. score is the greatest containment, 1 with
    a base phrase, 0 without any label. Null texts count as empty and have no label; repeated
    rows are scanned alike; an empty table gives no rows; other columns are ignored.
    """
    sets = token_sets(templates)
    vocabulary = sorted({w for _, tokens in sets for w in tokens})
    count = frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    index = prefix_index(sets, rank, containment)
    phrases = "|".join(p for p, _ in BASE)
    rows = docs.select("doc_id", "text", normal(F.col("text")).alias("words"))
    rows = rows.withColumn("hits", F.when(F.col("words").rlike(f"(?i) (?:{phrases}) "), F.regexp_extract_all("words", F.lit(f"(?i)(?<= )(?:{phrases})(?= )"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    pieces = F.split("words", f"(?i)(?<= )(?:{phrases})(?= )")
    some = F.size("hits") > 0
    n_words = _count(F.col("words"))
    first = F.when(some, _spaces(F.get(pieces, F.lit(0))) - 1)
    tail = _spaces(F.element_at(pieces, -1)) - 1 + F.size(F.split(F.element_at("hits", -1), " "))
    last = F.when(some, n_words - tail)
    named = F.array_compact(F.array(*[F.when(F.array_contains(F.transform("hits", F.lower), p), F.lit(label)) for p, label in BASE]))
    spans = [SPAN * len(said.replace(".", " ").split()) for _, said in templates]
    found = _similar(F.col("text"), sets, spans, rank, index, containment)
    rows = rows.select("doc_id", n_words.alias("n_words"), F.size("hits").cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), named.alias("base"), found.alias("found"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda x: x["label"])))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _similar(text: Column, sets: list[tuple[str, list[str]]], spans: list[int], rank: dict[str, int], index: dict[str, list[tuple[int, int]]], containment: float) -> Column:
    """Array of struct(label, share) over the windows around prefix words."""
    quick = "(?i)(?:^|" + GAP[:-1] + ")(?:" + "|".join(sorted(index)) + ")(?:$|" + GAP[:-1] + ")"
    kind = "array<struct<label:string,share:double>>"
    ranked = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    # of each prefix token the templates, and how many of their tokens are not rarer
    table = F.create_map(*[x for w, at in index.items() for x in (F.lit(rank[w]), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(len(sets[t][1]) - q).alias("left")) for t, q in at]))])
    full = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(len(tokens)).alias("n"), F.lit(math.ceil(containment * len(tokens) - 1e-9)).alias("need"), F.lit(span).alias("span"), F.array(*[F.lit(r) for r in sorted(rank[w] for w in tokens)]).alias("r")) for (label, tokens), span in zip(sets, spans, strict=True)])
    words = F.split(F.lower(F.btrim(F.regexp_replace(text, GAP, " "))), " ")
    # positions and ranks of the text's template words
    known = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.try_element_at(ranked, w).alias("r"))), lambda k: k["r"].isNotNull())

    def of_known(known: Column) -> Column:
        own = lambda k, j: F.transform(F.coalesce(F.try_element_at(table, k["r"]), F.array().cast("array<struct<t:int,left:int>>")), lambda x: F.struct(k["i"].alias("i"), k["r"].alias("r"), j.alias("j"), x["left"].alias("left"), F.get(full, x["t"]).alias("t")))
        met = F.flatten(F.transform(known, own))

        def overlap(m: Column) -> Column:
            """The greatest overlap of a window in which the token met is the template's rarest; where a rarer one stands, that one meets it."""
            span, need = m["t"]["span"], m["t"]["need"]
            # words around it, of which no more can be near than the window is long
            around = F.slice(known, F.greatest(F.lit(1), m["j"] + 2 - span), 2 * span)
            near = F.filter(around, lambda k: (k["i"] > m["i"] - span) & (k["i"] < m["i"] + span) & (k["r"] >= m["r"]) & F.array_contains(m["t"]["r"], k["r"]))
            held = lambda near, s: F.size(F.array_distinct(F.transform(F.filter(near, lambda k: (k["i"] >= s) & (k["i"] < s + span)), lambda k: k["r"])))
            # positional filter: what is left of the template from this token on, and of the words around
            bound = lambda near: F.least(m["left"], F.size(F.array_distinct(F.transform(near, lambda k: k["r"]))))
            most = lambda near: F.when(bound(near) >= need, F.array_max(F.transform(F.filter(near, lambda k: k["i"] <= m["i"]), lambda k: held(near, k["i"])))).otherwise(F.lit(0))
            return F.struct(m["t"]["label"].alias("label"), m["t"]["n"].alias("n"), need.alias("need"), _let(near, most).alias("both"))

        fits = F.filter(F.transform(met, overlap), lambda x: x["both"] >= x["need"])
        return F.transform(fits, lambda x: F.struct(x["label"].alias("label"), (x["both"] / x["n"]).cast("double").alias("share")))

    return F.when(F.coalesce(text, F.lit("")).rlike(quick), _let(known, of_known)).otherwise(F.array().cast(kind))


def duckdb_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """``scan`` of the table documents in DuckDB's SQL: every window from a template's word on is counted, without an index."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in BASE)
    rows = ", ".join(
        f"({k}, '{label}', {SPAN * len(said.replace('.', ' ').split())}, {len(tokens)}, {math.ceil(containment * len(tokens) - 1e-9)}, {quoted(tokens)})"
        for k, ((label, tokens), (_, said)) in enumerate(zip(token_sets(templates), templates, strict=True))
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
phrase(label, ph) AS (VALUES {phrases}),
ahead AS (SELECT rid, i, word, lead(word) OVER x AS w1, lead(word, 2) OVER x AS w2 FROM p WINDOW x AS (PARTITION BY rid ORDER BY i)),
b AS (
  SELECT rid, count(*) AS n, min(i) AS low, max(i) AS high, list(DISTINCT label) AS labels
  FROM ahead JOIN phrase ON word = ph[1] AND w1 = ph[2] AND (len(ph) < 3 OR w2 = ph[3]) GROUP BY rid),
t(id, label, span, n, need, words) AS (VALUES {rows}),
tw AS (SELECT id, span, unnest(words) AS word FROM t),
h AS (SELECT rid, id, span, i, word FROM p JOIN tw USING (word)),
m AS (
  SELECT x.rid, x.id, x.i, count(DISTINCT y.word) AS c
  FROM h x JOIN h y ON x.rid = y.rid AND x.id = y.id AND y.i >= x.i AND y.i < x.i + x.span GROUP BY x.rid, x.id, x.i),
f AS (SELECT rid, list(DISTINCT label) AS labels, max(c / n) AS share FROM m JOIN t USING (id) WHERE c >= need GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.low::BIGINT AS first_word, b.high::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(f.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""
