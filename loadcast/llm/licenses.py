"""License scans with a positional index of rare words.

Templates are short license notices.  Document frequencies of their words over
the whole corpus give the rarest words of each; these form the index, with their
positions.  Every indexed word of a file looks up the postings, which give the
place where the whole template would stand; there the template's rare words must
stand at their relative positions (by weight at least ``SHARE``) and its key
phrase word by word.  Base phrases are found literally.

All of it are array expressions on one row, so no text is shuffled; only one row
per template word leaves the executors.

Defined results: a null text has no words, no label and score 0; the score is
the largest weighted share of rare words among the accepted templates, or 1 with
a base phrase; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.llm.text import ascii_lower

# What separates words, base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of common licenses, and the phrase that must stand in each.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "released under the apache license 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright and related"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
]

RARE_WORDS = 5
SHARE = 0.6


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def rare_words(docs: DataFrame, templates: list[tuple[str, str, str]]) -> list[list[tuple[str, int, float]]]:
    """Per template its rarest words as (word, position, inverse document frequency), over all documents."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_append(F.array_intersect(known, license_words(F.col("text"))), F.lit(""))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # one row per template word, and one for all
    total = counts.get("", 0)
    weight = lambda w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-6
    out = []
    for _, text, _ in templates:
        places = {w: i for i, w in reversed(list(enumerate(text.split())))}
        chosen = sorted(places, key=lambda w: (-weight(w), places[w]))[:RARE_WORDS]
        out.append([(w, places[w], weight(w)) for w in chosen])
    return out


def _postings(templates: list[tuple[str, str, str]], rare: list[list[tuple[str, int, float]]]) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for t, chosen in enumerate(rare):
        for word, place, _ in chosen:
            out.setdefault(word, []).append((t, place))
    return out


def _match(words: Column, start: Column, template: tuple[str, str, str], rare: list[tuple[str, int, float]]) -> Column:
    """Weighted share of the rare words at their places, or null below SHARE or without the key phrase."""
    total = sum(w for *_, w in rare)
    found = sum((F.when(F.get(words, start + p) == w, F.lit(x)).otherwise(F.lit(0.0)) for w, p, x in rare), F.lit(0.0))
    text, phrase = template[1].split(), template[2].split()
    at = next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)
    key = F.lit(True)
    for i, w in enumerate(phrase):
        key = key & F.coalesce(F.get(words, start + at + i) == w, F.lit(False))
    share = F.least(found / F.lit(total), F.lit(1.0))
    return F.when(key & (share >= SHARE), share)


def _base(joined: Column, count: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places of a phrase, its first and its last start; words stand between single blanks each."""
    mark = "".join(f" {w} " for w in phrase.split())
    here = F.contains(joined, F.lit(mark))
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    n = (F.length(joined) - F.length(F.replace(joined, F.lit(mark), F.lit("")))) / len(mark)
    first = blanks(F.substring_index(joined, mark, 1)) / 2
    last = count - len(phrase.split()) - blanks(F.substring_index(joined, mark, -1)) / 2
    return F.when(here, n.cast("long")).otherwise(F.lit(0).cast("long")), F.when(here, first.cast("long")), F.when(here, last.cast("long"))


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rare = rare_words(docs, templates)
    postings = _postings(templates, rare)
    indexed = F.array(*[F.lit(w) for w in sorted(postings)])
    words = docs.select("doc_id", license_words(F.col("text")).alias("words"))

    def found_at(word: Column, place: Column) -> Column:
        """Matches of all templates that hold this word, were it at its place in them."""
        out = F.lit(None).cast("array<struct<label:string,share:double>>")
        for w, entries in postings.items():
            hits = [F.struct(F.lit(templates[t][0]).alias("label"), _match(F.col("words"), place - p, templates[t], rare[t]).alias("share")) for t, p in entries]
            out = F.when(word == w, F.array(*hits)).otherwise(out)
        return F.filter(out, lambda m: m["share"].isNotNull())

    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(indexed, w), F.struct(w.alias("word"), i.alias("place")))), lambda h: h.isNotNull())
    matches = F.flatten(F.filter(F.transform(places, lambda h: found_at(h["word"], h["place"])), lambda m: F.size(m) > 0))
    none = F.array().cast("array<struct<label:string,share:double>>")
    joined = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    base = {p: _base(F.col("joined"), F.col("n_words"), p) for p in PHRASES}
    labels = F.filter(F.array(*[F.when(n > 0, F.lit(PHRASES[p])) for p, (n, _, _) in base.items()]), lambda x: x.isNotNull())
    both = F.array_union("base", F.transform("matches", lambda m: m["label"]))
    return (
        words.withColumns({"joined": joined, "n_words": F.size("words").cast("long"), "matches": F.when(F.arrays_overlap("words", indexed), matches).otherwise(none)})
        .withColumns(
            {
                "n_base": sum((n for n, _, _ in base.values()), F.lit(0).cast("long")),
                "first_word": F.least(*[f for _, f, _ in base.values()]),
                "last_word": F.greatest(*[x for _, _, x in base.values()]),
                "base": labels,
            }
        )
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
            F.array_join(F.array_sort(both), ",").alias("labels"),
            F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))).alias("score"),
        )
    )
