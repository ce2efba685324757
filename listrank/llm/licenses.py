"""License scans: exact phrases, and an exact set-similarity join of text blocks (windows of words, wherever lines break)
with notice templates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Phrases whose every place counts, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public license notices, as sets of words, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("reserved", "all rights reserved"),
)
CONTAINMENT = 0.8
#: Words of all templates together up to which their prefix index is broadcast.
BROADCAST_WORDS = 100_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only code point beyond ASCII whose lower case is an ASCII letter.
_KELVIN = "\u212A"


def _words(text: Column) -> Column:
    """The loose words of a text whose letters a-z are lower-cased as A-Z are and nothing else becomes a-z. lower() is the
    faster way; what it does to letters beyond A-Z parts no words and makes no ASCII word."""
    lowered = F.when(F.contains(text, F.lit(_KELVIN)), ascii_lower(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _GAP), "")


def _known_words(words: Column, vocabulary: Sequence[str]) -> Column:
    """array<struct(at, word)> of the words of a text that stand in the vocabulary, with their numbers there."""
    number = F.create_map(*[F.lit(x) for i, w in enumerate(vocabulary) for x in (w, i)])
    seen = F.transform(words, lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("at"), F.element_at(number, w).alias("word"))))
    return F.array_compact(seen)


def phrase_places(known: Column, vocabulary: Sequence[str], phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """array<struct(label, start)> of every place of every phrase in the known words of a text."""
    found = []
    for phrase, label in phrases:
        parts = [vocabulary.index(w) for w in phrase.split()]
        places = F.transform(known, _start_of(known, parts, label))
        found.append(F.array_compact(places))
    return F.concat(*found)


def _start_of(known: Column, parts: list[int], label: str):
    """The place of a phrase that begins at a known word: its words are the next known ones, one after another."""

    def at(x: Column, i: Column) -> Column:
        here = x["word"] == parts[0]
        for k, p in enumerate(parts[1:], 1):
            after = F.get(known, i + k)
            here = here & (after["word"] == p) & (after["at"] == x["at"] + k)
        return F.when(here, F.struct(F.lit(label).alias("label"), x["at"].alias("start")))

    return at


def _windows(known: Column, width: Column) -> Column:
    """The sorted distinct ranks of each window of `width` words that starts at a known word: other windows hold no more.
    known: array<struct(at, rank)>, by place."""

    def window(x: Column, k: Column) -> Column:
        return F.filter(F.slice(known, k + 1, width), lambda y: y["at"] < x["at"] + width)

    return F.transform(known, lambda x, k: F.array_sort(F.array_distinct(F.transform(window(x, k), lambda y: y["rank"]))))


def template_matches(rows: DataFrame, keys: Sequence[str], vocabulary: Sequence[str], templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """rows(keys, known): keys, labels (array), containment, for each row with a block that holds at least `containment`
    of a template's distinct words. The blocks for a template are all windows of as many words as it has, wherever lines
    break: a wrapped notice is one block, and words farther apart are none, however long their line.

    Words are ordered by the number of rows that have them, rarest first. A block needs a = ceil(containment * |T|)
    words of a template T, so it has one of T's first |T| - a + 1 words (prefix filter), a or more words of templates
    (length filter), and from their first shared word on both must have enough words left (positional filter). What
    remains is intersected in full. The filters lose nothing, so the order affects the cost alone. A row's windows are
    cut only for the templates of which it has a prefix word, and its blocks meet as sets, each once."""
    spark = rows.sparkSession
    number = {w: i for i, w in enumerate(vocabulary)}
    sets = [(len(text.split()), label, sorted({number[w] for w in text.split()})) for label, text in templates]
    counts = rows.select(F.explode(F.array_distinct(F.transform("known", lambda x: x["word"]))).alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # at most one row for each word of the templates
    order = sorted(range(len(vocabulary)), key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index, prefix, least = [], {}, {}
    for width, label, ws in sets:
        ranks, need = sorted(rank[w] for w in ws), math.ceil(containment * len(ws) - 1e-9)
        least[width] = min(need, least.get(width, need))
        for i, r in enumerate(ranks[: len(ws) - need + 1]):
            index.append((r, label, i, need, ranks, width))
            prefix.setdefault(width, set()).add(order[r])
    every = spark.createDataFrame(index, "word_rank int, label string, t_at int, need int, t_ranks array<int>, t_width int")
    if sum(len(x[4]) for x in index) <= BROADCAST_WORDS:
        every = F.broadcast(every)
    ranks = F.array(*[F.lit(rank[w]) for w in range(len(vocabulary))])
    widths = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(n).alias("least"), F.array(*map(F.lit, sorted(prefix[w]))).alias("prefix")) for w, n in sorted(least.items())])
    words, ranked = F.transform("known", lambda x: x["word"]), F.transform("known", lambda x: F.struct(x["at"].alias("at"), F.get(ranks, x["word"]).alias("rank")))
    told = rows.select(*keys, F.array_distinct(words).alias("_words"), ranked.alias("_known"))
    hopeful = told.select(*keys, "_known", F.explode(F.filter(widths, lambda w: F.arrays_overlap(w["prefix"], F.col("_words")) & (F.size("_words") >= w["least"]))).alias("w"))
    # sets travel as texts here, since texts are told apart by hash and arrays pair by pair
    blocks = F.filter(_windows(F.col("_known"), F.col("w.width")), lambda x: F.size(x) >= F.col("w.least"))
    blocks = hopeful.select(*keys, F.col("w.width").alias("width"), F.explode(F.array_distinct(F.transform(blocks, lambda x: F.array_join(x.cast("array<string>"), ",")))).alias("block"))
    blocks = blocks.select(*keys, "width", F.split("block", ",").cast("array<int>").alias("ranks"))
    pairs = blocks.select(*keys, "width", "ranks", F.posexplode("ranks").alias("b_at", "word_rank")).join(every, "word_rank").where(F.col("width") == F.col("t_width"))
    size_t, size_b, need = F.size("t_ranks"), F.size("ranks"), F.col("need")
    pairs = pairs.where((size_b >= need) & (F.col("b_at") <= size_b - need) & (1 + F.least(size_t - F.col("t_at") - 1, size_b - F.col("b_at") - 1) >= need))
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    matches = pairs.select(*keys, "label", need.alias("need"), shared.alias("shared"), (shared / size_t).alias("containment")).where("shared >= need")
    return matches.groupBy(*keys).agg(F.collect_set("label").alias("labels"), F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, places (array of label and start), base_labels and labels (arrays, sorted), score: 1 where a
    phrase stands, else the largest containment of a template that meets the threshold, else 0.

    Texts are parted once: what is kept of a row is its number of words and the places of the words of phrases and
    templates, as numbers, in a checkpoint; phrases, word frequencies and blocks come from these. Rows are known by a
    number of their own there, so repeated rows each get a result, whatever their ids. Null text counts as empty. Other
    columns are ignored, so clashing names do no harm."""
    vocabulary = sorted({w for _, t in templates for w in t.split()} | {w for p, _ in phrases for w in p.split()})
    parted = docs.select("doc_id", _words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = cut(parted.select("doc_id", F.size("words").cast("long").alias("n_words"), _known_words(F.col("words"), vocabulary).alias("known"), F.monotonically_increasing_id().alias("row_key")))
    based = rows.select("row_key", "doc_id", "n_words", phrase_places(F.col("known"), vocabulary, phrases).alias("places"))
    matches = template_matches(rows.select("row_key", "known"), ("row_key",), vocabulary, templates, containment)
    found = matches.select(F.col("row_key").alias("_key"), F.col("labels").alias("_labels"), "containment")
    both = based.join(found, F.col("row_key") == F.col("_key"), "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("_labels", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "places", base_labels.alias("base_labels"), labels.alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
