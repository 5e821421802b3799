"""License scan: base phrases, and template texts found by diagonal voting.

Every rolling k-gram hash of every text is joined with the positions of the
same k-gram in the license templates.  A match votes for the diagonal (place
in the text minus place in the template).  Votes are counted by diagonal,
neighbouring diagonals (words put in or left out) are merged into one span, and
a span is verified by the share of the template's words that its matches cover
within a span not much longer than the template.  Where neighbours make a longer
chain, every window of that length in it is verified.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesight.llm import words as W
from linesight.llm.common import staged

K = 3
MERGE = 4              # diagonals at most this far apart are neighbours
COVERED = 0.8          # share of a template's words that a span must cover
STRETCH = 1.5          # a span's length at most, in template lengths

#: base phrases and their labels (fixed values of the query)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: templates of the method: short notices of well-known licenses (public texts)
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "Distributed under the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
]


def word_list(text: str) -> list[str]:
    data, offsets = W.text_buffer(pa.array([text]))
    w = W.find_words(data, offsets, W.ALNUM)
    raw = W.LOWER[data].tobytes()
    return [raw[s:e].decode() for s, e in zip(w.starts, w.ends, strict=True)]


def _document_key(words: W.Words, ids: np.ndarray) -> np.ndarray:
    """Key of (doc_id, word sequence): rows share it only as repeats."""
    at = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(words.hashes + W.mix(at.astype(np.uint64))), dtype=np.uint64)])
    return (W.mix(total[words.first[1:]] - total[words.first[:-1]]) ^ W.mix(ids.astype(np.uint64) + np.uint64(1))).view(np.int64)


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def base_counts(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """(doc_id, key, n_words, n_base, first_word, last_word, base) of every row."""
    runs = [(W.hash_words(word_list(p)), label) for p, label in phrases.items()]
    labels = sorted(set(phrases.values()))

    def run(it):
        for batch in it:
            for rows, words in W.batches(batch.column(1), W.ALNUM):
                n, h, row = len(words.counts), words.hashes, words.row_of_word()
                places, kinds = [], []
                for phrase, label in runs:
                    ok = np.ones(max(0, len(h) - len(phrase) + 1), bool)
                    for j, x in enumerate(phrase):
                        ok &= h[j:len(ok) + j] == x
                    p = np.flatnonzero(ok)
                    p = p[row[p] == row[p + len(phrase) - 1]] if len(p) else p
                    places.append(p)
                    kinds.append(np.full(len(p), labels.index(label)))
                p, kind = np.concatenate(places), np.concatenate(kinds)
                r = row[p]
                at = p - words.first[r]
                least, most = np.full(n, 2**62), np.full(n, -1)
                np.minimum.at(least, r, at)
                np.maximum.at(most, r, at)
                bits = np.zeros(n, np.int64)
                np.bitwise_or.at(bits, r, 1 << kind)
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(_document_key(words, _ids(ids))), pa.array(words.counts), pa.array(np.bincount(r, minlength=n)), pa.array(least, mask=most < 0), pa.array(most, mask=most < 0), pa.array([[x for i, x in enumerate(labels) if b >> i & 1] for b in bits], pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def rolling_grams(docs: DataFrame, k: int) -> DataFrame:
    """(key, place, gram): every k-gram of every text."""
    def run(it):
        for batch in it:
            for rows, words in W.batches(batch.column(1), W.ALNUM):
                key = _document_key(words, _ids(batch.column(0).slice(rows.start, rows.stop - rows.start)))
                row, g = words.row_of_word(), W.grams(words.hashes, k)
                ok = row[:len(g)] == row[k - 1:k - 1 + len(g)]
                row = row[:len(g)][ok]
                place = np.flatnonzero(ok) - words.first[row]
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(place.astype(np.int32)), pa.array(g[ok].view(np.int64))], names=["key", "place", "gram"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "key long, place int, gram long")


def template_spans(docs: DataFrame, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """(key, template, label, first, last, covered): verified spans."""
    spark = docs.sparkSession
    sized, positions = [], []
    for t, (label, text) in enumerate(templates):
        h = W.hash_words(word_list(text))
        sized.append((t, label, len(h)))
        positions += [(int(g), t, p) for p, g in enumerate(W.grams(h, k).view(np.int64))]
    table = spark.createDataFrame(positions, "gram long, template int, at int")    # the templates are a bounded parameter
    names = spark.createDataFrame(sized, "template int, label string, length int")
    hits = rolling_grams(docs, k).join(F.broadcast(table), "gram").select("key", "template", "place", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    # a repeated row votes once
    votes = staged(hits.groupBy("key", "template", "diagonal").agg(F.sort_array(F.collect_set(F.struct("place", "at"))).alias("votes")), "votes")
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    # a new span where the diagonal leaps
    leap = (F.col("diagonal") - F.lag("diagonal").over(order) > MERGE).cast("int")
    spans = votes.withColumn("span", F.sum(F.coalesce(leap, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("key", "template", "span").agg(F.min(F.element_at("votes.place", 1)).alias("first"), F.max(F.element_at("votes.place", -1)).alias("last"), F.flatten(F.collect_list(F.transform("votes", lambda v: v["at"]))).alias("at"), F.flatten(F.collect_list("votes")).alias("votes"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (k - 1))))))
    checked = merged.join(F.broadcast(names), "template").withColumn("covered", covered / F.col("length"))
    fits = F.col("last") + k - F.col("first") <= STRETCH * F.col("length") + MERGE
    enough = checked.where(F.col("covered") >= COVERED)
    found = enough.where(fits).select("key", "template", "label", F.col("first").cast("long"), (F.col("last") + (k - 1)).cast("long").alias("last"), "covered")
    # a chain of neighbours may be longer than any notice in it
    return found.union(split_chains(enough.where(~fits), k))


def split_chains(chains: DataFrame, k: int) -> DataFrame:
    """(key, template, label, first, last, covered): verified spans in chains that
    are too long, apart from each other, those that cover the most first."""
    def run(it):
        for batch in it:
            out: list[tuple] = []
            for key, template, label, length, votes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hits = sorted((v["place"], v["at"]) for v in votes)
                seen, covered, to, spans = [0] * length, 0, 0, []
                for i, (place, at) in enumerate(hits):
                    while to < len(hits) and hits[to][0] + k - place <= STRETCH * length + MERGE:
                        for x in range(hits[to][1], hits[to][1] + k):
                            covered += seen[x] == 0
                            seen[x] += 1
                        to += 1
                    if covered / length >= COVERED:
                        spans.append((-covered, place, hits[to - 1][0] + k - 1))
                    for x in range(at, at + k):
                        seen[x] -= 1
                        covered -= seen[x] == 0
                taken: list[tuple] = []   # sorted, apart from each other
                for c, first, last in sorted(spans):
                    at = bisect.bisect(taken, (first,))
                    if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                        taken.insert(at, (first, last))
                        out.append((key, template, label, first, last, -c / length))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["key", "template", "label", "first", "last", "covered"])
    return chains.select("key", "template", "label", "length", "votes").mapInArrow(run, "key long, template int, label string, first long, last long, covered double")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; further columns are
    ignored): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans.

    Words are runs of a-z, 0-9 and non-ASCII after A-Z is lower-cased.  Base
    places of phrases are counted everywhere.  score is the largest covered
    share of a verified template, 0 without one.  A null text is empty: no
    words, no labels.  Repeated rows give repeated results; an empty table none."""
    rows = base_counts(docs, phrases)
    span = F.struct("first", "last", "label", "covered")
    found = template_spans(docs, templates, k).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("covered").alias("score"), F.sort_array(F.collect_list(span)).alias("spans"))
    joined = rows.join(found.withColumnRenamed("key", "found_key"), F.col("key") == F.col("found_key"), "left")
    both = F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",")
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), both.alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint,label:string,covered:double>>")).alias("spans"))
