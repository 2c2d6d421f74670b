"""License scan by diagonal voting.

Each task rolls a hash over every k words of its texts and keeps the places whose hash is one of the templates' (the
rest of the join is empty by then). Spark joins the kept places to template positions. A copy of a template lies on one
diagonal (place in the text minus position in the template); a copy with words put in or left out lies on a few
neighbouring ones. Places are counted per diagonal, diagonals closer than ``drift`` words are merged into one span, and
a span counts when the words that really agree cover at least ``share`` of its template.

Base labels come from fixed phrases whose words stand consecutively, in the same pass over the words.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.llm import words
from rentroll.llm.shared import save

# Phrases and the label each stands for.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Opening words of public license notices, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation the"
     " rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]

SCANNED = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>,"
    " hits array<struct<place:bigint,gram:bigint,said:string>>"
)


def template_grams(spark, templates, k):
    """(gram, said, template, label, position, size): every k words of every template; as many rows as their words."""
    rows = []
    for number, (label, text) in enumerate(templates):
        w = words.hash_of(text)
        for i, g in enumerate(w.grams(k).astype(np.int64).tolist()):
            rows.append((g, w.text(i, k), number, label, i, len(w.start)))
    return spark.createDataFrame(rows, "gram bigint, said string, template int, label string, position bigint, size int")


def scan(documents, templates=TEMPLATES, phrases=PHRASES, k=3):
    """One row per document: word count, places of the base phrases, and places of template grams."""
    known = np.unique(np.concatenate([words.hash_of(t).grams(k) for _, t in templates]))
    near = np.zeros(1 << 16, bool)
    near[known & np.uint64(0xFFFF)] = True

    def places_of(w, phrase, n):
        found = np.flatnonzero((w.grams(n) == words.hash_of(phrase).grams(n)[0]) & w.within(n))
        return [i for i in found.tolist() if w.text(i, n) == phrase]

    def one_slice(w, ids):
        n = len(ids)
        base = [[] for _ in range(n)]
        labels = [set() for _ in range(n)]
        hits = [[] for _ in range(n)]
        row = w.of()
        for phrase, label in phrases:
            for i in places_of(w, phrase, phrase.count(" ") + 1):
                base[row[i]].append(i - int(w.first[row[i]]))
                labels[row[i]].add(label)
        grams = w.grams(k)
        maybe = np.flatnonzero(near[grams & np.uint64(0xFFFF)] & w.within(k))
        maybe = maybe[np.isin(grams[maybe], known)]
        for i in maybe.tolist():
            place = i - int(w.first[row[i]])
            hits[row[i]].append({"place": place, "gram": int(grams[i].astype(np.int64)), "said": w.text(i, k)})
        return {
            "doc_id": ids,
            "n_words": np.diff(w.first),
            "n_base": [len(b) for b in base],
            "first_word": [min(b, default=None) for b in base],
            "last_word": [max(b, default=None) for b in base],
            "base": [sorted(x) for x in labels],
            "hits": hits,
        }

    def run(batches):
        hit = pa.struct([("place", pa.int64()), ("gram", pa.int64()), ("said", pa.string())])
        kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.list_(hit)]
        for batch in batches:
            ids = batch.column("doc_id")
            for row, to, w in words.slices(batch.column("text")):
                got = one_slice(w, ids.slice(row, to - row))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got.values(), kinds)], list(got))

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


def spans(hits, grams, k, drift, share):
    """Verified spans: (row, template, label, first_place, last_place, votes, cover) from (row, place, gram, said)."""
    votes = (
        hits.join(grams, ["gram", "said"])  # the words themselves agree, not only their hash
        .withColumn("diagonal", F.col("place") - F.col("position"))
        .groupBy("row", "template", "label", "size", "diagonal")
        .agg(
            F.count(F.lit(1)).alias("votes"),
            F.min("place").alias("first_place"),
            F.max("place").alias("last_place"),
            F.collect_set("position").alias("positions"),  # at most the template's length
        )
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > drift
    merged = (
        votes.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "template", "label", "size", "span")
        .agg(
            F.sum("votes").alias("votes"),
            F.min("first_place").alias("first_place"),
            (F.max("last_place") + k - 1).alias("last_place"),
            F.array_distinct(F.flatten(F.collect_set("positions"))).alias("positions"),
        )
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + (k - 1))))))
    return merged.withColumn("cover", covered / F.col("size")).filter(F.col("cover") >= share).drop("positions", "span")


def label(documents, templates=TEMPLATES, phrases=PHRASES, k=3, drift=4, share=0.6):
    """One row per row of ``documents`` (doc_id, text), further columns ignored.

    n_words, n_base (all places of base phrases), first_word and last_word (smallest and largest place; null without
    any), base_labels and labels (distinct, sorted, comma-joined; the latter with those of verified spans), score (1 with
    a base phrase, else the best cover of a template, 0 without any span), n_spans. Null text counts as empty: no words.
    Repeated rows and repeated doc_ids are each scanned and reported on their own.
    """
    spark = documents.sparkSession
    scanned = save(scan(documents, templates, phrases, k).withColumn("row", F.monotonically_increasing_id()), "scanned")
    hits = scanned.select("row", F.inline("hits"))
    found = spans(hits, template_grams(spark, templates, k), k, drift, share)
    per_row = found.groupBy("row").agg(
        F.collect_set("label").alias("span_labels"),
        F.max("cover").alias("best"),
        F.count(F.lit(1)).alias("n_spans"),
    )
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union("base", F.coalesce("span_labels", none)))
    return scanned.drop("hits").join(per_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
    )
