"""License texts in documents, found by diagonal voting.

All k-grams of a text's words are joined with those of the license templates. A shared
k-gram at word i of the text and word j of a template votes for the diagonal i - j: an
unbroken copy puts all votes on one diagonal, inserted or missing words move the later ones
to a neighbour. Votes are counted by diagonal, runs of neighbouring diagonals are merged, and
the span they name is aligned with the template word by word, in order. Of spans that overlap
the one aligned best stays, so that a license which differs from another by a word is not
taken for it.

Short phrases are matched as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch
from tallyfold.llm.words import NOT_ALPHANUMERIC, lower_ascii, with_shingles, words_between

#: Phrases that name a license by themselves, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Sentences that grant or name a license, with their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)

#: Words in a k-gram.
K = 3
#: Diagonals at most so far apart belong to one run.
GAP = 2
#: Share of a template's words that a span has to have in their order, each word in between taken off.
MIN_SCORE = 0.8
#: Words of a text that are one block when overlapping spans are brought together.
BLOCK = 64


def _templates(spark: SparkSession, templates, k: int) -> DataFrame:
    """(template, label, words, size, place, shingle): fixed by ``templates``, not by the data."""
    df = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    words = words_between(lower_ascii(F.col("text")), NOT_ALPHANUMERIC)
    df = df.select("template", "label", words.alias("words"), F.size(words).alias("size"), F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    df = with_shingles(df, "hashes", k, "shingles")
    return df.select("template", "label", "words", "size", F.posexplode("shingles").alias("place", "shingle"))


def phrase_counts(words: str, phrases=PHRASES) -> Column:
    """Array of (label, n, first, last) of the phrases that the array column ``words`` has.

    ``n`` counts all places where a phrase's words stand consecutively, ``first`` and ``last``
    are the words at which the first and last of them start. The joined words are cut before
    each phrase: the words in the parts give the places.
    """
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    found = []
    for phrase, label in phrases:
        before = F.split(joined, f" (?={phrase} )")
        before = F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0)))
        sizes = F.transform(before, lambda p: F.size(F.array_remove(F.split(p, " "), "")))
        one = F.struct(
            F.lit(label).alias("label"),
            F.size(sizes).cast("long").alias("n"),
            F.try_element_at(sizes, F.lit(1)).alias("first"),
            F.aggregate(sizes, F.lit(0), lambda a, n: a + n).alias("last"),
        )
        found.append(F.when(F.contains(joined, F.lit(f" {phrase} ")), one))
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = K, gap: int = GAP, min_score: float = MIN_SCORE) -> DataFrame:
    """(row, template, label, start, end): spans of ``docs`` (row, hashes) voted for, in words from 0."""
    spark = docs.sparkSession
    known = F.broadcast(_templates(spark, templates, k).drop("words"))  # as large as ``templates``
    places = with_shingles(docs, "hashes", k, "shingles").select("row", F.posexplode("shingles").alias("at", "shingle"))
    votes = places.join(known, "shingle").select("row", "template", "label", "size", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    voted = votes.groupBy("row", "template", "label", "size", "diagonal").agg(
        F.count("*").alias("votes"), F.collect_set("place").alias("places")
    )
    # runs of neighbouring diagonals; a text and template have at most as many as the text has words
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    runs = voted.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda p: F.sequence(p, p + (k - 1)))))
    merged = runs.groupBy("row", "template", "label", "size", "run").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), covered.alias("covered")
    )
    return merged.where(F.size("covered") >= min_score * F.col("size")).select(
        "row", "template", "label", F.greatest("low", F.lit(0)).alias("start"), (F.col("high") + F.col("size")).alias("end")
    )


def aligned_words(own: str, words: str, longest: int) -> Column:
    """The most words of the array ``words`` that a part of the array ``own`` has in order, less its other words.

    A word of ``words`` may be missing, and costs what it would have counted; a word of ``own``
    between two aligned ones costs one. ``longest`` bounds the length of ``words``. The state
    after a word of ``own`` holds, for each place in ``words``, the best that ends there or
    before, and at its end the best so far.
    """
    shifts = F.array(*(F.lit(1 << b) for b in range(longest.bit_length())))
    size = F.size(words) + 1
    nothing = F.array_repeat(F.lit(0), size)

    def upto(values: Column) -> Column:
        """Running maximum: over twice as many places a step."""
        return F.aggregate(shifts, values, lambda v, by: F.slice(F.zip_with(v, F.concat(F.slice(nothing, 1, by), v), lambda a, b: F.greatest(a, b)), 1, size))

    def after(row: Column, word: Column) -> Column:
        before = F.zip_with(words, F.concat(F.array(F.lit(0)), row), lambda t, b: F.struct(t.alias("t"), b.alias("b")))
        met = F.zip_with(
            before, row,
            lambda p, here: F.when(p["t"].isNull(), here).when(p["t"] == word, p["b"] + 1).otherwise(F.greatest(here - 1, F.lit(0))),
        )
        return upto(F.slice(met, 1, size))

    return F.aggregate(own, nothing, after, lambda row: F.element_at(row, -1))


def best_of_overlapping(spans: DataFrame) -> DataFrame:
    """``spans`` (row, template, label, start, end, size, score) that no better one overlaps.

    Better is the higher score, then the longer template, then the template named first.
    Spans meet by blocks of their row, so no row's spans are compared all with all.
    """
    blocks = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    placed = spans.withColumn("rank", F.struct("score", "size", (-F.col("template")).alias("template")))
    placed = placed.withColumn("block", F.explode(blocks))
    other = placed.select("row", "block", F.col("start").alias("other_start"), F.col("end").alias("other_end"), F.col("rank").alias("other_rank"))
    beaten = (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")) & (F.col("rank") < F.col("other_rank"))
    lost = placed.join(other, ["row", "block"]).where(beaten).select("row", "template", "start", "end").distinct()
    return spans.join(lost, ["row", "template", "start", "end"], "left_anti")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, gap: int = GAP, min_score: float = MIN_SCORE) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text); other columns are not read.

    n_words; ``phrases``, with their places; ``spans``, the verified template spans that no
    better one overlaps, or null;
    ``score``, 1 with a phrase and else the best span's, 0 without either.
    A null text is an empty one. Rows are told apart by their place, so ids may be null or repeat.
    """
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    words = words_between(lower_ascii(F.col("text")), NOT_ALPHANUMERIC)
    split = docs.select("doc_id", "text").withColumn("words", words).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # a text none of whose k-grams any template has cannot have a vote: its words are not kept
    known = [r.shingle for r in _templates(spark, templates, k).select("shingle").distinct().collect()]
    marked = with_shingles(split, "hashes", k, "shingles").withColumn("votes", F.exists("shingles", lambda s: s.isin(known)))
    facts = scratch.write(
        marked.select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            phrase_counts("words", phrases).alias("phrases"),
            F.when(F.col("votes"), F.col("words")).alias("words"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    voting = facts.where("words is not null").select("row", "words")
    spans = license_spans(voting.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))), templates, k, gap, min_score)
    # verified on the words themselves, in their order
    wording = _templates(spark, templates, k).where("place = 0").select("template", "size", "words")
    longest = max((len(t.words) for t in wording.collect()), default=1)  # as many rows as ``templates``
    own = F.slice("own", F.col("start") + 1, F.col("end") - F.col("start"))
    compared = voting.withColumnRenamed("words", "own").join(spans, "row").withColumn("own", own)
    compared = compared.join(F.broadcast(wording), "template")
    compared = compared.withColumn("score", aligned_words("own", "words", longest) / F.col("size"))
    likely = scratch.write(compared.where(F.col("score") >= min_score).select("row", "template", "label", "start", "end", "size", "score"))
    verified = best_of_overlapping(likely).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("label", "start", "end", "score"))).alias("spans")
    )
    found = facts.select("row", "doc_id", "n_words", "phrases").join(verified, "row", "left")
    best = F.array_max(F.transform("spans", lambda s: s["score"]))
    score = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))
    return found.select("doc_id", "n_words", "phrases", "spans", score.alias("score"))
