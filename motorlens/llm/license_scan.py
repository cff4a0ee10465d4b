"""License notices in documents by diagonal voting.

All rolling word k-grams of all documents are hashed and joined by Spark to the places at
which the templates hold them.  A match votes for its diagonal, the place in the document
less the place in the template; a notice is a diagonal with many votes, one with words put
in or left out goes on a neighbouring diagonal.  Diagonals that lie close together are
merged and what they claim is verified: the matches must follow one another in both texts,
cover enough of the template and lie in a span that is not much longer than it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.functions.shipping import by_value
from motorlens.llm.kernels import ALPHANUMERIC, mixed, owners, pieces, spans, word_hashes
from motorlens.session import materialise

by_value(__name__)

# words in a gram of a phrase, of which every place is reported, and of a notice, which may be changed a little
PHRASE_GRAM = 2
NOTICE_GRAM = 3
# diagonals so far apart are neighbours, and so many words may be put in or left out for every four of the template
BAND = 3
SLACK = 4
LEAST_COVERED = 0.75
LONGEST_SPAN = 1.5
# template places that every task holds; a larger table of templates is met by a shuffle
MOST_PLACES = 200_000
# grams in a row of the table that is joined
BLOCK = 1 << 15

# fixed values: phrases of which all places count, and their labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# fixed values: notices as their licenses word them, and their labels
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation", "lgpl"),
    ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
]

TEMPLATES = "template int, label string, exact boolean, n_words int, width int, gram long, place int"


def _grams(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and how many every text has."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - width + 1 + k], width)
    text = owners(bounds)[: len(rolled)]
    inside = np.arange(len(rolled)) + width <= bounds[1:][text]
    return rolled[inside], counts


def _hashed(text: str) -> np.ndarray:
    for _, data, offsets in pieces(pa.array([text])):
        starts, ends, _ = spans(data, offsets, ALPHANUMERIC)
        return word_hashes(data, starts, ends, ALPHANUMERIC)
    return np.zeros(0, np.uint64)


def template_places(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """All places of the templates with the hashes of the grams that stand there; a text shorter than a gram is none."""
    rows, template = [], 0
    for exact, width, texts in ((True, PHRASE_GRAM, phrases), (False, NOTICE_GRAM, notices)):
        for text, label in texts:
            hashes = _hashed(text)
            rolled, _ = _grams(hashes, np.array([0, len(hashes)]), width)
            rows += [(template, label, exact, len(hashes), width, int(h), place) for place, h in enumerate(rolled.view(np.int64))]
            template += 1
    return spark.createDataFrame(rows, TEMPLATES)


def _gram_kernel(kind: pa.DataType, widths: list[int]) -> Callable:
    """Arrow batches ``(doc_id, text)`` to blocks of grams and one row of width 0 for every document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                n = len(offsets) - 1
                starts, ends, bounds = spans(data, offsets, ALPHANUMERIC)
                hashes = word_hashes(data, starts, ends, ALPHANUMERIC)
                rows = np.arange(number, number + n)
                number += n

                def table(row, ids, words, width, at, sizes, grams):
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(grams.view(np.int64)))
                    return pa.RecordBatch.from_arrays(
                        [pa.array(row), ids, words, pa.array(np.full(len(row), width, np.int32)), pa.array(at), lists],
                        names=["row", "doc_id", "n_words", "width", "at", "grams"])

                yield table(rows, batch.column(0).slice(first, n).cast(kind), pa.array(np.diff(bounds).astype(np.int64)), 0,
                            np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.uint64))
                for width in widths:
                    rolled, counts = _grams(hashes, bounds, width)
                    blocks = -(-counts // BLOCK)
                    text = np.repeat(np.arange(n), blocks)
                    if not len(text):
                        continue
                    at = (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
                    sizes = np.minimum(BLOCK, counts[text] - at)
                    yield table(rows[text], pa.nulls(len(text), kind), pa.nulls(len(text), pa.int64()), width, at, sizes, rolled)

    return kernel


def template_matches(docs: DataFrame, templates: DataFrame, most_places: int = MOST_PLACES) -> DataFrame:
    """The stored matches ``(row, doc_id, n_words, template, place, diagonal)`` and a row without template per document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    arrow = {T.LongType: pa.int64(), T.IntegerType: pa.int32()}.get(type(kind), pa.string())
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()),
        T.StructField("width", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())),
    ])
    widths = [r[0] for r in templates.select("width").distinct().collect()]
    blocks = docs.select("doc_id", "text").mapInArrow(_gram_kernel(arrow, widths), schema)
    # the row that stands for a document meets a place of its own
    own = spark.createDataFrame([(None, 0, 0, None)], "template int, width int, gram long, place int")
    places = templates.select("template", "width", "gram", "place").unionByName(own)
    if templates.count() <= most_places:
        places = F.broadcast(places)
    grams = blocks.select("row", "doc_id", "n_words", "width", "at", F.posexplode("grams").alias("_i", "gram"))
    met = grams.join(places, ["width", "gram"])
    return materialise(met.select(
        "row", "doc_id", "n_words", "template", "place", (F.col("at") + F.col("_i") - F.col("place")).alias("diagonal")))


def _chain(diagonals: list[int], places: list[list[int]], width: int) -> tuple[int, int, int]:
    """``(covered words, first, last)``: the longest run of matches that go on in both texts."""
    pairs = sorted({(d + p, -p) for d, some in zip(diagonals, places) for p in some})
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, minus) in enumerate(pairs):
        k = bisect_left(tails, -minus)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(-minus)
            ends.append(i)
        else:
            tails[k], ends[k] = -minus, i
    chain, i = [], ends[-1]
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    covered = {-minus + k for _, minus in chain for k in range(width)}
    return len(covered), chain[-1][0], chain[0][0] + width - 1


def _verified(diagonals: list[int], places: list[list[int]], n_words: int, width: int) -> Iterator[tuple[int, int, float]]:
    """``(first, last, share of the template)`` of the notices among merged diagonals."""
    reach, i = n_words // SLACK + BAND, 0
    while i < len(diagonals):
        upto = bisect_left(diagonals, diagonals[i] + reach + 1, i)
        if sum(map(len, places[i:upto])) >= LEAST_COVERED * n_words / width:
            covered, first, last = _chain(diagonals[i:upto], places[i:upto], width)
            share = covered / n_words
            if share >= LEAST_COVERED and last - first + 1 <= LONGEST_SPAN * n_words:
                yield first, last, share
                while i < len(diagonals) and diagonals[i] <= last:
                    i += 1
                continue
        i += 1


FOUND = "row long, template int, first_word long, last_word long, share double"


def _verify_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row, template, n_words, width, lines in zip(*[c.to_pylist() for c in batch.columns]):
            diagonals, places = [line["diagonal"] for line in lines], [line["places"] for line in lines]
            found += [(row, template, *span) for span in _verified(diagonals, places, n_words, width)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        columns = list(zip(*found)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "template", "first_word", "last_word", "share"])


def license_spans(matches: DataFrame, templates: DataFrame) -> DataFrame:
    """``(row, label, exact, first_word, last_word, share)``: every place of a phrase and every verified notice."""
    kinds = templates.groupBy("template", "label", "exact", "n_words", "width").agg(F.count(F.lit(1)).alias("_grams"))
    votes = matches.where("template is not null").groupBy("row", "template", "diagonal").agg(
        F.array_sort(F.collect_set("place")).alias("places"))
    lines = materialise(votes.join(F.broadcast(kinds), "template"))
    whole = lines.where(F.col("exact") & (F.size("places") == F.col("_grams"))).select(
        "row", "label", "exact", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("n_words") - 1).alias("last_word"),
        F.lit(1.0).alias("share"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = lines.where(~F.col("exact")).withColumn(
        "_new", (F.col("diagonal") - F.lag("diagonal").over(line) > BAND).cast("int"))
    groups = apart.withColumn("_group", F.sum(F.coalesce("_new", F.lit(0))).over(line)).groupBy("row", "template", "_group").agg(
        F.first("n_words").alias("n_words"), F.first("width").alias("width"), F.sum(F.size("places")).alias("_votes"),
        F.array_sort(F.collect_list(F.struct("diagonal", "places"))).alias("lines"))
    # fewer matches cannot cover the share
    claimed = groups.where(F.col("_votes") * F.col("width") >= LEAST_COVERED * F.col("n_words"))
    found = claimed.select("row", "template", "n_words", "width", "lines").mapInArrow(_verify_kernel, FOUND)
    notices = found.join(F.broadcast(kinds.select("template", "label", "exact")), "template")
    return whole.unionByName(notices.select("row", "label", "exact", "first_word", "last_word", "share"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, most_places: int = MOST_PLACES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every document.

    Words are runs of letters, digits and characters above 0x7F, A-Z in lower case.
    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the
    smallest and the largest of them (null without any), ``base_labels`` their labels and
    ``labels`` also those of notices, sorted and joined by commas.  ``score`` is 1 for a
    phrase, for a notice the share of its words that the document holds in order, else 0.
    Null and empty texts hold nothing; equal rows are judged one by one; overlapping places
    count each; an empty table gives no rows; further columns are not used.  Without
    templates every document is free of licenses.
    """
    templates = template_places(docs.sparkSession) if templates is None else templates
    matches = template_matches(docs, templates, most_places)
    found = license_spans(matches, templates)
    base = F.col("exact")
    per_row = found.groupBy("row").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    rows = matches.where("template is null").select("row", "doc_id", "n_words")
    return rows.join(materialise(per_row), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
