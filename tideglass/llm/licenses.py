"""License scans with DataFrame functions only.

A notice in a text is found by the template it follows:

1. The text's words (lower case, outer punctuation off) give word 5-gram hashes.
2. Overlapping windows of those retrieve templates. Templates are partitioned by their number of
   shingles q. For q up to 4 a window is one shingle, and its MinHash is the shingle itself: a
   template that is there is retrieved with certainty. For larger ones windows are three blocks
   of 4, 8, 16, ... shingles, one window for each block, so that a template of up to 2 blocks + 1
   lies wholly in one. Each of 24 MinHash functions (hash xor constant, the constants spread
   evenly over the hash range) is a band of its own. A window that holds a whole template is at
   similarity 3 / 8 or more and is retrieved with probability 1 - (5/8)**24 > 0.9999; one that
   holds 0.8 of it is at 0.28 or more and is retrieved with probability 0.9996. Block minima of
   larger blocks come from those of smaller ones.
3. Retrieved templates are verified by exact shingle containment of at least 0.8, on the words
   themselves.

Templates are a table (license, text): whole license texts or single notices. It becomes part of
the plan, so templates of over ``MAX_TEMPLATE_WORDS`` words in all are taken in blocks, one pass over the texts each. ``TEMPLATES`` is a small
one of notices.

Defined results: a null or empty text has no notice; a text of under 5 words has no shingle, and
a template of under 5 words or without a name is not searched for; of templates with one name the
5-grams count together; a notice that stands twice is reported once per row; a text that reaches
the threshold for several templates, equal ones included, gives a row for each; repeated rows give
repeated results; very long texts are read whole; empty tables give no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


THRESHOLD = 0.8
WIDTH = 5
BANDS = 24
#: Templates up to this many shingles are retrieved by single shingles.
TINY = 4
#: Shingles in the smallest block; a window is three blocks.
BLOCK = 4
#: Words of the templates that one plan holds; more are scanned for in blocks, one pass over the texts each.
MAX_TEMPLATE_WORDS = 200_000

# Public license notices as they stand in texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def normal_words(text: Column) -> Column:
    """Lower-case words without punctuation at their ends; words of punctuation alone fall out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"), F.lit(0)), lambda w: F.length(w) > 0)


def _positions(count: Column, first: int = 1) -> Column:
    """first, first + 1, ...: ``count`` positions, none if it is not positive."""
    return F.when(count >= 1, F.sequence(F.lit(first), count + (first - 1))).otherwise(F.array().cast("array<int>"))


def gram_strings(words: Column) -> Column:
    """All 5-grams of a word array, as strings."""
    return F.transform(_positions(F.size(words) - WIDTH + 1), lambda i: F.array_join(F.slice(words, i, WIDTH), " "))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with new columns that are evaluated once a row.

    A plain projection would be merged with what reads it, and the lambdas above it would
    evaluate its arrays again for every element; a generator of one row is not merged.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(row)).alias("once")).select(*keep, "once.*")


def _constants() -> list[int]:
    """Evenly spread 64-bit constants for the xor family."""
    step = (1 << 64) // BANDS
    return [(i * step + step // 3) % (1 << 64) - (1 << 63) for i in range(BANDS)]


def _gram_hash(word_at: Callable[[int], Column]) -> Column:
    return F.xxhash64(*[word_at(k) for k in range(WIDTH)])


def template_table(spark: SparkSession) -> DataFrame:
    """The built-in templates: license, text."""
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def _template_blocks(templates: DataFrame) -> Iterator[dict[str, tuple[list[str], list[int]]]]:
    """Blocks of templates, each name: (5-grams, their hashes by Spark's own function).

    A block has up to ``MAX_TEMPLATE_WORDS`` words, or one template; the driver holds the names and one block.
    """
    named = templates.where("license IS NOT NULL AND text IS NOT NULL").select(F.col("license").alias("name"), normal_words(F.col("text")).alias("words"))
    sizes = sorted((r["name"], r["n"]) for r in named.groupBy("name").agg(F.sum(F.size("words")).alias("n")).collect())
    blocks: list[list[str]] = []
    room = 0
    for name, n in sizes:
        if n > room:
            blocks.append([])
            room = max(MAX_TEMPLATE_WORDS, n)
        blocks[-1].append(name)
        room -= n
    for names in blocks:
        grams = named.where(F.col("name").isin(names)).select("name", "words", F.posexplode(gram_strings(F.col("words"))).alias("i", "gram"))
        hashed = grams.select("name", "gram", _gram_hash(lambda k: F.get("words", F.col("i") + k)).alias("hash")).collect()  # bounded by the words
        found: dict[str, dict[str, int]] = {}
        for r in sorted(hashed):
            found.setdefault(r["name"], {})[r["gram"]] = r["hash"]
        if found:
            yield {name: (list(g), list(g.values())) for name, g in found.items()}


def _least_shingles(hashes: list[int]) -> list[int]:
    """The shingles of a template that are its minimum under one of the functions."""
    return [min(h ^ c for h in hashes) ^ c for c in _constants()]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in sorted(set(values))])


def _block_minima(blocks: str, constant: int) -> Column:
    mask = F.lit(constant).cast("long")
    return F.transform(blocks, lambda b: F.array_min(F.transform(b, lambda h: h.bitwiseXOR(mask))))


def _halved(minima: str) -> Column:
    """Minima of blocks of twice the size."""
    array = F.col(minima)
    return F.transform(_positions(F.ceil(F.size(array) / 2).cast("int"), 0), lambda i: F.least(F.get(array, 2 * i), F.get(array, 2 * i + 1)))


def _windows(minima: str) -> Column:
    """Minima of windows: each block with the next two."""
    array = F.col(minima)
    return F.transform(array, lambda m, i: F.least(m, F.get(array, i + 1), F.get(array, i + 2)))


def class_of(shingles: int) -> int:
    """-1 for tiny templates, else how often the smallest block is doubled."""
    if shingles <= TINY:
        return -1
    k = 0
    while shingles > 2 * (BLOCK << k) + 1:
        k += 1
    return k


_NOTICES = "doc_id long, license string, n_shared long, n_template long, containment double, first_word int"


def license_notices(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_shared, n_template, containment, first_word of every notice found.

    templates: license, text; the built-in ones if not given. Rows of one name are one template.
    """
    blocks = _template_blocks(template_table(docs.sparkSession) if templates is None else templates)
    parts = [_notices_of(docs, index, threshold) for index in blocks]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _NOTICES)


def _notices_of(docs: DataFrame, index: dict[str, tuple[list[str], list[int]]], threshold: float) -> DataFrame:
    """The notices of one block of templates."""
    by_class: dict[int, list[str]] = {}
    for name, (grams, _) in index.items():
        by_class.setdefault(class_of(len(grams)), []).append(name)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _once(texts, ["doc_id"], words=normal_words(F.col("text")))
    rows = _once(rows, ["doc_id", "words"], hashes=F.transform(_positions(F.size("words") - WIDTH + 1, 0), lambda i: _gram_hash(lambda k: F.get("words", i + k))))
    # equal minima mean that the window holds the template's own least shingle: a text without
    # any of these cannot be retrieved, and its minima need not be computed
    decisive = [h for k, names in by_class.items() for n in names for h in (index[n][1] if k < 0 else _least_shingles(index[n][1]))]
    rows = rows.where(F.arrays_overlap("hashes", _longs(decisive)))
    tiny = F.arrays_overlap("hashes", _longs([h for n in by_class[-1] for h in index[n][1]])) if -1 in by_class else F.lit(False)
    count = F.ceil(F.size("hashes") / BLOCK).cast("int")
    blocks = F.transform(_positions(count, 0), lambda i: F.slice("hashes", i * BLOCK + 1, BLOCK))
    rows = _once(rows, ["doc_id", "words"], retrieved=F.coalesce(tiny, F.lit(False)), blocks=blocks)

    constants, largest = _constants(), max(by_class)
    names = [f"m{i}" for i in range(BANDS)]
    minima = {n: _block_minima("blocks", c) for n, c in zip(names, constants, strict=True)}
    for k in range(largest + 1):
        rows = _once(rows, ["doc_id", "words", "retrieved"], **minima)
        if k in by_class:
            hits = F.lit(False)
            for n, c in zip(names, constants, strict=True):
                wanted = _longs([min(h ^ c for h in index[t][1]) for t in by_class[k]])
                hits = hits | F.coalesce(F.arrays_overlap(_windows(n), wanted), F.lit(False))
            rows = _once(rows.withColumnRenamed("retrieved", "before"), ["doc_id", "words", *names], retrieved=F.col("before") | hits)
        minima = {n: _halved(n) for n in names}
    found = _once(rows.where("retrieved"), ["doc_id"], grams=gram_strings(F.col("words")))

    def check(name: str) -> Column:
        grams = index[name][0]
        template = F.array(*[F.lit(g) for g in grams])
        shared = F.size(F.array_intersect(F.col("grams"), template))
        first = F.array_min(F.filter(F.transform(template, lambda g: F.array_position("grams", g)), lambda p: p > 0))
        return F.struct(
            F.lit(name).alias("license"), shared.cast("long").alias("n_shared"), F.lit(len(grams)).cast("long").alias("n_template"),
            (shared / F.lit(len(grams))).alias("containment"), (first - 1).alias("first_word"),
        )

    checked = found.select("doc_id", F.explode(F.array(*[check(n) for n in index])).alias("n"))
    return checked.where(F.col("n.n_shared") >= F.ceil(threshold * F.col("n.n_template") - 1e-9)).select("doc_id", "n.*")
