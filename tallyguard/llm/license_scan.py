"""License notices in texts: MinHash bands over overlapping windows, then exact containment.

Words are runs of ASCII letters and digits, lower-cased; shingles are five words. Templates are
cut into segments of ``SEGMENT`` words, texts into windows of ``WINDOW`` words every ``STRIDE``
words, and every shingle of a template that a text holds is a window of its own as well. A window
and a segment that share the smallest shingle under any of ``BANDS`` hash functions meet (bands
of one row). A segment that lies whole in a text meets it with certainty, wherever it lies: the
smallest of its shingles is one of these windows under every hash function. A single shingle of
an eight-word segment meets it unless it is the smallest under none of the functions, about once
in 10 ** 8 shingles; that depends on the template only, not on the text around it. Segments
hold about half of a template's shingles or more, so a text with ``CONTAINMENT`` of them holds
some of a segment's. Only windows with a shingle of some template can meet one, so only those
are hashed; that leaves nothing out.

A template that was retrieved is verified on the whole text: at least ``CONTAINMENT`` of its
distinct shingles must occur. Templates are data, a table of names and texts whose shingles are
collected once; texts stay distributed. Everything is DataFrame expressions.

A null text holds nothing. Templates of fewer than five words are never found. Rows are kept
one to one, repeated or not; a column that bears the name of the added one is replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import stage
from .text import indices, let

SHINGLE, WINDOW, STRIDE, SEGMENT, BANDS, CONTAINMENT = 5, 16, 4, 8, 64, 0.8
MAX_SHINGLES = 200_000  # of all templates, which are collected and shipped with the plan

# Public license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at"
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation"
    ),
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    rows = list((TEMPLATES if templates is None else templates).items())
    return spark.createDataFrame(rows, "name string, text string")


def _words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """64-bit hashes of all shingles, in order."""
    return F.transform(
        indices(F.size(words) - (SHINGLE - 1)),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]),
    )


def _signature(shingles: Column) -> Column:
    """The smallest value of the shingles under each hash function."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda band: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band))),
    )


def _segments(shingles: Column) -> Column:
    """Signatures of the template's segments; the last one ends with the template."""
    width = SEGMENT - SHINGLE + 1
    last = F.greatest(F.size(shingles) - width, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(SEGMENT)), F.array(last)))
    return F.transform(starts, lambda at: _signature(F.slice(shingles, at + 1, F.lit(width))))


def _windows(shingles: Column, hits: Column) -> Column:
    """Signatures of the windows that hold a hit."""
    width = WINDOW - SHINGLE + 1
    starts = F.flatten(
        F.transform(
            hits,
            lambda hit: F.transform(
                F.sequence(F.lit(0), F.lit(width - 1), F.lit(STRIDE)),
                lambda back: F.greatest(
                    F.lit(0), F.floor(hit["at"] / F.lit(STRIDE)).cast("int") * STRIDE - back
                ),
            ),
        )
    )
    return F.transform(
        F.array_distinct(starts), lambda at: _signature(F.slice(shingles, at + 1, F.lit(width)))
    )


def _single(hits: Column) -> Column:
    """Signatures of the hits as windows of one shingle."""
    distinct = F.array_distinct(F.transform(hits, lambda hit: hit["h"]))
    return F.transform(distinct, lambda h: _signature(F.array(h)))


def _bands(signatures: Column) -> Column:
    """Distinct (band, value) of an array of signatures."""
    return F.array_distinct(_listed(signatures))


def _listed(signatures: Column) -> Column:
    """(band, value) of an array of signatures."""
    return F.flatten(
        F.transform(
            signatures,
            lambda s: F.transform(s, lambda v, band: F.struct(band.alias("band"), v.alias("value"))),
        )
    )


def scan(
    docs: DataFrame,
    templates: DataFrame | None = None,
    text: str = "text",
    out: str = "licenses",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Add the array of (name, found, size, containment) of the templates found, by name.

    The columns but the text travel with the result through the staged table.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    known = stage(
        templates.select("name", _words(F.col("text")).alias("words"))
        .select("name", _shingles(F.col("words")).alias("shingles"))
        .filter(F.size("shingles") > 0)
        .select("name", F.array_distinct("shingles").alias("distinct"), let(F.col("shingles"), lambda s: _bands(_segments(s))).alias("bands")),
        "license-templates",
    )
    all_shingles = [r["h"] for r in known.select(F.explode("distinct").alias("h")).distinct().limit(MAX_SHINGLES + 1).collect()]
    if len(all_shingles) > MAX_SHINGLES:
        raise ValueError(f"templates hold more than {MAX_SHINGLES} distinct shingles")

    own = [c for c in docs.columns if c not in (text, out)]
    read = docs.select(
        F.monotonically_increasing_id().alias("_number"),
        F.struct(*own).alias("_row") if own else F.lit(True).alias("_row"),
        let(_words(F.col(text)), lambda w: _found(_shingles(w), all_shingles)).alias("_found"),
    )
    read = stage(read, "license-hits")  # the number of a row is fixed from here on
    met = read.select("_number", F.explode("_found.bands").alias("b")).select("_number", "b.*")
    table = known.select("name", F.explode("bands").alias("b")).select("name", "b.*")
    retrieved = met.join(table, ["band", "value"]).select("_number", "name").distinct()
    hits = read.filter(F.size("_found.hits") > 0).select("_number", "_found.hits")
    verified = (
        hits.join(retrieved, "_number")
        .join(known.select("name", "distinct"), "name")
        .withColumn("found", F.size(F.array_intersect("distinct", F.transform("hits", lambda x: x["h"]))))
        .withColumn("containment", F.col("found") / F.size("distinct"))
        .filter(F.col("containment") >= containment)
    )
    listed = verified.groupBy("_number").agg(
        F.sort_array(
            F.collect_list(F.struct("name", "found", F.size("distinct").alias("size"), "containment"))
        ).alias(out)
    )
    none = F.array().cast("array<struct<name:string,found:int,size:int,containment:double>>")
    return read.join(listed, "_number", "left").select(
        *[F.col("_row")[c].alias(c) for c in own], F.coalesce(out, none).alias(out)
    )


def _found(shingles: Column, known: list[int]) -> Column:
    """The hits of known shingles, and the bands of the windows around them."""
    none = F.array().cast("array<struct<band:int,value:bigint>>")

    def around(hashes: Column) -> Column:
        hits = F.filter(
            F.transform(hashes, lambda h, i: F.when(h.isin(known), F.struct(i.alias("at"), h.alias("h")))),
            lambda x: x.isNotNull(),
        )
        return let(
            hits,
            lambda hs: F.struct(
                hs.alias("hits"),
                F.when(
                    F.size(hs) > 0, F.concat(_bands(_windows(hashes, hs)), _listed(_single(hs)))
                ).otherwise(none).alias("bands"),
            ),
        )

    return let(shingles, around)
