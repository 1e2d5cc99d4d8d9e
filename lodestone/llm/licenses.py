"""License scans (operator 3), native.

Method: texts are word sequences (lower case, runs of a-z and 0-9), hashed as
shingles of five words.  Overlapping windows of 2 * 2**c shingles, 2**c apart, are
laid over the shingles for every size class c of the templates, so that a whole
notice of up to 2**c shingles lies in some window.  A window and a template meet
if one of BANDS MinHash values is the same (bands of one value); a notice of which
0.8 is present has a Jaccard similarity of 0.19 or more with its window, so it is
missed with a probability of at most (1 - 0.19) ** BANDS, below 0.0001.  Then the
share of the template's shingles in the window is counted exactly, on the words.

A window's value can equal a template's only where the window holds that very
shingle.  So windows are laid only over the places where a shingle is some
template's minimum; all others can't meet a template.

Only DataFrame functions.  Nothing of a document is shuffled until its windows
have met a template; templates are a parameter of bounded size and are sent to
every task.  A passage in a third of all documents costs each of them a few
windows.

Defined results: null, empty and short texts have no match; a template of fewer
than five words is refused with a ValueError; a text with several places of one
license gives one row; repeated rows are documents with the same id and give one
row; a null id is kept; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 48
SHINGLE = 5
SHARE = 0.8

#: Notices of public licenses, as they are commonly worded.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _hashes(w: Column) -> Column:
    """The hash of the shingle at every place; none for fewer than SHINGLE words."""
    places = F.sequence(F.lit(0), F.size(w) - SHINGLE)
    return F.when(F.size(w) >= SHINGLE, F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def _minima(hashes: Column) -> Column:
    """MinHash values: the least of each band's own hash of the shingles' hashes."""
    return F.transform(F.lit(list(range(BANDS))), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band))))


def _least(hashes: Column) -> Column:
    """The shingles' hashes that give the MinHash values."""
    return F.transform(F.lit(list(range(BANDS))), lambda band: F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, band).alias("value"), h.alias("h"))))["h"])


def _shingles(w: Column) -> Column:
    """Distinct shingles as text."""
    places = F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, parts (shingles), minima, step (2 ** class), least (hashes of the minima's shingles)."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("w", words(F.col("text")))
    made = rows.where(F.size("w") >= SHINGLE).withColumn("parts", _shingles(F.col("w")))
    step = F.pow(F.lit(2), F.ceil(F.log2(F.size("w") - (SHINGLE - 1)))).cast("int")
    return made.select("license", "parts", _minima(_hashes(F.col("w"))).alias("minima"), step.alias("step"), _least(_hashes(F.col("w"))).alias("least"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (largest share of the template's shingles in a window), n_windows, first_word (where the first such window's first shingle of the template begins)."""
    spark = docs.sparkSession
    # Templates are a bounded parameter; their rows come to the driver and go to every task.
    known = _templates(spark, TEMPLATES if templates is None else templates).collect()
    if len(known) < len(TEMPLATES if templates is None else templates):
        raise ValueError(f"a template needs {SHINGLE} words")
    fields = "license string, parts array<string>, minima array<bigint>, step int"
    small = spark.createDataFrame([tuple(r)[:4] for r in known], fields)
    minima = sorted({h for r in known for h in r["least"]})
    steps = sorted({r["step"] for r in known})

    wanted = F.lit(minima)
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    # Behind a generator the hashes are a column; a filter can't make Spark compute them again.
    rows = rows.select("doc_id", F.inline(F.array(F.struct("w", _hashes(F.col("w")).alias("h"))))).where(F.arrays_overlap("h", wanted))
    # What follows sees only documents that may match.
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains(wanted, F.get("h", i)))
    rows = rows.select("doc_id", F.inline(F.array(F.struct("w", "h", places.alias("at")))))
    laid = F.flatten(F.array(*(_laid(step) for step in steps)))
    windows = rows.select("doc_id", "w", "h", F.explode(laid).alias("x")).select("doc_id", "w", "h", "x.step", "x.start")
    own = F.slice("h", F.col("start") + 1, F.col("step") * 2)
    banded = windows.select("doc_id", "step", "start", F.slice("w", F.col("start") + 1, F.col("step") * 2 + (SHINGLE - 1)).alias("w"), _minima(own).alias("minima"))
    bands = small.select("license", "parts", "step", F.posexplode("minima").alias("band", "value")).groupBy("step", "band", "value").agg(F.collect_list(F.struct("license", "parts")).alias("held"))
    # A window has BANDS values; a struct of them is probed by an equi-join on step, band and value.
    probes = banded.select("doc_id", "step", "start", "w", F.posexplode("minima").alias("band", "value"))
    met = probes.join(F.broadcast(bands), ["step", "band", "value"]).select("doc_id", "step", "start", "w", F.explode("held").alias("t")).select("doc_id", "start", "w", "t.license", "t.parts")
    met = met.dropDuplicates(["doc_id", "license", "start"])
    found = F.array_intersect("parts", _shingles(F.col("w")))
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.size("w") - SHINGLE + 1), lambda i: F.array_contains("parts", F.array_join(F.slice("w", i, SHINGLE), " "))), F.lit(True)) - 1
    checked = met.where(F.size("w") >= SHINGLE).withColumn("containment", F.size(found) / F.size("parts")).where(F.col("containment") >= share)
    placed = checked.select("doc_id", "license", "containment", "start", (F.col("start") + first).alias("first_word"))
    return placed.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("first_word").alias("first_word"))


def _laid(step: int) -> Column:
    """The windows of one size over the places in ``at``."""
    nth = F.transform("at", lambda p: (p / step).cast("int"))
    starts = F.array_distinct(F.flatten(F.array(nth, F.transform(nth, lambda n: F.greatest(n - 1, F.lit(0))))))
    return F.transform(starts, lambda n: F.struct(F.lit(step).alias("step"), (n * step).alias("start")))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the result of ``scan``: every window is counted exactly, without MinHash."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))

    def split(text: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"

    def parts(source: str) -> str:
        return f"SELECT * EXCLUDE w, array_to_string(w[p + 1 : p + {SHINGLE}], ' ') AS part FROM (SELECT *, unnest(range(0, len(w) - {SHINGLE - 1})) AS p FROM {source} WHERE len(w) >= {SHINGLE})"

    return f"""
        WITH t AS (SELECT license, {split("text")} AS w FROM (VALUES {values}) AS v(license, text)),
        tp AS ({parts("(SELECT license, w, CAST(2 ** ceil(log2(len(w) - 4)) AS BIGINT) AS step FROM t)")}),
        ts AS (SELECT license, step, count(DISTINCT part) AS size FROM tp GROUP BY ALL),
        d AS (SELECT doc_id, {split("text")} AS w FROM {table} WHERE text IS NOT NULL),
        dp AS ({parts("d")}),
        hit AS (SELECT dp.doc_id, dp.p, dp.part, x.license, x.step FROM dp JOIN (SELECT DISTINCT license, step, part FROM tp) x ON dp.part = x.part),
        laid AS (SELECT DISTINCT doc_id, p, part, license, step, unnest([p // step, greatest(p // step - 1, 0)]) AS n FROM hit),
        win AS (SELECT doc_id, license, step, n, count(DISTINCT part) AS have, min(p) AS first_word FROM laid GROUP BY ALL)
        SELECT win.doc_id, win.license, max(have / size) AS containment, count(*) AS n_windows, CAST(min(first_word) AS BIGINT) AS first_word
        FROM win JOIN ts USING (license) WHERE have / size >= {SHARE} GROUP BY win.doc_id, win.license
    """
