"""License scans by diagonal voting, with DataFrame operations only.

Every run of k words of a document is joined by its hash to the places in the
templates where it stands. A hit votes for the diagonal (place in the document
minus place in the template); a copy of a template is a diagonal with many
votes. Neighbouring diagonals, which come from small insertions and deletions,
are merged, and the template's words are aligned, in their order, with those of
the document along the merged diagonals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .native_words import grams, words

#: Label, whether it is a base phrase, text.
TEMPLATES = (
    ("mit", True, "mit license"),
    ("apache", True, "apache license"),
    ("gpl", True, "general public license"),
    ("cc-by-nc", False, "licensed under cc by-nc 4.0"),
    ("proprietary", False, "all rights reserved"),
    ("mit", False, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", False, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", False, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", False, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", False, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", False, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
)
#: Words in a gram: of templates of up to SHORT words, and of longer ones.
SHORT, K_SHORT, K_LONG = 7, 2, 5
#: Diagonals this near are one copy; the share of grams that must vote, and of the template's words that must be aligned.
NEAR, VOTES, VERIFIED = 4, 0.4, 0.75


def template_table(spark: SparkSession) -> DataFrame:
    """t, label, base and w (words) of the templates: a constant of a few rows."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {quote(label)}, {str(base).lower()}, {quote(text)})" for i, (label, base, text) in enumerate(TEMPLATES))
    return spark.sql(f"SELECT * FROM VALUES {values} AS x(t, label, base, text)").select("t", "label", "base", words(F.col("text")).alias("w"))


def template_grams(spark: SparkSession) -> DataFrame:
    """k, h and place of the grams of each template, with what the vote needs of it."""
    rows = template_table(spark).withColumn("k", F.when(F.size("w") <= SHORT, K_SHORT).otherwise(K_LONG))
    parts = [rows.filter(F.col("k") == k).withColumn("g", grams("w", k)).select("t", "label", "base", "w", "k", F.size("g").alias("n_grams"), F.posexplode("g").alias("place", "h")) for k in (K_SHORT, K_LONG)]
    return parts[0].unionAll(parts[1])


def gram_rows(words_: str, k: int) -> Column:
    return F.transform(grams(words_, k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("at"), h.alias("h")))


def candidates(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """row (the carried columns), n_words, rid (a number of the row) and w, its words where a gram is one of a template.

    Written, so that the numbers stay what they are and texts are split once.
    The templates are a constant: their hashes stand in the plan.
    """
    known = {k: [r.h for r in template_grams(docs.sparkSession).filter(F.col("k") == k).select("h").distinct().collect()] for k in (K_SHORT, K_LONG)}
    rows = docs.select(F.struct(*carry).alias("row"), words(F.col("text")).alias("w"))
    some = reduce(Column.__or__, [F.arrays_overlap(grams("w", k), F.array(*map(F.lit, hashes))) for k, hashes in known.items()])
    rows = rows.select("row", F.size("w").cast("long").alias("n_words"), F.monotonically_increasing_id().alias("rid"), F.when(some, F.col("w")).alias("w"))
    return written(rows, "license-candidates")


def votes(rows: DataFrame) -> DataFrame:
    """rid, template and span of the candidate copies in rows (rid, w); from and to are the diagonals of a copy."""
    hits = rows.select("rid", F.explode_outer(F.concat(gram_rows("w", K_SHORT), gram_rows("w", K_LONG))).alias("g")).select("rid", "g.*")
    hits = hits.join(F.broadcast(template_grams(rows.sparkSession)), ["k", "h"])  # the templates are a constant
    by = ["rid", "t", "k", "n_grams", "base"]
    diagonals = hits.groupBy(*by, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    order = W.partitionBy("rid", "t").orderBy("diagonal")
    near = F.when(F.col("base"), 0).otherwise(NEAR)  # a base phrase has to stand as it is
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True))
    runs = diagonals.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order))
    merged = runs.groupBy(*by, "run").agg(F.min("lo").alias("lo"), (F.max("hi") + F.max("k")).alias("hi"), F.sum("n").alias("n"), F.min("diagonal").alias("from"), F.max("diagonal").alias("to"))
    return merged.filter(F.col("n") >= F.when(F.col("base"), 1.0).otherwise(VOTES) * F.col("n_grams")).select("rid", "t", "lo", "hi", "from", "to")


def aligned(w: Column, template: Column, first: Column, last: Column) -> Column:
    """How many words of a template stand in ``w`` in the same order, each between the diagonals ``first`` and ``last``."""

    def step(acc: Column, p: Column) -> Column:
        places = F.when(F.greatest(p + first, acc["end"]) <= p + last, F.sequence(F.greatest(p + first, acc["end"]), p + last))
        at = F.get(F.filter(places, lambda q: F.get(w, q) == F.get(template, p)), F.lit(0))
        return F.when(at.isNotNull(), F.struct((acc["n"] + 1).alias("n"), (at + 1).alias("end"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.sequence(F.lit(0), F.size(template) - 1), start, step, lambda acc: acc["n"])


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (the carried columns), n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    Base places are exact: a base phrase whose grams all vote for one diagonal is
    compared word by word. Of other templates VERIFIED of the words must be
    aligned with the document's; the score is the best share found (1 with a base
    place, 0 without any match). Spans are (label, first word, word past the end).

    A null text has no words and no labels ('' and score 0). Each row is judged
    by its own words, whether its doc_id is null, repeated or neither: rows are
    told apart by a number of their own. Only rows that hold a gram of a template
    are shuffled, by that number; the others pass with nothing found.
    """
    rows = candidates(docs, carry)
    some, none = rows.filter("w IS NOT NULL"), rows.filter("w IS NULL")
    templates = F.broadcast(template_table(docs.sparkSession).withColumnRenamed("w", "tw"))  # a constant
    found = some.select("rid", "w").join(votes(some.select("rid", "w")), "rid").join(templates, "t")
    share = aligned(F.col("w"), F.col("tw"), F.col("from"), F.col("to")) / F.size("tw")
    found = found.select("rid", "lo", "hi", "label", "base", share.alias("share")).filter(F.col("share") >= F.when(F.col("base"), 1.0).otherwise(VERIFIED))
    found = found.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "label", "base", "share")).alias("checked"))
    base = F.filter("checked", lambda m: m["base"])
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["lo"].cast("long"))
    spans = F.array_sort(F.transform("checked", lambda m: F.struct(m["label"].alias("label"), m["lo"].alias("first"), m["hi"].alias("past"))))
    columns = {"n_base": F.size(base).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts), "base_labels": names(base), "labels": names(F.col("checked")), "score": F.array_max(F.transform("checked", lambda m: m["share"])), "spans": spans}
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "spans": F.array()}
    found = some.select("rid", "row", "n_words").join(found, "rid", "left").select("row", "n_words", *[F.coalesce(c, empty[n]).alias(n) if n in empty else c.alias(n) for n, c in columns.items()])
    nothing = [empty.get(n, F.lit(None)).cast(found.schema[n].dataType).alias(n) for n in columns]
    return found.unionAll(none.select("row", "n_words", *nothing))
