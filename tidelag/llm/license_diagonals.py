"""Licence notices in documents, found by diagonal voting.

1. Templates are notices with a label, cut into words; every run of GRAM words is hashed with its place.
2. One pass over the documents hashes every run of GRAM words and joins all of them to the template places.  A meeting
   at word ``at`` of a document and ``place`` of a template votes for the diagonal ``at - place``.  The words themselves
   are compared too, so no vote rests on a hash alone.
3. Votes are added up per (row, template, diagonal).  A word more or less in a document moves the rest of the notice to
   a neighbouring diagonal, so diagonals of one template at most DRIFT apart are merged to one span.
4. A span is verified on the words: those of the template that stand at their place on one of its diagonals, as a share
   of the template.  A share of 4/5 or more gives the document the template's label.

Only built-in expressions are used.  The templates are broadcast where their measured size is small; votes are few and
combine before they are shuffled, and the row is never shuffled with its text.

Defined results: NULL and empty texts have no words, places or labels and score 0; each row is judged by its own text,
equal rows alike, NULL and repeated ids too; a template of fewer words than GRAM gives no votes; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.llm.common import shared_dir, wide_row_key, written

GRAM = 3
DRIFT = 3  # words that may be missing or added at one place of a notice
BROADCAST_WORDS = 1_000_000  # templates whose words, squared, add up to more are joined without a broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that decide alone, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices as their licences word them.
NOTICES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
    ),
    (
        "gpl-2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version",
    ),
    (
        "agpl-3",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of digits, letters and characters beyond ASCII."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates: label, text."""
    rows = [F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in NOTICES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _gram(words: str, at: str) -> str:
    return ", ".join(f"get({words}, {at} + {i})" for i in range(GRAM))


def template_places(templates: DataFrame) -> DataFrame:
    """template, label, t_words, place, gram: every run of GRAM words of every distinct template."""
    cut = templates.select("label", words_of(F.col("text")).alias("t_words")).distinct()
    named = cut.withColumn("template", F.xxhash64("label", "t_words")).where(F.size("t_words") >= GRAM)
    placed = named.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("t_words") - GRAM)))
    return placed.withColumn("gram", F.expr(f"xxhash64({_gram('t_words', 'place')})"))


def _sized(places: DataFrame) -> DataFrame:
    """``places``, marked for broadcast if their measured size is small."""
    total = places.agg(F.coalesce(F.sum(F.size("t_words")), F.lit(0))).first()[0]
    return F.broadcast(places) if total <= BROADCAST_WORDS else places


def diagonals(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """row, template, label, t_size, diagonal, votes, agreeing (template places verified on the words).

    ``rows``: row, words.
    """
    grams = (
        rows.where(F.size("words") >= GRAM)
        .select("row", "words", F.explode(F.sequence(F.lit(0), F.size("words") - GRAM)).alias("at"))
        .withColumn("gram", F.expr(f"xxhash64({_gram('words', 'at')})"))
    )
    same = " and ".join(f"get(words, at + {i}) = get(t_words, place + {i})" for i in range(GRAM))
    # What agrees along a diagonal is the same for all its votes, so the first vote of each run of them finds it out.
    leads = "not (at > 0 and place > 0 and get(words, at - 1) = get(t_words, place - 1))"
    agreeing = "filter(sequence(0, size(t_words) - 1), j -> get(t_words, j) = get(words, at - place + j))"
    votes = grams.join(_sized(template_places(templates)), "gram").where(same)
    return (
        votes.selectExpr(
            "row", "template", "label", "size(t_words) as t_size", "at - place as diagonal", f"if({leads}, {agreeing}, null) as agreeing"
        )
        .groupBy("row", "template", "label", "t_size", "diagonal")
        .agg(F.count("*").alias("votes"), F.first("agreeing", ignorenulls=True).alias("agreeing"))
    )


def spans(voted: DataFrame) -> DataFrame:
    """row, label, first, stop, votes, agreed, t_size: merged neighbouring diagonals, verified or not."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT
    merged = voted.withColumn("span", F.sum(F.when(far, 1).otherwise(0)).over(order))
    return (
        merged.groupBy("row", "template", "label", "t_size", "span")
        .agg(
            F.sum("votes").alias("votes"),
            F.min(F.col("diagonal") + F.array_min("agreeing")).alias("first"),
            (F.max(F.col("diagonal") + F.array_max("agreeing")) + 1).alias("stop"),
            F.size(F.array_distinct(F.flatten(F.collect_list("agreeing")))).alias("agreed"),
        )
        .drop("template", "span")
    )


def verified(agreed: str = "agreed", size: str = "t_size") -> Column:
    return 5 * F.col(agreed) >= 4 * F.col(size)


def _phrase_places(phrase: str) -> Column:
    """Words at which a phrase begins; looked for only where the text has the phrase at all."""
    parts = phrase.split(" ")
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    stands = " and ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(parts))
    places = F.expr(f"filter(sequence(0, size(words) - 1), i -> {stands})")
    return F.when(F.contains(text, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def phrase_places(rows: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``rows`` (with ``words``) and n_base, first_word, last_word, base (sorted labels)."""
    found = rows.withColumns({f"__p{i}": _phrase_places(p) for i, p in enumerate(phrases)})
    places = [F.col(f"__p{i}") for i in range(len(phrases))]
    named = [F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, phrases.values())]
    out = found.withColumns(
        {
            "n_base": sum((F.size(p) for p in places[1:]), F.size(places[0])).cast("long"),
            "first_word": F.array_min(F.concat(*places)).cast("long"),
            "last_word": F.array_max(F.concat(*places)).cast("long"),
            "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))),
        }
    )
    return out.drop(*[f"__p{i}" for i in range(len(phrases))])


def licences(
    documents: DataFrame,
    templates: DataFrame | None = None,
    phrases: Mapping[str, str] = PHRASES,
    folder: str | None = None,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``documents``.

    ``templates``: label, text; the built-in notices by default.
    """
    spark = documents.sparkSession
    folder = folder or shared_dir(spark)
    rows = documents.select(F.col("doc_id").cast("long"), wide_row_key().alias("row"), words_of(F.col("text")).alias("words"))
    voted = diagonals(rows.select("row", "words"), notices(spark) if templates is None else templates)
    found = written(spans(written(voted, folder, "diagonals")), folder, "spans")
    per_row = found.groupBy("row").agg(
        F.collect_set(F.when(verified(), F.col("label"))).alias("own"),
        F.max(F.col("agreed") / F.col("t_size")).alias("score"),
    )
    based = phrase_places(rows, phrases).withColumn("n_words", F.size("words").cast("long")).drop("words")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return based.join(per_row.hint("rebalance"), "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
