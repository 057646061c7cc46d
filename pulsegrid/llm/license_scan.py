"""License scans by diagonal voting, in DataFrame functions only.

Words of a text and of license templates are compared by their ``GRAM``-grams. Every hit (a gram of the text equal to a gram
of a template) votes for the diagonal, its place in the text minus its place in the template: a copy of the template
puts all its votes on one, and a copy with words inserted or left out on some that lie side by side. Diagonals at most ``SLACK``
apart are merged to a span, and a span is verified: the grams' words are equal (not their hashes alone), the words that name
the license stand together on one diagonal, and the words of the template that hits cover are at least ``SHARE`` of the
longer one, span or template.

Rolling hashes are made inside the row and only those that some template has leave it, so the join with the templates (fixed
text of this module, broadcast) sees hits and not words. One pass reads the texts; what it finds is written, and votes are
shuffled by row, template and diagonal, so no key is larger than what one text holds.

Beside the method stand the base phrases: places where the words of a phrase follow each other.

Defined results: null and empty texts have no words, places or labels and score 0; labels are distinct, sorted and joined by
commas (empty: none); equal texts get equal results, repeated rows one each; a null key is kept; an empty table gives an
empty result; other columns are left behind.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Words that may be inserted or missing between two parts of a copy.
SLACK = 3
SHARE = 0.75

#: Phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    """A license's text or notice, in lower case words, and the words (``GRAM`` at least) that tell it from others."""

    label: str
    text: str
    key: str

    def __post_init__(self) -> None:
        assert f" {self.key} " in f" {self.text} " and len(self.key.split()) >= GRAM


def _notice(label: str, name: str, key: str | None = None) -> Template:
    """Licensed, released, distributed or available under a name."""
    return Template(label, f"under {name}", key or name)


#: Notices as authors write them, and the openings and bodies of the licenses' public texts.
TEMPLATES: tuple[Template, ...] = (
    _notice("mit", "the mit license"),
    _notice("apache-2", "the apache license version 2 0", "apache license version 2"),
    _notice("cc-by-nc", "cc by nc"),
    _notice("cc-by-sa", "cc by sa"),
    _notice("cc-by-nd", "cc by nd"),
    _notice("gpl-2", "the gnu general public license version 2"),
    _notice("gpl-3", "the gnu general public license version 3"),
    _notice("lgpl", "the gnu lesser general public license", "gnu lesser general public license"),
    _notice("agpl", "the gnu affero general public license", "gnu affero general public license"),
    _notice("mpl-2", "the mozilla public license version 2 0", "mozilla public license version 2"),
    _notice("bsd", "the bsd license"),
    _notice("isc", "the isc license"),
    Template("cc-by-nc", "creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike license", "creative commons attribution sharealike"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "without limitation the rights to use copy modify merge publish distribute sublicense",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "www apache org licenses license 2 0",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        "terms of the gnu general public license",
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
)


def words_of(text: Column) -> Column:
    """The words of a text (null: none), with A to Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def _hash(words: Sequence[Column]) -> Column:
    return F.xxhash64(*words)


def _scanned(docs: DataFrame, key: str, text: str, phrases: Sequence[tuple[str, str]], templates: Sequence[Template]) -> DataFrame:
    """Written: one row a document with its base places and its hits (at, hash, gram)."""
    rows = docs.select(F.col(key).alias("_key"), words_of(F.col(text)).alias("_w"))

    def places_of(phrase: str) -> Column:
        first, *rest = phrase.split()
        stands = lambda x, i: reduce(lambda a, b: a & b, [x == F.lit(first), *[F.get("_w", i + k) == F.lit(w) for k, w in enumerate(rest, 1)]])
        return F.filter(F.transform("_w", lambda x, i: F.when(stands(x, i), i)), lambda v: v.isNotNull())

    places = [places_of(p) for p, _ in phrases]
    grams = sorted({tuple(w[i : i + GRAM]) for t in templates for w in [t.text.split()] for i in range(len(w) - GRAM + 1)})
    known = [_hash([F.lit(w) for w in g]) for g in grams]
    rolled = F.transform("_w", lambda x, i: F.struct(i.alias("at"), _hash([F.get("_w", i + k) for k in range(GRAM)]).alias("hash")))
    hits = F.filter(rolled, lambda r: r["hash"].isin(known) & (r["at"] <= F.size("_w") - GRAM))
    found = rows.select(F.monotonically_increasing_id().alias("_row"), "_key", "_w", *[p.alias(f"_p{k}") for k, p in enumerate(places)], hits.alias("_h"))
    all_places = F.concat(*[f"_p{k}" for k in range(len(phrases))])
    base = F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda v: v.isNotNull())
    grammed = F.transform("_h", lambda h: F.struct(h["at"].alias("at"), h["hash"].alias("hash"), F.slice("_w", h["at"] + 1, GRAM).alias("gram")))
    out = found.select("_row", "_key", F.size("_w").cast("long").alias("n_words"), all_places.alias("_places"), F.array_sort(F.array_distinct(base)).alias("_base"), grammed.alias("_hits"))
    return materialize(out, "scanned")


def _grams_of(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """The gram positions of the templates: as many rows as the templates have words at most."""
    rows = []
    for i, t in enumerate(templates):
        w, k = t.text.split(), t.key.split()
        first = next(j for j in range(len(w)) if w[j : j + len(k)] == k)
        rows.append(F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.text).alias("text"), F.lit(first).alias("key_from"), F.lit(first + len(k) - GRAM).alias("key_to")))
    listed = spark.range(1).select(F.inline(F.array(*rows))).withColumn("w", F.split("text", " "))
    each = listed.select("template", "label", "key_from", "key_to", F.size("w").alias("length"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - GRAM)).alias("pos"))
    each = each.withColumn("gram", F.slice("w", F.col("pos") + 1, GRAM)).drop("w")
    return each.withColumn("hash", _hash([F.get("gram", F.lit(k)) for k in range(GRAM)]))


def _verified(scanned: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Verified spans: _row, _key, template, label, first_word, last_word, share."""
    hits = scanned.where(F.size("_hits") > 0).select("_row", "_key", F.inline("_hits"))
    votes = hits.join(F.broadcast(_grams_of(scanned.sparkSession, templates)), ["hash", "gram"])
    by = ["_row", "_key", "template", "label", "length"]
    diagonals = votes.groupBy(*by, "key_from", "key_to", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.collect_set("pos").alias("covered"), F.min("at").alias("start"), F.max("at").alias("end"),
        F.sum((F.col("pos").between(F.col("key_from"), F.col("key_to"))).cast("int")).alias("named"),
    )
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True))
    merged = diagonals.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(along))
    merged = merged.withColumn("named", F.col("named") == F.col("key_to") - F.col("key_from") + 1)
    spans = merged.groupBy(*by, "_span").agg(F.flatten(F.collect_list("covered")).alias("covered"), F.min("start").alias("start"), (F.max("end") + GRAM - 1).alias("end"), F.max("named").alias("named"))
    matched = F.size(F.array_distinct(F.flatten(F.transform("covered", lambda p: F.sequence(p, p + GRAM - 1)))))
    spans = spans.withColumn("share", matched / F.greatest("length", F.col("end") - F.col("start") + 1))
    verified = spans.where(F.col("named") & (F.col("share") >= SHARE))
    return verified.select("_row", "_key", "template", "label", F.col("start").cast("long").alias("first_word"), F.col("end").cast("long").alias("last_word"), "share")


def license_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """The verified spans: key, template (its number), label, first_word, last_word, share."""
    return _verified(_scanned(docs, key, text, PHRASES, templates), templates).drop("_row").withColumnRenamed("_key", key)


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row a document: key, n_words, n_base, first_word, last_word (of the base places), base_labels, labels, score, n_spans.

    score: 1 where a base phrase stands, else the largest share of a verified span, else 0.
    """
    scanned = _scanned(docs, key, text, phrases, templates)
    of_row = _verified(scanned, templates).groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share"), F.count("*").alias("n_spans"))
    out = scanned.drop("_hits").join(of_row, "_row", "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    return out.select(
        F.col("_key").alias(key), "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
