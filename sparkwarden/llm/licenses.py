"""Licence scans as an exact set-similarity join of text blocks with notice templates, with DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import whole_text
from sparkwarden.session import cut_lineage

#: Phrases whose places are always reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as they are commonly printed: (label, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Share of a template's words that a block must hold, and the blocks: so many words, begun every ``stride``.

    Every run of ``block_words - stride + 1`` words lies in a block of its own, so a notice of up to that
    length is never cut apart; ``fitting`` gives blocks for given templates.
    """

    containment: float = 0.9
    block_words: int = 64
    stride: int = 32


@dataclass(frozen=True)
class Template:
    """Distinct words in the global order, rare ones first, and how many of them a block must hold."""

    label: str
    words: tuple[str, ...]
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        """A block that holds ``need`` of the words holds one of these: at most ``len - need`` are missing."""
        return self.words[: len(self.words) - self.need + 1]


def template_words(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return sorted({w for w in re.split(SEPARATORS, lowered) if w})


def fitting(templates: Sequence[tuple[str, str]] = TEMPLATES) -> Settings:
    """Blocks in which a copy of the longest template fits as a whole, wherever it begins."""
    lowered = (text.translate(str.maketrans(UPPER, LOWER)) for _, text in templates)
    longest = max((sum(bool(w) for w in re.split(SEPARATORS, t)) for t in lowered), default=0)
    usual = Settings()
    fits = usual.block_words - usual.stride + 1 >= longest
    return usual if fits else replace(usual, block_words=2 * longest, stride=longest)


def normal_form(text: Column) -> Column:
    """The words in lower case, with one space before, between and after; a single space for no words."""
    lowered = F.translate(text, UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), SEPARATORS, " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


# ---- base phrases ---------------------------------------------------------------------------------


def _phrase(normal: Column, phrase: str) -> Column:
    """(n, first, last): how often a phrase stands in the words, and the first word of its first and last place."""
    parts = F.split(normal, f"(?<= ){phrase}(?= )", -1)
    size = len(phrase.split())
    found = F.transform(
        F.array(parts),
        lambda p: F.struct(
            (F.size(p) - 1).cast("long").alias("n"),
            (_spaces(p[0]) - 1).alias("first"),
            (_spaces(normal) - size - _spaces(F.element_at(p, -1))).alias("last"),
        ),
    )[0]
    return F.when(F.contains(normal, F.lit(f" {phrase} ")), found)


# ---- the join -------------------------------------------------------------------------------------


def ordered_templates(docs: DataFrame, settings: Settings, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[Template]:
    """The templates with their words ordered by the number of documents that hold them, over the whole corpus.

    Only template words are counted, once in a document and combined before the shuffle, so the result has
    at most as many rows as the templates have words.
    """
    vocabulary = sorted({w for _, text in templates for w in template_words(text)})
    words = F.split(normal_form(whole_text().cast("string")), " ")
    held = F.array_distinct(F.filter(words, lambda w: w.isin(*vocabulary)))
    counts = {r["word"]: r["count"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()}
    out = []
    for label, text in templates:
        mine = sorted(template_words(text), key=lambda w: (counts.get(w, 0), w))
        out.append(Template(label, tuple(mine), math.ceil(settings.containment * len(mine) - 1e-9)))
    return out


def prefix_index(spark, templates: list[Template]) -> DataFrame:
    """(word, template, place): the inverted index of all prefixes; its size is that of the templates."""
    rows = [
        F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(i).alias("place"))
        for t, template in enumerate(templates)
        for i, w in enumerate(template.prefix)
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scanned(docs: DataFrame, templates: list[Template], settings: Settings) -> DataFrame:
    """(row, doc_id, n_words, phrases, blocks), stored: of each row its base places and the blocks worth joining.

    ``blocks``: (start, words) of the blocks that hold a prefix word; null where the text holds none.
    """
    rare = sorted({w for t in templates for w in t.prefix})
    lits = F.array(*[F.lit(w) for w in rare])
    normal = F.col("normal")
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) - 1) / settings.stride).cast("int")),
        lambda k: F.struct((k * settings.stride).alias("start"), F.array_distinct(F.slice(w, k * settings.stride + 1, settings.block_words)).alias("words")),
    )
    blocks = F.transform(
        F.array(words),
        lambda w: F.when(F.arrays_overlap(w, lits), F.filter(cut(w), lambda b: F.arrays_overlap(b["words"], lits))),
    )[0]
    return cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_form(whole_text().cast("string")).alias("normal"))
        .withColumn("row", F.monotonically_increasing_id())
        .select(
            "row", "doc_id", (_spaces(normal) - 1).alias("n_words"),
            F.array(*[_phrase(normal, p) for p in PHRASES]).alias("phrases"), blocks.alias("blocks"),
        )
    )


def similar_blocks(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, start, label, containment) of every block that holds the needed share of a template's words.

    Prefix filter: blocks meet templates by a shared prefix word only. Length filter: a block has at least
    the needed number of template words. Positional filter: after the first shared word in the global order
    both sides must have enough words left. What remains is counted exactly.
    """
    spark = rows.sparkSession
    order = sorted({w for t in templates for w in t.words}, key=_rank(templates))
    ranks = F.array(*[F.lit(w) for w in order])
    # the block's template words, rare ones first: the intersection keeps the order of its first argument
    blocks = rows.select("row", F.explode("blocks").alias("b")).select(
        "row", "b.start", F.array_intersect(ranks, F.col("b.words")).alias("held")
    )
    met = blocks.select("row", "start", "held", F.posexplode("held").alias("at", "word")).join(
        F.broadcast(prefix_index(spark, templates)), "word"
    )
    first = met.groupBy("row", "start", "template").agg(F.min("place").alias("place"), F.min("at").alias("at"), F.first("held").alias("held"))
    table = F.array(
        *[F.struct(F.lit(t.label).alias("label"), F.array(*[F.lit(w) for w in t.words]).alias("words"), F.lit(t.need).alias("need")) for t in templates]
    )
    told = first.withColumn("t", table[F.col("template")])
    size, have = F.size("t.words"), F.size("held")
    left = 1 + F.least(size - 1 - F.col("place"), have - 1 - F.col("at"))
    shared = F.size(F.array_intersect("held", "t.words"))
    return (
        told.filter((have >= F.col("t.need")) & (left >= F.col("t.need")))
        .withColumn("shared", shared)
        .filter(F.col("shared") >= F.col("t.need"))
        .select("row", "start", F.col("t.label").alias("label"), (F.col("shared") / size).alias("containment"))
    )


def _rank(templates: list[Template]):
    """The global order again, from the templates' own orders, which are all parts of it."""
    after: dict[str, set[str]] = {}
    for t in templates:
        for i, w in enumerate(t.words):
            after.setdefault(w, set()).update(t.words[i + 1 :])
    placed: dict[str, int] = {}
    waiting = {w: sum(w in later for later in after.values()) for w in after}
    ready = sorted(w for w, n in waiting.items() if not n)
    while ready:
        w = ready.pop(0)
        placed[w] = len(placed)
        for x in after[w]:
            waiting[x] -= 1
            if not waiting[x]:
                ready = sorted([*ready, x])
    return placed.__getitem__


def licences(docs: DataFrame, settings: Settings | None = None, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks), one row for each row of ``docs``.

    ``n_base``, ``first_word`` and ``last_word``: all places of the base phrases, the smallest and largest word
    at which one begins (null without any). ``labels``: those of the phrases and of the templates found,
    distinct and sorted; ``blocks``: (start, label, containment) of the blocks found; ``score``: 1 with a
    base phrase, else the largest containment, 0 without any. ``templates`` are (label, text); unless settings are given, blocks are
    as large as the longest needs. A null text counts as empty. Repeated rows give repeated rows,
    a null doc_id stays null, an empty table gives an empty result; other columns are not read.
    """
    settings = settings or fitting(templates)
    templates = ordered_templates(docs, settings, [t for t in templates if template_words(t[1])])
    rows = scanned(docs, templates, settings)
    found = similar_blocks(rows, templates).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "label", "containment"))).alias("hits")
    )
    names = F.array(*[F.lit(v) for v in PHRASES.values()])
    base = F.transform(
        F.filter(F.arrays_zip(F.col("phrases").alias("p"), names.alias("label")), lambda x: x["p"].isNotNull()), lambda x: x["label"]
    )
    seen = F.filter("phrases", lambda p: p.isNotNull())
    hits = F.coalesce("hits", F.array().cast("array<struct<start:int,label:string,containment:double>>"))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words",
        F.aggregate(seen, F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform(seen, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(seen, lambda p: p["last"])).alias("last_word"),
        F.sort_array(F.array_distinct(base)).alias("base_labels"),
        F.sort_array(F.array_distinct(F.concat(base, F.transform(hits, lambda h: h["label"])))).alias("labels"),
        F.when(F.size(seen) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(hits, lambda h: h["containment"])), F.lit(0.0))).alias("score"),
        hits.alias("blocks"),
    )
