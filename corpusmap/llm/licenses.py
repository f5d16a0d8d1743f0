"""License scan: exact set-similarity join of text blocks with license templates, in built-ins only.

A block is a window of ``2 L`` words, each begun ``L`` words after the one before, ``L`` being the length of the longest
template: any passage as long as a template lies whole in one block. A block matches a template if it holds
the share ``CONTAINMENT`` of the template's distinct words. The join is exact and takes the usual filters:

* all words are ordered by their number of documents in the whole table, rarest first;
* prefix: of |T| ordered words of which ``need`` must be shared, one of the first |T| - need + 1 is;
* length: the block has at least ``need`` template words;
* position: from the first shared word on, both sides still have ``need`` words.

The template table is fixed and small, so it is a literal in the plan: documents are never shuffled.
Each document first meets the union of all prefixes, which few pass. Every template that matches a block names it,
except one whose shared words are words of a template of larger share, too: near-identical templates, of which
one notice has most words. If those words stand in the block once more than that notice takes, and still make
the threshold, they are a notice of their own and name it as well.

Base labels come from phrases whose words stand consecutively; they are kept whatever the method finds.

Defined cases: null is the empty text: 0 words, null positions, '' as labels and score 0; repeated rows give
repeated results; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

CONTAINMENT = 0.8

# The phrases of the base labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices as their licenses recommend them, in words as the scan sees them.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLOCK = max(len(t.split()) for _, t in TEMPLATES)


def normal_text(text: Column) -> Column:
    """Words of the text, A-Z lower-cased, with one blank between them.

    Lower-casing other letters too changes no word count and no match, as templates are ASCII, except for
    the Kelvin sign, which is kept apart.
    """
    spared = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5"))
    return F.trim(F.regexp_replace(F.lower(spared), SEPARATORS, " "))


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def _ranked(words: DataFrame) -> list[str]:
    """Template words, rarest first by the number of documents that have them."""
    known = sorted({w for _, t in TEMPLATES for w in t.split()})
    counts = (
        words.select(F.explode(F.array_intersect(F.col("words"), F.array(*map(F.lit, known)))).alias("w"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most one row per template word
    )
    seen = {r["w"]: r["n"] for r in counts}
    return sorted(known, key=lambda w: (seen.get(w, 0), w))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _templates(order: list[str], containment: float) -> tuple[Column, list[str]]:
    """Literal array of the templates, words in global order, and the union of their prefixes."""
    rows, prefixes = [], set()
    for label, text in TEMPLATES:
        words = sorted(set(text.split()), key=order.index)
        need = math.ceil(containment * len(words) - 1e-9)
        prefix = words[: len(words) - need + 1]
        prefixes.update(prefix)
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                _strings(words).alias("words"),
                _strings(prefix).alias("prefix"),
                F.lit(need).alias("need"),
            )
        )
    return F.array(*rows), sorted(prefixes, key=order.index)


def _passes(template: Column, block: Column) -> Column:
    """Length, prefix and position filters, cheapest first, then the count."""
    shared = F.get(F.array_intersect(template["prefix"], block), F.lit(0))
    left = F.least(
        F.size(template["words"]) - F.array_position(template["words"], shared),
        F.size(block) - F.array_position(block, shared),
    )
    return (
        (F.size(block) >= template["need"])
        & F.arrays_overlap(template["prefix"], block)
        & (left + 1 >= template["need"])
        & (F.size(F.array_intersect(template["words"], block)) >= template["need"])
    )


def _displaced(match: Column, other: Column, text: Column) -> Column:
    """Whether ``match`` only has words of the text that ``other``, of larger share, has too."""
    times = lambda word: F.size(F.filter(text, lambda w: w == word))
    # So often the notice of ``other`` stands here, told by the words that only it has.
    copies = F.array_max(F.transform(F.array_except(other["shared"], match["shared"]), times))
    left = F.filter(match["shared"], lambda w: times(w) > copies)
    return (
        (other["share"] > match["share"])
        & (F.size(F.array_except(match["shared"], other["shared"])) == 0)
        & (F.coalesce(F.size(left), F.lit(0)) < match["need"])
    )


def scan(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Per (doc_id, text) row: n_words, n_base, first_word, last_word, base_labels, labels, score and
    ``blocks``, every matching block as (first word, label, share)."""
    texts = docs.select("doc_id", normal_text(F.col("text")).alias("norm"))
    words = texts.select(
        "doc_id", "norm", F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " ")).alias("words")
    )
    order = _ranked(words)
    templates, prefixes = _templates(order, containment)

    def matches(begin: Column) -> Column:
        text = F.slice("words", begin + 1, 2 * BLOCK)
        block = F.array_intersect(_strings(order), text)
        found = F.transform(
            F.filter(templates, lambda t: _passes(t, block)),
            lambda t: F.struct(
                begin.cast("long").alias("first_word"),
                t["label"].alias("label"),
                (F.size(F.array_intersect(t["words"], block)) / F.size(t["words"])).alias("share"),
                F.array_intersect(t["words"], block).alias("shared"),
                t["need"].alias("need"),
            ),
        )
        return F.transform(
            F.filter(found, lambda m: ~F.exists(found, lambda o: _displaced(m, o, text))),
            lambda m: F.struct(*(m[c].alias(c) for c in ("first_word", "label", "share"))),
        )

    none = F.array().cast("array<struct<first_word:bigint,label:string,share:double>>")
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = F.when(
        F.arrays_overlap("words", _strings(prefixes)), F.flatten(F.transform(begins, matches))
    ).otherwise(none)

    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    n_words = F.size("words").cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        here = F.contains(padded, F.lit(f" {phrase} "))
        size = len(phrase.split())
        pattern = F.lit(f"(?<= ){phrase}(?= )")
        counts.append(F.when(here, F.regexp_count(padded, pattern)).otherwise(0))
        firsts.append(F.when(here, _count(F.substring_index(padded, f" {phrase} ", 1), " ")))
        lasts.append(F.when(here, n_words - size - _count(F.substring_index(padded, f" {phrase} ", -1), " ")))
        labels.append(F.when(here, F.lit(label)))
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    return (
        words.select(
            "doc_id",
            n_words.alias("n_words"),
            reduce(lambda a, b: a + b, counts).cast("long").alias("n_base"),
            F.least(*firsts).cast("long").alias("first_word"),
            F.greatest(*lasts).cast("long").alias("last_word"),
            named.alias("base"),
            blocks.alias("blocks"),
        )
        .withColumn("found", F.array_union("base", F.transform("blocks", lambda b: b["label"])))
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort("found"), ",").alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0))
            .otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0)))
            .alias("score"),
            "blocks",
        )
    )


def duckdb_sql(containment: float = CONTAINMENT) -> str:
    """The same result, without ``blocks``, by comparing every block with every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))})" for label, t in TEMPLATES)
    cases = ", ".join(
        f"('{p}', {quoted(p.split())}, '{label}')" for p, label in PHRASES
    )
    return f"""
    WITH w AS (
        SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
            lower(replace(coalesce(text, ''), chr(8490), chr(229))), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
            lambda x: x <> '') AS words FROM documents
    ),
    p(phrase, parts, label) AS (VALUES {cases}),
    t(label, parts) AS (VALUES {rows}),
    starts AS (
        SELECT r, label, unnest(list_filter(range(len(words)),
            lambda i: list_slice(words, i + 1, i + len(parts)) = parts)) AS pos
        FROM w, p WHERE list_contains(words, parts[1])
    ),
    base AS (
        SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
        FROM starts GROUP BY r
    ),
    b AS (
        SELECT r, b, list_slice(words, b + 1, b + {2 * BLOCK}) AS block
        FROM (SELECT r, words, unnest(range(0, len(words), {BLOCK})) AS b FROM w
              WHERE len(list_intersect(words, {quoted(sorted({w for _, t in TEMPLATES for w in t.split()}))})) > 3)
    ),
    m AS (
        SELECT r, b, label, len(list_intersect(parts, block)) / len(parts) AS share FROM b, t
        WHERE len(list_intersect(parts, block)) >= ceil({containment} * len(parts) - 1e-9)
    ),
    best AS (
        SELECT r, list(DISTINCT label) AS labels, max(share) AS share
        FROM (SELECT *, max(share) OVER (PARTITION BY r, b) AS top FROM m) WHERE share = top GROUP BY r
    )
    SELECT doc_id, len(words) AS n_words, coalesce(base.n, 0) AS n_base, base.first_word, base.last_word,
        coalesce(list_aggregate(list_sort(base.labels), 'string_agg', ','), '') AS base_labels,
        coalesce(list_aggregate(list_sort(list_distinct(list_concat(
            coalesce(base.labels, []), coalesce(best.labels, [])))), 'string_agg', ','), '') AS labels,
        CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r)
    """
