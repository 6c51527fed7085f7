"""License scan: an exact set-similarity join of the blocks of all texts with license templates.

A block is a line, or a run of consecutive words wherever lines end, for a template of m words ``ceil(m / threshold)`` of them: so a notice
that is wrapped over lines is found too.

The tokens of the templates are put in one order, rarest in the corpus first. A template of n tokens asks a block for ``need = ceil(threshold * n)`` of
them. Such a block holds one of the template's ``n - need + 1`` first tokens (prefix filter), has at least ``need`` template
tokens (length filter), and from the first token they share on, both have enough tokens left (positional filter). What passes is counted exactly.

No block holds more of a template than the whole text, so a text's blocks are taken only if its distinct words pass the filters. The runs of words are then
those that start with a token of a template that passed.

The templates are a fixed list, so the join needs no shuffle: each block looks its tokens up in a literal index. Phrases are
counted besides, by word position. All of it is column expressions.

Defined results: a null text counts as empty; a text without words has 0 words, null positions, no labels and score 0; rows are
independent, so ids may be null or repeat; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, whole_text

#: Phrases that give a label wherever their words stand one after another (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Template texts in words and their labels (public license notices, fixed values).
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
THRESHOLD = 0.9
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def token_order(df: DataFrame, tokens: list[str], text_col: str = "text") -> list[str]:
    """``tokens`` by how often they stand in all texts, rarest first; as many rows as tokens are fetched."""
    words = df.select(F.explode(F.split(ascii_lower(whole_text(text_col)), NOT_WORD)).alias("word"))
    counts = {r.word: r.n for r in words.filter(F.col("word").isin(tokens)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def line_share(block: Column, template: list[str], threshold: float) -> Column:
    """Share of ``template`` (tokens in order) that a block of ordered tokens holds; 0 below the threshold."""
    n = len(template)
    need = math.ceil(threshold * n - 1e-9)
    prefix = template[: n - need + 1]
    tokens = literal(template)
    shared = F.array_intersect(block, tokens)
    first = F.element_at(shared, 1)
    left = F.least(n - F.array_position(tokens, first), F.size(block) - F.array_position(block, first)) + 1
    passes = (F.size(block) >= need) & F.arrays_overlap(block, literal(prefix))
    return F.when(passes, F.when(left >= need, F.when(F.size(shared) >= need, F.size(shared) / n))).otherwise(F.lit(0.0))


def run_share(words: Column, template: list[str], length: int, threshold: float) -> Column:
    """Largest share of ``template`` that ``length`` consecutive words hold; 0 below the threshold. A run can as well start with its first token."""
    n = len(template)
    tokens = literal(template)
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_contains(tokens, F.element_at(words, i)))
    most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(words, i, length), tokens))))
    return F.when(most >= math.ceil(threshold * n - 1e-9), most / n).otherwise(F.lit(0.0))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    lengths = [math.ceil(len(text.split()) / threshold - 1e-9) for text, _ in templates]
    sets = [(sorted(set(text.split())), label) for text, label in templates]
    order = token_order(df, sorted({t for tokens, _ in sets for t in tokens}), text_col)
    sets = [(sorted(tokens, key=order.index), label) for tokens, label in sets]

    lowered = df.select(F.col(id_col).alias("id"), ascii_lower(whole_text(text_col)).alias("text"))
    # Words one blank apart, with a blank at both ends.
    spaced = lowered.withColumn("words", F.concat(F.lit(" "), F.trim(F.regexp_replace("text", NOT_WORD, " ")), F.lit(" ")))
    words = F.col("words")
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    n_words = F.when(words == "  ", F.lit(0)).otherwise(blanks(words) - 1).cast("long")

    counts, firsts, lasts, base = [], [], [], []
    for phrase, label in phrases.items():
        padded = f" {phrase} "
        there = words.contains(padded)
        counts.append(F.when(there, F.regexp_count(words, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(F.lit(0)))
        firsts.append(F.when(there, blanks(F.substring(words, F.lit(1), F.instr(words, padded))) - 1))
        after = blanks(F.substring_index(words, padded, -1))
        lasts.append(F.when(there, n_words - after - len(phrase.split())))
        base.append(F.when(there, F.lit(label)))
    counted = spaced.select(
        "id",
        "text",
        "words",
        n_words.alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*base)).alias("base"),
    )

    # A text without any prefix token holds no match: most texts end here, before their lines are taken apart.
    rare = sorted({t for tokens, _ in sets for t in tokens[: len(tokens) - math.ceil(threshold * len(tokens) - 1e-9) + 1]})
    possible = F.col("text").rlike("|".join(rare))
    ordered = literal(order)
    blocks = F.transform(F.split("text", "\n"), lambda line: F.array_intersect(ordered, F.split(line, NOT_WORD)))
    shares = F.transform(F.filter(blocks, lambda b: F.size(b) > 0), lambda b: F.array(*[line_share(b, tokens, threshold) for tokens, _ in sets]))
    best = F.aggregate(shares, literal([0.0] * len(sets)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    listed_words = F.when(possible, F.split(F.trim("words"), " "))
    whole = counted.withColumn("word_list", listed_words).withColumn("held", F.array_intersect(ordered, F.col("word_list")))
    passing = whole.withColumn("passing", F.array(*[F.coalesce(line_share(F.col("held"), tokens, threshold), F.lit(0.0)) > 0 for tokens, _ in sets]))
    runs = [
        F.when(F.get("passing", F.lit(i)), run_share(F.col("word_list"), tokens, length, threshold)).otherwise(F.lit(0.0))
        for i, ((tokens, _), length) in enumerate(zip(sets, lengths, strict=True))
    ]
    either = F.zip_with(best, F.array(*runs), lambda x, y: F.greatest(x, y))
    matched = passing.withColumn("shares", F.when(F.array_contains("passing", True), either).otherwise(literal([0.0] * len(sets))))
    found = F.array_compact(F.array(*[F.when(F.get("shares", F.lit(i)) > 0, F.lit(label)) for i, (_, label) in enumerate(sets)]))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return matched.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", found)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.array_max("shares")).alias("score"),
    )


def sql(table: str = "documents") -> str:
    """The same in DuckDB SQL, without order, filters or index, for texts whose notices stand in one line each: its blocks are lines only."""
    values = ", ".join(f"(string_split('{text}', ' '), '{label}')" for text, label in TEMPLATES)
    phrases = ", ".join(f"(string_split('{phrase}', ' '), '{label}')" for phrase, label in PHRASES.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS t FROM {table}),
    d AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM texts),
    phrases AS (SELECT * FROM (VALUES {phrases}) p(words, label)),
    templates AS (SELECT list_distinct(words) AS words, label FROM (VALUES {values}) p(words, label)),
    places AS (
        SELECT r, label, unnest(list_filter(range(len(w) - len(words) + 1), lambda i: w[i + 1 : i + len(words)] = words)) AS place
        FROM d, phrases
    ),
    base AS (
        SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS base FROM places GROUP BY r
    ),
    lines AS (SELECT r, list_distinct(regexp_extract_all(line, '{word}')) AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
    shares AS (SELECT r, label, len(list_intersect(w, words)) / len(words) AS share FROM lines, templates),
    found AS (SELECT r, list_distinct(list(label)) AS found, max(share) AS score FROM shares WHERE share >= {THRESHOLD} GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
        CASE WHEN base IS NOT NULL THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
    FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)
    """
