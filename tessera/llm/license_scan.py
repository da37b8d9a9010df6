"""License scans as an exact set-similarity join.

Texts are lower-cased (A-Z) and cut into words.  Text blocks are runs of `block`
words, each beginning half a block after the one before, so that any passage up
to half a block lies whole in one.  A block matches a template if it holds at
least `threshold` of the template's different words.

What a short template leaves out within the threshold may be the one word that
tells it from others; so each has marks, words that a match must have, and words
that it must not have as they tell of another licence.  The words must stand close
together: in a run of at most twice the template's length.

The templates' words are ordered by how many documents have them, rarest first.
A template that needs k of its n words can only match a block that has one of
its first n - k + 1 (prefix filter) and at least k template words at all (length
filter); for the first common word of both orders, no more words can be shared
than follow it in either (positional filter).  What passes is verified on the
runs of the block's words.  A text
without any prefix word is never cut into blocks.  The frequencies are counted
over all texts; the templates are a parameter, so their words and prefixes are a
fixed number of values.

Beside it, phrases whose words stand consecutively are counted by place and
name labels of their own.

Null and empty texts have no words and no label.  Texts of any length are
scanned whole.  Repeated rows are scanned alike.  All of it is DataFrame
operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Phrases and the labels that they name.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Passages of public licence texts and notices, in words, their labels, their marks, and words that tell of another licence.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "hereby granted", ""),
    ("released under the mit license", "mit", "mit license", ""),
    ("licensed under the apache license version 2 0", "apache-2", "apache license 2", ""),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2", "compliance license", ""),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution binary", ""),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu general public license", "lesser library affero"),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu general public license", "lesser library affero"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", "gnu lesser general public license", "affero"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl", "gnu affero general public license", "lesser"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license 2", ""),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution international", "noncommercial commercial sharealike share noderivatives derivatives"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", "creative commons attribution noncommercial international", "sharealike share noderivatives derivatives"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", "creative commons attribution sharealike international", "noncommercial commercial noderivatives derivatives"),
    ("licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa", "creative commons attribution noncommercial sharealike international", ""),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd", "creative commons attribution noderivatives international", "noncommercial commercial sharealike share"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc", "sa nd"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved", ""),
)
CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    templates: tuple[tuple[str, str, str, str], ...] = TEMPLATES
    threshold: float = 0.8
    block: int = 64


def spaced(text: Column) -> Column:
    """The lower-cased words with one space before, between and after them; one space if there are none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inner = F.regexp_replace(lower, CUT, " ")
    return F.regexp_replace(F.concat(F.lit(" "), inner, F.lit(" ")), "^ +| +$", " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def ordered_words(docs: DataFrame, settings: Settings, text: str) -> list[str]:
    """The templates' words, those of fewest documents first; a fixed number of values."""
    universe = sorted({w for t, *_ in settings.templates for w in t.split()})
    words = F.split(spaced(F.col(text)), " ")
    found = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, universe)), words)).alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in found.collect()}
    return sorted(universe, key=lambda w: (count.get(w, 0), w))


def _template_table(spark, settings: Settings, order: list[str]) -> DataFrame:
    """(token, place, template, label, t_words, marks, nots, need, run): a row for each prefix word of each template, its words in the given order."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for n, (t, label, marks, nots) in enumerate(settings.templates):
        words = sorted(set(t.split()), key=rank.__getitem__)
        need = max(1, math.ceil(settings.threshold * len(words) - 1e-9))
        run = min(2 * len(t.split()), settings.block // 2)
        rows += [(w, i, n, label, words, marks.split(), nots.split(), need, run) for i, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "token string, place int, template int, label string, t_words array<string>, marks array<string>, nots array<string>, need int, run int")


def license_scan(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    order = ordered_words(docs, settings, text)
    table = _template_table(spark, settings, order)
    prefix = F.array(*(F.lit(r.token) for r in table.select("token").distinct().collect()))
    universe = F.array(*map(F.lit, order))

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("doc_id"), spaced(F.col(text)).alias("t"))
    n_words = F.greatest(_spaces(F.col("t")) - 1, F.lit(0)).cast("long")
    own = own.withColumn("n_words", n_words)
    places, firsts, lasts, named = [], [], [], []
    for phrase, label in settings.phrases:
        has = F.contains(F.col("t"), F.lit(f" {phrase} "))
        parts = F.split(F.col("t"), f"(?<= ){phrase}(?= )")
        places.append(F.when(has, F.size(parts) - 1).otherwise(0))
        firsts.append(F.when(has, _spaces(F.element_at(parts, 1)) - 1))
        lasts.append(F.when(has, F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        named.append(F.when(has, F.lit(label)))
    half = settings.block // 2
    words = F.slice(F.split(F.col("t"), " "), F.lit(2), F.greatest(F.col("n_words"), F.lit(1)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest((F.col("n_words") - 1) / half, F.lit(0)).cast("int")), lambda i: F.slice(F.col("words"), i * half + 1, F.lit(settings.block)))
    own = own.withColumn("words", F.when(F.col("n_words") > 0, words))
    blocks = F.when(F.arrays_overlap("words", prefix), F.filter(cut, lambda b: F.arrays_overlap(b, prefix)))
    base = own.select(
        "row", "doc_id", "n_words",
        reduce(lambda a, b: a + b, places).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*named)).alias("base"),
        blocks.alias("blocks"),
    )

    block = base.select("*", F.explode_outer("blocks").alias("raw")).drop("blocks").withColumn("block", F.array_intersect(universe, F.col("raw")))
    probes = block.select("*", F.explode_outer(F.array_intersect("block", prefix)).alias("probe"))
    joined = probes.join(F.broadcast(table), F.col("probe") == F.col("token"), "left")
    at = F.array_position("block", F.col("probe")) - 1
    room = F.least(F.col("place"), at) + F.least(F.size("t_words") - F.col("place"), F.size("block") - at)
    passes = (F.size("block") >= F.col("need")) & (room >= F.col("need"))
    run = lambda i: F.slice(F.col("raw"), i + 1, F.col("run"))
    marked = lambda r: (F.size(F.array_except(F.col("marks"), r)) == 0) & ~F.arrays_overlap("nots", r)
    shared = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size("raw") - F.col("run"), F.lit(0))), lambda i: F.when(marked(run(i)), F.size(F.array_intersect("t_words", run(i)))).otherwise(0)))
    # shared is found once
    matched = F.when(passes, F.transform(F.array(shared), lambda s: F.when(s >= F.col("need"), F.struct((s / F.size("t_words")).alias("share"), F.col("label").alias("label"))))[0])
    found = joined.withColumn("match", matched)
    same = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    out = found.groupBy("row").agg(*(F.first(c).alias(c) for c in same), F.collect_set("match.label").alias("more"), F.max("match.share").alias("share"))
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        text_of(F.col("base")).alias("base_labels"),
        text_of(F.concat("base", "more")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))


def _sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', list_distinct(string_split('{t}', ' ')), string_split('{m}', ' '), {nots.split() or '[]::VARCHAR[]'}, {min(2 * len(t.split()), 32)})" for i, (t, label, m, nots) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
ph(phrase, label, n) AS (VALUES {phrases}),
tp(tid, label, tw, marks, nots, run) AS (SELECT * FROM (VALUES {templates}) AS v),
pos AS (SELECT doc_id, ph.label, i - 1 AS place FROM d, ph, range(1, greatest(len(w), 1)) AS r(i)
        WHERE array_to_string(list_slice(w, i, i + ph.n - 1), ' ') = ph.phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pos GROUP BY doc_id),
blk AS (SELECT doc_id, list_slice(w, i * 32 + 1, i * 32 + 64) AS raw FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 31) // 32)) AS i FROM d)),
near AS (SELECT doc_id, label, tw, marks, nots, run, raw FROM blk, tp WHERE list_has_all(raw, marks) AND len(list_intersect(tw, list_distinct(raw))) >= ceil(0.8 * len(tw) - 1e-9)),
m AS (SELECT doc_id, label, max(shared::DOUBLE / len(tw)) AS share FROM (
  SELECT doc_id, label, tw, list_max(list_transform(range(0, greatest(len(raw) - run, 0) + 1), lambda i: CASE WHEN list_has_all(raw[i + 1 : i + run], marks) AND NOT list_has_any(raw[i + 1 : i + run], nots) THEN len(list_intersect(tw, list_distinct(raw[i + 1 : i + run]))) ELSE 0 END)) AS shared FROM near)
  WHERE shared >= ceil(0.8 * len(tw) - 1e-9) GROUP BY doc_id, label),
a AS (SELECT doc_id, label, 1::DOUBLE AS share FROM pos UNION ALL SELECT doc_id, label, share FROM m),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM a GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(share, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP6_SQL = _sql()
