"""License scans: an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a run of as many consecutive words as the template has, wherever lines end in it (of a shorter text, all of it). It
matches if it contains at least ``PERCENT`` % of the template's distinct words; it fits if it also has all the words that the
template can't do without, and none that would make it another license. The join finds every block that matches; labels are of those that fit:

* Template words are ordered by their count over all documents, rarest first. A block with enough of them has one of the
  first ones (prefix filter), so only places of those words are joined with the templates, by equal words.
* A text with fewer words than the overlap needs can't match (length filter).
* If the joined word is the first one (in that order) of a block, the block's other words come later in the order: there
  have to be enough of these around the place (positional filter).

Blocks around the places that are left are verified whole.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, read

PERCENT = 80
#: Phrases and labels that always count.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Templates, labels, words that a block must have, and words that it must not have.
TEMPLATES = (
    ("released under the mit license", "mit", "mit", ""),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "", ""),
    ("licensed under the apache license version 2 0", "apache", "apache", ""),
    ("you may not use this file except in compliance with the license", "apache", "", ""),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu", "lesser affero"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu", "lesser affero"),
    ("licensed under cc by 4 0", "cc-by", "cc by", "nc nd sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc", "nd sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "", ""),
    ("subject to the terms of the mozilla public license v 2 0", "mpl", "mozilla", ""),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered", ""),
)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "array<struct<start:long,n_block:int,template:int,label:string,containment:double,fits:boolean>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAP), "")


def ordered_templates(docs: DataFrame, templates=TEMPLATES) -> list[list[str]]:
    """Each template's distinct words, rarest first over all documents; ties in order of the word."""
    names = sorted({w for t, *_ in templates for w in t.split()})
    some = F.filter(words_of(F.col("text")), lambda w: w.isin(names))
    counted = docs.select(F.explode_outer(some).alias("w")).where("w is not null").groupBy("w").agg(F.count("*").alias("n"))
    n = {r.w: r.n for r in counted.collect()}  # a row for each word of the templates at most
    return [sorted(set(t.split()), key=lambda w: (n.get(w, 0), w)) for t, *_ in templates]


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and found for each row of ``docs`` (doc_id, text).

    ``found`` has every block that matches: start (its first word, from 0), n_block (words), template (its number), label,
    containment and whether it fits. Null texts count as empty: no words, no blocks. Repeated rows each get a result of their own, ties are all
    returned, and texts are scanned whole, however long. Other columns are not looked at. An empty table gives an empty result.
    """
    order = ordered_templates(docs, templates)
    length = [len(t.split()) for t, *_ in templates]
    need = [math.ceil(PERCENT * len(t) / 100) for t in order]
    longest = max(length)
    first = sorted({w for t, n in zip(order, need, strict=True) for w in t[: len(t) - n + 1]})
    any_of = "(?:^|[^0-9a-z\\x80-\\x{10FFFF}])(?:" + "|".join(sorted({*first, "license"})) + ")(?:$|[^0-9a-z\\x80-\\x{10FFFF}])"

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.when(F.rlike(F.translate(text, _UPPER, _LOWER), F.lit(any_of)), words_of(text)).otherwise(F.array().cast("array<string>")).alias("w"))
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    near = lambda p: F.slice("w", F.greatest(p - longest + 2, F.lit(1)), F.least(p, F.lit(longest - 1)) + longest)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words",
        F.filter(places, lambda i: _any(_stands(i, p) for p, _ in PHRASES)).alias("at"),
        F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.array(*(F.when(F.exists(places, lambda i: _stands(i, p)), label) for p, label in PHRASES))))), ",").alias("base_labels"),
        F.transform(F.filter(places, lambda i: F.get("w", i).isin(first)), lambda p: F.struct(p.cast("long").alias("p"), F.get("w", p).alias("word"), near(p).alias("near"))).alias("hits"),
    )
    rows = cut(rows)

    # A row for each of the first words of each template: as many as the templates have, so it is broadcast.
    listed = [(w, i, at, length[i], need[i], t, t[at:], must.split(), never.split(), templates[i][1]) for i, (t, n, (_, _, must, never)) in enumerate(zip(order, need, templates, strict=True)) for at, w in enumerate(t[: len(t) - n + 1])]
    index = docs.sparkSession.createDataFrame(listed, "word string, template int, at int, length int, need int, words array<string>, rest array<string>, must array<string>, never array<string>, label string")
    pairs = rows.select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.p", "h.word", "h.near").join(F.broadcast(index), "word")
    pairs = pairs.where((F.col("n_words") >= F.col("need")) & (F.size(F.array_intersect("near", "rest")) >= F.col("need")))
    size = F.least("length", "n_words").cast("int")
    lead = F.least("p", F.lit(longest - 1)).cast("int")  # words of near before the place
    starts = F.sequence(F.greatest(lead - size + 1, F.lit(0)), F.least(lead, F.size("near") - size))
    blocks = pairs.where(F.greatest(lead - size + 1, F.lit(0)) <= F.least(lead, F.size("near") - size)).select("row", "template", "label", "need", "words", "rest", "must", "never", size.alias("n_block"), (F.col("p") - lead).alias("base"), "near", F.explode(starts).alias("s"))
    block = F.slice("near", F.col("s") + 1, F.col("n_block"))
    blocks = blocks.select("row", "template", "label", "need", "words", "must", "never", "n_block", (F.col("base") + F.col("s")).alias("start"), block.alias("b"))
    common = F.size(F.array_intersect("b", "words"))
    match = blocks.where(100 * common >= PERCENT * F.size("words"))
    fits = (F.size(F.array_intersect("b", "must")) == F.size("must")) & ~F.arrays_overlap("b", "never")
    match = match.select("row", F.struct("start", "n_block", "template", "label", (common / F.size("words")).alias("containment"), fits.alias("fits")).alias("m")).groupBy("row").agg(F.array_sort(F.collect_set("m")).alias("found"))
    out = rows.join(match, "row", "left")
    return out.select("doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"), "base_labels", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """As ``scanned``, with labels (those of blocks that fit, and the base ones) and score, the largest containment of such a block or 0."""
    out = scanned(docs, templates)
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    own = F.filter("found", lambda m: m["fits"])
    labels = F.array_join(F.sort_array(F.array_union(base, F.transform(own, lambda m: m["label"]))), ",")
    return out.withColumns({"labels": labels, "score": F.coalesce(F.array_max(F.transform(own, lambda m: m["containment"])), F.lit(0.0))})


def _any(tests):
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _stands(i: Column, phrase: str) -> Column:
    out = F.lit(True)
    for j, word in enumerate(phrase.split()):
        out = out & F.coalesce(F.get("w", i + j) == word, F.lit(False))
    return out


def query(spark, sf_dir):
    out = licenses(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _listed(words: str) -> str:
    return "CAST([" + ", ".join(f"'{w}'" for w in words.split()) + "] AS VARCHAR[])"


_STANDS = {p: " AND ".join(f"coalesce(w[i + {j}] = '{x}', false)" for j, x in enumerate(p.split())) for p, _ in PHRASES}
#: Every block of every text that has enough words of the template at all.
SQL = (
    "WITH t AS (SELECT unnest(["
    + ", ".join(f"{{'m': {len(t.split())}, 'tw': {_listed(t)}, 'must': {_listed(must)}, 'never': {_listed(never)}, 'label': '{label}'}}" for t, label, must, never in TEMPLATES)
    + r"""], recursive := true)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
at_ AS (SELECT r, list_filter(range(1, len(w) + 1), lambda i: """
    + " OR ".join(_STANDS.values())
    + ") AS places, list_filter(["
    + ", ".join(f"CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: {_STANDS[p]})) > 0 THEN '{label}' END" for p, label in PHRASES)
    + f"""], lambda x: x IS NOT NULL) AS base FROM d),
b AS (SELECT r, tw, must, never, label, w[s:s + m - 1] AS b FROM (SELECT r, w, m, tw, must, never, label, unnest(range(1, greatest(len(w) - m, 0) + 2)) AS s FROM d, t
  WHERE 100 * len(list_intersect(w, list_distinct(tw))) >= {PERCENT} * len(list_distinct(tw)))),
f AS (SELECT r, label, len(list_intersect(list_distinct(b), list_distinct(tw))) / len(list_distinct(tw)) AS c FROM b
  WHERE 100 * len(list_intersect(list_distinct(b), list_distinct(tw))) >= {PERCENT} * len(list_distinct(tw)) AND list_has_all(b, must) AND NOT list_has_any(b, never)),
g AS (SELECT r, list(label) AS found, max(c) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels, coalesce(score, 0.0) AS score
FROM d JOIN at_ USING (r) LEFT JOIN g USING (r)"""
)
