"""Operator 10: licence scans, an exact set-similarity join in DataFrame functions only.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Phrases are found where their words
stand consecutively. Beyond them, text blocks (lines, cut after a full stop, question or exclamation mark
before white space) are joined with notice templates: a block meets a template if it holds at least
``threshold`` of the template's distinct words. Words are ordered by how many documents hold them, rarest
first. A template's prefix is so long that a block without any word of it can't meet the threshold (prefix
filter); a block needs as many distinct words as the threshold asks (length filter); and the words
after the first common one must suffice on both sides (positional filter). What is left is compared
exactly. A block that meets a template adds its label.

Notices are often wrapped: sentences that go on over line ends, up to a line without words, are blocks too. They
go through the same filters, but the words in common must stand in a window as long as the template, so that long
passages don't meet one by words from here and there.

Scale: two passes over the texts without Python or text shuffles: one counts the documents of each
template word (as many rows as the templates have words), one keeps, for the few documents that could
meet a template, the template words of their blocks. Only those rows move. Templates, and so all that is
broadcast, are a parameter; their size is checked.

Cases: null text counts as empty: no words, labels '' and score 0; null doc_ids and repeated rows
stay rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices as their licences ask for them, in words, and the labels they add.
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
MOST_TEMPLATE_WORDS = 10_000


def spaced(text: Column) -> Column:
    """The words of a text with one space before and after each; one space if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), APART, " ")), F.lit(" "))


def _count(line: Column) -> Column:
    return F.when(F.length(line) > 2, F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) - 1).otherwise(0).cast("long")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _blocks(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")


def _wrapped(text: Column) -> Column:
    """Sentences over several lines of a paragraph, as words with one space before and after each."""
    paragraphs = F.split(text, r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?])[ \t\r\n]+")))
    return F.transform(F.filter(sentences, lambda b: F.contains(b, F.lit("\n"))), spaced)


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table of constants inside the plan."""
    whole = F.array(*(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in row.items())) for row in rows))
    return spark.range(1).select(F.inline(whole))


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the matches (block, label, share)."""
    sets = [(label, list(dict.fromkeys(words.split()))) for label, words in templates]
    known = sorted({w for _, s in sets for w in s})
    if len(known) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {len(known)} words; {MOST_TEMPLATE_WORDS} can be broadcast")
    vocabulary = F.array(*map(F.lit, known))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lined = rows.withColumn("line", spaced(F.col("text")))

    # Documents that hold each template word; a row for each word that occurs at all.
    held = lined.select(F.explode(F.array_intersect(F.split("line", " "), vocabulary)).alias("word")).groupBy("word").count()
    count = dict.fromkeys(known, 0) | {r["word"]: r["count"] for r in held.collect()}
    rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (count[w], w)))}
    needed = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    ordered = [sorted(s, key=rank.__getitem__) for _, s in sets]
    prefix = [s[: len(s) - n + 1] for s, n in zip(ordered, needed, strict=True)]

    # First pass per document: base places, and the blocks' template words if a template is within reach.
    held = F.array_intersect(F.split("line", " "), vocabulary)
    lined = lined.withColumn("held", held)
    reach = F.lit(False)
    for s, p, n in zip(ordered, prefix, needed, strict=True):
        reach = reach | (F.arrays_overlap("held", F.array(*map(F.lit, p))) & (F.size(F.array_intersect("held", F.array(*map(F.lit, s)))) >= n))
    places = {p: F.regexp_count("line", F.lit(f" (?={p} )")) for p in phrases}
    found = {p: F.contains("line", F.lit(f" {p} ")) for p in phrases}
    first = F.array_min(F.array(*(F.when(found[p], _spaces(F.substring("line", F.lit(1), F.instr("line", f" {p} "))) - 1) for p in phrases)))
    turned = F.reverse("line")
    last = F.array_max(F.array(*(F.when(found[p], _count(F.col("line")) - (_spaces(F.substring(turned, F.lit(1), F.instr(turned, f" {p[::-1]} "))) - 1) - len(p.split())) for p in phrases)))
    known_of = lambda line: F.array_intersect(F.split(line, " "), vocabulary)
    lines = F.transform(_blocks(F.col("text")), lambda b: F.struct(known_of(spaced(b)).alias("words"), F.lit(None).cast("string").alias("wrapped")))
    wrapped = F.transform(_wrapped(F.col("text")), lambda b: F.struct(known_of(b).alias("words"), b.alias("wrapped")))
    blocks = F.filter(F.concat(lines, wrapped), lambda b: F.size(b.words) >= min(needed))
    facts = lined.select(
        "doc_id",
        _count(F.col("line")).alias("n_words"),
        sum((F.when(found[p], places[p]).otherwise(0) for p in phrases), F.lit(0)).cast("long").alias("n_base"),
        first.cast("long").alias("first_word"),
        last.cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(found[p], F.lit(label)) for p, label in phrases.items()))).alias("base"),
        F.when(reach, blocks).alias("blocks"),
        F.monotonically_increasing_id().alias("row"),
    )
    facts = scratch.written(facts)
    spark = docs.sparkSession

    # The join: words of blocks against the inverted index of template prefixes.
    ranks = F.create_map(*(F.lit(x) for w in known for x in (w, rank[w])))
    block = facts.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "of")).select("row", "block", "of.words", "of.wrapped")
    block = block.withColumn("words", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("word")))), lambda x: x.word))
    probes = block.select("row", "block", "words", "wrapped", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    index = _table(spark, [{"word": w, "template": t, "place": at} for t, p in enumerate(prefix) for at, w in enumerate(p)])
    notes = _table(spark, [{"template": t, "label": sets[t][0], "whole": F.array(*map(F.lit, ordered[t])), "needed": needed[t], "length": len(templates[t][1].split())} for t in range(len(sets))])
    pairs = probes.join(F.broadcast(index), "word").join(F.broadcast(notes), "template")
    pairs = pairs.where((F.col("n") >= F.col("needed")) & (F.least(F.size("whole") - F.col("place"), F.col("n") - F.col("at")) >= F.col("needed")))
    pairs = pairs.where(F.size(F.array_intersect("words", "whole")) >= F.col("needed"))
    text = F.split(F.trim("wrapped"), " ")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(text) - F.col("length") + 1, F.lit(1))), lambda i: F.size(F.array_intersect(F.slice(text, i, F.col("length")), F.col("whole"))))
    common = F.when(F.col("wrapped").isNull(), F.size(F.array_intersect("words", "whole"))).otherwise(F.array_max(windows))
    met = pairs.where(common >= F.col("needed")).select("row", "block", "label", (common / F.size("whole")).alias("share"))
    met = met.groupBy("row", "block", "label").agg(F.max("share").alias("share")).groupBy("row").agg(F.collect_list(F.struct("block", "label", "share")).alias("matches"))
    met = met.withColumnRenamed("row", "row_")
    out = facts.drop("blocks").join(met, F.col("row") == F.col("row_"), "left")
    method = F.coalesce(F.transform("matches", lambda m: m.label), F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base", method))), ",").alias("labels"), score.alias("score"), "matches")


def _sql() -> str:
    sets = [(label, list(dict.fromkeys(words.split()))) for label, words in TEMPLATES]
    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in s)}], {math.ceil(THRESHOLD * len(s) - 1e-9)})" for label, s in sets)
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES.items())
    words = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT id, doc_id, text, {words.format("text")} AS ws FROM d
), p AS (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos, id FROM w
), ph(words, label) AS (VALUES {phrases}
), hits AS (
  SELECT p.id, p.pos, ph.label FROM p JOIN ph ON p.word = ph.words[1] JOIN w ON w.id = p.id
  WHERE w.ws[p.pos + 1 : p.pos + len(ph.words)] = ph.words
), base AS (SELECT id, count(*) AS n, min(pos) AS f, max(pos) AS l, list(DISTINCT label) AS ls FROM hits GROUP BY id
), b AS (SELECT id, unnest(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS block FROM w
), bw AS (SELECT id, list_distinct({words.format("block")}) AS ws FROM b
), t(label, ws, needed) AS (VALUES {values}
), m AS (
  SELECT id, list(DISTINCT t.label) AS ls, max(len(list_intersect(bw.ws, t.ws)) / len(t.ws)) AS share
  FROM bw, t WHERE len(bw.ws) >= t.needed AND len(list_intersect(bw.ws, t.ws)) >= t.needed GROUP BY id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.f::BIGINT AS first_word, base.l::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(base.ls, []) || coalesce(m.ls, []))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (id) LEFT JOIN m USING (id)
"""


SQL = _sql()
