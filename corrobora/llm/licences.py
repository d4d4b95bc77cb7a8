"""Licence scans: fixed phrases, and a positional index of rare words, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.llm.columns import lower_ascii
from corrobora.llm.tables import small
from corrobora.session import cut_lineage

# Phrases that decide by themselves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Licence wordings (label, wording, the phrase in it that must be there).
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
)
# Words of the wordings that say nothing about a licence; the index leaves them out.
COMMON = frozenset("a all and any are at by copy except file files following for free in into is may met not obtain of or person that the this to under use with without work you".split())
RARE_WORDS = tuple(sorted({w for _, text, _ in TEMPLATES for w in text.split() if w not in COMMON and len(w) > 1}))


def _spaced(text: Column) -> Column:
    """Every word between blanks of its own, so a phrase is a plain substring and blanks before it count its words."""
    low = lower_ascii(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")), F.lit(" "))


def _quoted(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(spaced: Column, phrase: str) -> Column:
    mark = _quoted(phrase)
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(mark), F.lit("")))) / F.lit(len(mark))).cast("long")


def _first(spaced: Column, phrase: str) -> Column:
    at = F.instr(spaced, _quoted(phrase))
    return F.when(at > 0, (_blanks(F.substring(spaced, F.lit(1), at - 1)) / 2).cast("long"))


def _last(spaced: Column, phrase: str) -> Column:
    mark = _quoted(phrase)
    after = F.substring_index(spaced, mark, -1)
    before = F.substring(spaced, F.lit(1), F.length(spaced) - F.length(after) - len(mark))
    return F.when(F.instr(spaced, mark) > 0, (_blanks(before) / 2).cast("long"))


def _index(rare: DataFrame) -> DataFrame:
    """Postings (word, idf, template, label, key, tpos, mass) of the rare words of all wordings."""
    rows = [(i, label, key, p, w) for i, (label, text, key) in enumerate(TEMPLATES) for p, w in enumerate(text.split()) if w in RARE_WORDS]
    postings = rare.sparkSession.createDataFrame(rows, "template int, label string, key string, tpos int, word string")
    weighed = postings.join(F.broadcast(rare), "word")  # both have one row per word of the fixed wordings
    return weighed.withColumn("mass", F.sum("idf").over(Window.partitionBy("template")))


def scan_licences(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``.

    * Base: places of the fixed phrases, on whole texts.
    * Index: every licence word of a file looks up the positional postings of the wordings; the list is a fixed table,
      so this is bounded. Postings that agree on the relative position vote with the word's inverse document frequency;
      a wording is a candidate when ``share`` of its votes agree, and is labelled when its mandatory phrase is there.
    * ``score``: 1 with a base label, else the best labelled wording's share of votes, else 0.

    Only marks of licence words leave the text scan, so later shuffles carry no text and most documents have no row in
    them. Edge cases: null or empty text has no words and no labels; a file is one row, so repeated rows and ids are
    kept apart; other columns are ignored; empty input gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _spaced(F.col("text").cast("string")).alias("s"))
    rare = F.array(*[F.lit(w) for w in RARE_WORDS])
    listed = F.split(F.trim("s"), "  ")
    marks = F.filter(F.transform(listed, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(*RARE_WORDS))
    keys = sorted({key for _, _, key in TEMPLATES})
    held = F.filter(F.array(*[F.when(F.instr("s", _quoted(k)) > 0, F.lit(k)) for k in keys]), lambda k: k.isNotNull())
    any_rare = F.col("s").rlike(f" (?:{'|'.join(RARE_WORDS)}) ")
    places = [_places(F.col("s"), p) for p in PHRASES]
    n_base = places[0]
    for n in places[1:]:
        n_base = n_base + n
    labels = F.array(*[F.when(F.instr("s", _quoted(p)) > 0, F.lit(v)) for p, v in PHRASES.items()])
    found = cut_lineage(base.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id",
        F.when(F.trim("s") == "", F.lit(0)).otherwise(_blanks(F.col("s")) / 2).cast("long").alias("n_words"),
        n_base.alias("n_base"),
        F.least(*[_first(F.col("s"), p) for p in PHRASES]).alias("first_word"),
        F.greatest(*[_last(F.col("s"), p) for p in PHRASES]).alias("last_word"),
        F.array_sort(F.filter(labels, lambda v: v.isNotNull())).alias("base"),
        F.when(any_rare, marks).alias("marks"), F.when(any_rare, held).alias("held"),
    ))
    marked = found.where("marks is not null").select("_row", F.explode("marks").alias("m")).select("_row", "m.word", "m.pos")
    per_word = marked.groupBy("word").agg(F.count_distinct("_row").alias("_df"))
    total = found.count()
    idf = cut_lineage(per_word.select("word", F.log((F.lit(float(total)) + 1.0) / F.col("_df")).alias("idf")))
    index = small(cut_lineage(_index(idf)))
    words = marked.join(F.broadcast(idf), "word")  # one row per licence word
    votes = (
        words.select("_row", "word", "pos").join(index, "word")
        .select("_row", "template", "label", "key", "mass", "tpos", "idf", (F.col("pos") - F.col("tpos")).alias("_shift")).distinct()
        .groupBy("_row", "template", "label", "key", "mass", "_shift").agg(F.sum("idf").alias("_agree"))
        .where(F.col("_agree") >= F.lit(share) * F.col("mass"))
    )
    sure = (
        votes.join(found.where("size(held) > 0").select("_row", "held"), "_row").where(F.array_contains("held", F.col("key")))
        .groupBy("_row").agg(F.array_sort(F.collect_set("label")).alias("_more"), F.max(F.col("_agree") / F.col("mass")).alias("_score"))
    )
    every = F.array_sort(F.array_union("base", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.round(F.coalesce("_score", F.lit(0.0)), 6)))
    return found.join(sure, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
