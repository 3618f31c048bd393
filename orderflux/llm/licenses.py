"""Licence scan by a positional index of rare words; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflux.llm.common import col, fresh, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between two words: ASCII that is neither digit nor letter.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Share of a template's words that must stand at their places.
LEAST_SHARE = 0.5


@dataclass(frozen=True)
class Template:
    """A licence notice: its words, the phrase that must stand in it word by word, and its label."""

    label: str
    text: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def must(self) -> list[int]:
        """Places of the phrase's words in the template."""
        words, phrase = self.words, self.phrase.split()
        at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
        return list(range(at, at + len(phrase)))


# Public licence notices in lower case.
TEMPLATES = [
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this "
             "software and associated documentation files the software to deal in the software without restriction",
             "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
             "fee is hereby granted", "permission to use copy modify"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("creative-commons", "licensed under a creative commons attribution", "creative commons attribution"),
    Template("reserved", "all rights reserved", "all rights reserved"),
]


def document_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How many texts hold each word of ``vocabulary``; what reaches the driver is bounded by the vocabulary."""
    words = F.split(F.lower(text_of(text_col)), BETWEEN, -1)
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), words)
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counts}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[Template] = TEMPLATES) -> DataFrame:
    """Licences of every text: one row per row of ``docs``, in no order, without any shuffle.

    The index has for each template the word of its mandatory phrase that fewest documents hold (counted over all
    ``docs``) with its place in the template. A file looks up those of these words that it holds, each
    place of such a word gives a possible start of the template, and the template counts when its phrase stands
    there word by word and at least half of its words stand at their places.

    Columns: doc_id; n_words; places, an array of (label, base, start, share); n_base, first_word, last_word of the
    base templates; base_labels and labels, distinct, sorted and comma-joined; score, the largest share (0 if none).
    Null and empty texts have no words, no places and empty labels; repeated rows each get their row.
    """
    vocabulary = sorted({t.words[i] for t in templates for i in t.must})
    seen = document_frequency(docs, vocabulary, text_col)
    rarest = [min((seen[t.words[i]], t.words[i], i) for i in t.must) for t in templates]
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("t"), F.lit(i).alias("q"))
                      for k, (_, w, i) in enumerate(rarest)])
    body = F.array(*[F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
        F.array(*map(F.lit, t.words)).alias("words"), F.array(*map(F.lit, t.must)).alias("must")) for t in templates])
    anchors = [w for _, w, _ in sorted(set(rarest))]
    anchors = list(dict.fromkeys(anchors))
    # Lower-casing of all letters keeps every ASCII word, so no file that holds an anchor is missed.
    low, hit = F.lower(F.col("text")), F.lit(False)
    for w in anchors:
        hit = hit | low.contains(w)
    split = F.split(F.col("text"), BETWEEN, -1)
    size = F.size(split) - (F.get(split, F.lit(0)) == "").cast("int") - (
        (F.size(split) > 1) & (F.element_at(split, -1) == "")).cast("int")
    lowered = F.filter(F.split(F.translate("text", UPPER, LOWER), BETWEEN, -1), lambda w: w != "")
    rows = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # Exploding a one-element array keeps the array from being computed anew inside each lambda.
    rows = rows.select("doc_id", size.cast("bigint").alias("n_words"),
                       F.explode(F.array(F.when(hit, lowered))).alias("words"))
    rows = rows.select("doc_id", "n_words", "words", F.explode(F.array(
        F.array_intersect(F.array(*map(F.lit, anchors)), F.col("words")))).alias("rare"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                    lambda x: F.array_contains("rare", x["w"]))
    starts = F.flatten(F.transform(hits, lambda h: F.transform(
        F.filter(index, lambda p: p["w"] == h["w"]),
        lambda p: F.struct(F.element_at(body, p["t"] + 1).alias("tpl"), (h["i"] - p["q"]).alias("start")))))

    def stands(x: Column, place: Column) -> Column:
        return F.coalesce(F.get("words", x["start"] + place) == F.get(x["tpl"]["words"], place), F.lit(False))

    whole = F.filter(starts, lambda x: F.forall(x["tpl"]["must"], lambda j: stands(x, j)))
    places = F.transform(whole, lambda x: F.struct(
        x["tpl"]["label"].alias("label"), x["tpl"]["base"].alias("base"), x["start"].alias("start"),
        (F.size(F.filter(F.transform(x["tpl"]["words"], lambda w, j: stands(x, j)), lambda ok: ok))
         / F.size(x["tpl"]["words"])).alias("share")))
    places = F.coalesce(F.filter(places, lambda p: p["share"] >= LEAST_SHARE), F.array().cast(
        "array<struct<label:string,base:boolean,start:int,share:double>>"))
    rows = rows.select("doc_id", "n_words", F.explode(F.array(places)).alias("places"))
    base = F.filter("places", lambda p: p["base"])

    def joined(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"]))), ",")

    return rows.select(
        "doc_id", "n_words", "places", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
