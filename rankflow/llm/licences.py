"""Licence texts found through a positional index of rare words.

Templates are short licence texts, each with a label and mandatory key phrases.

1. *Hits.*  One pass over the texts keeps, of each document, the places of the words that occur in
   any template, and counts in how many documents each of these words is found.  A word's weight is
   its inverse document frequency, floor(1000 ln((2 N + 2) / (2 df + 1))), 1 at least.
2. *Anchors.*  Of each template the words of highest weight are looked up, as many as needed so that
   the others alone cannot reach ``SHARE`` percent of the template's weight.  So every match holds
   an anchor, and frequent words are looked up nowhere.
3. *Relative positions.*  A hit on a template's word gives the place where the template would start.
   Anchors that agree on it are added up, and starts that cannot reach the share are dropped.
4. *Verification.*  The words a template has at a start are joined with the document's hits by place:
   the share is summed in full and every word of the key phrases has to stand at its place.

All work is done by joins and aggregations over column functions.  The tables that the size of the
corpus does not touch are the template words (some hundred rows) and their document counts; one file
with very many hits is spread over all tasks, for the groups are (file, template, start).

Defined cases: a null text counts as empty; an empty text has no words and no labels; texts are worked
on whole, of any length; repeated rows each get their result, null ids are kept; other columns are kept,
except those with the names of the results, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.tables import present
from rankflow.plans import cut

#: Percent of a template's weight that has to stand in place.
SHARE = 70
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII characters other than letters and digits, once A-Z is lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@dataclass(frozen=True)
class Template:
    """A licence text; ``base`` marks phrases whose places are counted."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def key_places(self) -> set[int]:
        """Places of the words of all key phrases."""
        words, places = self.text.split(), set()
        for phrase in self.keys:
            key = phrase.split()
            start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            places |= set(range(start, start + len(key)))
        return places


def phrase(label: str, text: str) -> Template:
    """A template that has to stand there as a whole."""
    return Template(label, text, (text,), base=True)


GPL = "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license"
#: The public licences' own grant lines, as words.
TEMPLATES = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", GPL.format(3), ("gnu general public license", "version 3 of the license")),
    Template("gpl-2", GPL.format(2), ("gnu general public license", "version 2 of the license")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """Other columns, ``n_words``, and ``_hits``: (place, word) of the template words, by place."""
    split = F.split(F.translate(present(text), UPPER, LOWER), BETWEEN)
    rows = docs.select(*[c for c in docs.columns if c not in (text, *RESULTS)], split.alias("_words"))
    # What stands before the first and after the last separator may be empty.
    lead = (F.get("_words", F.lit(0)) == "").cast("int")
    tail = (F.get("_words", F.size("_words") - 1) == "").cast("int")
    known = vocabulary(templates)
    place = lambda w, i: F.when(w.isin(known), F.struct((i - lead).alias("place"), w.alias("word")))
    found = F.filter(F.transform("_words", place), lambda h: h.isNotNull())
    n_words = F.greatest(F.size("_words") - lead - tail, F.lit(0)).cast("bigint")
    return rows.withColumns({"n_words": n_words, "_hits": found}).drop("_words")


def weights(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Weight of each template word by the number of documents that hold it."""
    words = found.select(F.explode(F.array_distinct(F.transform("_hits", lambda h: h["word"]))).alias("word"))
    held = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = found.count()
    return {w: max(1, math.floor(1000 * math.log((2 * total + 2) / (2 * held.get(w, 0) + 1)))) for w in vocabulary(templates)}


def postings(weight: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, int, str, int, bool, bool]]:
    """(template, place, word, weight, anchor, key) of every template word."""
    rows = []
    for number, template in enumerate(templates):
        words, keys = template.text.split(), template.key_places()
        total = sum(weight[w] for w in words)
        rest, anchors = total, set()
        for i in sorted(range(len(words)), key=lambda i: (-weight[words[i]], i)):
            if 100 * rest < SHARE * total:
                break
            anchors.add(i)
            rest -= weight[words[i]]
        # A word that stands twice is looked up for both of its places.
        high = {words[i] for i in anchors}
        rows += [(number, i, w, weight[w], w in high, i in keys) for i, w in enumerate(words)]
    return rows


def _values(df: DataFrame, names: str, rows: list[tuple]) -> DataFrame:
    """A small table of literals, its size known to the planner."""
    listed = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def matches(found: DataFrame, key: str, weight: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(key, template, start, aligned) of every template that stands in a document of ``found``; ``key`` tells its rows apart."""
    listed = postings(weight, templates)
    words = _values(found, "template, at, word, weight, anchor, key_word", listed)
    facts = []
    for number in range(len(templates)):
        own = [row for row in listed if row[0] == number]
        facts.append((number, sum(r[3] for r in own), sum(r[3] for r in own if not r[4]), sum(r[5] for r in own)))
    facts = _values(found, "template, total, rest, n_keys", facts)
    high = sorted({row[2] for row in listed if row[4]})
    looked_up = found.select(key, F.explode(F.filter("_hits", lambda h: h["word"].isin(high))).alias("h")).select(key, "h.*")
    starts = looked_up.join(words.filter("anchor"), "word").withColumn("start", F.col("place") - F.col("at"))
    seen = starts.groupBy(key, "template", "start").agg(F.sum("weight").alias("seen"))
    enough = F.expr(f"100 * (seen + rest) >= {SHARE} * total")
    likely = cut(seen.join(facts, "template").filter(enough).select(key, "template", "start"), "starts")
    asked = likely.join(words, "template").withColumn("place", F.col("start") + F.col("at"))
    held = found.join(likely.select(key).distinct(), key, "left_semi").select(key, F.explode("_hits").alias("h"))
    stands = asked.join(held.select(key, "h.*"), [key, "place", "word"])
    sums = stands.groupBy(key, "template", "start").agg(
        F.sum("weight").alias("aligned"), F.count_if("key_word").cast("bigint").alias("keys")
    )
    whole = F.expr(f"100 * aligned >= {SHARE} * total AND keys = n_keys")
    return sums.join(facts, "template").filter(whole).select(key, "template", "start", "aligned", "total")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``score`` is the largest share of a matching template's weight, 0 without a match.
    """
    found = cut(hits(docs, templates, text).withColumn("_row", F.monotonically_increasing_id()), "hits")
    at = matches(found, "_row", weights(found, templates), templates)
    names = _values(found, "template, label, base", [(i, t.label, t.base) for i, t in enumerate(templates)])
    base = lambda value: F.when(F.col("base"), value)
    # Grouped by template first: a document has few of these, however many places.
    each = at.join(names, "template").groupBy("_row", "label").agg(
        F.count(base(F.col("start"))).alias("n"),
        F.min(base(F.col("start"))).alias("first"),
        F.max(base(F.col("start"))).alias("last"),
        F.max(F.col("aligned") / F.col("total")).alias("best"),
    )
    per_row = each.groupBy("_row").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("best").alias("best"),
        _joined(F.when(F.col("n") > 0, F.col("label"))).alias("based"), _joined(F.col("label")).alias("all"),
    )
    own = [c for c in found.columns if c not in ("_row", "_hits")]
    return found.drop("_hits").join(per_row, "_row", "left").select(
        *own,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first").cast("bigint").alias("first_word"),
        F.col("last").cast("bigint").alias("last_word"),
        F.coalesce("based", F.lit("")).alias("base_labels"),
        F.coalesce("all", F.lit("")).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def _joined(label: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(label)), ",")
