"""Licence notices by a positional index of rare words, DataFrame functions only.

A text is lower-cased (A-Z) and cut into words. Base phrases are found where their words stand consecutively. Beyond them,
``TEMPLATES`` are short notices with the label that they stand for. The index has, for each word of a template, its
positions there. How many documents have each of these words is counted over the whole corpus; in a document, only the
``rarest`` rarest words of a template that it has are looked up. An occurrence at word p of a word that stands at t in the
template puts the template's start at p - t; occurrences that agree on the start within ``slack`` words are intersected.
A template is found where at least ``share`` of the looked-up words agree and all its mandatory key phrases stand, word
by word, at that start as well. So a notice with words changed, left out or put in between is found, and words
scattered over a long text are not.

Scale: one scan of the texts, nothing of them is shuffled; only documents that have all words of a template's key phrases
keep positions, of that template's words. The index and the words' counts are as large as ``TEMPLATES`` (some hundred
rows). The intersection is a grouping by document, template and start, so no task holds a document's matches.

Score: the largest share of looked-up words that agree, over the templates found; at least 0.5 where there is a base label;
else 0.

Edge cases: null and empty texts have no words, labels "" and score 0. Rows are told apart by their place, so repeated rows and ids, or
null ids, are kept as they are. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed values: (label, words of a public notice, its mandatory key phrases).
TEMPLATES = [
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", ("gnu general public license", "version 3")),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license", "version 2 1")),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license", "2 0")),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "released into the public domain")),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
]

RAREST, SLACK, SHARE = 6, 4, 0.6


def _words(texts: list[str]) -> list[str]:
    return sorted({w for t in texts for w in t.split()})


def _list(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def lowered(text: Column) -> Column:
    """A-Z in lower case and no other letter; most texts are ASCII and take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _places(words: Column, n: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand consecutively."""
    parts = phrase.split()
    stands = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + j) == w for j, w in enumerate(parts)))
    return F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - 1), stands)).otherwise(F.array().cast("array<int>"))


def _all_in(phrases: tuple[str, ...], present: Column) -> Column:
    return F.size(F.array_except(_list(_words(list(phrases))), present)) == 0


def _read(docs: DataFrame, templates: list, id_col: str, text_col: str) -> DataFrame:
    """Per row: counts, base places and labels, the templates' words that it has, templates to look up, and where their words stand."""
    vocabulary = _words([text for _, text, _ in templates] + list(PHRASES))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(lowered(text), F.lit(WORDS), F.lit(0)).alias("words"))
    rows = rows.select("doc_id", "words", F.size("words").alias("n"), F.array_intersect("words", _list(vocabulary)).alias("present"))
    words, n, present = F.col("words"), F.col("n"), F.col("present")
    none = F.array().cast("array<int>")
    base = [F.when(_all_in((p,), present), _places(words, n, p)).otherwise(none) for p in PHRASES]
    asked = F.filter(F.array(*(F.when(_all_in(keys, present), F.lit(t)) for t, (_, _, keys) in enumerate(templates))), lambda t: t.isNotNull())
    rows = rows.select("doc_id", "words", "n", "present", F.array(*base).alias("base"), asked.alias("asked"))
    of_template = F.array(*(_list(_words([text])) for _, text, _ in templates))
    wanted = F.array_intersect("present", F.flatten(F.transform("asked", lambda t: F.get(of_template, t))))
    rows = rows.select("doc_id", "words", "n", "present", "base", "asked", wanted.alias("wanted"))
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: F.array_contains("wanted", x["word"]))
    labels = F.filter(F.array(*(F.when(F.size(F.get("base", k)) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("n").cast("long").alias("n_words"), F.flatten("base").alias("places"), labels.alias("base_labels"),
        "present", "asked", F.when(F.size("asked") > 0, at).alias("at"),
    )


def _key_starts(at: Column, phrase: str) -> Column:
    """Word positions where a key phrase starts; ``at`` holds all words of the phrase, in the order of the text."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        first = F.get(at, i)
        return reduce(lambda a, b: a & b, ((F.get(at, i + j)["word"] == w) & (F.get(at, i + j)["pos"] == first["pos"] + j) for j, w in enumerate(parts)))

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(at) - 1), stands), lambda i: F.get(at, i)["pos"])


def _marks(phrase: str) -> Column:
    return F.transform(_key_starts(F.col("at"), phrase), lambda s: F.struct(F.lit(f" {phrase}").alias("token"), s.alias("pos")))


def _found(spark: SparkSession, rows: DataFrame, templates: list, rarest: int, slack: int, share: float) -> DataFrame:
    """(row, labels, share) of the rows in which a template is found."""
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # words of the templates
    order = [sorted(_words([text]), key=lambda w: (counts.get(w, 0), w)) for _, text, _ in templates]
    index, keys = [], []
    for t, (_, text, phrases) in enumerate(templates):
        index += [(t, w, k, 1 << order[t].index(w)) for k, w in enumerate(text.split())]
        for j, p in enumerate(phrases):
            start = f" {text} ".index(f" {p} ")
            index.append((t, f" {p}", len(text[:start].split()), 1 << (40 + j)))
            keys.append((t, p))
    postings = F.broadcast(spark.createDataFrame(index, "template int, token string, position int, bit long"))

    each = rows.where(F.size("asked") > 0).select("row", "present", "at", F.explode("asked").alias("template"))
    by_rarity = F.get(F.array(*(_list(o) for o in order)), F.col("template"))
    each = each.select("row", "at", "template", F.slice(F.filter(by_rarity, lambda w: F.array_contains("present", w)), 1, rarest).alias("looked"))
    words = F.transform(F.filter("at", lambda x: F.array_contains("looked", x["word"])), lambda x: F.struct(x["word"].alias("token"), x["pos"].alias("pos")))
    marks = [F.when(F.col("template") == t, _marks(p)) for t, p in keys]
    none = F.array().cast("array<struct<token:string,pos:int>>")
    hits = each.select("row", "template", F.size("looked").alias("n"), F.explode(F.concat(words, *(F.coalesce(m, none) for m in marks))).alias("hit"))
    hits = hits.select("row", "template", "n", "hit.token", "hit.pos").join(postings, ["template", "token"])
    cell = F.floor((F.col("pos") - F.col("position")) / slack)
    starts = hits.select("row", "template", "n", "bit", F.explode(F.array(cell, cell - 1)).alias("cell")).groupBy("row", "template", "cell").agg(F.max("n").alias("n"), F.bit_or("bit").alias("bits"))
    agree = F.bit_count(F.col("bits").bitwiseAND((1 << 40) - 1))
    need = F.get(F.array(*(F.lit(sum(1 << j for j in range(len(p)))) for _, _, p in templates)), F.col("template"))
    label = F.get(_list([label for label, _, _ in templates]), F.col("template"))
    starts = starts.where((F.shiftright("bits", 40) == need) & (100 * agree >= round(100 * share) * F.col("n")))
    return starts.groupBy("row").agg(F.collect_set(label).alias("more"), F.max(agree / F.col("n")).alias("share"))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list = TEMPLATES, rarest: int = RAREST, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """Per row of ``docs``: n_words, the base places' number, first and last, the labels of the base and all labels, and a score."""
    scratch = Scratch(spark, "license")
    rows = scratch.table(_read(docs, templates, id_col, text_col), "rows")
    found = scratch.table(_found(spark, rows, templates, rarest, slack, share), "found")
    base = F.size("base_labels") > 0
    out = rows.select("row", "doc_id", "n_words", "places", "base_labels").join(found, "row", "left")
    labels = F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(base, 0.5).otherwise(0.0)).alias("score"),
    )


def sql(templates: list = TEMPLATES, rarest: int = RAREST, slack: int = SLACK, share: float = SHARE) -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    postings = [(t, w, k) for t, (_, text, _) in enumerate(templates) for k, w in enumerate(text.split())]
    key_words = [(t, j, k, w, len(p.split()), len(text[: f" {text} ".index(f" {p} ")].split())) for t, (_, text, ps) in enumerate(templates) for j, p in enumerate(ps) for k, w in enumerate(p.split())]
    base = [(label, k, w, len(p.split())) for p, label in PHRASES.items() for k, w in enumerate(p.split())]
    return f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORDS}'), []) AS words FROM documents),
        w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
        base_word(label, k, word, m) AS (VALUES {values(base)}),
        place AS (SELECT r, label, pos - k AS p FROM w JOIN base_word USING (word) GROUP BY r, label, pos - k, m HAVING count(*) = m),
        base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY r),
        posting(t, word, q) AS (VALUES {values(postings)}),
        key_word(t, j, k, word, m, q) AS (VALUES {values(key_words)}),
        name(t, label) AS (VALUES {values([(t, label) for t, (label, _, _) in enumerate(templates)])}),
        present AS (SELECT DISTINCT r, word FROM w SEMI JOIN posting USING (word)),
        rare AS (SELECT word, count(*) AS df FROM present GROUP BY word),
        n_keys AS (SELECT t, count(DISTINCT word) AS n_words, count(DISTINCT j) AS n FROM key_word GROUP BY t),
        asked AS (SELECT r, t FROM present JOIN (SELECT DISTINCT t, word FROM key_word) USING (word) JOIN n_keys USING (t) GROUP BY r, t, n_words HAVING count(*) = n_words),
        looked AS (
            SELECT r, t, word, count(*) OVER (PARTITION BY r, t) AS n FROM (
                SELECT r, t, word, row_number() OVER (PARTITION BY r, t ORDER BY df, word) AS nth
                FROM asked JOIN (SELECT DISTINCT t, word FROM posting) USING (t) JOIN present USING (r, word) JOIN rare USING (word)) WHERE nth <= {rarest}),
        hit AS (
            SELECT r, t, pos - q AS start, word, NULL AS j FROM w JOIN looked USING (r, word) JOIN posting USING (t, word)
            UNION ALL
            SELECT r, t, pos - k - q, NULL, j FROM w JOIN key_word USING (word) JOIN asked USING (r, t) GROUP BY r, t, j, pos - k, q, pos - k - q, m HAVING count(*) = m),
        cell AS (SELECT r, t, unnest([floor(start / {slack}e0), floor(start / {slack}e0) - 1]) AS c, word, j FROM hit),
        start AS (SELECT r, t, c, count(DISTINCT word) AS agree, count(DISTINCT j) AS n_found FROM cell GROUP BY r, t, c),
        found AS (
            SELECT r, list(DISTINCT label) AS more, max(agree / CAST(l.n AS DOUBLE)) AS share
            FROM start JOIN (SELECT DISTINCT r, t, n FROM looked) l USING (r, t) JOIN n_keys k USING (t) JOIN name USING (t)
            WHERE n_found = k.n AND 100 * agree >= {round(100 * share)} * l.n GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') AS labels,
               greatest(coalesce(share, 0e0), CASE WHEN n_base > 0 THEN 0.5e0 ELSE 0e0 END) AS score
        FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""
