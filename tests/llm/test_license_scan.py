"""Licence notices: base phrases against a plain version, planted notices, and the same rows as the SQL."""

import random
import re

import duckdb
import pandas as pd
import pytest

from lumisift.llm import license_scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, labels string, score string, row long"


def filler(rng, n):
    return " ".join(rng.choice(["the", "of", "Élan", "in", "KK", "under", "a", "license", "version", "0", "work", "x7"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [
        None, "", " ;- ", "MIT", "mit LICENSE", "mit-license: CC  BY, cc by", "Licensed under CC BY-NC 4.0.", "licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any person obtaining one copy of this software",
        "gnu general public licence", "apache of the license 2 0 version licensed", "mİt license", "gnu general general public license version 3",
        "redistribution and use in source and binary forms, with or without modification, is permitted",
    ]
    for _ in range(150):
        part = [filler(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(license_scan.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                w.insert(rng.randrange(len(w)), "inserted")
            if rng.random() < 0.3:
                w.pop(rng.randrange(len(w)))
            part += [" ".join(w).title() if rng.random() < 0.5 else ", ".join(w), filler(rng, rng.randrange(30))]
        out.append(" ".join(part))
    words = " ".join(w for _, text, _ in license_scan.TEMPLATES for w in text.split())
    scattered = words.split()
    rng.shuffle(scattered)
    return [*out, " ".join(scattered), "word " * 5000 + out[7] + " the" * 5000, out[6], out[6]]


@pytest.fixture(scope="module")
def rows(spark, texts):
    docs = spark.createDataFrame([(None if k == 5 else k // 2, t, "clash", "clash", k) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    return docs, license_scan.scan(spark, docs).collect()


def test_base(texts, rows):
    want = []
    for k, t in enumerate(texts):
        w = WORDS.findall((t or "").translate(FOLD))
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        want.append((None if k == 5 else k // 2, len(w), len(at), first, last, ",".join(sorted({label for _, label in at}))))
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows[1]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows[1])


def test_planted(spark):
    cases = {
        1: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), 2: ("licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), 3: ("cc by", "cc-by"),
        4: ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), 5: ("apache stands; the license, licensed under version 2 0", ""),
        6: ("Permission is hereby granted, free of charge, to any person obtaining a copy of all this fine software", "mit"), 7: ("released under the MIT license", "mit"),
        8: ("apache license " + "filler " * 30 + "version 2 0 licensed under the", "apache"),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(spark, docs).collect()} == {k: v for k, (_, v) in cases.items()}


def test_agrees_with_sql(texts, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([None if k == 5 else k // 2 for k in range(len(texts))], "Int64"), "text": texts}))
    names = rows[1][0].__fields__
    cur = con.execute(license_scan.sql())
    place = [[d[0] for d in cur.description].index(c) for c in names]
    want = sorted((tuple(r[i] for i in place) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in rows[1]), key=repr) == want
    assert sum(r["labels"] != r["base_labels"] for r in rows[1]) > 40


def test_empty(spark, rows):
    assert license_scan.scan(spark, rows[0].where("false")).count() == 0
