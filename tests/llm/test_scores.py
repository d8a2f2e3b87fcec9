"""Classifiers on held-out rows, rules, personal data, extraction, mixing and leaks on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumisift.llm import decontaminate, html_extract, mixing, personal_data, quality_fm, quality_rules, toxicity

BAD = ["idiot", "moron", "worthless", "pathetic", "дурак"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        toxic, poor = int(rng.random() < 0.3), int(rng.random() < 0.3)
        w = sentence(rng, 60).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(BAD))
        if poor:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), None, "s", None))
        labels.append((i, 1 - poor, toxic))
    docs += [(1000, None, "en", None, 1), (1001, "", "en", "s", 1), (None, "you idiot", None, None, None), (1002, "x" * 5000, "en", "s", 5000)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, labels, column):
    j = out.join(labels, "doc_id").where("held_out").select((F.col("predicted") == F.col(column)).cast("double").alias("ok"))
    return j.agg(F.avg("ok"), F.count("*")).first()


def test_quality(spark, labelled):
    docs, labels = labelled
    out = quality_fm.score_documents(spark, docs, labels, meta_cols=("n_chars",)).cache()
    ok, n = accuracy(out, labels, "quality")
    assert n > 100 and ok > 0.95 and out.count() == docs.count()
    assert out.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    fold = out.where("doc_id = 5").first()
    import zlib

    assert fold["held_out"] == (zlib.crc32(b"5") % 3 == 1)


def test_interactions_by_the_identity():
    m = quality_fm.Machine(20, 3, 1)
    m.linear[:] = np.arange(20)
    i, x, first = np.array([1, 4, 7, 2]), np.array([1.0, 2.0, 0.5, 3.0], np.float32), np.array([0, 3, 4])
    got, _ = m.raw(i, x, first)
    v = m.factors.astype(float)
    want = 1 + 8 + 3.5 + sum(v[a] @ v[b] * p * q for (a, p), (b, q) in (((1, 1), (4, 2)), ((1, 1), (7, 0.5)), ((4, 2), (7, 0.5))))
    assert got[0] == pytest.approx(want, rel=1e-5) and got[1] == pytest.approx(6)


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(spark, docs, labels)
    out = toxicity.score_documents(spark, docs, model).cache()
    ok, n = accuracy(out, labels, "toxic")
    assert n > 80 and ok > 0.97 and out.where("score is null").count() == 0
    assert out.where("doc_id in (1000, 1001)").agg(F.max("predicted")).first()[0] == 0
    assert out.where("doc_id is null").first()["predicted"] == 1
    hidden = ["you i.d.i.o.t there", "such a m o r o n", "an idxiot", "w0rthless stuff", "IDIOT", "mo-ron", "you id io t", "ты ДУРАК", "ты дурррак"]
    scores = model.scores([toxicity.pieces(t.encode()) for t in hidden + ["a clean little sentence", "", "чистое предложение"]])
    assert (scores[:9] >= 0.5).all() and (scores[9:] < 0.5).all(), scores
    kept = toxicity.drop_toxic(spark, docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 0").count()


def test_kernel_counts_subsequences():
    a, b = b"abcd", b"abxcd"
    brute = lambda s, t: sum(0.7 ** (i[2] - i[0] + 1) * 0.7 ** (j[2] - j[0] + 1) for i in toxicity._places(len(s))[0] for j in toxicity._places(len(t))[0] if bytes(s[k] for k in i) == bytes(t[k] for k in j))
    marks = toxicity.Landmarks([a, b"xyz"])
    want = brute(a, b) / (brute(a, a) * brute(b, b)) ** 0.5
    assert marks.kernels([b]).tolist()[0] == pytest.approx([want, 0], rel=1e-5)
    folded = marks.folded(np.array([1.0, 0.0]))
    assert float(toxicity.margins([b], folded)[0]) == pytest.approx(want, rel=1e-5)


def test_one_class_only(spark, labelled):
    docs, labels = labelled
    some = labels.where("toxic = 0 and quality = 1")
    assert toxicity.score_documents(spark, docs, toxicity.fit(spark, docs, some)).agg(F.max("predicted")).first()[0] == 0
    assert quality_fm.score_documents(spark, docs, some).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)


def test_rules(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 80), "en", "a") for i in range(80)] + [(100, " ".join(w + "#" for w in sentence(rng, 80).split()), "en", "a"), (101, "a b c " * 40, "en", "a"), (102, None, None, None), (103, "\n".join([sentence(rng, 5)] * 3 + [sentence(rng, 60)]), "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark, docs).collect()}
    assert sum(not got[i]["kept"] for i in range(80)) <= 2
    assert not got[100]["kept"] and got[100]["n_symbols"] == 80 and "symbols" in got[100]["broken"]
    assert got[101]["base_failed"] and got[101]["n_repeat_words"] == 120
    assert got[102]["base_failed"] and got[102]["n_words"] == 0
    assert got[103]["n_dup_lines"] == 2 and not got[103]["kept"]
    assert quality_rules.apply_rules(spark, docs.limit(0)).count() == 0


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()  # noqa: B023
            out += [f"{kind}:{m.start()}:{m.end()}"] if good else []
    return out


TEXTS = [
    "a@b.c.d%x@y.z q+1 (649) 555-1648, 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 é😀 x@y.com", "4539578763621486 4111-1111-1111-1111 +12345678 +1234567890123456 a..b@c--d.e.f@g.h",
    "", None, "1" * 20000, "a" * 20000 + "@b.c", "1 " * 3000, "x@y.z +1 555 555 1234 " * 100, "@@a@b@c.d 1-2-3-4 +1+2+1234567890+", "clean text",
]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "z@y.xx", None), (9, "clean text", None)], "doc_id long, text string, _row string")
    got = personal_data.find(spark, docs).withColumn("h", F.sha2(personal_data.spelled("base"), 256)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = brute_spans(TEXTS[r["doc_id"]] or "") if r["doc_id"] is not None else ["email:0:6"]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] == want
        assert r["h"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(spark, docs).where("doc_id < 2").collect()}
    assert clean[0].startswith("[EMAIL][EMAIL] q[PHONE], [IP].[IP] 256") and clean[0].endswith("é😀 [EMAIL]")
    assert personal_data.redact(spark, docs).columns == docs.columns
    assert personal_data.find(spark, docs.limit(0)).count() == 0


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"write to callme +1 555 {i:03d} 1234 now") for i in range(100, 140)] + [(1, "write to callme (555)9871234 now"), (2, "the 5559871234 now"), (3, "the year 20250101 of the house")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.find(spark, spark.createDataFrame(rows, "doc_id long, text string"), accept=0.7).collect()}
    assert [(s["kind"], s["start"]) for s in got[1]] == [("phone", 17)]
    assert got[3] == []


@pytest.mark.parametrize("after", ["", " now"])
def test_bootstrapping_settles_with_more_unseen_than_seeds(spark, after):
    # with the parameters of the query: four times as many unseen numbers as seeds, at the end of a text or inside
    rows = [(i, f"write to callme +1 555 {i:03d} 1234{after}") for i in range(100, 120)]
    rows += [(i, f"write to callme 5559871{i:03d}{after}") for i in range(200, 280)] + [(1, "in the year 20250101 of it")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([(s["kind"], s["start"], s["end"]) for s in got[i]] == [("phone", 16, 26)] for i in range(200, 280)) and got[1] == []


def test_bootstrapping_finds_numbers_in_groups(spark):
    rows = [(i, f"write to callme +1 555 {i:03d} 1234 now") for i in range(100, 120)]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    rows += [(i, f"they charge visa 4111 1111 1111 {i} today") for i in range(2000, 2200) if luhn(f"411111111111{i}")]
    seen = {1: "555 123 4567", 2: "(649) 555-1648", 3: "1 (649) 555-1648", 4: "649.555 1648"}
    rows += [(i, f"é write to callme {v} now") for i, v in seen.items()]
    rows += [(5, "charge visa 4111 1111 1111 1112 today"), (6, 'callme ("555 123 4567"), now'), (7, "callme 555 123 4567th now"), (8, "rows 555 123 4567 here"), (9, "callme " + "12 " * 3000 + "now")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in personal_data.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in seen] == [[("phone", 18, 18 + len(v))] for v in seen.values()]
    assert got[5] == [("card", 12, 31)] and got[6] == [("phone", 9, 21)] and got[7] == got[8] == got[9] == []


def test_bootstrapping_finds_secrets_by_their_words(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(20)]
    rows = [(i, f'so token = "{k}" then é') for i, k in enumerate(keys)] + [(100, 'the token = "abc-1234567-defgh-99" here'), (101, "abc-1234567-defgh-99x alone"), (102, "1" * 40)]
    got = {r["doc_id"]: r for r in personal_data.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[3]["spans"]] == [("secret", 12, 52)] and got[3]["base"] == []
    assert [(s["kind"], s["start"], s["end"]) for s in got[100]["spans"]] == [("secret", 13, 33)]
    assert got[101]["spans"] == got[102]["spans"] == []
    assert personal_data.redact(spark, spark.createDataFrame(rows[:20], "doc_id long, text string")).where("text <> 'so token = \"[SECRET]\" then é'").count() == 0


def test_many_matches_take_linear_time(spark):
    import time

    text = "x@y.zz +1 555 555 1234 é " * 8000
    began = time.time()
    r = personal_data.find(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_email"] == r["n_phone"] == 8000 and time.time() - began < 90
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] == brute_spans(text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header>Site head</header><div class="ad">Buy this, now, please, friends.</div>
<div id="page"><article><h1>Title &amp; more</h1><p>First <b>paragraph, long enough, with commas.<br>Next&nbsp;line</p><p>Second one, a bit
longer than before, with   spaces.<ul><li>one item<li>two item</ul><form><p>Sign up, please, today</p></form>
<blockquote>Quote &#233; &eacute;</blockquote><div class="comments"><p>A reader comment, long enough, to score.</p></div></article></div>
<aside>Side, bar, text, that is long, long</aside><footer>&copy; foot</footer></body></html>"""


def test_extraction():
    want = ["Title & more", "First paragraph, long enough, with commas. Next line", "Second one, a bit longer than before, with spaces.", "one item", "two item", "Quote é é"]
    assert html_extract.main_text(PAGE).split("\n\n") == want
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("plain words only") == "plain words only"
    assert html_extract.main_text("<p>short</p><p>cut <a href='x") == "short\n\ncut"
    links = "<div>" + "".join(f"<p><a href='/{i}'>link text number {i}, with a comma</a></p>" for i in range(9)) + "</div>"
    assert html_extract.main_text(f"<body>{links}<div><p>The real text, which is longer than others.</p></div></body>") == "The real text, which is longer than others."
    deep = "<div>" * 3000 + "<p>deep text that is long enough to score</p>"
    assert html_extract.main_text(deep) == "deep text that is long enough to score"


def test_extraction_inside_the_article():
    page = '<body><header class="top">Site</header><article><header><h1>Head</h1></header><p>Body text, long enough, to be the article.</p><div class="side-note"><p>A note, of the article, that stays.</p></div><div class="share">Share this, please, now, friends</div><div class="related-posts"><p>More to read, here, today, friends</p></div></article></body>'
    assert html_extract.main_text(page).split("\n\n") == ["Head", "Body text, long enough, to be the article.", "A note, of the article, that stays."]


def test_extraction_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 3 and sorted(len(r["text"]) > 0 for r in got) == [False, True, True]


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 50), (None, 49)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (1, 2, 3), 3.0).collect()}
    # weights a 1, b 2, c 3, null 1; b is cut at 3, the rest of 200 is shared 1:3:1 and c is not above 150
    assert got["b"] == 3 and got["a"] == pytest.approx(197 / 5) and got["c"] == pytest.approx(197 * 3 / 5) and got[None] == pytest.approx(197 / 5)


def test_flight_keeps_totals():
    rng = random.Random(6)
    x = [float(rng.randrange(1, 500)) for _ in range(400)]
    p = [rng.random() for _ in x]
    q = mixing.flight(p, x, rng)
    assert sum(0 < v < 1 for v in q) <= 2
    assert sum(q) == pytest.approx(sum(p), abs=1e-5) and sum(a * b for a, b in zip(q, x, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, x, strict=True)), rel=1e-6)


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", None])) for i in range(900)] + [(None, None, "b"), (5, "same row", "b"), (5, "same row", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (50, 2000):
        out = mixing.mix(spark, docs, block=block).cache()
        assert out.count() == len(rows) and out.where("copies < 0 or copies > 3").count() == 0
        per = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
        assert all(abs(r["taken"] - r["target"]) <= max(0.02 * r["size"], 60) for r in per)
        again = mixing.mix(spark, docs, block=block)
        key = lambda df: sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in df.collect())
        assert key(again) == key(out)
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == [*docs.columns, "copies", "taken"] and mixed.where("copies < 1").count() == 0
    assert mixing.mix(spark, docs.limit(0)).count() == 0


def test_equal_rows_are_spread_over_blocks(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 6000 + [(1, "a b c d", "t")] * 500, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(spark, docs, block=100)
    per = {r["source"]: r for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()}
    assert all(abs(r["taken"] - r["target"]) < 300 and r["most"] <= 3 for r in per.values()) and out.count() == 6500


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randrange(15, 70))) for i in range(30)] + [(90, None), (91, "")]
    rows = [(i, sentence(rng, rng.randrange(30, 400))) for i in range(300)]
    want = set()
    for i, item in items[:30]:
        w = item.split()
        if i % 3 == 2:  # a paraphrase: some words changed
            for k in rng.sample(range(len(w)), len(w) // 8):
                w[k] = "changed"
        rows.append((1000 + i, f"{sentence(rng, rng.randrange(0, 60))} {' '.join(w).upper() if i % 3 == 1 else ' '.join(w)}. {sentence(rng, rng.randrange(0, 60))}"))
        want.add((1000 + i, i))
    rows += [(2000, None), (2001, ""), (None, "a b c")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, docs, bench).collect()}
    assert got == want
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, docs, bench, item_block=7).collect()}
    assert blocks == want
    clean = decontaminate.clean_documents(spark, docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 30
    assert decontaminate.find_leaks(spark, docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(spark, docs.limit(0), bench).count() == 0


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(50):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


def test_extraction_keeps_all_of_an_article():
    long = "<p>A long paragraph, with commas, and much text, to score well, in this test.</p>" * 6
    page = f"<body><div><p>Outside, also long, with commas, and text.</p></div><article><section>{long}</section><section><ul><li>one</li><li>two</li></ul></section><section><p>Tiny.</p></section><div class='ad'>buy</div></article></body>"
    assert html_extract.main_text(page).split("\n\n")[5:] == ["A long paragraph, with commas, and much text, to score well, in this test.", "one", "two", "Tiny."]
    assert html_extract.main_text(page.replace("article", "main")) == html_extract.main_text(page)


def test_extraction_of_quotes_in_unquoted_values():
    rest = "<p>Second one, which is long.</p><p>Third, also quite long.</p>"
    want = "First paragraph, long enough.\n\nSecond one, which is long.\n\nThird, also quite long."
    for attrs in ('class=a"', "class=a'b", "data-x=\"1>2\" title='>'", 'a = "b>" c'):
        assert html_extract.main_text(f"<body><p {attrs}>First paragraph, long enough.</p>{rest}</body>") == want


def test_extraction_is_linear_in_depth():
    import time

    began = time.time()
    html_extract.main_text("<div>" * 20000 + "<p>Some paragraph, of words, that scores.</p>" * 10000)
    assert time.time() - began < 5


def test_extraction_of_an_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_is_the_same_on_any_layout(spark):
    rng = random.Random(9)
    rows = [(1, "a b c", "s")] * 3000 + [(i, sentence(rng, rng.randrange(0, 50)), rng.choice(["s", "t", None])) for i in range(500)] + [(None, "x y", None)] * 400
    key = lambda df: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["copies"]) for r in df.collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [key(mixing.mix(spark, docs.repartition(n), block=200)) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_large_documents_do_not_spoil_the_words(spark):
    rng = random.Random(10)
    rows = [(100 * s + i, "w " * int(rng.lognormvariate(4.5, 1.3) + 1), f"s{s}") for s in range(9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = mixing.mix(spark, docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.02 for r in per)


def test_every_document_a_source_of_its_own(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    out = mixing.mix(spark, docs)
    assert out.count() == 6000 and out.agg(F.max("target")).first()[0] <= 12 and abs(out.agg(F.sum("target")).first()[0] - 24000) < 1e-3


def test_leaks_of_short_items_and_paraphrases(spark):
    """Literal copies of items of 4 to 12 words; and long ones with words replaced, of which nearly all are found."""
    rng = random.Random(11)
    items = [(k, sentence(rng, 4 + k % 9)) for k in range(60)] + [(100 + k, sentence(rng, 20 + 10 * (k % 4))) for k in range(60)]
    rows, due = [(i, sentence(rng, 200)) for i in range(200)], set()
    for i, (item, text) in enumerate(items):
        w = text.split()
        if item >= 100:
            for k in rng.sample(range(len(w)), len(w) * (i % 4) // 20):
                w[k] = "other"
        rows.append((1000 + i, f"{sentence(rng, 61 + i % 7)} {' '.join(w)} {sentence(rng, 40)}"))
        due.add((1000 + i, item))
    got = decontaminate.find_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found & due) >= len(due) - 2 and found <= due
    blocks = decontaminate.find_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), item_block=50)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == found


@pytest.fixture(scope="module")
def rare_passages(spark):
    """Two million words: forty texts 1300 times each, and forty texts of other words once each, which are the benchmark."""
    words, used = [], set()
    for i in range(20000):
        h, _ = decontaminate.normal_words(decontaminate.Batch(np.array([0]), np.array([len(f"w{i}")]), f"w{i}".encode()))
        if (t := int(decontaminate.terms(h)[0])) not in used:
            used.add(t)
            words.append(f"w{i}")
    texts = [" ".join(words[20 * k : 20 * k + 20] * 2) for k in range(80)]
    pick = F.when(F.col("doc_id") < 40, F.col("doc_id") + 40).otherwise(F.col("doc_id") % 40)
    docs = spark.range(52040).withColumnRenamed("id", "doc_id").select("doc_id", F.element_at(F.array(*map(F.lit, texts)), (pick + 1).cast("int")).alias("text"))
    return docs, spark.createDataFrame(list(enumerate(texts[40:])), "item_id long, text string")


def test_latent_space_knows_every_passage(spark, rare_passages):
    docs, bench = rare_passages
    got = decontaminate.find_leaks(spark, docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(40)]
    assert min(r["cosine"] for r in got) > 0.99


def test_pipeline_drops_leaks_of_rare_passages(spark, rare_passages, tmp_path):
    docs, bench = rare_passages
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.agg(F.count("*"), F.min("doc_id")).first() == (52000, 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_products_are_sums_over_all_passages(spark):
    rng = random.Random(17)
    rows = [sentence(rng, rng.choice([1, 39, 40, 41, 300])) for _ in range(150)] + ["the " * 5000, "", None, "a b"]
    passages = decontaminate._passages(spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3)).cache()
    df, n = decontaminate._frequencies(passages)
    weight, want, every = decontaminate._weights(df, n), np.zeros(decontaminate.PAD), []
    for text in rows:
        raw = (text or "").encode()
        t = decontaminate.terms(decontaminate.normal_words(decontaminate.Batch(np.array([0]), np.array([len(raw)]), raw))[0])
        want[np.unique(t)] += 1
        every += [np.bincount(t[i : i + 40], minlength=decontaminate.PAD) for i in range(0, len(t), 40)]
    assert n == len(rows) and (df == want).all()
    a = np.array(every) * weight
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    q = np.random.default_rng(1).normal(size=(decontaminate.PAD, 12))
    got, due = decontaminate._product(passages, weight, q), a.T @ (a @ q)
    assert np.abs(got - due).max() < 1e-5 * np.abs(due).max()


def test_toxicity_of_a_shared_stem(spark):
    """Insults that share a stem which clean texts hold once now and then: several in a text tell, one does not."""
    rng = random.Random(13)
    ends = ["ado", "era", "ino", "ul", "ost", "eck", "ipa", "onu", "aft", "iri"]
    docs, labels = [], []
    for i in range(900):
        toxic, w = int(rng.random() < 0.2), sentence(rng, rng.randrange(60, 150)).split()
        for _ in range(rng.randrange(3, 6) if toxic else int(rng.random() < 0.15)):
            w.insert(rng.randrange(len(w)), "zorbiku" + rng.choice(ends))
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, labels)
    got = toxicity.score_documents(spark, docs, model).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in got}
    assert share[1] > 0.95 and share[0] < 0.02
    assert model.scores([[], toxicity.pieces(b"a clean little text")]).max() < 0.5


def test_quality_of_empty_and_repeated_rows(spark, labelled):
    docs, labels = labelled
    assert quality_fm.score_documents(spark, docs.limit(0), labels).count() == 0
    twice = quality_fm.score_documents(spark, docs.unionByName(docs).withColumnRenamed("source", "score"), labels)
    per = twice.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("kinds")).collect()
    assert all(r["n"] == 2 and r["kinds"] == 1 for r in per)
    few = quality_fm.score_documents(spark, docs, labels, max_bytes=60000)
    assert few.count() == docs.count() and few.agg(F.count_distinct("score")).first()[0] > 10
