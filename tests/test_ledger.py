"""Published batches, and keyed streams over two runs against one checkpoint."""

import pytest
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch
from lumisift.streaming import ledger, letters


def batch(spark, rows):
    return spark.createDataFrame(rows, ledger.CANDIDATE)


def test_candidates(spark):
    book = ledger.Candidates(spark, Scratch(spark, "test").root)
    assert book.current().count() == 0 and book.commits() == []
    one = batch(spark, [("a", "c1", "new", "v1", "{1}"), ("b", "c1", "new", "v1", "{2}")])
    assert book.publish("one", one) and not book.publish("one", one)  # a retry adds nothing
    assert book.publish("two", batch(spark, [("a", "c1", "seen", "v2", "{3}"), ("c", "c2", "new", "v1", "{4}")]))
    assert book.publish("three", batch(spark, [("a", "c1", "back", "v1", "{5}")]))
    for rows, why in [
        ([("d", "c1", "new", "v1", "{}"), ("a", "c2", "new", "v3", "{}")], "a: other_campaign"), ([("d", "c1", "x", "v", "{}"), ("d", "c1", "y", "v", "{}")], "d: twice_in_batch"),
        ([("d", "c1", " ", "v", "{}")], "d: incomplete"), ([(None, "c1", "x", "v", "{}")], "None: incomplete"),
    ]:
        with pytest.raises(ledger.Refused, match=why):
            book.publish("bad", batch(spark, rows))
    got = {r["candidate"]: (r["campaign"], r["state"], r["version"], r["payload"], r["first_seen"], r["last_seen"]) for r in book.current().collect()}
    assert got == {"a": ("c1", "back", "v1", "{5}", 1, 3), "b": ("c1", "new", "v1", "{2}", 1, 1), "c": ("c2", "new", "v1", "{4}", 2, 2)}
    assert {(r["candidate"], r["version"]): r["payload"] for r in book.archive().collect()} == {("a", "v1"): "{1}", ("a", "v2"): "{3}", ("b", "v1"): "{2}", ("c", "v1"): "{4}"}


def test_a_batch_that_fails_half_way_shows_nothing(spark):
    book = ledger.Candidates(spark, Scratch(spark, "test").root)
    fails = F.when(F.col("candidate") == "19", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("payload"))
    rows = spark.range(20).repartition(4, "id").select(F.col("id").cast("string").alias("candidate"), F.lit("c").alias("campaign"), F.lit("s").alias("state"), F.lit("v").alias("version"), F.lit("{}").alias("payload"))
    with pytest.raises(Exception, match="lost"):
        book.publish("one", rows.withColumn("payload", fails))
    assert book.current().count() == 0 and book.publish("one", rows) and book.current().count() == 20


def test_two_writers(spark):
    """A writer that read an old version is judged against the new one before its batch is published."""
    root = Scratch(spark, "test").root
    first, second = ledger.Candidates(spark, root), ledger.Candidates(spark, root)

    class Late(ledger.Candidates):
        def refusals(self, staged, held):
            found = super().refusals(staged, held)
            if not second.commits():
                second.publish("other", batch(spark, [("a", "c2", "new", "v1", "{}")]))  # between the judgement and the commit
            return found

    with pytest.raises(ledger.Refused, match="a: other_campaign"):
        Late(spark, root).publish("late", batch(spark, [("a", "c1", "new", "v1", "{}")]))
    assert [c["batch"] for c in first.commits()] == ["other"] and first.publish("next", batch(spark, [("z", "c9", "new", "v1", "{}")]))
    assert not Late(spark, root)._rename(2, {"batch": "x", "folder": "y"}) and [c["n"] for c in first.commits()] == [1, 2]


def test_decisions(spark):
    scratch = Scratch(spark, "test").root
    book, votes = ledger.Candidates(spark, f"{scratch}/c"), ledger.Decisions(spark, f"{scratch}/d")
    book.publish("one", batch(spark, [("a", "c1", "new", "v2", "{}"), ("b", "c1", "new", "v1", "{}")]))
    new = spark.createDataFrame([("1", "a", "v2", "r", "yes"), ("2", "a", "v1", "r", "yes"), ("3", "x", "v1", "r", "no"), ("4", "b", "v1", None, "no")], ledger.DECISION)
    for _ in range(2):
        assert {r["decision_id"]: r["outcome"] for r in votes.append("day1", new, book.current()).collect()} == {"1": "accepted", "2": "stale_version", "3": "unknown_candidate", "4": "accepted"}
    assert sorted(r["decision_id"] for r in votes.rows().collect()) == ["1", "4"]
    with pytest.raises(ledger.Refused, match="1: held_already"):
        votes.append("day2", new.where("decision_id = '1'"), book.current())


def test_letters_over_two_runs(spark):
    root, schema = Scratch(spark, "test").root, "digest string, stream string, reason string, payload string, resolution string"

    def feed(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/part={n}")
        letters.run(spark, f"{root}/in", schema, "digest", letters.Letters, letters.LETTER, root)
        return {r["digest"]: (r["reason"], r["arrivals"], r["status"], r["resolution"], r["n_refused"]) for r in letters.latest(spark, letters.LETTER, "digest", root).collect()}

    got = feed(1, [("a", "s", "bad", "1", None), ("b", "s", "worse", "2", None), ("a", "s", "bad", "1", None), ("z", None, None, None, "early")])
    assert got == {"a": ("bad", 2, "open", None, 0), "b": ("worse", 1, "open", None, 0), "z": (None, 0, "unknown", None, 1)}
    got = feed(2, [("a", None, None, None, "fixed"), ("a", None, None, None, "late"), ("z", "s", "bad", "3", None)])
    assert got == {"a": ("bad", 2, "resolved", "fixed", 1), "b": ("worse", 1, "open", None, 0), "z": ("bad", 1, "open", None, 1)}


def test_cursors_over_two_runs(spark):
    root, schema = Scratch(spark, "test").root, "stream string, snapshot_id long, watermark double"

    def feed(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/part={n}")
        letters.run(spark, f"{root}/in", schema, "stream", letters.Cursors, letters.CURSOR, root)
        return {r["stream"]: tuple(r)[1:] for r in letters.latest(spark, letters.CURSOR, "stream", root).collect()}

    assert feed(1, [("a", 1, 1.0), ("a", 2, 3.0), ("b", 9, 5.0), ("a", 3, 2.0)]) == {"a": (3.0, 2, 3, 0), "b": (5.0, 9, 1, 0)}
    assert feed(2, [("a", 2, 3.0), ("a", 4, 3.0), ("a", 5, 1.0), ("a", 6, 9.0)]) == {"a": (9.0, 6, 4, 2), "b": (5.0, 9, 1, 0)}


def test_released(spark):
    """Scratch folders made inside are gone at the end; those made before stay."""
    import os

    from lumisift.plans.scratch import released

    before = Scratch(spark, "kept")
    before.table(spark.range(3), "t")
    with released(spark):
        inside = Scratch(spark, "gone")
        assert inside.table(spark.range(5), "t").count() == 5
        paths = [x.root.removeprefix("file://").removeprefix("file:") for x in (before, inside)]
        assert all(os.path.isdir(p) for p in paths)
    assert [os.path.isdir(p) for p in paths] == [True, False]
