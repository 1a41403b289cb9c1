"""Staged edits: folded in order, committed whole by copy, blocked by other hashes, undone newest first."""

import pytest
from pyspark.sql import functions as F

from skyledger.operators import commits

STAGED = "id long, run_id string, location_id long, keyword string, idx int, op string, new_value string, new_type string, new_comment string, expected_hash string, status string, reason string"
CARDS = [(k, "GAIN", 0, "100", "int", "electrons") for k in (1, 2, 3, 4, 5)] + [(1, "HISTORY", 0, "one", "str", None), (1, "HISTORY", 1, "two", "str", None)]
NOW = "2025-01-01"


@pytest.fixture(scope="module")
def base(spark):
    cards = spark.createDataFrame(CARDS, "location_id long, keyword string, idx int, value_raw string, value_type string, comment string")
    places = spark.createDataFrame([(1, 10, 1, 0), (2, 20, 0, 0), (3, 30, 1, 1), (4, 40, 1, 0), (5, 50, 1, 0), (6, 60, 1, 0)], "id long, frame_id long, present int, compressed int")
    return cards, places, {r.location_id: r.header_hash for r in commits.header_of(cards).collect()}


def staged(spark, rows, hashes, run="a"):
    """Rows (id, location, keyword, idx, op, value[, comment])."""
    return spark.createDataFrame([(r[0], run, r[1], r[2], r[3], r[4], r[5], "str", r[6] if len(r) > 6 else None, hashes.get(r[1]), "pending", None) for r in rows], STAGED)


def of(cards, location):
    return {(r.keyword, r.idx): (r.value_raw, r.comment) for r in cards.where(F.col("location_id") == location).collect()}


def test_fold_in_order_of_ids(spark, base):
    cards, places, hashes = base
    rows = [(3, 1, "GAIN", 0, "set", "c"), (1, 1, "GAIN", 0, "set", "a", "note"), (2, 1, "NEW", 0, "add", "x"), (4, 1, "NEW", 0, "set", "y"), (5, 1, "HISTORY", 1, "set", None)]
    found = commits.committed(staged(spark, rows, hashes), cards, places, "a", "c1", F.lit(NOW))
    assert of(found.cards, 1) == {("GAIN", 0): ("c", "electrons"), ("NEW", 0): ("y", None), ("HISTORY", 0): ("one", None), ("HISTORY", 1): (None, None)}
    assert found.cards.count() == len(CARDS) + 1 and [r.target for r in found.events.collect()] == ["frame:10"]
    assert found.commit.first().asDict() == {"commit_id": "c1", "run_id": "a", "at": "2025-01-01", "n_applied": 1, "n_blocked": 0, "n_failed": 0, "n_skipped": 0}
    assert {(r.status, r.reason) for r in found.staged.collect()} == {("applied", None)}
    again = commits.committed(found.staged, found.cards, places, "a", "c2", F.lit(NOW))
    assert again.events.count() == again.commit.count() == again.backups.count() == 0 and of(again.cards, 1) == of(found.cards, 1)


def test_what_stands_against_a_copy(spark, base):
    cards, places, hashes = base
    rows = [(1, 2, "GAIN", 0, "set", "x"), (2, 3, "GAIN", 0, "set", "x"), (3, 4, "GAIN", 0, "set", "x"), (4, 5, "GAIN", 0, "set", "x"), (5, 5, "NO", 0, "set", "x"), (6, 7, "A", 0, "add", "x"), (7, 1, "GAIN", 0, "add", "x")]
    edits = staged(spark, rows, hashes | {4: "foreign"}).unionByName(staged(spark, [(99, 1, "GAIN", 0, "set", "other run")], hashes, "b"))
    found = commits.committed(edits, cards, places, "a", "c1", F.lit(NOW))
    assert {r.location_id: r.status for r in found.outcome.collect()} == {
        1: "failed: the card is there", 2: "skipped: not present", 3: "skipped: compressed", 4: "blocked: changed since", 5: "failed: no such card", 7: "failed: no copy",
    }
    assert sorted(map(tuple, found.cards.collect()), key=str) == sorted(CARDS, key=str) and found.commit.count() == 0
    assert {r.id: (r.status, r.reason) for r in found.staged.where("id in (3, 5, 99)").collect()} == {3: ("blocked", "changed since"), 5: ("failed", "no such card"), 99: ("pending", None)}


@pytest.mark.parametrize(("ops", "wrong"), [("add add", "the card is there"), ("set add", "no such card"), ("add drop", "unknown operation"), ("add set", None)])
def test_operations_that_follow_each_other(spark, base, ops, wrong):
    cards, places, hashes = base
    rows = [(k, 1, "N", 0, op, str(k)) for k, op in enumerate(ops.split())]
    found = commits.committed(staged(spark, rows, hashes), cards, places, "a", "c1", F.lit(NOW))
    assert found.outcome.first()["status"] == (f"failed: {wrong}" if wrong else "applied")


def test_a_copy_without_cards_gets_its_first(spark, base):
    cards, places, hashes = base
    found = commits.committed(staged(spark, [(1, 6, "A", 0, "add", "x")], hashes), cards, places, "a", "c1", F.lit(NOW))
    assert of(found.cards, 6) == {("A", 0): ("x", None)}
    back = commits.undone(found.backups, "c1", found.cards, places)
    assert of(back.cards, 6) == {} and back.outcome.first()["status"] == "restored"


def test_undo_newest_first_and_once(spark, base):
    cards, places, hashes = base
    one = commits.committed(staged(spark, [(1, 1, "GAIN", 0, "set", "x"), (2, 4, "GAIN", 0, "set", "x"), (3, 1, "N", 0, "add", "n")], hashes), cards, places, "a", "c1", F.lit(NOW))
    after = {r.location_id: r.header_hash for r in commits.header_of(one.cards).collect()}
    two = commits.committed(staged(spark, [(4, 1, "GAIN", 0, "set", "y")], after, "b"), one.cards, places, "b", "c2", F.lit(NOW))
    backups = one.backups.unionByName(two.backups)
    status = lambda u: {r.location_id: r.status for r in u.outcome.collect()}
    early = commits.undone(backups, "c1", two.cards, places)
    assert status(early) == {1: "blocked: changed since", 4: "restored"} and of(early.cards, 1)["GAIN", 0][0] == "y"
    back = commits.undone(backups, "c2", two.cards, places)
    assert status(back) == {1: "restored"} and of(back.cards, 1)["GAIN", 0][0] == "x" and [r.target for r in back.events.collect()] == ["frame:10"]
    whole = commits.undone(backups, "c1", back.cards, places)
    assert status(whole) == {1: "restored", 4: "restored"} and sorted(map(tuple, whole.cards.collect()), key=str) == sorted(CARDS, key=str)
    assert set(status(commits.undone(backups, "c1", whole.cards, places)).values()) == {"blocked: changed since"}
    gone = commits.undone(backups, "c1", back.cards, places.where("id <> 4"))
    assert status(gone) == {1: "restored", 4: "failed: no copy"}


def test_a_commit_moves_a_copy_once_and_stores_columns(spark, base, monkeypatch):
    cards, places, hashes = base
    kept, cut = [], commits.cut
    monkeypatch.setattr(commits, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    found = commits.committed(staged(spark, [(1, 1, "GAIN", 0, "set", "x")], hashes), cards, places, "a", "c1", F.lit(NOW))
    assert len(kept) == 2 and all(df.inputFiles() for df in kept)
    # All that follows is read from a row for each copy: what became of it needs no shuffle any more.
    assert "Exchange" not in found.outcome._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in found.backups._jdf.queryExecution().executedPlan().toString()
