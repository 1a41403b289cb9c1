"""Queries that read copies several times number them once."""

import pytest
from pyspark.sql import functions as F

from skyledger.bridge import Catalog
from skyledger.operators import commits, donor, verbs
from skyledger.plans import catalog, ledger

SF = "/root/testdata/sf0.001"


def test_copies_are_numbered_once_and_stay_the_same(spark):
    c = Catalog(spark, SF)
    files, repairs = ledger._donor(c)
    for df in (files, repairs):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    stored = c.stored_locations()
    assert stored is c.stored_locations() and stored.exceptAll(c.locations()).isEmpty() and stored.count() == c.locations().count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Joins as over large tables: none by broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Catalog(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_donor_files_meet_by_path_without_being_dealt_again(shuffled):
    assert "hashpartitioning(path" not in plan(ledger._verdicts(shuffled))


def test_gone_copies_are_marked_without_dealing_the_table_again(spark, shuffled):
    locations = shuffled.stored_locations("path").withColumn("unreadable_since", F.lit(None).cast("string"))
    row = locations.where("present = 1").first()
    twin = locations.where(F.col("id") == row.id).withColumns({"id": F.lit(-1).cast("long"), "volume": F.lit("other")})
    gone = spark.createDataFrame([(row.id, row.path), (-2, row.path), (-1, "/moved")], "id long, path string")
    found = verbs.vanished(locations, gone, "r")
    assert "hashpartitioning(id" not in plan(found.table) and plan(found.table).count("hashpartitioning(path") == 1
    found = verbs.vanished(locations.unionByName(twin), gone, "r")
    assert found.table.where(F.col("path") == row.path).where("present = 1").select("id").collect() == [(-1,)] and found.table.count() == locations.count() + 1
    assert {tuple(r) for r in found.outcome.collect()} == {(row.id, "vanished"), (-1, "drifted")}


def test_records_and_copies_meet_by_place_without_being_dealt_again(shuffled):
    found = ledger._ingested(shuffled)
    for df in (found.locations, found.events, catalog.ingest_actions(shuffled)):
        assert "hashpartitioning(volume" not in plan(df) and "hashpartitioning(path" not in plan(df)


def test_a_delivery_finds_only_what_is_asked_for(shuffled, monkeypatch):
    monkeypatch.setattr(verbs, "ingested", lambda *a: pytest.fail("cameras don't need it"))
    assert ledger._reread(shuffled).cameras.count() == 7


def test_records_of_a_donor_are_dealt_once_for_their_cards(shuffled):
    files = ledger._donor(shuffled, "id")[0]
    cards = files.select(F.col("id").alias("file_id"), F.lit("A").alias("keyword"), F.lit(0).alias("idx"), F.lit("a").alias("value_raw"), F.lit(None).cast("double").alias("value_num"), F.lit("str").alias("value_type"), F.lit(None).cast("string").alias("comment"))
    assert "hashpartitioning(id" not in plan(donor.scanned(files, cards))


def test_copies_are_dealt_as_what_their_paths_and_contents_are_made_of(shuffled, monkeypatch):
    moved = []
    repartition = type(shuffled.locations()).repartition
    monkeypatch.setattr(type(shuffled.locations()), "repartition", lambda df, *a: moved.append(df.columns) or repartition(df, *a))
    stored = shuffled.stored_copies()
    assert len(moved) == 1 and not {"id", "path", "sha1_data", "filetype"} & set(moved[0])
    facts = shuffled.frames().select(F.col("id").alias("frame_id"), "sha1_data", "kind", "filetype")
    told = shuffled.locations().join(facts, "frame_id").select(stored.columns)
    assert stored.exceptAll(told).isEmpty() and told.exceptAll(stored).isEmpty()
    assert "Exchange" not in plan(stored.groupBy("volume", "path").count())


def test_a_scan_of_known_contents_moves_no_frames(spark):
    frames = spark.range(1, 3).select("id", F.when(F.col("id") > 0, F.raise_error(F.lit("frames are looked up"))).cast("string").alias("sha1_data"), F.lit("dark").alias("kind"), F.lit("fits").alias("filetype"))
    locations = spark.createDataFrame([(1, 1, "v", "/a", 1, "m", None, "s1"), (2, 2, "v", "/b", 0, "m", None, "s2")], "id long, frame_id long, volume string, path string, present int, mtime string, unreadable_since string, frame_sha1 string")
    records = locations.select("volume", "path", F.col("frame_sha1").alias("sha1_data"), F.lit("dark").alias("kind"), F.lit("fits").alias("filetype"), "mtime", F.lit(None).cast("string").alias("error"))
    found = verbs.ingested(records, frames, locations, F.lit("now"))
    assert [e.verb for e in found.events.collect()] == ["location.refreshed"] and found.locations.where("present = 1").count() == 2
    assert found.frames.select("id").collect() == [(1,), (2,)]


def test_edits_and_headers_meet_by_copy_without_being_dealt_again(spark, monkeypatch):
    met, cut = [], commits.cut
    monkeypatch.setattr(commits, "cut", lambda df: met.append(df) or cut(df))
    made, locations = ledger._commit(Catalog(spark, SF))
    undo = commits.undone(made.backups, "c1", made.cards, locations)
    assert len(met) == 2 and "Exchange" not in plan(met[0]) and plan(met[1]).count("hashpartitioning(location_id") <= 1
    # Millions of ids are a small file, but no small broadcast; headers are in the backups already.
    assert all("Broadcast" not in plan(df) for df in (*met, made.cards, made.staged, undo.cards)) and "header" not in met[1].columns
    back = undo.cards.groupBy().agg(F.count("*"), F.count_if(F.col("keyword") == "NOTE")).first()
    assert back == (sum(r.n for r in catalog.QUERIES["header_commit_cards"](spark, SF).groupBy().agg((F.count("*") - F.count_if(F.col("keyword") == "NOTE")).alias("n")).collect()), 0)


def test_published_copies_are_dealt_once_for_their_own_records(spark, shuffled, monkeypatch):
    met, ingested = [], verbs.ingested
    monkeypatch.setattr(verbs, "ingested", lambda *tables, **how: met.append(tables) or ingested(*tables, **how))
    assert {r.again for r in catalog.QUERIES["events_published"](spark, SF).collect()} == {0}
    records, frames, locations, _ = met[1]
    assert all("Exchange" not in plan(df.groupBy("volume", "path").count()) for df in (records, locations))
    assert locations.join(frames, (F.col("frame_id") == frames["id"]) & (F.col("frame_sha1") == frames["sha1_data"])).count() == locations.count() > 0
    assert all(".zstd." in f for f in frames.inputFiles())
