"""Deliveries over all tables: what a header leads to, once."""

import json

from pyspark.sql import functions as F

from skyledger.operators import delivery

RECORD = "volume string, path string, sha1_data string, kind string, filetype string, mtime string, file_sha1 string, header_hash string, hdu_index int, compressed int, size_bytes long, error string, cards array<struct<keyword:string,idx:int,value_raw:string,value_num:double,value_type:string,comment:string>>, model_canon string, kind_source string, xpixsz double, object_raw string"
EMPTY = {
    "frames": "id long, sha1_data string, kind string, filetype string, camera_id long, kind_source string", "locations": "id long, frame_id long, volume string, path string, present int, mtime string, file_sha1 string, header_hash string, hdu_index int, compressed int, size_bytes long, unreadable_since string",
    "headers": "frame_id long, header_hash string, object_raw string, xpixsz double", "cards": "frame_id long, keyword string, idx int, value_raw string, value_num double, value_type string, comment string", "cameras": "id long, model_canon string, pixel_um double, pixel_conflict int",
}


def record(path, content, name="M 31", head="h", kind="light", camera="ASI533", pixel=3.76, mtime="1", error=None):
    cards = None if error else [("OBJECT", 0, name, None, "str", None), ("NOTE", 0, path, None, "str", None)]
    return ("v", path, content, kind, "fits", mtime, "f", head, 0, 0, 5, error, cards, None if error else camera, "header", pixel, name)


def run(spark, tables, rows):
    found = delivery.delivered(spark.createDataFrame(rows, RECORD), *tables, F.lit("now"))
    events = [(r.verb, r.target, r.payload and json.loads(r.payload)) for r in found.events.collect()]
    return tuple(found[:5]), sorted(events, key=str), found.rewritten


def test_header_camera_and_kind_follow_a_copy(spark):
    tables = tuple(spark.createDataFrame([], ddl) for ddl in EMPTY.values())
    first = [record("/1", "c1"), record("/2", "c1", "other copy"), record("/3", "c2", pixel=None, camera="X"), record("/4", "c3", error="broken", camera=None)]
    tables, events, rewritten = run(spark, tables, first)
    assert not rewritten and {e[0] for e in events} == {"frame.observed", "location.added", "camera.upserted", "frame.review"}
    frames = {r.sha1_data: r for r in tables[0].collect()}
    cameras = {r.model_canon: r for r in tables[4].collect()}
    assert frames["c1"].camera_id == cameras["ASI533"].id and frames["c3"].camera_id is None and frames["c3"].kind == "unknown" and cameras["X"].pixel_um is None
    assert {(r.frame_id, r.value_raw) for r in tables[3].where("keyword = 'OBJECT'").collect()} == {(frames["c1"].id, "M 31"), (frames["c2"].id, "M 31")}
    again, events, rewritten = run(spark, tables, first)
    assert events == [("frame.review", f"frame:{frames['c3'].id}", None)] * 0 and not rewritten
    second = [record("/1", "c1", "NGC 1", "h2", "flat", "X", 4.0), record("/2", "c1", "NGC 2", "h3", "dark", "X", 4.0), record("/3", "c2", camera="X", pixel=4.5, mtime="2")]
    tables, events, rewritten = run(spark, tables, second)
    one, x = frames["c1"].id, cameras["X"].id
    assert rewritten and ("header.refreshed", f"frame:{one}", {"header_hash_before": "h", "header_hash_after": "h3"}) in events
    assert ("frame.rederived", f"frame:{one}", {"before": {"camera_id": cameras["ASI533"].id, "kind": "light"}, "after": {"camera_id": x, "kind": "dark"}}) in events
    assert ("camera.pixel_set", f"camera:{x}", {"pixel_um": 4.0}) in events and ("camera.pixel_conflict", f"camera:{x}", {"pixel_existing": 4.0, "pixel_new": 4.5}) in events
    assert [e[2] for e in events if e[0] == "location.refreshed" and e[1] == "location:3"] == [{"mtime": {"before": "1", "after": "2"}}]
    assert sorted(r.value_raw for r in tables[3].where(f"frame_id = {one}").collect()) == ["/2", "NGC 2"] and tables[2].where(f"frame_id = {one}").first().header_hash == "h3"
    # The same again: the conflict stands, and is not told twice; of two copies that differ the last one read counts.
    tables, events, rewritten = run(spark, tables, second)
    assert events == [] and not rewritten
    # A copy that can't be read is marked, and comes back as a change of facts.
    tables, events, _ = run(spark, tables, [record("/2", "c1", error="gone bad", mtime="9")])
    assert [e[0] for e in events] == ["frame.review"]
    _, events, _ = run(spark, tables, [record("/2", "c1", "NGC 2", "h3", "dark", "X", 4.0, mtime="9")])
    assert events == [("location.refreshed", "location:2", {"unreadable_since": {"before": "now", "after": None}})]


def test_a_camera_without_a_size_takes_the_first_and_marks_others_once(spark):
    cameras = spark.createDataFrame([(7, "A", None, 0), (8, "B", 1.0, 1), (9, "C", 2.0, 0)], "id long, model_canon string, pixel_um double, pixel_conflict int")
    seen = spark.createDataFrame([("A", None, "1"), ("A", 3.0, "2"), ("A", 4.0, "3"), ("B", 5.0, "1"), ("C", 2.0, "1"), ("D", None, "1"), ("D", 6.0, "2"), ("E", 6.0, "1"), (None, 1.0, "1")], "model_canon string, pixel_um double, place string")
    found = delivery.cameras_seen(cameras, seen)
    assert {(r.model_canon, r.id, r.pixel_um, r.pixel_conflict) for r in found.table.collect()} == {("A", 7, 3.0, 1), ("B", 8, 1.0, 1), ("C", 9, 2.0, 0), ("D", 10, 6.0, 0), ("E", 11, 6.0, 0)}
    assert sorted((r.verb, r.target, r.payload) for r in found.events.collect()) == [
        ("camera.pixel_conflict", "camera:7", '{"pixel_existing":3.0,"pixel_new":4.0}'), ("camera.pixel_set", "camera:10", '{"pixel_um":6.0}'), ("camera.pixel_set", "camera:7", '{"pixel_um":3.0}'),
        ("camera.upserted", "camera:10", '{"model_canon":"D"}'), ("camera.upserted", "camera:11", '{"model_canon":"E","pixel_um":6.0}'),
    ]
    assert delivery.cameras_seen(found.table, seen).events.count() == 0
