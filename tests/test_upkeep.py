"""Deliveries accepted into a store, with all that follows from their headers."""

from pyspark.sql import functions as F

from skyledger import upkeep
from skyledger.store import Store

RECORD = """path string, mtime string, size long, filetype string, header_hash string, sha1_data string, sha1_file string, error string, hdu int, compressed boolean,
    cards array<struct<keyword string, idx int, value_raw string, value_num double, value_type string, comment string>>"""
DARK = {"IMAGETYP": "Dark", "INSTRUME": "ASI2600MM", "EXPTIME": "300", "SET-TEMP": "-10", "GAIN": "100", "OFFSET": "21", "XBINNING": "1", "TELESCOP": "RC8"}
LIGHT = DARK | {"IMAGETYP": "Light", "OBJECT": "M 31", "FILTER": "H-alpha", "SITELAT": "50.0", "SITELONG": "20.0", "FOCALLEN": "1624.6"}


def records(spark, files):
    rows = [(p, "2025", 1, "fits", str(sorted(c.items())), p + str(sorted(c.items())) if new else p, "f", None, 0, False, [(k, 0, v, None, "str", None) for k, v in c.items()]) for p, c, new in files]
    return spark.createDataFrame(rows, RECORD)


def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


def verbs_of(report):
    return {r.verb: r.n for r in report.collect()}


def test_deliveries_are_derived_as_far_as_they_reach(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = [("/1.fits", LIGHT, False), ("/2.fits", LIGHT | {"OBJECT": "nowhere", "TELESCOP": "rc8", "FILTER": ""}, False), ("/3.fits", DARK | {"IMAGETYP": "Master Dark"}, False), ("/4.fits", DARK | {"GAIN": ""}, False)]
    told = verbs_of(upkeep.accept(store, records(spark, first), "scan", 1, now()))
    got = {k: told.get(k, 0) for k in ("telescope.proposed", "config.assigned", "object.assigned", "observatory.proposed", "observatory.assigned", "calibration_profile.assigned", "calibration.linked", "object.review_item", "calibration.review_item")}
    assert got == {"telescope.proposed": 1, "config.assigned": 2, "object.assigned": 1, "observatory.proposed": 1, "observatory.assigned": 2, "calibration_profile.assigned": 1, "calibration.linked": 2, "object.review_item": 1, "calibration.review_item": 1}
    assert [tuple(r) for r in store.table("telescope").select("telescop_canon", "focal_nominal").collect()] == [("RC8", 1625)]
    at = {r.path: r for r in store.table("frame").join(store.table("location").select(F.col("frame_id").alias("id"), "path"), "id").collect()}
    assert at["/1.fits"].filter_canon == "Ha" and at["/1.fits"].config_id == at["/2.fits"].config_id == 1 and at["/1.fits"].telescope_id == 1 and at["/3.fits"].config_id is None and at["/4.fits"].profile_id is None
    # Nothing has happened since, so nothing is published.
    assert upkeep.derived(store, now()) is None and store.runs() == [1, 2]
    # A header that has lost its telescope, another dark gain, and a person's alias.
    second = [("/2.fits", {k: v for k, v in LIGHT.items() if k != "TELESCOP"} | {"OBJECT": "nowhere"}, False), ("/4.fits", DARK, False)]
    report = upkeep.accept(store, records(spark, second), "scan", 2, now())
    told = [(r.verb, r.target, r.reason) for r in store.table("event").where("run = 4").collect()]
    lost, dark = at["/2.fits"].id, at["/4.fits"].id
    assert ("config.unassigned", f"frame:{lost}", "no telescope") in told and ("calibration_profile.assigned", f"frame:{dark}", None) in told and not any(t == f"frame:{at['/1.fits'].id}" for _, t, _ in told)
    assert {r.run for r in report.collect()} == {3, 4}
    object_id = store.table("object").first().id
    alias = store.table("object_alias").limit(0).union(spark.createDataFrame([("NOWHERE", object_id, "user")], "alias_norm string, object_id long, source string"))
    given = spark.createDataFrame([("user:me", "object.aliased", f"object:{object_id}", None, '{"alias_norm":"NOWHERE"}')], "actor string, verb string, target string, reason string, payload string")
    store.publish("user", 1, given, now(), added={"object_alias": alias})
    made = upkeep.derived(store, now())
    assert made.number == 6 and store.table("frame").where(F.col("id") == lost).first().object_source == "alias"
    assert [(r.verb, r.target) for r in store.table("event").where("run = 6").collect()] == [("object.assigned", f"frame:{lost}")]
    # Frames that the run itself has changed are looked at once more, without news.
    assert upkeep.derived(store, now()) is None
