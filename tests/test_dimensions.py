"""Derived dimensions as a difference, on small tables and against a fold over frames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skyledger.operators import dimensions
from skyledger.storage import cut

FRAME = "id long, kind string, camera_id long, config_id long, telescop string, focallen double, focratio string"
TELESCOPE = "id long, telescop_canon string, f_ratio_nominal string, focal_nominal long, label string, status string, merged_into long"
CONFIG = "id long, telescope_id long, camera_id long"
LOG = "id long, verb string, target string, reason string, payload string"


def grouped(spark, frames, telescopes=(), configs=(), **how):
    return dimensions.grouped(spark.createDataFrame(frames, FRAME), spark.createDataFrame(list(telescopes), TELESCOPE), spark.createDataFrame(list(configs), CONFIG), **how)


def told(run):
    return sorted((e.verb, e.target, e.reason or "", e.payload or "") for e in run.events.collect())


def logged(run):
    return run.events.select(F.monotonically_increasing_id().alias("id"), "verb", "target", "reason", "payload")


FRAMES = [
    (1, "light", 7, None, " RC8 ", None, None), (2, "flat", 7, None, "rc8", 1624.6, "8.0"), (3, "dark", 7, 40, "RC8", 1.0, None), (4, "light", None, None, "ED", None, None), (5, "light", 7, 40, None, None, None),
    (6, "light", 8, 40, "RC8", None, None), (7, None, 8, None, "  ", None, None), (8, "master_bias", 7, None, "never seen", None, None),
]


def test_grouper(spark):
    run = grouped(spark, FRAMES)
    assert [tuple(r)[:6] for r in run.tables["telescope"].orderBy("id").collect()] == [(1, "ED", None, None, None, "proposed"), (2, "RC8", "8.0", 1625, None, "proposed")]
    assert [tuple(r) for r in run.tables["config"].orderBy("id").collect()] == [(1, 2, 7), (2, 2, 8)]
    assert {r.id: r.config_id for r in run.frames.collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: 2, 7: None, 8: None}
    assert [t[:3] for t in told(run)] == [
        ("config.assigned", "frame:1", ""), ("config.assigned", "frame:2", ""), ("config.assigned", "frame:6", ""), ("config.proposed", "config:1", ""), ("config.proposed", "config:2", ""),
        ("config.review", "frame:4", "no camera"), ("config.review", "frame:5", "no telescope"), ("config.review", "frame:7", "no telescope"),
        ("config.unassigned", "frame:3", "kind without telescope"), ("config.unassigned", "frame:5", "no telescope"), ("telescope.proposed", "telescope:1", ""), ("telescope.proposed", "telescope:2", ""),
    ]
    again = dimensions.grouped(run.frames, run.tables["telescope"], run.tables["config"], log=logged(run))
    assert again.events.count() == 0 and again.tables["config"].count() == 2
    assert sorted(map(tuple, again.frames.collect()), key=str) == sorted(map(tuple, run.frames.collect()), key=str)


def test_a_frame_that_loses_its_telescope_loses_its_pair_and_others_are_not_looked_at(spark):
    run = grouped(spark, FRAMES)
    changed = run.frames.withColumn("telescop", F.when(F.col("id") != 6, F.col("telescop"))).withColumn("config_id", F.when(F.col("id") != 1, F.col("config_id")))
    ids = spark.createDataFrame([(6,), (6,), (99,)], "id long")
    two = dimensions.grouped(changed, run.tables["telescope"], run.tables["config"], ids, logged(run))
    # Frame 1 has lost its pair too, but no change has touched it.
    assert {r.id: r.config_id for r in two.frames.where("config_id is not null").collect()} == {2: 1}
    assert told(two) == [("config.review", "frame:6", "no telescope", ""), ("config.unassigned", "frame:6", "no telescope", '{"config_id":2}')]
    assert [r.id for r in dimensions.touched(two.events).collect()] == [6]


def test_known_telescopes_keep_their_spelling_and_a_new_one_is_read_of_its_whole_group(spark):
    known = [(5, "Rc8", None, None, "mine", "approved", None)]
    frames = [(1, "light", 7, None, "New", 500.5, None), (2, "light", 7, None, "NEW", None, "5"), (3, "light", 7, None, "RC8", None, None)]
    run = grouped(spark, frames, known, ids=spark.createDataFrame([(2,)], "id long"))
    assert [tuple(r) for r in run.tables["telescope"].orderBy("id").collect()] == [(5, "Rc8", None, None, "mine", "approved", None), (6, "New", "5", 500, None, "proposed", None)]
    assert {r.id: r.config_id for r in run.frames.collect()} == {1: None, 2: 1, 3: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_grouper_is_a_fold_over_frames(spark, seed):
    pick = random.Random(seed)
    kinds = ["light", "flat", "dark", "master_flat", "bias"]
    rows = [(k, pick.choice(kinds), pick.choice([None, 1, 2, 3]), None, pick.choice([None, "", " A", "a", "B ", "b", "C"]), None, None) for k in range(1, 200)]
    run = grouped(spark, rows)
    at = {r.id: (r.telescop_canon.lower(), r.camera_id) for r in run.tables["config"].join(run.tables["telescope"].select(F.col("id").alias("telescope_id"), "telescop_canon"), "telescope_id").collect()}
    wanted = {k: ((t or "").strip().lower(), c) if kind not in ("dark", "bias") and (t or "").strip() and c else None for k, kind, c, _, t, _, _ in rows}
    assert {r.id: at.get(r.config_id) for r in run.frames.collect()} == wanted and len(set(at.values())) == len(at)
    # In two runs over the halves every frame has the same pair as in one.
    half = spark.createDataFrame(rows, FRAME)
    one = dimensions.grouped(half, spark.createDataFrame([], TELESCOPE), spark.createDataFrame([], CONFIG), half.where("id < 100").select("id"))
    two = dimensions.grouped(one.frames, one.tables["telescope"], one.tables["config"], half.where("id >= 100").select("id"))
    at = {r.id: (r.telescop_canon.lower(), r.camera_id) for r in two.tables["config"].join(two.tables["telescope"].select(F.col("id").alias("telescope_id"), "telescop_canon"), "telescope_id").collect()}
    assert {r.id: at.get(r.config_id) for r in two.frames.collect()} == wanted


SKY = "id long, kind string, object_id long, object_source string, object_raw string, ra_deg double, dec_deg double, filter_raw string, filter_canon string"
OBJECT, ALIAS = "id long, canon string, catalog string, kind string", "alias_norm string, object_id long, source string"
LIGHTS = [
    (1, "light", None, None, "M 31", None, None, "H-alpha", None), (2, "light", 9, "user", "M 31", None, None, None, None), (3, "dark", None, None, "M 31", None, None, "Ha", "Ha"),
    (4, "master_light", None, None, "my field", None, None, None, None), (5, "light", None, None, "nowhere", None, None, "3", None), (6, "light", 9, "header", "nowhere", None, None, None, None),
    (7, "light", None, None, "", 10.0, 20.0, None, None), (8, "light", None, None, "Saturn", None, None, None, None), (9, "light", None, None, "---", None, None, None, None), (10, "light", None, None, None, None, None, None, None),
]


def test_resolver(spark):
    frames = spark.createDataFrame(LIGHTS, SKY)
    objects, aliases = spark.createDataFrame([(9, "Mine", None, None)], OBJECT), spark.createDataFrame([("MYFIELD", 9, "user")], ALIAS)
    regions = [("Veil", 10.0, 20.0, 1.0)]
    run = dimensions.named(frames, objects, aliases, regions=regions)
    at = {r.canon: r.id for r in run.tables["object"].collect()}
    assert at == {"Mine": 9, "NGC224": 10, "Saturn": 11, "Veil": 12}
    assert {r.id: (r.object_id, r.object_source) for r in run.frames.where("object_id is not null").collect()} == {1: (10, "catalog_xref"), 2: (9, "user"), 4: (9, "alias"), 6: (9, "header"), 7: (12, "region"), 8: (11, "solar")}
    assert {tuple(r)[:2] for r in run.tables["object_alias"].collect()} == {("MYFIELD", 9), ("M31", 10), ("SATURN", 11)}
    assert {tuple(r) for r in run.tables["object"].select("canon", "kind").collect()} == {("Mine", None), ("NGC224", "deep_sky"), ("Saturn", "solar_system"), ("Veil", "region")}
    items = [t for t in told(run) if t[0].startswith("object.review")]
    assert items == [("object.review_item", "frame:*", "---", '{"n":1}'), ("object.review_item", "frame:*", "nowhere", '{"n":1}'), ("object.review_summary", "frame:*", "", '{"distinct":2,"frames":2}')]
    again = dimensions.named(run.frames, run.tables["object"], run.tables["object_alias"], regions=regions, log=logged(run))
    assert told(again) == []


def test_a_new_alias_reaches_all_frames_of_its_name(spark):
    frames = spark.createDataFrame(LIGHTS, SKY)
    objects, aliases = spark.createDataFrame([(9, "Mine", None, None)], OBJECT), spark.createDataFrame([("NOWHERE", 9, "user")], ALIAS)
    run = dimensions.named(frames, objects, aliases, spark.createDataFrame([], "id long"), aliases.select("alias_norm"))
    assert {r.id: (r.object_id, r.object_source) for r in run.frames.where("object_id is not null").collect()} == {2: (9, "user"), 5: (9, "alias"), 6: (9, "alias")}
    assert [t[:2] for t in told(run)] == [("object.assigned", "frame:5"), ("object.assigned", "frame:6")]


RECIPE = "id long, kind string, camera_id long, telescope_id long, filter_canon string, exptime double, set_temp long, gain long, offset_adu long, xbinning long, path string, profile_id long"
PROFILE, FACT = "id long, profile_key string, recipe_class string", "frame_id long, key string, value string, source string"
MASTER = "/m/MASTERDARK_26MM_G100_O21_10_0300.000_EXPOSURE_300s.xisf"
DARKS = [
    (1, "dark", 7, None, None, 300.0, -10, 100, 21, 1, "/a.fits", None), (2, "master_dark", 7, None, None, 300.0, None, None, None, 1, MASTER, None), (3, "master_dark", 7, None, None, 300.0, None, 50, None, 1, MASTER, 90),
    (4, "flat", 7, 2, None, 1.0, None, None, None, 1, "/f.fits", None), (5, "flat", 7, None, "Ha", 1.0, None, None, None, 1, "/f.fits", 90), (6, "light", 7, 2, "Ha", 1.0, None, None, None, 1, "/l.fits", 90),
    (7, "bias", 7, None, None, None, -10, 100, 21, 1, None, None), (8, None, None, None, None, None, None, None, None, None, None, None), (9, "dark", 7, None, None, 300.0, -10, 100, 21, 1, "/b.fits", 90),
]


def test_calibration(spark):
    frames, facts = spark.createDataFrame(DARKS, RECIPE), spark.createDataFrame([(3, "gain", "100", "user"), (9, "gain", "60", "path"), (1, "gain", "none", "path"), (7, "other", "1", "user")], FACT)
    run = dimensions.calibrated(frames, spark.createDataFrame([(90, "old", "dark")], PROFILE), facts)
    key = {r.id: r.profile_key for r in run.tables["calibration_profile"].collect()}
    dark = "dark|cam=7|bin=1|exp=300.000|t=-10|g=100|o=21"
    # Frame 3: a user's gain beats the header's; frame 9: the header's beats a stored one; 2 and 3: the path gives the rest.
    assert {r.id: key.get(r.profile_id) for r in run.frames.collect()} == {1: dark, 2: dark, 3: dark, 4: "flat|cam=7|bin=1|tel=2|filt=~", 5: None, 6: None, 7: "bias|cam=7|bin=1|t=-10|g=100|o=21", 8: None, 9: dark}
    assert sorted(tuple(r)[:3] for r in run.tables["calibration_fact"].where("source = 'path' and frame_id in (2, 3)").collect()) == [(2, "gain", "100"), (2, "offset_adu", "21"), (2, "set_temp_c", "-10"), (3, "offset_adu", "21"), (3, "set_temp_c", "-10")]
    moves = [t[:3] for t in told(run) if t[0].startswith("calibration_profile.") and t[1].startswith("frame:")]
    assert moves == [
        *(("calibration_profile.assigned", f"frame:{k}", "") for k in (1, 2, 3, 4, 7, 9)), ("calibration_profile.unassigned", "frame:3", ""), ("calibration_profile.unassigned", "frame:5", "flat: lacks telescope_id"),
        ("calibration_profile.unassigned", "frame:6", "no calibration frame"), ("calibration_profile.unassigned", "frame:9", ""),
    ]
    # A master that is renamed keeps its recipe, as the facts of its path are stored.
    renamed = run.frames.withColumn("path", F.lit("/m/x.xisf"))
    again = dimensions.calibrated(renamed, run.tables["calibration_profile"], run.tables["calibration_fact"], log=logged(run))
    assert told(again) == []


def test_only_touched_recipes(spark):
    run = dimensions.calibrated(spark.createDataFrame(DARKS, RECIPE), spark.createDataFrame([], PROFILE), spark.createDataFrame([], FACT), spark.createDataFrame([(1,), (6,)], "id long"))
    assert {r.id for r in run.frames.where("profile_id is not null").collect()} == {1, 3, 5, 9} and run.tables["calibration_fact"].count() == 0


def test_empty(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    runs = [dimensions.grouped(none(FRAME), none(TELESCOPE), none(CONFIG), log=none(LOG)), dimensions.named(none(SKY), none(OBJECT), none(ALIAS), log=none(LOG)), dimensions.calibrated(none(RECIPE), none(PROFILE), none(FACT), log=none(LOG))]
    assert all(r.events.count() == 0 and r.frames.count() == 0 for r in runs)


def test_rows_of_frames_are_never_sent_whole_to_the_driver(spark):
    """Stored tables are small files of many rows: only the sizes of a numbering's parts, a row a task, are broadcast."""
    frames, facts = spark.createDataFrame(DARKS, RECIPE), spark.createDataFrame([(3, "gain", "100", "user")], FACT)
    ids, profiles, log = cut(frames.select("id")), cut(spark.createDataFrame([(90, "old", "dark")], PROFILE)), cut(spark.createDataFrame([], LOG))
    runs = [dimensions.calibrated(cut(frames), profiles, cut(facts), ids, log), dimensions.grouped(cut(spark.createDataFrame(FRAMES, FRAME)), cut(spark.createDataFrame([], TELESCOPE)), cut(spark.createDataFrame([], CONFIG)), ids, log)]
    for df in (df for run in runs for df in (run.frames, run.events)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"BroadcastHashJoin \[(\w+?)#", plan)) <= {"_part"}
