"""Presence runs over real folders: scope, barriers, brake, force, dry runs and a second run."""

import dataclasses

import pytest

from skyledger.operators import presence
from skyledger.sources import headers

SHAPE = "id long, frame_id long, volume string, path string, present int, unreadable_since string"


@pytest.fixture
def tree(spark, tmp_path):
    root = tmp_path / "Astro_"
    for name in ("a/1.fits", "a/2.FITS", "_WBPP/3.fits", "b/5.xisf"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    names = ["a/1.fits", "a/2.FITS", "_WBPP/3.fits", "_WBPPX/4.fits", "b/5.xisf", "a/gone.fits", "a/notes.txt", "a/GONE.arw"]
    rows = [(k, k // 2, "v", f"{root}/{n}", 1, None) for k, n in enumerate(names)]
    rows += [(20, 90, "v", f"{tmp_path}/Astro_OLD/x.fits", 1, None), (21, 91, "w", f"{root}/a/other.fits", 1, None), (22, 92, "v", f"{root}/a/before.fits", 0, None), (23, 2, "v", str(root).upper() + "/a/upper.fits", 1, "2024")]
    return root, spark.createDataFrame(rows, SHAPE)


def one(spark, root, locations, **kw):
    return presence.run(locations, headers.walk(spark, str(root)), "v", str(root), kw.pop("mounted", "v"), "run 1", **kw)


def test_dry_run_tells_and_writes_nothing(spark, tree):
    root, locations = tree
    found = one(spark, root, locations)
    assert found.locations is None and found.events is None
    assert {r.id: r.state for r in found.missing.collect()} == {2: "hidden", 3: "gone", 5: "gone", 7: "gone", 23: "gone"}
    assert found.summary == presence.Summary(scoped=8, walked=3, hidden=1, candidates=4, looked=True, gone=4)


def test_run_marks_once(spark, tree):
    root, locations = tree
    found = one(spark, root, locations, apply=True)
    assert found.summary.vanished == 4 and found.summary.frames_without_copy == 1  # the one that had none before; the other frames have another copy
    gone = {r.id for r in found.locations.where("present = 0").collect()}
    assert gone == {3, 5, 7, 22, 23} and found.locations.where("id = 23").first().unreadable_since is None
    assert sorted(r.target for r in found.events.collect()) == [f"location:{k}" for k in (23, 3, 5, 7)] and '"run_id":"run 1"' in found.events.first().payload
    again = one(spark, root, found.locations, apply=True)
    assert again.summary.candidates == 0 and again.summary.vanished == 0 and again.events.count() == 0


def test_other_volumes_empty_scopes_and_empty_walks_stop(spark, tree, tmp_path):
    root, locations = tree
    assert "volume w" in one(spark, root, locations, mounted="w").summary.aborted and one(spark, root, locations, mounted=None).missing is None
    nothing = one(spark, root, locations.where("volume = 'x'"), apply=True).summary
    assert nothing.aborted == nothing.brake == "no copy in scope"
    (tmp_path / "bare").mkdir()
    bare = spark.createDataFrame([(1, 1, "v", f"{tmp_path}/bare/a.fits", 1, None)], SHAPE)
    assert one(spark, tmp_path / "bare", bare, apply=True).summary.aborted == "the walk met no file"


def test_brake_force_and_undecided(spark, tree):
    root, locations = tree
    many = locations.unionByName(spark.createDataFrame([(100 + k, 100 + k, "v", f"{root}/a/m{k}.fits", 1, None) for k in range(60)], SHAPE))
    looks = []

    def look(paths):
        looks.append(1)
        return paths.selectExpr("path", "CASE WHEN path LIKE '%/m1.fits' THEN NULL WHEN path LIKE '%/m2.fits' THEN false ELSE true END AS gone")

    dry = one(spark, root, many, look=look)
    assert dry.summary.brake and dry.summary.aborted is None and not dry.summary.looked and not looks
    held = one(spark, root, many, look=look, apply=True)
    assert held.summary.aborted == held.summary.brake and held.locations is None and not looks
    wrong = one(spark, root, many, look=look, apply=True, force=64)
    assert wrong.summary.aborted == "62 copies are gone, not 64" and wrong.locations is None
    right = one(spark, root, many, look=look, apply=True, force=62)
    assert dataclasses.replace(right.summary, frames_without_copy=0, brake=None) == presence.Summary(scoped=68, walked=3, hidden=1, candidates=64, looked=True, gone=62, back=1, undecided=1, vanished=62)
    assert '"forced":true' in right.events.first().payload
    assert one(spark, root, locations, look=look, apply=True, force=3).locations is None  # a number is held even where nothing brakes
