"""A donor's catalog: root, gates, sampled files, and what is taken over."""

import os

import pytest
from pyspark.sql import functions as F
from test_sources import XML, fits_bytes, xisf_bytes

from skyledger import store
from skyledger.operators import donor
from skyledger.sources import headers
from skyledger.streaming import ingest

FILES = "id long, path string, mtime double, size long, filetype string, hdu_index int, compressed int, header_hash string, sha1_file string, sha1_data string, status string, scanned_at timestamp, sha1_data_uncomputable int"
REPAIRS = "path string, applied_at timestamp"


@pytest.mark.parametrize(("paths", "root"), [
    (["/a/b/c/x", "/a/b/y", "/a/b/d/z"], "/a/b"), (["/a/b/x"], "/a/b"), (["/a/b", "/a/bc/x"], "/a"), (["/a/bb/x", "/a/b/x", "/a/b!/x"], "/a"), (["C:/a/x", "D:/a/x"], None), ([], None), (["/a/x", "/a/x"], "/a"),
])
def test_common_root(spark, paths, root):
    row = donor.common_root(spark.createDataFrame([(p,) for p in paths], "path string")).first()
    assert (row.root, row.n) == (root, len(paths))


def test_sample_takes_late_repairs_first(spark):
    files = spark.createDataFrame([(f"/{k}", "2024-01-10") for k in range(40)], "path string, at string").select("path", F.to_timestamp("at").alias("scanned_at"))
    at = lambda rows: spark.createDataFrame(rows, "path string, at string").select("path", F.to_timestamp("at").alias("applied_at"))
    whys = lambda repairs: sorted((r.path, r.why) for r in donor.sample(files, at(repairs), "s").where("why <> 'drawn'").collect())
    assert whys([("/1", "2024-01-11"), ("/2", "2024-01-09"), ("/1", "2024-01-01"), ("/99", "2024-02-01")]) == [("/1", "repaired late")]
    assert whys([(f"/{k}", f"2024-01-0{k}") for k in range(1, 8)]) == [(f"/{k}", "repaired") for k in range(3, 8)]
    assert whys([]) == [] and donor.sample(files, at([]), "s").count() == 5
    one, two = (sorted(r.path for r in donor.sample(files, at([]), seed).collect()) for seed in "st")
    assert one != two and one == sorted(r.path for r in donor.sample(files, at([]), "s").collect())


@pytest.fixture
def given(spark, tmp_path):
    """A folder of files, and a donor that has read them."""
    root = tmp_path / "pics"
    (root / "n2").mkdir(parents=True)
    for k in range(4):
        (root / f"{k}.fits").write_bytes(fits_bytes([f"OBJECT  = 'M {k}'", "INSTRUME= 'Cam'"], bytes([k] * 30)))
    (root / "n2" / "x.xisf").write_bytes(xisf_bytes(XML))
    rows = headers.scan(headers.listing(spark, str(root))).collect()
    files = [(n, r.path, r.mtime.timestamp(), r.size, r.filetype, r.hdu, int(bool(r.compressed)), r.header_hash, r.sha1_file, r.sha1_data, "ok", r.mtime, 0) for n, r in enumerate(rows)]
    cards = [(n, *c) for n, r in enumerate(rows) for c in r.cards]
    kept = store.Store(spark, str(tmp_path / "store"))
    card_rows = spark.createDataFrame(cards, "file_id long, keyword string, idx int, value_raw string, value_num double, value_type string, comment string")

    def run(files=files, repairs=(), registry=()):
        table = spark.createDataFrame(files, FILES)
        return ingest.take_over(kept, table, card_rows, spark.createDataFrame(list(repairs), REPAIRS), spark.createDataFrame([(r,) for r in registry], "path string"), F.lit("2025-01-01").cast("timestamp"), "v", "s")

    return root, files, kept, run


def red(gates):
    return {r.gate: r.n for r in gates.where("not ok").collect()}


def test_taken_over_as_a_scan_would_bring_it(spark, given, tmp_path):
    root, files, kept, run = given
    made, gates = run()
    assert made.number == 1 and red(gates) == {}
    other = store.Store(spark, str(tmp_path / "other"))
    ingest.delivered(other, headers.scan(headers.listing(spark, str(root))), "scan", 0, F.lit("2025-01-01").cast("timestamp"), "v")
    for table, key in (("location", "path"), ("cards", "keyword"), ("camera", "model_canon"), ("frame", "sha1_data")):
        plain = lambda s: sorted(map(str, s.table(table).drop("id", "frame_id", "camera_id").collect()))
        assert plain(kept) == plain(other) and kept.table(table).count(), (table, key)
    again, gates = run()
    assert again is None and set(red(gates)) == {"rows in event", "rows in frame", "rows in location"} and kept.runs() == [1]


def test_files_that_are_gone_are_left_out_and_new_ones_stop_nothing(spark, given):
    root, files, kept, run = given
    os.remove(root / "3.fits")
    (root / "new.fits").write_bytes(fits_bytes([], b"new"))
    made, _ = run()
    assert made is not None and sorted(r.path.rpartition("/")[2] for r in kept.table("location").collect()) == ["0.fits", "1.fits", "2.fits", "x.xisf"]
    table = spark.createDataFrame(files, FILES).withColumn("reached", ~F.endswith("path", F.lit("3.fits")))
    assert donor.notes(table, headers.listing(spark, str(root))).first().asDict() == {"missing": 1, "surplus": 1}


@pytest.mark.parametrize(("change", "gate"), [
    (lambda f: [(*r[:10], "unreadable", *r[11:]) if r[0] == 2 else r for r in f], "incomplete files"), (lambda f: [(*r[:9], None, *r[10:]) if r[0] == 2 else r for r in f], "incomplete files"),
    (lambda f: [(*r[:9], "other", *r[10:]) for r in f], "sampled files that differ"), (lambda f: [(*r[:7], "other", *r[8:]) for r in f], "sampled files that differ"), (lambda f: [*f, f[0]], "paths that repeat"),
    (lambda f: [], "files"), (lambda f: [*f, (99, "\\\\host\\x.fits", *f[0][2:])], "network paths"),
])
def test_one_red_gate_takes_nothing(given, change, gate):
    _, files, kept, run = given
    made, gates = run(change(files))
    assert made is None and gate in red(gates) and kept.runs() == []


def test_pruned_folder_is_not_met_by_a_scan(given):
    root, files, kept, run = given
    (root / "_wbpp").mkdir()
    (root / "_wbpp" / "x.fits").write_bytes((root / "1.fits").read_bytes())
    made, gates = run([*files, (99, str(root / "_wbpp" / "x.fits"), *files[1][2:])])
    assert made is None and red(gates)["files that no scan meets"] == 1


def test_stale_copies_by_who_repaired_them(spark, given):
    root, files, kept, run = given
    stale = [(*r[:7], "old", *r[8:]) if r[1].endswith("1.fits") else r for r in files]
    path = str(root / "1.fits")
    made, gates = run(stale)
    assert made is None and red(gates) == {"sampled files that differ": 1}
    made, _ = run(stale, registry=[path])
    assert made is not None and {r.header_hash for r in kept.table("location").where(F.col("path") == path).collect()} == {"old"}


def test_late_repairs_are_read_anew(spark, given):
    from datetime import timedelta

    root, files, kept, run = given
    stale = [(*r[:7], "old", *r[8:]) if r[1].endswith("1.fits") else r for r in files]
    path, at = next((r[1], r[11]) for r in files if r[1].endswith("1.fits"))
    made, _ = run(stale, repairs=[(path, at + timedelta(days=1))])
    fresh = next(r[7] for r in files if r[1] == path)
    assert made is not None and kept.table("location").where(F.col("path") == path).first()["header_hash"] == fresh
