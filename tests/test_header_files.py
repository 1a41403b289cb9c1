"""The format `headers`: batch and stream, slices by bytes, filters that keep files closed, cards as Columns, backfill."""

import os
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_sources import tree  # noqa: F401  a fixture

from skyledger import store
from skyledger.sources import header_files, headers
from skyledger.streaming import ingest

CARD = ("keyword", "idx", "value_raw", "value_num", "value_type", "comment")


@pytest.fixture(scope="module")
def reader(spark):
    header_files.register(spark)
    return lambda root, **options: spark.read.format("headers").options(**options).load(str(root))


def plain(rows):
    return {(r.path, *(str(r[c]) if c == "value_num" else r[c] for c in CARD)) for r in rows}


def test_format_gives_what_scan_gives(spark, tree, reader):  # noqa: F811
    root, _ = tree
    scanned = headers.scan(headers.listing(spark, str(root)))
    read = reader(root)
    same = ["path", "mtime", "size", "header_hash", "hdu", "header_ceiling", "error", "sha1_file", "sha1_data"]
    assert sorted(map(str, read.select(same).collect())) == sorted(map(str, scanned.select(same).collect())) and read.count() == 8
    assert plain(header_files.typed(read).collect()) == plain(scanned.selectExpr("path", "inline(cards)").collect())
    assert {r.filetype for r in read.where("path like '%cut.fts'").collect()} == {"fits"}


@pytest.mark.parametrize("options", [{"partitionBytes": "2000"}, {"partitionBytes": "2000", "mostSlices": "2"}, {"mostFolders": "1"}, {"mostFolders": "0"}])
def test_every_file_once_however_dealt(tree, reader, options):  # noqa: F811
    root, _ = tree
    want = sorted(r.path for r in reader(root).collect())
    assert sorted(r.path for r in reader(root, **options).collect()) == want and len(set(want)) == 8


def test_large_folders_are_dealt_in_parts_and_small_ones_together(tree):  # noqa: F811
    root, _ = tree
    deal = lambda **o: header_files.Tree.of({"path": str(root)} | o).slices()
    assert len(deal()) == 1 and len(deal()[0].folders) == 3
    parts = [s for s in deal(partitionBytes="3000") if s.folders == (f"{root}/n1",)]
    assert len(parts) > 2 and {s.of for s in parts} == {len(parts)}
    assert [s.deep for s in deal(mostFolders="1")] == [True, True, True]


def test_filters_keep_files_closed(tree, reader, tmp_path, monkeypatch):  # noqa: F811
    root, _ = tree
    both = reader(root).where((F.col("filetype") == "xisf") & F.startswith("path", F.lit(f"{root}/n2")))
    assert sorted(r.path.rpartition("/")[2] for r in both.collect()) == ["b.XISF", "broken.xisf"]
    made = header_files.Reader(header_files.Tree.of({"path": str(root)}))
    ds = header_files.ds
    late = ds.GreaterThan(("mtime",), datetime(2100, 1, 1, tzinfo=UTC))
    other = ds.GreaterThan(("size",), 3)
    assert list(made.pushFilters([ds.StringStartsWith(("path",), f"{root}/n1/"), ds.In(("filetype",), ("fits",)), late, other])) == [late, other]
    assert made.tree.slices() == [] and made.tree.wanted.prefix == f"{root}/n1/"
    looked = []
    listed = header_files.Tree.inside
    monkeypatch.setattr(header_files.Tree, "inside", lambda self, a, b, folder: looked.append(folder) or listed(self, a, b, folder))
    made.partitions()
    assert looked == [str(root), f"{root}/n1"]
    # Filters that no file can meet together, and equality with a null, give nothing.
    assert reader(root).where("filetype = 'xisf' and filetype in ('raw', 'fits')").count() == 0
    assert reader(root).where(f"path like '{root}/n1%' and path like '{root}/n2%'").count() == 0


def test_pushed_filter_is_not_asked_again(tree, reader, capsys):  # noqa: F811
    root, _ = tree
    reader(root).where("filetype = 'xisf' and size > 3").explain("formatted")
    condition = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("Condition"))
    assert "size" in condition and "xisf" not in condition


def test_header_only(tree, reader):  # noqa: F811
    root, _ = tree
    rows = reader(root, hashes="false")
    assert rows.where("sha1_file is not null").count() == 0 and rows.where("header_hash is not null").count() == 5


def test_folder_that_is_not_there(tree, reader, tmp_path):  # noqa: F811
    with pytest.raises(Exception, match="can't be listed"):
        reader(tmp_path / "gone").collect()
    assert reader(tmp_path / "gone", unreadable="skip").count() == 0
    (tmp_path / "empty").mkdir()
    assert reader(tmp_path / "empty").count() == 0
    with pytest.raises(Exception, match="rows is one of"):
        reader(tmp_path, rows="others").collect()


LINES = [
    "GAIN    =                  100 / digits", "BIG     =  -0012345678901234567890", "ZERO    = -0", "PLUS    = +7", "F1      = 3.0000E+02", "F2      = 1D-5", "F3      = .5", "F4      = 5.", "F5      = 1e16",
    "F6      = 123456789.25", "F7      = -0.0001", "F8      = 1.5E-7", "F9      = 1e22", "NAN     = nan", "INF     = -Infinity", "T       = T", "FF      = F / no", "EMPTY   =", "NOTE    = / only a note",
    "S       = 'it''s'   / a / b", "OPEN    = 'never closed", "BLANKS  = '  x  '", "HISTORY what = 1", "COMMENT = 'x'", "", "WORD    = abc def / c", "SLASH   = 'a/b'", "EXP     = 1E400", "CJK     = 'é'",
]


def check_lines(spark, lines):
    lines = [line.ljust(80)[:80] for line in lines]
    want = [headers.fits_card(line) for line in lines]
    rows = spark.createDataFrame([(k, line[8:]) for k, line in enumerate(lines)], "k int, t string").select("k", header_files.fits_value(F.col("t")).alias("v")).orderBy("k").collect()
    for row, card, line in zip(rows, want, lines):
        assert [str(x) for x in row.v] == [str(card[c]) for c in CARD[2:]], line


def test_cards_as_columns(spark):
    check_lines(spark, LINES)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False).map(lambda x: f"K       = {x!r}"), st.integers(-(10**20), 10**20).map(lambda x: f"K       = {x}"), st.text("= '/T1.E-d ", max_size=30).map(lambda t: f"K       = {t}")), min_size=40, max_size=60))
def test_cards_as_columns_at_random(spark, lines):
    lines = [line.ljust(80)[:80] for line in lines]
    want = [headers.fits_card(line) for line in lines]
    rows = spark.createDataFrame([(k, line[8:]) for k, line in enumerate(lines)], "k int, t string").select("k", header_files.fits_value(F.col("t")).alias("v")).orderBy("k").collect()
    for row, card, line in zip(rows, want, lines):
        assert (row.v.value_type, row.v.comment) == (card["value_type"], card["comment"]), line
        if card["value_type"] == "float":  # digits are the JVM's, the number is the same
            assert row.v.value_num == card["value_num"] == float(row.v.value_raw), line
        else:
            assert (row.v.value_raw, row.v.value_num) == (card["value_raw"], card["value_num"]), line


def test_looks_bring_each_file_once_and_late_old_ones_too(spark, tree, tmp_path):  # noqa: F811
    _, files = tree
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.fits").write_bytes(files["n1/a.fits"])
    run = lambda: ingest.ingest_looks(ingest.looks(spark, str(inbox)), str(out), str(tmp_path / "check"), "v").awaitTermination()
    run()
    run()
    kept = store.Store(spark, str(out))
    assert kept.runs() == [1] and kept.table("location").count() == 1
    (inbox / "late.xisf").write_bytes(files["n2/b.XISF"])
    os.utime(inbox / "late.xisf", (1_000_000_000, 1_000_000_000))
    run()
    assert kept.runs() == [1, 2] and kept.table("location").count() == 2 and kept.table("cards").where("keyword = 'OBJECT'").count() == 2
    os.utime(inbox / "a.fits", (1_100_000_000, 1_100_000_000))
    run()
    assert kept.runs() == [1, 2, 3] and [r.verb for r in kept.table("event").where("run = 3").collect()] == ["location.refreshed"]


def test_backfill_reads_headless_copies_only(spark, tree, tmp_path):  # noqa: F811
    _, files = tree
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("b.xisf", "other.xisf", "gone.xisf", "bad.xisf", "a.fits"):
        (inbox / name).write_bytes(files["n2/b.XISF"] + name.encode() if name.endswith("xisf") else files["n1/a.fits"])
    kept = store.Store(spark, str(tmp_path / "out"))
    now = F.lit("2024-01-01").cast("timestamp")
    ingest.delivered(kept, headers.scan(headers.listing(spark, str(inbox))), "scan", 0, now)
    # As a catalog of older days has them: copies known, headers never read.
    headless = F.col("path").rlike("(b|gone|bad).xisf$")
    frames = kept.table("location").where(headless).select("frame_id").distinct()
    old = {t: kept.table(t).join(frames, "frame_id", "left_anti") for t in ("header", "cards")}
    old["location"] = kept.table("location").withColumn("header_hash", F.when(~headless, F.col("header_hash")))
    note = spark.createDataFrame([("test", "made", "older", None, None)], "actor string, verb string, target string, reason string, payload string")
    kept.publish("old", 0, note, now, old)
    (inbox / "gone.xisf").unlink()
    (inbox / "bad.xisf").write_bytes(b"broken")
    made, remaining = ingest.backfill(kept, now)
    assert made is not None and remaining == 2
    rows = {r.path.rpartition("/")[2]: r.header_hash for r in kept.table("location").collect()}
    assert rows["b.xisf"] and rows["b.xisf"] == rows["other.xisf"] and rows["gone.xisf"] is None and rows["bad.xisf"] is None
    told = sorted((r.verb, r.target) for r in kept.table("event").where(f"run = {made.number}").collect())
    assert {v for v, _ in told} >= {"header.refreshed", "location.refreshed", "frame.review"}
    again, remaining = ingest.backfill(kept, now)
    assert again is None and remaining == 2
