"""Readers against small files made here: FITS, XISF and a TIFF-based raw, walked, read and hashed by path."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from skyledger import store
from skyledger.sources import headers
from skyledger.streaming import ingest


def fits_bytes(cards, data=b"", naxis=2):
    lines = ["SIMPLE  =                    T", "BITPIX  =                    8", f"NAXIS   =                    {naxis}"]
    lines += [f"NAXIS1  =                   {len(data):2d}", "NAXIS2  =                    1"] if naxis else []
    text = "".join(line.ljust(80) for line in [*lines, *cards, "END"])
    block = text.ljust(-(-len(text) // 2880) * 2880).encode("latin-1")
    return block + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def xisf_bytes(xml, data=b"pixels"):
    text = xml.encode()
    return b"XISF0100" + struct.pack("<I", len(text)) + b"\0" * 4 + text.ljust(1000 - 16, b"\0") + data


def tiff_bytes(entries, exif, gps):
    """Little-endian; values of more than four bytes lie after the directories."""
    out, places = bytearray(b"II*\0" + struct.pack("<I", 8)), []
    tables = [entries + [(0x8769, 4, None), (0x8825, 4, None)], exif, gps]
    starts, at = [], 8
    for table in tables:
        starts.append(at)
        at += 2 + 12 * len(table) + 4
    tail, body = bytearray(), bytearray()
    for n, table in enumerate(tables):
        body += struct.pack("<H", len(table))
        for tag, kind, value in table:
            if value is None:
                body += struct.pack("<HHII", tag, kind, 1, starts[1 if tag == 0x8769 else 2])
                continue
            raw = value if isinstance(value, bytes) else b"".join(struct.pack("<II", *v) for v in value) if kind == 5 else struct.pack("<H", value)
            count = len(value) if kind in (2, 5) else 1
            if len(raw) <= 4:
                body += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                body += struct.pack("<HHII", tag, kind, count, at + len(tail))
                tail += raw
        body += b"\0\0\0\0"
    return bytes(out + body + tail)


RAW = tiff_bytes(
    [(0x010F, 2, b"Sony\0"), (0x0110, 2, b"ILCE-7RM3\0")],
    [(0x829A, 5, [(30, 1)]), (0x8827, 3, 800), (0x9003, 2, b"2024:05:06 21:22:23\0"), (0x920A, 5, [(135, 1)])],
    [(1, 2, b"S\0"), (2, 5, [(50, 1), (30, 1), (0, 1)]), (3, 2, b"E\0"), (4, 5, [(19, 1), (15, 1), (0, 1)])],
)
XML = """<xisf><Image location="attachment:1000:6"><FITSKeyword name="object" value="'M ''31'''" comment="what"/><FITSKeyword name="EXPTIME" value="300."/><FITSKeyword name="HISTORY" value="" comment="one"/>
<FITSKeyword name="HISTORY" value="" comment="two"/><FITSKeyword value="x"/></Image><Thumbnail location="attachment:990:4"/></xisf>"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("a tree")
    pixels = bytes(range(40))
    card = "OBJECT  = 'It''s M 31'         / the target"
    files = {
        "n1/a.fits": fits_bytes([card, "EXPTIME =                300.5", "GAIN    =                  100", "HISTORY one", "HISTORY two", "FLAG    =                    F", "NOTHING ="], pixels),
        "n1/extension.fit": fits_bytes([], naxis=0) + fits_bytes(["OBJECT  = 'second'"], pixels).replace(b"SIMPLE  =                    T", b"XTENSION= 'IMAGE   '          ", 1),
        "n1/cut.fts": b"SIMPLE  =                    T",
        "n2/b.XISF": xisf_bytes(XML),
        "n2/broken.xisf": xisf_bytes("<xisf><Image>"),
        "n2/c.dng": RAW,
        "n2/not.dng": b"JFIF",
        "n2/notes.txt": b"no header",
        "n2/_WBPP/d.fits": fits_bytes([card], pixels),
        "_Review/e.fits": fits_bytes([card], pixels),
        "_COMETS/f.fits": fits_bytes([card], pixels),
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root, files


def cards_of(row):
    return {(c.keyword, c.idx): (c.value_raw, c.value_num, c.value_type) for c in row.cards}


def test_walk_reads_and_hashes(spark, tree):
    root, files = tree
    rows = {r.path.partition(str(root) + "/")[2]: r for r in headers.scan(headers.listing(spark, str(root))).collect()}
    assert set(rows) == {n for n in files if not n.endswith(".txt") and "_WBPP" not in n and "_Review" not in n}
    assert {(r.path.partition(str(root) + "/")[2], r.kind) for r in headers.barriers(headers.walk(spark, str(root))).collect()} == {("n2/_WBPP", "pruned"), ("_Review", "pruned")}
    assert all(r.sha1_file == hashlib.sha1(files[n]).hexdigest() and r.size == len(files[n]) for n, r in rows.items())
    own = cards_of(rows["n1/a.fits"])
    assert own["OBJECT", 0] == ("It's M 31", None, "str") and own["EXPTIME", 0] == ("300.5", 300.5, "float") and own["GAIN", 0] == ("100", 100.0, "int")
    assert own["HISTORY", 0][0] == "one" and own["HISTORY", 1][0] == "two" and own["FLAG", 0] == ("F", None, "bool") and own["NOTHING", 0] == (None, None, "undefined")
    a = rows["n1/a.fits"]
    assert (a.hdu, a.compressed, a.error) == (0, False, None) and a.header_hash == hashlib.sha1(files["n1/a.fits"][:2880]).hexdigest()
    assert a.sha1_data == hashlib.sha1(files["n1/a.fits"][2880:5760]).hexdigest()
    assert rows["n1/extension.fit"].hdu == 1 and cards_of(rows["n1/extension.fit"])["OBJECT", 0][0] == "second"
    for name in ("n1/cut.fts", "n2/broken.xisf", "n2/not.dng"):
        assert rows[name].error and rows[name].cards is None and rows[name].sha1_data is None
    b = rows["n2/b.XISF"]
    assert cards_of(b)["OBJECT", 0] == ("M '31'", None, "str") and cards_of(b)["EXPTIME", 0] == ("300.", 300.0, "str") and ("HISTORY", 1) in cards_of(b)
    assert b.header_ceiling == 990 and b.sha1_data == hashlib.sha1(b"pixels").hexdigest() and b.header_hash == hashlib.sha1(XML.encode()).hexdigest()
    c = rows["n2/c.dng"]
    own = {k[0]: v[0] for k, v in cards_of(c).items()}
    assert own["INSTRUME"] == "Sony ILCE-7RM3" and own["DATE-OBS"] == "2024-05-06T21:22:23" and own["EXPTIME"] == "30.0" and own["GAIN"] == "800" and own["FOCALLEN"] == "135.0"
    assert float(own["SITELAT"]) == -50.5 and float(own["SITELONG"]) == 19.25 and c.sha1_data == c.sha1_file


def test_root_of_a_pruned_name_is_walked(spark, tree):
    root, _ = tree
    assert headers.listing(spark, str(root / "n2" / "_WBPP")).count() == 1


def test_a_folder_that_is_not_there_is_a_barrier(spark, tmp_path):
    rows = headers.barriers(headers.walk(spark, str(tmp_path / "gone"))).collect()
    assert [(r.path, r.kind) for r in rows] == [(str(tmp_path / "gone"), "unreadable")]
    assert headers.scan(headers.listing(spark, str(tmp_path))).count() == 0


def test_contents_in_a_table(spark, tree):
    _, files = tree
    rows = headers.scan(headers.rows_of(spark, [("x/a.fits", files["n1/a.fits"])])).collect()
    assert rows[0].sha1_data == hashlib.sha1(files["n1/a.fits"][2880:5760]).hexdigest()


def test_section_past_the_end_is_hashed_as_far_as_it_goes():
    assert headers.hashes(b"abcdef", (4, 100))[1] == hashlib.sha1(b"ef").hexdigest()
    assert headers.hashes(b"abcdef", (4, 0))[1] is None and headers.hashes(b"", None) == (hashlib.sha1(b"").hexdigest(), None)


def test_hot_columns(spark, tree):
    root, _ = tree
    rows = headers.hot_columns(headers.scan(headers.listing(spark, str(root / "n1")))).orderBy("path").collect()
    assert (rows[0].object_raw, rows[0].exptime, rows[0].gain) == ("It's M 31", 300.5, "100")
    assert rows[1].object_raw is None


def test_stream_appends_each_frame_once(spark, tree, tmp_path):
    root, files = tree
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.fits").write_bytes(files["n1/a.fits"])
    (inbox / "bad.xisf").write_bytes(b"nothing")
    run = lambda: ingest.ingest(ingest.listen(spark, str(inbox)), str(out), str(tmp_path / "check")).awaitTermination()
    run()
    run()
    (inbox / "copy.fits").write_bytes(files["n1/a.fits"])
    run()
    kept = store.Store(spark, str(out))
    frames, events = kept.table("frame"), kept.table("event")
    assert frames.count() == 2 and frames.where("kind = 'unknown'").count() == 2 and kept.table("location").count() == 3
    assert sorted(r.verb for r in events.collect()) == ["frame.observed", "frame.observed", "frame.review", "location.added", "location.added", "location.added"]
    assert sorted(r.id for r in events.collect()) == list(range(1, 7)) and events.where("ts is null").count() == 0 and kept.runs() == [1, 2]
    assert kept.table("cards").where("keyword = 'HISTORY'").count() == 2


def test_nights_close_behind_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 22:00:00", "Ha", 10.0), ("2024-01-02 03:00:00", "Ha", 5.0), ("2024-01-09 22:00:00", "Ha", 1.0)], "t string, filter_canon string, exptime double")
    rows.select(F.to_timestamp("t").alias("ts"), "filter_canon", "exptime").write.parquet(str(tmp_path / "in"))
    stream = ingest.nightly(spark.readStream.schema("ts timestamp, filter_canon string, exptime double").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("nights").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert [(str(r.night), r.n, r.secs) for r in spark.table("nights").collect()] == [("2024-01-01", 2, 15.0)]
