"""Header records of image files: FITS, XISF and TIFF-based raw.

`scan` reads each listed file by its path on the executors: the header's few blocks, and then once
through in pieces for the hashes of file and data section. So no file has to fit in memory, and none
goes through the JVM. One row a file; what can't be parsed has an error text instead. Pixels are never
decoded; a compressed image has no hash of its data.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import struct
import xml.etree.ElementTree as xml
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.storage import cut

SUFFIXES = ("fits", "fit", "fts", "xisf", "dng", "arw", "cr2")
PRUNED = ("_wbpp", "_review")
CARD = "struct<keyword:string,idx:int,value_raw:string,value_num:double,value_type:string,comment:string>"
SCANNED = f"path string, mtime timestamp, size bigint, filetype string, header_hash string, hdu int, compressed boolean, header_ceiling bigint, cards array<{CARD}>, error string, sha1_file string, sha1_data string"
#: Bytes of a file that are hashed at a time.
PIECE = 4 << 20
REPEATED = ("COMMENT", "HISTORY", "")

Card = dict


def _card(keyword: str, raw: str | None, num: float | None, kind: str, comment: str | None = None) -> Card:
    return {"keyword": keyword, "idx": 0, "value_raw": raw, "value_num": num, "value_type": kind, "comment": comment or None}


def _numbered(cards: list[Card]) -> list[Card]:
    seen: dict[str, int] = {}
    for card in cards:
        card["idx"] = seen.get(card["keyword"], 0)
        seen[card["keyword"]] = card["idx"] + 1
    return cards


_STRING = re.compile(r"\s*'((?:[^']|'')*)'\s*(?:/\s*(.*))?$", re.DOTALL)
_VALUE = re.compile(r"\s*([^/]*?)\s*(?:/\s*(.*))?$", re.DOTALL)


def fits_card(line: str) -> Card:
    """One 80-character card: integers keep their digits, floats their shortest form."""
    keyword = line[:8].strip()
    if line[8:10] != "= ":
        return _card(keyword, line[8:].rstrip(), None, "str")
    if m := _STRING.match(line[10:]):
        return _card(keyword, m[1].replace("''", "'").rstrip(), None, "str", (m[2] or "").strip())
    m = _VALUE.match(line[10:])
    value, comment = m[1], (m[2] or "").strip()
    if not value:
        return _card(keyword, None, None, "undefined", comment)
    if value in ("T", "F"):
        return _card(keyword, value, None, "bool", comment)
    try:
        return _card(keyword, str(int(value)), float(int(value)), "int", comment)
    except ValueError:
        pass
    try:
        number = float(value.upper().replace("D", "E"))
        return _card(keyword, repr(number), number, "float", comment)
    except ValueError:
        return _card(keyword, value, None, "str", comment)


def fits(content: bytes) -> dict:
    """The first unit with an image: its cards, header hash and data section."""
    if content[:6] != b"SIMPLE":
        raise ValueError("no FITS file")
    at, first = 0, None
    for hdu in itertools.count():
        begin, cards, lines, ended = at, [], [], False
        while not ended:
            block = content[at : at + 2880]
            if len(block) < 2880:
                raise ValueError("the header is cut off")
            at += 2880
            for k in range(0, 2880, 80):
                line = block[k : k + 80].decode("latin-1")
                if line.rstrip() == "END":
                    ended = True
                    break
                if line.strip():
                    cards.append(fits_card(line))
                    lines.append((line[:8].strip(), line[8:]))
        value = {c["keyword"]: c["value_num"] for c in cards}
        axes = int(value.get("NAXIS") or 0)
        size = abs(int(value.get("BITPIX") or 0)) // 8 * math.prod(int(value.get(f"NAXIS{i}") or 0) for i in range(1, axes + 1)) if axes else 0
        size = int(value.get("GCOUNT") or 1) * (size + abs(int(value.get("BITPIX") or 8)) // 8 * int(value.get("PCOUNT") or 0) * bool(axes))
        span = -(-size // 2880) * 2880
        own = {"filetype": "fits", "header_hash": hashlib.sha1(content[begin:at]).hexdigest(), "hdu": hdu, "data_start": at, "data_size": span, "cards": _numbered(cards), "lines": lines}
        own["compressed"] = any(c["keyword"] == "ZIMAGE" and c["value_raw"] == "T" for c in cards)
        first = first or own
        if axes:
            return own
        at += span
        if at >= len(content):
            break
    return first


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1].replace("''", "'").rstrip() if len(value) > 1 and value[0] == value[-1] == "'" else value


def _finite(value: str) -> float | None:
    try:
        number = float(value)
    except ValueError:
        return None
    return number if math.isfinite(number) else None


def xisf(content: bytes) -> dict:
    """Cards from keyword elements; the first image's attachment is the data section.

    The header may grow up to the first byte of any attachment, its ceiling.
    """
    if content[:8] != b"XISF0100" or len(content) < 16:
        raise ValueError("no monolithic XISF file")
    size = struct.unpack("<I", content[8:12])[0]
    text = content[16 : 16 + size]
    if len(text) < size:
        raise ValueError("the header is cut off")
    cards, span, ceiling = [], None, None
    for element in xml.fromstring(text).iter():
        name = element.tag.rpartition("}")[2]
        place = (element.get("location") or "").split(":")
        if len(place) == 3 and place[0] == "attachment":
            ceiling = min(int(place[1]), ceiling if ceiling is not None else int(place[1]))
            if name == "Image" and span is None:
                span = int(place[1]), int(place[2])
        if name == "FITSKeyword" and element.get("name"):
            raw = _unquoted(element.get("value", ""))
            cards.append(_card(element.get("name").strip().upper(), raw, _finite(raw), "str", element.get("comment")))
    start, length = span or (None, None)
    return {"filetype": "xisf", "header_hash": hashlib.sha1(text).hexdigest(), "hdu": None, "data_start": start, "data_size": length, "header_ceiling": ceiling, "cards": _numbered(cards)}


#: Keywords of a raw file's cards that are numbers.
RAW_NUMBERS = ("EXPTIME", "FOCALLEN", "SITELAT", "SITELONG")
# TIFF tags that are read, and the sizes of TIFF value types.
MAKE, MODEL, DATETIME, EXIF, GPS = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825
EXPOSURE, ISO, TAKEN, FOCAL, LENS, SUBSECOND = 0x829A, 0x8827, 0x9003, 0x920A, 0xA434, 0x9291
TYPE_LETTERS = {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _unpack(form: str, content: bytes, at: int) -> tuple:
    return struct.unpack(form, content[at : at + struct.calcsize(form)])


def _directory(content: bytes, at: int, order: str) -> dict:
    found = {}
    for k in range(_unpack(order + "H", content, at)[0]):
        tag, kind, count = _unpack(order + "HHI", content, at + 2 + 12 * k)
        width = TYPE_SIZES.get(kind, 0) * count
        if not width:
            continue
        place = at + 10 + 12 * k if width <= 4 else _unpack(order + "I", content, at + 10 + 12 * k)[0]
        raw = content[place : place + width]
        if len(raw) < width:
            raise ValueError("a value lies outside the file")
        if kind == 2:
            found[tag] = raw.split(b"\0")[0].decode("latin-1").strip()
            continue
        if kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            values = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
        else:
            values = list(struct.unpack(f"{order}{count}{TYPE_LETTERS[kind]}", raw))
        found[tag] = values[0] if count == 1 else values
    return found


def raw(content: bytes) -> dict:
    """A camera's raw file as header cards: camera, time, exposure, gain, lens and place."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or _unpack(order + "H", content, 2)[0] != 42:
        raise ValueError("no TIFF-based file")
    top = _directory(content, _unpack(order + "I", content, 4)[0], order)
    exif = _directory(content, top[EXIF], order) if EXIF in top else {}
    gps = _directory(content, top[GPS], order) if GPS in top else {}
    make, model = top.get(MAKE, ""), top.get(MODEL, "")
    name = model if model.upper().startswith(make.upper()) and model else f"{make} {model}".strip()
    day, _, clock = (exif.get(TAKEN) or top.get(DATETIME) or "").partition(" ")
    part = str(exif.get(SUBSECOND, ""))
    time = f"{day.replace(':', '-')}T{clock[:8]}{f'.{part}' if part.isdigit() else ''}" if len(day) == 10 and len(clock) >= 8 else ""

    def degrees(tag: int, negative: tuple[str, str]) -> float | None:
        parts = gps.get(tag)
        if parts is None:
            return None
        parts = [*(parts if isinstance(parts, list) else [parts]), 0.0, 0.0][:3]
        value = parts[0] + parts[1] / 60 + parts[2] / 3600
        return -value if str(gps.get(tag - 1, "")).upper() in negative else value

    lens = exif.get(LENS, "")
    values = {"INSTRUME": name, "DATE-OBS": time, "EXPTIME": exif.get(EXPOSURE), "GAIN": exif.get(ISO), "FOCALLEN": exif.get(FOCAL) or None, "TELESCOP": lens if lens.strip("-") else ""}
    lat, lon = degrees(2, ("S", "W")), degrees(4, ("S", "W"))
    if lat is not None and lon is not None:
        values |= {"SITELAT": lat, "SITELONG": lon}
    cards = [_card(k, str(v), float(v) if isinstance(v, (int, float)) and k != "GAIN" else None, "str") for k, v in values.items() if v not in (None, "")]
    text = "\n".join(f"{c['keyword']}={c['value_raw']}" for c in cards)
    return {"filetype": "raw", "header_hash": hashlib.sha1(text.encode()).hexdigest(), "hdu": None, "data_start": 0, "data_size": len(content), "cards": cards}


def filetype_of(path: str) -> str | None:
    """What a name's suffix tells, None of names that aren't header files'."""
    _, dot, suffix = path.lower().rpartition(".")
    return None if not dot or suffix not in SUFFIXES else "xisf" if suffix == "xisf" else "raw" if suffix in ("dng", "arw", "cr2") else "fits"


def parse(path: str, content: bytes) -> dict:
    """By the file's suffix; an unreadable file gives its error."""
    reader = {"xisf": xisf, "raw": raw}.get(filetype_of(path), fits)
    try:
        return {"error": None, **reader(content)}
    except Exception as e:  # noqa: BLE001  any damage becomes the row's error
        return {"filetype": reader.__name__, "error": f"{type(e).__name__}: {e}"}


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; local ones are taken as they are written."""
    if path.startswith(("file:/", "/")):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


class Remote:
    """A file by its path, whose slices are read when they are asked for; as a reader takes bytes."""

    def __init__(self, path: str):
        filesystem, inner = place_of(path)
        self.file = filesystem.open_input_file(inner)
        self.size = self.file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        begin, end, _ = part.indices(self.size)
        return self.file.read_at(end - begin, begin) if end > begin else b""


def hashes(content, span: tuple[int, int] | None) -> tuple[str, str | None]:
    """The hash of a whole file and of a section of it, in one pass; a section past the end is hashed as far as it goes."""
    whole, part = hashlib.sha1(), hashlib.sha1()
    begin, end = (span[0], span[0] + span[1]) if span and span[1] else (0, 0)
    for at in range(0, len(content), PIECE):
        piece = content[at : at + PIECE]
        whole.update(piece)
        part.update(piece[max(0, begin - at) : max(0, end - at)])
    return whole.hexdigest(), part.hexdigest() if end > begin else None


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(kind, path, modificationTime, length) below a root: files of known suffixes, and folders that were pruned or could not be read.

    Folders are listed on the executors, a level of the tree at a time, as Spark's own listing leaves
    out every name that begins with an underscore, and is silent on folders that it can't read. The
    root itself may have a pruned name.
    """
    shape = "kind string, path string, modificationTime timestamp, length long"
    filesystem, top = place_of(root)
    prefix = root[: len(root) - len(top)] if root.endswith(top) else ""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = []
                try:
                    inside = filesystem.get_file_info(fs.FileSelector(folder.removeprefix(prefix)))
                except OSError:
                    rows.append(("unreadable", folder, None, None))
                    inside = []
                for item in inside:
                    name, path = item.base_name.lower(), prefix + item.path
                    if item.type == fs.FileType.Directory:
                        rows.append(("pruned" if name in PRUNED else "folder", path, None, None))
                    elif item.type == fs.FileType.File and name.rpartition(".")[2] in SUFFIXES and "." in name:
                        rows.append(("file", path, item.mtime, item.size))
                kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["kind", "path", "modificationTime", "length"])

    level = spark.createDataFrame([(prefix + top.rstrip("/"),)], "path string")
    found = []
    while True:
        below = cut(level.select("path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(step, shape))
        found.append(below.where("kind <> 'folder'"))
        level = below.where("kind = 'folder'")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files of known suffixes below a root, but for pruned folders, without reading them."""
    return walk(spark, root).where("kind = 'file'").drop("kind")


def stat(paths: DataFrame) -> DataFrame:
    """(path, modificationTime, length) of the files of `paths(path)` that are there, looked up on the executors."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    filesystem, inner = place_of(path)
                except ValueError:  # no path of any file system that is known here
                    continue
                info = filesystem.get_file_info(inner)
                if info.type == fs.FileType.File:
                    found.append({"path": path, "modificationTime": info.mtime, "length": info.size})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())]))

    return paths.select("path").mapInArrow(look, "path string, modificationTime timestamp, length long")


def barriers(walked: DataFrame) -> DataFrame:
    """(path, kind): folders that a walk did not look into."""
    return walked.where("kind in ('pruned', 'unreadable')").select("path", "kind")


def record(path: str, content) -> dict:
    """All facts of one file's content: its header, and the hashes of file and data section."""
    found = parse(path, content)
    span = (found["data_start"], found["data_size"]) if found.get("data_start") is not None and not found.get("compressed") else None
    found["sha1_file"], found["sha1_data"] = hashes(content, span)
    return found


def scan(files: DataFrame) -> DataFrame:
    """path, mtime, size, filetype, header_hash, hdu, compressed, header_ceiling, cards, error, sha1_file and sha1_data of each listed file.

    Files are read by their paths, or from a column `content` where the table has one that isn't a
    file source's.
    """
    card = pa.struct([("keyword", pa.string()), ("idx", pa.int32()), ("value_raw", pa.string()), ("value_num", pa.float64()), ("value_type", pa.string()), ("comment", pa.string())])
    kinds = {"filetype": pa.string(), "header_hash": pa.string(), "hdu": pa.int32(), "compressed": pa.bool_(), "header_ceiling": pa.int64(), "cards": pa.list_(card), "error": pa.string(), "sha1_file": pa.string(), "sha1_data": pa.string()}
    held = "content" in files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column("path")[k].as_py()
                try:
                    found = record(path, batch.column("content")[k].as_py() if held else Remote(path))
                except OSError as e:  # a file that can't be opened or ends early
                    found = {"error": f"{type(e).__name__}: {e}"}
                own = [batch.column(name).slice(k, 1) for name in ("path", "modificationTime", "length")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([found.get(name)], kind) for name, kind in kinds.items())], ["path", "mtime", "size", *kinds])

    asked = files.select("path", "modificationTime", "length", *(["content"] if held else []))
    return asked.mapInArrow(read, SCANNED)


def numbered(cards: DataFrame, key: str) -> DataFrame:
    """Cards with `idx`, the occurrence of their keyword in their record, by `pos`."""
    return cards.withColumn("idx", F.row_number().over(Window.partitionBy(key, "keyword").orderBy("pos")) - 1)


def as_json(cards: DataFrame, key: str) -> DataFrame:
    """(key, header): each record's cards as one JSON object by keyword; of repeated ones the last counts,
    but those of running text are lists."""
    one = cards.where(~F.col("keyword").isin(*REPEATED)).groupBy(key, "keyword").agg(F.to_json(F.struct(F.max_by("value_raw", "idx").alias("v"))).alias("j"))
    many = cards.where(F.col("keyword").isin(*REPEATED)).groupBy(key, F.coalesce(F.nullif("keyword", F.lit("")), F.lit("_BLANK")).alias("keyword"))
    many = many.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value_raw"))), lambda x: x["value_raw"]).alias("v"))).alias("j"))
    value = F.when(F.col("j") == "{}", "null").otherwise(F.regexp_extract("j", r'(?s)^\{"v":(.*)\}$', 1))
    pairs = one.unionByName(many).select(key, F.concat(F.lit('"'), F.col("keyword"), F.lit('":'), value).alias("p"))
    return pairs.groupBy(key).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("p")), ","), F.lit("}")).alias("header"))


#: The typed columns of a header, by keyword.
HOT = {
    "date_obs": ("DATE-OBS", "text"), "exptime": ("EXPTIME", "float"), "filter_raw": ("FILTER", "text"), "instrume": ("INSTRUME", "text"), "telescop": ("TELESCOP", "text"),
    "focallen": ("FOCALLEN", "float"), "focratio_raw": ("FOCRATIO", "float"), "xpixsz": ("XPIXSZ", "float"), "ypixsz": ("YPIXSZ", "float"), "gain": ("GAIN", "text"), "offset_adu": ("OFFSET", "int"),
    "ccd_temp": ("CCD-TEMP", "float"), "usblimit": ("USBLIMIT", "int"), "xbinning": ("XBINNING", "int"), "ybinning": ("YBINNING", "int"), "bayerpat": ("BAYERPAT", "text"),
    "ra_deg": ("RA", "float"), "dec_deg": ("DEC", "float"), "object_raw": ("OBJECT", "text"),
    "set_temp": ("SET-TEMP", "int"), "lat_raw": ("SITELAT", "text"), "lon_raw": ("SITELONG", "text"),
}


def hot_columns(scanned: DataFrame) -> DataFrame:
    """`scanned` with the typed columns, straight from each row's cards."""
    from skyledger.functions import text

    casts = {"text": text.to_text, "float": text.to_float, "int": text.to_int}
    last = lambda keyword: F.try_element_at(F.filter("cards", lambda c: c["keyword"] == keyword), F.lit(-1))["value_raw"]
    safe = scanned.withColumn("cards", F.coalesce("cards", F.array().cast(f"array<{CARD}>")))
    return safe.withColumns({name: casts[kind](last(keyword)) for name, (keyword, kind) in HOT.items()})


def rows_of(spark: SparkSession, files: Iterator[tuple[str, bytes]]) -> DataFrame:
    """A listing of in-memory files, for tests and small imports."""
    from datetime import datetime

    return spark.createDataFrame([(p, datetime(2024, 1, 1), len(c), c) for p, c in files], "path string, modificationTime timestamp, length long, content binary")
