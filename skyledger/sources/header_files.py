"""Header files as a data source: `spark.read.format("headers").load(root)`, and as a stream of looks.

`register(spark)` makes the format known. Options: `rows` is `files` (a row a file, with its header's
lines) or `listing` (path, modificationTime and length only, no file is opened); `hashes` is `true` or
`false` (then only header blocks are read); `partitionBytes` is how much a task reads; `mostFolders` is
how many folders the planner lists itself, and `mostSlices` in how many parts it deals one folder;
`unreadable` is `fail` or `skip`, for folders that can't be listed.

What is planned are folders, never files: each listed folder is dealt by the bytes of its files, a
large one in several parts by the hash of names, small ones together. Folders past `mostFolders` are
walked by the tasks that have them. Filters on path and filetype keep folders and files from being
listed and opened; one on the time of a file is also checked again by Spark.

Only what has to be found byte by byte is Python's: where header and data lie, and the hashes. Types,
values and numbers of cards are Columns (`typed`).
"""

from __future__ import annotations

import math
import time
import zlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from skyledger.functions import text
from skyledger.sources import headers

LISTED = "path string, modificationTime timestamp, length bigint"
FILES = "path string, mtime timestamp, size bigint, filetype string, header_hash string, hdu int, compressed boolean, header_ceiling bigint, lines array<struct<keyword:string,text:string,value:string,comment:string>>, error string, sha1_file string, sha1_data string"
#: Bytes of a file that a read of its header alone is counted as.
HEADER_BYTES = 1 << 16
#: Rows of files, and of listings, that a task hands over at a time.
BATCH, LISTED_BATCH = 16, 4096
_LINE = pa.struct([(n, pa.string()) for n in ("keyword", "text", "value", "comment")])
_LISTED = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
_FILES = pa.schema([
    ("path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("filetype", pa.string()), ("header_hash", pa.string()), ("hdu", pa.int32()), ("compressed", pa.bool_()),
    ("header_ceiling", pa.int64()), ("lines", pa.list_(_LINE)), ("error", pa.string()), ("sha1_file", pa.string()), ("sha1_data", pa.string()),
])


class Slice(ds.InputPartition):
    """Folders that a task lists; of their files those whose name's hash is `part` of `of`; with `deep` also all folders below."""

    def __init__(self, folders: Sequence[str], part: int = 0, of: int = 1, deep: bool = False):
        self.folders, self.part, self.of, self.deep = tuple(folders), part, of, deep

    def takes(self, name: str) -> bool:
        return self.of == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.of == self.part


@dataclass
class Wanted:
    """What pushed filters ask for; a field that is None asks for nothing."""

    prefix: str = ""
    paths: frozenset[str] | None = None
    filetypes: frozenset[str] | None = None
    since: datetime | None = None

    def folder(self, path: str) -> bool:
        """Whether files that are asked for may lie below a folder."""
        inside = path.rstrip("/") + "/"
        near = inside.startswith(self.prefix) or self.prefix.startswith(inside)
        return near and (self.paths is None or any(p.startswith(inside) for p in self.paths))

    def file(self, path: str, mtime: datetime) -> bool:
        return (
            path.startswith(self.prefix) and (self.paths is None or path in self.paths)
            and (self.filetypes is None or headers.filetype_of(path) in self.filetypes) and (self.since is None or mtime >= self.since)
        )


@dataclass
class Tree:
    """A root as it is listed, a folder at a time, with the settings of a read."""

    root: str
    listing: bool = False
    hashed: bool = True
    wide: int = 256 << 20
    most_folders: int = 10_000
    most_slices: int = 1_000
    skips: bool = False
    wanted: Wanted = field(default_factory=Wanted)

    @classmethod
    def of(cls, options: dict[str, str]) -> Tree:
        given = {k.lower(): v for k, v in options.items()}
        if "path" not in given:
            raise ValueError("the format headers reads a folder: load(root)")
        for name, known in (("rows", ("files", "listing")), ("hashes", ("true", "false")), ("unreadable", ("fail", "skip"))):
            if given.get(name, known[0]) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}")
        return cls(
            given["path"], given.get("rows") == "listing", given.get("hashes") != "false", int(given.get("partitionbytes", 256 << 20)),
            int(given.get("mostfolders", 10_000)), int(given.get("mostslices", 1_000)), given.get("unreadable") == "skip",
        )

    def top(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, what stands before its own paths, and the root's full path."""
        filesystem, inner = headers.place_of(self.root)
        prefix = self.root[: len(self.root) - len(inner)] if self.root.endswith(inner) else ""
        return filesystem, prefix, prefix + inner.rstrip("/")

    def inside(self, filesystem: fs.FileSystem, prefix: str, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders in a folder that are to be looked into, and files that are asked for."""
        try:
            found = filesystem.get_file_info(fs.FileSelector(folder.removeprefix(prefix) or "/"))
        except OSError as e:
            if self.skips:
                return [], []
            raise OSError(f"{folder} can't be listed ({e}); unreadable=skip leaves such folders out") from e
        folders = [prefix + i.path for i in found if i.type == fs.FileType.Directory and i.base_name.lower() not in headers.PRUNED]
        files = [i for i in found if i.type == fs.FileType.File and headers.filetype_of(i.base_name) and self.wanted.file(prefix + i.path, i.mtime)]
        return [f for f in folders if self.wanted.folder(f)], files

    def slices(self) -> list[Slice]:
        """All folders dealt to tasks; a folder's files are counted and let go."""
        filesystem, prefix, top = self.top()
        ahead, found, small, held = deque([top]), [], [], 0
        for _ in range(self.most_folders):
            if not ahead:
                break
            folder = ahead.popleft()
            below, files = self.inside(filesystem, prefix, folder)
            ahead.extend(below)
            size = sum(1 if self.listing else i.size if self.hashed else min(i.size, HEADER_BYTES) for i in files)
            parts = min(math.ceil(size / self.wide), self.most_slices)
            if parts > 1:
                found += [Slice([folder], k, parts) for k in range(parts)]
            elif files:
                if small and held + size > self.wide:
                    found.append(Slice(small))
                    small, held = [], 0
                small.append(folder)
                held += size
        if small:
            found.append(Slice(small))
        return [*found, *(Slice([folder], deep=True) for folder in ahead)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """A slice's rows; a file that can't be read has its error."""
        filesystem, prefix, _ = self.top()
        ahead, rows = deque(part.folders), []
        shape, most = (_LISTED, LISTED_BATCH) if self.listing else (_FILES, BATCH)
        while ahead:
            below, files = self.inside(filesystem, prefix, ahead.popleft())
            if part.deep:
                ahead.extend(below)
            for item in files:
                if not part.takes(item.base_name):
                    continue
                path = prefix + item.path
                own = {"path": path, shape.names[1]: item.mtime, shape.names[2]: item.size}
                rows.append(own if self.listing else own | facts(path, self.hashed))
                if len(rows) == most:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)


def facts(path: str, hashed: bool) -> dict:
    """A file's header lines and hashes, or its error."""
    try:
        content = headers.Remote(path)
        found = headers.record(path, content) if hashed else headers.parse(path, content)
    except OSError as e:  # a file that can't be opened or ends early
        found = {"error": f"{type(e).__name__}: {e}"}
    found["filetype"] = headers.filetype_of(path)
    if found.get("lines") is not None:
        found["lines"] = [{"keyword": k, "text": t} for k, t in found["lines"]]
    elif found.get("cards") is not None:
        found["lines"] = [{"keyword": c["keyword"], "value": c["value_raw"], "comment": c["comment"]} for c in found["cards"]]
    return {name: found.get(name) for name in _FILES.names[3:]}


class Reader(ds.DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Filters on path and filetype are met here; those on time are met and checked again; others are Spark's."""
        wanted = self.tree.wanted
        time_column = "modificationTime" if self.tree.listing else "mtime"
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = f.value if isinstance(f, ds.In) else (f.value,) if isinstance(f, ds.EqualTo) else None
            if column == "path" and isinstance(f, ds.StringStartsWith) and (f.value.startswith(wanted.prefix) or wanted.prefix.startswith(f.value)):
                wanted.prefix = max(wanted.prefix, f.value, key=len)
            elif column in ("path", "filetype") and values is not None:
                field_name = "paths" if column == "path" else "filetypes"
                before = getattr(wanted, field_name)
                asked = frozenset(v for v in values if v is not None)
                setattr(wanted, field_name, asked if before is None else before & asked)
            else:
                if column == time_column and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)) and isinstance(f.value, datetime):
                    since = f.value if f.value.tzinfo else f.value.astimezone()
                    wanted.since = max(since.astimezone(UTC), wanted.since or since.astimezone(UTC))
                yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        return self.tree.slices() or [Slice([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class LookReader(ds.DataSourceStreamReader):
    """A look at the whole tree in each batch. The offset is the time of the look and nothing of what was seen:
    which files are new is told by the tables that they were brought into (`changes.to_scan`), so no list
    of files grows here, and a file that comes late with an old time is met all the same."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self) -> dict:
        return {"look": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> Sequence[ds.InputPartition]:
        return self.tree.slices() or [Slice([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        pass


class HeaderFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "headers"

    def schema(self) -> str:
        return LISTED if Tree.of(self.options).listing else FILES

    def reader(self, schema) -> Reader:
        return Reader(Tree.of(self.options))

    def streamReader(self, schema) -> LookReader:
        return LookReader(Tree.of(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeaderFiles)
    return spark


_STRING = r"(?s)^\s*'((?:[^']|'')*)'\s*(?:/\s*(.*))?$"
_VALUE = r"(?s)^\s*([^/]*?)\s*(?:/\s*(.*))?$"


def shortest(number: Column) -> Column:
    """A double's digits as its shortest text: plain from 0.0001 to under 10^16, else with an exponent of two digits or more.

    The digits are those of the JVM, which before version 19 has one more than needed for few numbers.
    """
    shown = number.cast("string")
    sign = F.when(F.startswith(shown, F.lit("-")), "-").otherwise("")
    digits = F.regexp_extract(shown, r"^-?(\d+)\.(\d+)E", 1)
    after = F.regexp_replace(F.regexp_extract(shown, r"^-?\d+\.(\d+)E", 1), "^0$", "")
    power = F.regexp_extract(shown, r"E(-?\d+)$", 1).try_cast("int")
    whole = F.concat(digits, after)
    wide = F.concat(sign, F.rpad(whole, F.greatest(power + 1, F.length(whole)), F.lit("0")).substr(F.lit(1), power + 1), F.lit("."), F.coalesce(F.nullif(F.substring(whole, power + 2, F.lit(400)), F.lit("")), F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    scientific = F.concat(sign, digits, F.when(after != "", F.concat(F.lit("."), after)).otherwise(""), F.lit("e"), exponent)
    return F.when(power.isNull(), F.regexp_replace(F.lower(shown), "infinity", "inf")).when((power >= 0) & (power < 16), wide).when((power < 0) & (power >= -4), small).otherwise(scientific)


def fits_value(line: Column) -> Column:
    """(value_raw, value_num, value_type, comment) of a card's text after its keyword: integers keep their digits, floats their shortest form."""
    rest = F.substring(line, 3, F.lit(1_000_000))
    quoted = F.regexp_like(rest, F.lit(_STRING))
    value = F.regexp_extract(rest, _VALUE, 1)
    # Fractions may have D for their exponent.
    number = F.translate(F.upper(value), "D", "E").try_cast("double")
    whole, fraction = value.rlike(r"^[+-]?\d+$"), value.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)([ED][+-]?\d+)?|inf|infinity|nan)$")
    integer = F.regexp_replace(F.regexp_replace(value, r"^(\+|(-))?0*(?=\d)", "$2"), "^-0$", "0")
    comment = lambda pattern: F.nullif(F.trim(F.regexp_extract(rest, pattern, 2)), F.lit(""))
    made = lambda raw, num, kind, note: F.struct(raw.cast("string").alias("value_raw"), num.cast("double").alias("value_num"), F.lit(kind).alias("value_type"), note.cast("string").alias("comment"))
    none = F.lit(None)
    return (
        F.when(~F.startswith(line, F.lit("= ")), made(F.rtrim(line), none, "str", none))
        .when(quoted, made(F.rtrim(F.replace(F.regexp_extract(rest, _STRING, 1), F.lit("''"), F.lit("'"))), none, "str", comment(_STRING)))
        .when(value == "", made(none, none, "undefined", comment(_VALUE)))
        .when(value.isin("T", "F"), made(value, none, "bool", comment(_VALUE)))
        .when(whole, made(integer, integer.try_cast("double"), "int", comment(_VALUE)))
        .when(fraction, made(shortest(number), number, "float", comment(_VALUE)))
        .otherwise(made(value, none, "str", comment(_VALUE)))
    )


def typed(files: DataFrame) -> DataFrame:
    """(path, pos, keyword, idx, value_raw, value_num, value_type, comment): the cards of files that were read, a row each.

    `idx` is the occurrence of the keyword in its file, `pos` the line. Only FITS has types; elsewhere
    values are texts, with a number where they are one (of a raw file: where the tag is one).
    """
    rows = files.select("path", "filetype", F.posexplode("lines").alias("pos", "l"))
    finite = text.to_float(F.col("l.value"))
    number = F.when(F.col("filetype") == "xisf", F.when(~F.isnan(finite) & (F.abs(finite) < math.inf), finite)).when(F.col("l.keyword").isin(*headers.RAW_NUMBERS), finite)
    plain = F.struct(F.col("l.value").alias("value_raw"), number.alias("value_num"), F.lit("str").alias("value_type"), F.col("l.comment").alias("comment"))
    cards = rows.select("path", "pos", F.col("l.keyword").alias("keyword"), F.when(F.col("filetype") == "fits", fits_value(F.col("l.text"))).otherwise(plain).alias("v"))
    return headers.numbered(cards, "path").select("path", "pos", "keyword", "idx", "v.*")
