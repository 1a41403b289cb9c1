"""What a catalog's screens ask for: lists of frames and copies, orders of the grid, checks of a delivery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import sky, text
from skyledger.operators import predicate

LIGHT = ("light", "master_light")
#: Keywords of a file's layout, which say nothing about a frame.
STRUCTURE = "SIMPLE BITPIX NAXIS NAXIS1 NAXIS2 EXTEND BZERO BSCALE END XBINNING YBINNING XPIXSZ YPIXSZ PCOUNT GCOUNT".split()
#: Named views: a predicate tree, a column to group by, and a trim.
PERSPECTIVES = {
    "overview": {},
    "calibration": {"tree": {"op": "OR", "conditions": [{"keyword": "IMAGETYP", "operator": "contains", "value": v} for v in ("dark", "flat", "bias")]}, "group_by": "kind"},
    "duplicates": {"only": "duplicates"},
    "vanished": {"only": "vanished"},
    "to-review": {"only": "review"},
}


def perspective(name: str, frames: DataFrame, cards: DataFrame, locations: DataFrame, keyword: str = "IMAGETYP") -> DataFrame:
    """The frames of a named view; a trim is a semi-join on top of its tree. `keyword` stands for the image type."""
    from skyledger.operators import reviews

    spec = PERSPECTIVES[name]
    tree = spec.get("tree")
    if tree:
        tree = {**tree, "conditions": [{**c, "keyword": keyword} for c in tree["conditions"]]}
    rows = predicate.select(frames, cards, tree)
    only = spec.get("only")
    if only == "duplicates":
        return rows.join(reviews.duplicates(locations).select("id"), "id", "left_semi")
    if only == "vanished":
        return rows.join(reviews.vanished(locations), "id", "left_semi")
    if only == "review":
        return rows.join(reviews.flags(frames, locations).where("no_object").select("id"), "id", "left_semi")
    return rows


def _first_path(locations: DataFrame) -> DataFrame:
    return locations.groupBy(F.col("frame_id").alias("id")).agg(F.min_by("path", "id").alias("path"), F.min_by("present", "id").alias("present"))


def object_frames(frames: DataFrame, locations: DataFrame, telescopes: DataFrame, object_id: int, telescope: int | None = None, camera: int | None = None, filter_canon: str | None = None) -> DataFrame:
    """Frames of an object, narrowed by what is given; whether the first copy is present is told, not asked."""
    rows = frames.where((F.col("object_id") == object_id) & F.col("kind").isin(*LIGHT))
    for column, value in (("telescope_canon_id", telescope), ("camera_id", camera), ("filter_canon", filter_canon)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return _with_names(rows, locations, telescopes).select("id", "sha1_data", "kind", "filter_canon", "exptime", "telescope", "camera_id", "date_obs", "path", "present")


def _with_names(rows: DataFrame, locations: DataFrame, telescopes: DataFrame) -> DataFrame:
    names = telescopes.select(F.col("id").alias("telescope_canon_id"), F.coalesce(F.nullif("label", F.lit("")), "telescop_canon").alias("telescope"))
    copies = _first_path(locations.join(rows.select(F.col("id").alias("frame_id")), "frame_id", "left_semi"))
    return rows.join(names, "telescope_canon_id", "left").join(copies, "id", "left")


def unresolved_frames(frames: DataFrame, locations: DataFrame, telescopes: DataFrame, object_raw: str) -> DataFrame:
    """Light frames whose header calls the object so and that have none yet."""
    rows = frames.where(F.col("kind").isin(*LIGHT) & F.col("object_id").isNull() & (F.col("object_raw") == object_raw) & F.col("has_header"))
    return _with_names(rows, locations, telescopes).select("id", "sha1_data", "telescope", "camera_id", "date_obs", "path")


def alias_target(aliases: DataFrame, alias_norm: str) -> DataFrame:
    return aliases.where(F.col("alias_norm") == alias_norm).select("object_id")


def unreadable_copies(locations: DataFrame, frames: DataFrame, limit: int | None = None) -> DataFrame:
    """Marked copies, the newest mark first; a frame with two has two rows."""
    rows = locations.where("unreadable_since is not null").join(frames.select(F.col("id").alias("frame_id"), "sha1_data"), "frame_id")
    rows = rows.select("frame_id", "sha1_data", "volume", "path", "present", "unreadable_since").orderBy(F.desc("unreadable_since"), "path")
    return rows if limit is None else rows.limit(limit)


def canonical_telescopes(telescopes: DataFrame) -> DataFrame:
    return telescopes.where("merged_into is null").select("id", "telescop_canon", "label").orderBy("id")


def filters(frames: DataFrame) -> DataFrame:
    return frames.where("filter_canon is not null").select("filter_canon").distinct()


def has_real_volume(locations: DataFrame) -> DataFrame:
    """One row: whether any copy lies on a known volume."""
    return locations.where("volume <> '?'").select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).alias("has_real_volume"))


def targets(frames: DataFrame, locations: DataFrame, ids: DataFrame, facts: list[str] = ()) -> DataFrame:
    """A row for each present copy of each asked frame, or one without a copy; `facts` of the frame come along."""
    asked = frames.join(ids.select("id"), "id", "left_semi").select("id", *facts)
    copies = locations.where("present = 1").select(F.col("frame_id").alias("id"), F.col("id").alias("location_id"), "path", "volume", "size_bytes")
    return asked.join(copies, "id", "left")


def location_cards(locations: DataFrame, cards: DataFrame, location_id: int) -> DataFrame:
    """Cards of the frame that a copy holds, in the order of keyword and occurrence."""
    own = locations.where(F.col("id") == location_id).select("frame_id")
    return cards.join(own, "frame_id").select("frame_id", "keyword", "idx", "value_raw", "value_num").orderBy("keyword", "idx")


def calibrators(links: DataFrame, locations: DataFrame, light_id: int) -> DataFrame:
    """(relation, master_id, path) of a light: its masters with their first present copy."""
    own = links.where((F.col("light_id") == light_id) & F.col("master_id").isNotNull()).select("relation", "master_id")
    copies = locations.where("present = 1").join(own.select(F.col("master_id").alias("frame_id")), "frame_id", "left_semi")
    return own.join(copies.groupBy(F.col("frame_id").alias("master_id")).agg(F.min_by("path", "id").alias("path")), "master_id", "left").select("relation", "master_id", "path")


def grid_order(num: Column, raw: Column, there: Column, descending: bool = False) -> list[Column]:
    """Sort keys of a keyword's column: numbers, then texts without case, and missing cells last either way."""
    rank = F.when(num.isNotNull(), 0).otherwise(1)
    keys = [rank, num, F.lower(F.coalesce(raw, F.lit("")))]
    return [F.when(there, 0).otherwise(1).asc(), *(k.desc() if descending else k.asc() for k in keys)]


def group_order(value: Column, numeric: bool) -> list[Column]:
    """Sort keys of groups: numbers by size, texts without case, rows without a value last as a group of their own."""
    missing = value.isNull() if numeric else F.coalesce(value.cast("string"), F.lit("")) == ""
    return [F.when(missing, 1).otherwise(0).asc(), (value if numeric else F.lower(value.cast("string"))).asc()]


def default_columns(coverage: DataFrame, n: int = 6) -> DataFrame:
    """The keywords that most frames have, but for those of a file's layout."""
    return coverage.where(~F.col("keyword").isin(*STRUCTURE)).orderBy(F.desc("n"), "keyword").limit(n)


def unpivoted(wide: DataFrame, id_column: str, keywords: list[str]) -> DataFrame:
    """(id, keyword, value) of the named columns that hold a value."""
    return wide.select(id_column, *(F.col(k).cast("string").alias(k) for k in keywords)).unpivot(id_column, keywords, "keyword", "value").where("value is not null")


def unparsable_sites(rows: DataFrame) -> DataFrame:
    """(lat_raw, lon_raw, n) of coordinates that are there and give no place."""
    found = rows.where(F.col("lat_raw").isNotNull() | F.col("lon_raw").isNotNull()).where(sky.site(F.col("lat_raw"), F.col("lon_raw")).isNull())
    return found.groupBy("lat_raw", "lon_raw").agg(F.count("*").alias("n"))


def per_camera(frames: DataFrame) -> DataFrame:
    """Files of each type for each camera."""
    return frames.where("camera_id is not null").groupBy("camera_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("filetype") == t).alias(f"n_{t}") for t in ("fits", "xisf", "raw")))


def orphans(frames: DataFrame, locations: DataFrame, key: Column) -> DataFrame:
    """Recipes that one frame alone has, and that frame in several present copies."""
    alone = frames.select("id", key.alias("profile_key")).where("profile_key is not null").groupBy("profile_key").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    several = locations.where("present = 1").groupBy(F.col("frame_id").alias("id")).agg(F.count("*").alias("copies")).where("copies > 1")
    return alone.join(several, "id").select("profile_key", "id", "copies")


def late_repairs(repairs: DataFrame, scans: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, applied_at): files whose last repair(path, applied_at) came after their scan(path, scanned_at), the newest first."""
    last = repairs.groupBy("path").agg(F.max("applied_at").alias("applied_at"))
    rows = last.join(scans.select("path", "scanned_at"), "path").where("applied_at > scanned_at").select("path", "applied_at").orderBy(F.desc("applied_at"), "path")
    return rows if limit is None else rows.limit(limit)


def acceptance(frames: DataFrame, events: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(gate, expected, actual, ok): cameras, kinds and verbs counted against what a delivery should hold."""
    ways = [
        frames.agg(F.count_distinct("camera_id").alias("actual")).select(F.lit("cameras").alias("gate"), "actual"),
        frames.groupBy("kind").agg(F.count("*").alias("actual")).select(F.concat(F.lit("kind:"), F.col("kind")).alias("gate"), "actual"),
        events.groupBy("verb").agg(F.count("*").alias("actual")).select(F.concat(F.lit("verb:"), F.col("verb")).alias("gate"), "actual"),
    ]
    actual = reduce(DataFrame.unionByName, ways)
    pairs = F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(n).cast("long").alias("expected")) for g, n in expected.items()))
    wanted = frames.sparkSession.range(1).select(F.explode(pairs).alias("g")).select("g.*")
    rows = wanted.join(actual, "gate", "left")
    return rows.select("gate", "expected", F.coalesce("actual", F.lit(0)).alias("actual"), (F.coalesce("actual", F.lit(0)) == F.col("expected")).alias("ok"))


def surplus(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, both ways at once."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r").select(key, F.when(F.col("l") == 1, "left only").otherwise("right only").alias("side"))


def frame_kind(filetype: Column, imagetyp: Column, path: Column, readable: Column) -> Column:
    """A frame's kind: of a raw file by its path, else by its header, unknown where that can't be read."""
    from skyledger.functions import resolve

    return F.when(filetype == "raw", resolve.kind_of_path(path)).when(~readable, "unknown").otherwise(resolve.kind(imagetyp))


def chosen_time(source: str, header: Column, name: Column, hours: int = 0) -> Column:
    """A frame's time from its header or its file's name, moved by whole hours; null where that source has none."""
    own = {"header": sky.header_time(header), "filename": sky.file_time(text.basename(name))}[source]
    return own + F.make_dt_interval(F.lit(0), F.lit(hours))


def modified(seconds: Column) -> Column:
    """Seconds of the epoch as an ISO time in UTC, with a fraction only where there is one."""
    micros = F.bround(seconds * 1e6).cast("bigint")
    utc = F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    plain, fraction = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(utc, ".SSSSSS")
    return F.concat(plain, F.when(F.pmod(micros, F.lit(1000000)) != 0, fraction).otherwise(""), F.lit("+00:00"))


def half_away(c: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("bigint")


def hours_text(seconds: Column) -> Column:
    return F.format_string("%.1f h", F.bround(seconds / 3600, 1))


def bytes_text(size: Column) -> Column:
    """A size with the unit that leaves less than 1024 of it."""
    out, power = F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B"))), 1
    for unit in ("KB", "MB", "GB", "TB"):
        own = F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))
        out = out.when(size < float(1024 ** (power + 1)), own) if unit != "TB" else out.otherwise(own)
        power += 1
    return out


def falsifiers(rows: DataFrame, key: str, seed: str, n: int = 5) -> DataFrame:
    """A sample of `n` rows to be checked by hand against their files, the same for the same seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).limit(n)
