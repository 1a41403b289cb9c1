"""File names and folder layouts from facts: plans only, no file is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import sky, text

DEFAULT = ("datetime", "object", "kind", "filter", "exp", "disc")
UNSET = "_UNSET"
LIGHT = ("light", "master_light")


def _token(spec) -> Column:
    token, args = (spec["t"], spec) if isinstance(spec, dict) else (spec, {})
    clean = lambda c: F.nullif(text.sanitize(c), F.lit(""))
    if token == "datetime":
        return F.date_format("ts", "yyyyMMdd_HHmmss")
    if token == "object":
        return F.when(F.col("kind").isin(*LIGHT), F.coalesce(clean(F.col("object")), clean(F.col("object_raw")), F.lit(UNSET)))
    if token == "kind":
        return F.coalesce(clean(F.col("kind")), F.lit("unknown"))
    if token == "filter":
        return clean(F.col("filter_canon"))
    if token == "exp":
        return sky.exposure_token(F.col("exptime"))
    if token == "disc":
        return F.substring("sha1_data", 1, 12)
    if token == "folder":
        return clean(text.folder(F.col("path"), args.get("n", 1)))
    if token == "orig":
        pattern, stem = args.get("re", ""), text.stem(F.col("path"))
        group = 1 if "(" in pattern.replace("(?", "").replace(r"\(", "") else 0
        return F.when(stem.rlike(pattern), clean(F.regexp_extract(stem, pattern, group))) if pattern else F.lit(None).cast("string")
    raise ValueError(f"no such token: {token}")


def composed(template=DEFAULT) -> Column:
    """The new name by a template: a list for all, or lists by file type, then kind, then `default`; null without a needed time."""
    if isinstance(template, dict):
        out = composed(template.get("default", DEFAULT))
        for column in ("kind", "filetype"):  # the last asked is the first to count
            for key, own in template.items():
                if key != "default":
                    out = F.when(F.col(column) == key, composed(own)).otherwise(out)
        return out
    name = F.concat(F.concat_ws("_", *map(_token, template)), text.extension(F.col("path")))
    return F.when(F.col("ts").isNotNull(), name) if "datetime" in template else name


def renames(rows: DataFrame, template=DEFAULT) -> DataFrame:
    """Each copy's new path and why it is skipped: no time, unchanged, or several copies want one path."""
    place = F.regexp_replace("path", r"[^\\/]*$", "")
    named = rows.select("id", "path", "volume", F.concat(place, composed(template)).alias("new_path"))
    # One shuffle by target; rows without a target would be one group, so each has a group of its own.
    alone = F.when(F.col("new_path").isNull(), F.col("id"))
    n = F.count("*").over(Window.partitionBy("volume", "new_path", alone))
    why = F.when(F.col("new_path").isNull(), "no time").when(F.col("new_path") == F.col("path"), "unchanged").when(n > 1, "collision")
    return named.select("id", "path", "new_path", why.alias("skipped"))


#: The names that saved layouts go by, and our own.
LAYOUTS = {"by-object": ("object", "filter"), "feed": ("object", "telescope", "filter"), "po-obiektach": ("object", "filter"), "wbpp-feed": ("object", "telescope", "filter")}


def projection(rows: DataFrame, layout: str) -> DataFrame:
    """(id, folder, file) of a materialised layout from frames with their first present copy."""
    columns = {"object": F.coalesce("object", "object_raw"), "telescope": F.coalesce("label", "telescop_canon"), "filter": F.col("filter_canon")}
    safe = lambda c: F.when(F.coalesce(text.sanitize(c), F.lit("")).isin("", ".", ".."), UNSET).otherwise(text.sanitize(c))
    segments = [safe(columns[name]) for name in LAYOUTS[layout]]
    return rows.select("id", F.when(F.col("path").isNotNull(), F.concat_ws("/", *segments)).alias("folder"), text.basename(F.col("path")).alias("file"), F.when(F.col("path").isNull(), "no present copy").alias("skipped"))


def apply_status(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Each planned file against what lies at its target: would link, exists, conflict or skipped."""
    there = existing.select("folder", "file", F.col("id").alias("_there"))
    rows = planned.join(there, ["folder", "file"], "left")
    status = F.when(F.col("skipped").isNotNull(), "skipped").when(F.col("_there").isNull(), "would-link").when(F.col("_there") == F.col("id"), "exists").otherwise("conflict")
    return rows.select("id", "folder", "file", status.alias("status"))


#: Names of working folders, one of which a projection's root must lie in.
WORKING = ("_wbpp", "_review")


def root_allowed(root: Column) -> Column:
    """Whether a projection may be laid out there: some folder of the path is a working one."""
    return F.exists(F.split(root, r"[\\/]+"), lambda part: F.lower(part).isin(*WORKING))


def manifest(status: DataFrame, layout: str, root: str, at: Column) -> DataFrame:
    """One row: a JSON text that says what a projection was made of, with the number of files by status."""
    counts = status.groupBy("status").agg(F.count("*").alias("n"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))
    segments = F.array(*map(F.lit, LAYOUTS[layout]))
    return whole.select(F.to_json(F.struct(F.lit(layout).alias("layout"), segments.alias("segments"), F.lit(root).alias("root"), at.alias("ts"), "n_items", "counts")).alias("manifest"))


def folder_histogram(planned: DataFrame, n: int) -> DataFrame:
    rows = planned.where("folder is not null").groupBy("folder").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "folder").limit(n)
