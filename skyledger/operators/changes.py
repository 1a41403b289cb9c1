"""State changes as differences: a new snapshot against an old one gives rows and events.

Nothing is updated in place. A change is what a comparison finds, so a second run over its own
result finds nothing and emits no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, change, before, after): added, removed and changed rows, with the facts that differ as JSON."""
    renamed = old.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in facts))
    both = renamed.join(new.select(key, *facts), F.col("_key") == F.col(key), "full_outer")
    differs = [~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in facts]
    change = F.when(F.col("_key").isNull(), "added").when(F.col(key).isNull(), "removed").when(F.greatest(*(d.cast("int") for d in differs)) == 1, "changed")
    shown = lambda prefix: F.to_json(F.struct(*(F.when(d, F.col(f"{prefix}{f}")).alias(f) for f, d in zip(facts, differs))))
    return both.select(F.coalesce(key, "_key").alias(key), change.alias("change"), shown("_").alias("before"), shown("").alias("after")).where("change is not null")


def events(changes: DataFrame, key: str, noun: str, actor: str, at: Column) -> DataFrame:
    """An event row for each change, to be appended with the snapshot."""
    verb = F.concat(F.lit(f"{noun}."), F.col("change"))
    payload = F.concat(F.lit('{"before":'), F.col("before"), F.lit(',"after":'), F.col("after"), F.lit("}"))
    return changes.select(at.alias("ts"), F.lit(actor).alias("actor"), verb.alias("verb"), F.concat(F.lit(f"{noun}:"), F.col(key).cast("string")).alias("target"), payload.alias("payload"))


def merges(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted merge (source, target) with why it is refused, null where it may go ahead."""
    known = entities.select("id", "merged_into")
    roots = entities.where("merged_into is not null").select(F.col("merged_into").alias("source"), F.lit(True).alias("has_members")).distinct()
    rows = wanted.join(known.select(F.col("id").alias("source"), F.col("merged_into").alias("source_into"), F.lit(True).alias("source_known")), "source", "left")
    rows = rows.join(known.select(F.col("id").alias("target"), F.col("merged_into").alias("target_into"), F.lit(True).alias("target_known")), "target", "left").join(roots, "source", "left")
    why = (
        F.when(F.col("source_known").isNull() | F.col("target_known").isNull(), "unknown").when(F.col("source") == F.col("target"), "same")
        .when(F.col("source_into").isNotNull(), "source is merged").when(F.col("target_into").isNotNull(), "target is merged").when(F.col("has_members"), "source has members")
    )
    return rows.select("source", "target", why.alias("refused"))


def cameras(rows: DataFrame) -> DataFrame:
    """A camera for each model: its first pixel size, and whether frames disagree on it."""
    return rows.groupBy("model_canon").agg(F.min_by("pixel_um", F.when(F.col("pixel_um").isNotNull(), F.col("id"))).alias("pixel_um"), (F.count_distinct("pixel_um") > 1).alias("pixel_conflict"), F.count("*").alias("n"))


def classified(records: DataFrame, frames: DataFrame, locations: DataFrame) -> DataFrame:
    """What becomes of each scanned record (volume, path, sha1_data, mtime): the ingest's action."""
    known = locations.select("volume", "path", F.col("frame_sha1").alias("old_sha1"), F.col("mtime").alias("old_mtime"), F.col("present").alias("was_present"))
    data = frames.select("sha1_data", F.lit(True).alias("frame_known")).distinct()
    rows = records.join(known, ["volume", "path"], "left")
    # Only places without a known content ask whether theirs is known.
    asks = F.col("error").isNull() & F.col("old_sha1").isNull()
    rows = rows.where(asks).join(data, "sha1_data", "left").unionByName(rows.where(~asks), allowMissingColumns=True)
    action = (
        F.when(F.col("error").isNotNull(), "unreadable").when(F.col("old_sha1").isNull() & F.col("frame_known").isNull(), "new frame").when(F.col("old_sha1").isNull(), "new copy")
        .when(F.col("old_sha1") != F.col("sha1_data"), "rebound").when((F.col("old_mtime") != F.col("mtime")) | (F.col("was_present") == 0), "refreshed").otherwise("unchanged")
    )
    return rows.select("volume", "path", action.alias("action"))


def to_scan(listing: DataFrame, locations: DataFrame) -> DataFrame:
    """Listed files that a re-scan must read: not known by (volume, path, mtime) as present and readable."""
    done = locations.where("present = 1 and unreadable_since is null").select("volume", "path", "mtime")
    return listing.join(done, ["volume", "path", "mtime"], "left_anti")


def to_backfill(locations: DataFrame, frames: DataFrame, filetype: str = "xisf") -> DataFrame:
    """Present copies of a file type whose header has never been read; empty once they have been."""
    kinds = frames.where(F.col("filetype") == filetype).select(F.col("id").alias("frame_id"))
    rows = locations.where("header_hash is null and present = 1").join(kinds, "frame_id", "left_semi")
    return rows.select("id", "volume", "path")


def missing(locations: DataFrame, listing: DataFrame, root: str, barriers: list[str] = ()) -> DataFrame:
    """Present copies under a root that a walk did not meet, and whether a barrier hides them."""
    under = lambda prefix: F.startswith(F.lower("path"), F.lit(prefix.lower().rstrip("/") + "/"))
    scoped = locations.where((F.col("present") == 1) & under(root))
    hidden: Column = F.lit(False)
    for barrier in barriers:
        hidden = hidden | under(barrier)
    return scoped.join(listing.select("path"), "path", "left_anti").withColumn("hidden", hidden)


LEAST_BRAKE, BRAKE_SHARE = 50, 0.02


def brake(scoped: int, walked: int, candidates: int) -> str | None:
    """Why a presence run must not mark copies as gone by itself, or None."""
    if not scoped:
        return "no copy in scope"
    if not walked:
        return "the walk met no file"
    if candidates > max(LEAST_BRAKE, int(BRAKE_SHARE * scoped)):
        return f"{candidates} of {scoped} copies would be gone"
    return None


def best_facts(facts: DataFrame) -> DataFrame:
    """(frame_id, key, value, source) of least rank: a user's word before a path's."""
    rank = F.when(F.col("source") == "user", 0).otherwise(1)
    return facts.groupBy("frame_id", "key").agg(F.min(F.struct(rank.alias("r"), "value", "source")).alias("b")).select("frame_id", "key", "b.value", "b.source")


def alias_conflicts(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted alias with what stands against it: empty, taken by another object, or nothing."""
    rows = wanted.join(aliases.select("alias_norm", F.col("canon").alias("taken")), "alias_norm", "left")
    why = F.when(F.coalesce(F.col("alias_norm"), F.lit("")) == "", "empty").when(F.col("taken") != F.col("canon"), "taken").when(F.col("taken") == F.col("canon"), "already there")
    return rows.select("alias_norm", "canon", why.alias("refused"))


def commit_status(staged: DataFrame, now: DataFrame) -> DataFrame:
    """Each staged edit against its copy as it is: skipped, blocked or to be applied. No file is written."""
    rows = staged.join(now.select("location_id", F.col("header_hash").alias("now_hash"), "present", "compressed"), "location_id", "left")
    status = F.when(F.coalesce("present", F.lit(0)) == 0, "skipped: not present").when(F.col("compressed") == 1, "skipped: compressed").when(~F.col("now_hash").eqNullSafe(F.col("header_hash")), "blocked: changed since").otherwise("apply")
    return rows.select("id", "location_id", status.alias("status"))
