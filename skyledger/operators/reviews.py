"""Queues and reports derived from state: duplicates, vanished, reviews, deltas, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIGHT = ("light", "master_light")


def duplicates(locations: DataFrame) -> DataFrame:
    """Frames with more than one present copy."""
    return locations.where("present = 1").groupBy("frame_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("frame_id").alias("id"), "n")


def vanished(locations: DataFrame) -> DataFrame:
    """Frames that have copies, none of them present."""
    return locations.groupBy("frame_id").agg(F.max("present").alias("p")).where("p = 0").select(F.col("frame_id").alias("id"))


def flags(frames: DataFrame, locations: DataFrame) -> DataFrame:
    """The review buckets of every frame, which may overlap."""
    copies = locations.groupBy(F.col("frame_id").alias("id")).agg(F.max("present").alias("any_present"), F.count("*").alias("n_copies"))
    light = F.col("kind").isin(*LIGHT)
    return frames.join(copies, "id", "left").select(
        "id",
        F.col("has_header").alias("_header"),
        (~F.col("has_header")).alias("no_header"),
        (F.col("has_header") & F.col("camera_id").isNull()).alias("no_camera"),
        (F.col("has_header") & F.col("telescope_id").isNull()).alias("no_telescope"),
        (light & F.col("object_id").isNull() & F.col("has_header")).alias("no_object"),
        F.col("n_copies").isNull().alias("no_copy"),
    )


def review_state(frames: DataFrame, locations: DataFrame) -> DataFrame:
    """One row: the size of each bucket, and of frames that are in any, in one pass."""
    names = ["no_header", "no_camera", "no_telescope", "no_object", "no_copy"]
    anywhere = F.greatest(*(F.col(n).cast("int") for n in names)) == 1
    return flags(frames, locations).agg(*(F.count_if(F.col(n)).alias(n) for n in names), F.count_if(anywhere).alias("total"))


def review_queue(frames: DataFrame) -> DataFrame:
    """Unresolved light frames by what their header calls the object."""
    rows = frames.where(F.col("kind").isin(*LIGHT) & F.col("object_id").isNull() & F.col("object_raw").isNotNull())
    return rows.groupBy("object_raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object_raw")


def delta_report(frames: DataFrame) -> DataFrame:
    """One row: light frames with and without an object, the share, and how many have a filter."""
    light = frames.where(F.col("kind").isin(*LIGHT))
    found = light.agg(F.count("object_id").alias("resolved"), F.count_if(F.col("object_id").isNull()).alias("unresolved"), F.count("filter_canon").alias("filters"))
    share = F.bround(100 * F.col("resolved") / F.nullif(F.col("resolved") + F.col("unresolved"), F.lit(0)), 1)
    return found.withColumn("pct", F.coalesce(share, F.lit(0.0)))


def tasks(frames: DataFrame, locations: DataFrame, events: DataFrame) -> DataFrame:
    """One row of counters, each a scalar aggregate over its own table."""
    one = frames.agg(F.count("*").alias("n_frames"), F.count_if(F.col("object_id").isNull()).alias("n_unresolved"))
    two = locations.agg(F.count_if(F.col("present") == 0).alias("n_gone"), F.count_distinct("volume").alias("n_volumes"))
    three = events.agg(F.count("*").alias("n_events"))
    return one.join(two, how="cross").join(three, how="cross")  # one row each


def copy_plan(locations: DataFrame, volume: str) -> DataFrame:
    """One row: bytes of each frame's first present copy, copies of no known size, and whether links suffice."""
    first = locations.where("present = 1").groupBy("frame_id").agg(F.min_by(F.struct("volume", "size_bytes"), "id").alias("c"))
    return first.agg(
        F.round(F.sum("c.size_bytes"), 2).alias("bytes"), F.count_if(F.col("c.size_bytes").isNull()).alias("n_unknown"), F.count_if(F.col("c.volume") != volume).alias("n_other_volume"),
        F.coalesce(F.bool_or(F.col("c.volume") != volume), F.lit(False)).alias("must_copy"),
    )


def audit(events: DataFrame, target: str | None, limit: int) -> DataFrame:
    """The newest events, of all or of one target."""
    rows = events if target is None else events.where(F.col("target") == target)
    return rows.orderBy(F.desc("id")).limit(limit)


def gates(actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(gate, expected, actual, ok) of a one-row table of numbers."""
    names = list(expected)
    pairs = F.array(*(F.struct(F.lit(n).alias("gate"), F.lit(expected[n]).cast("long").alias("expected"), F.col(n).cast("long").alias("actual")) for n in names))
    return actual.select(F.explode(pairs).alias("g")).select("g.*", (F.col("g.expected") == F.col("g.actual")).alias("ok"))


def violations(before: DataFrame, after: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Fingerprints that are gone or differ after a run that should change nothing."""
    new = after.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in facts))
    changed: Column = F.lit(False)
    for f in facts:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    joined = before.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(key, F.when(F.col("_key").isNull(), "gone").when(changed, "changed").alias("what")).where("what is not null")
