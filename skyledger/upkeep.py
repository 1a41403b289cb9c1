"""What follows from headers, kept up in a store: telescopes, objects, sites, filters, recipes and lineage, run by run.

A run looks at the frames that events since the last one are about, so its work follows from what has
changed; that it has looked is part of what it publishes, by its number, which is that of the run it
becomes. A run that finds nothing to change publishes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import sky
from skyledger.operators import derive, dimensions, sites, verbs
from skyledger.storage import cut
from skyledger.store import Manifest, Store
from skyledger.streaming import ingest

NAME = "derive"
#: Columns of headers that the dimensions of a frame follow from.
TOLD = ("date_obs", "exptime", "filter_raw", "telescop", "focallen", "focratio_raw", "gain", "offset_adu", "set_temp", "xbinning", "ra_deg", "dec_deg", "object_raw", "lat_raw", "lon_raw")


def changed(events: DataFrame, locations: DataFrame) -> DataFrame:
    """(id) of frames whose header, copies or facts events are about; of a copy that was bound to another content, both."""
    copies = events.select(F.regexp_extract("target", r"^location:(\d+)$", 1).try_cast("long").alias("location_id"), F.get_json_object("payload", "$.before").try_cast("long").alias("before"), "verb").where("location_id is not null")
    now = locations.select(F.col("id").alias("location_id"), F.col("frame_id").alias("id"))
    bound = copies.where("verb = 'location.rebound' and before is not null").select(F.col("before").alias("id"))
    return dimensions.touched(events).union(copies.join(now, "location_id").select("id")).union(bound).distinct()


def _with_header(frames: DataFrame, headers: DataFrame, locations: DataFrame) -> DataFrame:
    """Frames with what their headers tell and the path of their first present copy."""
    path = locations.where("present = 1").groupBy(F.col("frame_id").alias("id")).agg(F.min_by("path", "id").alias("path"))
    told = headers.select(F.col("frame_id").alias("id"), *TOLD).withColumns({"focratio": F.col("focratio_raw").cast("string"), "gain": dimensions.FACTS["gain"][1](F.col("gain"))}).drop("focratio_raw")
    return frames.join(told, "id", "left").join(path, "id", "left")


def derived(store: Store, now: Column, regions: list[tuple[str, float, float, float]] = (), radius_km: float = sky.SITE_KM) -> Manifest | None:
    """Brings everything that follows from headers up to date with the store's last run, as one run of its own.

    Frames that events since the last such run are about are looked at, and those whose object is called
    by an alias that was given since; lineage is asked anew for all lights where one of them has changed.
    """
    base = store.manifest()
    table = store.table
    log, locations = table("event"), table("location")
    since = cut(log.where(F.col("run") > store.known(NAME)))
    ids = cut(changed(since, locations))
    keys = cut(since.where("verb = 'object.aliased'").select(F.get_json_object("payload", "$.alias_norm").alias("alias_norm")).where("alias_norm is not null").distinct())
    if ids.isEmpty() and keys.isEmpty():
        return None
    columns = table("frame").columns
    frames = cut(_with_header(table("frame"), table("header"), locations))
    named = dimensions.named(frames, table("object"), table("object_alias"), ids, keys, regions, log)
    frames = cut(named.frames)
    seen = sites.observed(frames.join(ids, "id", "left_semi").select("id", "lat_raw", "lon_raw", "observatory_id"), table("observatory"), radius_km)
    at = seen.frames.select("id", F.col("observatory_id").alias("_site"), F.lit(True).alias("_seen"))
    frames = frames.join(at, "id", "left").withColumn("observatory_id", F.when(F.col("_seen"), F.col("_site")).otherwise(F.col("observatory_id"))).drop("_site", "_seen")
    grouped = dimensions.grouped(cut(frames), table("telescope"), table("config"), ids, log)
    pairs = cut(grouped.tables["config"])
    frames = cut(dimensions.led(grouped.frames.drop("telescope_id"), pairs.select(F.col("id").alias("config_id"), "telescope_id"), ["config_id"]))
    again = cut(ids.union(dimensions.touched(named.events)).union(dimensions.touched(grouped.events)).distinct())
    recipes = dimensions.calibrated(frames, table("calibration_profile"), table("calibration_fact"), again, log)
    frames, facts = cut(recipes.frames), cut(recipes.tables["calibration_fact"])
    lineage = derive.lineage(dimensions.facts_of(frames.withColumn("date_ts", sky.header_time(F.col("date_obs"))), facts))
    links = verbs.linked(table("calibration_link"), cut(lineage.where("status = 'linked'").select("light_id", "relation", "master_id")))
    gaps = lineage.where("status <> 'linked'").groupBy(F.concat_ws(": ", "relation", "status").alias("raw")).agg(F.count("*").alias("n"))
    unlinked = dimensions.untold(verbs.review_summary(cut(gaps), "lineage", "lineage"), log.where("verb in ('lineage.review_summary', 'lineage.review_item')"))
    places = dimensions.untold(seen.events.where("verb in ('observatory.review_summary', 'observatory.review_item')"), log).unionByName(seen.events.where("verb not in ('observatory.review_summary', 'observatory.review_item')"))
    events = cut(reduce(DataFrame.unionByName, [named.events, places, grouped.events, recipes.events, links.events, unlinked]))
    replaced = {"frame": frames.select(columns), "observatory": seen.sites, "telescope": grouped.tables["telescope"], "config": pairs, "calibration_profile": recipes.tables["calibration_profile"], "calibration_fact": facts, "calibration_link": links.table} | named.tables
    return store.publish(NAME, base.number + 1, events, now, replaced, base=base)


def report(store: Store, after: int = 0) -> DataFrame:
    """(run, verb, n): what the runs after one have told."""
    return store.table("event").where(F.col("run") > after).groupBy("run", "verb").agg(F.count("*").alias("n"))


def accept(store: Store, scanned: DataFrame, name: str, number: int, now: Column, volume: str = "", regions: list[tuple[str, float, float, float]] = ()) -> DataFrame:
    """Header records brought into a store, all that follows from them derived, and the report of both runs."""
    before = store.manifest().number
    ingest.delivered(store, scanned, name, number, now, volume)
    derived(store, now, regions)
    return report(store, before)
