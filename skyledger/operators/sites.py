"""Observing sites found from places in headers, run by run, against the sites that are there.

A known site's place is frozen, so it takes the points in its reach first, whatever has become of its
name or what it was merged into; only what is left founds sites. Two deliveries in two runs so give
the sites that one pass over both in order of their frames would give.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import sky
from skyledger.operators import derive, verbs, views
from skyledger.storage import cut, numbered


class Observed(NamedTuple):
    """Sites and frames after a run, its events, and how many sites are new, frames assigned and places not readable."""

    sites: DataFrame
    frames: DataFrame
    events: DataFrame
    counts: DataFrame


def observed(frames: DataFrame, sites: DataFrame, radius_km: float = sky.SITE_KM, actor: str = "resolver") -> Observed:
    """frames(id, lat_raw, lon_raw, observatory_id) brought to sites(id, name, lat, lon, status, merged_into).

    A point goes to the nearest known site in reach, ties to the least id; of points out of reach of
    all the one of the least frame founds a site, with ids that follow, and each frame goes to the
    nearest site that was there when its turn came: known, or founded by a frame that isn't after it.
    A frame without a place keeps what it has and is silent; one whose place can't be read is told in a
    summary. Sites without a place take none.
    """
    placed = frames.select("id", sky.site(F.col("lat_raw"), F.col("lon_raw")).alias("p")).where("p is not null").select("id", "p.lat", "p.lon")
    placed = cut(placed)
    anchors = sites.where("lat is not null and lon is not null").select("id", "lat", "lon")
    once = cut(placed.groupBy("lat", "lon").agg(F.min("id").alias("id")))
    taken = derive.nearest_site(once, anchors, radius_km).select("id")
    seeds = cut(derive.site_seeds(once.join(taken, "id", "left_anti").select("id", "lat", "lon"), radius_km).select("id", "lat", "lon"))
    top = sites.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    founded = cut(numbered(seeds.withColumnRenamed("id", "founder"), ["founder"], top))
    # Known sites are there from the start; a founded one from its frame on.
    there = anchors.withColumn("since", F.lit(None).cast("long")).unionByName(founded.select("id", "lat", "lon", F.col("founder").cast("long").alias("since")))
    wanted = cut(derive.nearest_site(placed, there, radius_km, since=True)).select("id", F.col("site_id").alias("observatory_id"))
    given = verbs.assigned(frames, wanted, "observatory_id", "observatory", actor=actor)
    payload = F.to_json(F.struct("lat", "lon"))
    proposed = verbs._events(founded, actor, "observatory.proposed", verbs._at("observatory", "id"), None, payload)
    new = founded.select("id", "lat", "lon", F.lit("proposed").alias("status"))
    unread = cut(views.unparsable_sites(frames))
    shown = lambda c: F.coalesce(F.col(c), F.lit(""))
    review = verbs.review_summary(unread.select(F.concat(shown("lat_raw"), F.lit(", "), shown("lon_raw")).alias("raw"), "n"), "observatory", actor)
    counted = founded.agg(F.count("*").alias("new")).crossJoin(given.events.agg(F.count("*").alias("assigned"))).crossJoin(unread.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unreadable")))
    log = reduce(DataFrame.unionByName, [proposed, given.events, review])
    return Observed(sites.unionByName(new, allowMissingColumns=True).select(sites.columns), given.table, log, counted)
