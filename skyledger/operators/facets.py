"""Counts beside a selection: facets, coverage, exposure, pivot, grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import predicate

FACETS = {"object": "object_id", "filter": "filter_canon", "kind": "kind", "telescope": "telescope_canon_id", "night": "night"}


def counts(frames: DataFrame, facets: dict[str, str] = FACETS) -> DataFrame:
    """(facet, value, n) of every facet in one pass by grouping sets over the unpivoted columns."""
    pairs = [F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value")) for name, column in facets.items()]
    rows = frames.select(F.explode(F.array(*pairs)).alias("p")).select("p.facet", "p.value").where("value is not null")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def sibling_counts(frames: DataFrame, cards: DataFrame, state: dict, advanced: dict | None = None) -> DataFrame:
    """(facet, value, n) where each facet counts the frames that all other facets select."""
    trees = {f"_in_{name}": predicate.composed(predicate.sibling(state, name), advanced) for name in FACETS}
    rows = predicate.flagged(frames, cards, trees)
    pairs = [F.when(F.col(f"_in_{name}"), F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value"))) for name, column in FACETS.items()]
    rows = rows.select(F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull() & p["value"].isNotNull())).alias("p")).select("p.facet", "p.value")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def coverage(cards: DataFrame) -> DataFrame:
    """(keyword, n) of frames that have it; two steps, so one common keyword is no single group of rows."""
    return cards.select("keyword", "frame_id").distinct().groupBy("keyword").agg(F.count("*").alias("n"))


def exposure(frames: DataFrame) -> DataFrame:
    """Seconds and frames without exposure by object and filter, of light frames."""
    light = frames.where((F.col("kind") == "light") & F.col("object_id").isNotNull())
    return light.groupBy("object_id", "filter_canon").agg(F.round(F.sum("exptime"), 2).alias("secs"), F.count_if(F.col("exptime").isNull()).alias("n_null"))


def portfolio(exposures: DataFrame) -> DataFrame:
    """By object: all seconds, frames without exposure, and its filters by seconds."""
    item = F.struct(F.coalesce("secs", F.lit(0.0)).alias("secs"), F.coalesce("filter_canon", F.lit("-")).alias("filter"))
    ordered = F.array_sort(F.collect_list(item), lambda a, b: F.when(a["secs"] > b["secs"], -1).when(a["secs"] < b["secs"], 1).when(a["filter"] < b["filter"], -1).otherwise(1))
    out = exposures.groupBy("object_id").agg(F.round(F.sum(F.coalesce("secs", F.lit(0.0))), 2).alias("secs"), F.sum("n_null").alias("n_null"), ordered.alias("f"))
    return out.select("object_id", "secs", "n_null", F.array_join(F.transform("f", lambda x: x["filter"]), ",").alias("filters"))


def first_cards(cards: DataFrame) -> DataFrame:
    """The card of least occurrence for each frame and keyword, with partial aggregation."""
    own = F.min_by(F.struct("value_raw", "value_num"), "idx")
    return cards.groupBy("frame_id", "keyword").agg(own.alias("cell"))


def pivot(frames: DataFrame, cards: DataFrame, names: list[str]) -> DataFrame:
    """A row for each frame with (raw, num) columns of the named keywords; null and missing stay apart by `has_`."""
    # One shuffle: of each keyword the card of least occurrence, picked where the cards are.
    own = F.struct("value_raw", "value_num")
    picked = [F.min_by(own, F.when(F.col("keyword") == n, F.col("idx"))).alias(n) for n in names]
    cells = cards.where(F.col("keyword").isin(names)).groupBy(F.col("frame_id").alias("id")).agg(*picked)
    wide = frames.select("id").join(cells, "id", "left")
    return wide.select("id", *(c for n in names for c in (F.col(n).isNotNull().alias(f"has_{n}"), F.col(n)["value_raw"].alias(f"{n}_raw"), F.col(n)["value_num"].alias(f"{n}_num"))))


def base_rows(frames: DataFrame, locations: DataFrame, telescopes: DataFrame, objects: DataFrame) -> DataFrame:
    """The grid: a frame with names of its axes, its first copy and the number of present ones."""
    first = locations.groupBy(F.col("frame_id").alias("id")).agg(F.min_by("path", "id").alias("path"), F.min_by("volume", "id").alias("volume"), F.count_if(F.col("present") == 1).alias("n_present"))
    names = telescopes.select(F.col("id").alias("telescope_canon_id"), F.coalesce(F.nullif("label", F.lit("")), "telescop_canon").alias("telescope"))
    things = objects.select(F.col("id").alias("object_id"), F.col("canon").alias("object"))
    rows = frames.join(names, "telescope_canon_id", "left").join(things, "object_id", "left").join(first, "id", "left")
    return rows.select("id", "kind", "filter_canon", "exptime", "telescope", F.coalesce("object", "object_raw").alias("object"), "path", "volume", F.coalesce("n_present", F.lit(0)).alias("n_present"))


def group_headers(rows: DataFrame, label: Column, order: list[Column]) -> DataFrame:
    """Rows and a header row before each group, as (label, is_header, n, id); the least rows need no window."""
    named = rows.withColumn("label", F.coalesce(label, F.lit("(none)")))
    heads = named.groupBy("label").agg(F.count("*").alias("n")).select("label", F.lit(1).alias("is_header"), "n", F.lit(None).cast("long").alias("id"))
    return heads.unionByName(named.select("label", F.lit(0).alias("is_header"), F.lit(None).cast("long").alias("n"), "id")).orderBy(F.lower("label"), F.desc("is_header"), *order)


def time_differences(rows: DataFrame, one: Column, two: Column) -> DataFrame:
    """Median and spread of hours between two times, over rows that have both."""
    hours = (F.unix_micros(one.cast("timestamp")) - F.unix_micros(two.cast("timestamp"))) / 3.6e9
    found = rows.select(hours.alias("h")).where("h is not null")
    return found.agg(F.round(F.median("h"), 6).alias("median_h"), F.round(F.max("h") - F.min("h"), 6).alias("spread_h"), F.count("*").alias("n"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of every group; Spark limits each task's groups before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
