"""Derived dimensions as one difference: telescopes and their pairs with cameras, objects and filters, calibration recipes.

A run looks at the frames that a change has touched (`touched` tells them from its events), or at all;
what has to be known of a whole group, such as the first spelling of a new telescope, is read of the
groups of those frames only. It gives entities to keys that have none, moves pointers that differ from
what headers say now, takes away those that no longer follow from anything, and tells what can't be
derived. What the log has told last in the same words isn't told again, so a run over its own result
changes nothing and logs nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import resolve, text
from skyledger.operators import derive, verbs
from skyledger.storage import cut, many, numbered

#: Stored facts of a recipe by name, with the column of a frame that they stand for and its type.
FACTS = {"exptime": ("exptime", text.to_float), "set_temp_c": ("set_temp", text.to_int), "gain": ("gain", text.to_int), "offset_adu": ("offset_adu", text.to_int), "xbinning": ("xbinning", text.to_int), "telescope_id": ("telescope_id", text.to_int)}


#: How many ways rows of one key are dealt where they meet the entity of their key.
WAYS = 8


class Derived(NamedTuple):
    """Frames after a run, the tables of entities by name, and the events."""

    frames: DataFrame
    tables: dict[str, DataFrame]
    events: DataFrame


def touched(events: DataFrame) -> DataFrame:
    """(id) of the frames that events are about: those that the next run has to look at."""
    return events.select(F.regexp_extract("target", r"^frame:(\d+)$", 1).try_cast("long").alias("id")).where("id is not null").distinct()


def untold(events: DataFrame, log: DataFrame | None) -> DataFrame:
    """Events other than the last that the log has of their verb, target and reason."""
    if log is None:
        return events
    last = log.groupBy(F.col("verb").alias("_verb"), F.col("target").alias("_target"), F.col("reason").alias("_reason")).agg(F.max_by(F.struct("payload"), "id").alias("_last"))
    same = (F.col("verb") == F.col("_verb")) & F.col("target").eqNullSafe(F.col("_target")) & F.col("reason").eqNullSafe(F.col("_reason")) & F.col("payload").eqNullSafe(F.col("_last.payload"))
    return events.join(many(last), same, "left_anti")


def _looked_at(frames: DataFrame, ids: DataFrame | None) -> DataFrame:
    return frames if ids is None else frames.join(many(ids.select("id").distinct()), "id", "left_semi")


def led(rows: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the entity of their keys, one at most, or nulls; rows of one key, or of none, are dealt in several ways by id."""
    way = F.pmod(F.xxhash64("id"), F.lit(WAYS)).cast("int")
    there = entities.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    return rows.withColumn("_way", way).join(many(there), [*keys, "_way"], "left").drop("_way")


def _founded(entities: DataFrame, new: DataFrame, keys: list[str], noun: str, told: list[str], actor: str) -> verbs.Change:
    """Entities for rows of keys that have none, with ids that follow in the order of the keys."""
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(new, keys, top)
    kept = [c for c in entities.columns if c in added.columns]
    events = verbs._events(added, actor, f"{noun}.proposed", verbs._at(noun, "id"), None, F.to_json(F.struct(*told)))
    return verbs.Change(entities.unionByName(added.select(kept), allowMissingColumns=True), events)


def _pointed(frames: DataFrame, wanted: DataFrame, column: str, noun: str, shown: str, actor: str, both: bool) -> verbs.Change:
    """A pointer of frames as wanted(id, _new, _why); a null takes it away, and says why.

    With `both`, one that is moved is told as taken away and given, else as given only.
    """
    rows = frames.join(many(wanted.select("id", "_new", "_why", F.lit(True).alias("_asked"))), "id", "left")
    rows = rows.withColumn("_moved", F.coalesce("_asked", F.lit(False)) & ~F.col(column).eqNullSafe(F.col("_new")))
    gone = F.col(column).isNotNull() & (F.lit(both) | F.col("_new").isNull())
    step = lambda test, verb, value, why: F.when(test, F.struct(F.lit(f"{noun}.{verb}").alias("verb"), value.cast("long").alias("value"), why.cast("string").alias("why")))
    steps = F.array(step(gone, "unassigned", F.col(column), F.col("_why")), step(F.col("_new").isNotNull(), "assigned", F.col("_new"), F.lit(None)))
    told = rows.where("_moved").select("id", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    events = verbs._events(told, actor, F.col("s.verb"), verbs._at("frame", "id"), F.col("s.why"), F.to_json(F.struct(F.col("s.value").alias(shown))))
    return verbs.Change(rows.withColumn(column, F.when(F.col("_moved"), F.col("_new")).otherwise(F.col(column))).select(frames.columns), events)


def grouped(frames: DataFrame, telescopes: DataFrame, configs: DataFrame, ids: DataFrame | None = None, log: DataFrame | None = None, actor: str = "grouper") -> Derived:
    """frames(id, kind, camera_id, config_id, telescop, focallen, focratio) brought to telescopes(id, telescop_canon, f_ratio_nominal, focal_nominal, status) and configs(id, telescope_id, camera_id).

    A telescope is known by its name in any case; a new one has the first frame's spelling and the first
    focal length and ratio that any frame of its group gives. Darks and biases have no telescope. A frame
    whose kind, telescope or camera doesn't lead to a pair any more loses the one it had, and one that
    should have a pair and can't is told for review.
    """
    name = F.trim("telescop")
    on_axis = ~F.coalesce(F.col("kind").isin(*derive.NO_TELESCOPE), F.lit(False))
    keyed = frames.withColumn("_key", F.when(on_axis, F.nullif(text.ascii_lower(name), F.lit(""))))
    rows = cut(_looked_at(keyed, ids).select("id", "camera_id", "_key", on_axis.alias("_axis")))
    by_key = lambda t: t.groupBy(text.ascii_lower(F.col("telescop_canon")).alias("_key")).agg(F.min("id").alias("telescope_id"))
    new = rows.where("_key is not null").select("_key").distinct().join(by_key(telescopes), "_key", "left_anti")
    whole = derive.telescopes(keyed.join(cut(new), "_key", "left_semi"))
    whole = whole.select("key", "telescop_canon", F.col("f_ratio").alias("f_ratio_nominal"), F.bround("focal", 0).cast("long").alias("focal_nominal"), F.lit("proposed").alias("status"), F.col("members").alias("member_count"))
    made = _founded(telescopes, whole, ["key"], "telescope", ["telescop_canon", "f_ratio_nominal", "focal_nominal", "member_count"], actor)
    rows = cut(led(rows, by_key(made.table), ["_key"]))
    pairs = rows.where("telescope_id is not null and camera_id is not null").select("telescope_id", "camera_id").distinct()
    paired = _founded(configs, pairs.join(configs.select("telescope_id", "camera_id"), ["telescope_id", "camera_id"], "left_anti"), ["telescope_id", "camera_id"], "config", ["telescope_id", "camera_id"], actor)
    known = paired.table.groupBy("telescope_id", "camera_id").agg(F.min("id").alias("_new"))
    why = F.when(~F.col("_axis"), "kind without telescope").when(F.col("telescope_id").isNull(), "no telescope").when(F.col("camera_id").isNull(), "no camera")
    wanted = cut(led(rows, known, ["telescope_id", "camera_id"]).select("id", "_new", why.alias("_why"), "_axis"))
    given = _pointed(frames, wanted, "config_id", "config", "config_id", actor, False)
    review = verbs._events(wanted.where("_axis and _new is null"), actor, "config.review", verbs._at("frame", "id"), F.col("_why"))
    log = None if log is None else log.where("verb = 'config.review'")
    events = reduce(DataFrame.unionByName, [made.events, paired.events, given.events, untold(review, log)])
    return Derived(given.table, {"telescope": made.table, "config": paired.table}, events)


def named(frames: DataFrame, objects: DataFrame, aliases: DataFrame, ids: DataFrame | None = None, keys: DataFrame | None = None, regions: list[tuple[str, float, float, float]] = (), log: DataFrame | None = None, actor: str = "resolver") -> Derived:
    """frames(id, kind, object_id, object_source, object_raw, ra_deg, dec_deg, filter_raw, filter_canon) brought to objects(id, canon, catalog, kind) and aliases(alias_norm, object_id, source).

    Besides `ids`, frames whose object is called one of keys(alias_norm) are looked at, as aliases that
    were given since ask for. The ladder is that of `derive.resolved`, with aliases as they were before
    the run; what a user has assigned stays. A name that was found becomes an alias; one found by an alias
    or by its place doesn't. A frame that has an object keeps it where its header no longer leads to any.
    Filters are filled in where they differ. Names that stay open are told, each with the number of all
    frames that are open under it, if any frame looked at has it.
    """
    light = F.coalesce(F.col("kind").isin(*derive.LIGHT), F.lit(False))
    raw = text.to_text(F.col("object_raw"))
    rows = _looked_at(frames, ids)
    if ids is not None and keys is not None:
        called = frames.where(light).join(keys.select("alias_norm").distinct(), text.norm_alnum(F.col("object_raw")) == F.col("alias_norm"), "left_semi")
        rows = frames.join(many(rows.select("id").union(called.select("id")).distinct()), "id", "left_semi")
    rows = cut(rows.select("id", "kind", "object_source", "ra_deg", "dec_deg", "filter_raw", raw.alias("object_raw"), F.lit(None).cast("string").alias("user_canon")))
    by_name = aliases.join(objects.select(F.col("id").alias("object_id"), "canon"), "object_id").select("alias_norm", "canon")
    free = light & ~F.col("object_source").eqNullSafe("user")
    found = cut(derive.resolved(rows.where(free), by_name, regions).select("id", "object_raw", "found.canon", "found.source"))
    kinds = found.where("canon is not null").groupBy("canon").agg(F.min_by("source", "id").alias("_by"))
    body = F.when(F.col("_by").isin("solar", "comet", "region"), F.col("_by"))
    kind = F.when(F.col("_by") == "solar", "solar_system").otherwise(F.coalesce(body, F.lit("deep_sky")))
    new = kinds.join(objects.select("canon"), "canon", "left_anti").select("canon", F.coalesce(body, resolve.catalogue(F.col("canon"))).alias("catalog"), kind.alias("kind"))
    made = verbs.upserted(objects, new, "canon", "object", ["catalog", "kind"], actor=actor)
    at = made.table.groupBy("canon").agg(F.min("id").alias("object_id"))
    wanted = cut(found.join(at, "canon").select("id", "object_id", F.col("source").alias("object_source"), "object_raw"))
    spelled = wanted.where(~F.col("object_source").isin("alias", "region")).select(text.norm_alnum(F.col("object_raw")).alias("alias_norm"), "object_id", F.col("object_source").alias("source")).distinct()
    known = verbs.aliased(aliases, spelled, actor)
    given = verbs.assigned(frames, wanted, "object_id", "object", "object_source", actor)
    filled = verbs.backfilled(given.table, rows.select("id", resolve.filter_name(F.col("filter_raw")).alias("filter_canon")), "filter_canon", actor)
    still = filled.table.where(light & F.col("object_id").isNull()).select(raw.alias("raw")).where("raw is not null")
    if ids is not None:
        still = still.join(found.where("canon is null").select(F.col("object_raw").alias("raw")).distinct(), "raw", "left_semi")
    review = verbs.review_summary(cut(still.groupBy("raw").agg(F.count("*").alias("n"))), "object", actor)
    log = None if log is None else log.where("verb in ('object.review_summary', 'object.review_item')")
    events = reduce(DataFrame.unionByName, [made.events, known.events, given.events, filled.events, untold(review, log)])
    return Derived(filled.table, {"object": made.table, "object_alias": known.table}, events)


def facts_of(frames: DataFrame, facts: DataFrame) -> DataFrame:
    """`frames` with the facts of their recipes: what a user has said, else the header, else what is stored from a path.

    facts(frame_id, key, value, source) become a row a frame; a stored value that is no number counts as none.
    """
    rank = lambda key: F.when(F.col("key") == key, F.when(F.col("source") == "user", 2).otherwise(1))
    stored = facts.where(F.col("key").isin(*FACTS)).groupBy(F.col("frame_id").alias("_frame")).agg(*(F.max_by(F.struct("value", "source"), rank(k)).alias(f"_{k}") for k in FACTS))
    rows = frames.join(many(stored), F.col("id") == F.col("_frame"), "left")

    def best(key: str) -> Column:
        name, typed = FACTS[key]
        kept = typed(F.col(f"_{key}.value"))
        return F.when(F.col(f"_{key}.source") == "user", kept).otherwise(F.coalesce(F.col(name), kept))

    return rows.withColumns({FACTS[k][0]: best(k) for k in FACTS}).drop("_frame")


def calibrated(frames: DataFrame, profiles: DataFrame, facts: DataFrame, ids: DataFrame | None = None, log: DataFrame | None = None, actor: str = "calibration") -> Derived:
    """frames(id, kind, camera_id, telescope_id, filter_canon, exptime, set_temp, gain, offset_adu, xbinning, path, profile_id) brought to profiles(id, profile_key, recipe_class) and facts(frame_id, key, value, source).

    `path` is that of a frame's first present copy. Of darks and biases that lack facts those that the path
    tells, and that nobody has stored, are stored before the recipe is made, so a file that is renamed
    keeps its recipe. A frame whose facts are complete has the recipe of their key, and one that is given
    another is told as taken away and given; a frame that lacks facts, or is no calibration frame any more,
    loses its recipe. What is lacking is told by reason, with how many of the frames looked at lack it.
    """
    columns = ["id", "kind", "camera_id", "telescope_id", "filter_canon", "exptime", "set_temp", "gain", "offset_adu", "xbinning", "path"]
    looked = _looked_at(frames, ids).select(*columns, "profile_id").withColumn("_class", derive.recipe_class(F.col("kind")))
    mine = facts if ids is None else facts.join(many(ids.select(F.col("id").alias("frame_id")).distinct()), "frame_id", "left_semi")
    rows = cut(facts_of(looked.where("_class is not null"), mine))
    lacking = lambda: F.nullif(derive.missing_facts(F.col("_class")), F.lit(""))
    asked = rows.where(F.col("_class").isin("dark", "bias") & lacking().isNotNull()).withColumn("_path", derive.master_path(F.col("path")))
    told = [F.when(F.col(name).isNull() & F.col(f"_{key}").isNull() & F.col(f"_path.{name}").isNotNull(), F.struct(F.lit(key).alias("key"), F.col(f"_path.{name}").cast("string").alias("value"))) for key, name in (("gain", "gain"), ("offset_adu", "offset_adu"), ("set_temp_c", "set_temp"))]
    read = cut(asked.select(F.col("id").alias("frame_id"), F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("f")).select("frame_id", "f.key", "f.value", F.lit("path").alias("source")))
    recorded = verbs.facts_recorded(facts, read, actor)
    taken = read.groupBy(F.col("frame_id").alias("id")).agg(*(F.max(F.when(F.col("key") == key, F.col("value").cast("long"))).alias(f"_from_{name}") for key, name in (("gain", "gain"), ("offset_adu", "offset_adu"), ("set_temp_c", "set_temp"))))
    rows = rows.join(many(taken), "id", "left").withColumns({name: F.coalesce(name, f"_from_{name}") for name in ("gain", "offset_adu", "set_temp")})
    rows = cut(rows.select("id", "_class", F.when(lacking().isNull(), derive.profile_key(F.col("_class"))).alias("profile_key"), F.concat(F.col("_class"), F.lit(": lacks "), lacking()).alias("_why")))
    new = rows.where("profile_key is not null").groupBy("profile_key").agg(F.min("_class").alias("recipe_class")).join(many(profiles.select("profile_key")), "profile_key", "left_anti")
    made = _founded(profiles, new, ["profile_key"], "calibration_profile", ["profile_key", "recipe_class"], actor)
    known = made.table.groupBy("profile_key").agg(F.min("id").alias("_new"))
    wanted = led(rows, known, ["profile_key"]).select("id", "_new", "_why")
    stale = looked.where("_class is null and profile_id is not null").select("id", F.lit(None).cast("long").alias("_new"), F.lit("no calibration frame").alias("_why"))
    given = _pointed(frames, cut(wanted.unionByName(stale)), "profile_id", "calibration_profile", "profile_id", actor, True)
    items = rows.where("profile_key is null").groupBy(F.coalesce("_why", F.concat(F.col("_class"), F.lit(": lacks a fact"))).alias("raw")).agg(F.count("*").alias("n"))
    log = None if log is None else log.where("verb in ('calibration.review_summary', 'calibration.review_item')")
    review = untold(verbs.review_summary(cut(items), "calibration", actor), log)
    events = reduce(DataFrame.unionByName, [recorded.events, made.events, given.events, review])
    return Derived(given.table, {"calibration_profile": made.table, "calibration_fact": recorded.table}, events)
