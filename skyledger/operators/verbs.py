"""Changes of state by verb: each gives the new snapshot and the events that go into the log with it.

A change is found by comparison, never by counting calls, so a run over its own result changes nothing
and logs nothing. What is refused has its reason in the outcome and leaves the snapshot as it was.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.storage import cut, many, numbered

EVENT = ("actor", "verb", "target", "reason", "payload")


class Change(NamedTuple):
    """The table as it is afterwards, the events, and (key, outcome) of what was asked for."""

    table: DataFrame
    events: DataFrame
    outcome: DataFrame | None = None


def _events(rows: DataFrame, actor: str, verb: Column | str, target: Column, reason: Column | None = None, payload: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    verb = F.lit(verb) if isinstance(verb, str) else verb
    return rows.select(F.lit(actor).alias("actor"), verb.alias("verb"), target.alias("target"), text(reason).alias("reason"), text(payload).alias("payload"))


def _at(noun: str, c: str | Column) -> Column:
    return F.concat(F.lit(f"{noun}:"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _before_after(before: Column, after: Column) -> Column:
    return F.to_json(F.struct(before.alias("before"), after.alias("after")), {"ignoreNullFields": "false"})


def unreadable(locations: DataFrame, failures: DataFrame, now: Column, actor: str = "scan") -> Change:
    """Copies that are there but could not be read, from failures(id, mtime, reason).

    The first failure sets the mark, a later one leaves it; a copy that was gone is back. A failure
    that changes nothing of a marked copy is quiet.
    """
    asked = failures.select("id", F.col("mtime").alias("_mtime"), F.col("reason").alias("_reason"), F.lit(True).alias("_asked"))
    rows = locations.join(asked, "id", "left")
    moved = F.coalesce("_asked", F.lit(False)) & ~(F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("unreadable_since").isNotNull() & (F.col("present") == 1))
    rows = rows.withColumn("_moved", moved)
    new = rows.withColumns({
        "mtime": F.when(F.col("_moved"), F.col("_mtime")).otherwise(F.col("mtime")), "present": F.when(F.col("_moved"), 1).otherwise(F.col("present")),
        "unreadable_since": F.when(F.col("_moved"), F.coalesce("unreadable_since", now)).otherwise(F.col("unreadable_since")),
    })
    events = _events(rows.where("_moved"), actor, "frame.review", _at("frame", "frame_id"), F.concat(F.lit("copy not readable: "), F.col("_reason")), F.to_json(F.struct("path")))
    return Change(new.select(locations.columns), events)


def vanished(locations: DataFrame, gone: DataFrame, run_id: str, forced: bool = False, actor: str = "presence") -> Change:
    """Copies whose file is gone, from gone(id, path): not present, no mark; a path that has changed since is left alone."""
    # Rows meet by path, and ids in that path's list: where copies are dealt by path, none is dealt again.
    asked = gone.where("path is not null").groupBy("path").agg(F.collect_set("id").alias("_ids"))
    rows = locations.join(asked, "path", "left").withColumn("_asked", F.coalesce(F.array_contains("_ids", F.col("id")), F.lit(False)))
    rows = rows.withColumn("_moved", F.coalesce(F.col("_asked") & (F.col("present") == 1), F.lit(False)))
    new = rows.withColumns({"present": F.when(F.col("_moved"), 0).otherwise(F.col("present")), "unreadable_since": F.when(~F.col("_moved"), F.col("unreadable_since"))})
    payload = F.to_json(F.struct("path", "volume", F.lit(run_id).alias("run_id"), F.col("unreadable_since").alias("unreadable_since_before"), F.lit(forced).alias("forced")), {"ignoreNullFields": "false"})
    met = cut(rows.where("_asked").select("id", F.when(F.col("_moved"), "vanished").otherwise("already gone").alias("outcome")))
    other = gone.where("path is not null").select("id").distinct().join(met, "id", "left_anti")
    strayed = locations.select("id", F.col("path").isNotNull().alias("_placed")).join(other, "id").select("id", F.when(F.col("_placed"), "drifted").otherwise("already gone").alias("outcome"))
    return Change(new.select(locations.columns), _events(rows.where("_moved"), actor, "location.vanished", _at("location", "id"), None, payload), met.unionByName(strayed))


def flagged(frames: DataFrame, flags: dict[str, tuple[Column, Column]], actor: str = "scan") -> DataFrame:
    """Events only: for each verb its predicate and reason, all over one pass of the frames."""
    each = F.array(*(F.when(test, F.struct(F.lit(verb).alias("verb"), reason.cast("string").alias("reason"))) for verb, (test, reason) in flags.items()))
    rows = frames.select("id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f"))
    return _events(rows, actor, F.col("f.verb"), _at("frame", "id"), F.col("f.reason"))


def headers_recorded(known: DataFrame, new: DataFrame, actor: str = "scan") -> Change:
    """Headers of frames that had none yet: one for each frame, an event each."""
    added = new.dropDuplicates(["frame_id"]).join(known.select("frame_id"), "frame_id", "left_anti")
    return Change(known.unionByName(added, allowMissingColumns=True), _events(added, actor, "header.recorded", _at("frame", "frame_id")))


def upserted(entities: DataFrame, wanted: DataFrame, key: str, noun: str, facts: list[str] = (), verb: str = "upserted", actor: str = "resolver") -> Change:
    """Entities of keys that are not there yet, with the ids that follow; known ones stay as they are.

    Ids follow the order of keys. Only new keys are numbered, a range of them in each task.
    """
    new = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(f).alias(f) for f in facts), F.count("*").alias("_n")).drop("_n").join(many(entities.select(key)), key, "left_anti")
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    named = numbered(new, [key], top)
    added = named.select("id", key, *facts)
    payload = F.to_json(F.struct(key, *facts))
    return Change(entities.unionByName(added, allowMissingColumns=True), _events(added, actor, f"{noun}.{verb}", _at(noun, "id"), None, payload))


def aliased(aliases: DataFrame, wanted: DataFrame, actor: str = "resolver") -> Change:
    """aliases(alias_norm, object_id, source): a known alias stays with its object; of new equal ones the least object has it."""
    new = wanted.where(F.coalesce("alias_norm", F.lit("")) != "").groupBy("alias_norm").agg(F.min(F.struct("object_id", "source")).alias("b")).select("alias_norm", "b.object_id", "b.source")
    added = new.join(aliases.select("alias_norm"), "alias_norm", "left_anti")
    return Change(aliases.unionByName(added), _events(added, actor, "object.aliased", _at("object", "object_id"), None, F.to_json(F.struct("alias_norm", "source"))))


def assigned(frames: DataFrame, wanted: DataFrame, column: str, verb: str, source: str | None = None, actor: str = "resolver") -> Change:
    """A pointer of frames, from wanted(id, `column`): an event where it differs from what is there; a null takes it away."""
    facts = [column, *([source] if source else [])]
    asked = wanted.select("id", *(F.col(f).alias(f"_{f}") for f in facts), F.lit(True).alias("_asked"))
    rows = frames.join(many(asked), "id", "left")
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    rows = rows.withColumn("_moved", F.coalesce("_asked", F.lit(False)) & ~same)
    new = rows.withColumns({f: F.when(F.col("_moved"), F.col(f"_{f}")).otherwise(F.col(f)) for f in facts})
    noun = F.when(F.col(f"_{column}").isNull(), F.lit(f"{verb}.unassigned")).otherwise(f"{verb}.assigned")
    return Change(new.select(frames.columns), _events(rows.where("_moved"), actor, noun, _at("frame", "id"), None, F.to_json(F.struct(*(F.col(f"_{f}").alias(f) for f in facts)))))


def backfilled(frames: DataFrame, wanted: DataFrame, column: str, actor: str = "resolver") -> Change:
    """A derived column where it differs, nulls in `wanted(id, column)` left out; one event with the number of rows, none for none."""
    asked = wanted.where(F.col(column).isNotNull()).select("id", F.col(column).alias("_new"))
    rows = frames.join(many(asked), "id", "left").withColumn("_moved", F.col("_new").isNotNull() & ~F.col(column).eqNullSafe(F.col("_new")))
    new = rows.withColumn(column, F.when(F.col("_moved"), F.col("_new")).otherwise(F.col(column)))
    count = rows.where("_moved").agg(F.count("*").alias("count")).where("count > 0")
    return Change(new.select(frames.columns), _events(count, actor, "filter.backfilled", F.lit("frame:*"), None, F.to_json(F.struct("count"))))


def review_summary(items: DataFrame, noun: str, actor: str = "resolver") -> DataFrame:
    """One event with how many raw values and frames are open, from items(raw, n), and one for each of them; none for none.

    Items are events of their own, as their number grows with the data.
    """
    whole = items.agg(F.count("*").alias("distinct"), F.sum("n").alias("frames")).where("distinct > 0")
    head = _events(whole, actor, f"{noun}.review_summary", F.lit("frame:*"), None, F.to_json(F.struct("distinct", "frames")))
    return head.unionByName(_events(items, actor, f"{noun}.review_item", F.lit("frame:*"), F.col("raw"), F.to_json(F.struct("n"))))


def labelled(entities: DataFrame, wanted: DataFrame, noun: str, column: str = "label", verb: str = "labeled", uid: str = "local") -> Change:
    """A user's names, from wanted(id, name): empty ones and unknown ids are refused, equal ones change nothing."""
    asked = wanted.select("id", F.trim("name").alias("_name"))
    known = asked.join(entities.select("id", F.col(column).alias("_before"), F.lit(True).alias("_known")), "id", "left")
    outcome = F.when(F.col("_known").isNull(), "refused: unknown").when(F.coalesce("_name", F.lit("")) == "", "refused: empty").when(F.col("_before").eqNullSafe(F.col("_name")), "no change").otherwise("applied")
    known = known.withColumn("outcome", outcome)
    done = known.where("outcome = 'applied'")
    new = entities.join(done.select("id", "_name"), "id", "left").withColumn(column, F.coalesce("_name", column)).select(entities.columns)
    return Change(new, _events(done, f"user:{uid}", f"{noun}.{verb}", _at(noun, "id"), None, _before_after(F.col("_before"), F.col("_name"))), known.select("id", "outcome"))


def approved(entities: DataFrame, wanted: DataFrame, noun: str = "telescope", uid: str = "local") -> Change:
    """Approval of canonical entities(id, status, merged_into) from wanted(id)."""
    known = wanted.select("id").distinct().join(entities.select("id", "status", "merged_into", F.lit(True).alias("_known")), "id", "left")
    outcome = F.when(F.col("_known").isNull(), "refused: unknown").when(F.col("merged_into").isNotNull(), "refused: merged").when(F.col("status") == "approved", "no change").otherwise("applied")
    known = known.withColumn("outcome", outcome)
    done = known.where("outcome = 'applied'")
    new = entities.join(done.select("id", F.lit("approved").alias("_new")), "id", "left").withColumn("status", F.coalesce("_new", "status")).select(entities.columns)
    return Change(new, _events(done, f"user:{uid}", f"{noun}.approved", _at(noun, "id"), None, _before_after(F.col("status"), F.lit("approved"))), known.select("id", "outcome"))


def merged(entities: DataFrame, checked: DataFrame, noun: str, uid: str = "local") -> Change:
    """Merges (source, target, refused) that a check of guards allowed; a source that is there already changes nothing.

    Of several merges of one source, or of merges that would meet in a chain, none is taken: sources
    must differ and no source be a target.
    """
    fine = checked.where("refused is null")
    targets = fine.select(F.col("target").alias("source"), F.lit(True).alias("_is_target")).distinct()
    counts = fine.groupBy("source").agg(F.count("*").alias("_times"))
    rows = checked.join(counts, "source", "left").join(targets, "source", "left").join(entities.select(F.col("id").alias("source"), F.col("merged_into").alias("_before")), "source", "left")
    outcome = F.when(F.col("_before") == F.col("target"), "no change").when(F.col("refused").isNotNull(), F.concat(F.lit("refused: "), F.col("refused"))).when((F.col("_times") > 1) | F.coalesce("_is_target", F.lit(False)), "refused: chain").otherwise("applied")
    rows = rows.withColumn("outcome", outcome)
    done = rows.where("outcome = 'applied'")
    new = entities.join(done.select(F.col("source").alias("id"), F.col("target").alias("_target")), "id", "left").withColumn("merged_into", F.coalesce("_target", "merged_into")).select(entities.columns)
    return Change(new, _events(done, f"user:{uid}", f"{noun}.merged", _at(noun, "source"), None, F.to_json(F.struct("source", "target"))), rows.select("source", "target", "outcome"))


def unmerged(entities: DataFrame, wanted: DataFrame, noun: str, uid: str = "local") -> Change:
    """Entities set free again, from wanted(id); canonical ones change nothing."""
    known = wanted.select("id").distinct().join(entities.select("id", F.col("merged_into").alias("_before"), F.lit(True).alias("_known")), "id", "left")
    known = known.withColumn("outcome", F.when(F.col("_known").isNull(), "refused: unknown").when(F.col("_before").isNull(), "no change").otherwise("applied"))
    done = known.where("outcome = 'applied'")
    new = entities.join(done.select("id", F.lit(True).alias("_free")), "id", "left").withColumn("merged_into", F.when(F.col("_free").isNull(), F.col("merged_into"))).select(entities.columns)
    return Change(new, _events(done, f"user:{uid}", f"{noun}.unmerged", _at(noun, "id"), None, _before_after(F.col("_before"), F.lit(None).cast("long"))), known.select("id", "outcome"))


def facts_recorded(facts: DataFrame, wanted: DataFrame, actor: str = "calibration") -> Change:
    """facts(frame_id, key, value, source): a user's word beats a path's; what is there already, or weaker, changes nothing."""
    rank = lambda c: F.when(F.col(c) == "user", 0).otherwise(1)
    best = wanted.groupBy("frame_id", "key").agg(F.min(F.struct(rank("source").alias("r"), "value", "source")).alias("b")).select("frame_id", "key", F.col("b.value").alias("_value"), F.col("b.source").alias("_source"))
    rows = facts.join(many(best), ["frame_id", "key"], "full_outer")
    moved = F.col("_source").isNotNull() & (F.col("source").isNull() | (rank("_source") <= rank("source"))) & ~(F.col("value").eqNullSafe(F.col("_value")) & F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_moved", moved)
    new = rows.select("frame_id", "key", F.when(F.col("_moved"), F.col("_value")).otherwise(F.col("value")).alias("value"), F.when(F.col("_moved"), F.col("_source")).otherwise(F.col("source")).alias("source"))
    payload = F.to_json(F.struct("key", F.col("_value").alias("value"), F.col("_source").alias("source")))
    return Change(new.select(facts.columns), _events(rows.where("_moved"), actor, "calibration.fact", _at("frame", "frame_id"), None, payload))


def linked(links: DataFrame, wanted: DataFrame, actor: str = "calibration") -> Change:
    """links(light_id, relation, master_id), one for each light and relation: a new master gives an unlinked and a linked event."""
    asked = wanted.select("light_id", "relation", F.col("master_id").alias("_new"))
    rows = links.join(many(asked), ["light_id", "relation"], "full_outer").withColumn("_moved", F.col("_new").isNotNull() & ~F.col("master_id").eqNullSafe(F.col("_new")))
    new = rows.select("light_id", "relation", F.when(F.col("_moved"), F.col("_new")).otherwise(F.col("master_id")).alias("master_id"))
    steps = F.array(F.when(F.col("master_id").isNotNull(), F.struct(F.lit("calibration.unlinked").alias("verb"), F.col("master_id").alias("m"))), F.struct(F.lit("calibration.linked").alias("verb"), F.col("_new").alias("m")))
    moved = rows.where("_moved").select("light_id", "relation", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    return Change(new, _events(moved, actor, F.col("s.verb"), _at("frame", "light_id"), None, F.to_json(F.struct("relation", F.col("s.m").alias("master_id")))))


def rename_outcome(staged: DataFrame, locations: DataFrame, back: bool = False) -> DataFrame:
    """Each staged rename(id, location_id, old_path, new_path, expected_mtime) against the copies as they are.

    Going back, a copy must stand at its new path and its old one be free. No file is touched.
    """
    now = locations.select(F.col("id").alias("location_id"), F.col("path").alias("_path"), F.col("volume").alias("_volume"), F.col("mtime").alias("_mtime"), F.col("present").alias("_present"))
    goal, start = ("old_path", "new_path") if back else ("new_path", "old_path")
    taken = locations.select(F.col("volume").alias("_volume"), F.col("path").alias(goal), F.col("id").alias("_other"))
    rows = staged.join(now, "location_id", "left")
    clash = rows.select("id", "location_id", "_volume", goal).join(taken, ["_volume", goal]).where("_other <> location_id").select("id").distinct().withColumn("_clash", F.lit(True))
    rows = rows.join(clash, "id", "left")
    moved = (F.col("_path") != F.col(start)) if back else (F.col("_path") != F.col(start)) | ~F.col("_mtime").eqNullSafe(F.col("expected_mtime"))
    outcome = F.when(F.col("_path").isNull(), "failed: no copy").when(~F.lit(back) & (F.col("_present") != 1), "skipped: not present").when(moved, "blocked: changed since").when(F.col("_clash"), "blocked: path is taken")
    return rows.select("id", "location_id", F.coalesce(outcome, F.lit("restore" if back else "apply")).alias("outcome"))


def relocated(locations: DataFrame, wanted: DataFrame, actor: str = "user:local") -> Change:
    """Paths of copies from wanted(id, new_path): one that another copy of the volume has, or that two ask for, is refused."""
    asked = wanted.join(locations.select("id", "volume", "path"), "id", "left")
    taken = locations.select("volume", F.col("path").alias("new_path"), F.col("id").alias("_other"))
    clash = asked.join(taken, ["volume", "new_path"]).where("_other <> id").select("id").distinct().withColumn("_clash", F.lit(True))
    asked = asked.withColumn("_twice", F.count("*").over(Window.partitionBy("volume", "new_path")) > 1).join(clash, "id", "left")
    outcome = F.when(F.col("path").isNull(), "refused: unknown").when(F.col("path") == F.col("new_path"), "no change").when(F.coalesce("_clash", F.lit(False)) | F.col("_twice"), "refused: path is taken").otherwise("applied")
    asked = asked.withColumn("outcome", outcome)
    done = asked.where("outcome = 'applied'")
    new = locations.join(done.select("id", F.col("new_path").alias("_new")), "id", "left").withColumn("path", F.coalesce("_new", "path")).select(locations.columns)
    return Change(new, _events(done, actor, "location.renamed", _at("location", "id"), None, _before_after(F.col("path"), F.col("new_path"))), asked.select("id", "outcome"))


def staged(pending: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """The staging table with a run's rows in place of those that the run had before, all pending."""
    return pending.where(F.col("run_id") != run_id).unionByName(rows.withColumns({"run_id": F.lit(run_id), "status": F.lit("pending")}).select(pending.columns))


def by_location(pending: DataFrame, run_id: str, newest_first: bool = False) -> DataFrame:
    """(location_id, first, edits) of a run's pending rows: edits of a copy in the order of their ids, or back.

    A copy has few edits in a run, so its list is bounded.
    """
    item = F.struct("id", "keyword", "new_value")
    edits = F.sort_array(F.collect_list(item), not newest_first)
    rows = pending.where((F.col("run_id") == run_id) & (F.col("status") == "pending"))
    return rows.groupBy("location_id").agg(F.min("id").alias("first"), F.array_join(F.transform(edits, lambda e: F.concat_ws("=", e["keyword"], e["new_value"])), ",").alias("edits"))


def folders_above(path: Column) -> Column:
    """All folders that a path lies in, from the root down, in lower case."""
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def behind(rows: DataFrame, barriers: DataFrame) -> DataFrame:
    """`rows(path)` that lie below one of `barriers(path)`, by equality of folders, so any number of barriers is one join."""
    shut = barriers.select(F.regexp_replace(F.lower("path"), "/+$", "").alias("_folder")).distinct()
    return rows.withColumn("_folder", F.explode(folders_above(F.col("path")))).join(shut, "_folder", "left_semi").select(rows.columns).distinct()


def presence(locations: DataFrame, listing: DataFrame, verdicts: DataFrame, volume: str, root: str, barriers: list[str] = ()) -> DataFrame:
    """(id, path, state) of every copy in scope: seen, hidden, gone, back or undecided.

    `verdicts(path, gone)` is what a look at each missing file gave: true, false or null.
    """
    inside = F.startswith(F.lower("path"), F.lit(root.lower().rstrip("/") + "/"))
    scoped = locations.where((F.col("present") == 1) & (F.col("volume") == volume) & inside).select("id", "path")
    seen = listing.select("path", F.lit(True).alias("_seen")).distinct()
    rows = scoped.join(seen, "path", "left")
    shut = behind(rows.where("_seen is null").select("id", "path"), locations.sparkSession.createDataFrame([(b,) for b in barriers], "path string"))
    rows = rows.join(shut.select("id", F.lit(True).alias("_hidden")), "id", "left").join(verdicts.select("path", F.col("gone").alias("_gone")), "path", "left")
    state = F.when(F.col("_seen"), "seen").when(F.col("_hidden"), "hidden").when(F.col("_gone"), "gone").when(~F.col("_gone"), "back").otherwise("undecided")
    return rows.select("id", "path", state.alias("state"))


def may_mark(counts: dict[str, int], walked: int, force: int | None = None) -> str | None:
    """Why a run with these numbers of states must not mark its gone copies, or None.

    `force` is the number of gone copies that a user expects; it lifts the brake, and must be met.
    """
    from skyledger.operators import changes

    candidates = sum(counts.get(s, 0) for s in ("gone", "back", "undecided"))
    brake = changes.brake(sum(counts.values()), walked, candidates)
    if brake and force is None:
        return brake
    gone = counts.get("gone", 0)
    return f"{gone} copies are gone, not {force}" if force is not None and gone != force else None


class Ingested(NamedTuple):
    """All tables after an ingest, its events, and what was read of known copies: `restated` has (frame_id, volume, path, before, after) of those whose header_hash is another.

    `looked` has (volume, path, sha1_data) of what could be read and is new or has another content: only there can new frames come from.
    """

    frames: DataFrame
    locations: DataFrame
    events: DataFrame
    restated: DataFrame | None = None
    looked: DataFrame | None = None


#: What is known of a copy's file, besides that it is there and can be read; those of them that a table has are compared.
COPY = ("mtime", "file_sha1", "header_hash", "hdu_index", "compressed", "size_bytes")


def ingested(records: DataFrame, frames: DataFrame, locations: DataFrame, now: Column, actor: str = "scan", keep: bool = True) -> Ingested:
    """Scanned records(volume, path, sha1_data, kind, filetype, error, and what is known of the file) brought into the tables.

    A frame is a content: new contents become frames, kind unknown where the file could not be read. A
    copy is a place: a new place is added, another content under a known one rebinds it, other facts
    refresh it (its event has each changed fact before and after), and a known place that can't be read
    keeps its frame and gets a mark. A place that repeats counts once, by its least content.

    Records and copies meet once, by place. Only rows that are new or have another content than their
    frame, whose content `locations` may have as `frame_sha1`, look frames up. What has met is stored, as all tables read
    it; with `keep` false each meets it anew, which costs less where both sides are stored dealt by place.
    """
    facts = [f for f in COPY if f in records.columns and f in locations.columns]
    once = records.groupBy("volume", "path").agg(F.min(F.struct("sha1_data", "kind", "filetype", *facts, "error")).alias("r"))
    once = once.select("volume", "path", F.col("r.sha1_data").alias("sha1_data"), F.col("r.kind").alias("_kind"), F.col("r.filetype").alias("_filetype"), F.col("r.error").alias("_error"), *(F.col(f"r.{f}").alias(f"_{f}") for f in facts), F.lit(True).alias("_asked"))
    held = locations
    if "frame_sha1" not in locations.columns:
        held = locations.join(many(frames.select(F.col("id").alias("frame_id"), F.col("sha1_data").alias("frame_sha1")).dropDuplicates(["frame_id"])), "frame_id", "left")
    rows = once.join(many(held.withColumn("_held", F.lit(True))), ["volume", "path"], "full_outer")
    rows = rows.withColumns({"_asked": F.coalesce("_asked", F.lit(False)), "_held": F.coalesce("_held", F.lit(False))})
    rows = rows.withColumn("_other", F.col("_asked") & (~F.col("_held") | (F.col("_error").isNull() & ~F.col("sha1_data").eqNullSafe(F.col("frame_sha1")))))
    rows = cut(rows) if keep else rows
    looking = cut(rows.where("_other"))
    seen = looking.select("sha1_data", F.when(F.col("_error").isNull(), F.col("_kind")).otherwise("unknown").alias("kind"), F.col("_filetype").alias("filetype"))
    # A scan that finds nothing new moves no frame.
    quiet = looking.isEmpty()
    observed = upserted(frames.where(F.lit(not quiet)), seen, "sha1_data", "frame", ["kind", "filetype"], "observed", actor)
    found = cut(looking.join(many(observed.table.select("sha1_data", F.col("id").alias("_new_frame"))), "sha1_data", "left"))
    # New places; those that lack a part equal no other in a join, so they are held against the copies by their text.
    fresh = found.where("not _held").withColumn("_place", F.concat_ws("\u0000", "volume", "path"))
    part = F.col("volume").isNull() | F.col("path").isNull()
    there = locations.where(part).select(F.concat_ws("\u0000", "volume", "path").alias("_place"))
    fresh = fresh.where(~part).unionByName(fresh.where(part).join(there, "_place", "left_anti").dropDuplicates(["_place"]))
    mark = F.when(F.col("_error").isNotNull(), now.cast("string"))
    top = locations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = fresh.select("_place", F.col("_new_frame").alias("frame_id"), "volume", "path", F.lit(1).alias("present"), *(F.col(f"_{f}").alias(f) for f in facts), mark.alias("unreadable_since"), F.col("_error").alias("error"), F.col("sha1_data").alias("frame_sha1"))
    added = numbered(fresh, ["_place"], top).drop("_place")
    old = rows.where("_held and not _other").withColumn("_new_frame", F.col("frame_id")).unionByName(found.where("_held"), allowMissingColumns=True)
    read = F.col("_asked") & F.col("_error").isNull()
    failed = F.col("_error").isNotNull()
    rebound = read & (F.col("_new_frame") != F.col("frame_id"))
    # What a copy that was read is after it, by fact.
    after = {f: F.col(f"_{f}").cast(locations.schema[f].dataType) for f in facts} | {"unreadable_since": F.lit(None).cast("string"), "present": F.lit(1)}
    differs = reduce(lambda a, b: a | b, (~F.col(f).eqNullSafe(new) for f, new in after.items()))
    failing = failed & ~(F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("unreadable_since").isNotNull() & (F.col("present") == 1))
    item = lambda f, new: F.when(~F.col(f).eqNullSafe(new), F.struct(F.lit(f).alias("key"), F.struct(F.col(f).cast("string").alias("before"), new.cast("string").alias("after")).alias("value")))
    changed = F.map_from_entries(F.filter(F.array(*(item(f, new) for f, new in after.items())), lambda x: x.isNotNull()))
    old = old.withColumns({"_rebound": F.coalesce(rebound, F.lit(False)), "_failing": F.coalesce(failing, F.lit(False))}).withColumn("_refreshed", read & ~F.col("_rebound") & differs)
    took = F.col("_rebound") | F.col("_refreshed")
    kept = {f: F.when(took, new).otherwise(F.col(f)) for f, new in after.items()} | {
        "unreadable_since": F.when(F.col("_failing"), F.coalesce("unreadable_since", now.cast("string"))).when(~took, F.col("unreadable_since")),
        "present": F.when(took | F.col("_failing"), 1).otherwise(F.col("present")), "mtime": F.when(took | F.col("_failing"), F.col("_mtime")).otherwise(F.col("mtime")),
    }
    kept |= {"frame_sha1": F.when(F.col("_rebound"), F.col("sha1_data")).otherwise(F.col("frame_sha1"))}
    new = old.withColumns({"_before": F.col("frame_id"), "_changed": F.when(F.col("_refreshed"), F.to_json(changed, {"ignoreNullFields": "false"})), "frame_id": F.when(F.col("_rebound"), F.col("_new_frame")).otherwise(F.col("frame_id")), **kept})
    gained = added.drop("error")
    for c in locations.columns:
        if c not in gained.columns:
            gained = gained.withColumn(c, F.lit(None).cast(locations.schema[c].dataType))
    table = new.select(locations.columns).unionByName(gained.select(locations.columns))
    # One event of a copy that was there, all kinds in one pass.
    verb = F.when(F.col("_rebound"), "location.rebound").when(F.col("_refreshed"), "location.refreshed").otherwise("frame.review")
    payload = F.when(F.col("_rebound"), _before_after(F.col("_before"), F.col("frame_id"))).otherwise(F.col("_changed"))
    target = F.when(F.col("_failing"), _at("frame", "frame_id")).otherwise(_at("location", "id"))
    reason = F.when(F.col("_failing"), F.concat(F.lit("copy not readable: "), F.col("_error")))
    log = [
        observed.events, _events(added, actor, "location.added", _at("location", "id"), None, F.to_json(F.struct("frame_id", "volume", "path"))),
        _events(new.where(took | F.col("_failing")), actor, verb, target, reason, payload),
        _events(added.where("error is not null"), actor, "frame.review", _at("frame", "frame_id"), F.concat(F.lit("header not readable: "), F.col("error"))),
    ]
    hashes = "header_hash" in facts
    restated = old.where("_refreshed").where(~F.col("header_hash").eqNullSafe(F.col("_header_hash"))).select("frame_id", "volume", "path", F.col("header_hash").alias("before"), F.col("_header_hash").alias("after")) if hashes else None
    return Ingested(frames if quiet else observed.table, table, reduce(DataFrame.unionByName, log), restated, looking.where("_error is null").select("volume", "path", "sha1_data"))


def committed(outcome: DataFrame, headers: DataFrame, commit_id: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(commit_id, at, n_applied, n_blocked, n_skipped) in one row, and the header that each applied copy had, for an undo."""
    head = lambda word: F.count_if(F.startswith("outcome", F.lit(word)))
    commit = outcome.agg(head("appl").alias("n_applied"), head("blocked").alias("n_blocked"), head("skipped").alias("n_skipped")).select(F.lit(commit_id).alias("commit_id"), at.alias("at"), "n_applied", "n_blocked", "n_skipped")
    backups = headers.join(outcome.where(F.startswith("outcome", F.lit("appl"))).select("location_id"), "location_id", "left_semi").select(F.lit(commit_id).alias("commit_id"), "location_id", "header_text", "header_hash")
    return commit, backups
