"""Staged header edits folded into final headers, committed and undone by one comparison of hashes.

Cards are those of copies: cards(location_id, keyword, idx, value_raw, value_type, comment). The edits
of a copy go in together or not at all. What is compared is the hash of a copy's cards: with the one
an edit was staged on, and for an undo with the one that the commit left. So a header that something
else has changed since is blocked either way, commits are undone newest first, and a second undo is
blocked by itself. No file is written here; a writer takes the final cards.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from skyledger import storage
from skyledger.operators import verbs
from skyledger.storage import many

CARD = ("keyword", "idx", "value_raw", "value_type", "comment")


class Commit(NamedTuple):
    """All cards and the staging table afterwards, what became of each copy, the commit's row (none where nothing was applied), what an undo needs, and the events."""

    cards: DataFrame
    staged: DataFrame
    outcome: DataFrame
    commit: DataFrame
    backups: DataFrame
    events: DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """Rows of copies stored dealt by copy: with cards and copies that are stored like that they meet without being dealt again."""
    return storage.dealt(rows, "location_id")


def header_of(cards: DataFrame) -> DataFrame:
    """(location_id, header, header_hash): a copy's cards in order and their hash. A header is a bounded list."""
    grouped = cards.groupBy("location_id").agg(F.sort_array(F.collect_list(F.struct(*CARD))).alias("header"))
    return grouped.withColumn("header_hash", hashed(F.col("header")))


def hashed(header: Column) -> Column:
    """The hash of a list of cards in order."""
    return F.sha1(F.to_json(header, {"ignoreNullFields": "false"}))


def _folded(header: Column, edits: Column, kind: DataType) -> tuple[Column, Column]:
    """A copy's header after its edits, and why they can't be made: edits of a card, in the order of their ids, are one.

    `set` needs a card, `add` none; after an `add` the card is there for those that follow. A header and
    the edits of a copy are bounded lists, so all happens in the copy's row.
    """
    key = lambda c: F.struct(c["keyword"].alias("keyword"), c["idx"].alias("idx"))
    of = lambda c: F.filter(edits, lambda e: (e["keyword"] == c["keyword"]) & (e["idx"] == c["idx"]))
    cards = F.arrays_zip(header["keyword"].alias("keyword"), header["idx"].alias("idx"))
    there = lambda k: k["keyword"].isNotNull() & k["idx"].isNotNull() & F.array_contains(cards, k)
    keys = F.array_distinct(F.transform(edits, key))
    own = F.transform(keys, lambda k: F.struct(k.alias("k"), F.filter(edits, lambda e: e["keyword"].eqNullSafe(k["keyword"]) & e["idx"].eqNullSafe(k["idx"])).alias("edits"), there(k).alias("there")))

    def wrong(x: Column) -> Column:
        adds, others = F.size(F.filter(x["edits"], lambda e: e["op"] == "add")), F.exists(x["edits"], lambda e: F.coalesce(~e["op"].isin("set", "add"), F.lit(True)))
        return (
            F.when(others, "unknown operation").when(~x["there"] & (x["edits"][0]["op"] == "set"), "no such card").when(adds > F.when(x["there"], 0).otherwise(1), "the card is there")
        )

    def changed(c: Column) -> Column:
        h, last = c["h"], c["last"]
        # A comment that an edit doesn't give stays.
        return F.when(last.isNotNull(), F.struct(h["keyword"], h["idx"], last["new_value"], F.coalesce(last["new_type"], h["value_type"]), F.coalesce(last["new_comment"], h["comment"])).cast(kind.elementType)).otherwise(h)

    def added(x: Column) -> Column:
        last = F.element_at(x["edits"], -1)
        return F.struct(x["k"]["keyword"], x["k"]["idx"], last["new_value"], last["new_type"], last["new_comment"]).cast(kind.elementType)

    # A card's last edit is looked for once, though several of its fields are read.
    last = F.transform(header, lambda h: F.struct(h.alias("h"), F.try_element_at(of(h), F.lit(-1)).alias("last")))
    new = F.concat(F.transform(last, changed), F.transform(F.filter(own, lambda x: ~x["there"]), added))
    return F.sort_array(new), F.array_min(F.filter(F.transform(own, wrong), lambda w: w.isNotNull()))


def committed(staged: DataFrame, cards: DataFrame, locations: DataFrame, run_id: str, commit_id: str, at: Column, actor: str = "user:local", headers: DataFrame | None = None) -> Commit:
    """A run's pending edits, staged(id, run_id, location_id, keyword, idx, op, new_value, new_type, new_comment, expected_hash, status, reason).

    locations(id, frame_id, present, compressed). A copy is skipped if it isn't there or is compressed,
    blocked if its header isn't the one that its first edit was staged on, and fails if it isn't known
    or an edit can't be made. Of those, none of its cards changes. Other runs' rows stay as they are.
    `headers` is the stored `header_of` the cards, where an edit's staging has asked for it already.
    """
    mine = (F.col("run_id") == run_id) & (F.col("status") == "pending")
    step = F.struct("id", "keyword", "idx", "op", "new_value", "new_type", "new_comment")
    copies = staged.where(mine).groupBy("location_id").agg(F.sort_array(F.collect_list(step)).alias("edits"), F.min(F.struct("id", "expected_hash")).alias("f"))
    copies = copies.select("location_id", "edits", "f.expected_hash")
    # With the cards' headers at hand they are read once.
    copies = cut(copies) if headers is None else copies
    known = locations.select(F.col("id").alias("location_id"), "frame_id", "present", "compressed")
    before = header_of(cards.join(many(copies.select("location_id")), "location_id", "left_semi")) if headers is None else headers
    kind = before.schema["header"].dataType
    rows = copies.join(many(known), "location_id", "left").join(many(before), "location_id", "left")
    new, wrong = _folded(F.coalesce("header", F.array().cast(kind)), F.col("edits"), kind)
    status = (
        F.when(F.col("present").isNull(), "failed: no copy").when(F.col("present") == 0, "skipped: not present").when(F.col("compressed") == 1, "skipped: compressed")
        .when(~F.col("header_hash").eqNullSafe(F.col("expected_hash")), "blocked: changed since").otherwise(F.coalesce(F.concat(F.lit("failed: "), wrong), F.lit("applied")))
    )
    applied = F.col("status") == "applied"
    rows = rows.withColumn("status", status).select("location_id", "frame_id", "status", F.when(applied, F.col("header")).alias("header"), "header_hash", F.when(applied, new).alias("new"))
    rows = cut(rows.withColumn("post_hash", F.when(applied, hashed(F.col("new")))))
    outcome = rows.select("location_id", "status")
    done = rows.where(applied)
    backups = done.select(F.lit(commit_id).alias("commit_id"), "location_id", "header", "header_hash", "post_hash")
    head = lambda word: F.count_if(F.startswith("status", F.lit(word))).alias(f"n_{word}")
    words = ("applied", "blocked", "failed", "skipped")
    commit = outcome.agg(*map(head, words)).where("n_applied > 0").select(F.lit(commit_id).alias("commit_id"), F.lit(run_id).alias("run_id"), at.alias("at"), *(f"n_{w}" for w in words))
    hashes = F.to_json(F.struct(F.col("header_hash").alias("header_hash_before"), F.col("post_hash").alias("header_hash_after")), {"ignoreNullFields": "false"})
    events = verbs._events(done.where(~F.col("header_hash").eqNullSafe(F.col("post_hash"))), actor, "header.refreshed", verbs._at("frame", "frame_id"), None, hashes)
    rest = cards.join(many(done.select("location_id")), "location_id", "left_anti")
    told = outcome.select("location_id", F.split("status", ": ", 2).alias("_s"))
    log = staged.join(many(told), "location_id", "left").withColumns({"status": F.when(mine, F.col("_s")[0]).otherwise(F.col("status")), "reason": F.when(mine, F.get("_s", F.lit(1))).otherwise(F.col("reason"))})
    return Commit(rest.unionByName(done.select("location_id", F.inline("new")), allowMissingColumns=True).select(cards.columns), log.select(staged.columns), outcome, commit, backups, events)


class Undo(NamedTuple):
    """All cards afterwards, what became of each copy, and the events."""

    cards: DataFrame
    outcome: DataFrame
    events: DataFrame


def undone(backups: DataFrame, commit_id: str, cards: DataFrame, locations: DataFrame, actor: str = "user:local") -> Undo:
    """A commit's headers as they were before it, where the copy's header is still the one that it left; cards that it added go."""
    own = backups.where(F.col("commit_id") == commit_id)
    now = header_of(cards.join(many(own.select("location_id")), "location_id", "left_semi")).select("location_id", F.col("header_hash").alias("now_hash"))
    known = locations.select(F.col("id").alias("location_id"), "frame_id", F.lit(True).alias("known"))
    rows = own.join(many(known), "location_id", "left").join(many(now), "location_id", "left")
    status = F.when(F.col("known").isNull(), "failed: no copy").when(~F.col("now_hash").eqNullSafe(F.col("post_hash")), "blocked: changed since").otherwise("restored")
    # Headers are in the backups; of what has met, only what became of each copy is stored.
    rows = cut(rows.select("location_id", "frame_id", "header_hash", "now_hash", status.alias("status")))
    done = rows.where("status = 'restored'")
    back = own.join(many(done.select("location_id")), "location_id", "left_semi").select("location_id", F.inline("header"))
    rest = cards.join(many(done.select("location_id")), "location_id", "left_anti")
    hashes = F.to_json(F.struct(F.col("now_hash").alias("header_hash_before"), F.col("header_hash").alias("header_hash_after")), {"ignoreNullFields": "false"})
    events = verbs._events(done.where(~F.col("now_hash").eqNullSafe(F.col("header_hash"))), actor, "header.refreshed", verbs._at("frame", "frame_id"), None, hashes)
    return Undo(rest.unionByName(back, allowMissingColumns=True).select(cards.columns), rows.select("location_id", "status"), events)
