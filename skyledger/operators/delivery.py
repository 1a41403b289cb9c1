"""A delivery of scanned files as one change over all tables that a header reaches.

What a copy says of itself leads on: new contents bring their header, cards and camera; another
header_hash of a known copy replaces header and cards of its frame, whose camera and kind are derived
anew; a camera's pixel size is filled in where it is not known, and a difference is marked once. Every
step is a comparison with the tables as they are, so a delivery that is made again changes nothing.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import verbs
from skyledger.storage import cut

#: What a header gives, besides its hash: typed columns of the `header` table.
TYPED = ("date_obs", "exptime", "filter_raw", "instrume", "telescop", "xpixsz", "gain", "object_raw", "focallen", "focratio_raw", "offset_adu", "set_temp", "xbinning", "ra_deg", "dec_deg", "lat_raw", "lon_raw")


class Delivered:
    """All tables after a delivery, and its events, each found when it is first asked for. `rewritten` tells whether a header or card that was there has changed."""

    TABLES = ("frames", "locations", "headers", "cards", "cameras")

    def __init__(self, records: DataFrame, frames: DataFrame, locations: DataFrame, headers: DataFrame, cards: DataFrame, cameras: DataFrame, now: Column, actor: str, keep: bool):
        self._records, self._tables, self._now, self._actor, self._keep = records, (frames, locations, headers, cards, cameras), now, actor, keep

    def __getitem__(self, which: slice | int):
        """The tables by their place in TABLES."""
        names = self.TABLES[which]
        return getattr(self, names) if isinstance(which, int) else tuple(getattr(self, name) for name in names)

    @cached_property
    def _read(self) -> DataFrame:
        return self._records.where("error is null")

    @property
    def _typed(self) -> list[str]:
        return [c for c in TYPED if c in self._records.columns]

    @cached_property
    def _found(self) -> verbs.Ingested:
        return verbs.ingested(self._records, self._tables[0], self._tables[1], self._now, self._actor, self._keep)

    @cached_property
    def _seen(self) -> verbs.Change:
        size = F.col("xpixsz") if "xpixsz" in self._typed else F.lit(None).cast("double")
        return cameras_seen(self._tables[4], self._read.select("model_canon", size.alias("pixel_um"), F.struct("volume", "path").alias("place")), self._actor)

    @cached_property
    def _stated(self) -> DataFrame:
        """What is said anew: of each frame the copy that counts, with what its header says."""
        top = self._tables[0].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = self._found.frames.where(F.col("id") > top).select(F.col("id").alias("frame_id"), "sha1_data")
        first = self._found.looked.select("sha1_data", F.struct("volume", "path").alias("_place")).join(new, "sha1_data").groupBy("frame_id").agg(F.min("_place").alias("p")).select("frame_id", "p.*", F.lit(None).cast("string").alias("before"), F.lit(True).alias("new"))
        last = self._found.restated.withColumn("_place", F.struct("volume", "path", "before")).groupBy("frame_id").agg(F.max("_place").alias("p")).select("frame_id", "p.*", F.lit(False).alias("new"))
        told = self._read.dropDuplicates(["volume", "path"]).select("volume", "path", "header_hash", "cards", "model_canon", "kind", "kind_source", *self._typed)
        return cut(first.unionByName(last).join(told, ["volume", "path"]))

    @cached_property
    def _rows(self) -> DataFrame:
        """Frames with what is derived anew of those that a header speaks of."""
        ids = self._seen.table.select("model_canon", F.col("id").alias("_camera"))
        derived = self._stated.join(ids, "model_canon", "left").select(F.col("frame_id").alias("id"), "new", "_camera", F.col("kind").alias("_kind"), F.col("kind_source").alias("_source"))
        rows = self._found.frames.join(derived, "id", "left")
        before, after = F.struct("camera_id", "kind"), F.struct(F.col("_camera").alias("camera_id"), F.col("_kind").alias("kind"))
        moved = F.coalesce(~F.col("new"), F.lit(False)) & ~(F.col("camera_id").eqNullSafe(F.col("_camera")) & F.col("kind").eqNullSafe(F.col("_kind")))
        return cut(rows.withColumns({"_stated": F.col("new").isNotNull(), "_moved": moved, "_payload": F.to_json(F.struct(before.alias("before"), after.alias("after")), {"ignoreNullFields": "false"})}))

    @cached_property
    def rewritten(self) -> bool:
        return not self._stated.where("not new").isEmpty()

    @cached_property
    def frames(self) -> DataFrame:
        frames = self._tables[0]
        take = {"camera_id": F.col("_camera"), "kind": F.col("_kind"), "kind_source": F.col("_source")}
        return self._rows.withColumns({c: F.when(F.col("_stated"), v).otherwise(F.col(c)) for c, v in take.items() if c in frames.columns}).select(frames.columns)

    @property
    def locations(self) -> DataFrame:
        return self._found.locations

    @cached_property
    def headers(self) -> DataFrame:
        headers, own = self._tables[2], self._stated.select("frame_id", "header_hash", *self._typed)
        return headers.join(self._stated.select("frame_id"), "frame_id", "left_anti").unionByName(own, allowMissingColumns=True).select(headers.columns)

    @cached_property
    def cards(self) -> DataFrame:
        cards, mirrored = self._tables[3], self._stated.select("frame_id", F.inline("cards"))
        return cards.join(self._stated.select("frame_id"), "frame_id", "left_anti").unionByName(mirrored, allowMissingColumns=True).select(cards.columns)

    @property
    def cameras(self) -> DataFrame:
        return self._seen.table

    @property
    def camera_events(self) -> DataFrame:
        return self._seen.events

    @cached_property
    def events(self) -> DataFrame:
        hashes = F.to_json(F.struct(F.col("before").alias("header_hash_before"), F.col("header_hash").alias("header_hash_after")), {"ignoreNullFields": "false"})
        log = [
            self._found.events, self._seen.events, verbs._events(self._stated.where("not new"), self._actor, "header.refreshed", verbs._at("frame", "frame_id"), None, hashes),
            verbs._events(self._rows.where("_moved"), self._actor, "frame.rederived", verbs._at("frame", "id"), None, F.col("_payload")),
        ]
        return reduce(DataFrame.unionByName, log)


def cameras_seen(cameras: DataFrame, seen: DataFrame, actor: str = "scan") -> verbs.Change:
    """cameras(id, model_canon, pixel_um, pixel_conflict) after seen(model_canon, pixel_um, place), in order of place.

    A model is new with the pixel size that it comes with first, known or not. A size that isn't known
    is set by the first that is; another one than that marks a conflict, once, for a person to settle.
    """
    sizes = cut(seen.where("model_canon is not null").groupBy("model_canon", "pixel_um").agg(F.min("place").alias("place")))
    firsts = sizes.groupBy("model_canon").agg(F.min_by("pixel_um", "place").alias("_came"), F.min_by("pixel_um", F.when(F.col("pixel_um").isNotNull(), F.col("place"))).alias("_first"))
    made = verbs.upserted(cameras, firsts.select("model_canon", F.col("_came").alias("pixel_um")), "model_canon", "camera", ["pixel_um"], actor=actor)
    table = made.table.withColumn("pixel_conflict", F.coalesce("pixel_conflict", F.lit(0)))
    rows = table.join(firsts.select("model_canon", "_first"), "model_canon", "left").withColumn("_now", F.coalesce("pixel_um", "_first"))
    others = sizes.select(F.col("model_canon").alias("_model"), F.col("pixel_um").alias("_size"), "place")
    other = rows.join(others, (F.col("model_canon") == F.col("_model")) & (F.col("_size") != F.col("_now"))).groupBy("model_canon").agg(F.min_by("_size", "place").alias("_other"))
    rows = cut(rows.join(other, "model_canon", "left").withColumns({"_set": F.col("pixel_um").isNull() & F.col("_now").isNotNull(), "_split": F.col("_other").isNotNull() & (F.col("pixel_conflict") == 0)}))
    log = [
        made.events, verbs._events(rows.where("_set"), actor, "camera.pixel_set", verbs._at("camera", "id"), None, F.to_json(F.struct(F.col("_now").alias("pixel_um")))),
        verbs._events(rows.where("_split"), actor, "camera.pixel_conflict", verbs._at("camera", "id"), None, F.to_json(F.struct(F.col("_now").alias("pixel_existing"), F.col("_other").alias("pixel_new")))),
    ]
    new = rows.withColumns({"pixel_um": F.col("_now"), "pixel_conflict": F.when(F.col("_split"), 1).otherwise(F.col("pixel_conflict"))})
    return verbs.Change(new.select(cameras.columns), reduce(DataFrame.unionByName, log))


def delivered(records: DataFrame, frames: DataFrame, locations: DataFrame, headers: DataFrame, cards: DataFrame, cameras: DataFrame, now: Column, actor: str = "scan", keep: bool = True) -> Delivered:
    """Records brought into all tables.

    `records` are those of `verbs.ingested` with model_canon, kind_source, cards (an array) and the columns
    of `headers` that they have. Of several copies of a frame that say something new in one delivery the
    last by place counts; of a new content the first. They are stored, as most tables read them, unless
    `keep` is false: for records and copies that are stored dealt by place.
    """
    return Delivered(cut(records) if keep else records, frames, locations, headers, cards, cameras, now, actor, keep)


def last_numbers(found: Delivered, top: int) -> dict[str, DataFrame]:
    """The rows that a delivery has only added, of tables in which it has changed no other: by table, after frame `top`."""
    return {"cards": found.cards.where(F.col("frame_id") > top), "header": found.headers.where(F.col("frame_id") > top)}
