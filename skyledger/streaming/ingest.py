"""Continuous ingest: new header files become frames, copies and events, once each.

The file source's checkpoint keeps what was read; each micro-batch is a run of the store, by the same
verbs as any other ingest, so its tables and events are there together or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyledger import storage
from skyledger.functions import resolve
from skyledger.operators import changes, delivery, donor, views
from skyledger.sources import header_files, headers
from skyledger.store import Manifest, Store


def listen(spark: SparkSession, root: str) -> DataFrame:
    """A stream of header records of files that appear below a root."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return headers.scan(files.select("path", "modificationTime", "length").where(F.lower("path").rlike(rf"\.({'|'.join(headers.SUFFIXES)})$")))


def records_of(scanned: DataFrame, volume: str = "") -> DataFrame:
    """Header records as deliveries take them: what a file is, and what its header says of camera and kind.

    A file that can't be parsed counts by the hash of all its bytes, one that can't be opened by its path.
    """
    rows = headers.hot_columns(scanned)
    keyed = lambda keyword: F.try_element_at(F.filter("cards", lambda c: c["keyword"] == keyword), F.lit(-1))["value_raw"]
    kind = views.frame_kind(F.col("filetype"), keyed("IMAGETYP"), F.col("path"), F.col("error").isNull())
    return rows.select(
        F.lit(volume).alias("volume"), "path", F.coalesce("sha1_data", "sha1_file", F.sha1(F.concat(F.lit("unread:"), F.col("path")))).alias("sha1_data"), kind.alias("kind"), "filetype",
        F.col("mtime").cast("string").alias("mtime"), F.col("size").alias("size_bytes"), "header_hash", F.col("sha1_file").alias("file_sha1"), F.coalesce("hdu", F.lit(0)).alias("hdu_index"), F.coalesce("compressed", F.lit(False)).cast("int").alias("compressed"), "error",
        "cards", resolve.camera_identity(F.col("instrume"), F.col("bayerpat"), F.when(F.col("filetype") == "raw", "raw")).alias("model_canon"), F.when(F.col("filetype") == "raw", "path").otherwise("header").alias("kind_source"), *delivery.TYPED,
    )


def delivered(store: Store, scanned: DataFrame, name: str, number: int, now: Column, volume: str = "") -> Manifest | None:
    """Header records brought into a store as one run, of all tables that they reach.

    Headers and cards are added to while a run only brings new contents, and written anew where it changes what was there.
    """
    base = store.manifest()
    tables = [store.table(t) for t in ("frame", "location", "header", "cards", "camera")]
    found = delivery.delivered(records_of(scanned, volume), *tables, now)
    replaced, added = {"frame": found.frames, "location": found.locations, "camera": found.cameras}, {}
    if found.rewritten:
        replaced |= {"header": found.headers, "cards": found.cards}
    else:
        added = delivery.last_numbers(found, base.last.get("frame", 0))
    return store.publish(name, number, found.events, now, replaced, added, base)


def ingest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Brings files there now into the store of `folder`, each micro-batch as one run.

    A batch that is run again after a failure has been published, or has left nothing.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, folder)
        if store.known("stream") < number:
            delivered(store, batch, "stream", number, F.current_timestamp())

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def looks(spark: SparkSession, root: str) -> DataFrame:
    """A stream of looks at a tree: every header file that is there by path, time and size, none opened."""
    return header_files.register(spark).readStream.format("headers").option("rows", "listing").load(root)


def ingest_looks(stream: DataFrame, folder: str, checkpoint: str, volume: str = "") -> StreamingQuery:
    """Looks brought into the store of `folder`: only files that its copies don't have by path and time are opened.

    The gate is the store, so a look that is made again, or finds nothing new, publishes nothing.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, folder)
        if store.known("looks") < number:
            listed = batch.withColumns({"volume": F.lit(volume), "mtime": F.col("modificationTime").cast("string")})
            delivered(store, headers.scan(changes.to_scan(listed, store.table("location"))), "looks", number, F.current_timestamp(), volume)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill(store: Store, now: Column, volume: str = "", filetype: str = "xisf") -> tuple[Manifest | None, int]:
    """Reads the headers of a volume's copies of a file type that never had theirs read, and only those.

    Returns the run that was published, if any, and how many copies remain: those whose file is gone or
    can't be read.
    """
    todo = lambda: changes.to_backfill(store.table("location").where(F.col("volume") == volume), store.table("frame"), filetype)
    found = delivered(store, headers.scan(headers.stat(todo())), "backfill", store.known("backfill") + 1, now, volume)
    return found, todo().count()


def take_over(store: Store, files: DataFrame, cards: DataFrame, repairs: DataFrame, registry: DataFrame, now: Column, volume: str = "", seed: str = "") -> tuple[Manifest | None, DataFrame]:
    """A donor's catalog brought into an empty store as one run, and the gates that were judged before (see `donor`).

    Nothing is published where one isn't met. Files that are gone are left out. Of files that the donor
    has repaired after it read them, all are read anew where a sampled one has other facts.
    """
    spark = store.spark
    there = storage.cut(headers.stat(files.select("path").distinct()))
    files = storage.cut(files.join(there.select("path", F.lit(True).alias("_there")), "path", "left").withColumn("reached", F.coalesce("_there", F.lit(False))).drop("_there"))
    root = donor.common_root(files).first()["root"]
    listing = headers.listing(spark, root) if root else there.limit(0)
    drawn = storage.cut(donor.sample(files.where("reached"), repairs, seed))
    read = headers.scan(there.join(drawn, "path", "left_semi"))
    verdicts = storage.cut(donor.judged(drawn, files, read, repairs, registry))
    gates = storage.cut(donor.gates(files, listing, verdicts, {t: store.table(t) for t in ("frame", "location", "event")}))
    if not gates.where("not ok").isEmpty():
        return None, gates
    kept = files.where("reached")
    rows = donor.scanned(kept, cards)
    if not verdicts.where("verdict = 'stale, repaired late'").isEmpty():
        late = donor.repaired(kept, repairs).where("late").select("path")
        rows = rows.join(late, "path", "left_anti").unionByName(headers.scan(there.join(late, "path", "left_semi")))
    return delivered(store, rows, "import", 0, now, volume), gates


def nightly(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Frames and exposure by night, from noon to noon, as the nights close; later records are dropped."""
    timed = stream.withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "1 day", "1 day", "12 hours").alias("w"), "filter_canon").agg(F.count("*").alias("n"), F.sum("exptime").alias("secs")).select(F.to_date("w.start").alias("night"), "filter_canon", "n", "secs")
