"""A catalog taken over from another one: what it says of its files, once everything that speaks against it has been ruled out.

A donor has files(id, path, mtime, size, filetype, hdu_index, compressed, header_hash, sha1_file,
sha1_data, status, scanned_at, sha1_data_uncomputable), with `mtime` in seconds, and cards(file_id,
keyword, idx, value_raw, value_num, value_type, comment). Everything is judged before anything is
written: one gate that isn't met, and nothing is taken over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import views
from skyledger.sources import headers

#: How many files are read again: newest repairs, and any.
SAMPLE = 5


def common_root(files: DataFrame) -> DataFrame:
    """(root, n): the deepest folder that all files lie in, null where there is none, and how many files.

    What the least and the greatest list of folders share at their beginning, all lists share; so it is
    one aggregate, whatever the number of files.
    """
    folders = F.split("path", "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    ends = files.agg(F.min(folders).alias("a"), F.max(folders).alias("b"), F.count("*").alias("n"))
    steps = F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")))
    shared = F.array_max(F.filter(steps, lambda k: F.slice("a", 1, k) == F.slice("b", 1, k)))
    root = F.nullif(F.array_join(F.slice("a", 1, shared), "/"), F.lit(""))
    return ends.select(F.when(F.col("n") > 0, root).alias("root"), "n")


def incomplete(files: DataFrame) -> DataFrame:
    """Files that a donor can't vouch for: not read, or without the hash of all bytes or, where there is one to be had, of the data."""
    unknown = F.col("sha1_data").isNull() & (F.coalesce("sha1_data_uncomputable", F.lit(0)) == 0)
    return files.where((F.coalesce("status", F.lit("")) != "ok") | F.col("sha1_file").isNull() | unknown)


def repaired(files: DataFrame, repairs: DataFrame) -> DataFrame:
    """(path, repaired_at, late): files that the donor has rewritten, `late` where it was after it last read them. repairs(path, applied_at)."""
    last = repairs.groupBy("path").agg(F.max("applied_at").alias("repaired_at"))
    return files.join(last, "path").select("path", "repaired_at", F.coalesce(F.col("repaired_at") > F.col("scanned_at"), F.lit(False)).alias("late"))


def sample(files: DataFrame, repairs: DataFrame, seed: str, n: int = SAMPLE) -> DataFrame:
    """(path, why) of files to be read again: `n` at random by `seed`, and the `n` repaired last of those repaired late; where none was, of all repaired."""
    rows = repaired(files, repairs)
    newest = rows.orderBy(F.desc("late"), F.desc("repaired_at"), "path").limit(n)
    # With late ones in front, the others of the n count only where the first isn't late.
    flag = newest.agg(F.max("late").alias("any_late"))
    targeted = newest.crossJoin(flag).where(F.col("late") | ~F.col("any_late")).select("path", F.when(F.col("late"), "repaired late").otherwise("repaired").alias("why"))
    drawn = views.falsifiers(files.select("path"), "path", seed, n).select("path", F.lit("drawn").alias("why"))
    return targeted.unionByName(drawn).groupBy("path").agg(F.max("why").alias("why"))


def judged(sampled: DataFrame, files: DataFrame, read: DataFrame, repairs: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, verdict, stops) of sampled files against read(path, mtime, header_hash, sha1_file, sha1_data, error) as they are.

    Other data, or a file that can't be read, stop an import. Other facts of a copy are known of files
    repaired late, whose group is read anew, and of those in registry(path), whose repair the donor
    can't know; of all others they stop it.
    """
    known = files.select("path", "sha1_file", "sha1_data", "sha1_data_uncomputable", "header_hash", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long")).alias("mtime"))
    now = read.select("path", *(F.col(c).alias(f"_{c}") for c in ("sha1_file", "sha1_data", "header_hash", "mtime", "error")), F.lit(True).alias("_read"))
    late = repaired(files, repairs).where("late").select("path", F.lit(True).alias("_late"))
    rows = sampled.select("path").distinct().join(known, "path").join(now, "path", "left").join(late, "path", "left")
    rows = rows.join(registry.select("path", F.lit(True).alias("_registered")).distinct(), "path", "left")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("sha1_file", "header_hash", "mtime")))
    data = (F.coalesce("sha1_data_uncomputable", F.lit(0)) == 0) & ~F.col("sha1_data").eqNullSafe(F.col("_sha1_data"))
    verdict = (
        F.when(F.col("_read").isNull() | F.col("_error").isNotNull(), "not readable").when(data, "other data").when(same, "same")
        .when(F.col("_late"), "stale, repaired late").when(F.col("_registered"), "stale, repaired here").otherwise("stale")
    )
    return rows.select("path", verdict.alias("verdict"), verdict.isin("not readable", "other data", "stale").alias("stops"))


def gates(files: DataFrame, listing: DataFrame, verdicts: DataFrame, target: dict[str, DataFrame]) -> DataFrame:
    """(gate, n, ok): what must hold before anything is taken over.

    listing(path) is what a scan of the root would meet; `reached` tells of each of the donor's files
    whether it is there. One that is there and that no scan meets would come in twice some day. Files
    of the listing that the donor doesn't know, and files that are gone, don't stop it (`notes`).
    """
    none = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("gate"), "n", (F.col("n") == 0).alias("ok"))
    root = common_root(files)
    checks = [
        root.select(F.lit("files").alias("gate"), "n", (F.col("n") > 0).alias("ok")),
        root.select(F.lit("one root").alias("gate"), F.col("root").isNotNull().cast("long").alias("n"), F.col("root").isNotNull().alias("ok")),
        none("incomplete files", incomplete(files)), none("network paths", files.where(F.startswith("path", F.lit("\\\\")))),
        none("paths that repeat", files.groupBy("path").count().where("count > 1")),
        none("files that no scan meets", views.surplus(files.where("reached").select("path"), listing.select("path"), "path").where("side = 'left only'")),
        none("sampled files that differ", verdicts.where("stops")),
        *(none(f"rows in {name}", rows) for name, rows in sorted(target.items())),
    ]
    return reduce(DataFrame.unionByName, checks)


def notes(files: DataFrame, listing: DataFrame) -> DataFrame:
    """(missing, surplus): donor's files that are gone, which are left out, and files that it doesn't know, which the next scan brings."""
    both = views.surplus(files.select("path"), listing.select("path"), "path").agg(F.count_if(F.col("side") == "right only").alias("surplus"))
    return files.agg(F.count_if(~F.col("reached")).alias("missing")).crossJoin(both)


def scanned(files: DataFrame, cards: DataFrame) -> DataFrame:
    """A donor's files in the shape of `headers.scan`: what would have been read of them. A file's cards are a bounded list."""
    item = F.struct("keyword", F.col("idx").cast("int").alias("idx"), "value_raw", F.col("value_num").cast("double").alias("value_num"), "value_type", "comment")
    held = cards.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).cast(f"array<{headers.CARD}>").alias("cards"))
    mtime: Column = F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long"))
    rows = files.join(held, files["id"] == held["file_id"], "left")
    return rows.select(
        "path", mtime.alias("mtime"), F.col("size").cast("long").alias("size"), "filetype", "header_hash", F.col("hdu_index").cast("int").alias("hdu"), F.col("compressed").cast("boolean").alias("compressed"),
        F.lit(None).cast("long").alias("header_ceiling"), F.coalesce("cards", F.array().cast(f"array<{headers.CARD}>")).alias("cards"), F.lit(None).cast("string").alias("error"), "sha1_file", "sha1_data",
    )
