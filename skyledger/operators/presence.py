"""A run that takes copies off whose files are gone: walk, compare, brake, look, and only then mark.

What a walk of the root did not meet is a candidate, unless it lies below a folder that the walk did not
look into. Too many candidates, none in scope or an empty walk are a brake: more likely a volume that
isn't mounted than so many losses. Each candidate is looked at on the executors, with three outcomes:
gone, back, or undecided. A run is dry unless it is told to apply; `force` is the number of gone copies
that a person expects, lifts the brake, and must be met exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators import changes, verbs
from skyledger.sources import headers
from skyledger.storage import cut


@dataclass(frozen=True)
class Summary:
    """What a run met and did; gone, back and undecided are 0 where nothing was looked at."""

    scoped: int = 0
    walked: int = 0
    hidden: int = 0
    candidates: int = 0
    looked: bool = False
    gone: int = 0
    back: int = 0
    undecided: int = 0
    vanished: int = 0
    drifted: int = 0
    frames_without_copy: int = 0
    brake: str | None = None
    aborted: str | None = None


class Run(NamedTuple):
    """The summary, (id, path, state) of what the walk did not meet, and the table and events, None where nothing was to be marked."""

    summary: Summary
    missing: DataFrame | None
    locations: DataFrame | None = None
    events: DataFrame | None = None


def looked_at(paths: DataFrame) -> DataFrame:
    """(path, gone) of each file, on the executors: true where its folder's system says that it isn't there, null where it says neither."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for path in batch.column("path").to_pylist():
                try:
                    system, inner = headers.place_of(path)
                    gone.append(system.get_file_info(inner).type == headers.fs.FileType.NotFound)
                except (OSError, ValueError):
                    gone.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(gone, pa.bool_())], ["path", "gone"])

    spread = paths.select("path").repartition(paths.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(look, "path string, gone boolean")


def run(
    locations: DataFrame, walked: DataFrame, volume: str, root: str, mounted: str | None, run_id: str, *, apply: bool = False, force: int | None = None,
    look: Callable[[DataFrame], DataFrame] = looked_at, suffixes: tuple[str, ...] = headers.SUFFIXES,
) -> Run:
    """One run over the copies of a volume below a root, after `headers.walk`'s (kind, path).

    `mounted` is the volume that the root really lies on. Files of suffixes that a walk doesn't list are
    no candidates, and roots end at a separator, so a folder beside one of a longer name isn't in scope.
    """
    if volume != mounted or volume == "?":
        return Run(Summary(aborted=f"{root} lies on volume {mounted}, not {volume}"), None)
    known = F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1).isin(*suffixes)
    inside = F.startswith(F.lower("path"), F.lit(root.lower().rstrip("/") + "/"))
    scoped = locations.where((F.col("present") == 1) & (F.col("volume") == volume) & inside & known).select("id", "path", "frame_id")
    files = walked.where("kind = 'file'").select("path").distinct()
    seen = F.lit(True).alias("_seen")
    missing = cut(scoped.join(files.select("path", seen), "path", "left").where("_seen is null").select("id", "path", "frame_id"))
    shut = verbs.behind(missing.select("id", "path"), headers.barriers(walked)).select("id", F.lit(True).alias("_hidden"))
    missing = cut(missing.join(shut, "id", "left"))
    open_ = missing.where("_hidden is null")
    n_scoped, n_walked, n_hidden, n = scoped.count(), files.count(), missing.where("_hidden").count(), open_.count()
    brake = changes.brake(n_scoped, n_walked, n)
    counted = {"scoped": n_scoped, "walked": n_walked, "hidden": n_hidden, "candidates": n, "brake": brake}
    plain = missing.select("id", "path", F.when(F.col("_hidden"), "hidden").otherwise("not looked at").alias("state"))
    if brake and not (apply and force is not None):
        return Run(Summary(**counted, aborted=brake if apply else None), plain)
    verdicts = cut(look(open_.select("path")))
    state = F.when(F.col("_hidden"), "hidden").when(F.col("gone"), "gone").when(~F.col("gone"), "back").otherwise("undecided")
    judged = cut(missing.join(verdicts, "path", "left").select("id", "path", state.alias("state")))
    found = {r["state"]: r["count"] for r in judged.groupBy("state").count().collect()}
    counted |= {"looked": True, **{s: found.get(s, 0) for s in ("gone", "back", "undecided")}}
    if not apply:
        return Run(Summary(**counted), judged)
    if force is not None and force != counted["gone"]:
        return Run(Summary(**counted, aborted=f"{counted['gone']} copies are gone, not {force}"), judged)
    change = verbs.vanished(locations, judged.where("state = 'gone'").select("id", "path"), run_id, force is not None)
    table = cut(change.table)
    outcome = {r["outcome"]: r["count"] for r in change.outcome.groupBy("outcome").count().collect()}
    without = table.groupBy("frame_id").agg(F.max("present").alias("p")).where("p = 0").count()
    counted |= {"vanished": outcome.get("vanished", 0), "drifted": outcome.get("drifted", 0) + outcome.get("already gone", 0), "frames_without_copy": without}
    return Run(Summary(**counted), judged, table, change.events)
