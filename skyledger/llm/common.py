"""Helpers shared by the training-data operators: shared storage, components, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only where the session names none and runs on one machine (tests) a temporary folder is set.
    """
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="skyledger-")
        context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named if "://" in named else f"file://{named}" if named.startswith("/") else named


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a small or iterated table in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes a table once to the shared folder as Parquet and reads it from there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """A name that no column of `df` has: `name`, with underscores before it where it is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Values of a batch that are Python objects at a time.
SLICE_ROWS = 256


def by_slices(column: pa.Array, f: Callable[[list], pa.Array]) -> pa.Array:
    """`f` over a column a few rows at a time, so a batch of long texts is never held twice."""
    cuts = range(0, max(1, len(column)), SLICE_ROWS)
    return pa.concat_arrays([f(column.slice(at, SLICE_ROWS).to_pylist()) for at in cuts])


def sampled(rows: DataFrame, n: int, most: int | None = None, texts: DataFrame | None = None) -> list[tuple]:
    """(label, rows of that label, text) of at most `n` distinct texts for each label, and of `most` in all.

    Where labels are so many that `n` texts each are over `most`, each has fewer, one at least.

    Texts are taken by least hash. A first pass counts each label's rows and, roughly, its texts;
    the share of hashes that holds `n` of them for certain is all that the second pass shuffles, and
    copies of a text are one row before the shuffle. So a task gets a few thousand rows at most,
    however large the table is or however often a text repeats.

    `rows` holds label and text; or, with `texts(text)`, label and the text's `h`, so that a join
    which gives the labels doesn't have to move texts.
    """
    spark = rows.sparkSession
    rows = rows.select("label", "text", F.xxhash64("text").alias("h")) if texts is None else rows.select("label", "h")
    stats = rows.groupBy("label").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("kinds")).collect()
    if not stats:
        return []
    n = n if most is None else max(1, min(n, most // len(stats)))
    # The rough count is off by less than a quarter; six deviations of what falls below a cut.
    ample = 1.25 * (n + 6 * n**0.5 + 20)
    cuts = [(r.label, r.rows, min((1 << 63) - 1, int(ample / max(1, r.kinds) * (1 << 64)) - (1 << 63))) for r in stats]
    kind = rows.schema["label"].dataType.simpleString()
    known = F.broadcast(spark.createDataFrame(cuts, f"label {kind}, rows long, cut long"))
    few = rows.join(known, "label").where("h <= cut").groupBy("label", "rows", "h").agg(*([F.min("text").alias("text")] if texts is None else [F.count("*").alias("copies")]))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = few.withColumn("place", place).where(F.col("place") <= n)
    if texts is not None:  # at most n for each label
        wanted = F.broadcast(chosen.select("label", "rows", "h"))
        chosen = texts.select("text", F.xxhash64("text").alias("h")).join(wanted, "h").groupBy("label", "rows", "h").agg(F.min("text").alias("text"))
    return [(r.label, r.rows, r.text) for r in chosen.orderBy("label", "h").toLocalIterator()]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a, b)` as `(id, component)`, component = smallest id.

    Every round maps each node to the smallest node among itself and its neighbours and contracts
    the edges, so the count of live nodes at least halves; the rounds' maps are then composed.
    Only nodes that have an edge to another node are returned. Hub nodes only meet a partially
    aggregated minimum and joins against a table of unique keys, which Spark can split.
    """
    live = cut(edges.select("a", "b").where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a"))).toDF("node", "other")
        step = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")))
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        live = cut(
            live.join(left, "a").join(right, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
        )
    if not steps:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], f"id {kind.simpleString()}, component {kind.simpleString()}")
    found = steps[0].select(F.col("node").alias("id"), F.col("to").alias("component"))
    for step in steps[1:]:
        step = step.select(F.col("node").alias("component"), F.col("to").alias("next"))
        found = found.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return found


def positions(rows: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """`rows` with its place, from 0, in its group by `order`, whatever a group's size.

    Rows are dealt by ranges of (group, order), so a large group spans many tasks; each task counts
    its own rows, and a running sum over the tasks of a group (a row each) gives where each begins.
    """
    spark = rows.sparkSession
    plain = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for value in batch.column(group).to_pylist():
                at = at + 1 if value == now else 0
                now = value
                places.append(at)
            table = pa.Table.from_batches([batch]).append_column("_part", pa.array([part] * len(places), pa.int64())).append_column("_place", pa.array(places, pa.int64()))
            yield from table.to_batches()

    keys = [group, *order]
    dealt = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    shape = StructType([*rows.schema.fields, StructField("_part", LongType()), StructField("_place", LongType())])
    counted = keep(dealt.mapInArrow(number, shape), "positions")
    sizes = counted.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).count()
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).where("_before > 0")
    joined = counted.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")), "left")
    return joined.select(*plain, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(name))


def numbered(blocks: DataFrame) -> DataFrame:
    """Stored `blocks(part, seq, ...)`, seq counting from 0 in each part, with `block`, its place by (part, seq).

    Only the parts' numbers of blocks are brought together, a row a task; the blocks stay where they are.
    """
    before, known = 0, []
    for row in blocks.groupBy("part").count().orderBy("part").collect():
        known.append((row["part"], before))
        before += row["count"]
    offsets = F.broadcast(blocks.sparkSession.createDataFrame(known, "part long, _before long"))
    return blocks.join(offsets, "part").withColumn("block", F.col("seq") + F.col("_before")).drop("part", "seq", "_before")
