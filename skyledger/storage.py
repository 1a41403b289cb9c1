"""Where intermediate tables are cut from their lineage: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, MapType, NullType, StructType, VariantType


def shared(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.

    Only where no folder is named and all runs on one machine (tests) a temporary one is set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = named or "file://" + tempfile.mkdtemp(prefix="skyledger-")
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared(spark)}/{label}-{uuid.uuid4().hex}"


def _columnar(schema: StructType) -> bool:
    """Whether Parquet keeps rows of this type as they are."""
    names = [f.name.lower() for f in schema.fields]
    plain = lambda t: (_columnar(t) if isinstance(t, StructType) else plain(t.elementType) if isinstance(t, ArrayType) else plain(t.keyType) and plain(t.valueType) if isinstance(t, MapType) else not isinstance(t, (NullType, CalendarIntervalType, VariantType)))
    return bool(names) and len(set(names)) == len(names) and all(plain(f.dataType) for f in schema.fields)


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, without its lineage.

    Compressed columns take a small part of the disk that a checkpoint's rows take; only what Parquet
    has no type or name for is written as those. As with checkpoints, the folder is for its owner to clear.
    """
    spark = df.sparkSession
    if not _columnar(df.schema):
        shared(spark)
        return df.checkpoint()
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, made: dict[str, Column] | None = None) -> DataFrame:
    """`df` written as `cut` does, dealt by `keys`: rows read of it meet and are counted by just these keys without being dealt again.

    Columns `made`, keys among them, are added once rows are dealt, so that only what they are made of is moved.
    Its name in the session's catalog is taken away again; the files stay. What Parquet has no type or name for is stored as `cut` does.
    """
    spark = df.sparkSession
    if not _columnar(df.withColumns(made or {}).schema):
        return cut(df.withColumns(made or {}))
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"dealt_{uuid.uuid4().hex}"
    made = made or {}
    rows = df.repartition(n, *(made.get(k, F.col(k)) for k in keys)).withColumns(made).write.bucketBy(n, *keys).option("compression", "zstd").option("path", scratch(spark, "dealt"))
    rows.format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def many(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that grows with the data: both sides are dealt by the keys, and it isn't sent whole to the driver and to every task.

    The planner knows stored tables by the size of their files, and ids and texts that repeat take a small part
    there of what they take in memory: millions of rows seem small enough for a broadcast.
    """
    return df.hint("merge")


def numbered(rows: DataFrame, order: list[str | Column], after: int = 0, name: str = "id") -> DataFrame:
    """`rows` with the numbers that follow `after`, by `order`, a range of rows in each task.

    Rows are dealt by ranges and written once, so that numbers are the same whenever they are read;
    what comes together is a row a task.
    """
    dealt = rows.repartitionByRange(*(F.col(c) if isinstance(c, str) else c for c in order)).sortWithinPartitions(*order)
    ordered = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_seq").alias("_first"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.join(F.broadcast(sizes.select("_part", "_first", before.alias("_before"))), "_part")
    return placed.withColumn(name, F.col("_seq") - F.col("_first") + F.col("_before") + after + 1).drop("_part", "_seq", "_first", "_before")
