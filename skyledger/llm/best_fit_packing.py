"""Best-fit packing of documents into sequences by hierarchical residual packing.

Pieces are dealt over tasks, each task packs its own by best fit (largest first, into the open
sequence with the least room that takes it), nearly full sequences are final, and the underfull
ones go on as single items into a round with fewer tasks, a tree of merges, until one round no
longer saves any. An item of a later round is a whole underfull sequence, so its pieces move
together. A task holds about `task_rows` pieces at first and `FAN_IN` times as many later, of their
ids' place and length only.

Defined results: a null text counts as empty; every document has its separator, so at least one
token; equal rows are separate pieces; an empty table gives no row; other columns are left alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from skyledger.llm import common, wordcache

PIECES = "doc_id long, piece int, start long, length long, ids binary"
TASK_ROWS = 50_000
FAN_IN = 8


def pieces(docs: DataFrame, tokenizer: str, separator: int = 0, length: int = 2048) -> DataFrame:
    """The ids of each document with its separator, cut only where longer than a sequence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordcache.encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for begin, end in wordcache.slices(texts):
                ids, bounds = encoder.encode(texts[begin:end])
                rows = []
                for k in range(begin, end):
                    own = np.append(ids[bounds[k - begin] : bounds[k - begin + 1]], np.uint32(separator)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), length)):
                        part = own[at : at + length]
                        rows.append((doc_ids[k], piece, at, len(part), part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the place in it of every item, and what each bin holds; largest items first.

    Open bins stand in lists by their free room; a bit set of the rooms that have a bin gives the
    smallest sufficient one in a few operations.
    """
    bins, offsets, held = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_bins: list[deque] = [deque() for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = open_bins[room].popleft()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, own = capacity, len(held)
            held.append(0)
        bins[item], offsets[item] = own, capacity - room
        held[own] += size
        if room > size:
            open_bins[room - size].append(own)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(held, np.int64)


def pack(rows: DataFrame, length: int = 2048, nearly_full: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows that have `doc_id`, `piece` and `length`.

    Every other column of `rows` is carried along; one of these two names has an underscore before it then.
    """
    nearly_full = length - 4 if nearly_full is None else nearly_full
    for taken in ("sequence_id", "offset"):
        rows = rows.withColumnsRenamed({c: common.fresh("_" + taken, rows) for c in rows.columns if c.lower() == taken})
    columns = rows.columns
    held_name, final_name = common.fresh("held", rows), common.fresh("final", rows)
    shape = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("sequence_id", "offset", held_name)), StructField(final_name, BooleanType())])

    def pack_round(number: int, last: bool):
        def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [b for b in batches if b.num_rows]
            if not found:
                return
            table = pa.Table.from_batches(found)
            keys = np.arange(table.num_rows) if number == 0 else table["sequence_id"].to_numpy()
            _, first, item = np.unique(keys, return_index=True, return_inverse=True)
            sizes = table["length" if number == 0 else held_name].to_numpy()[first]
            bins, places, held = best_fit(sizes, length)
            offsets = places[item] + (0 if number == 0 else table["offset"].to_numpy())
            new = bins[item]
            base = (number << 56) + (TaskContext.get().partitionId() << 28)
            out = table.select(columns)
            for name, values in (("sequence_id", new + base), ("offset", offsets), (held_name, held[new]), (final_name, (held[new] >= nearly_full) | last)):
                out = out.append_column(name, pa.array(values))
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)

        return one_task

    done: list[DataFrame] = []
    # Pieces are dealt in turn, so equal ids don't meet in one task; later rounds keep sequences together.
    todo, number, key, before = rows, 0, [], None
    while True:
        left = todo.count() if number == 0 else items
        tasks = max(1, -(-left // (task_rows * (FAN_IN if number else 1))), 0 if before is None else -(-before // FAN_IN))
        last = number > 0 and (tasks == 1 or before is not None and tasks >= before)
        packed = common.keep(todo.repartition(tasks, *key).mapInArrow(pack_round(number, last), shape), f"pack-{number}")
        done.append(packed if last else packed.where(F.col(final_name)))
        if last:
            break
        todo, before, number, key = packed.where(~F.col(final_name)), tasks, number + 1, [F.col("sequence_id")]
        items = todo.count()
        if items == 0:
            break
    return reduce(DataFrame.unionByName, done).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, separator: int = 0, length: int = 2048) -> DataFrame:
    """Pieces of all documents with their ids and their place in a sequence."""
    parts = common.keep(pieces(docs, tokenizer, separator, length).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(parts.drop("ids"), length).join(parts.select("row", "ids"), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed rows of one sequence put together: sequence_id and its ids in order.

    A sequence holds at most its length in pieces, so its group is bounded.
    """
    members = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id", F.aggregate("m", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
