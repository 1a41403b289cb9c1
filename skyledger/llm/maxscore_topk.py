"""Exact top-k by integer inner product with MaxScore over posting shards.

Components are turned into integers; a term is a component number, and a shard of documents keeps
each term's postings as one row of weights with its greatest and least weight. For a query, a term's
bound in a shard is the most it can add there. Terms are ordered by bound; those at the end whose
bounds together stay under the query's current k-th score (of the shards before, or of the shard's
first documents) are not essential. Essential postings are traversed for all documents of the shard
at once; the others are probed, a few terms at a time, only for documents that are still
competitive. A task keeps each query's best k over its shards, and a last step merges the tasks' lists.

Every query meets every shard: shards are dealt to groups of a few, and the blocks of queries, which
are far fewer, are sent to every group. All blocks are rows of bounded size; nothing is broadcast.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; a shorter vector ends in zeros; an empty vector scores zero; any finite component
counts, and scores beyond a long stop at its ends; a query's candidates are all rows but its own
`row`, or, in tables without that column, but those of its id; queries that repeat an id have results
of their own; ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import common, vectors

SCALE, SHARD_ROWS, QUERY_ROWS, PROBE_TERMS = 256.0, 4096, 256, 8
#: Most shards that a task holds at a time, and documents of a shard that give the first k-th score.
GROUP_SHARDS, FIRST_DOCS = 8, 256
#: Up to this share of competitive documents they are probed one by one, above it together.
DENSE = 0.02
#: Products and sums of doubles are exact integers below it.
EXACT = float(1 << 53)


#: Components under it have products whose sums are exact, whatever the other vector's are.
SMALL = float(1 << 23)


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: float = SCALE) -> DataFrame:
    """Valid vectors as (id, weights): integers floor(scale * x) as little-endian doubles, which hold them exactly."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        values, begin, end = vectors.lists(column)
        fine = np.isfinite(values)
        with np.errstate(over="ignore"):
            whole = np.nan_to_num(np.floor(np.where(fine, values, 0) * scale)).astype("<f8")
        missing = column.is_null().to_numpy(zero_copy_only=False)
        return pa.array([None if m or not fine[b:e].all() else whole[b:e].tobytes() for m, b, e in zip(missing, begin, end)], pa.binary())

    rows = df.select(F.col(id_column).cast("long").alias("id"), pack(F.col(vector_column).cast("array<double>")).alias("weights"))
    return rows.where("id is not null and weights is not null")


BLOCKS = "part long, seq long, ids binary, rows binary, weights binary, kind string"


def _blocks(rows: DataFrame, size: int, label: str) -> DataFrame:
    """Bounded blocks (block, ids, rows, weights, kind) of rows; a task cuts its own rows.

    `kind` is the least type of number that holds a block's weights.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, places, weights = TaskContext.get().partitionId(), 0, [], [], []

        def block(n: int) -> pa.RecordBatch:
            own = vectors.matrix(weights[:n])
            most = np.abs(own).max(initial=0)
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
            row = [part], [seq], [np.array(ids[:n], "<i8").tobytes()], [np.array(places[:n], "<i8").tobytes()], [own.astype(kind).tobytes()], [kind]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "seq", "ids", "rows", "weights", "kind"])

        for batch in batches:
            ids += batch.column("id").to_pylist()
            places += batch.column("row").to_pylist()
            weights += batch.column("weights").to_pylist()
            while len(ids) >= size:
                yield block(size)
                seq += 1
                del ids[:size], places[:size], weights[:size]
        if ids:
            yield block(len(ids))

    named = rows if "row" in rows.columns else rows.withColumn("row", F.col("id"))
    tasks = max(1, -(-rows.count() // (4 * size)))
    dealt = named.select("id", "row", "weights").repartition(tasks, "id", "row", "weights").sortWithinPartitions("id", "row", "weights")
    return common.numbered(common.keep(dealt.mapInArrow(cut, BLOCKS), label))


class Block:
    """The vectors of a stored block as doubles, with their ids and row numbers."""

    def __init__(self, ids: bytes, rows: bytes, weights: bytes, kind: str):
        self.ids, self.rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
        self.weights = np.frombuffer(weights, kind).reshape(len(self.ids), -1).astype(float)


def search(queries: np.ndarray, query_rows: np.ndarray, shard: np.ndarray, shard_rows: np.ndarray, shard_ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of one shard for each query of a block as flat (query place, id, score), exact.

    `least` holds each query's k-th best score so far; documents that can't reach it are skipped.
    """
    width = max(queries.shape[1], shard.shape[1])
    queries, shard = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, shard))
    with np.errstate(over="ignore"):
        most = np.abs(queries).sum(1).max(initial=0) * np.abs(shard).max(initial=0)
    if most < EXACT:
        return _search_exact(queries, query_rows, shard, shard_rows, shard_ids, k, least)
    # Few vectors are large: only pairs with one of them are counted in whole numbers of any size.
    small = [np.abs(m).max(1, initial=0) < SMALL for m in (queries, shard)] if width < 128 else [np.zeros(len(m), bool) for m in (queries, shard)]
    found = []
    for q, d in ((q, d) for q in (small[0], ~small[0]) for d in (small[1], ~small[1])):
        q, d = np.flatnonzero(q), np.flatnonzero(d)
        if not len(q) or not len(d):
            continue
        exact = small[0][q[0]] and small[1][d[0]]
        own = (queries[q], query_rows[q], shard[d], shard_rows[d], shard_ids[d], k)
        place, ids, score = _search_exact(*own, least[q]) if exact else _search_large(*own)
        found.append((q[place], ids, score))
    return _best(*(np.concatenate(x) for x in zip(*found)), k)


def _search_exact(weights, query_rows, shard, shard_rows, shard_ids, k, least):
    width = weights.shape[1]
    posts = np.ascontiguousarray(shard.T)  # a row of postings a term
    high, low = posts.max(1, initial=-np.inf), posts.min(1, initial=np.inf)
    bound, worst = np.maximum(weights * high, weights * low), np.minimum(weights * high, weights * low)
    order = np.argsort(-bound.sum(0), kind="stable")
    weights, posts, bound, worst = weights[:, order], posts[order], bound[:, order], worst[:, order]
    # What the terms from each place on can add at most and at least.
    rest, lack = (np.pad(np.cumsum(x[:, ::-1], 1)[:, ::-1], ((0, 0), (0, 1))) for x in (bound, worst))
    own = query_rows[:, None] == shard_rows[None, :]
    floor = least.copy()
    first = np.where(own[:, :FIRST_DOCS], -np.inf, weights @ posts[:, :FIRST_DOCS])
    if first.shape[1] >= k:
        floor = np.maximum(floor, np.partition(first, -k, 1)[:, -k])
    # Terms from each query's own place on are not essential: together they stay under its k-th score.
    steps = np.append(np.arange(PROBE_TERMS, width, PROBE_TERMS), width)
    split = steps[np.argmax(np.where(steps == width, True, rest[:, steps] < floor[:, None]), 1)]
    found = []
    for essential in np.unique(split).tolist():
        at = np.flatnonzero(split == essential)
        place, d, score = _traverse(weights[at], posts, own[at], rest[at], lack[at], floor[at], essential, k)
        found.append((at[place], shard_ids[d], score))
    return _best(*(np.concatenate(x) for x in zip(*found)), k) if found else (np.zeros(0, np.int64),) * 3


def _traverse(weights, posts, own, rest, lack, floor, at, k):
    """Queries that share a split: its essential postings for all documents, then probes for competitive ones."""
    width = weights.shape[1]
    partial = weights[:, :at] @ posts[:at]
    partial[own] = -np.inf
    while True:
        if partial.shape[1] >= k:
            floor = np.maximum(floor, np.partition(partial, -k, 1)[:, -k] + lack[:, at])
        alive = (partial + rest[:, at, None] >= floor[:, None]) & (partial > -np.inf)
        if at >= width or alive.mean() < DENSE:
            break
        partial += weights[:, at : at + PROBE_TERMS] @ posts[at : at + PROBE_TERMS]
        at = min(at + PROBE_TERMS, width)
    q, d = np.nonzero(alive)
    score = partial[q, d]
    while at < width:
        probe = slice(at, at + PROBE_TERMS)
        score = score + (weights[q, probe] * posts[probe, d].T).sum(1)
        at = min(at + PROBE_TERMS, width)
        keep = score + rest[q, at] >= floor[q]
        q, d, score = q[keep], d[keep], score[keep]
    return q, d, score.astype(np.int64)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~score, q))  # unlike a minus sign, this turns the least long around too
    q, ids, score = q[order], ids[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[kept], ids[kept], score[kept]


def _search_large(queries, query_rows, shard, shard_rows, shard_ids, k):
    """For numbers whose products leave the exact range of doubles; scores stop at the ends of long."""
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, shard)]
    score = np.clip(whole[0] @ whole[1].T, -(1 << 63), (1 << 63) - 1).astype(np.int64).reshape(len(queries), len(shard))
    q, d = np.nonzero(query_rows[:, None] != shard_rows[None, :])
    return _best(q, shard_ids[d], score[q, d], k)


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k best of `corpus` for each row of `queries`."""
    n = common.partitions(corpus.sparkSession)
    shards, asked = _blocks(corpus, SHARD_ROWS, "shards"), _blocks(queries, QUERY_ROWS, "queries")
    per_group = max(1, min(GROUP_SHARDS, shards.count() // n))
    grouped = shards.withColumn("group", F.floor(F.col("block") / per_group).cast("long")).withColumn("query", F.lit(False))
    groups = grouped.agg(F.coalesce(F.max("group"), F.lit(0))).first()[0] + 1
    sent = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).withColumn("query", F.lit(True))
    dealt = grouped.unionByName(sent).repartition(n, "group").sortWithinPartitions("group", "query", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if row["group"] != now:
                    now, held = row["group"], []
                block = Block(row["ids"], row["rows"], row["weights"], row["kind"])
                if not row["query"]:
                    held.append(block)
                    continue
                best, least = [np.zeros(0, np.int64)] * 3, np.full(len(block.ids), -np.inf)
                for shard in held:
                    new = search(block.weights, block.rows, shard.weights, shard.rows, shard.ids, k, least)
                    best = _best(*(np.concatenate(x) for x in zip(best, new)), k)
                    counts = np.bincount(best[0], minlength=len(block.ids))
                    least = np.where(counts >= k, np.append(best[2], 0)[np.cumsum(counts) - 1].astype(float), -np.inf)
                q, ids, score = best
                yield pa.RecordBatch.from_arrays([pa.array(row["block"] * QUERY_ROWS + q), pa.array(block.ids[q]), pa.array(ids), pa.array(score)], ["place", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "place long, query_id long, vec_id long, score long")
    # Each asked row has a place of its own, so equal ids stay apart.
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
