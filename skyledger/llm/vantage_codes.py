"""Product codes of vectors: the nearest entry of each part's codebook, by vantage-point trees.

Components become whole numbers and vectors four equal parts. A codebook's entries stand in a
vantage-point tree: a node keeps the distances from its entry to those of each half below it, rounded
outwards. A batch of parts descends together, each part first into the half where it lies; into the
other only where the distance that it can't fall below is no greater than its best one (equal counts,
as a lower index may be there). Bounds are doubles widened by `SLACK`; what decides is the squared
distance in whole numbers, then the index.

Codebooks are refined on all vectors: a task adds up parts by their entry, so it gives a row an entry
at most, which Spark sums; codebooks, whose size doesn't depend on the data, go back to the tasks.

Defined results: a vector that is null or holds null or non-finite components is left out; a shorter
one, an empty one too, ends in zeros, as do all up to a multiple of four; components beyond 2^62 after
scaling stop there, errors beyond a long at its end. Fewer than 256 vectors give as many entries. Of
rows that share a vec_id the first entries are those with lesser components; ids that are null come
last. An empty table gives no row and codebooks without entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common, vectors

FACTOR, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries that are compared one by one, by how much bounds are widened, and vectors of a batch that descend at a time.
LEAF, SLACK, ROWS = 16, 1e-12, 8192
#: Ways that rows of one label are dealt.
SALTS = 16
LONGEST = (1 << 63) - 1


def _reach(*rows: np.ndarray) -> int:
    """No squared distance between such rows of whole numbers, nor a step on the way to it, is greater."""
    most = max((int(np.abs(x).max(initial=0)) for x in rows), default=0)
    return 4 * max(1, rows[0].shape[1]) * most * most


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, exact: by doubles, longs or Python's numbers, as they need."""
    reach = _reach(a, b)
    if reach < 1 << 53:
        a, b = a.astype(np.float64), b.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if reach < 1 << 63 else object
    return np.stack([((a.astype(kind) - e) ** 2).sum(1) for e in b.astype(kind)], 1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Tree:
    """A vantage-point tree over the rows of `entries`, whole numbers.

    A node is (ids, halves): a leaf's ids are all compared; an inner node has one id and two halves,
    each a node and the least and greatest distance of what is in it.
    """

    def __init__(self, entries: np.ndarray):
        self.entries, self.compared = entries, 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray) -> tuple:
        if len(ids) <= LEAF:
            return ids, None
        # The entry farthest from the first one sees the others well apart.
        own = ids[int(np.argmax(_root(squared(self.entries[ids], self.entries[ids[:1]])[:, 0])))]
        rest = ids[ids != own]
        far = _root(squared(self.entries[rest], self.entries[own : own + 1])[:, 0])
        order = np.argsort(far, kind="stable")
        halves = order[: len(order) // 2], order[len(order) // 2 :]
        # Rounded outwards: no entry of a half is nearer or farther than this.
        return np.array([own]), [(self._node(np.sort(rest[h])), far[h].min() * (1 - SLACK), far[h].max() * (1 + SLACK)) for h in halves]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row, the lowest index of equally near ones."""
        reach = _reach(rows, self.entries)
        best, at = np.full(len(rows), reach + 1, np.int64 if reach < LONGEST else object), np.full(len(rows), len(self.entries))

        def offer(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
            self.compared += len(ids) * len(asked)
            found = squared(rows[asked], self.entries[ids])
            least = np.argmin(found, 1)  # ids ascend, so the first is the lowest
            value, name = found[np.arange(len(asked)), least], ids[least]
            nearer = (value < best[asked]) | ((value == best[asked]) & (name < at[asked]))
            best[asked[nearer]], at[asked[nearer]] = value[nearer], name[nearer]
            return found[:, 0]

        def visit(node: tuple, asked: np.ndarray) -> None:
            if not len(asked):
                return
            ids, halves = node
            far = _root(offer(ids, asked))
            if halves is None:
                return
            (inner, _, border), (outer, start, _) = halves
            within = far <= (border + start) / 2
            # Each first where it lies, then, against what it found there, in the other half.
            for child, mine, (_, least, most) in ((inner, within, halves[0]), (outer, ~within, halves[1]), (outer, within, halves[1]), (inner, ~within, halves[0])):
                own, away = asked[mine], far[mine]
                bound = np.maximum(least - away * (1 + SLACK), away * (1 - SLACK) - most)
                visit(child, own[bound <= _root(best[own]) * (1 + SLACK)])

        if len(self.entries):
            visit(self.root, np.arange(len(rows)))
        return at, best


def _coder(books: list[np.ndarray]):
    """A function from rows of whole numbers to (codes, squared distances), each by part."""
    trees, width = [Tree(b) for b in books], books[0].shape[1]

    def code(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = vectors.widened(rows, PARTS * width)
        found = [t.nearest(rows[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
        return np.stack([at for at, _ in found], 1), [best for _, best in found]

    return code


def _started(rows: DataFrame) -> list[np.ndarray]:
    """The codebooks of the first vectors by id."""
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-width // PARTS)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    whole = vectors.floored(_column([r["vector"] for r in first]), FACTOR)[1]
    whole = vectors.widened(whole, PARTS * width)
    return [whole[:, p * width : (p + 1) * width] for p in range(PARTS)]


def _column(lists: list) -> pa.Array:
    return pa.array(lists, pa.list_(pa.float64()))


def _summed(own: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """Sums of rows by code, exact, as Python's whole numbers."""
    if len(own) * int(np.abs(own).max(initial=0)) < 1 << 53:
        columns = [np.bincount(codes, own[:, j], entries) for j in range(own.shape[1])]
        return np.stack(columns, 1).astype(np.int64).astype(object) if columns else np.zeros((entries, 0), object)
    out = np.zeros((entries, own.shape[1]), object)
    np.add.at(out, codes, own.astype(object))
    return out


def _refined(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks of which each used entry is the mean of its parts, rounded down."""
    shared, width, entries = rows.sparkSession.sparkContext.broadcast(books), books[0].shape[1], len(books[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(shared.value)
        counts, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = vectors.widened(vectors.floored(batch.column("vector").slice(at, ROWS), FACTOR)[1], PARTS * width)
                codes, _ = code(own)
                for p in range(PARTS):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    sums[p] += _summed(own[:, p * width : (p + 1) * width], codes[:, p], entries)
        part, entry = np.nonzero(counts)
        added = [[Decimal(int(x)) for x in sums[p, e]] for p, e in zip(part, entry)]
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), pa.array(added, pa.list_(pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    found = rows.select("vector").mapInArrow(add, "part int, entry int, n long, sums array<decimal(38,0)>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    new = [b.copy() for b in books]
    for r in totals.collect():  # a row an entry at most
        new[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return new


def _vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    fit = F.col(vector_column).isNotNull() & ~F.exists(vector_column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(fit).select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))


def codebooks(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> list[np.ndarray]:
    """For each part position the entries after `ROUNDS` rounds over all vectors."""
    rows = _vectors(df, id_column, vector_column)
    books = _started(rows)
    for _ in range(ROUNDS if len(books[0]) else 0):
        books = _refined(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], vector_column: str = "embedding", found: str = "coded") -> DataFrame:
    """Rows of `df` that hold a vector, with a struct column `found`: the indexes of its parts' entries, and the error."""
    shared = df.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("struct<entries: binary, error: bigint>")
    def code(column: pa.Array) -> pa.Array:
        coder, parts = _coder(shared.value), []
        for at in range(0, len(column), ROWS):
            kept, own = vectors.floored(column.slice(at, ROWS), FACTOR)
            codes, errors = coder(own)
            total = np.minimum(sum(e.astype(object) for e in errors), LONGEST).astype(np.int64)
            made = pa.StructArray.from_arrays([pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(total, pa.int64())], ["entries", "error"])
            parts.append(made.take(pa.array(np.where(kept, np.cumsum(kept) - 1, 0), pa.int64(), mask=~kept)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct({"entries": pa.binary(), "error": pa.int64()}))

    return df.withColumn(found, code(F.col(vector_column).cast("array<double>"))).where(F.col(found).isNotNull())


def labelled(coded: DataFrame, label_column: str = "label", error: str = "error", name: str = "label_error") -> DataFrame:
    """`coded` with the sum of the errors of all rows of its label, nulls together; a label's rows are dealt in several ways."""
    plain = coded.columns
    total = F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col(label_column).alias("_label")).agg(total.alias("_total"))
    sums = sums.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("_dealt", F.pmod(F.xxhash64(*(c for c in plain if c != label_column)), F.lit(SALTS)).cast("int"))
    joined = dealt.join(sums, F.col(label_column).eqNullSafe(F.col("_label")) & (F.col("_dealt") == F.col("_way")), "left")
    return joined.select(*plain, F.col("_total").alias(name))
