"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Distinct fingerprints are sorted by Gray rank, so neighbours share long masked bit patterns, and cut
into blocks. Blocks are leaves of a tree whose upper nodes keep the bits that all fingerprints below
share. Pairs of nodes are expanded from the root by joins; a pair goes as soon as the shared bits of
both already differ in more places than allowed, which prunes whole groups at once. Surviving block
pairs go on the same way inside a task, over groups and then over single fingerprints, and give only
a forest of links (each fingerprint to the smallest one it hangs together with in that pair), never
all pairs of a group of near copies. The forests' components are the groups.

By default fingerprints link at `DISTANCE` bits, exactly. With a `similarity` instead, documents link
where their shingles' Jaccard index is estimated to reach it: sets of index J have fingerprints whose
bits differ with the chance arccos(2 J / (1 + J)) / pi. The tree then allows a pair of nodes as many
differences in the bits that both fix as `SLACK` deviations above that chance make, and pairs that
come through are held against `CHECK_WORDS` further words of fingerprint, `CHECK_SLACK` deviations wide.

Defined results: a null or empty text, or one of white space only, has fingerprint zero; equal rows
have equal results; a row without doc_id takes its group's component; an empty table gives no row;
other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
BLOCK, GROUP, FAN_OUT_BITS = 8192, 32, 3
#: Most left blocks that a task holds while right ones pass, ways that right blocks are dealt at least, and right blocks in one at most.
HELD, WAYS, PASSING, SALTS = 32, 4, 128, 8
#: Further words of a fingerprint, and deviations that a pair of the wanted similarity may be off.
CHECK_WORDS, SLACK, CHECK_SLACK = 16, 3.2, 2.4
#: Pairs that are checked at a time.
CHECKED = 20_000


def allowed(similarity: float | None, distance: int = DISTANCE) -> list[int]:
    """The most differences of a linked pair among some of its bits, by their number from 0."""
    if similarity is None:
        return [distance] * (BITS + 1)
    return [_differences(similarity, n, SLACK) for n in range(BITS + 1)]


def _differences(similarity: float, bits: int, slack: float) -> int:
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * chance + slack * math.sqrt(bits * chance * (1 - chance)))


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Hashes turned into others, one way for each further word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * word)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    return wide_fingerprint_of(text, words, 0)[0]


def wide_fingerprint_of(text: str | None, words: int, more: int) -> tuple[int, ...]:
    """The fingerprint of one text and `more` further words of it."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return (0,) * (1 + more)
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        digest, glue = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(glue(s), SEED) for s in zip(*(found[i:] for i in range(words)))]
    ones = np.zeros((1 + more, BITS), np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = np.array(hashes[at : at + (1 << 13)], "<u8")
        wide = np.stack([part, *(_mixed(part, k) for k in range(more))], 1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64).reshape(ones.shape)
    return tuple(np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel().tolist())


def fingerprint(text: Column, words: int = SHINGLE, more: int = 0) -> Column:
    """(fp, more): the fingerprint as a long, and the further words as bytes."""

    def rows(some: list[str | None]) -> pa.Array:
        prints = np.array([wide_fingerprint_of(t, words, more) for t in some], "<u8").reshape(len(some), 1 + more)
        rest = pa.array([row.tobytes() for row in prints[:, 1:]], pa.binary())
        return pa.StructArray.from_arrays([pa.array(prints[:, 0].copy().view(np.int64)), rest], ["fp", "more"])

    @F.arrow_udf("struct<fp:bigint,more:binary>")
    def prints(texts: pa.Array) -> pa.Array:
        return common.by_slices(texts, rows)

    return prints(text.cast("string"))


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in the Gray sequence, as a long whose order is that of the place."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _blocks(fps: DataFrame) -> DataFrame:
    """`fps(fp, more, name)` in Gray order as rows (part, seq, lo, hi, fps, more, names): AND and OR of the block, and its members."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, rest, named = TaskContext.get().partitionId(), 0, [], [], []

        def block() -> pa.RecordBatch:
            values, more = np.array(held[:BLOCK], np.int64), b"".join(rest[:BLOCK])
            row = [part], [seq], [np.bitwise_and.reduce(values)], [np.bitwise_or.reduce(values)], [values.tobytes()], [more], [np.array(named[:BLOCK], np.int64).tobytes()]
            kinds = (pa.int64(),) * 4 + (pa.binary(),) * 3
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "seq", "lo", "hi", "fps", "more", "names"])

        for batch in batches:
            held += batch.column("fp").to_pylist()
            rest += batch.column("more").to_pylist()
            named += batch.column("name").to_pylist()
            while len(held) >= BLOCK:
                yield block()
                seq += 1
                del held[:BLOCK], rest[:BLOCK], named[:BLOCK]
        if held:
            yield block()

    order = gray_rank(F.col("fp"))
    dealt = fps.select("fp", "more", "name", order.alias("rank")).repartitionByRange(common.partitions(fps.sparkSession), "rank").sortWithinPartitions("rank")
    return dealt.select("fp", "more", "name").mapInArrow(cut, "part long, seq long, lo long, hi long, fps binary, more binary, names binary")


def _may_link(a: str, b: str, most: list[int]) -> Column:
    """Whether the bits in which all fingerprints below two nodes are alike differ in few enough places."""
    mixed = [F.col(f"{x}_lo").bitwiseXOR(F.col(f"{x}_hi")) for x in (a, b)]
    fixed = F.bitwise_not(mixed[0].bitwiseOR(mixed[1]))
    apart = F.bit_count(F.col(f"{a}_lo").bitwiseXOR(F.col(f"{b}_lo")).bitwiseAND(fixed))
    return apart <= F.element_at(F.array(*map(F.lit, most)), F.bit_count(fixed) + 1)


def _block_pairs(blocks: DataFrame, most: list[int]) -> DataFrame:
    """Pairs (a, b), a <= b, of block numbers whose fingerprints may link; traversed from the root."""
    levels = [common.cut(blocks.select(F.col("block").alias("node"), "lo", "hi"))]
    while levels[-1].count() > 1:
        up = levels[-1].groupBy(F.shiftright("node", FAN_OUT_BITS).alias("node")).agg(F.bit_and("lo").alias("lo"), F.bit_or("hi").alias("hi"))
        levels.append(common.cut(up))
    pairs = levels.pop().select(F.col("node").alias("a"), F.col("node").alias("b"))
    while levels:
        below = levels.pop()
        child = lambda x: below.select(F.shiftright("node", FAN_OUT_BITS).alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "lo", "hi")))  # noqa: B023, E731
        pairs = pairs.join(child("a"), "a").join(child("b"), "b").where((F.col("a_node") <= F.col("b_node")) & _may_link("a", "b", most))
        pairs = common.cut(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return pairs


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the labels of the nodes of links (a, b); labels point to the smallest node at last."""
    while True:
        one, two = label[a], label[b]
        differ = one != two
        if not differ.any():
            return
        a, b, one, two = a[differ], b[differ], one[differ], two[differ]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def _forest(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None, most: list[int], check: int) -> np.ndarray:
    """Links within a block (right is None) or between two as pairs (member, smallest place hung to).

    A block is its fingerprints, their further words, which may differ in `check` places, and the nodes' names.
    """
    _, more, nodes = left if right is None else (np.concatenate(x) for x in zip(left, right))
    label = np.arange(len(nodes))
    shift = 0 if right is None else len(left[0])
    limit = np.array(most, np.uint8)

    def groups(values: np.ndarray, base: int):
        n = -(-len(values) // GROUP)
        places = np.minimum(np.arange(n * GROUP), len(values) - 1).reshape(n, GROUP)
        own = values[places]
        return own, places + base, np.bitwise_and.reduce(own, 1), np.bitwise_or.reduce(own, 1)

    one, one_at, one_lo, one_hi = groups(left[0], 0)
    two, two_at, two_lo, two_hi = (one, one_at, one_lo, one_hi) if right is None else groups(right[0], shift)
    sure = ~(one_lo ^ one_hi)[:, None] & ~(two_lo ^ two_hi)[None, :]
    near = np.bitwise_count((one_lo[:, None] ^ two_lo[None, :]) & sure) <= limit[np.bitwise_count(sure)]
    if right is None:
        near = np.triu(near)
    ga, gb = np.nonzero(near)
    for at in range(0, len(ga), 512):
        a, b = ga[at : at + 512], gb[at : at + 512]
        la, lb = label[one_at[a]], label[two_at[b]]
        joined = (la == la[:, :1]).all(1) & (lb == la[:, :1]).all(1)  # these hang together already
        a, b = a[~joined], b[~joined]
        found = np.bitwise_count(one[a][:, :, None] ^ two[b][:, None, :]) <= limit[-1]
        k, i, j = np.nonzero(found)
        i, j = one_at[a[k], i], two_at[b[k], j]
        if not more.shape[1]:
            hook(label, i, j)
            continue
        for begin in range(0, len(i), CHECKED):
            x, y = i[begin : begin + CHECKED], j[begin : begin + CHECKED]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            fine = np.bitwise_count(more[x] ^ more[y]).sum(1, dtype=np.int64) <= check
            hook(label, x[fine], y[fine])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([nodes[moved], nodes[label[moved]]], 1)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """A forest (a, b) of nodes `fps(fp, more, name)` that hangs together as the links do; a fingerprint without a name is its own.

    Left blocks are dealt to groups of a few; a right block is sent once to each group that asks for it.
    """
    spark, most = fps.sparkSession, allowed(similarity, distance)
    fps = fps if "more" in fps.columns else fps.withColumn("more", F.lit(b""))
    fps = fps if "name" in fps.columns else fps.withColumn("name", F.col("fp"))
    check = 0 if similarity is None else _differences(similarity, BITS * CHECK_WORDS, CHECK_SLACK)
    blocks = common.keep(_blocks(fps), "gray-blocks")
    numbered = common.numbered(blocks)  # in Gray order
    pairs = _block_pairs(numbered.drop("fps", "more", "names"), most)
    members = numbered.select("block", "fps", "more", "names")
    n = members.count()
    held, ways = max(1, min(HELD, n // 8)), max(WAYS, -(-n // PASSING))
    place = [F.floor(F.col("a") / held).cast("long").alias("group"), F.pmod("b", F.lit(ways)).alias("way")]
    asked = pairs.groupBy(*place, F.col("b").alias("block")).agg(F.collect_list("a").alias("asks"))  # at most `held` of them
    left = pairs.select(*place, F.col("a").alias("block")).distinct().withColumn("asks", F.lit(None).cast("array<long>"))
    sent = asked.unionByName(left).join(members, "block")
    dealt = sent.withColumn("right", F.col("asks").isNotNull()).repartition(common.partitions(spark), "group", "way").sortWithinPartitions("group", "way", "right", "block")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lefts = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("group", "way", "block", "asks", "fps", "more", "names")}
                if (row["group"], row["way"]) != now:
                    now, lefts = (row["group"], row["way"]), {}
                values = np.frombuffer(row["fps"], np.uint64)
                values = values, np.frombuffer(row["more"], np.uint64).reshape(len(values), -1), np.frombuffer(row["names"], np.int64)
                if row["asks"] is None:
                    lefts[row["block"]] = values
                for a in row["asks"] or []:
                    found = _forest(lefts[a], None if a == row["block"] else values, most, check)
                    if len(found):
                        one, two = found.T.copy()
                        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])

    return dealt.mapInArrow(links, "a long, b long")


def classes(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """For every row of `docs(doc_id, text)`: doc_id, mix (a hash of the text), fp, and root, the same for all rows of a group.

    By similarity a node is a fingerprint with its further words, under a hash of both: rows that share the
    fingerprint only are compared by those like any others.
    """
    more = CHECK_WORDS if similarity is not None else 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mix"), fingerprint(F.col("text"), words, more).alias("print"))
    name = F.col("fp") if similarity is None else F.xxhash64("fp", "more")
    rows = common.keep(rows.select("doc_id", "mix", "print.*").withColumn("name", name), "fingerprints")
    nodes = common.keep(rows.groupBy("name", "fp", "more").count().drop("count"), "fingerprint-nodes")
    links = common.keep(fingerprint_links(nodes, distance, similarity), "gray-links")
    groups = common.components(links).select(F.col("id").alias("name"), F.col("component").alias("root"))
    return rows.drop("more").join(groups, "name", "left").select("doc_id", "mix", "fp", F.coalesce("root", "name").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """For every row of `docs(doc_id, text)`: doc_id, fingerprint as 16 hex digits, component_id."""
    rows = common.keep(classes(docs, distance, words, similarity), "fingerprint-classes")
    # Copies are one node before groups are joined, and groups are dealt in several ways, as one may be large.
    nodes = rows.groupBy("fp", "root").agg(F.min("doc_id").alias("first")).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = common.keep(nodes.join(least, ["root", "salt"]).select("fp", "component_id"), "fingerprint-groups")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of `docs` with one of each group: that of the least doc_id (null is last), then of the least hash of its text."""
    rows = common.keep(classes(docs, distance, words, similarity), "fingerprint-classes")
    # The first row of each group, and how many rows equal it; only those few are brought together.
    equal = rows.groupBy("root", "doc_id", "mix").agg(F.count("*").alias("n"))
    first = equal.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mix", "n")).alias("f"))
    # Names that the documents don't have.
    own_id, own_mix, n, mix = (common.fresh(c, docs) for c in ("chosen_id", "chosen_mix", "chosen_rows", "text_mix"))
    counted = common.keep(first.select(F.col("f.doc_id").alias(own_id), F.col("f.mix").alias(own_mix), F.col("f.n").alias(n)), "chosen")
    hashed = docs.withColumn(mix, F.xxhash64(F.col("text").cast("string")))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(mix) == F.col(own_mix))
    single = hashed.join(counted.where(F.col(n) == 1), match, "left_semi")
    repeated = hashed.join(counted.where(F.col(n) > 1), match, "left_semi").dropDuplicates(["doc_id", mix])
    return single.unionByName(repeated).drop(mix)
