"""Near-duplicate embeddings by NN-descent on a neighbour graph.

Exact copies become one vertex with a weight. Vertices get first neighbours from sorted sequences of
random sign codes, in several tables, each vertex with the `WINDOW` next ones (of the same task; what
a task's border parts stands together in other tables). A list keeps its `LIST` best neighbours,
however far they are, and is doubled while it is saturated with links, up to `LONGEST`. Then the graph is
refined: every vertex compares the neighbours that its lists hold, forward and backward, with each
other, where one of the two is new since the round before; a pair that improves the list of either
replaces what is there. Rounds end when few neighbours have been replaced. Lists steer the search only:
every link that it meets goes to the components, as a forest for each vertex's neighbours.

Recall is audited in two ways. A sample of vertices is compared with all vertices: the share of their
links that lead into their own component, by link and by vertex. And probes take part in the search:
copies of some vertices turned by just the angle of a link, the hardest to find, each of which must
find its vertex; they count where links are too rare for the sample. While recall is under `RECALL`, more tables are
searched, `ATTEMPTS` times at most; what an audit finds is kept. So up to one in two hundred links may be
lost, or more where the audit says so in its column; with `closing` every vertex is compared with every
other instead, block by block, whenever recall is under 1: exact, and quadratic.

Links hang vertices together to components. Within a component, in blocks of bounded size, links
are counted exactly, so a count never depends on how long a list was and no pairs are written out.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; a shorter vector counts as ending in zeros; rows that repeat a vec_id count as vertices of
their own; a row without vec_id takes part and has its component's smallest id; an empty table gives
no row; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import common, simhash_gray, vectors

THRESHOLD = 0.9
TABLES, CODE_BITS, WINDOW = 12, 24, 4
LIST, LONGEST, ROUNDS, STILL = 8, 64, 2, 0.02
#: Neighbours of a vertex that meet in a round, others in each, and ways that a component is dealt.
MEETING, SALTS = 20, 16
#: Searches at most; recall that ends them, and linked vertices that show it in a sample.
ATTEMPTS, RECALL, LINKED = 6, 0.995, 200
#: Vertices in the sample of an audit, and most bytes of them; probes, and vertices that have none.
AUDIT, AUDIT_BYTES, PROBES = 2048, 16_000_000, 1024
#: Vertices in a block of link counts and of the closing pass, and how many are compared at a time.
BLOCK, CLOSING, SLICE = 4096, 4096, 512


def _unit(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows (id, unit): the unit vector in double precision as bytes, null where it links with nothing."""

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        values, begin, end = vectors.lists(column)
        out = []
        for b, e in zip(begin.tolist(), end.tolist()):
            own = values[b:e]
            top = np.abs(own).max(initial=0.0)
            if not (0 < top < np.inf):  # also false for NaN
                out.append(None)
                continue
            own = own / top
            out.append((own / np.sqrt(own @ own) + 0.0).astype("<f8").tobytes())
        return pa.array(out, pa.binary())

    return df.select(F.col(id_column).cast("long").alias("id"), pack(F.col(vector_column).cast("array<double>")).alias("unit"))


def _codes(first_table: int, tables: int):
    """Codes of a vector in some tables: signs of products with random planes, the table on top."""

    @F.arrow_udf("array<bigint>")
    def codes(column: pa.Array) -> pa.Array:
        units = vectors.matrix(column.to_pylist())
        powers = 1 << np.arange(CODE_BITS)[::-1]
        out = np.empty((len(units), tables), np.int64)
        for t in range(tables):
            planes = np.random.default_rng(7919 + first_table + t).standard_normal((max(1, units.shape[1]), CODE_BITS))
            out[:, t] = ((units @ planes[: units.shape[1]] > 0) @ powers) + ((first_table + t) << CODE_BITS)
        return pa.array(list(out), pa.list_(pa.int64()))

    return codes


def _seeds(nodes: DataFrame, first_table: int, tables: int) -> DataFrame:
    """Pairs (a, b, s) of vertices that stand near each other in a table."""

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_ids, tail_units = [], []
        for batch in batches:
            ids, units = tail_ids + batch.column("node").to_pylist(), tail_units + batch.column("unit").to_pylist()
            rows, keys = vectors.matrix(units), np.array(ids)
            a, b, s = [], [], []
            for gap in range(1, min(WINDOW, len(keys) - 1) + 1):
                fresh = slice(max(0, len(tail_ids) - gap), None)  # pairs within the tail have been given
                a.append(keys[:-gap][fresh])
                b.append(keys[gap:][fresh])
                s.append(np.einsum("ij,ij->i", rows[:-gap][fresh], rows[gap:][fresh]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], ["a", "b", "s"])
            tail_ids, tail_units = ids[-WINDOW:], units[-WINDOW:]

    n = common.partitions(nodes.sparkSession)
    coded = nodes.select("node", "unit", F.explode(_codes(first_table, tables)("unit")).alias("code"))
    dealt = coded.repartitionByRange(n, "code", "node").sortWithinPartitions("code", "node")
    return dealt.select("node", "unit").mapInArrow(window, "a long, b long, s double").where("a <> b")


def _lists(pairs: DataFrame, threshold: float) -> DataFrame:
    """The best neighbours (a, b, s, new) of every vertex from pairs (a, b, s, new) taken both ways; a pair is new unless it was there before."""
    both = pairs.union(pairs.select("b", "a", "s", "new")).toDF("a", "b", "s", "new").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LONGEST)
    # A list is doubled while it is full of links, and no longer than that.
    links = F.count(F.when(F.col("s") >= threshold, 1)).over(Window.partitionBy("a"))
    size = F.least(F.lit(LONGEST), F.lit(LIST) * F.pow(F.lit(2), F.ceil(F.log2((F.col("links") + 1) / F.lit(LIST)))))
    length = F.when(F.col("links") < LIST, F.lit(LIST)).otherwise(size)
    return ranked.withColumn("links", links).where(F.col("rank") <= length).select("a", "b", "s", "new")


def _refined(lists: DataFrame, nodes: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs (a, b, s, link) found by comparing neighbours of every vertex with each other.

    `MEETING` of them meet, new ones before others, by a hash that each turn changes. Of those in which one
    is new each gives its `LIST` best pairs that would improve its own list or the other's, and all links
    among them are given as a forest (`link` true), so a group of near copies never writes all its pairs.
    """
    around = lists.select("a", "b", "new").union(lists.select("b", "a", "new")).toDF("a", "b", "new").groupBy("a", "b").agg(F.max("new").alias("new"))
    order = Window.partitionBy("a").orderBy(F.desc("new"), F.xxhash64("a", "b", F.lit(turn)))
    around = around.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MEETING)
    # What a pair must be better than to come into a vertex's list.
    least = lists.groupBy("a").agg(F.when(F.count("*") >= LIST, F.min("s")).otherwise(F.lit(-2.0)).alias("least"))
    held = nodes.select(F.col("node").alias("b"), "unit").join(least.withColumnRenamed("a", "b"), "b")
    joined = around.join(held, "b").select("a", "b", "new", "unit", "least")

    def compared(a: np.ndarray, keys: np.ndarray, new: np.ndarray, least: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """The pairs of whole groups, which follow each other by `a`."""
        begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(a))))
        seat = np.arange(len(a)) - begin[group]
        width = int(seat.max()) + 1
        at = np.full((len(begin), width), -1)
        at[group, seat] = np.arange(len(a))
        near = rows[at] @ rows[at].transpose(0, 2, 1)
        there = at >= 0
        near[~(there[:, :, None] & there[:, None, :])] = -2.0
        near[:, np.arange(width), np.arange(width)] = -2.0
        # Probes hang on vertices, but no two vertices on a probe.
        probe = (keys < 0)[at]
        link = (near >= threshold) & ~probe[:, None, :]
        label = np.arange(len(a))
        g, i, j = np.nonzero(link & ~probe[:, :, None])
        simhash_gray.hook(label, at[g, i], at[g, j])
        g, i = np.nonzero(link.any(2) & probe)
        label[at[g, i]] = at[g, np.where(link[g, i], near[g, i], -2.0).argmax(1)]
        fresh = new[at]
        near[~(fresh[:, :, None] | fresh[:, None, :])] = -2.0
        best = np.argpartition(-near, min(LIST, width) - 1, 2)[:, :, :LIST]
        value = np.take_along_axis(near, best, 2)
        bar = np.minimum(least[at][:, :, None], least[at[np.arange(len(at))[:, None, None], best]])
        g, i, k = np.nonzero((value > bar) & (value > -2.0))
        one, two = at[g, i], at[g, best[g, i, k]]
        moved = np.flatnonzero(label != np.arange(len(a)))
        left, right = np.concatenate([keys[one], keys[moved]]), np.concatenate([keys[two], keys[label[moved]]])
        found = np.concatenate([value[g, i, k], np.ones(len(moved))])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(found), pa.array(np.arange(len(found)) >= len(one))], ["a", "b", "s", "link"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "new", "least")] + [vectors.matrix(batch.column("unit").to_pylist())]
            if tail is not None and len(tail[0]):
                width = max(tail[4].shape[1], own[4].shape[1])
                own = [np.concatenate(x) for x in zip(tail[:4], own[:4])] + [np.concatenate([vectors.widened(tail[4], width), vectors.widened(own[4], width)])]
            if len(own[0]):
                whole = int(np.searchsorted(own[0], own[0][-1]))  # the last group may go on
                if whole:
                    yield compared(*(x[:whole] for x in own))
                own = [x[whole:] for x in own]
            tail = own
        if tail is not None and len(tail[0]):
            yield compared(*tail)

    dealt = joined.repartition(common.partitions(nodes.sparkSession), "a").sortWithinPartitions("a")
    return dealt.select("a", "b", F.col("new").cast("boolean").alias("new"), "least", "unit").mapInArrow(meet, "a long, b long, s double, link boolean")


def _search(nodes: DataFrame, lists: DataFrame | None, first_table: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """The lists after seeds from `TABLES` more tables and rounds of refinement, and all links met."""
    seeds = common.keep(_seeds(nodes, first_table, TABLES), "seeds")
    links = [seeds.where(F.col("s") >= threshold).select("a", "b")]
    fresh = seeds.withColumn("new", F.lit(1))
    old = lambda known: known.select("a", "b", "s", F.lit(0).alias("new"))
    lists = common.cut(_lists(fresh if lists is None else old(lists).union(fresh), threshold))
    for turn in range(ROUNDS):
        found = common.keep(_refined(lists, nodes, threshold, first_table + turn), "refined")
        links.append(found.where("link").select("a", "b"))
        lists = common.cut(_lists(old(lists).union(found.where("not link").select("a", "b", "s", F.lit(1).alias("new"))), threshold))
        held, replaced = lists.agg(F.count("*"), F.sum("new")).first()
        if (replaced or 0) <= STILL * held:
            break
    return lists, links


def _probes(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, unit, origin): some vertices, by least hash, turned by the angle of a link in a random direction. Their names are below zero."""
    some = nodes.withColumn("h", F.xxhash64("node", F.lit(17))).orderBy("h", "node").limit(PROBES).select("node", "unit")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, blob in zip(batch.column("node").to_pylist(), batch.column("unit").to_pylist()):
                unit = np.frombuffer(blob, "<f8")
                way = np.random.default_rng(node).standard_normal(len(unit))
                way -= unit * (way @ unit)
                size = np.sqrt(way @ way)
                # A hair within the threshold, so that rounding can't put it outside.
                cosine = min(1.0, threshold + 1e-9)
                out.append((cosine * unit + np.sqrt(1 - cosine * cosine) * way / size if size > 1e-9 else unit).astype("<f8").tobytes())
            origin = batch.column("node")
            yield pa.RecordBatch.from_arrays([pa.array([-1 - n for n in origin.to_pylist()], pa.int64()), pa.array(out, pa.binary()), origin], ["node", "unit", "origin"])

    return some.mapInArrow(turn, "node long, unit binary, origin long")


def _audit(placed: DataFrame, n: int, size: int, seed: int, threshold: float) -> tuple[int, float, DataFrame]:
    """Of `size` vertices out of `n`: how many have a link, the share of links within components, and the others.

    The sample, bounded by `AUDIT` and `AUDIT_BYTES`, is broadcast and meets all vertices of
    `placed(node, unit, component)`; a batch gives a row a vertex asked and each pair of components once.
    """
    spark = placed.sparkSession
    # By least hash; what is left out before the sort is far above the sample's last hash.
    share = (1.25 * size + 100) / max(1, n)
    rows = placed.withColumn("h", F.xxhash64("node", F.lit(seed))).where(F.col("h") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    asked = rows.orderBy("h", "node").limit(size).collect()
    nodes, comps = (np.array([r[name] for r in asked], np.int64) for name in ("node", "component"))
    shared = spark.sparkContext.broadcast((nodes, comps, vectors.matrix([r["unit"] for r in asked])))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, comps, queries = shared.value
        for batch in batches:
            links, same, apart = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), []
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                own, where, units = part.column("node").to_numpy(), part.column("component").to_numpy(), vectors.matrix(part.column("unit").to_pylist())
                width = min(queries.shape[1], units.shape[1])  # a shorter vector ends in zeros
                i, j = np.nonzero(queries[:, :width] @ units[:, :width].T >= threshold)
                other = nodes[i] != own[j]
                i, j = i[other], j[other]
                inside = comps[i] == where[j]
                links += np.bincount(i, minlength=len(nodes))
                same += np.bincount(i[inside], minlength=len(nodes))
                apart.append(np.stack([comps[i[~inside]], where[j[~inside]]]))
            hit = np.flatnonzero(links)
            pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *apart], 1), axis=1)
            gone = [None] * pairs.shape[1]
            rows = {"a": [*nodes[hit].tolist(), *pairs[0].tolist()], "b": [None] * len(hit) + pairs[1].tolist(), "links": [*links[hit].tolist(), *gone], "same": [*same[hit].tolist(), *gone]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    found = common.keep(placed.select("node", "component", "unit").mapInArrow(ask, "a long, b long, links long, same long"), "audit")
    each = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"), F.sum("same").alias("same"))
    n, by_vertex, links, same = each.agg(F.count("*"), F.avg(F.col("same") / F.col("links")), F.sum("links"), F.sum("same")).first()
    return n, min(by_vertex, same / links) if n else 1.0, found.where("b is not null").select("a", "b")


def _missed(placed: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components of `placed(node, unit, component)`, a forest for every two blocks.

    All vertices are compared with all others, block by block, so no link between two components is left
    out, however the search went. Blocks are rows of bounded size in the shared folder.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, where, units = TaskContext.get().partitionId() << 32, 0, [], []

        def block(n: int) -> pa.RecordBatch:
            own = vectors.matrix(units[:n])
            row = [part + seq], [np.array(where[:n], "<i8").tobytes()], [np.ascontiguousarray(own).tobytes()], [own.shape[1]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["block", "comps", "units", "dims"])

        for batch in batches:
            where += batch.column("component").to_pylist()
            units += batch.column("unit").to_pylist()
            while len(where) >= CLOSING:
                yield block(CLOSING)
                seq += 1
                del where[:CLOSING], units[:CLOSING]
        if where:
            yield block(len(where))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                comps = [np.frombuffer(row[f"{x}_comps"], "<i8") for x in "ab"]
                units = [np.frombuffer(row[f"{x}_units"], "<f8").reshape(len(c), row[f"{x}_dims"]) for x, c in zip("ab", comps)]
                width = min(u.shape[1] for u in units)  # a shorter vector ends in zeros
                names, at = np.unique(np.concatenate(comps), return_inverse=True)
                left, right = at[: len(comps[0])], at[len(comps[0]) :]
                label = np.arange(len(names))
                for begin in range(0, len(left), SLICE):
                    own = left[begin : begin + SLICE]
                    link = units[0][begin : begin + SLICE, :width] @ units[1][:, :width].T >= threshold
                    i, j = np.nonzero(link)
                    apart = label[own[i]] != label[right[j]]
                    simhash_gray.hook(label, own[i[apart]], right[j[apart]])
                moved = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["a", "b"])

    tasks = max(1, -(-placed.count() // CLOSING))
    blocks = common.keep(placed.select("component", "unit").repartition(tasks).mapInArrow(cut, "block long, comps binary, units binary, dims long"), "closing-blocks")
    one, two = (blocks.select(*(F.col(c).alias(f"{x}_{c}") for c in blocks.columns)) for x in "ab")
    pairs = one.hint("shuffle_replicate_nl").join(two, F.col("a_block") <= F.col("b_block"))
    return pairs.mapInArrow(compare, "a long, b long")


def _placed(nodes: DataFrame, links: list[DataFrame]) -> DataFrame:
    """`nodes` with the component that the links give each."""
    groups = common.components(reduce(DataFrame.union, links)).withColumnRenamed("id", "node")
    return common.keep(nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")


def _merged(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """`placed` after pairs of its components have been joined."""
    more = common.components(pairs).select(F.col("id").alias("component"), F.col("component").alias("next"))
    joined = placed.join(more, "component", "left").withColumn("component", F.coalesce("next", "component"))
    return common.keep(joined.drop("next"), "merged")


def _caught(placed: DataFrame, probes: DataFrame, links: list[DataFrame]) -> tuple[int, int]:
    """How many probes there are, and how many have a link into their vertex's component."""
    met = reduce(DataFrame.union, links).where("a < 0 or b < 0").select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("b")).distinct()
    own = placed.select("node", "component")
    wanted = probes.select("node", F.col("origin")).join(own.toDF("origin", "wanted"), "origin")
    found = met.join(own.toDF("b", "found"), "b").join(wanted, "node").where("found = wanted").select("node").distinct()
    return probes.count(), found.count()


def _grouped(nodes: DataFrame, threshold: float, closing: bool) -> tuple[DataFrame, float]:
    """`nodes` with their components, and the recall that was shown (1 where every vertex was asked)."""
    n, width = nodes.agg(F.count("*"), F.max(F.octet_length("unit"))).first()
    size = max(1, min(AUDIT, AUDIT_BYTES // max(1, width or 0)))
    probes = common.keep(_probes(nodes, threshold), "probes")
    searched = common.keep(nodes.select("node", "unit").union(probes.select("node", "unit")), "searched")
    lists, links = None, []
    for attempt in range(ATTEMPTS):
        lists, found = _search(searched, lists, attempt * TABLES, threshold)
        links += found
        placed = _placed(nodes, [x.where("a >= 0 and b >= 0") for x in links])
        asked, hit = _caught(placed, probes, links)
        linked, recall, missed = _audit(placed, n, size, attempt, threshold)
        shown = recall if linked >= LINKED else hit / asked if asked else 1.0
        if size >= n:
            return _merged(placed, missed), 1.0
        # A component is named by one of its vertices, so what was missed is a link for the next attempt.
        links.append(common.keep(missed, "missed"))
        if shown >= RECALL:
            break
    placed = _merged(placed, missed)
    if closing and shown < 1:
        return _merged(placed, common.keep(_missed(placed, threshold), "missed-links")), 1.0
    return placed, shown


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, near): the weight of each vertex's links, from `members(component, node, unit, weight, vertices)`.

    A component, of which `vertices` counts the members, is dealt into blocks by hash, and every two
    blocks of it meet once.
    """
    blocks = F.ceil(F.col("vertices") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("component", "node", "unit", "weight", "own", other)
    pairs = pairs.select("component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).alias("right"), "node", "unit", "weight")
    # Dealt by all three: left to itself Spark keeps a component's pairs of blocks in one task.
    pairs = pairs.repartition(common.partitions(members.sparkSession), "component", "one", "two")

    def count(group: pa.Table) -> pa.Table:
        rows, ids = vectors.matrix(group["unit"].to_pylist()), group["node"].to_numpy()
        weight, right = group["weight"].to_numpy(), group["right"].to_numpy(zero_copy_only=False)
        same = group["one"][0].as_py() == group["two"][0].as_py()
        left = np.arange(len(ids)) if same else np.flatnonzero(~right)
        there = left if same else np.flatnonzero(right)
        near, back, units = [], np.zeros(len(there), np.int64), rows[there].T
        for at in range(0, len(left), SLICE):
            own = left[at : at + SLICE]
            link = rows[own] @ units >= threshold
            link &= ids[own][:, None] != ids[there][None, :]
            near.append(link @ weight[there])
            back += weight[own] @ link
        near = np.concatenate([np.zeros(0, np.int64), *near])
        if same:
            return pa.table({"node": ids, "near": near})
        return pa.table({"node": np.concatenate([ids[left], ids[there]]), "near": np.concatenate([near, back])})

    return pairs.groupBy("component", "one", "two").applyInArrow(count, "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))


def near_duplicates(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, closing: bool = False) -> DataFrame:
    """For every row: vec_id, n_links, component_id, kept, and the audited recall of the search."""
    rows = common.keep(_unit(df, id_column, vector_column), "units")
    # A vertex is a distinct vector, named by a number of its own.
    distinct = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("weight"), F.min("id").alias("first"))
    nodes = common.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "vertices")
    whole, recall = _grouped(nodes, threshold, closing)
    # Components of more than one vertex are dealt in several ways, so that a large one is no single task.
    sizes = whole.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("vertices")).where("vertices > 1")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    whole = common.keep(salted.join(sizes, ["component", "salt"], "left").drop("salt").withColumn("component_id", F.when(F.col("vertices") > 1, F.col("component_id")).otherwise(F.col("first"))), "classes")
    counted = common.keep(_counts(whole.where("vertices > 1").select("component", "node", "unit", "weight", "vertices"), threshold), "link-counts")
    classes = whole.join(counted, "node", "left")
    classes = classes.select("unit", "component_id", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    linked = rows.where("unit is not null").join(classes, "unit").select("id", "n_links", "component_id")
    alone = rows.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = linked.unionByName(alone)
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall")
    )
