"""A training mix of sources to target weights that may change over time.

Sources, in order of their code points, have weights and schedules by turns: a schedule says how much a
source weighs at equal steps of the training, straight lines between. Its integral, scaled to the
source's target, is the words that the mix has asked of the source up to a time. Documents of a source
stand one after the other, by a hash of their ids, and once more where the target is above the
source's size; a document's place in that row is the demand at which its turn comes, so the inverse of
the demand gives its position, a time from 0 to 1. Documents in order of position are the curriculum:
at any time each source has given what was asked of it, within a document.

Targets share `SHARE` of all words by weight; none is above `MOST` times its source's size, and what is
over goes to the others by weight until none is above: what a unit of weight gets is raised until the
targets of sources below their bound take the rest. Of the last document of a source only as many words
are taken as the target still asks for, so a source's words are its target without the fraction.

Words are counted once and kept beside a document's id and source. Places in the row of a source come
from sums over buckets of the hash, so no source is one task: a window in each bucket, of bounded size,
and one over the buckets. Rows alike in source, id and size are one row with a count until places are given.

Defined results: a null or empty text, or one of blanks, has no word, takes none and has no position;
a null source is one of its own, the last; sources without words have target 0; documents without an id
take part; repeated rows take part each; an empty table gives no row. Rows alike in everything are told apart
only by what they take. Other columns are left alone; join the result by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SHARE, MOST = 1.5, 2
#: Rows of a bucket of the hash, about.
BUCKET_ROWS = 1024


@dataclass(frozen=True)
class Schedule:
    """A source's weight, and how it is spread over the training: relative weights at equal steps."""

    weight: float
    knots: tuple[float, ...] = (1.0, 1.0)

    def __post_init__(self):
        if len(self.knots) < 2 or min(self.knots) < 0 or max(self.knots) <= 0 or not self.weight > 0:
            raise ValueError(f"no schedule: {self}")


#: Heavy sources rise, light ones fall.
SCHEDULES = (Schedule(5, (0.5, 1.5)), Schedule(2), Schedule(1, (1.5, 0.5)))


def demand(knots: Column, t: Column) -> Column:
    """The share of a schedule's integral up to time `t`, from 0 to 1."""
    steps = F.size(knots) - 1
    at = t * steps
    i = F.least(F.floor(at).cast("int"), steps - 1)
    before = F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda s, k: s + F.when(k <= i, (F.get(knots, k - 1) + F.get(knots, k)) / 2).otherwise(0.0))
    x = at - i
    a, b = F.get(knots, i), F.get(knots, i + 1)
    return (before + a * x + (b - a) * x * x / 2) / _whole(knots)


def _whole(knots: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), F.lit(0.0), lambda s, k: s + (F.get(knots, k - 1) + F.get(knots, k)) / 2)


def position(knots: Column, share: Column) -> Column:
    """The time at which a schedule has asked for `share` (0 to 1) of its integral: `demand` turned round.

    Steps that are full are counted; in the next one the straight line's integral is a quadratic.
    """
    wanted = share * _whole(knots)
    steps = F.size(knots) - 1
    empty = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"))

    def passed(s: Column, k: Column) -> Column:
        after = s["sum"] + (F.get(knots, k - 1) + F.get(knots, k)) / 2
        return F.when((after <= wanted) & (k < steps) & (s["i"] == k - 1), F.struct(k.alias("i"), after.alias("sum"))).otherwise(s)

    def within(s: Column) -> Column:
        a, b = F.get(knots, s["i"]), F.get(knots, s["i"] + 1)
        rest = wanted - s["sum"]
        root = a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * rest))
        return F.least(F.lit(1.0), (s["i"] + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0))) / steps)

    return F.aggregate(F.sequence(F.lit(1), steps), empty, passed, within)


def targets(sizes: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`sizes(source, source_size, rows)` with knots and target, for any number of sources."""
    ranked = common.positions(sizes.withColumns({"_all": F.lit(0), "_last": F.col("source").isNull()}), "_all", ["_last", "source"], "_rank").drop("_all", "_last")
    turn = F.pmod(F.col("_rank"), F.lit(len(schedules))).cast("int")
    weights = F.array(*(F.lit(float(s.weight)) for s in schedules))
    knots = F.array(*(F.array(*(F.lit(float(k)) for k in s.knots)) for s in schedules))
    known = common.keep(ranked.select("source", "source_size", "rows", F.get(weights, turn).alias("_weight"), F.get(knots, turn).alias("knots")), "sources")
    cap, weight = F.col("source_size") * most, F.col("_weight")
    all_words = known.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # what a unit of weight gets; each turn bounds more sources
        over = (cap < level * weight) if capped >= 0 else F.lit(False)
        now, held, free = known.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(~over, weight))).first()
        if now == capped or not free:
            break
        level, capped = (share * all_words - held) / free, now
    return known.select("source", "source_size", "rows", "knots", F.least(cap.cast("double"), F.lit(level) * weight).alias("target"))


def mixed(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", schedules: tuple[Schedule, ...] = SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """For every document: doc_id, source, size, source_size, target, and what the mix takes of it.

    `takes` is an array of (copy, position, words), the first time and, where a source is taken more than
    once, the others; it is empty where the mix does without the document.
    """
    doc_id, source = F.col(id_column), F.col(source_column).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    # Null is a key like any other, and joins need no more than equality.
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    sized = common.keep(docs.select(doc_id.alias("doc_id"), source.alias("source"), key.alias("key"), size.alias("size"), place.alias("place")), "sizes")
    goals = common.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), schedules, share, most), "targets")
    rows = goals.agg(F.sum("rows")).first()[0] or 0
    digits = 0
    while 16**digits * BUCKET_ROWS < rows:
        digits += 2
    once = sized.groupBy("key", "source", "doc_id", "place", "size").agg(F.count("*").alias("n")).withColumn("bucket", F.substring("place", 1, digits))
    own = Window.partitionBy("key", "bucket").orderBy("place", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(own), F.lit(0)))
    joined = placed.join(_starts(sized, goals, digits), ["key", "bucket"])
    copies = joined.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    offset = F.col("start") + F.col("before") + F.col("i") * F.col("size")

    def take(c: Column) -> Column:
        begin = c * F.col("source_size") + offset
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin)).cast("long")
        at = F.when(words > 0, position(F.col("knots"), begin / F.col("target")))
        return F.struct(c.cast("int").alias("copy"), at.alias("position"), words.alias("words"))

    takes = F.filter(F.array(*(take(F.lit(c)) for c in range(most))), lambda x: x["words"] > 0)
    return copies.select("doc_id", "source", "size", "source_size", "target", takes.alias("takes"))


def _starts(sized: DataFrame, goals: DataFrame, digits: int) -> DataFrame:
    """(key, bucket, start, source_size, target, knots): the words of a source before each bucket of its documents.

    Sums are taken within the buckets of a common prefix and over prefixes, so no window holds more
    than the square root of a source's buckets.
    """
    sums = sized.groupBy("key", F.substring("place", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
    sums = common.keep(sums.withColumn("prefix", F.substring("bucket", 1, digits // 2)), "buckets")
    prefixes = sums.groupBy("key", "prefix").agg(F.sum("words").alias("words"))
    running = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = prefixes.select("key", "prefix", running(Window.partitionBy("key").orderBy("prefix")).alias("outer"))
    inner = sums.select("key", "prefix", "bucket", running(Window.partitionBy("key", "prefix").orderBy("bucket")).alias("inner"))
    keyed = goals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", "knots")
    return inner.join(outer.join(keyed, "key"), ["key", "prefix"]).select("key", "bucket", (F.col("inner") + F.col("outer")).alias("start"), "source_size", "target", "knots")


def curriculum(mix: DataFrame) -> DataFrame:
    """A row for each take of `mixed`, range-sorted by position: the order in which a training reads them."""
    rows = mix.select("doc_id", "source", "size", F.explode("takes").alias("_take")).select("doc_id", "source", "size", "_take.*")
    order = ["position", "source", "copy", "doc_id"]
    return rows.repartitionByRange(common.partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
