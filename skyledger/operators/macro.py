"""Header edits by rule: set or add one keyword in many frames, by an expression or a literal text.

A run is a table with a row for each frame: what would be written to its copy, or why not. Cells are
gathered in one aggregation over the cards that the rule names; no file is touched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import expression
from skyledger.operators.expression import Refused, Value

TRUE = ("t", "true", "1", "yes")


@dataclass(frozen=True)
class Rule:
    """`op` is set or add; `computes` are (name, expression) worked out before, in order."""

    keyword: str
    op: str
    value: str
    value_type: str | None = None
    comment: str | None = None
    idx: int | None = None
    computes: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        if self.op not in ("set", "add"):
            raise Refused(f"no such operation: {self.op}")


def inferred(source: str):
    """A literal as the narrowest type that it can be; an empty text is a text."""
    low = source.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(source)
        except ValueError:
            pass
    return source


def literal(source: str, wanted: str | None) -> tuple[str | None, str, str | None]:
    """(text, type, reason) of a literal that goes to a card of type `wanted` (None: not known)."""
    value = source if wanted in ("str", "bool") else inferred(source)
    kind = wanted or type(value).__name__
    if kind == "bool":
        return ("T" if str(value).strip().lower() in TRUE else "F"), kind, None
    if kind == "str":
        return source if wanted else str(value), kind, None
    if isinstance(value, str) or isinstance(value, bool):
        return None, kind, f"value does not fit type {kind}"
    if kind == "int":
        return (str(int(value)), kind, None) if value == int(value) else (None, kind, "not a whole number")
    return repr(float(value)), kind, None


def _literals(source: str, wanted: Column) -> Column:
    """The same as a struct column, for each type that a row's card may have."""
    def item(kind: str | None) -> Column:
        new, new_type, why = literal(source, kind)
        return F.struct(F.lit(new).cast("string").alias("value"), F.lit(new_type).alias("type"), F.lit(why).cast("string").alias("reason"))

    out = F.when(wanted == "str", item("str"))
    for kind in ("bool", "int", "float"):
        out = out.when(wanted == kind, item(kind))
    return out.otherwise(item(None))


def _written(v: expression.Value, wanted: Column) -> Column:
    """(value, type, reason) of an evaluated value for a card of type `wanted`."""
    kind = F.coalesce(wanted, v.kind)
    own = F.lower(F.trim(expression.shown(v)))
    as_int = F.when(v.is_text(), F.when(v.text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v.text).try_cast("double"))).otherwise(v.num)
    as_float = F.when(v.is_text(), expression.text.to_float(v.text)).otherwise(v.num)
    truth = F.when(v.kind == "bool", v.num == 1).otherwise(own.isin(*TRUE))
    written = (
        F.when(kind == "bool", F.when(truth, "T").otherwise("F")).when(kind == "int", expression.whole_text(as_int))
        .when(kind == "float", expression.float_text(as_float)).otherwise(expression.shown(v))
    )
    fraction = F.when((kind == "int") & (v.kind == "float") & (v.num != F.floor(v.num)), "not a whole number")
    misfit = F.when(written.isNull(), F.concat(F.lit("value does not fit type "), kind))
    reason = F.coalesce(fraction, misfit)
    return F.struct(F.when(reason.isNull(), written).alias("value"), kind.alias("type"), reason.alias("reason"))


def cells(cards: DataFrame, names: set[str]) -> DataFrame:
    """(frame_id, c_<name>): for each name the first card (value_raw, value_num, value_type, idx), how many there are, and all of them."""
    one = F.struct("value_raw", "value_num", "value_type", "idx")
    own = lambda name: F.col("keyword") == name
    picked = [F.struct(F.min_by(one, F.when(own(n), F.col("idx"))).alias("first"), F.count_if(own(n)).alias("n"), F.collect_list(F.when(own(n), one)).alias("all")).alias(f"c_{n}") for n in sorted(names)]
    return cards.where(F.col("keyword").isin(*names)).groupBy("frame_id").agg(*picked)


def run(targets: DataFrame, cards: DataFrame, rule: Rule) -> DataFrame:
    """A row for each of `targets(id, location_id, reason)`: the change, or the reason against it."""
    trees = [(name, source) for name, source in rule.computes]
    for _, source in trees:
        expression.parsed(source)  # a broken rule is the user's mistake, not the data's
    try:
        names = expression.parsed(rule.value)[1]
    except Refused:
        names = None  # no expression: a literal for every frame
    used = set().union(*(expression.parsed(s)[1] for _, s in trees)) | (names or set()) | {rule.keyword}
    known = used - {name for name, _ in trees} | {rule.keyword}
    rows = targets.join(cells(cards, known).withColumnRenamed("frame_id", "id"), "id", "left")
    env = {n: expression.cell(n, F.col(f"`c_{n}`.first.value_raw"), F.col(f"`c_{n}`.first.value_num")) for n in known}
    own = F.col(f"`c_{rule.keyword}`")
    n = F.coalesce(own["n"], F.lit(0))
    if rule.op == "set":
        at = own["first"] if rule.idx is None else F.try_element_at(F.filter(own["all"], lambda c: c["idx"] == rule.idx), F.lit(1))
        guard = F.when(n == 0, "no card to set").when(F.lit(rule.idx is None) & (n > 1), "several cards: idx wanted").when(at.isNull(), "no card of that idx")
        idx, old, base = F.lit(rule.idx or 0), at["value_raw"], F.coalesce(F.lit(rule.value_type).cast("string"), own["first"]["value_type"])
    else:
        guard = F.when(n > 0, "card exists")
        idx, old, base = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(rule.value_type).cast("string")

    def made(trees: list[tuple[str, str]], env: dict[str, Value], failed: list[Column]) -> Column:
        """(why, new) once each of `trees` is bound to its name, in order."""
        if trees:
            (name, source), *rest = trees
            return expression.bound(source, env, lambda v: made(rest, env | {name: v}, [*failed, F.concat(F.lit(f"compute {name}: "), v.error)]))
        why = F.coalesce(*failed, F.lit(None).cast("string")).alias("why")
        if names is None:
            return F.struct(why, _literals(rule.value, base).alias("new"))

        def assigned(v: Value) -> Column:
            # A missing operand means that the text was no expression; other mistakes stand.
            absent = F.startswith(v.error, F.lit(expression.MISSING))
            wrong = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("type"), F.concat(F.lit("assign: "), v.error).alias("reason"))
            return F.when(v.error.isNull(), _written(v, base)).when(absent, _literals(rule.value, base)).otherwise(wrong)

        return F.struct(why, expression.bound(rule.value, env, assigned).alias("new"))

    rows = rows.select("id", "location_id", F.coalesce("reason", guard).alias("_guard"), idx.alias("idx"), old.alias("old_value"), made(trees, env, []).alias("_made"))
    rows = rows.select("id", "location_id", F.coalesce("_guard", "_made.why").alias("_why"), "idx", "old_value", F.col("_made.new").alias("_new"))
    reason = F.coalesce("_why", "_new.reason")
    fine = lambda c: F.when(reason.isNull(), c)
    return rows.select(
        "id", fine(F.col("location_id")).alias("location_id"), F.lit(rule.keyword).alias("keyword"), fine(F.col("idx")).alias("idx"), F.lit(rule.op).alias("op"), fine(F.col("old_value")).alias("old_value"),
        fine(F.col("_new.value")).alias("new_value"), fine(F.col("_new.type")).alias("new_type"), F.lit(rule.comment).cast("string").alias("comment"), reason.alias("reason"),
    )


def manual(frames: DataFrame, cards: DataFrame, keyword: str, source: str) -> DataFrame:
    """(id, op, idx, old_value, new_value, new_type, reason) of one text typed into a cell, by the same rules."""
    rows = frames.select("id").join(cells(cards, {keyword}).withColumnRenamed("frame_id", "id"), "id", "left")
    own = F.col(f"`c_{keyword}`")
    n, first = F.coalesce(own["n"], F.lit(0)), own["first"]
    rows = rows.select("id", n.alias("n"), first.alias("first"), F.when(n > 0, _literals(source, first["value_type"])).otherwise(_literals(source, F.lit(None).cast("string"))).alias("new"))
    reason = F.coalesce(F.when(F.col("n") > 1, "several cards"), F.col("new.reason"))
    fine = lambda c: F.when(reason.isNull(), c)
    return rows.select(
        "id", fine(F.when(F.col("n") > 0, "set").otherwise("add")).alias("op"), fine(F.col("first.idx")).alias("idx"), fine(F.col("first.value_raw")).alias("old_value"),
        fine(F.col("new.value")).alias("new_value"), fine(F.col("new.type")).alias("new_type"), reason.alias("reason"),
    )


def card_counts(cards: DataFrame) -> DataFrame:
    """(frame_id, keyword, n): how often a frame has a keyword."""
    return cards.groupBy("frame_id", "keyword").agg(F.count("*").alias("n"))
