"""Predicate trees over header cards and frame columns, as one boolean column.

A tree is a dict: a condition {"keyword", "operator", "value"}, a group {"op": "AND" | "OR",
"conditions": [...]}, a negation {"op": "NOT", "conditions": [one]}, or a facet {"facet", "value"}. Its
conditions become one aggregation over the cards of the keywords it names, joined to the frames once.
Logic is two-valued: what can't be told is false, so a negation keeps frames without the card.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import sky, text

KEYWORD = re.compile(r"^[A-Za-z0-9_\-]{1,68}$")
ORDER = {"gt": "__gt__", "lt": "__lt__", "ge": "__ge__", "le": "__le__"}


def number_of(value) -> float | None:
    if isinstance(value, bool):
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _leaf(keyword: str, operator: str, value) -> Column:
    """Whether one card fulfils a condition."""
    raw, num = F.col("value_raw"), F.col("value_num")
    if operator in ("exists", "not_exists"):
        found = F.lit(True)
    elif operator in ORDER:
        if (limit := number_of(value)) is None:
            raise ValueError(f"{operator} wants a number, not {value!r}")
        found = getattr(num, ORDER[operator])(F.lit(limit))
    elif operator in ("eq", "ne"):
        written = ("T" if value else "F") if isinstance(value, bool) else str(value)
        limit = number_of(value)
        if operator == "eq":
            found = (raw == written) if limit is None else (raw == written) | (num == limit)
        else:
            found = (raw != written) if limit is None else (raw != written) & (num.isNull() | (num != limit))
    elif operator == "contains":
        found = F.contains(text.ascii_lower(raw), text.ascii_lower(F.lit(str(value))))
    elif operator == "startswith":
        found = F.startswith(text.ascii_lower(raw), text.ascii_lower(F.lit(str(value))))
    else:
        raise ValueError(f"no such operator: {operator}")
    return (F.col("keyword") == keyword) & F.coalesce(found, F.lit(False))


def _facet(name: str, value) -> Column:
    if name == "night":
        first, last = sky.night_bounds(value)
        return (F.col("date_obs") >= first) & (F.col("date_obs") < last)
    columns = {"object": "object_id", "filter": "filter_canon", "kind": "kind", "telescope": "telescope_canon_id"}
    if name not in columns:
        raise ValueError(f"no such facet: {name}")
    return F.col(columns[name]) == value


def compiled(tree: dict | None) -> tuple[Column, dict[str, Column]]:
    """The predicate of a frame and the card conditions that it refers to, by column name."""
    leaves: dict[str, Column] = {}

    def walk(node: dict) -> Column:
        if "facet" in node:
            return F.coalesce(_facet(node["facet"], node["value"]), F.lit(False))
        if "keyword" in node:
            if not KEYWORD.match(node["keyword"]):
                raise ValueError(f"no keyword: {node['keyword']!r}")
            name = f"_leaf{len(leaves)}"
            leaves[name] = _leaf(node["keyword"], node["operator"], node.get("value"))
            found = F.coalesce(F.col(name), F.lit(False))
            return ~found if node["operator"] == "not_exists" else found
        inner = [walk(c) for c in node.get("conditions", [])]
        if node["op"] == "NOT":
            if len(inner) != 1:
                raise ValueError("NOT takes one condition")
            return ~inner[0]
        if node["op"] not in ("AND", "OR"):
            raise ValueError(f"no such group: {node['op']}")
        out = inner[0] if inner else F.lit(True)
        for other in inner[1:]:
            out = out & other if node["op"] == "AND" else out | other
        return out

    return (walk(tree) if tree else F.lit(True)), leaves


def keywords(tree: dict | None) -> set[str]:
    if not tree:
        return set()
    return {tree["keyword"]} if "keyword" in tree else set().union(*map(keywords, tree.get("conditions", [])))


def flagged(frames: DataFrame, cards: DataFrame, trees: dict[str, dict | None]) -> DataFrame:
    """`frames` with a boolean column for each named tree; the cards are read once for all."""
    made, leaves = {}, {}
    for n, (name, tree) in enumerate(trees.items()):
        predicate, own = compiled(tree)
        made[name] = predicate
        if own:
            # Leaf names are per tree, so they get the tree's number.
            leaves[n] = own
            made[name] = (predicate, n)
    if leaves:
        asked = set().union(*(keywords(t) for t in trees.values()))
        aggregates = [F.max(leaf).alias(f"{name}_{n}") for n, own in leaves.items() for name, leaf in own.items()]
        per_frame = cards.where(F.col("keyword").isin(sorted(asked))).groupBy("frame_id").agg(*aggregates).withColumnRenamed("frame_id", "_frame")
        frames = frames.join(per_frame, F.col("id") == F.col("_frame"), "left").drop("_frame")
    for name, predicate in made.items():
        if isinstance(predicate, tuple):
            predicate, n = predicate
            own = list(leaves[n])
            frames = frames.withColumns({leaf: F.col(f"{leaf}_{n}") for leaf in own}).withColumn(name, predicate).drop(*own, *(f"{leaf}_{n}" for leaf in own))
        else:
            frames = frames.withColumn(name, predicate)
    return frames


def select(frames: DataFrame, cards: DataFrame, tree: dict | None) -> DataFrame:
    """The frames that a tree selects."""
    return flagged(frames, cards, {"_selected": tree}).where("_selected").drop("_selected")


def described(tree: dict | None, nested: bool = False) -> str:
    """A tree in words."""
    if not tree:
        return "all"
    if "facet" in tree:
        return f"{tree['facet']} = {tree.get('label', tree['value'])}"
    if "keyword" in tree:
        return " ".join(str(x) for x in (tree["keyword"], tree["operator"], tree.get("value")) if x is not None)
    inner = [described(c, True) for c in tree.get("conditions", [])]
    if tree["op"] == "NOT":
        return f"not ({inner[0]})"
    joined = f" {tree['op'].lower()} ".join(inner) or "all"
    return f"({joined})" if nested and len(inner) > 1 else joined


def composed(state: dict[str, dict[str, list]], advanced: dict | None = None) -> dict | None:
    """A facet state {facet: {"in": [...], "out": [...]}} as a tree: OR within a facet, AND between."""
    parts: list[dict] = []
    for facet, chosen in state.items():
        wanted = [{"facet": facet, "value": v} for v in chosen.get("in", [])]
        if wanted:
            parts.append(wanted[0] if len(wanted) == 1 else {"op": "OR", "conditions": wanted})
        parts += [{"op": "NOT", "conditions": [{"facet": facet, "value": v}]} for v in chosen.get("out", [])]
    parts += [advanced] if advanced else []
    return None if not parts else parts[0] if len(parts) == 1 else {"op": "AND", "conditions": parts}


def cycled(state: dict, facet: str, value) -> dict:
    """The state after a click on a value: none, in, out, none."""
    own = {k: [v for v in state.get(facet, {}).get(k, [])] for k in ("in", "out")}
    if value in own["in"]:
        own["in"].remove(value)
        own["out"].append(value)
    elif value in own["out"]:
        own["out"].remove(value)
    else:
        own["in"].append(value)
    rest = {k: v for k, v in state.items() if k != facet}
    return rest | ({facet: own} if own["in"] or own["out"] else {})


def sibling(state: dict, facet: str) -> dict:
    """The state without one facet: what that facet's counts are taken over."""
    return {k: v for k, v in state.items() if k != facet}
