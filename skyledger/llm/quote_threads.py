"""Conversations in reply order, without their quotations, by quotation linking.

A message's text is parsed into lines with a quote level (the number of `>` before them). What it
says itself and what it quotes are cut into passages: every run of lines of one level, its
paragraphs and its lines. A passage is hashed after lower-casing and dropping all but letters and
digits. Quoted hashes are joined, within the conversation, to the earliest message that says the
passage itself (a table of unique keys, so a common passage never multiplies rows). A message replies
to the earlier message that holds most of what it quotes at the lowest level that is found.

Replies hang together to threads; the root is found by pointer doubling. Messages are ordered by
the turn of their thread's root, then by their own turn, so a reply always follows its original. A
message without a link is a root; a conversation without quotations keeps its order of turns.

Defined results: a null text counts as empty; a text without quotations is returned as it is; rows
that repeat a turn keep an order by their role and text; null turns come first and are replied to by
none; rows with null conv_id form a conversation of their own; an empty table gives no row; other
columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_PLAIN = re.compile(r"[\W_]+")
#: How the line that announces a quotation ends.
_ANNOUNCES = re.compile(r"\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.IGNORECASE)


def lines(text: str) -> list[tuple[int, str]]:
    """Every line with its quote level and without its quote marks."""
    out = []
    for line in text.split("\n"):
        mark = _QUOTE.match(line)
        out.append((mark.group(1).count(">"), line[mark.end() :]) if mark else (0, line))
    return out


def passages(own: list[str]) -> dict[bytes, int]:
    """Hashes of a run of lines, of its paragraphs and of its lines, with their normalised length."""
    parts = ["\n".join(own), *"\n".join(own).split("\n\n"), *own]
    found = {}
    for part in parts:
        plain = _PLAIN.sub("", part.lower())
        if plain:
            found[xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))] = len(plain)
    return found


def parse(text: str | None) -> tuple[str, dict[bytes, int], list[tuple[int, bytes, int]]]:
    """The text without quotations, its own passages, and the quoted ones with their level."""
    rows = lines(text or "")
    if not any(level for level, _ in rows):
        return text or "", passages([line for _, line in rows]), []
    own, quoted, said, run = [], [], {}, []
    for k, (level, line) in enumerate(rows):
        ahead = next((above for above, other in rows[k + 1 : k + 3] if above or other.strip()), 0)
        if level == 0 and ahead and line.rstrip().endswith(":") and _ANNOUNCES.search(line):
            level, line = 0, None
        if level == 0:
            own += [] if line is None else [line]
            said |= {} if line is None or not line.strip() else passages([line])
        if run and (run[0] != level or line is None):
            _close(run, quoted, said)
            run = []
        if line is not None:
            run = run or [level]
            run.append(line)
    _close(run, quoted, said)
    return "\n".join(own).strip(), said | passages(own), quoted


def _close(run: list, quoted: list, said: dict) -> None:
    if run and run[0]:
        quoted += [(run[0], key, size) for key, size in passages(run[1:]).items()]
    elif run:
        said |= passages(run[1:])


def _parsed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    quote = pa.struct([("level", pa.int32()), ("key", pa.binary()), ("size", pa.int64())])
    for column in texts:
        found = [parse(text) for text in column.to_pylist()]
        yield pa.StructArray.from_arrays(
            [
                pa.array([x[0] for x in found], pa.string()),
                pa.array([list(x[1]) for x in found], pa.list_(pa.binary())),
                pa.array([[{"level": a, "key": b, "size": c} for a, b, c in x[2]] for x in found], pa.list_(quote)),
            ],
            ["body", "own", "quoted"],
        )


PARSED = "struct<body:string,own:array<binary>,quoted:array<struct<level:int,key:binary,size:bigint>>>"


def links(messages: DataFrame) -> DataFrame:
    """(id, parent, parent_turn, n_linked) from messages(id, conv_id, turn, parsed), for those that reply."""
    said = messages.where("turn is not null").select("conv_id", F.explode("parsed.own").alias("key"), F.struct("turn", "id").alias("original"))
    first = said.groupBy("conv_id", "key").agg(F.min("original").alias("original")).withColumnRenamed("conv_id", "of").withColumnRenamed("key", "said")
    asked = messages.select("id", "conv_id", "turn", F.explode("parsed.quoted").alias("q")).select("id", "conv_id", "turn", "q.level", "q.key", "q.size")
    found = asked.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("said"))).where("original.turn < turn")
    weights = found.groupBy("id", "level", F.col("original.id").alias("parent"), F.col("original.turn").alias("parent_turn")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    best = F.struct("level", (-F.col("size")).alias("less"), (-F.col("parent_turn")).alias("later"), "parent", "parent_turn")
    chosen = weights.groupBy("id").agg(F.min(best).alias("best"), F.sum("n").alias("n_linked"))
    return chosen.select("id", "best.parent", "best.parent_turn", "n_linked")


def roots(replies: DataFrame) -> DataFrame:
    """(id, root, root_turn) of every reply; the way to the root halves in each round."""
    step = common.cut(replies.select("id", F.col("parent").alias("root"), F.col("parent_turn").alias("root_turn")))
    while True:
        above = step.select(F.col("id").alias("root"), F.col("root").alias("up"), F.col("root_turn").alias("up_turn"))
        joined = common.cut(step.join(above, "root", "left"))
        if joined.where("up is not null").isEmpty():
            return step
        step = joined.select("id", F.coalesce("up", "root").alias("root"), F.coalesce("up_turn", "root_turn").alias("root_turn"))


def conversations(table: DataFrame) -> DataFrame:
    """Every message as conv_id, turn, role, position, reply_to (a turn), n_quoted, n_linked, text."""
    parsed = F.arrow_udf(_parsed, PARSED)
    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    messages = common.keep(rows.withColumn("parsed", parsed("text")).drop("text").withColumn("id", F.monotonically_increasing_id()), "messages")
    replies = common.keep(links(messages), "replies")
    threads = replies.join(roots(replies), "id", "left")
    placed = messages.join(threads, "id", "left").select(
        "conv_id", "turn", "role", F.coalesce("root_turn", "turn").alias("root_turn"), F.col("parent_turn").alias("reply_to"),
        F.size("parsed.quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parsed.body").alias("text"),
    )
    ordered = common.positions(placed, "conv_id", ["root_turn", "turn", "role", "text"])
    return ordered.select("conv_id", "turn", "role", "position", "reply_to", "n_quoted", "n_linked", "text")
