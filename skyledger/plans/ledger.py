"""Queries over state changes, header edits by rule and the catalog's views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger import storage, store
from skyledger.bridge import Catalog
from skyledger.functions import sky, text
from skyledger.operators import changes, commits, delivery, derive, dimensions, donor, facets, macro, naming, presence, sites, verbs, views
from skyledger.plans.catalog import _CLASS, _PATHS, RESOLVED_SQL, _key, plan, truths

# Header edits by rule. Cards get types: GAIN is whole, PRICE a fraction, the others are texts.
_TYPED = """typed AS (SELECT *, CASE keyword WHEN 'GAIN' THEN 'int' WHEN 'PRICE' THEN 'float' ELSE 'str' END AS value_type FROM cards),
copies AS (SELECT f.id, count(l.id) AS n, min(l.id) AS location_id FROM frame f LEFT JOIN location l ON l.frame_id = f.id AND l.present = 1 GROUP BY 1),
gate AS (SELECT id, CASE WHEN n = 1 THEN location_id END AS location_id, CASE WHEN n = 0 THEN 'no present copy' WHEN n > 1 THEN 'several copies' END AS gate FROM copies)"""


def _typed(c: Catalog) -> DataFrame:
    kind = F.when(F.col("keyword") == "GAIN", "int").when(F.col("keyword") == "PRICE", "float").otherwise("str")
    return c.cards().withColumn("value_type", kind)


def _targets(c: Catalog) -> DataFrame:
    copies = c.locations().where("present = 1").groupBy(F.col("frame_id").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("location_id"))
    rows = c.frames().select("id").join(copies, "id", "left")
    reason = F.when(F.col("n").isNull(), "no present copy").when(F.col("n") > 1, "several copies")
    return rows.select("id", F.when(reason.isNull(), F.col("location_id")).alias("location_id"), reason.alias("reason"))


def _edit(value: str, kind: str, why: str, keyword: str, op: str, joins: str) -> str:
    """The SQL of a run: value, type and reason by expressions over gate g and the cards joined."""
    return f""", {_TYPED} SELECT id, CASE WHEN why IS NULL THEN location_id END AS location_id, '{keyword}' AS keyword, '{op}' AS op, CASE WHEN why IS NULL THEN value END AS new_value, CASE WHEN why IS NULL THEN kind END AS new_type, why AS reason
    FROM (SELECT g.id, g.location_id, coalesce(g.gate, {why}) AS why, {value} AS value, {kind} AS kind FROM gate g {joins})"""


def _run(c: Catalog, rule: macro.Rule) -> DataFrame:
    return macro.run(_targets(c), _typed(c), rule).select("id", "location_id", "keyword", "op", "new_value", "new_type", "reason")


_GAIN = "LEFT JOIN typed k ON k.frame_id = g.id AND k.keyword = 'GAIN'"
_PRICE = "LEFT JOIN typed p ON p.frame_id = g.id AND p.keyword = 'PRICE'"


@plan(_edit("((k.value_num + 100) / 2)::BIGINT::VARCHAR", "'int'", "CASE WHEN k.frame_id IS NULL THEN 'no card to set' END", "GAIN", "set", _GAIN))
def macro_set_int(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("GAIN", "set", "(GAIN + 100) / 2"))


@plan(_edit("((k.value_num + 1) / 2)::BIGINT::VARCHAR", "'int'", "CASE WHEN k.frame_id IS NULL THEN 'no card to set' WHEN (k.value_num + 1) % 2 <> 0 THEN 'not a whole number' END", "GAIN", "set", _GAIN))
def macro_set_int_fraction(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("GAIN", "set", "(GAIN + 1) / 2"))


@plan(_edit("(floor(p.value_num) + 5)::BIGINT::VARCHAR", "'int'", "CASE WHEN p.frame_id IS NULL THEN 'compute whole: missing operand: PRICE' END", "NET", "add", _PRICE))
def macro_add_computed(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("NET", "add", "whole + 5", computes=(("whole", "int(PRICE)"),)))


@plan(_edit("NULL::VARCHAR", "NULL::VARCHAR", "CASE WHEN k.frame_id IS NULL THEN NULL ELSE 'card exists' END", "GAIN", "add", _GAIN))
def macro_add_existing(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("GAIN", "add", "1"))


@plan(_edit("'RC8'", "'str'", "CASE WHEN k.frame_id IS NULL THEN 'no card to set' END", "STATUS", "set", "LEFT JOIN typed k ON k.frame_id = g.id AND k.keyword = 'STATUS'"))
def macro_set_literal(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("STATUS", "set", "RC8"))


@plan(_edit("NULL::VARCHAR", "NULL::VARCHAR", "CASE WHEN k.frame_id IS NULL THEN 'no card to set' ELSE 'value does not fit type int' END", "GAIN", "set", _GAIN))
def macro_misfit(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("GAIN", "set", "EQMOD HEQ5/6"))


_HISTORY = "LEFT JOIN (SELECT frame_id, count(*) AS n FROM typed WHERE keyword = 'HISTORY' GROUP BY 1) k ON k.frame_id = g.id"


@plan(_edit("NULL::VARCHAR", "NULL::VARCHAR", "CASE WHEN k.n IS NULL THEN 'no card to set' ELSE 'several cards: idx wanted' END", "HISTORY", "set", _HISTORY))
def macro_several_cards(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("HISTORY", "set", "done"))


@plan(f""", {_TYPED} SELECT g.id, CASE WHEN g.gate IS NULL AND h.frame_id IS NOT NULL THEN h.value_raw END AS old_value, CASE WHEN g.gate IS NULL AND h.frame_id IS NOT NULL THEN 'done' END AS new_value,
coalesce(g.gate, CASE WHEN h.frame_id IS NULL THEN 'no card to set' END) AS reason FROM gate g LEFT JOIN typed h ON h.frame_id = g.id AND h.keyword = 'HISTORY' AND h.idx = 1""")
def macro_set_occurrence(c: Catalog) -> DataFrame:
    return macro.run(_targets(c), _typed(c), macro.Rule("HISTORY", "set", "done", idx=1)).select("id", "old_value", "new_value", "reason")


@plan(_edit("NULL::VARCHAR", "NULL::VARCHAR", "CASE WHEN k.frame_id IS NULL THEN 'no card to set' WHEN s.frame_id IS NULL THEN 'assign: missing' ELSE 'assign: type error' END", "GAIN", "set", _GAIN + " LEFT JOIN typed s ON s.frame_id = g.id AND s.keyword = 'STATUS'"))
def macro_type_error(c: Catalog) -> DataFrame:
    return _run(c, macro.Rule("GAIN", "set", "GAIN + STATUS"))


@plan(f""", {_TYPED} SELECT id, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN 'set' ELSE 'add' END AS op, CASE WHEN n > 1 THEN NULL ELSE '12' END AS new_value, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN 'str' ELSE 'int' END AS new_type,
CASE WHEN n > 1 THEN 'several cards' END AS reason FROM (SELECT f.id, (SELECT count(*) FROM typed k WHERE k.frame_id = f.id AND keyword = 'HISTORY') AS n FROM frame f)""")
def manual_cell_edit(c: Catalog) -> DataFrame:
    return macro.manual(c.frames(), _typed(c), "HISTORY", "12").select("id", "op", "new_value", "new_type", "reason")


@plan("SELECT frame_id, keyword, count(*) AS n FROM cards GROUP BY 1, 2")
def card_counts(c: Catalog) -> DataFrame:
    return macro.card_counts(c.cards())


# State changes: snapshots and events.
def _marked(c: Catalog) -> DataFrame:
    return c.locations().withColumn("unreadable_since", F.when(F.col("id") % 5 == 0, "2024-01-01"))


_MARKED = "marked AS (SELECT *, CASE WHEN id % 5 = 0 THEN '2024-01-01' END AS unreadable_since FROM location)"
_UNREADABLE = f", {_MARKED}, change AS (SELECT *, id % 3 = 0 AND NOT (id % 6 = 0 AND unreadable_since IS NOT NULL AND present = 1) AS moved FROM marked)"


def _unreadable(c: Catalog) -> verbs.Change:
    later = F.col("mtime") + F.expr("INTERVAL 1 DAY")
    failures = c.locations().where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, F.col("mtime")).otherwise(later).alias("mtime"), F.lit("broken").alias("reason"))
    return verbs.unreadable(_marked(c), failures, F.lit("2025-05-05"))


@plan(f"""{_UNREADABLE} SELECT id, CASE WHEN moved THEN 1 ELSE present END AS present, CASE WHEN moved THEN coalesce(unreadable_since, '2025-05-05') ELSE unreadable_since END AS unreadable_since,
CASE WHEN moved AND id % 6 <> 0 THEN mtime + INTERVAL 1 DAY ELSE mtime END AS mtime FROM change""")
def state_unreadable(c: Catalog) -> DataFrame:
    return _unreadable(c).table.select("id", "present", "unreadable_since", "mtime")


@plan(f"{_UNREADABLE} SELECT 'frame.review' AS verb, 'frame:' || frame_id AS target, 'copy not readable: broken' AS reason FROM change WHERE moved")
def events_unreadable(c: Catalog) -> DataFrame:
    return _unreadable(c).events.select("verb", "target", "reason")


_GONE = f", {_MARKED}, asked AS (SELECT *, id % 8 = 0 AS drifted FROM marked WHERE id % 4 = 0)"


def _vanished(c: Catalog) -> verbs.Change:
    gone = c.locations().where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "/elsewhere").otherwise(F.col("path")).alias("path"))
    return verbs.vanished(_marked(c), gone, "run-1")


@plan(f"{_GONE} SELECT id, CASE WHEN drifted THEN 'drifted' WHEN present = 1 THEN 'vanished' ELSE 'already gone' END AS outcome FROM asked")
def vanish_outcome(c: Catalog) -> DataFrame:
    return _vanished(c).outcome


@plan(f"{_GONE} SELECT id, CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN 0 ELSE present END AS present, CASE WHEN id % 4 = 0 AND id % 8 <> 0 AND present = 1 THEN NULL ELSE unreadable_since END AS unreadable_since FROM marked")
def state_vanished(c: Catalog) -> DataFrame:
    return _vanished(c).table.select("id", "present", "unreadable_since")


@plan(f"""{_GONE} SELECT 'location.vanished' AS verb, 'location:' || id AS target, '{{"path":"' || path || '","volume":"' || volume || '","run_id":"run-1","unreadable_since_before":' || coalesce('"' || unreadable_since || '"', 'null') || ',"forced":false}}' AS payload
FROM asked WHERE NOT drifted AND present = 1""")
def events_vanished(c: Catalog) -> DataFrame:
    return _vanished(c).events.select("verb", "target", "payload")


@plan("""SELECT 'frame.review' AS verb, count(*) AS n FROM frame WHERE NOT has_header HAVING count(*) > 0 UNION ALL SELECT 'camera.review', count(*) FROM frame WHERE has_header AND camera_id IS NULL HAVING count(*) > 0
UNION ALL SELECT 'kind.unmapped', count(*) FROM frame WHERE kind = 'dark' HAVING count(*) > 0""")
def events_review_flags(c: Catalog) -> DataFrame:
    flags = {"frame.review": (~F.col("has_header"), F.lit("no header")), "camera.review": (F.col("has_header") & F.col("camera_id").isNull(), F.lit("no camera")), "kind.unmapped": (F.col("kind") == "dark", F.col("kind"))}
    return verbs.flagged(c.frames(), flags).groupBy("verb").agg(F.count("*").alias("n"))


@plan("SELECT 'header.recorded' AS verb, 'frame:' || id AS target FROM frame WHERE has_header AND id % 4 <> 0")
def events_headers(c: Catalog) -> DataFrame:
    headers = c.frames().where("has_header").select(F.col("id").alias("frame_id"), "object_raw", "date_obs")
    return verbs.headers_recorded(headers.where("frame_id % 4 = 0"), headers).events.select("verb", "target")


@plan("""SELECT 25 + row_number() OVER (ORDER BY object_raw) - 1 AS id, object_raw AS canon FROM (SELECT DISTINCT object_raw FROM frame WHERE object_raw IS NOT NULL) UNION ALL SELECT id, canon FROM object""")
def state_objects(c: Catalog) -> DataFrame:
    wanted = c.frames().select(F.col("object_raw").alias("canon"))
    return verbs.upserted(c.objects(), wanted, "canon", "object").table.select("id", "canon")


@plan("SELECT 'object.aliased' AS verb, 'object:' || min(object_id) AS target, count(DISTINCT object_id) > 1 AS shared FROM frame WHERE object_id IS NOT NULL AND object_raw IS NOT NULL AND regexp_replace(upper(object_raw), '[^A-Z0-9]+', '', 'g') <> 'M31' GROUP BY object_raw")
def events_aliases(c: Catalog) -> DataFrame:
    rows = c.frames().where("object_id is not null and object_raw is not null").select(text.norm_alnum(F.col("object_raw")).alias("alias_norm"), "object_id", F.lit("header").alias("source"))
    known = c.spark.createDataFrame([("M31", 1, "header")], "alias_norm string, object_id long, source string")
    found = verbs.aliased(known, rows)
    many = rows.groupBy("alias_norm").agg((F.count_distinct("object_id") > 1).alias("shared"), F.min("object_id").alias("least"))
    return many.join(found.table, "alias_norm").where("alias_norm <> 'M31'").select(F.lit("object.aliased").alias("verb"), F.concat(F.lit("object:"), F.col("object_id").cast("string")).alias("target"), "shared")


_WANTED = "wanted AS (SELECT id, CASE WHEN id % 3 = 0 THEN object_id WHEN id % 3 = 1 THEN 7 END AS object_id FROM frame WHERE id % 2 = 0)"


def _assigned(c: Catalog) -> verbs.Change:
    wanted = c.frames().where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.col("object_id")).when(F.col("id") % 3 == 1, 7).cast("long").alias("object_id"))
    return verbs.assigned(c.frames(), wanted, "object_id", "object")


@plan(f", {_WANTED} SELECT f.id, CASE WHEN f.id % 2 = 0 THEN w.object_id ELSE f.object_id END AS object_id FROM frame f LEFT JOIN wanted w USING (id)")
def state_assigned(c: Catalog) -> DataFrame:
    return _assigned(c).table.select("id", "object_id")


@plan(f", {_WANTED} SELECT CASE WHEN w.object_id IS NULL THEN 'object.unassigned' ELSE 'object.assigned' END AS verb, 'frame:' || f.id AS target FROM frame f JOIN wanted w USING (id) WHERE w.object_id IS DISTINCT FROM f.object_id")
def events_assigned(c: Catalog) -> DataFrame:
    return _assigned(c).events.select("verb", "target")


@plan("""SELECT '{"count":' || count(*) || '}' AS payload FROM frame WHERE id % 2 = 0 AND filter_canon IS DISTINCT FROM 'L'""")
def events_filter_backfill(c: Catalog) -> DataFrame:
    wanted = c.frames().select("id", F.when(F.col("id") % 2 == 0, "L").alias("filter_canon"))
    return verbs.backfilled(c.frames(), wanted, "filter_canon").events.select("payload")


_OPEN = "open AS (SELECT object_raw AS raw, count(*) AS n FROM frame WHERE kind IN ('light', 'master_light') AND object_id IS NULL AND object_raw IS NOT NULL GROUP BY 1)"


@plan(f""", {_OPEN} SELECT 'object.review_item' AS verb, raw AS reason, '{{"n":' || n || '}}' AS payload FROM open UNION ALL SELECT 'object.review_summary', NULL, '{{"distinct":' || count(*) || ',"frames":' || sum(n) || '}}' FROM open HAVING count(*) > 0""")
def events_review_summary(c: Catalog) -> DataFrame:
    rows = c.frames().where("kind in ('light', 'master_light') and object_id is null and object_raw is not null").groupBy(F.col("object_raw").alias("raw")).agg(F.count("*").alias("n"))
    return verbs.review_summary(rows, "object").select("verb", "reason", "payload")


_NAMES = "asked AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' Scope ' || s_nationkey || ' ' ELSE 'mine' END AS name FROM supplier UNION ALL SELECT -1, 'x')"
_LABELS = f"{_NAMES}, checked AS (SELECT a.id, t.label, trim(name) AS name, CASE WHEN t.id IS NULL THEN 'refused: unknown' WHEN trim(name) = '' THEN 'refused: empty' WHEN t.label IS NOT DISTINCT FROM trim(name) THEN 'no change' ELSE 'applied' END AS outcome FROM asked a LEFT JOIN telescope t ON t.id = a.id)"


def _labelled(c: Catalog) -> verbs.Change:
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit(" Scope "), F.col("s_nationkey").cast("string"), F.lit(" "))).otherwise("mine")
    asked = c.table("supplier").select(k.alias("id"), name.alias("name")).unionByName(c.spark.createDataFrame([(-1, "x")], "id long, name string"))
    return verbs.labelled(c.telescopes(), asked, "telescope")


@plan(f", {_LABELS} SELECT id, outcome FROM checked")
def label_outcome(c: Catalog) -> DataFrame:
    return _labelled(c).outcome


@plan(f""", {_LABELS} SELECT 'telescope.labeled' AS verb, 'telescope:' || id AS target, '{{"before":' || coalesce('"' || label || '"', 'null') || ',"after":"' || name || '"}}' AS payload FROM checked WHERE outcome = 'applied'""")
def events_labelled(c: Catalog) -> DataFrame:
    return _labelled(c).events.select("verb", "target", "payload")


@plan("SELECT id, CASE WHEN merged_into IS NOT NULL THEN 'refused: merged' WHEN id % 4 = 0 THEN 'no change' ELSE 'applied' END AS outcome FROM telescope")
def approve_outcome(c: Catalog) -> DataFrame:
    rows = c.telescopes().withColumn("status", F.when(F.col("id") % 4 == 0, "approved").otherwise("proposed"))
    return verbs.approved(rows, rows.select("id")).outcome


_MERGE = """asked AS (SELECT id AS source, id + 5 AS target FROM telescope WHERE id % 10 IN (1, 3, 4)),
merged AS (SELECT source, target, CASE WHEN target > (SELECT max(id) FROM telescope) THEN 'refused: unknown' WHEN source % 10 = 1 THEN 'refused: source is merged' ELSE 'applied' END AS outcome FROM asked)"""


def _merged(c: Catalog) -> verbs.Change:
    asked = c.telescopes().where("id % 10 in (1, 3, 4)").select(F.col("id").alias("source"), (F.col("id") + 5).alias("target"))
    return verbs.merged(c.telescopes(), changes.merges(c.telescopes(), asked), "telescope")


@plan(f", {_MERGE} SELECT * FROM merged")
def merge_outcome(c: Catalog) -> DataFrame:
    return _merged(c).outcome


@plan(f", {_MERGE} SELECT t.id, coalesce(m.target, t.merged_into) AS merged_into FROM telescope t LEFT JOIN merged m ON m.source = t.id AND m.outcome = 'applied'")
def state_merged(c: Catalog) -> DataFrame:
    return _merged(c).table.select("id", "merged_into")


@plan("""SELECT 'telescope.unmerged' AS verb, 'telescope:' || id AS target, '{"before":' || merged_into || ',"after":null}' AS payload FROM telescope WHERE merged_into IS NOT NULL AND id % 3 = 0""")
def events_unmerged(c: Catalog) -> DataFrame:
    return verbs.unmerged(c.telescopes(), c.telescopes().where("id % 3 = 0"), "telescope").events.select("verb", "target", "payload")


@plan("SELECT id, CASE WHEN id % 2 = 0 THEN 'Hill' WHEN id % 5 = 0 THEN 'Site' END AS name FROM site")
def state_site_names(c: Catalog) -> DataFrame:
    sites = c.sites().withColumn("name", F.when(F.col("id") % 5 == 0, "Site"))
    wanted = sites.where("id % 2 = 0").select("id", F.lit("Hill").alias("name"))
    return verbs.labelled(sites, wanted, "observatory", "name", "named").table.select("id", "name")


@plan("""SELECT frame_id, 'GAIN' AS key, CASE WHEN frame_id % 3 = 0 THEN 'u' ELSE 'p' END AS value, CASE WHEN frame_id % 3 = 0 THEN 'user' ELSE 'path' END AS source FROM (SELECT id AS frame_id FROM frame)""")
def state_calibration_facts(c: Catalog) -> DataFrame:
    ids = c.frames().select(F.col("id").alias("frame_id"))
    fact = lambda rows, value, source: rows.select("frame_id", F.lit("GAIN").alias("key"), F.lit(value).alias("value"), F.lit(source).alias("source"))
    known = fact(ids.where("frame_id % 3 = 0"), "u", "user")
    return verbs.facts_recorded(known, fact(ids, "p", "path")).table


@plan("""SELECT verb, count(*) AS n FROM (SELECT 'calibration.unlinked' AS verb FROM frame WHERE id % 4 = 0 UNION ALL SELECT 'calibration.linked' FROM frame WHERE id % 2 = 0) GROUP BY 1""")
def events_relinked(c: Catalog) -> DataFrame:
    link = lambda rows, master: rows.select(F.col("id").alias("light_id"), F.lit("dark").alias("relation"), master.cast("long").alias("master_id"))
    known = link(c.frames().where("id % 4 = 0 or id % 2 = 1"), F.lit(5))
    wanted = link(c.frames(), F.when(F.col("id") % 2 == 0, 6).otherwise(5))
    return verbs.linked(known, wanted).events.groupBy("verb").agg(F.count("*").alias("n")).where("verb <> 'calibration.linked' or n > 0")


_STAGED = "SELECT l.id, l.id AS location_id, path AS old_path, CASE WHEN id % 7 = 0 THEN '/archive/taken' ELSE path || '.new' END AS new_path FROM location l"


def _staged(c: Catalog) -> tuple[DataFrame, DataFrame]:
    taken = c.spark.createDataFrame([(-1, 0, "F", "/archive/taken", 1)], "id long, frame_id long, volume string, path string, present int")
    rows = c.stored_locations()
    staged = rows.select("id", F.col("id").alias("location_id"), F.col("path").alias("old_path"), F.when(F.col("id") % 7 == 0, "/archive/taken").otherwise(F.concat("path", F.lit(".new"))).alias("new_path"), F.when(F.col("id") % 5 != 0, F.col("mtime")).alias("expected_mtime"))
    return staged, rows.unionByName(taken, allowMissingColumns=True)


@plan("SELECT id, id AS location_id, CASE WHEN present <> 1 THEN 'skipped: not present' WHEN id % 5 = 0 THEN 'blocked: changed since' WHEN id % 7 = 0 AND volume = 'F' THEN 'blocked: path is taken' ELSE 'apply' END AS outcome FROM location")
def rename_commit(c: Catalog) -> DataFrame:
    return verbs.rename_outcome(*_staged(c))


@plan("SELECT id, id AS location_id, CASE WHEN id % 2 = 0 THEN 'restore' ELSE 'blocked: changed since' END AS outcome FROM location")
def rename_undo(c: Catalog) -> DataFrame:
    staged, _ = _staged(c)
    moved = c.locations().withColumn("path", F.when((F.col("id") % 2 == 0) & (F.col("id") % 7 != 0), F.concat("path", F.lit(".new"))).when(F.col("id") % 2 == 0, "/archive/taken").otherwise(F.col("path")))
    return verbs.rename_outcome(staged, moved, back=True)


@plan("""SELECT id, CASE WHEN id % 3 = 0 THEN 'no change' WHEN id % 7 = 0 THEN 'refused: path is taken' ELSE 'applied' END AS outcome FROM location WHERE id % 7 <> 0 OR id % 3 = 0
UNION ALL SELECT id, CASE WHEN count(*) OVER (PARTITION BY volume) > 1 OR volume = 'F' THEN 'refused: path is taken' ELSE 'applied' END FROM location WHERE id % 7 = 0 AND id % 3 <> 0""")
def relocate_outcome(c: Catalog) -> DataFrame:
    staged, locations = _staged(c)
    wanted = staged.select("id", F.when(F.col("id") % 3 == 0, F.col("old_path")).otherwise(F.col("new_path")).alias("new_path"))
    return verbs.relocated(locations, wanted).outcome


_PENDING = "SELECT id, frame_id AS location_id, 'K' || id % 3 AS keyword, present::VARCHAR AS new_value FROM location WHERE id % 2 = 0"


def _pending(c: Catalog) -> DataFrame:
    rows = c.locations().where("id % 2 = 0").select("id", F.col("frame_id").alias("location_id"), F.concat(F.lit("K"), (F.col("id") % 3).cast("string")).alias("keyword"), F.col("present").cast("string").alias("new_value"))
    old = rows.withColumns({"run_id": F.when(F.col("id") % 4 == 0, "a").otherwise("b"), "status": F.lit("done")})
    return verbs.staged(old, rows, "a")


@plan(f"SELECT location_id, min(id) AS first, string_agg(keyword || '=' || new_value, ',' ORDER BY id) AS edits FROM ({_PENDING}) GROUP BY 1")
def staging_by_location(c: Catalog) -> DataFrame:
    return verbs.by_location(_pending(c), "a")


@plan(f"SELECT location_id, string_agg(keyword || '=' || new_value, ',' ORDER BY id DESC) AS edits FROM ({_PENDING}) GROUP BY 1")
def undo_order(c: Catalog) -> DataFrame:
    return verbs.by_location(_pending(c), "a", newest_first=True).select("location_id", "edits")


@plan("SELECT run_id, status, count(*) AS n FROM (SELECT 'a' AS run_id, 'pending' AS status FROM location WHERE id % 2 = 0 UNION ALL SELECT 'b', 'done' FROM location WHERE id % 2 = 0 AND id % 4 <> 0) GROUP BY 1, 2")
def staging_status(c: Catalog) -> DataFrame:
    return _pending(c).groupBy("run_id", "status").agg(F.count("*").alias("n"))


@plan("""SELECT CASE WHEN id % 97 <> 0 THEN 'seen' WHEN path LIKE '%/darks/%' THEN 'hidden' WHEN id % 3 = 0 THEN 'gone' WHEN id % 3 = 1 THEN 'back' ELSE 'undecided' END AS state, count(*) AS n FROM location WHERE present = 1 AND volume = 'F' GROUP BY 1""")
def presence_states(c: Catalog) -> DataFrame:
    missing = c.locations().where("id % 97 = 0")
    verdicts = missing.where("id % 3 < 2").select("path", (F.col("id") % 3 == 0).alias("gone"))
    found = verbs.presence(c.locations(), c.locations().where("id % 97 <> 0"), verdicts, "F", "/archive", ["/archive/darks"])
    return found.groupBy("state").agg(F.count("*").alias("n"))


# Runs over all copies of a volume: one in 97 or in 20 is missing, those below a pruned folder are hidden, and a look gives three outcomes.
_RUN = """, scoped AS (SELECT *, id % {one_in} <> 0 AND path NOT LIKE '/archive/darks/%' AS seen, path LIKE '/archive/darks/%' AS hidden FROM location WHERE present = 1 AND volume = 'F'),
counted AS (SELECT count(*) AS scoped, count(*) FILTER (NOT seen AND hidden) AS hidden, count(*) FILTER (NOT seen AND NOT hidden) AS candidates, count(*) FILTER (NOT seen AND NOT hidden AND id % 3 = 0) AS gone,
    count(*) FILTER (NOT seen AND NOT hidden AND id % 3 = 1) AS back, count(*) FILTER (NOT seen AND NOT hidden AND id % 3 = 2) AS undecided FROM scoped),
braked AS (SELECT *, candidates > greatest(50, floor(0.02 * scoped)) AS brake FROM counted)"""


def _presence_run(c: Catalog, one_in: int, **how) -> presence.Run:
    locations = c.stored_locations("path").withColumn("unreadable_since", F.lit(None).cast("string"))
    files = locations.where(f"id % {one_in} <> 0 AND path NOT LIKE '/archive/darks/%'").select(F.lit("file").alias("kind"), "path")
    folders = c.spark.createDataFrame([("pruned", "/archive/DARKS"), ("unreadable", "/archive/LIGHT"), ("pruned", "/archive/_wbpp/img")], "kind string, path string")
    look = lambda paths: paths.join(locations.select("path", "id"), "path").select("path", F.when(F.col("id") % 3 < 2, F.col("id") % 3 == 0).alias("gone"))
    return presence.run(locations, files.unionByName(folders), "F", "/archive", "F", "r1", look=look, **how)


def _told(c: Catalog, s: presence.Summary) -> DataFrame:
    row = (s.scoped, s.hidden, s.candidates, s.looked, s.gone, s.back, s.undecided, s.vanished, s.brake is not None, s.aborted is not None)
    return c.spark.createDataFrame([row], "scoped long, hidden long, candidates long, looked boolean, gone long, back long, undecided long, vanished long, braked boolean, aborted boolean")


@plan(f"{_RUN.format(one_in=97)} SELECT scoped, hidden, candidates, NOT brake AS looked, CASE WHEN brake THEN 0 ELSE gone END AS gone, CASE WHEN brake THEN 0 ELSE back END AS back, CASE WHEN brake THEN 0 ELSE undecided END AS undecided, 0 AS vanished, brake AS braked, false AS aborted FROM braked")
def presence_run_dry(c: Catalog) -> DataFrame:
    return _told(c, _presence_run(c, 97).summary)


@plan(f"{_RUN.format(one_in=20)} SELECT scoped, hidden, candidates, NOT brake AS looked, CASE WHEN brake THEN 0 ELSE gone END AS gone, CASE WHEN brake THEN 0 ELSE back END AS back, CASE WHEN brake THEN 0 ELSE undecided END AS undecided, CASE WHEN brake THEN 0 ELSE gone END AS vanished, brake AS braked, brake AS aborted FROM braked")
def presence_run_brake(c: Catalog) -> DataFrame:
    return _told(c, _presence_run(c, 20, apply=True).summary)


@plan(f"{_RUN.format(one_in=20)} SELECT id, path, CASE WHEN hidden THEN 'hidden' WHEN brake THEN 'not looked at' ELSE ['gone', 'back', 'undecided'][id % 3 + 1] END AS state FROM scoped, (SELECT brake FROM braked) WHERE NOT seen")
def presence_run_barrier(c: Catalog) -> DataFrame:
    return _presence_run(c, 20).missing


@plan(f"{_RUN.format(one_in=20)} SELECT l.id, CASE WHEN s.id IS NOT NULL AND NOT seen AND NOT s.hidden AND l.id % 3 = 0 THEN 0 ELSE l.present END AS present FROM location l LEFT JOIN scoped s ON s.id = l.id")
def presence_run_forced(c: Catalog) -> DataFrame:
    """The number of gone copies is told by a run over the same tables that was refused."""
    told = _presence_run(c, 20, apply=True, force=-1).summary
    return _presence_run(c, 20, apply=True, force=told.gone).locations.select("id", "present")


def _ingested(c: Catalog) -> verbs.Ingested:
    """The test catalog scanned anew: some contents and facts have changed, some files fail, a tenth of the places is new."""
    rows = c.stored_copies().select("id", "frame_id", "volume", "path", "present", F.col("mtime").cast("string").alias("mtime"), F.col("size_bytes").cast("long").alias("size_bytes"), F.lit("h").alias("header_hash"), "sha1_data", "kind", "filetype")
    rows = rows.withColumn("unreadable_since", F.lit(None).cast("string"))
    content = F.when(F.col("id") % 7 == 0, F.sha1(F.concat(F.lit("x"), F.col("id").cast("string")))).otherwise(F.col("sha1_data"))
    records = rows.select("volume", "path", content.alias("sha1_data"), "kind", "filetype", "mtime", F.when(F.col("id") % 4 == 0, 1).otherwise(F.col("size_bytes")).alias("size_bytes"), "header_hash", F.when(F.col("id") % 31 == 0, "broken").alias("error"))
    known = rows.where("id % 10 <> 0").withColumnRenamed("sha1_data", "frame_sha1").drop("kind", "filetype")
    return verbs.ingested(records, c.frames().select("id", "sha1_data", "kind", "filetype"), known, F.lit("2025-01-01"), keep=False)


_INGEST = """, asked AS (SELECT *, id % 31 = 0 AS bad, id % 7 = 0 AS other, id % 10 = 0 AS fresh, present <> 1 OR (id % 4 = 0 AND size_bytes::BIGINT <> 1) AS moved FROM location)"""


@plan(f"""{_INGEST} SELECT verb, count(*) AS n FROM (SELECT 'frame.observed' AS verb FROM asked WHERE other AND (fresh OR NOT bad) UNION ALL SELECT 'location.added' FROM asked WHERE fresh UNION ALL SELECT 'location.rebound' FROM asked WHERE NOT fresh AND NOT bad AND other
UNION ALL SELECT 'location.refreshed' FROM asked WHERE NOT fresh AND NOT bad AND NOT other AND moved UNION ALL SELECT 'frame.review' FROM asked WHERE bad) GROUP BY 1""")
def events_ingest(c: Catalog) -> DataFrame:
    return _ingested(c).events.groupBy("verb").agg(F.count("*").alias("n"))


@plan(f"""{_INGEST} SELECT volume, path, CASE WHEN fresh OR bad OR other OR moved THEN 1 ELSE present END AS present, CASE WHEN bad THEN '2025-01-01' END AS unreadable_since, CASE WHEN id % 4 = 0 AND (fresh OR NOT bad) THEN 1 ELSE size_bytes::BIGINT END AS size_bytes,
CASE WHEN other AND (fresh OR NOT bad) THEN sha1('x' || id) ELSE sha1(frame_id::VARCHAR) END AS sha1_data FROM asked""")
def state_ingest(c: Catalog) -> DataFrame:
    found = _ingested(c)
    return found.locations.join(found.frames.select(F.col("id").alias("frame_id"), "sha1_data"), "frame_id").select("volume", "path", "present", "unreadable_since", "size_bytes", "sha1_data")


# A second reading of every copy: other headers under the same contents, other facts, cameras that come with or without a pixel size.
_REREAD = """, known AS (SELECT l.*, f.kind, id % 3 = 0 AS restated, (frame_id % 7)::VARCHAR AS cam, CASE WHEN frame_id % 5 <> 0 THEN 3.76 WHEN frame_id % 3 = 0 THEN 4.63 END AS pixel,
    CASE WHEN id % 5 = 0 THEN 'dark' ELSE f.kind END AS new_kind, present <> 1 OR id % 3 = 0 OR id % 4 = 0 OR (id % 6 = 1) OR id % 11 = 0 AS moved FROM location l JOIN (SELECT id AS fid, kind FROM frame) f ON f.fid = l.frame_id),
last AS (SELECT frame_id, max(volume || path) AS place FROM known WHERE restated GROUP BY 1),
told AS (SELECT k.* FROM known k JOIN last USING (frame_id) WHERE restated AND volume || path = place),
seen AS (SELECT 'CAM' || cam AS model, pixel, min(volume || path) AS place FROM known GROUP BY 1, 2),
camera AS (SELECT 'CAM' || k AS model, CASE WHEN k > 1 THEN 3.76 END AS old, k <= 3 AS known FROM range(7) t(k)),
sized AS (SELECT c.*, arg_min(pixel, place) FILTER (pixel IS NOT NULL) AS first, arg_min({'p': pixel}, place).p AS came FROM camera c JOIN seen USING (model) GROUP BY ALL),
settled AS (SELECT model, known, old, CASE WHEN known THEN old ELSE came END AS begun, coalesce(CASE WHEN known THEN old ELSE came END, first) AS now FROM sized),
other AS (SELECT model, arg_min(pixel, place) AS other FROM settled JOIN seen USING (model) WHERE pixel <> now GROUP BY 1)"""


def _reread(c: Catalog) -> delivery.Delivered:
    frames = c.frames().select("id", "sha1_data", "kind", "filetype", F.lit(None).cast("long").alias("camera_id"), F.lit("header").alias("kind_source"))
    k, f = F.col("id"), F.col("frame_id")
    copies = c.stored_copies()
    known = copies.select(
        "id", "frame_id", "volume", "path", "present", F.col("mtime").cast("string").alias("mtime"), F.col("size_bytes").cast("long").alias("size_bytes"), F.lit("h").alias("header_hash"),
        F.when(k % 11 == 0, "2024").alias("unreadable_since"), F.lit("s").alias("file_sha1"), F.lit(0).alias("hdu_index"), F.lit(0).alias("compressed"), F.col("sha1_data").alias("frame_sha1"), "kind", "filetype",
    )
    restated = k % 3 == 0
    card = F.array(F.struct(F.lit("OBJECT").alias("keyword"), F.lit(0).alias("idx"), F.col("path").alias("value_raw"), F.lit(None).cast("double").alias("value_num"), F.lit("str").alias("value_type"), F.lit(None).cast("string").alias("comment")))
    records = known.select(
        "volume", "path", F.col("frame_sha1").alias("sha1_data"), F.when(k % 5 == 0, "dark").otherwise(F.col("kind")).alias("kind"), "filetype", "mtime", F.when(k % 4 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(restated, "g").otherwise("h").alias("header_hash"), F.when(restated, "t").otherwise("s").alias("file_sha1"), F.lit(0).alias("hdu_index"), (k % 6 == 1).cast("int").alias("compressed"), F.lit(None).cast("string").alias("error"),
        card.alias("cards"), F.concat(F.lit("CAM"), (f % 7).cast("string")).alias("model_canon"), F.lit("header").alias("kind_source"), F.when(f % 5 != 0, 3.76).when(f % 3 == 0, 4.63).alias("xpixsz"), F.col("path").alias("object_raw"),
    )
    cameras = c.spark.range(4).select((F.col("id") + 1).alias("id"), F.concat(F.lit("CAM"), F.col("id").cast("string")).alias("model_canon"), F.when(F.col("id") > 1, 3.76).alias("pixel_um"), F.lit(0).alias("pixel_conflict"))
    headers = frames.select(F.col("id").alias("frame_id"), F.lit("h").alias("header_hash"), F.lit(None).cast("string").alias("object_raw"))
    return delivery.delivered(records, frames, known.drop("kind", "filetype"), headers, c.cards(), cameras, F.lit("2025-01-01"), keep=False)


@plan(f"""{_REREAD} SELECT id, mtime::VARCHAR AS mtime, CASE WHEN restated THEN 't' ELSE 's' END AS file_sha1, CASE WHEN restated THEN 'g' ELSE 'h' END AS header_hash, 0 AS hdu_index, (id % 6 = 1)::INTEGER AS compressed,
size_bytes::BIGINT + (id % 4 = 0)::INTEGER AS size_bytes, NULL::VARCHAR AS unreadable_since, 1 AS present FROM known""")
def state_refreshed(c: Catalog) -> DataFrame:
    return _reread(c).locations.select("id", "mtime", "file_sha1", "header_hash", "hdu_index", "compressed", "size_bytes", "unreadable_since", "present")


_JSON_FACT = """CASE WHEN {test} THEN '"{fact}":{{"before":' || {before} || ',"after":' || {after} || '}}' END"""
_FACTS = ", ".join([
    _JSON_FACT.format(test="restated", fact="file_sha1", before="""'"s"'""", after="""'"t"'"""), _JSON_FACT.format(test="restated", fact="header_hash", before="""'"h"'""", after="""'"g"'"""),
    _JSON_FACT.format(test="id % 6 = 1", fact="compressed", before="""'"0"'""", after="""'"1"'"""), _JSON_FACT.format(test="id % 4 = 0", fact="size_bytes", before="""'"' || size_bytes::BIGINT || '"'""", after="""'"' || (size_bytes::BIGINT + 1) || '"'"""),
    _JSON_FACT.format(test="id % 11 = 0", fact="unreadable_since", before="""'"2024"'""", after="'null'"), _JSON_FACT.format(test="present <> 1", fact="present", before="""'"0"'""", after="""'"1"'"""),
])


@plan(f"""{_REREAD} SELECT verb, target, payload FROM (SELECT 'location.refreshed' AS verb, 'location:' || id AS target, '{{' || concat_ws(',', {_FACTS}) || '}}' AS payload FROM known WHERE moved
UNION ALL SELECT 'header.refreshed', 'frame:' || frame_id, '{{"header_hash_before":"h","header_hash_after":"g"}}' FROM told
UNION ALL SELECT 'frame.rederived', 'frame:' || frame_id, '{{"before":{{"camera_id":null,"kind":"' || kind || '"}},"after":{{"camera_id":' || (cam::INTEGER + 1) || ',"kind":"' || new_kind || '"}}}}' FROM told)""")
def events_refreshed(c: Catalog) -> DataFrame:
    return _reread(c).events.where(~F.startswith("verb", F.lit("camera."))).select("verb", "target", "payload")


@plan(f"""{_REREAD} SELECT f.id, coalesce(new_kind, f.kind) AS kind, CASE WHEN t.frame_id IS NOT NULL THEN cam::BIGINT + 1 END AS camera_id, CASE WHEN t.frame_id IS NULL THEN 'h' ELSE 'g' END AS header_hash, t.path AS object_raw,
coalesce(n, CASE WHEN t.frame_id IS NOT NULL THEN 1 ELSE 0 END) AS n_cards FROM frame f LEFT JOIN told t ON t.frame_id = f.id LEFT JOIN (SELECT frame_id AS cf, count(*) AS n FROM cards GROUP BY 1) ON cf = f.id AND t.frame_id IS NULL""")
def state_restated(c: Catalog) -> DataFrame:
    found = _reread(c)
    counts = found.cards.groupBy(F.col("frame_id").alias("id")).agg(F.count("*").alias("n_cards"))
    own = found.headers.select(F.col("frame_id").alias("id"), "header_hash", "object_raw")
    return found.frames.join(own, "id", "left").join(counts, "id", "left").select("id", "kind", "camera_id", "header_hash", "object_raw", F.coalesce("n_cards", F.lit(0)).alias("n_cards"))


@plan(f"""{_REREAD}, numbered AS (SELECT *, row_number() OVER (ORDER BY model) AS id FROM settled) SELECT verb, 'camera:' || id AS target, payload FROM (SELECT id, 'camera.upserted' AS verb, '{{"model_canon":"' || model || '"' || coalesce(',"pixel_um":' || begun, '') || '}}' AS payload FROM numbered WHERE NOT known
UNION ALL SELECT id, 'camera.pixel_set', '{{"pixel_um":' || now || '}}' FROM numbered WHERE begun IS NULL AND now IS NOT NULL
UNION ALL SELECT id, 'camera.pixel_conflict', '{{"pixel_existing":' || now || ',"pixel_new":' || other || '}}' FROM numbered JOIN other USING (model))""")
def events_cameras(c: Catalog) -> DataFrame:
    return _reread(c).camera_events.select("verb", "target", "payload")


@plan(f"{_REREAD} SELECT model AS model_canon, now AS pixel_um, (other IS NOT NULL)::INTEGER AS pixel_conflict FROM settled LEFT JOIN other USING (model)")
def state_cameras(c: Catalog) -> DataFrame:
    return _reread(c).cameras.select("model_canon", "pixel_um", "pixel_conflict")


@plan(f"""{_INGEST}, logged AS (SELECT 'frame.observed' AS verb FROM asked WHERE other AND (fresh OR NOT bad) UNION ALL SELECT 'location.added' FROM asked WHERE fresh UNION ALL SELECT 'location.rebound' FROM asked WHERE NOT fresh AND NOT bad AND other
UNION ALL SELECT 'location.refreshed' FROM asked WHERE NOT fresh AND NOT bad AND NOT other AND moved UNION ALL SELECT 'frame.review' FROM asked WHERE bad), counted AS (SELECT verb, count(*) AS n FROM logged GROUP BY 1)
SELECT verb, n, (sum(n) OVER (ORDER BY verb) - n + 1)::BIGINT AS first_id, (sum(n) OVER (ORDER BY verb))::BIGINT AS last_id, n AS ids, 1::BIGINT AS run, 0::BIGINT AS again FROM counted""")
def events_published(c: Catalog) -> DataFrame:
    """What stands in the log after an ingest was published, and how many events publishing its tables' own records again would give."""
    kept = store.Store(c.spark, storage.scratch(c.spark, "store"))
    found = _ingested(c)
    kept.publish("scan", 1, found.events, F.lit("2025-01-01"), {"frame": found.frames, "location": found.locations.drop("frame_sha1")})
    frames, locations = kept.table("frame"), kept.table("location")
    # Records and copies are of one table, so it is dealt by place once, with what its frames tell, and nothing that has met is stored.
    # Contents are hashes in lower case: as bytes they are half as long.
    facts = frames.select(F.col("id").alias("frame_id"), F.unhex("sha1_data").alias("_sha1"), "kind", "filetype", F.lit(True).alias("framed"))
    copies = storage.dealt(locations.join(storage.many(facts), "frame_id", "left"), "volume", "path").withColumn("frame_sha1", F.lower(F.hex("_sha1"))).drop("_sha1")
    same = copies.where("unreadable_since is null and present = 1 and framed")
    records = same.select("volume", "path", F.col("frame_sha1").alias("sha1_data"), "kind", "filetype", "mtime", "size_bytes", "header_hash", F.lit(None).cast("string").alias("error"))
    again = kept.publish("scan", 2, verbs.ingested(records, frames, copies.drop("kind", "filetype", "framed"), F.lit("2025-01-02"), keep=False).events, F.lit("2025-01-02"))
    log = kept.table("event").groupBy("verb").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"), F.max("run").alias("run"))
    return log.withColumn("again", F.lit(0 if again is None else again.rows["event"]).cast("long"))


_OUTCOME = "CASE WHEN present <> 1 THEN 'skipped' WHEN id % 5 = 0 THEN 'blocked' WHEN id % 7 = 0 AND volume = 'F' THEN 'blocked' ELSE 'applied' END"


def _committed(c: Catalog) -> tuple[DataFrame, DataFrame]:
    outcome = verbs.rename_outcome(*_staged(c))
    headers = c.stored_locations().select(F.col("id").alias("location_id"), F.concat(F.lit("text "), F.col("path")).alias("header_text"), F.lit("h").alias("header_hash"))
    return verbs.committed(outcome, headers, "c1", F.lit("2025"))


@plan(f"SELECT 'c1' AS commit_id, '2025' AS at, count(*) FILTER (o = 'applied') AS n_applied, count(*) FILTER (o = 'blocked') AS n_blocked, count(*) FILTER (o = 'skipped') AS n_skipped FROM (SELECT {_OUTCOME} AS o FROM location)")
def commit_record(c: Catalog) -> DataFrame:
    return _committed(c)[0]


@plan(f"SELECT 'c1' AS commit_id, id AS location_id, 'text ' || path AS header_text, 'h' AS header_hash FROM location WHERE {_OUTCOME} = 'applied'")
def header_backups(c: Catalog) -> DataFrame:
    return _committed(c)[1]


# Views.
_NAMED = "LEFT JOIN telescope t ON t.id = f.telescope_canon_id LEFT JOIN (SELECT frame_id, arg_min(path, id) AS path, arg_min(present, id) AS present FROM location GROUP BY 1) l ON l.frame_id = f.id"


@plan(f"SELECT f.id, f.kind, f.filter_canon, coalesce(nullif(t.label, ''), t.telescop_canon) AS telescope, f.camera_id, l.path, l.present FROM frame f {_NAMED} WHERE f.object_id = 7 AND f.kind IN ('light', 'master_light') AND f.filter_canon = 'Ha'")
def object_frames(c: Catalog) -> DataFrame:
    return views.object_frames(c.frames(), c.locations(), c.telescopes(), 7, filter_canon="Ha").select("id", "kind", "filter_canon", "telescope", "camera_id", "path", "present")


@plan(f"SELECT f.id, f.sha1_data, coalesce(nullif(t.label, ''), t.telescop_canon) AS telescope, f.camera_id, f.date_obs, l.path FROM frame f {_NAMED} WHERE f.kind IN ('light', 'master_light') AND f.object_id IS NULL AND f.object_raw = 'Saturn'")
def object_review_frames(c: Catalog) -> DataFrame:
    return views.unresolved_frames(c.frames(), c.locations(), c.telescopes(), "Saturn")


@plan("SELECT n_nationkey::BIGINT AS object_id FROM nation WHERE regexp_replace(upper(n_name), '[^A-Z0-9]+', '', 'g') = 'NATION7'")
def alias_lookup(c: Catalog) -> DataFrame:
    aliases = c.objects().select(text.norm_alnum(F.col("canon")).alias("alias_norm"), F.col("id").alias("object_id"))
    return views.alias_target(aliases, "NATION7")


@plan(f", {_MARKED} SELECT m.frame_id, f.sha1_data, m.volume, m.path, m.present, m.unreadable_since FROM marked m JOIN frame f ON f.id = m.frame_id WHERE unreadable_since IS NOT NULL")
def unreadable_copies(c: Catalog) -> DataFrame:
    return views.unreadable_copies(_marked(c), c.frames())


@plan("SELECT id, telescop_canon, label FROM telescope WHERE merged_into IS NULL")
def telescope_choices(c: Catalog) -> DataFrame:
    return views.canonical_telescopes(c.telescopes())


@plan("SELECT count(*) > 0 AS has_real_volume FROM location WHERE volume <> '?'")
def real_volume(c: Catalog) -> DataFrame:
    return views.has_real_volume(c.locations())


_ASKED = "(SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F') a JOIN frame f USING (id) LEFT JOIN location l ON l.frame_id = f.id AND l.present = 1"


def _asked(c: Catalog) -> DataFrame:
    return c.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))


@plan(f"SELECT id, l.id AS location_id, l.path, l.volume, l.size_bytes FROM {_ASKED}")
def writeback_targets(c: Catalog) -> DataFrame:
    return views.targets(c.frames(), c.locations(), _asked(c))


@plan(f"SELECT id, f.kind, f.filter_canon, f.exptime, f.date_obs, l.id AS location_id, l.path, l.volume, l.size_bytes FROM {_ASKED}")
def rename_targets(c: Catalog) -> DataFrame:
    return views.targets(c.frames(), c.locations(), _asked(c), ["kind", "filter_canon", "exptime", "date_obs"])


@plan("SELECT c.frame_id, keyword, idx, value_raw, value_num FROM cards c JOIN location l ON l.frame_id = c.frame_id WHERE l.id = 7001")
def location_cards(c: Catalog) -> DataFrame:
    return views.location_cards(c.locations(), c.cards(), 7001)


@plan("SELECT relation, id AS master_id, (SELECT arg_min(path, l.id) FROM location l WHERE l.frame_id = f.id AND present = 1) AS path FROM (VALUES ('dark', 1), ('flat', 7)) v(relation, m) JOIN frame f ON f.id = v.m")
def calibrators(c: Catalog) -> DataFrame:
    links = c.spark.createDataFrame([(4, "dark", 1), (4, "flat", 7), (4, "bias", None), (5, "dark", 2)], "light_id long, relation string, master_id long")
    return views.calibrators(links, c.locations(), 4)


_CELLS = "SELECT f.id, p.value_num AS num, p.frame_id IS NOT NULL AS there FROM frame f LEFT JOIN cards p ON p.frame_id = f.id AND p.keyword = 'PRICE'"


@plan(f"SELECT id, row_number() OVER (ORDER BY CASE WHEN there THEN 0 ELSE 1 END, CASE WHEN num IS NOT NULL THEN 0 ELSE 1 END DESC, num DESC, id) AS place FROM ({_CELLS})")
def grid_sort_keyword(c: Catalog) -> DataFrame:
    rows = facets.pivot(c.frames(), c.cards(), ["PRICE"])
    keys = rows.select("id", "PRICE_num", "PRICE_raw", "has_PRICE")
    return storage.numbered(keys, [*views.grid_order(F.col("PRICE_num"), F.col("PRICE_raw"), F.col("has_PRICE"), descending=True), "id"], name="place").select("id", "place")


@plan("SELECT id, row_number() OVER (ORDER BY filter_canon IS NULL, lower(filter_canon), id) AS place FROM frame")
def grid_group_order(c: Catalog) -> DataFrame:
    return storage.numbered(c.frames().select("id", "filter_canon"), [*views.group_order(F.col("filter_canon"), False), "id"], name="place").select("id", "place")


@plan("SELECT keyword, count(DISTINCT frame_id) AS n FROM cards GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def default_columns(c: Catalog) -> DataFrame:
    return views.default_columns(facets.coverage(c.cards()), 3)


@plan("SELECT id FROM frame f WHERE EXISTS (SELECT 1 FROM cards c WHERE c.frame_id = f.id AND keyword = 'HISTORY' AND (value_raw ILIKE '%dark%' OR value_raw ILIKE '%flat%' OR value_raw ILIKE '%bias%'))")
def perspective_calibration(c: Catalog) -> DataFrame:
    return views.perspective("calibration", c.frames(), c.cards(), c.locations(), "HISTORY").select("id")


@plan("SELECT id FROM frame f WHERE (SELECT count(*) FROM location l WHERE l.frame_id = f.id AND present = 1) > 1")
def perspective_duplicates(c: Catalog) -> DataFrame:
    return views.perspective("duplicates", c.frames(), c.cards(), c.locations()).select("id")


@plan("SELECT o_orderkey AS id, k AS keyword, v AS value FROM (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']) AS k, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders) WHERE v IS NOT NULL")
def wide_to_cards(c: Catalog) -> DataFrame:
    return views.unpivoted(c.table("orders").withColumnRenamed("o_orderkey", "id"), "id", ["o_orderstatus", "o_orderpriority"])


@plan("SELECT CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '95' ELSE '10' END AS lat_raw, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE '20' END AS lon_raw, count(*) AS n FROM customer WHERE c_custkey % 4 < 2 OR c_custkey % 3 = 0 GROUP BY 1, 2")
def unparsable_sites(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    rows = c.table("customer").select(F.when(k % 4 == 0, "x").when(k % 4 == 1, "95").otherwise("10").alias("lat_raw"), F.when(k % 3 != 0, "20").alias("lon_raw"))
    return views.unparsable_sites(rows)


@plan("SELECT camera_id, count(*) AS n, count(*) FILTER (filetype = 'fits') AS n_fits, count(*) FILTER (filetype = 'xisf') AS n_xisf, 0::BIGINT AS n_raw FROM frame WHERE camera_id IS NOT NULL GROUP BY 1")
def per_camera(c: Catalog) -> DataFrame:
    return views.per_camera(c.frames())


_KEY = "'dark|cam=' || camera_id || '|bin=' || xbinning || '|exp=' || printf('%.3f', exptime) || '|t=' || set_temp || '|g=' || gain || '|o=' || offset_adu"


@plan(f"""SELECT k AS profile_key, id, copies FROM (SELECT k, min(id) AS id FROM (SELECT id, {_KEY} AS k FROM frame WHERE kind IN ('dark', 'master_dark')) WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
JOIN (SELECT frame_id AS id, count(*) AS copies FROM location WHERE present = 1 GROUP BY 1 HAVING count(*) > 1) USING (id)""")
def orphan_recipes(c: Catalog) -> DataFrame:
    return views.orphans(c.frames(), c.locations(), derive.profile_key(F.when(F.col("kind").isin("dark", "master_dark"), "dark")))


@plan("""SELECT path, max(mtime) AS applied_at FROM (SELECT '/f/' || frame_id AS path, mtime, frame_id FROM location) r JOIN frame f ON f.id = r.frame_id GROUP BY path, f.date_ts HAVING max(mtime) > f.date_ts + INTERVAL 60 DAY""")
def late_repairs(c: Catalog) -> DataFrame:
    name = lambda key: F.concat(F.lit("/f/"), F.col(key).cast("string")).alias("path")
    repairs = c.locations().select(name("frame_id"), F.col("mtime").alias("applied_at"))
    return views.late_repairs(repairs, c.frames().select(name("id"), (F.col("date_ts") + F.expr("INTERVAL 60 DAY")).alias("scanned_at")))


@plan("""SELECT 'cameras' AS gate, 5::BIGINT AS expected, count(DISTINCT camera_id) AS actual, count(DISTINCT camera_id) = 5 AS ok FROM frame UNION ALL SELECT 'kind:bias', 0, 0, true
UNION ALL SELECT 'kind:dark', 7, count(*), count(*) = 7 FROM frame WHERE kind = 'dark' UNION ALL SELECT 'verb:click', 3, count(*), count(*) = 3 FROM event WHERE verb = 'click'""")
def acceptance_gates(c: Catalog) -> DataFrame:
    return views.acceptance(c.frames(), c.events(), {"cameras": 5, "kind:bias": 0, "kind:dark": 7, "verb:click": 3})


@plan("SELECT path, CASE WHEN id % 13 = 0 THEN 'left only' ELSE 'right only' END AS side FROM location WHERE (id % 13 = 0) <> (id % 11 = 0)")
def paths_both_ways(c: Catalog) -> DataFrame:
    return views.surplus(c.locations().where("id % 11 <> 0").select("path"), c.locations().where("id % 13 <> 0").select("path"), "path")


@plan("SELECT f.id FROM frame f JOIN orders o ON o.o_orderkey = f.id WHERE o_orderstatus = 'F' AND filter_canon = 'Ha'")
def frames_by_list(c: Catalog) -> DataFrame:
    return c.frames().where("filter_canon = 'Ha'").join(_asked(c), "id", "left_semi").select("id")


@plan("""SELECT s.id, coalesce(n, 0)::BIGINT AS n FROM (SELECT *, CASE WHEN id % 3 = 1 THEN id - 1 END AS merged_into FROM site) s LEFT JOIN (SELECT CASE WHEN id % 40 % 3 = 1 THEN id % 40 - 1 ELSE id % 40 END AS sid, count(*) AS n FROM frame GROUP BY 1) f ON f.sid = s.id WHERE merged_into IS NULL""")
def active_sites(c: Catalog) -> DataFrame:
    sites = c.sites().withColumn("merged_into", F.when(F.col("id") % 3 == 1, F.col("id") - 1))
    return derive.per_canonical(sites, c.frames().select((F.col("id") % 40).alias("site_id")), "site_id").select("id", F.col("n").cast("long").alias("n"))


@plan("SELECT l.id, l.volume, l.path FROM location l JOIN frame f ON f.id = l.frame_id WHERE f.filetype = 'xisf' AND l.present = 1 AND l.id % 3 = 0")
def header_backfill(c: Catalog) -> DataFrame:
    rows = c.locations().withColumn("header_hash", F.when(F.col("id") % 3 != 0, "h"))
    return changes.to_backfill(rows, c.frames())


@plan("""SELECT '{"layout":"by-object","segments":["object","filter"],"root":"/out/_WBPP","ts":"2025-01-01","n_items":' || count(*) || ',"counts":{"exists":' || count(*) FILTER (id % 3 = 0) || ',"would-link":' || count(*) FILTER (id % 3 <> 0) || '}}' AS manifest FROM frame""")
def projection_manifest(c: Catalog) -> DataFrame:
    status = c.frames().select(F.when(F.col("id") % 3 == 0, "exists").otherwise("would-link").alias("status"))
    return naming.manifest(status, "by-object", "/out/_WBPP", F.lit("2025-01-01"))


@plan("SELECT id, path FROM location ORDER BY md5(id || 'seed') LIMIT 5")
def import_falsifiers(c: Catalog) -> DataFrame:
    return views.falsifiers(c.locations(), "id", "seed").select("id", "path")


_REGIONS = [("Cygnus", 312.75, 30.67, 60.0), ("Orion", 83.8, -5.4, 50.0), ("Near Orion", 90.0, 0.0, 50.0)]
_DEG = "round(2 * degrees(asin(least(1, sqrt(pow(sin(radians({dec} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({dec})) * pow(sin(radians({ra} - lon) / 2), 2))))), 9)"
_REGION_SQL = " UNION ALL ".join(f"SELECT id, '{name}' AS canon, {_DEG.format(ra=ra, dec=dec)} AS deg, {radius} AS radius FROM point" for name, ra, dec, radius in _REGIONS)


@plan(f"SELECT p.id, r.canon, CASE WHEN r.canon IS NOT NULL THEN 'region' END AS source FROM point p LEFT JOIN (SELECT id, arg_min(canon, deg) AS canon FROM ({_REGION_SQL}) WHERE deg <= radius GROUP BY 1) r USING (id)")
def resolver_region(c: Catalog) -> DataFrame:
    rows = c.points().select("id", F.col("lon").alias("ra_deg"), F.col("lat").alias("dec_deg"), F.lit("light").alias("kind"), F.lit("somewhere").alias("object_raw"), F.lit(None).cast("string").alias("user_canon"))
    none = c.spark.createDataFrame([], "alias_norm string, canon string")
    return derive.resolved(rows, none, _REGIONS).select("id", "found.canon", "found.source")


# Sites run by run: suppliers' places are known, customers' frames come in, some with no place or one that can't be read.
# Places lie on whole degrees, so within 4 km of each other only where they are equal.
_SITES = """, known AS (SELECT s_suppkey AS id, ((s_suppkey * 53) % 160 - 80)::DOUBLE AS lat, ((s_suppkey * 97) % 340 - 170)::DOUBLE AS lon, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS name, 'approved' AS status FROM supplier),
seen AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'north' WHEN id % 13 = 0 THEN NULL ELSE lat::VARCHAR END AS lat_raw, CASE WHEN id % 13 <> 0 THEN lon::VARCHAR END AS lon_raw, CASE WHEN id % 2 = 0 THEN 1 END AS before, lat, lon FROM point),
spot AS (SELECT * FROM seen WHERE id % 11 <> 0 AND id % 13 <> 0 AND NOT (lat = 0 AND lon = 0)),
founded AS (SELECT lat, lon, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY min(id)) AS id FROM spot WHERE (lat, lon) NOT IN (SELECT (lat, lon) FROM known) GROUP BY lat, lon),
place AS (SELECT lat, lon, min(id) AS id FROM (SELECT id, lat, lon FROM known UNION ALL SELECT id, lat, lon FROM founded) GROUP BY 1, 2),
given AS (SELECT s.id, p.id AS site, s.before FROM spot s JOIN place p USING (lat, lon))"""


def _observed(c: Catalog) -> sites.Observed:
    k = F.col("s_suppkey")
    known = c.table("supplier").select(
        k.alias("id"), F.when(k % 3 == 0, F.col("s_name")).alias("name"), ((k * 53) % 160 - 80).cast("double").alias("lat"), ((k * 97) % 340 - 170).cast("double").alias("lon"),
        F.lit("approved").alias("status"), F.when((k % 10).isin(1, 2), k - k % 10).alias("merged_into"),
    )
    i = F.col("id")
    frames = c.points().select(
        "id", F.when(i % 11 == 0, "north").when(i % 13 != 0, F.col("lat").cast("string")).alias("lat_raw"), F.when(i % 13 != 0, F.col("lon").cast("string")).alias("lon_raw"),
        F.when(i % 2 == 0, 1).cast("long").alias("observatory_id"),
    )
    return sites.observed(frames, known)


@plan(f"{_SITES} SELECT id, lat, lon, name, status FROM known UNION ALL SELECT id, lat, lon, NULL, 'proposed' FROM founded")
def state_observatories(c: Catalog) -> DataFrame:
    return _observed(c).sites.select("id", "lat", "lon", "name", "status")


@plan(f"{_SITES} SELECT id, coalesce(g.site, seen.before) AS observatory_id FROM seen LEFT JOIN given g USING (id)")
def state_frame_sites(c: Catalog) -> DataFrame:
    return _observed(c).frames.select("id", "observatory_id")


@plan(f"""{_SITES}, odd AS (SELECT lat_raw, lon_raw, count(*) AS n FROM seen WHERE id % 11 = 0 GROUP BY 1, 2)
SELECT 'observatory.proposed' AS verb, 'observatory:' || id AS target, NULL AS reason FROM founded UNION ALL SELECT 'observatory.assigned', 'frame:' || id, NULL FROM given WHERE site IS DISTINCT FROM given.before
UNION ALL SELECT 'observatory.review_summary', 'frame:*', NULL FROM (SELECT count(*) AS n FROM odd) WHERE n > 0 UNION ALL SELECT 'observatory.review_item', 'frame:*', lat_raw || ', ' || coalesce(lon_raw, '') FROM odd""")
def events_observatories(c: Catalog) -> DataFrame:
    return _observed(c).events.select("verb", "target", "reason")


# Header edits of every copy: its gain is set twice, and a note is added, or set where there is none.
_COMMIT = """, verdict AS (SELECT id AS location_id, frame_id, CASE WHEN present = 0 THEN 'skipped: not present' WHEN id % 7 = 0 THEN 'skipped: compressed' WHEN id % 5 = 0 THEN 'blocked: changed since'
    WHEN id % 3 = 0 THEN 'failed: no such card' ELSE 'applied' END AS status FROM location)"""


def _copies(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Copies, and the cards of each, both stored dealt by copy."""
    locations = storage.dealt(c.locations().select("id", "frame_id", "present", F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("compressed")), "id")
    cards = locations.select(F.col("id").alias("location_id"), "frame_id").join(storage.many(_typed(c)), "frame_id")
    return locations, storage.dealt(cards.select("location_id", "keyword", "idx", F.coalesce("value_raw", F.col("value_num").cast("string")).alias("value_raw"), "value_type", F.lit(None).cast("string").alias("comment")), "location_id")


def _commit(c: Catalog) -> tuple[commits.Commit, DataFrame]:
    locations, cards = _copies(c)
    edit = lambda n, keyword, op, value: F.struct(F.lit(n).alias("n"), F.lit(keyword).alias("keyword"), op.alias("op"), F.lit(value).alias("new_value"))
    op = F.when(F.col("location_id") % 3 == 0, "set").otherwise("add")
    headers = storage.dealt(commits.header_of(cards), "location_id")
    rows = headers.select("location_id", F.when(F.col("location_id") % 5 == 0, "foreign").otherwise(F.col("header_hash")).alias("expected_hash"))
    rows = rows.select("location_id", "expected_hash", F.explode(F.array(edit(1, "GAIN", F.lit("set"), "first"), edit(2, "NOTE", op, "a note"), edit(3, "GAIN", F.lit("set"), "second"))).alias("e"))
    none = F.lit(None).cast("string")
    staged = rows.select(
        (F.col("location_id") * 10 + F.col("e.n")).alias("id"), F.lit("a").alias("run_id"), "location_id", "e.keyword", F.lit(0).alias("idx"), "e.op", "e.new_value", F.lit("str").alias("new_type"),
        none.alias("new_comment"), "expected_hash", F.lit("pending").alias("status"), none.alias("reason"),
    )
    return commits.committed(staged, cards, locations, "a", "c1", F.lit("2025-01-01"), headers=headers), locations


@plan(f"{_COMMIT} SELECT location_id, status FROM verdict")
def header_commit(c: Catalog) -> DataFrame:
    return _commit(c)[0].outcome


@plan(f"""{_COMMIT} SELECT location_id, keyword, idx, CASE WHEN status = 'applied' AND keyword = 'GAIN' THEN 'second' WHEN keyword = 'PRICE' THEN '(number)' ELSE value_raw END AS value_raw FROM verdict JOIN cards USING (frame_id)
UNION ALL SELECT location_id, 'NOTE', 0, 'a note' FROM verdict WHERE status = 'applied'""")
def header_commit_cards(c: Catalog) -> DataFrame:
    return _commit(c)[0].cards.select("location_id", "keyword", "idx", F.when(F.col("keyword") == "PRICE", "(number)").otherwise(F.col("value_raw")).alias("value_raw"))


@plan(f"{_COMMIT} SELECT location_id, CASE WHEN location_id % 11 = 0 THEN 'blocked: changed since' ELSE 'restored' END AS status FROM verdict WHERE status = 'applied'")
def header_undo(c: Catalog) -> DataFrame:
    """Every eleventh copy has had its gain changed by something else since the commit."""
    made, locations = _commit(c)
    since = made.cards.withColumn("value_raw", F.when((F.col("keyword") == "GAIN") & (F.col("location_id") % 11 == 0), "other").otherwise(F.col("value_raw")))
    return commits.undone(made.backups, "c1", since, locations).outcome


# Every copy as a donor's file: those in one folder are not met by a scan, a frame in 50 has been repaired, of them half late.
_DONOR = """, donor AS (SELECT id, path, present = 1 AS reached, CASE WHEN id % 997 = 0 THEN 'unreadable' ELSE 'ok' END AS status, frame_id % 50 = 0 AS repaired, frame_id % 100 = 0 AS late, frame_id FROM location)"""


def _donor(c: Catalog, key: str = "path") -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    mtime = F.col("mtime").cast("timestamp")
    files = c.stored_locations(key).select(
        "id", "path", F.unix_micros(mtime).cast("double").alias("_us"), F.col("size_bytes").alias("size"), F.lit("fits").alias("filetype"), F.lit(0).alias("hdu_index"), F.lit(0).alias("compressed"),
        F.sha1("path").alias("header_hash"), F.sha1(F.concat(F.lit("file:"), "path")).alias("sha1_file"), F.sha1(F.concat(F.lit("data:"), F.col("frame_id").cast("string"))).alias("sha1_data"),
        F.when(i % 997 == 0, "unreadable").otherwise("ok").alias("status"), mtime.alias("scanned_at"), F.lit(0).alias("sha1_data_uncomputable"), (F.col("present") == 1).alias("reached"),
    )
    files = files.withColumn("mtime", F.col("_us") / 1_000_000).drop("_us")
    days = F.when(F.col("frame_id") % 100 == 0, F.expr("INTERVAL 9 DAYS")).otherwise(F.expr("INTERVAL -9 DAYS"))
    return files, c.stored_locations(key).where("frame_id % 50 = 0").select("path", (mtime + days).alias("applied_at"))


@plan("SELECT '/archive' AS root, count(*) AS n FROM location")
def import_root(c: Catalog) -> DataFrame:
    return donor.common_root(_donor(c)[0])


@plan(f"{_DONOR} SELECT path, late FROM donor WHERE repaired")
def import_repaired(c: Catalog) -> DataFrame:
    return donor.repaired(*_donor(c)).select("path", "late")


_VERDICT = f"""{_DONOR}, verdict AS (SELECT path, CASE WHEN id % 17 = 0 THEN 'not readable' WHEN id % 19 = 0 THEN 'other data' WHEN id % 5 <> 0 THEN 'same' WHEN late THEN 'stale, repaired late' WHEN frame_id % 3 = 0 THEN 'stale, repaired here' ELSE 'stale' END AS verdict FROM donor)"""


def _verdicts(c: Catalog) -> DataFrame:
    """Every file read again, as if it were of the sample."""
    files, repairs = _donor(c)
    i = F.col("id")
    read = files.select(
        "path", F.timestamp_micros(F.round(F.col("mtime") * 1_000_000).cast("long")).alias("mtime"), F.when(i % 5 == 0, "new").otherwise(F.col("header_hash")).alias("header_hash"), "sha1_file",
        F.when(i % 19 == 0, "new").otherwise(F.col("sha1_data")).alias("sha1_data"), F.when(i % 17 == 0, "gone").alias("error"),
    )
    return donor.judged(files, files, read, repairs, c.stored_locations("path").where("frame_id % 3 = 0").select("path"))


@plan(f"{_VERDICT} SELECT path, verdict, verdict IN ('not readable', 'other data', 'stale') AS stops FROM verdict")
def import_verdicts(c: Catalog) -> DataFrame:
    return _verdicts(c)


@plan(f"""{_VERDICT} SELECT 'files' AS gate, count(*) AS n, true AS ok FROM donor UNION ALL SELECT 'one root', 1, true UNION ALL SELECT 'incomplete files', count(*), count(*) = 0 FROM donor WHERE status <> 'ok'
UNION ALL SELECT 'network paths', 0, true UNION ALL SELECT 'paths that repeat', 0, true UNION ALL SELECT 'files that no scan meets', count(*), count(*) = 0 FROM donor WHERE reached AND path LIKE '%/_wbpp/%'
UNION ALL SELECT 'sampled files that differ', count(*), count(*) = 0 FROM verdict WHERE verdict IN ('not readable', 'other data', 'stale') UNION ALL SELECT 'rows in event', count(*), count(*) = 0 FROM event UNION ALL SELECT 'rows in frame', 0, true""")
def import_preflight(c: Catalog) -> DataFrame:
    files = _donor(c)[0]
    listing = files.where(~F.contains("path", F.lit("/_wbpp/")))
    return donor.gates(files, listing, _verdicts(c), {"frame": c.frames().limit(0), "event": c.events()})


@plan(f"""{_DONOR}, held AS (SELECT frame_id, count(*) AS n FROM cards GROUP BY 1) SELECT l.path, coalesce(n, 0)::BIGINT AS n_cards, sha1('data:' || l.frame_id) AS sha1_data, l.size_bytes::BIGINT AS size FROM location l LEFT JOIN held USING (frame_id)""")
def import_records(c: Catalog) -> DataFrame:
    cards = c.stored_locations("id").select(F.col("id").alias("file_id"), "frame_id").join(_typed(c), "frame_id").withColumn("comment", F.lit(None).cast("string"))
    return donor.scanned(_donor(c, "id")[0], cards).select("path", F.size("cards").cast("long").alias("n_cards"), "sha1_data", "size")


# Truth tables of the remaining functions.
HOURS = [(5400.0, "1.5 h"), (0.0, "0.0 h"), (360000.0, "100.0 h"), (90.0, "0.0 h")]
SIZES = [(999.0, "999 B"), (1536.0, "1.5 KB"), (1024.0**2, "1.0 MB"), (3.25 * 1024**3, "3.2 GB"), (5000.0 * 1024**4, "5000.0 TB"), (0.0, "0 B")]
HALVES = [(2.5, 3), (-2.5, -3), (1.4, 1), (-0.4, 0), (0.0, 0)]
MODIFIED = [(0.0, "1970-01-01T00:00:00+00:00"), (1700000000.5, "2023-11-14T22:13:20.500000+00:00")]
ASCII = [("Šumava", "SUMAVA"), ("Ångström", "ANGSTROM"), ("Ę ó x", "E O X"), ("Łódź", "ODZ"), ("ﬁne ½", "FINE 12"), ("plain  text", "PLAIN TEXT"), ("", ""), (None, None)]
SPACES = [("a  b", "A B"), (" x", "X")]
TOKENS = [(1e6, "1e+06s"), (0.00001, "1e-05s"), (1234567.0, "1.23457e+06s"), (0.0001, "0.0001s"), (999999.5, "1e+06s"), (0.00012345678, "0.000123457s"), (300.0, "300s")]
truths("hours_text", HOURS, views.hours_text)
truths("bytes_text", SIZES, views.bytes_text)
truths("half_away", HALVES, views.half_away, "bigint")
truths("modified_text", MODIFIED, views.modified)
truths("text_ascii", ASCII, text.norm_ascii)
truths("text_norm_spaces", SPACES, text.norm)
truths("exposure_token_wide", TOKENS, sky.exposure_token)
truths("header_time_chosen", [("2024-01-02T23:30:00", "2024-01-03 01:30:00"), ("2024-01-02", None)], lambda c: views.chosen_time("header", c, F.lit(None).cast("string"), 2))
truths("file_time_chosen", [("/a/x_2024-01-02_03-04-05.fits", "2024-01-02 02:04:05"), ("/2024-01-02_03-04-05/x.fits", None)], lambda c: views.chosen_time("filename", F.lit(None).cast("string"), c, -1))
truths("kind_of_raw", [("/a/LIGHTS/x.dng", "light"), ("/a/x.dng", "unknown")], lambda c: views.frame_kind(F.lit("raw"), F.lit("Dark"), c, F.lit(True)))
truths("kind_of_header", [("Light Frame", "light"), (None, "unknown")], lambda c: views.frame_kind(F.lit("fits"), c, F.lit("/darks/x"), F.lit(True)))
truths("projection_root", [("/out/_WBPP/x", 1), ("C:\\\\pics\\\\_review", 1), ("/out/WBPP", 0), ("/_wbppx/y", 0)], naming.root_allowed, "int")


# Telescopes and their pairs with cameras. Suppliers are known telescopes, each paired with camera 0; headers call some by other names or by none,
# and half of the frames have a pair, whatever their kind.
_SCOPES = """, keyed AS (SELECT f.id, f.camera_id, f.exptime AS focallen, CASE WHEN f.id % 5 <> 0 THEN f.xbinning::VARCHAR END AS focratio, CASE WHEN f.id % 2 = 0 THEN f.telescope_id END AS before,
    f.kind NOT IN ('dark', 'bias', 'master_dark', 'master_bias') AS axis, CASE WHEN f.id % 19 = 0 THEN NULL WHEN f.id % 3 = 0 THEN ' ' || lower(t.telescop_canon) || ' II' WHEN f.id % 3 = 1 THEN upper(t.telescop_canon) ELSE t.telescop_canon END AS telescop,
    CASE WHEN axis THEN lower(trim(telescop)) END AS key FROM frame f LEFT JOIN telescope t ON t.id = f.telescope_id),
scope AS (SELECT id, lower(telescop_canon) AS key, telescop_canon, NULL::VARCHAR AS f_ratio_nominal, NULL::BIGINT AS focal_nominal, 'approved' AS status FROM telescope
    UNION ALL SELECT (SELECT max(id) FROM telescope) + row_number() OVER (ORDER BY key), key, arg_min(trim(telescop), id), arg_min(focratio, id) FILTER (focratio IS NOT NULL), round_even(arg_min(focallen, id) FILTER (focallen IS NOT NULL), 0)::BIGINT, 'proposed'
    FROM keyed WHERE key IS NOT NULL AND key NOT IN (SELECT lower(telescop_canon) FROM telescope) GROUP BY key),
asked AS (SELECT k.*, s.id AS telescope_id FROM keyed k LEFT JOIN scope s USING (key)),
pair AS (SELECT id, id AS telescope_id, 0 AS camera_id FROM telescope UNION ALL SELECT (SELECT max(id) FROM telescope) + row_number() OVER (ORDER BY telescope_id, camera_id), telescope_id, camera_id
    FROM (SELECT DISTINCT telescope_id, camera_id FROM asked WHERE telescope_id IS NOT NULL AND camera_id IS NOT NULL) WHERE NOT (camera_id = 0 AND telescope_id <= (SELECT max(id) FROM telescope))),
given AS (SELECT a.*, p.id AS config_id, CASE WHEN NOT axis THEN 'kind without telescope' WHEN a.telescope_id IS NULL THEN 'no telescope' WHEN a.camera_id IS NULL THEN 'no camera' END AS why
    FROM asked a LEFT JOIN pair p ON p.telescope_id = a.telescope_id AND p.camera_id = a.camera_id)"""


def _grouped(c: Catalog) -> dimensions.Derived:
    k, name = F.col("id"), F.col("telescop_canon")
    rows = c.frames().join(c.telescopes().select(F.col("id").alias("telescope_id"), "telescop_canon"), "telescope_id", "left")
    telescop = F.when(k % 19 == 0, None).when(k % 3 == 0, F.concat(F.lit(" "), F.lower(name), F.lit(" II"))).when(k % 3 == 1, F.upper(name)).otherwise(name)
    frames = rows.select(
        "id", "kind", "camera_id", F.when(k % 2 == 0, F.col("telescope_id")).alias("config_id"), telescop.alias("telescop"), F.col("exptime").alias("focallen"), F.when(k % 5 != 0, F.col("xbinning").cast("string")).alias("focratio")
    )
    none = lambda t: F.lit(None).cast(t)
    known = c.telescopes().select("id", "telescop_canon", none("string").alias("f_ratio_nominal"), none("long").alias("focal_nominal"), F.lit("approved").alias("status"))
    pairs = c.telescopes().select("id", F.col("id").alias("telescope_id"), F.lit(0).cast("long").alias("camera_id"))
    return dimensions.grouped(storage.cut(frames), known, pairs)


@plan(f"{_SCOPES} SELECT id, telescop_canon, f_ratio_nominal, focal_nominal, status FROM scope")
def state_telescopes(c: Catalog) -> DataFrame:
    return _grouped(c).tables["telescope"]


@plan(f"{_SCOPES} SELECT id, telescope_id, camera_id::BIGINT AS camera_id FROM pair")
def state_configs(c: Catalog) -> DataFrame:
    return _grouped(c).tables["config"]


@plan(f"{_SCOPES} SELECT id, config_id FROM given")
def state_frame_configs(c: Catalog) -> DataFrame:
    return _grouped(c).frames.select("id", "config_id")


@plan(f"""{_SCOPES} SELECT 'telescope.proposed' AS verb, 'telescope:' || id AS target, NULL AS reason FROM scope WHERE status = 'proposed'
UNION ALL SELECT 'config.proposed', 'config:' || id, NULL FROM pair WHERE id > (SELECT max(id) FROM telescope) UNION ALL SELECT 'config.assigned', 'frame:' || id, NULL FROM given WHERE config_id IS NOT NULL AND config_id IS DISTINCT FROM before
UNION ALL SELECT 'config.unassigned', 'frame:' || id, why FROM given WHERE config_id IS NULL AND before IS NOT NULL UNION ALL SELECT 'config.review', 'frame:' || id, why FROM given WHERE axis AND config_id IS NULL""")
def events_grouper(c: Catalog) -> DataFrame:
    return _grouped(c).events.select("verb", "target", "reason")


# The run after it: headers have lost their telescopes where a frame's number says so, and only those frames are looked at.
@plan(f"""{_SCOPES} SELECT 'config.unassigned' AS verb, 'frame:' || id AS target, 'no telescope' AS reason FROM given WHERE id % 23 = 0 AND axis AND config_id IS NOT NULL
UNION ALL SELECT 'config.review', 'frame:' || id, 'no telescope' FROM given WHERE id % 23 = 0 AND axis AND why IS DISTINCT FROM 'no telescope'""")
def events_grouper_touched(c: Catalog) -> DataFrame:
    one = _grouped(c)
    frames = one.frames.withColumn("telescop", F.when(F.col("id") % 23 != 0, F.col("telescop")))
    log = one.events.select(F.monotonically_increasing_id().alias("id"), "verb", "target", "reason", "payload")
    two = dimensions.grouped(frames, one.tables["telescope"], one.tables["config"], frames.where("id % 23 = 0").select("id"), log)
    return two.events.select("verb", "target", "reason")


# Objects and filters: nations are known objects, one has an alias, some frames are a user's.
_NAMED = f""", res AS (SELECT id, CASE WHEN r.canon = 'Veil' THEN (SELECT canon FROM object WHERE id = 5) ELSE r.canon END AS canon, r.source FROM {RESOLVED_SQL} r WHERE id % 50 <> 0 AND r.canon IS NOT NULL),
obj AS (SELECT id, canon, NULL AS kind FROM object UNION ALL SELECT (SELECT max(id) FROM object) + row_number() OVER (ORDER BY canon), canon, CASE WHEN canon IN ('Moon', 'Saturn') THEN 'solar_system' WHEN canon LIKE 'C/%' THEN 'comet' ELSE 'deep_sky' END
    FROM (SELECT DISTINCT canon FROM res WHERE canon NOT IN (SELECT canon FROM object))),
sky AS (SELECT f.id, f.kind IN ('light', 'master_light') AS light, f.object_raw, f.object_id AS id_before, CASE WHEN f.id % 50 = 0 THEN 'user' WHEN f.object_id IS NOT NULL THEN 'header' END AS source_before, r.source, o.id AS found,
    coalesce(o.id, f.object_id) AS object_id, coalesce(r.source, source_before) AS object_source, f.filter_canon AS filter_before, CASE f.id % 4 WHEN 0 THEN 'Ha' WHEN 1 THEN NULL ELSE f.filter_canon END AS filter_new
    FROM frame f LEFT JOIN res r USING (id) LEFT JOIN obj o ON o.canon = r.canon),
still AS (SELECT object_raw AS raw, count(*) AS n FROM sky WHERE light AND object_id IS NULL AND object_raw IS NOT NULL GROUP BY 1)"""


def _named(c: Catalog) -> dimensions.Derived:
    k, none = F.col("id"), F.lit(None).cast("double")
    frames = c.frames().select(
        "id", "kind", "object_id", F.when(k % 50 == 0, "user").when(F.col("object_id").isNotNull(), "header").alias("object_source"), "object_raw", none.alias("ra_deg"), none.alias("dec_deg"),
        F.when(k % 4 == 0, "H-alpha").when(k % 4 == 1, "3").otherwise(F.col("filter_canon")).alias("filter_raw"), "filter_canon",
    )
    unknown = F.lit(None).cast("string")
    aliases = c.objects().where("id = 5").select(F.lit("THEVEIL").alias("alias_norm"), F.col("id").alias("object_id"), F.lit("user").alias("source"))
    return dimensions.named(frames, c.objects().select("id", "canon", unknown.alias("catalog"), unknown.alias("kind")), aliases)


@plan(f"{_NAMED} SELECT id, object_id, object_source, coalesce(filter_new, filter_before) AS filter_canon FROM sky")
def state_frame_objects(c: Catalog) -> DataFrame:
    return _named(c).frames.select("id", "object_id", "object_source", "filter_canon")


@plan(f"{_NAMED} SELECT id, canon, kind FROM obj")
def state_object_kinds(c: Catalog) -> DataFrame:
    return _named(c).tables["object"].select("id", "canon", "kind")


@plan(f"""{_NAMED} SELECT 'object.upserted' AS verb, 'object:' || id AS target, NULL AS reason, kind FROM obj WHERE kind IS NOT NULL UNION ALL SELECT 'object.aliased', 'object:' || found, NULL, NULL FROM (SELECT DISTINCT object_raw, found FROM sky WHERE source <> 'alias')
UNION ALL SELECT 'object.assigned', 'frame:' || id, NULL, NULL FROM sky WHERE found IS NOT NULL AND (object_id IS DISTINCT FROM id_before OR object_source IS DISTINCT FROM source_before)
UNION ALL SELECT 'filter.backfilled', 'frame:*', NULL, count(*)::VARCHAR FROM sky WHERE filter_new IS NOT NULL AND filter_new IS DISTINCT FROM filter_before HAVING count(*) > 0
UNION ALL SELECT 'object.review_item', 'frame:*', raw, n::VARCHAR FROM still UNION ALL SELECT 'object.review_summary', 'frame:*', NULL, count(*)::VARCHAR FROM still HAVING count(*) > 0""")
def events_resolver(c: Catalog) -> DataFrame:
    told = F.coalesce(*(F.get_json_object("payload", f"$.{name}") for name in ("kind", "count", "n", "distinct")))
    return _named(c).events.select("verb", "target", "reason", told.alias("kind"))


# Recipes: headers lack facts here and there, every frame has one stored, by a user or from a path, and half of the frames have an old recipe.
_RECIPES = f""", head AS (SELECT id, {_CLASS} AS class, camera_id, xbinning, telescope_id, filter_canon, CASE WHEN exptime IS NOT NULL THEN (id % 4 + 1) * 60.0 END AS exptime,
    CASE id % 3 WHEN 0 THEN 'gain' WHEN 1 THEN 'set_temp_c' ELSE 'note' END AS k, id % 4 * 50 AS v, id % 2 = 0 AS said, set_temp, CASE WHEN id % 5 <> 0 THEN gain END AS gain, CASE WHEN id % 7 <> 0 THEN offset_adu END AS offset_adu, id // 2 % 3 + 1 AS p FROM frame),
own AS (SELECT * REPLACE (CASE WHEN k = 'gain' AND said THEN v ELSE coalesce(gain, CASE WHEN k = 'gain' THEN v END) END AS gain, CASE WHEN k = 'set_temp_c' AND said THEN v ELSE coalesce(set_temp, CASE WHEN k = 'set_temp_c' THEN v END) END AS set_temp) FROM head WHERE class IS NOT NULL),
silent AS (SELECT *, class = 'dark' AND (camera_id IS NULL OR exptime IS NULL OR set_temp IS NULL OR gain IS NULL OR offset_adu IS NULL) AS asks FROM own),
path AS (SELECT *, CASE WHEN asks AND gain IS NULL THEN list_extract([100, 5, NULL], p) END AS p_gain, CASE WHEN asks AND offset_adu IS NULL THEN list_extract([21, 0, NULL], p) END AS p_offset, CASE WHEN asks AND set_temp IS NULL THEN list_extract([-10, 0, NULL], p) END AS p_temp FROM silent),
fact AS (SELECT * REPLACE (coalesce(gain, p_gain) AS gain, coalesce(offset_adu, p_offset) AS offset_adu, coalesce(set_temp, p_temp) AS set_temp) FROM path),
recipe AS (SELECT id, class, p_gain, p_offset, p_temp, CASE class WHEN 'dark' THEN {_key("dark")} ELSE {_key("flat")} END AS key, class || ': lacks ' || CASE class WHEN 'dark' THEN concat_ws(', ', CASE WHEN camera_id IS NULL THEN 'camera_id' END, CASE WHEN exptime IS NULL THEN 'exptime' END,
    CASE WHEN set_temp IS NULL THEN 'set_temp' END, CASE WHEN gain IS NULL THEN 'gain' END, CASE WHEN offset_adu IS NULL THEN 'offset_adu' END) ELSE concat_ws(', ', CASE WHEN camera_id IS NULL THEN 'camera_id' END, CASE WHEN telescope_id IS NULL THEN 'telescope_id' END) END AS why FROM fact),
profile AS (SELECT 1::BIGINT AS id, 'old' AS key, 'dark' AS class UNION ALL SELECT 1 + row_number() OVER (ORDER BY key), key, min(class) FROM recipe WHERE key IS NOT NULL GROUP BY key),
held AS (SELECT f.id, CASE WHEN f.id % 2 = 0 THEN 1 END AS before, p.id AS profile_id, CASE WHEN r.id IS NULL THEN 'no calibration frame' WHEN r.key IS NULL THEN r.why END AS why FROM frame f LEFT JOIN recipe r USING (id) LEFT JOIN profile p ON p.key = r.key)"""


def _recipes(c: Catalog) -> dimensions.Derived:
    k = F.col("id")
    frames = storage.cut(c.frames().select(
        "id", "kind", "camera_id", "telescope_id", "filter_canon", F.when(F.col("exptime").isNotNull(), (k % 4 + 1) * 60.0).alias("exptime"), F.col("set_temp").cast("long").alias("set_temp"), F.when(k % 5 != 0, F.col("gain")).cast("long").alias("gain"),
        F.when(k % 7 != 0, F.col("offset_adu")).alias("offset_adu"), "xbinning", F.element_at(F.array(*map(F.lit, _PATHS)), (F.floor(k / 2) % 3 + 1).cast("int")).alias("path"), F.when(k % 2 == 0, 1).cast("long").alias("profile_id"),
    ))
    facts = frames.select(F.col("id").alias("frame_id"), F.when(k % 3 == 0, "gain").when(k % 3 == 1, "set_temp_c").otherwise("note").alias("key"), (k % 4 * 50).cast("string").alias("value"), F.when(k % 2 == 0, "user").otherwise("path").alias("source"))
    old = c.spark.createDataFrame([(1, "old", "dark")], "id long, profile_key string, recipe_class string")
    return dimensions.calibrated(frames, old, facts)


@plan(f"{_RECIPES} SELECT id, key AS profile_key, class AS recipe_class FROM profile")
def state_recipes(c: Catalog) -> DataFrame:
    return _recipes(c).tables["calibration_profile"]


@plan(f"{_RECIPES} SELECT id, profile_id FROM held")
def state_frame_recipes(c: Catalog) -> DataFrame:
    return _recipes(c).frames.select("id", "profile_id")


@plan(f"""{_RECIPES}, open AS (SELECT why, count(*) AS n FROM recipe WHERE key IS NULL GROUP BY 1), found AS (SELECT id, unnest([p_gain, p_offset, p_temp]) AS value FROM recipe)
SELECT 'calibration_profile.proposed' AS verb, 'calibration_profile:' || id AS target, NULL AS reason FROM profile WHERE id > 1 UNION ALL SELECT 'calibration.fact', 'frame:' || id, NULL FROM found WHERE value IS NOT NULL
UNION ALL SELECT 'calibration_profile.unassigned', 'frame:' || id, why FROM held WHERE before IS NOT NULL UNION ALL SELECT 'calibration_profile.assigned', 'frame:' || id, NULL FROM held WHERE profile_id IS NOT NULL
UNION ALL SELECT 'calibration.review_item', 'frame:*', why FROM open UNION ALL SELECT 'calibration.review_summary', 'frame:*', NULL FROM open HAVING count(*) > 0""")
def events_calibration(c: Catalog) -> DataFrame:
    return _recipes(c).events.select("verb", "target", "reason")
