"""State changes are found by comparison: a run over its own result changes nothing and logs nothing. Expressions are those of Python."""

import pytest
from pyspark.sql import functions as F

from skyledger.operators import changes, edits, expression, macro, predicate, verbs, views

FIELDS = "id long, frame_id long, volume string, path string, present int, mtime string, unreadable_since string"


@pytest.fixture(scope="module")
def locations(spark):
    rows = [(1, 1, "V", "/a/1", 1, "m", None), (2, 1, "V", "/a/2", 0, "m", None), (3, 2, "V", "/a/3", 1, "m", "2020"), (4, 3, "W", "/b/4", 1, "m", None)]
    return spark.createDataFrame(rows, FIELDS)


def test_unreadable_is_quiet_the_second_time(spark, locations):
    failures = spark.createDataFrame([(1, "m2", "io"), (2, "m", "io"), (3, "m", "io"), (9, "m", "io")], "id long, mtime string, reason string")
    first = verbs.unreadable(locations, failures, F.lit("2025"))
    rows = {r.id: r for r in first.table.collect()}
    assert (rows[1].unreadable_since, rows[1].mtime, rows[2].present, rows[3].unreadable_since, rows[4].unreadable_since) == ("2025", "m2", 1, "2020", None)
    assert first.events.count() == 2
    again = verbs.unreadable(first.table, failures, F.lit("2026"))
    assert again.events.count() == 0 and sorted(again.table.collect()) == sorted(first.table.collect())


def test_vanished_and_back(spark, locations):
    gone = spark.createDataFrame([(1, "/a/1"), (2, "/a/2"), (3, "/other")], "id long, path string")
    first = verbs.vanished(locations, gone, "r")
    assert {r.id: r.outcome for r in first.outcome.collect()} == {1: "vanished", 2: "already gone", 3: "drifted"}
    assert first.events.count() == 1 and verbs.vanished(first.table, gone, "r2").events.count() == 0
    assert {r.id: r.present for r in first.table.collect()}[1] == 0


def test_presence_needs_a_walk_and_a_matching_force():
    assert verbs.may_mark({}, 0) == "no copy in scope" and verbs.may_mark({"seen": 5}, 0) == "the walk met no file"
    assert verbs.may_mark({"seen": 1000, "gone": 60}, 1000) is not None and verbs.may_mark({"seen": 1000, "gone": 50}, 1000) is None
    assert verbs.may_mark({"seen": 1000, "gone": 60}, 1000, force=60) is None and verbs.may_mark({"seen": 1000, "gone": 60}, 1000, force=59) is not None
    assert verbs.may_mark({"seen": 9000, "gone": 160, "hidden": 900}, 9000) is None


def test_upserted_ids_follow_keys(spark):
    known = spark.createDataFrame([(4, "b", "x")], "id long, canon string, catalog string")
    wanted = spark.createDataFrame([(c, "y") for c in ("d", "a", "b", "c", "a", None)], "canon string, catalog string")
    first = verbs.upserted(known, wanted, "canon", "object", ["catalog"])
    assert {r.canon: r.id for r in first.table.collect()} == {"b": 4, "a": 5, "c": 6, "d": 7}
    assert {r.canon: r.catalog for r in first.table.collect()}["b"] == "x" and first.events.count() == 3
    assert verbs.upserted(first.table, wanted, "canon", "object", ["catalog"]).events.count() == 0


def test_pointers_aliases_filters_and_links(spark):
    frames = spark.createDataFrame([(1, 5, "Ha"), (2, None, None), (3, 5, None)], "id long, object_id long, filter_canon string")
    wanted = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, object_id long")
    first = verbs.assigned(frames, wanted, "object_id", "object")
    assert sorted(r.verb for r in first.events.collect()) == ["object.assigned", "object.unassigned"]
    assert verbs.assigned(first.table, wanted, "object_id", "object").events.count() == 0
    canon = spark.createDataFrame([(1, "Ha"), (2, "L"), (3, None)], "id long, filter_canon string")
    filled = verbs.backfilled(frames, canon, "filter_canon")
    assert [r.payload for r in filled.events.collect()] == ['{"count":1}'] and verbs.backfilled(filled.table, canon, "filter_canon").events.count() == 0
    aliases = spark.createDataFrame([("A", 1, "user")], "alias_norm string, object_id long, source string")
    more = spark.createDataFrame([("A", 2, "header"), ("B", 4, "header"), ("B", 3, "header"), ("", 9, "header"), (None, 9, "header")], "alias_norm string, object_id long, source string")
    added = verbs.aliased(aliases, more)
    assert {r.alias_norm: r.object_id for r in added.table.collect()} == {"A": 1, "B": 3} and verbs.aliased(added.table, more).events.count() == 0
    links = spark.createDataFrame([(1, "dark", 7), (2, "dark", 8)], "light_id long, relation string, master_id long")
    new = spark.createDataFrame([(1, "dark", 7), (2, "dark", 9), (2, "flat", 5)], "light_id long, relation string, master_id long")
    linked = verbs.linked(links, new)
    assert sorted(r.verb for r in linked.events.collect()) == ["calibration.linked", "calibration.linked", "calibration.unlinked"]
    assert verbs.linked(linked.table, new).events.count() == 0
    facts = spark.createDataFrame([(1, "GAIN", "5", "user")], "frame_id long, key string, value string, source string")
    offered = spark.createDataFrame([(1, "GAIN", "6", "path"), (1, "OFFSET", "2", "path"), (1, "OFFSET", "3", "user")], "frame_id long, key string, value string, source string")
    recorded = verbs.facts_recorded(facts, offered)
    assert {(r.key, r.value) for r in recorded.table.collect()} == {("GAIN", "5"), ("OFFSET", "3")} and verbs.facts_recorded(recorded.table, offered).events.count() == 0
    assert verbs.review_summary(links.where("false").selectExpr("relation raw", "light_id n"), "object").count() == 0
    headers = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "frame_id long, object_raw string")
    seen = verbs.headers_recorded(headers.where("frame_id = 2"), headers)
    assert seen.events.count() == 1 and verbs.headers_recorded(seen.table, headers).events.count() == 0


def test_names_merges_and_approval(spark):
    scopes = spark.createDataFrame([(1, "A", "proposed", None), (2, None, "proposed", None), (3, None, "approved", None), (4, None, "proposed", 3)], "id long, label string, status string, merged_into long")
    names = spark.createDataFrame([(1, " A "), (2, "B"), (3, "  "), (9, "x"), (4, None)], "id long, name string")
    first = verbs.labelled(scopes, names, "telescope")
    assert {r.id: r.outcome for r in first.outcome.collect()} == {1: "no change", 2: "applied", 3: "refused: empty", 9: "refused: unknown", 4: "refused: empty"}
    assert verbs.labelled(first.table, names, "telescope").events.count() == 0
    ok = verbs.approved(scopes, scopes.select("id"))
    assert {r.id: r.outcome for r in ok.outcome.collect()} == {1: "applied", 2: "applied", 3: "no change", 4: "refused: merged"} and verbs.approved(ok.table, scopes.select("id")).events.count() == 0
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (1, 1)], "source long, target long")
    outcome = {(r.source, r.target): r.outcome for r in verbs.merged(scopes, changes.merges(scopes, pairs), "telescope").outcome.collect()}
    assert outcome == {(1, 2): "applied", (2, 3): "refused: chain", (3, 1): "refused: source has members", (4, 3): "no change", (1, 1): "refused: same"}
    free = verbs.unmerged(scopes, scopes.select("id"), "telescope")
    assert free.events.count() == 1 and verbs.unmerged(free.table, scopes.select("id"), "telescope").events.count() == 0


def test_renames_relocations_and_staging(spark, locations):
    staged = spark.createDataFrame([(1, 1, "/a/1", "/a/3", "m"), (2, 2, "/a/2", "/a/9", "m"), (3, 3, "/a/3", "/a/8", "old"), (4, 4, "/b/4", "/a/1", "m"), (5, 77, "/x", "/y", "m")], "id long, location_id long, old_path string, new_path string, expected_mtime string")
    assert {r.id: r.outcome for r in verbs.rename_outcome(staged, locations).collect()} == {1: "blocked: path is taken", 2: "skipped: not present", 3: "blocked: changed since", 4: "apply", 5: "failed: no copy"}
    wanted = spark.createDataFrame([(1, "/a/1"), (2, "/a/9"), (3, "/a/9"), (4, "/a/1"), (9, "/z")], "id long, new_path string")
    moved = verbs.relocated(locations, wanted)
    assert {r.id: r.outcome for r in moved.outcome.collect()} == {1: "no change", 2: "refused: path is taken", 3: "refused: path is taken", 4: "applied", 9: "refused: unknown"}
    assert {r.id: r.path for r in moved.table.collect()}[4] == "/a/1" and verbs.relocated(moved.table, wanted).events.count() == 0


CASES = [
    "1 + 2", "7 // 2", "-7 % 3", "7 % -3", "-7.5 // 2", "1 / 0", "'a' + 'b'", "'ab' * 2", "A + 1", "A + B", "T + 'x'", "T * 2", "T - 1", "round(A)", "round(A, 1)", "int(A)", "int('12')", "int('x')", "float('1e3')",
    "str(A)", "len(T)", "len(A)", "min(A, 3)", "max('a', T)", "min(A, T)", "abs(-3)", "Z + 1", "str(1e16)", "str(0.00001)", "str(1234567.5)", "str(1e22)", "1e15 * 10", "True + 1", "str(7 // 2)", "float(T)", "-T",
]


def test_expressions_are_those_of_python(spark):
    env = {"A": expression.cell("A", F.lit(None).cast("string"), F.col("a")), "B": expression.cell("B", F.lit(None).cast("string"), F.col("b")), "T": expression.cell("T", F.col("t"), F.lit(None).cast("double"))}
    values = [expression.compiled(c, env) for c in CASES]
    row = spark.createDataFrame([(2.75, None, "raw")], "a double, b double, t string").select(*(F.struct(F.when(v.error.isNull(), expression.shown(v)).alias("v"), v.kind.alias("k"), v.error.alias("e")).alias(f"c{n}") for n, v in enumerate(values))).first()
    reasons = {ZeroDivisionError: expression.ZERO, TypeError: expression.TYPE, ValueError: expression.VALUE}
    for case, got in zip(CASES, row):
        try:
            wanted = eval(case, {}, {"A": 2.75, "T": "raw"})
        except NameError:
            assert got.e.startswith(expression.MISSING), case
        except Exception as e:  # noqa: BLE001
            assert got.e == reasons[type(e)] and got.v is None, case
        else:
            assert (got.v, got.k, got.e) == (str(wanted), type(wanted).__name__, None), case


@pytest.mark.parametrize("source", ["", "A.b", "A[0]", "A ** 2", "f(A)", "round(A, places=1)", "min(*A)", "lambda: 1", "A = 1", "None", "A if B else 1"])
def test_other_expressions_are_refused(source):
    with pytest.raises(edits.Refused):
        expression.parsed(source)


def test_rules_write_what_fits_a_card(spark):
    targets = spark.createDataFrame([(1, 10, None), (2, 20, None), (3, None, "no present copy")], "id long, location_id long, reason string")
    cards = [(1, "GAIN", 0, "100", 100.0, "int"), (1, "FLAG", 0, "T", None, "bool"), (1, "NAME", 0, "x", None, "str"), (1, "EXP", 0, "1.5", 1.5, "float"), (2, "NAME", 0, "a", None, "str"), (2, "NAME", 1, "b", None, "str")]
    cards = spark.createDataFrame(cards, "frame_id long, keyword string, idx int, value_raw string, value_num double, value_type string")

    def run(*args, **kw):
        return {r.id: (r.new_value, r.new_type, r.reason) for r in macro.run(targets, cards, macro.Rule(*args, **kw)).collect()}

    gone = (None, None, "no present copy")
    assert run("GAIN", "set", "GAIN * 2") == {1: ("200", "int", None), 2: (None, None, "no card to set"), 3: gone}
    assert run("GAIN", "set", "GAIN / 3")[1][2] == "not a whole number" and run("GAIN", "set", "1 / 0")[1][2] == "assign: division by zero"
    assert run("EXP", "set", "EXP + 1")[1] == ("2.5", "float", None) and run("EXP", "set", "2")[1] == ("2.0", "float", None)
    assert run("FLAG", "set", "yes")[1] == ("T", "bool", None) and run("FLAG", "set", "EXP > 1")[1][1] == "bool"
    assert run("NAME", "set", "true")[1] == ("true", "str", None) and run("NAME", "set", "'a' + str(GAIN)")[1] == ("a100.0", "str", None)
    assert run("NAME", "set", "x y z")[2][2] == "several cards: idx wanted" and run("NAME", "set", "q", idx=1)[2] == ("q", "str", None) and run("NAME", "set", "q", idx=5)[2][2] == "no card of that idx"
    assert run("NEW", "add", "true")[1] == ("T", "bool", None) and run("NEW", "add", "5")[1] == ("5", "int", None) and run("NEW", "add", "5", value_type="float")[1] == ("5.0", "float", None)
    assert run("GAIN", "add", "5")[1][2] == "card exists"
    assert run("NEW", "add", "half + 1", computes=(("half", "GAIN / 2"),))[1] == ("51.0", "float", None) and run("NEW", "add", "half", computes=(("half", "GAIN / 2"),))[2][2] == "compute half: missing operand: GAIN"
    with pytest.raises(edits.Refused):
        macro.Rule("A", "drop", "1")


def test_grid_and_groups_keep_missing_last(spark):
    rows = spark.createDataFrame([(1, 5.0, None, True), (2, None, "b", True), (3, None, None, False), (4, -1.0, None, True), (5, None, "A", True), (6, None, None, True)], "id long, num double, raw string, there boolean")
    order = lambda d: [r.id for r in rows.orderBy(*views.grid_order(F.col("num"), F.col("raw"), F.col("there"), d)).collect()]
    assert order(False) == [4, 1, 6, 5, 2, 3] and order(True) == [2, 5, 6, 1, 4, 3]
    assert [r.id for r in rows.orderBy(*views.group_order(F.col("num"), True), "id").collect()][:2] == [4, 1]


def test_facet_state_cycles_and_trees_have_words():
    one = predicate.cycled({}, "kind", "light")
    two = predicate.cycled(one, "kind", "light")
    assert one == {"kind": {"in": ["light"], "out": []}} and two == {"kind": {"in": [], "out": ["light"]}} and predicate.cycled(two, "kind", "light") == {}
    assert predicate.described({"op": "NOT", "conditions": [{"op": "OR", "conditions": [{"facet": "kind", "value": "x"}, {"keyword": "B", "operator": "exists"}]}]}) == "not ((kind = x or B exists))"
    with pytest.raises(ValueError):
        predicate.compiled({"keyword": "A", "operator": "regex", "value": "x"})
    with pytest.raises(ValueError):
        predicate.compiled({"keyword": "A;B", "operator": "exists"})
    assert predicate.described(None) == "all" and predicate.described({"keyword": "A", "operator": "gt", "value": 3}) == "A gt 3"


def test_a_second_ingest_changes_nothing(spark):
    records = [("V", "/1", "a", "light", "fits", "m", 5, "h", None), ("V", "/2", "a", "light", "fits", "m", 5, "h", None), ("V", "/3", "b", "dark", "fits", "m", 5, None, "broken"), ("V", "/4", "c", "light", "fits", "n", 6, "h2", None), ("V", "/5", "d", "flat", "fits", "m", 5, None, "broken"), ("V", "/1", "z", "light", "fits", "m", 5, "h", None)]
    records = spark.createDataFrame(records, "volume string, path string, sha1_data string, kind string, filetype string, mtime string, size_bytes long, header_hash string, error string")
    frames = spark.createDataFrame([(1, "old", "light", "fits"), (2, "c", "light", "fits")], "id long, sha1_data string, kind string, filetype string")
    copies = [(10, 1, "V", "/2", 0, "m", 5, "h", "2020"), (11, 2, "V", "/4", 1, "m", 6, "h", None), (12, 1, "V", "/5", 1, "m", 5, "h", None), (13, 1, "V", "/9", 1, "m", 5, "h", None)]
    copies = spark.createDataFrame(copies, "id long, frame_id long, volume string, path string, present int, mtime string, size_bytes long, header_hash string, unreadable_since string")
    first = verbs.ingested(records, frames, copies, F.lit("now"))
    sha = {r.id: r.sha1_data for r in first.frames.collect()}
    assert sha == {1: "old", 2: "c", 3: "a", 4: "b"} and {r.sha1_data: r.kind for r in first.frames.collect()}["b"] == "unknown"
    rows = {r.path: r for r in first.locations.collect()}
    assert {p: sha[r.frame_id] for p, r in rows.items()} == {"/1": "a", "/2": "a", "/3": "b", "/4": "c", "/5": "old", "/9": "old"}
    assert (rows["/2"].present, rows["/2"].unreadable_since, rows["/4"].mtime, rows["/5"].unreadable_since, rows["/3"].unreadable_since) == (1, None, "n", "now", "now")
    assert sorted(r.verb for r in first.events.collect()) == ["frame.observed", "frame.observed", "frame.review", "frame.review", "location.added", "location.added", "location.rebound", "location.refreshed"]
    again = verbs.ingested(records, first.frames, first.locations, F.lit("later"))
    assert again.events.count() == 0 and sorted(again.locations.collect()) == sorted(first.locations.collect()) and again.frames.count() == 4


def test_tables_take_their_shape(spark):
    from skyledger import schemas

    found = schemas.conformed(spark.createDataFrame([("7", 1)], "canon string, id int"), "object")
    assert found.columns == ["id", "canon", "catalog", "kind"] and found.schema["id"].dataType.simpleString() == "bigint" and found.first().catalog is None
    with pytest.raises(ValueError):
        schemas.conformed(spark.range(1).withColumn("more", F.lit(1)), "object")
    assert all(schemas.empty(spark, t).count() == 0 for t in schemas.TABLES[schemas.VERSION])
