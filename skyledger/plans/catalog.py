"""Queries over the bridged catalog, each with the SQL that an independent engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.bridge import SQL, Catalog
from skyledger.functions import resolve, sky, text
from skyledger.operators import changes, derive, edits, expression, facets, naming, predicate, reviews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plan(sql: str | None = None):
    """Registers a query over a Catalog by its function's name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = SQL + sql
        return f

    return register


def selected(name: str, tree: dict | None, sql: str) -> None:
    """Registers the frame ids that a predicate tree selects."""
    QUERIES[name] = lambda spark, sf_dir: predicate.select((c := Catalog(spark, sf_dir)).frames(), c.cards(), tree).select("id")
    ORACLE[name] = f"{SQL} SELECT id FROM frame f WHERE {sql}"


def _card(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM cards c WHERE c.frame_id = f.id AND {test})"


condition = lambda keyword, operator, value=None: {"keyword": keyword, "operator": operator, "value": value}
group = lambda op, *conditions: {"op": op, "conditions": list(conditions)}

selected("flt_exists", condition("PRICE", "exists"), _card("keyword = 'PRICE'"))
selected("flt_not_exists", condition("PRICE", "not_exists"), "NOT " + _card("keyword = 'PRICE'"))
selected("flt_gt_lt_range", group("AND", condition("PRICE", "gt", 100000), condition("PRICE", "le", "200000")), _card("keyword = 'PRICE' AND value_num > 100000") + " AND " + _card("keyword = 'PRICE' AND value_num <= 200000"))
selected("flt_ge", condition("GAIN", "ge", 100), _card("keyword = 'GAIN' AND value_num >= 100"))
selected("flt_lt", condition("GAIN", "lt", 100), _card("keyword = 'GAIN' AND value_num < 100"))
selected("flt_eq_text", condition("STATUS", "eq", "F"), _card("keyword = 'STATUS' AND value_raw = 'F'"))
selected("flt_eq_bool", condition("STATUS", "eq", False), _card("keyword = 'STATUS' AND value_raw = 'F'"))
selected("flt_eq_numlike", condition("GAIN", "eq", "100.0"), _card("keyword = 'GAIN' AND (value_raw = '100.0' OR value_num = 100)"))
selected("flt_ne_text", condition("PRIORITY", "ne", "5-LOW"), _card("keyword = 'PRIORITY' AND value_raw <> '5-LOW'"))
selected("flt_ne_numlike", condition("GAIN", "ne", 100), _card("keyword = 'GAIN' AND value_raw <> '100' AND (value_num IS NULL OR value_num <> 100)"))
selected("flt_contains_ci", condition("HISTORY", "contains", "dARK"), _card("keyword = 'HISTORY' AND lower(value_raw) LIKE '%dark%'"))
selected("flt_contains_percent", condition("HISTORY", "contains", "0%"), _card("keyword = 'HISTORY' AND contains(value_raw, '0%')"))
selected("flt_startswith_ci", condition("PRIORITY", "startswith", "1-urg"), _card("keyword = 'PRIORITY' AND lower(value_raw) LIKE '1-urg%'"))
selected(
    "flt_and_or_not",
    group("AND", group("OR", condition("STATUS", "eq", "F"), condition("PRICE", "not_exists")), group("NOT", condition("PRIORITY", "eq", "5-LOW")), {"facet": "kind", "value": "light"}),
    f"({_card('keyword = ' + chr(39) + 'STATUS' + chr(39) + ' AND value_raw = ' + chr(39) + 'F' + chr(39))} OR NOT {_card('keyword = ' + chr(39) + 'PRICE' + chr(39))}) AND NOT {_card('keyword = ' + chr(39) + 'PRIORITY' + chr(39) + ' AND value_raw = ' + chr(39) + '5-LOW' + chr(39))} AND kind = 'light'",
)
selected("flt_empty_group_universe", group("AND"), "true")
selected("flt_not_empty_is_none", group("NOT", group("OR")), "false")
selected("flt_facet_object", {"facet": "object", "value": 7}, "object_id = 7")
selected("flt_facet_telescope", {"facet": "telescope", "value": 10}, "telescope_canon_id = 10")
selected("facet_night_leaf", {"facet": "night", "value": "1997-05-28"}, "date_obs >= '1997-05-28T12:00:00' AND date_obs < '1997-05-29T12:00:00'")
selected("flt_not_night_keeps_timeless", group("NOT", {"facet": "night", "value": "1997-05-28"}), "NOT coalesce(date_obs >= '1997-05-28T12:00:00' AND date_obs < '1997-05-29T12:00:00', false)")

FACET_SQL = " UNION ALL ".join(f"SELECT '{name}' AS facet, {column}::VARCHAR AS value, count(*) AS n FROM frame WHERE {column} IS NOT NULL GROUP BY 2" for name, column in facets.FACETS.items())


@plan(f"SELECT facet, value, n FROM ({FACET_SQL})")
def facet_counts(c: Catalog) -> DataFrame:
    return facets.counts(c.frames())


def _one_facet(name: str) -> None:
    column = facets.FACETS[name]
    QUERIES[f"facet_{name}"] = lambda spark, sf_dir: facets.counts(Catalog(spark, sf_dir).frames(), {name: column}).select("value", "n")
    ORACLE[f"facet_{name}"] = f"{SQL} SELECT {column}::VARCHAR AS value, count(*) AS n FROM frame WHERE {column} IS NOT NULL GROUP BY 1"


for _name in facets.FACETS:
    _one_facet(_name)

STATE = {"kind": {"in": ["light", "flat"]}, "filter": {"out": ["Ha"]}}
_KIND, _FILTER, _PRICE = "kind IN ('light', 'flat')", "NOT coalesce(filter_canon = 'Ha', false)", "EXISTS (SELECT 1 FROM cards c WHERE c.frame_id = frame.id AND keyword = 'PRICE')"
_SIBLING = {"kind": f"{_FILTER} AND {_PRICE}", "filter": f"{_KIND} AND {_PRICE}"}
SIBLING_SQL = " UNION ALL ".join(f"SELECT '{n}' AS facet, {col}::VARCHAR AS value, count(*) AS n FROM frame WHERE {col} IS NOT NULL AND {_SIBLING.get(n, f'{_KIND} AND {_FILTER} AND {_PRICE}')} GROUP BY 2" for n, col in facets.FACETS.items())


@plan(f"SELECT facet, value, n FROM ({SIBLING_SQL})")
def facet_sibling_counts(c: Catalog) -> DataFrame:
    return facets.sibling_counts(c.frames(), c.cards(), STATE, condition("PRICE", "exists"))


@plan("SELECT keyword, count(DISTINCT frame_id) AS n FROM cards GROUP BY 1")
def keyword_coverage(c: Catalog) -> DataFrame:
    return facets.coverage(c.cards())


@plan("""SELECT f.id, f.kind, f.filter_canon, f.exptime, coalesce(t.label, t.telescop_canon) AS telescope, coalesce(o.canon, f.object_raw) AS object,
(SELECT arg_min(path, l.id) FROM location l WHERE l.frame_id = f.id) AS path, (SELECT arg_min(volume, l.id) FROM location l WHERE l.frame_id = f.id) AS volume,
(SELECT count(*) FROM location l WHERE l.frame_id = f.id AND present = 1) AS n_present FROM frame f LEFT JOIN telescope t ON t.id = f.telescope_canon_id LEFT JOIN object o ON o.id = f.object_id""")
def grid_base_rows(c: Catalog) -> DataFrame:
    return facets.base_rows(c.frames(), c.locations(), c.telescopes(), c.objects())


@plan("""SELECT f.id, p.frame_id IS NOT NULL AS "has_PRICE", p.value_raw AS "PRICE_raw", p.value_num AS "PRICE_num", h.frame_id IS NOT NULL AS "has_HISTORY", h.value_raw AS "HISTORY_raw", h.value_num AS "HISTORY_num"
FROM frame f LEFT JOIN cards p ON p.frame_id = f.id AND p.keyword = 'PRICE' LEFT JOIN cards h ON h.frame_id = f.id AND h.keyword = 'HISTORY' AND h.idx = 0""")
def grid_pivot(c: Catalog) -> DataFrame:
    return facets.pivot(c.frames(), c.cards(), ["PRICE", "HISTORY"])


@plan("""SELECT coalesce(filter_canon, '(none)') AS label, 1 AS is_header, count(*) AS n, NULL::BIGINT AS id FROM frame WHERE kind = 'light' GROUP BY 1
UNION ALL SELECT coalesce(filter_canon, '(none)'), 0, NULL, id FROM frame WHERE kind = 'light'""")
def grid_sorted_group_headers(c: Catalog) -> DataFrame:
    return facets.group_headers(c.frames().where("kind = 'light'"), F.col("filter_canon"), [F.col("id")])


EXPOSURE_SQL = "SELECT object_id, filter_canon, round(sum(exptime), 2) AS secs, count(*) FILTER (exptime IS NULL) AS n_null FROM frame WHERE kind = 'light' AND object_id IS NOT NULL GROUP BY 1, 2"


@plan(EXPOSURE_SQL)
def portfolio_object_filter(c: Catalog) -> DataFrame:
    return facets.exposure(c.frames())


@plan(f"""SELECT object_id, round(sum(coalesce(secs, 0)), 2) AS secs, sum(n_null)::BIGINT AS n_null, string_agg(coalesce(filter_canon, '-'), ',' ORDER BY coalesce(secs, 0) DESC, coalesce(filter_canon, '-')) AS filters
FROM ({EXPOSURE_SQL}) GROUP BY 1""")
def portfolio_rollup(c: Catalog) -> DataFrame:
    return facets.portfolio(facets.exposure(c.frames()))


@plan("SELECT frame_id AS id, count(*) AS n FROM location WHERE present = 1 GROUP BY 1 HAVING count(*) > 1")
def dup_frames(c: Catalog) -> DataFrame:
    return reviews.duplicates(c.locations())


@plan("SELECT id FROM frame f WHERE EXISTS (SELECT 1 FROM location l WHERE l.frame_id = f.id) AND NOT EXISTS (SELECT 1 FROM location l WHERE l.frame_id = f.id AND present = 1)")
def vanished_frames(c: Catalog) -> DataFrame:
    return reviews.vanished(c.locations())


@plan("SELECT id FROM frame WHERE kind IN ('light', 'master_light') AND object_id IS NULL AND has_header")
def review_frames(c: Catalog) -> DataFrame:
    return reviews.flags(c.frames(), c.locations()).where("no_object").select("id")


@plan("""SELECT count(*) FILTER (NOT has_header) AS no_header, count(*) FILTER (has_header AND camera_id IS NULL) AS no_camera, count(*) FILTER (has_header AND telescope_id IS NULL) AS no_telescope,
count(*) FILTER (kind IN ('light', 'master_light') AND object_id IS NULL AND has_header) AS no_object, count(*) FILTER (NOT EXISTS (SELECT 1 FROM location l WHERE l.frame_id = frame.id)) AS no_copy,
count(*) FILTER (NOT has_header OR camera_id IS NULL OR telescope_id IS NULL OR (kind IN ('light', 'master_light') AND object_id IS NULL) OR NOT EXISTS (SELECT 1 FROM location l WHERE l.frame_id = frame.id)) AS total FROM frame""")
def review_state(c: Catalog) -> DataFrame:
    return reviews.review_state(c.frames(), c.locations())


@plan("SELECT object_raw, count(*) AS n FROM frame WHERE kind IN ('light', 'master_light') AND object_id IS NULL AND object_raw IS NOT NULL GROUP BY 1")
def review_queue(c: Catalog) -> DataFrame:
    return reviews.review_queue(c.frames())


@plan("SELECT count(object_id) AS resolved, count(*) - count(object_id) AS unresolved, count(filter_canon) AS filters, round(100.0 * count(object_id) / count(*), 1)::DOUBLE AS pct FROM frame WHERE kind IN ('light', 'master_light')")
def delta_report(c: Catalog) -> DataFrame:
    return reviews.delta_report(c.frames())


@plan("""SELECT (SELECT count(*) FROM frame) AS n_frames, (SELECT count(*) FROM frame WHERE object_id IS NULL) AS n_unresolved, (SELECT count(*) FROM location WHERE present = 0) AS n_gone,
(SELECT count(DISTINCT volume) FROM location) AS n_volumes, (SELECT count(*) FROM event) AS n_events""")
def tasks_state(c: Catalog) -> DataFrame:
    return reviews.tasks(c.frames(), c.locations(), c.events())


@plan("""SELECT t.id, t.telescop_canon, t.label, coalesce(n, 0) AS n FROM telescope t LEFT JOIN (SELECT telescope_canon_id AS id, count(*) AS n FROM frame WHERE telescope_canon_id IS NOT NULL GROUP BY 1) USING (id) WHERE merged_into IS NULL""")
def active_telescopes(c: Catalog) -> DataFrame:
    return derive.per_canonical(c.telescopes(), c.frames(), "telescope_id").select("id", "telescop_canon", "label", F.col("n").cast("long").alias("n"))


@plan("SELECT id, canon, (SELECT count(*) FROM frame f WHERE f.object_id = object.id AND kind IN ('light', 'master_light') AND filter_canon = 'Ha' AND camera_id = 1) AS n FROM object WHERE n > 0")
def library_objects(c: Catalog) -> DataFrame:
    light = c.frames().where(F.col("kind").isin("light", "master_light") & (F.col("filter_canon") == "Ha") & (F.col("camera_id") == 1))
    counted = light.groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("n"))
    return c.objects().join(counted, "id").select("id", "canon", "n")


@plan("SELECT id, telescop_canon FROM telescope WHERE merged_into = 10")
def merged_under(c: Catalog) -> DataFrame:
    return derive.members(c.telescopes(), 10).select("id", "telescop_canon")


@plan("SELECT id, coalesce(merged_into, id) AS canon_id FROM telescope")
def canonical_closure(c: Catalog) -> DataFrame:
    return derive.canonical(c.telescopes())


@plan("SELECT id, ts, actor, verb, target FROM event ORDER BY id DESC LIMIT 50")
def audit_tail(c: Catalog) -> DataFrame:
    return reviews.audit(c.events(), None, 50).select("id", "ts", "actor", "verb", "target")


@plan("SELECT id, ts, actor, verb, target FROM event WHERE target = 'click:46' ORDER BY id DESC LIMIT 20")
def audit_of_target(c: Catalog) -> DataFrame:
    return reviews.audit(c.events(), "click:46", 20).select("id", "ts", "actor", "verb", "target")


@plan("SELECT DISTINCT filter_canon FROM frame WHERE filter_canon IS NOT NULL")
def filter_values(c: Catalog) -> DataFrame:
    return c.frames().where("filter_canon is not null").select("filter_canon").distinct()


@plan("SELECT f.id, l.id AS location_id, l.path, l.volume FROM frame f LEFT JOIN location l ON l.frame_id = f.id AND l.present = 1")
def present_copies(c: Catalog) -> DataFrame:
    asked = c.frames().select("id")
    copies = c.locations().where("present = 1").select(F.col("frame_id").alias("id"), F.col("id").alias("location_id"), "path", "volume")
    return asked.join(copies, "id", "left")


@plan("SELECT keyword, idx, value_raw, value_num FROM cards WHERE frame_id = 8")
def frame_cards(c: Catalog) -> DataFrame:
    return c.cards().where("frame_id = 8").select("keyword", "idx", "value_raw", "value_num").orderBy("keyword", "idx")


# Truth tables: raw values with what they come to, dealt over the orders by key.
FILTERS = [("Ha", "Ha"), (" h-alpha ", "Ha"), ("sii", "SII"), ("LUM", "L"), ("L-Pro", "L-Pro"), ("lext", "L-eXtreme"), ("clear", None), ("3", None), ("", None), (" Custom ", "Custom"), ("no  filter", None), ("O3", "OIII")]
KINDS = [("Light Frame", "light"), ("LIGHT", "light"), ("Master_Flat", "master_flat"), ("master  dark", "master_dark"), ("integration", "master_light"), ("Dark frame", "dark"), ("tricolor", "unknown"), ("", "unknown"), (None, "unknown"), ("bias", "bias")]
PATH_KINDS = [("/a/LIGHTS/x.dng", "light"), ("C:\\pics\\Darks\\y.arw", "dark"), ("/flat/bias/z.cr2", "flat"), ("/lightsaber/z.cr2", "unknown"), ("biases", "bias")]
CAMERAS = [("ZWO ASI2600MM Pro", "ASI2600MM"), ("ZWO ASI2600MM Duo", "ASI2600MD"), ("asi 294mc pro", "ASI294MC"), ("ASI0174", "ASI174"), ("Sony ILCE-7RM3A", "SONYA7RM3"), ("ILCE-7S", "A7S"), ("ZWO CCD", None), (None, None), ("Canon EOS 6D", "CANONEOS6D")]
DESIGNATIONS = [("ngc 0224", "NGC224"), ("Messier 031", "M31"), ("sh2 131", "Sh2-131"), ("Sh 2-184", "Sh2-184"), ("Caldwell 23", "C23"), ("NGC4631_PGC42637", "NGC4631"), ("barnard 33", "B33"), ("Abell 0021", "Abell21"), ("van den bergh 14", "vdB14"), ("Cederblad 214", "Ced214"), ("Collinder 399", "Cr399"), ("CTB 1", "CTB1"), ("LDN 1174", "LDN1174"), ("Rosette", None), ("M 1000", None), ("", None)]
PREFERRED = [("M31", "NGC224"), ("C23", "NGC891"), ("Sh2-190", "IC1805"), ("M45", "M45"), ("NGC7000", "NGC7000"), (None, None)]
LABELLED = [("NGC224", "NGC"), ("Sh2-131", "Sh2"), ("Cr399", "Collinder"), ("CTB1", "CTB"), ("C23", "Caldwell"), ("B33", "Barnard"), ("M45", "Messier"), ("vdB14", "vdB"), ("Veil", None), (None, None)]
SOLAR = [("Księżyc", "Moon"), ("saturn", "Saturn"), ("Saturn Nebula", None), ("c/2025 a6", "C/2025 A6 (Lemmon)"), ("P2019Y4", "P/2019 Y4"), ("Comet Lemmon", "C/2025 A6 (Lemmon)"), ("Lemmons", None), ("Giacobini-Zinner", "21P/Giacobini-Zinner"), ("SŁOŃCE", None), (None, None)]
OBJECTS = [("M 31", "NGC224"), ("NGC 7000", "NGC7000"), ("Sh2-190", "IC1805"), ("Rosette Nebula", "NGC2237"), ("Bode's Galaxy", "NGC3031"), ("Moon", "Moon"), ("C/2025 A6", "C/2025 A6 (Lemmon)"), ("the heart", "IC1805"), ("somewhere", None), ("LDN 1174", "NGC7023"), ("", None)]
COORDINATES = [("50.123", 50.123), ("+41 12 30.0", 41 + 12 / 60 + 30 / 3600), ("-0 30 0", -0.5), (" 7 ", 7.0), ("nan", None), ("41:12:30", None), ("18 9 1.2.3", None), ("", None), (None, None), ("1e2", 100.0)]
HEADER_TIMES = [("2024-01-02T03:04:05.678Z", "2024-01-02 03:04:05"), (" 2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02", None), ("2024-13-40T00:00:00", None), ("", None), (None, None), ("x2024-01-02T03:04:05", None)]
FILE_TIMES = [("a_2024-01-02_03-04-05.fits", "2024-01-02 03:04:05"), ("20240102-030405_x.xisf", "2024-01-02 03:04:05"), ("120240102_0304051.fits", None), ("20241302_030405.fits", None), ("none.fits", None)]
NUMBERS = [("3.5", 3.5), (" -2 ", -2.0), ("3.5f", None), ("3d", None), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("", None), ("x", None), (None, None), ("0", 0.0)]
INTEGERS = [("100.0", 100), ("-2.9", -2), ("0", 0), ("", None), ("1e2", 100), ("abc", None)]
NORMS = [("  a  b\tc ", "A B C"), ("ä", "Ä"), ("", ""), (None, None)]
ALNUMS = [("Bode's Galaxy", "BODESGALAXY"), ("a-1 b_2", "A1B2"), ("", "")]
SAFE = [(" a b/c ", "a_b_c"), ("__x__", "x"), ("ok-1.0+2", "ok-1.0+2"), ("///", ""), ("", "")]
QUOTED = [("'It''s  '", "It's"), ("plain", "plain"), ("''", ""), ("'a' b", "'a' b")]
EXPOSURES = [(300.0, "300s"), (0.5, "0.5s"), (1.25, "1.25s"), (12345.678, "12345.7s"), (60.10, "60.1s"), (0.0, "0s")]
MONO = [("ASI2600MM", 1), ("ASI294MC", 0), ("ASI2600MD", 1), ("A7S", None), (None, None)]


def truths(name: str, table: list[tuple], f: Callable[[Column], Column], kind: str = "string") -> None:
    """Registers a function over raw values; the oracle picks the known answer by the same key."""
    raws, answers = [raw for raw, _ in table], [a for _, a in table]
    raw_kind = "double" if isinstance(next(r for r in raws if r is not None), float) else "string"
    sql_kind = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT"}[kind]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        picked = F.element_at(F.array(*(F.lit(r).cast(raw_kind) for r in raws)), (F.col("o_orderkey") % len(raws) + 1).cast("int"))
        found = f(picked)
        return Catalog(spark, sf_dir).table("orders").select(F.col("o_orderkey").alias("id"), (F.round(found, 6) if kind == "double" else found.cast(kind)).alias("value"))

    QUERIES[name] = query
    shown = ", ".join("NULL" if a is None else str(a) if isinstance(a, (int, float)) else "'" + a.replace("'", "''") + "'" for a in answers)
    value = f"list_extract([{shown}]::{sql_kind}[], o_orderkey % {len(raws)} + 1)"
    ORACLE[name] = f"SELECT o_orderkey AS id, {f'round({value}, 6)' if kind == 'double' else value} AS value FROM orders"


truths("norm_filter", FILTERS, resolve.filter_name)
truths("norm_kind", KINDS, resolve.kind)
truths("kind_from_path", PATH_KINDS, resolve.kind_of_path)
truths("norm_camera", CAMERAS, resolve.camera)
truths("camera_mono", MONO, lambda c: resolve.is_mono(F.lit(None).cast("string"), c, F.lit(None).cast("string"))["is_mono"], "int")
truths("designation_canon", DESIGNATIONS, resolve.designation)
truths("designation_xref", PREFERRED, resolve.preferred)
truths("designation_label", LABELLED, resolve.catalogue)
truths("solar_body", SOLAR, resolve.solar)
truths("object_canon", OBJECTS, lambda c: resolve.sky_object(c)["canon"])
truths("coord_parse", COORDINATES, sky.coordinate, "double")
truths("header_dt", HEADER_TIMES, sky.header_time)
truths("filename_dt", FILE_TIMES, sky.file_time)
truths("to_float", NUMBERS, text.to_float, "double")
truths("to_int", INTEGERS, text.to_int, "bigint")
truths("text_norm", NORMS, text.norm)
truths("text_alnum", ALNUMS, text.norm_alnum)
truths("text_sanitize", SAFE, text.sanitize)
truths("text_unquote", QUOTED, text.unquote)
truths("exposure_token", EXPOSURES, sky.exposure_token)


@plan("SELECT p_partkey AS id, regexp_replace(upper(trim(regexp_replace(p_name || ' ' || p_brand, '\\s+', ' ', 'g'))), '[^A-Z0-9]+', '', 'g') AS alnum FROM part")
def part_alnum(c: Catalog) -> DataFrame:
    return c.table("part").select(F.col("p_partkey").alias("id"), text.norm_alnum(F.concat_ws(" ", "p_name", "p_brand")).alias("alnum"))


@plan("SELECT id, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, lat FROM (SELECT id, lat, lon + 170 AS lon FROM point) WHERE NOT (lat = 0 AND lon = 0)")
def site_normalise(c: Catalog) -> DataFrame:
    found = c.points().select("id", sky.site(F.col("lat").cast("string"), (F.col("lon") + 170).cast("string")).alias("s"))
    return found.where("s is not null").select("id", "s.lat", "s.lon")


_KM = "2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))))"


@plan(f"""SELECT id, site_id, km FROM (SELECT p.id, s.id AS site_id, round({_KM}, 6) AS km, row_number() OVER (PARTITION BY p.id ORDER BY round({_KM}, 6), s.id) AS n FROM point p, site s WHERE round({_KM}, 6) <= 900) WHERE n = 1""")
def site_nearest(c: Catalog) -> DataFrame:
    return derive.nearest_site(c.points(), c.sites(), 900.0)


@plan()
def site_clusters(c: Catalog) -> DataFrame:
    return derive.site_seeds(c.points(), 700.0).select("id", "lat", "lon")


@plan()
def site_assign(c: Catalog) -> DataFrame:
    return derive.observatories(c.points(), 700.0).select("id", "site_id")


@plan("SELECT id, round(2 * degrees(asin(least(1, sqrt(pow(sin(radians(30.67 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30.67)) * pow(sin(radians(312.75 - lon) / 2), 2))))), 6) AS deg FROM point")
def region_distance(c: Catalog) -> DataFrame:
    return c.points().select("id", F.round(sky.separation_deg(F.col("lon"), F.col("lat"), F.lit(312.75), F.lit(30.67)), 6).alias("deg"))


RESOLVED_SQL = """(SELECT id, kind, CASE object_raw WHEN 'M 31' THEN 'NGC224' WHEN 'NGC 7000' THEN 'NGC7000' WHEN 'Sh2-190' THEN 'IC1805' WHEN 'Rosette Nebula' THEN 'NGC2237' WHEN 'Bode''s Galaxy' THEN 'NGC3031' WHEN 'Moon' THEN 'Moon'
WHEN 'C/2025 A6' THEN 'C/2025 A6 (Lemmon)' WHEN 'Comet Lemmon' THEN 'C/2025 A6 (Lemmon)' WHEN 'Saturn' THEN 'Saturn' WHEN 'LDN 1174' THEN 'NGC7023' WHEN 'The Veil' THEN 'Veil' END AS canon,
CASE WHEN object_raw IN ('M 31', 'Sh2-190', 'LDN 1174') THEN 'catalog_xref' WHEN object_raw = 'NGC 7000' THEN 'header' WHEN object_raw IN ('Rosette Nebula', 'Bode''s Galaxy') THEN 'common_name' WHEN object_raw IN ('Moon', 'Saturn') THEN 'solar'
WHEN object_raw IN ('C/2025 A6', 'Comet Lemmon') THEN 'comet' WHEN object_raw = 'The Veil' THEN 'alias' END AS source FROM frame WHERE kind IN ('light', 'master_light'))"""


@plan(f"SELECT id, CASE WHEN id % 50 = 0 THEN 'mine' ELSE canon END AS canon, CASE WHEN id % 50 = 0 THEN 'user' ELSE source END AS source FROM {RESOLVED_SQL}")
def resolver_ladder(c: Catalog) -> DataFrame:
    aliases = c.spark.createDataFrame([("THEVEIL", "Veil")], "alias_norm string, canon string")
    frames = c.frames().withColumn("user_canon", F.when(F.col("id") % 50 == 0, "mine"))
    found = derive.resolved(frames, aliases).where(F.col("kind").isin("light", "master_light"))
    return found.select("id", "found.canon", "found.source")


@plan("""SELECT CASE WHEN kind IN ('dark', 'bias', 'master_dark', 'master_bias') THEN 'no telescope wanted' WHEN telescope_id IS NULL THEN 'no telescope' WHEN camera_id IS NULL THEN 'no camera' ELSE 'assigned' END AS status,
CASE WHEN status = 'assigned' THEN telescope_id END AS telescope_id, CASE WHEN status = 'assigned' THEN camera_id END AS camera_id, count(*) AS n FROM frame GROUP BY ALL""")
def grouper_configs(c: Catalog) -> DataFrame:
    return derive.configs(c.frames())


@plan("""SELECT lower(name) AS key, arg_min(name, id) AS telescop_canon, count(*) AS members FROM (SELECT id, CASE WHEN id % 2 = 0 THEN upper(t.telescop_canon) ELSE t.telescop_canon END AS name
FROM (SELECT f.id, f.kind, f.telescope_id FROM frame f) f JOIN (SELECT id AS tid, telescop_canon FROM telescope) t ON t.tid = f.telescope_id WHERE kind NOT IN ('dark', 'bias', 'master_dark', 'master_bias')) GROUP BY 1""")
def grouper_telescopes(c: Catalog) -> DataFrame:
    names = c.telescopes().select(F.col("id").alias("telescope_id"), "telescop_canon")
    rows = c.frames().join(names, "telescope_id").select("id", "kind", F.when(F.col("id") % 2 == 0, F.upper("telescop_canon")).otherwise(F.col("telescop_canon")).alias("telescop"), F.lit(None).cast("double").alias("focallen"))
    return derive.telescopes(rows).select("key", "telescop_canon", "members")


_PATHS = ["/m/MASTERDARK_26MM_G100_O21_10_0300.000_EXPOSURE_300s.xisf", "/m/x_g5_o0_0_1_exposure.fits", "/m/none.fits"]


@plan("SELECT o_orderkey AS id, list_extract([100, 5, NULL], o_orderkey % 3 + 1)::BIGINT AS gain, list_extract([21, 0, NULL], o_orderkey % 3 + 1)::BIGINT AS offset_adu, list_extract([-10, 0, NULL], o_orderkey % 3 + 1)::BIGINT AS set_temp, list_extract([300.0, 1.0, NULL], o_orderkey % 3 + 1)::DOUBLE AS exptime FROM orders")
def recipe_from_path(c: Catalog) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), derive.master_path(path).alias("f")).select("id", "f.*")


def _key(kind: str) -> str:
    head = "'cam=' || camera_id || '|bin=' || xbinning"
    return f"'dark|' || {head} || '|exp=' || printf('%.3f', exptime) || '|t=' || set_temp || '|g=' || gain || '|o=' || offset_adu" if kind == "dark" else f"'flat|' || {head} || '|tel=' || telescope_id || '|filt=' || coalesce(filter_canon, '~')"


_CLASS = "CASE WHEN kind IN ('dark', 'master_dark') THEN 'dark' WHEN kind IN ('flat', 'master_flat') THEN 'flat' END"


@plan(f"SELECT profile_key, count(*) AS n FROM (SELECT CASE {_CLASS} WHEN 'dark' THEN {_key('dark')} WHEN 'flat' THEN {_key('flat')} END AS profile_key FROM frame) WHERE profile_key IS NOT NULL GROUP BY 1")
def recipe_profiles(c: Catalog) -> DataFrame:
    rows = c.frames().select(derive.profile_key(derive.recipe_class(F.col("kind"))).alias("profile_key"))
    return rows.where("profile_key is not null").groupBy("profile_key").agg(F.count("*").alias("n"))


@plan(f"""SELECT class, missing, count(*) AS n FROM (SELECT {_CLASS} AS class, CASE {_CLASS} WHEN 'dark' THEN concat_ws(', ', CASE WHEN camera_id IS NULL THEN 'camera_id' END, CASE WHEN exptime IS NULL THEN 'exptime' END, CASE WHEN set_temp IS NULL THEN 'set_temp' END)
ELSE concat_ws(', ', CASE WHEN camera_id IS NULL THEN 'camera_id' END, CASE WHEN telescope_id IS NULL THEN 'telescope_id' END) END AS missing FROM frame) WHERE class IS NOT NULL AND missing <> '' GROUP BY 1, 2""")
def recipe_incomplete_reasons(c: Catalog) -> DataFrame:
    kind = derive.recipe_class(F.col("kind"))
    rows = c.frames().select(kind.alias("class"), derive.missing_facts(kind).alias("missing")).where("class is not null and missing <> ''")
    return rows.groupBy("class", "missing").agg(F.count("*").alias("n"))


def _calibrated(c: Catalog) -> DataFrame:
    """Exposures in a few steps, so that darks of the same recipe occur."""
    return c.frames().withColumn("exptime", F.when(F.col("exptime").isNotNull(), (F.col("id") % 4 + 1) * 60.0))


_LINEAGE = f"""cal AS (SELECT * REPLACE (CASE WHEN exptime IS NOT NULL THEN (id % 4 + 1) * 60.0 END AS exptime) FROM frame),
light AS (SELECT id, relation, date_ts AS ts, CASE relation WHEN 'dark' THEN {_key("dark")} ELSE {_key("flat")} END AS key FROM cal, (VALUES ('dark'), ('flat')) r(relation) WHERE kind = 'light'),
keyed AS (SELECT id, kind, date_ts AS ts, CASE {_CLASS} WHEN 'dark' THEN {_key("dark")} WHEN 'flat' THEN {_key("flat")} END AS key FROM cal),
pair AS (SELECT l.id, l.relation, m.id AS master_id, row_number() OVER (PARTITION BY l.id, l.relation ORDER BY abs(epoch(l.ts) - epoch(m.ts)) NULLS LAST, m.id) AS n FROM light l JOIN keyed m ON m.key = l.key AND m.kind IN ('master_dark', 'master_flat')),
linked AS (SELECT l.id AS light_id, l.relation, CASE WHEN l.key IS NULL THEN 'incomplete' WHEN p.master_id IS NOT NULL THEN 'linked' WHEN EXISTS (SELECT 1 FROM keyed k WHERE k.key = l.key) THEN 'no master' ELSE 'no profile' END AS status, p.master_id
FROM light l LEFT JOIN pair p ON p.id = l.id AND p.relation = l.relation AND p.n = 1)"""


@plan(f", {_LINEAGE} SELECT * FROM linked")
def lineage_nearest(c: Catalog) -> DataFrame:
    return derive.lineage(_calibrated(c))


@plan(f", {_LINEAGE} SELECT relation, status, count(*) AS n FROM linked GROUP BY 1, 2")
def lineage_gaps(c: Catalog) -> DataFrame:
    return derive.lineage(_calibrated(c)).groupBy("relation", "status").agg(F.count("*").alias("n"))


@plan("SELECT path, id, path LIKE '%/darks/%' AS hidden FROM location WHERE present = 1 AND id % 97 = 0")
def presence_candidates(c: Catalog) -> DataFrame:
    listing = c.locations().where("id % 97 <> 0").select("path")
    return changes.missing(c.locations(), listing, "/Archive", ["/archive/DARKS"]).select("path", "id", "hidden")


@plan("SELECT volume, path, mtime FROM location WHERE NOT (present = 1 AND id % 5 <> 0)")
def incremental_gate(c: Catalog) -> DataFrame:
    known = c.locations().withColumn("unreadable_since", F.when(F.col("id") % 5 == 0, F.lit("2024")))
    return changes.to_scan(c.locations().select("volume", "path", "mtime"), known)


@plan("""SELECT volume, path, CASE WHEN id % 31 = 0 THEN 'unreadable' WHEN id % 7 = 0 THEN 'new copy' WHEN id % 6 = 0 AND frame_id <> 1 THEN 'rebound' WHEN present = 0 THEN 'refreshed' ELSE 'unchanged' END AS action FROM location""")
def ingest_actions(c: Catalog) -> DataFrame:
    rows = c.stored_copies()
    known = rows.where("id % 7 <> 0").withColumn("frame_sha1", F.col("sha1_data"))
    scanned = rows.select("volume", "path", F.when(F.col("id") % 6 == 0, F.sha1(F.lit("1"))).otherwise(F.col("sha1_data")).alias("sha1_data"), "mtime", F.when(F.col("id") % 31 == 0, "broken").alias("error"), "id")
    return changes.classified(scanned, c.frames(), known)


@plan("SELECT id, CASE WHEN id % 9 = 0 THEN 'added' WHEN id % 10 = 0 THEN 'removed' ELSE 'changed' END AS change FROM frame WHERE id % 9 = 0 OR id % 10 = 0 OR id % 8 = 0 AND filter_canon IS DISTINCT FROM 'L'")
def diff_events(c: Catalog) -> DataFrame:
    old = c.frames().where("id % 9 <> 0")
    new = c.frames().where("id % 10 <> 0 or id % 9 = 0").withColumn("filter_canon", F.when(F.col("id") % 8 == 0, "L").otherwise(F.col("filter_canon")))
    return changes.difference(old, new, "id", ["filter_canon", "kind"]).select("id", "change")


@plan("""SELECT s AS source, s + 1 AS target, CASE WHEN s >= (SELECT max(id) FROM telescope) THEN 'unknown' WHEN s % 10 IN (1, 2) THEN 'source is merged' WHEN (s + 1) % 10 IN (1, 2) THEN 'target is merged'
WHEN s % 10 = 0 AND s + 1 <= (SELECT max(id) FROM telescope) THEN 'source has members' END AS refused FROM (SELECT id AS s FROM telescope)""")
def merge_guards(c: Catalog) -> DataFrame:
    wanted = c.telescopes().select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return changes.merges(c.telescopes(), wanted)


@plan("SELECT DISTINCT 'A' || n_regionkey AS alias_norm, n_name AS canon, CASE WHEN n_nationkey < 5 THEN CASE WHEN n_nationkey = n_regionkey THEN 'already there' ELSE 'taken' END WHEN n_regionkey < 5 THEN 'taken' END AS refused FROM nation")
def user_assign_conflicts(c: Catalog) -> DataFrame:
    nation = c.table("nation")
    firsts = nation.select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("alias_norm"), F.col("n_name").alias("canon")).where("alias_norm in ('A0', 'A1', 'A2', 'A3', 'A4')")
    return changes.alias_conflicts(firsts, nation.select(F.concat(F.lit("A"), F.col("n_regionkey").cast("string")).alias("alias_norm"), F.col("n_name").alias("canon")))


@plan("SELECT c_mktsegment AS model_canon, arg_min(c_nationkey, c_custkey) FILTER (c_nationkey > 3)::DOUBLE AS pixel_um, count(DISTINCT c_nationkey) FILTER (c_nationkey > 3) > 1 AS pixel_conflict, count(*) AS n FROM customer GROUP BY 1")
def camera_dimension(c: Catalog) -> DataFrame:
    rows = c.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("model_canon"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")).alias("pixel_um"))
    return changes.cameras(rows)


_NAMED = """named AS (SELECT f.id, f.kind, f.filetype, f.date_ts, l.volume, l.path, l.id AS lid, strftime(f.date_ts, '%Y%m%d_%H%M%S') || CASE WHEN kind IN ('light', 'master_light') THEN '_' || coalesce(o.canon, regexp_replace(regexp_replace(f.object_raw, '[^0-9A-Za-z+._-]+', '_', 'g'), '^_+|_+$', '', 'g'), '_UNSET') ELSE '' END
|| '_' || kind || coalesce('_' || filter_canon, '') AS name, regexp_extract(l.path, '(\\.[^.]*)$', 1) AS ext, regexp_replace(l.path, '[^/]*$', '') AS place FROM frame f JOIN location l ON l.frame_id = f.id AND l.present = 1 LEFT JOIN object o ON o.id = f.object_id),
renamed AS (SELECT *, place || name || ext AS new_path, count(*) OVER (PARTITION BY volume, place || name || ext) AS n FROM named)"""


def _copies(c: Catalog) -> DataFrame:
    names = c.objects().select(F.col("id").alias("object_id"), F.col("canon").alias("object"))
    present = c.locations().where("present = 1").select(F.col("frame_id").alias("id"), "volume", "path", F.col("id").alias("lid"))
    return c.frames().join(names, "object_id", "left").join(present, "id").withColumn("ts", F.col("date_ts"))


@plan(f", {_NAMED} SELECT lid AS id, path, new_path, CASE WHEN new_path IS NULL THEN 'no time' WHEN n > 1 THEN 'collision' END AS skipped FROM renamed")
def rename_compose(c: Catalog) -> DataFrame:
    rows = _copies(c).drop("id").withColumnRenamed("lid", "id")
    return naming.renames(rows, ("datetime", "object", "kind", "filter"))


@plan(f", {_NAMED} SELECT CASE WHEN new_path IS NULL THEN 'no time' WHEN n > 1 THEN 'collision' ELSE 'renamed' END AS outcome, count(*) AS n FROM renamed GROUP BY 1")
def rename_collisions(c: Catalog) -> DataFrame:
    rows = _copies(c).drop("id").withColumnRenamed("lid", "id")
    return naming.renames(rows, ("datetime", "object", "kind", "filter")).groupBy(F.coalesce("skipped", F.lit("renamed")).alias("outcome")).agg(F.count("*").alias("n"))


@plan("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'LIGHTS_s' || o_orderkey || '.fits' ELSE CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y%m%d_%H%M%S') || '_' || substr(sha1(o_orderkey::VARCHAR), 1, 12) || '.fits' END END AS name FROM orders""")
def rename_templates(c: Catalog) -> DataFrame:
    rows = c.frames().withColumns({"ts": F.col("date_ts"), "path": F.concat(F.lit("/a/LIGHTS/s"), F.col("id").cast("string"), F.lit("_x.FITS"))})
    template = {"xisf": [{"t": "folder", "n": 1}, {"t": "orig", "re": r"^(s\d+)_"}], "default": ["datetime", "disc"]}
    return rows.select("id", naming.composed(template).alias("name"))


_FIRST = "(SELECT frame_id, arg_min(path, id) AS path FROM location WHERE present = 1 GROUP BY 1)"
_SAFE_OBJECT = "coalesce(o.canon, regexp_replace(regexp_replace(f.object_raw, '[^0-9A-Za-z+._-]+', '_', 'g'), '^_+|_+$', '', 'g'), '_UNSET')"
_PLAN = f"""planned AS (SELECT f.id, CASE WHEN l.path IS NOT NULL THEN {_SAFE_OBJECT} || '/' || coalesce(f.filter_canon, '_UNSET') END AS folder, regexp_extract(l.path, '([^/]*)$', 1) AS file, CASE WHEN l.path IS NULL THEN 'no present copy' END AS skipped
FROM frame f LEFT JOIN object o ON o.id = f.object_id LEFT JOIN {_FIRST} l ON l.frame_id = f.id)"""


def _planned(c: Catalog) -> DataFrame:
    names = c.objects().select(F.col("id").alias("object_id"), F.col("canon").alias("object"))
    first = c.locations().where("present = 1").groupBy(F.col("frame_id").alias("id")).agg(F.min_by("path", "id").alias("path"))
    return naming.projection(c.frames().join(names, "object_id", "left").join(first, "id", "left"), "by-object")


@plan(f", {_PLAN} SELECT id, folder, file, skipped FROM planned")
def projection_layout(c: Catalog) -> DataFrame:
    return _planned(c)


@plan(f", {_PLAN} SELECT folder, count(*) AS n FROM planned WHERE folder IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def projection_folder_hist(c: Catalog) -> DataFrame:
    return naming.folder_histogram(_planned(c), 10)


@plan(f", {_PLAN} SELECT CASE WHEN skipped IS NOT NULL THEN 'skipped' WHEN id % 3 = 0 THEN 'exists' WHEN id % 3 = 1 THEN 'conflict' ELSE 'would-link' END AS status, count(*) AS n FROM planned GROUP BY 1")
def projection_status(c: Catalog) -> DataFrame:
    planned = _planned(c)
    there = planned.where("id % 3 < 2 and folder is not null").select("folder", "file", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("id"))
    return naming.apply_status(planned, there).groupBy("status").agg(F.count("*").alias("n"))


@plan("""SELECT round(sum(size_bytes), 2) AS bytes, count(*) FILTER (size_bytes IS NULL) AS n_unknown, count(*) FILTER (volume <> 'O') AS n_other_volume, bool_or(volume <> 'O') AS must_copy
FROM (SELECT frame_id, arg_min(volume, id) AS volume, arg_min(size_bytes, id) AS size_bytes FROM location WHERE present = 1 GROUP BY 1)""")
def copy_size_sum(c: Catalog) -> DataFrame:
    return reviews.copy_plan(c.locations(), "O")


@plan("SELECT round(median(h), 6) AS median_h, round(max(h) - min(h), 6) AS spread_h, count(*) AS n FROM (SELECT (epoch(f.date_ts) - epoch(l.mtime)) / 3600 AS h FROM frame f JOIN location l ON l.frame_id = f.id) WHERE h IS NOT NULL")
def dt_delta_median(c: Catalog) -> DataFrame:
    rows = c.frames().join(c.locations().select(F.col("frame_id").alias("id"), "mtime"), "id")
    return facets.time_differences(rows, F.col("date_ts"), F.col("mtime"))


@plan("""SELECT id, CASE WHEN price IS NOT NULL AND gain <> 0 THEN round(price / gain, 7) + (-7 - 3 * floor(-7 / 3.0)) END AS value, CASE WHEN price IS NULL THEN 'no PRICE' WHEN gain = 0 THEN 'division by zero' END AS reason
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, o_orderkey % 3 * 100 AS gain FROM orders)""")
def macro_compute_set(c: Catalog) -> DataFrame:
    wide = facets.pivot(c.frames(), c.cards(), ["PRICE", "GAIN"]).select("id", F.col("PRICE_num").alias("PRICE"), F.col("GAIN_num").alias("GAIN"))
    found = expression.evaluated(wide, "value", "PRICE / GAIN + -7 % 3")
    return found.select("id", F.round("value", 7).alias("value"), F.regexp_replace("reason", f"^{expression.MISSING}", "no ").alias("reason"))


@plan("""SELECT id, CASE WHEN price IS NOT NULL AND gain <> 0 THEN round(((price * 2 + gain) / gain - price % 7 + abs(gain - 150) * 3 - floor(price / 10)) + greatest(gain, 120) - -least(price, 5000, 90) + 7 - 2 * 3, 5) END AS value,
CASE WHEN price IS NULL THEN 'missing operand: PRICE' WHEN gain = 0 THEN 'division by zero' END AS reason, CASE WHEN price IS NOT NULL AND gain <> 0 THEN 'float' END AS kind
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, o_orderkey % 3 * 100 AS gain FROM orders)""")
def expression_many_operators(c: Catalog) -> DataFrame:
    wide = facets.pivot(c.frames(), c.cards(), ["PRICE", "GAIN"]).select("id", F.col("PRICE_num").alias("PRICE"), F.col("GAIN_num").alias("GAIN"))
    source = "(PRICE * 2 + GAIN) / GAIN - PRICE % 7 + abs(GAIN - 150) * 3 - PRICE // 10 + max(GAIN, 120) - -min(PRICE, 5000, 90) + 7 - 2 * 3"
    return expression.evaluated(wide, "value", source, "kind").select("id", F.round("value", 5).alias("value"), "reason", "kind")


@plan("""SELECT coalesce(reason, 'edited') AS outcome, count(*) AS n FROM (SELECT frame_id, CASE WHEN count(*) FILTER (present = 1) = 0 THEN 'no present copy' WHEN count(*) FILTER (present = 1) > 1 THEN 'several copies'
WHEN arg_min(id, id) FILTER (present = 1) % 4 = 0 THEN 'compressed' END AS reason FROM location GROUP BY 1) GROUP BY 1""")
def macro_skip_reasons(c: Catalog) -> DataFrame:
    targets = c.locations().select("frame_id", F.col("id").alias("location_id"), "present", F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("compressed"), F.lit("h").alias("header_hash"))
    return edits.gated(targets).groupBy(F.coalesce("reason", F.lit("edited")).alias("outcome")).agg(F.count("*").alias("n"))


@plan("""SELECT id, id AS location_id, CASE WHEN present = 0 THEN 'skipped: not present' WHEN id % 4 = 0 THEN 'skipped: compressed' WHEN id % 5 = 0 THEN 'blocked: changed since' ELSE 'apply' END AS status FROM location""")
def commit_plan(c: Catalog) -> DataFrame:
    staged = c.locations().select("id", F.col("id").alias("location_id"), F.lit("h").alias("header_hash"))
    now = c.locations().select(F.col("id").alias("location_id"), "present", F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("compressed"), F.when(F.col("id") % 5 == 0, "g").otherwise("h").alias("header_hash"))
    return changes.commit_status(staged, now)


@plan("SELECT frame_id, keyword, (row_number() OVER (PARTITION BY frame_id, keyword ORDER BY idx) - 1)::INTEGER AS idx, value_raw FROM cards WHERE keyword = 'HISTORY'")
def cards_occurrence_idx(c: Catalog) -> DataFrame:
    from skyledger.sources import headers

    rows = c.cards().where("keyword = 'HISTORY'").withColumn("pos", F.col("idx") + 5)
    return headers.numbered(rows.drop("idx"), "frame_id").select("frame_id", "keyword", "idx", "value_raw")


@plan("""SELECT frame_id, '{"GAIN":"' || g || '","STATUS":"' || s || '"}' AS header FROM (SELECT frame_id, max(value_raw) FILTER (keyword = 'GAIN') AS g, max(value_raw) FILTER (keyword = 'STATUS') AS s FROM cards GROUP BY 1)""")
def header_from_cards(c: Catalog) -> DataFrame:
    from skyledger.sources import headers

    return headers.as_json(c.cards().where("keyword in ('GAIN', 'STATUS')"), "frame_id")


@plan("SELECT page_id AS id, sha1(html) AS whole, sha1(substr(html, 11, 100)) AS span FROM pages")
def dual_hash(c: Catalog) -> DataFrame:
    rows = c.table("pages")
    return rows.select(F.col("page_id").alias("id"), F.sha1("html").alias("whole"), F.sha1(F.substring("html", 11, 100)).alias("span"))


@plan("SELECT 'frames' AS gate, 10::BIGINT AS expected, count(*) AS actual, count(*) = 10 AS ok FROM frame UNION ALL SELECT 'telescopes', 5, count(DISTINCT telescope_id), count(DISTINCT telescope_id) = 5 FROM frame")
def import_gates(c: Catalog) -> DataFrame:
    return reviews.gates(c.frames().agg(F.count("*").alias("frames"), F.count_distinct("telescope_id").alias("telescopes")), {"frames": 10, "telescopes": 5})


@plan("SELECT id, CASE WHEN id % 20 = 0 THEN 'gone' ELSE 'changed' END AS what FROM location WHERE id % 20 = 0 OR id % 21 = 0")
def fingerprint_violations(c: Catalog) -> DataFrame:
    after = c.locations().where("id % 20 <> 0").withColumn("size_bytes", F.when(F.col("id") % 21 == 0, F.lit(-1.0)).otherwise(F.col("size_bytes")))
    return reviews.violations(c.locations(), after, "id", ["size_bytes", "mtime"])
