"""Every catalog query against the SQL that an independent engine answers it by."""

import math
import os

import pytest

from skyledger.plans import catalog, ledger  # noqa: F401  the ledger registers more

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    """A value in a form that both engines share and that sorts."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    own = rows_of(df.columns, df.collect())
    found = duck.execute(catalog.ORACLE[name])
    wanted = rows_of([d[0] for d in found.description], found.fetchall())
    assert own[0] == wanted[0]
    assert len(own[1]) == len(wanted[1])
    differs = [(a, b) for a, b in zip(own[1], wanted[1]) if a != b]
    assert not differs, differs[:5]


def test_site_clusters_are_the_greedy_seeds(spark):
    """Brute force: points by id, each founds a site where none stands within the radius."""
    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    from skyledger.bridge import Catalog

    seeds, assigned = [], set()
    for r in Catalog(spark, SF).points().orderBy("id").collect():
        point = (r.id, r.lat, r.lon)
        if all(km(s, point) > 700.0 for s in seeds):
            seeds.append(point)
        assigned.add((r.id, min((round(km(s, point), 6), s[0]) for s in seeds)[1]))
    assert {(r.id, r.site_id) for r in catalog.QUERIES["site_assign"](spark, SF).collect()} == assigned
    assert sorted(r.id for r in catalog.QUERIES["site_clusters"](spark, SF).collect()) == [s[0] for s in seeds]
