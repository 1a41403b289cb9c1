"""Sites run by run against a fold over frames in order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import derive, sites

FRAME = "id long, lat_raw string, lon_raw string, observatory_id long"
SITE = "id long, name string, lat double, lon double, status string, merged_into long"


def km(a, b):
    la, lo, lb, ob = map(math.radians, (*a, *b))
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def fold(frames, known, radius):
    """Frames in order: the nearest site there is, or a new one."""
    known, given = dict(known), {}
    for k, lat, lon in sorted(frames):
        near = min(((round(km((lat, lon), p), 6), s) for s, p in known.items() if km((lat, lon), p) <= radius), default=None)
        if near is None:
            known[max(known, default=0) + 1] = (lat, lon)
            near = 0, max(known)
        given[k] = near[1]
    return known, given


def places(n, seed):
    pick = random.Random(seed)
    return [(k, round(pick.uniform(49.0, 50.0), 2), round(pick.uniform(19.0, 20.0), 2)) for k in range(1, n + 1)]


def table(spark, rows, given=None):
    return spark.createDataFrame([(k, str(a), str(b), (given or {}).get(k)) for k, a, b in rows], FRAME)


def state(found):
    return {r.id: (r.lat, r.lon) for r in found.sites.collect()}, {r.id: r.observatory_id for r in found.frames.collect()}


@pytest.mark.parametrize("radius", [4.0, 15.0])
def test_two_deliveries_are_the_fold_over_both(spark, radius):
    rows = places(300, 7)
    first, second = rows[:150], rows[150:]
    one = sites.observed(table(spark, first), spark.createDataFrame([], SITE), radius)
    known, given = fold(first, {}, radius)
    assert state(one) == (known, given)
    two = sites.observed(table(spark, second), one.sites, radius)
    known2, given2 = fold(second, known, radius)
    assert state(two) == (known2, given2)
    # In one pass the same sites are founded, and each frame goes where it went.
    whole = sites.observed(table(spark, rows), spark.createDataFrame([], SITE), radius)
    assert state(whole) == (known2, given | given2) == fold(rows, {}, radius)


def test_second_run_finds_no_site_and_is_then_quiet(spark):
    rows = places(80, 3)
    one = sites.observed(table(spark, rows), spark.createDataFrame([], SITE))
    two = sites.observed(one.frames, one.sites)
    assert two.counts.first()["new"] == 0 and state(two) == fold(rows, state(one)[0], 4.0)
    three = sites.observed(two.frames, two.sites)
    assert three.events.count() == 0 and three.counts.first().asDict() == {"new": 0, "assigned": 0, "unreadable": 0}


def test_names_and_merges_survive_and_places_are_frozen(spark):
    known = spark.createDataFrame([(3, "Hill", 50.0, 20.0, "approved", None), (4, None, 50.02, 20.0, "proposed", 3), (9, "no place", None, None, "proposed", None)], SITE)
    frames = spark.createDataFrame([(1, "50.021", "20.0", None), (2, "50 0 0", "20 0 0", 3), (3, "-10", "200", None), (4, None, None, 7), (5, "north", "1", 4), (6, "95", None, None), (7, "0", "0", None)], FRAME)
    found = sites.observed(frames, known)
    assert [tuple(r) for r in found.sites.where("id < 10").orderBy("id").collect()] == [tuple(r) for r in known.orderBy("id").collect()]
    assert [tuple(r) for r in found.sites.where("id >= 10").collect()] == [(10, None, -10.0, -160.0, "proposed", None)]
    assert {r.id: r.observatory_id for r in found.frames.collect()} == {1: 4, 2: 3, 3: 10, 4: 7, 5: 4, 6: None, 7: None}
    events = sorted((r.verb, r.target, r.reason, r.payload) for r in found.events.select("verb", "target", F.coalesce("reason", F.lit("")).alias("reason"), "payload").collect())
    assert [e[:3] for e in events] == [
        ("observatory.assigned", "frame:1", ""), ("observatory.assigned", "frame:3", ""), ("observatory.proposed", "observatory:10", ""),
        ("observatory.review_item", "frame:*", "0, 0"), ("observatory.review_item", "frame:*", "95, "), ("observatory.review_item", "frame:*", "north, 1"), ("observatory.review_summary", "frame:*", ""),
    ]
    assert events[-1][3] == '{"distinct":3,"frames":3}'


def test_empty(spark):
    found = sites.observed(spark.createDataFrame([], FRAME), spark.createDataFrame([], SITE))
    assert found.sites.count() == found.frames.count() == found.events.count() == 0


def test_places_that_repeat_meet_once_and_by_no_broadcast(spark):
    pick = random.Random(3)
    spots = [(50.0 + i / 50, 19.0) for i in range(5)]
    points = [(k, *pick.choice(spots)) for k in range(1, 201)]
    there = [(k, *pick.choice(spots), pick.choice([None, 40, 90, 150])) for k in range(1, 61)]
    p, s = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(there, "id long, lat double, lon double, since long")
    # In a check by brute force every point meets every site that counts for it.
    for how, counts in (({}, lambda k, site: True), ({"since": True}, lambda k, site: site[3] is None or site[3] <= k), ({"earlier": True}, lambda k, site: site[0] <= k)):
        found = derive.nearest_site(p, s, 4.0, **how)
        options = {k: [(round(km((a, b), site[1:3]), 6), site[0]) for site in there if counts(k, site)] for k, a, b in points}
        wanted = {k: min(near) for k, o in options.items() if (near := [x for x in o if x[0] <= 4.0])}
        assert {r.id: (r.km, r.site_id) for r in found.collect()} == wanted
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [cell" in plan and "BroadcastHashJoin [cell" not in plan
