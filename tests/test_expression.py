"""Plans of long expressions stay small, also below filters, and their values are Python's."""

import time

import pytest
from pyspark.sql import functions as F

from skyledger.operators import expression, macro


def plan_size(df) -> int:
    return len(df._jdf.queryExecution().optimizedPlan().toString())


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(k, k / 4, float(k % 3)) for k in range(40)] + [(99, None, 1.0)], "id long, A double, B double")


@pytest.mark.parametrize("op", ["+", "*", "/", "//", "%", "-"])
def test_plans_grow_by_the_same_for_each_operator(numbers, op):
    sizes = [plan_size(expression.evaluated(numbers, "v", f" {op} ".join(["A"] * (n + 1))).where("reason is null")) for n in (1, 2, 3, 12)]
    step = sizes[2] - sizes[1]
    assert sizes[3] <= sizes[2] + 10 * step


def test_twenty_operators_are_planned_in_a_second(numbers):
    source = "min(A, B, 3) + " + " + ".join(f"abs(A - {k}) * B // 7" for k in range(6)) + " - -max(A, B)"
    expression.evaluated(numbers, "v", source).where("reason is null")._jdf.queryExecution().executedPlan()
    began = time.time()
    df = expression.evaluated(numbers, "v", source).where("reason is null").select("id", "v")
    df._jdf.queryExecution().executedPlan()
    assert time.time() - began < 4  # Python builds the columns, one call a function; some seconds on a busy machine
    got = {r.id: r.v for r in df.collect()}
    want = {k: eval(source, {}, {"A": k / 4, "B": float(k % 3), "min": min, "max": max, "abs": abs}) for k in range(40)}
    assert got == pytest.approx(want)


def test_names_that_name_each_other_do_not_multiply(spark, numbers):
    targets = spark.createDataFrame([(1, 10, None), (2, 20, "gone")], "id long, location_id long, reason string")
    cards = spark.createDataFrame([(1, "GAIN", 0, "3", 3.0, "int"), (2, "GAIN", 0, "3", 3.0, "int")], "frame_id long, keyword string, idx int, value_raw string, value_num double, value_type string")

    def run(n: int):
        computes = tuple((f"c{k}", f"{f'c{k - 1}' if k else 'GAIN'} + {f'c{k - 1}' if k else 'GAIN'}") for k in range(n))
        return macro.run(targets, cards, macro.Rule("NEW", "add", f"int(c{n - 1})", computes=computes))

    sizes = [plan_size(run(n)) for n in (2, 3, 10)]
    assert sizes[2] <= sizes[1] + 8 * (sizes[1] - sizes[0])
    assert {r.id: (r.new_value, r.reason) for r in run(10).collect()} == {1: (str(3 * 2**10), None), 2: (None, "gone")}


def test_first_failing_node_tells_why(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (2, 1.0, None), (3, None, None), (4, 1.0, 0.0), (5, 8.0, 2.0)], "id long, A double, B double")
    got = {r.id: (r.v, r.reason, r.k) for r in expression.evaluated(rows, "v", "A / B + Z if False else A".split(" if")[0].replace(" + Z", "") + " + min(A, B)", "k").collect()}
    missing = expression.MISSING
    assert got == {1: (None, missing + "A", None), 2: (None, missing + "B", None), 3: (None, missing + "A", None), 4: (None, expression.ZERO, None), 5: (6.0, None, "float")}
    assert expression.evaluated(rows, "v", "Q + 1").select("reason").distinct().collect()[0][0] == missing + "Q"


def test_bound_columns_are_worked_out_once(spark):
    df = spark.range(3).select(expression.let(F.rand(1) * 1e6, lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("s"))
    assert all(r.s.a == r.s.b for r in df.collect())
