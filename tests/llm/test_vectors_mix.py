"""Whitening, vector codes and the mix of sources against plain versions in Python's whole numbers."""

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import curriculum_mix, queries, residue_whitening, vantage_codes

CLASH = "found string, whitening string, coded string, _label string, _way int, row long, vector string, bucket string, takes int"


def clash(row: tuple) -> tuple:
    return (*row, "c", "c", "c", "c", 1, 2, "v", "b", 3)


def vectors(kind: str) -> list[tuple]:
    rng = np.random.default_rng(7)
    rows = [(k, (rng.standard_normal(6) * [3, 1, 1, 0.5, 0.2, 0.1]).tolist(), k % 3 if k % 7 else None) for k in range(400)]
    # Ties of equal entries, repeated rows and ids, short and empty vectors, null ids and labels.
    rows += [(500 + k, rows[k % 5][1], 1) for k in range(60)] + [rows[3], (3, [0.5] * 6, 2), (600, [1.0], 0), (601, [], None), (None, rows[9][1], 1)]
    rows += [(700, None, 0), (701, [None, 1.0], 0), (702, [math.nan], 0), (703, [math.inf], 1)]
    return {"plain": rows, "few": rows[:4], "one": rows[:1], "none": [], "unfit": rows[-4:], "wide": [*rows, (800, [1e12, -3e11, 0.25], 2), (801, [1e300], 2)]}[kind]


def written(spark, tmp_path, kind: str) -> str:
    rows = spark.createDataFrame([clash(r) for r in vectors(kind)], f"vec_id long, embedding array<double>, label int, {CLASH}")
    rows.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def whole(rows: list[tuple], offset: int) -> list[tuple]:
    fit = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in fit), default=0)
    top = 1 << 62
    far = lambda x: max(-top, min(top, math.floor(x * 1024) if abs(x) < 1e300 else int(math.copysign(top, x))))
    return [(i, [far(x) + offset for x in v] + [offset] * (width - len(v)), label) for i, v, label in fit]


@pytest.mark.parametrize("kind", ["plain", "few", "one", "none", "unfit", "wide"])
def test_whitening(spark, tmp_path, kind):
    got = queries.op11_residue_whitening(spark, written(spark, tmp_path, kind)).collect()
    rows = whole(vectors(kind), 100_000)
    n, width = len(rows), len(rows[0][1]) if rows else 0
    k = min(8, width)
    assert len(got) == n * k
    if not n:
        return
    sums = [sum(v[d] for _, v, _ in rows) for d in range(width)]
    deviations = sorted((str(i), min((1 << 63) - 1, sum((n * x - s) ** 2 for x, s in zip(v, sums)))) for i, v, _ in rows)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == deviations
    exact = [[Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for _, v, _ in rows), n**3) for b in range(width)] for a in range(width)]
    cov = np.array([[float(x) for x in line] for line in exact])
    values = np.linalg.eigvalsh(cov)[::-1][:k]
    trace = float(sum(exact[d][d] for d in range(width)))
    spread = [e > 1e-12 * values[0] and e > 0 for e in values]
    assert {r.n for r in got} == {n}
    for r in got:
        if not any(spread):
            assert r.whitened is None and r.explained is None and r.identity_error is None
            continue
        assert abs(r.explained - max(0.0, values[r.component - 1]) / trace) <= 1e-9 + 1e-4 * r.explained
        assert (r.whitened is not None) == spread[r.component - 1]
        assert r.identity_error <= 1e-4
    for c in range(1, k + 1):
        white = np.array([r.whitened for r in got if r.component == c and r.whitened is not None])
        if spread[c - 1] and kind != "wide":
            assert abs(white.mean()) < 1e-6 and abs((white**2).mean() - 1) < 1e-6


def test_whitened_values(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 5)) * [4, 2, 1, 0.5, 0.25]
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(data)], "id long, v array<double>, other string")
    model = residue_whitening.fit(df, "v", 3)
    x = np.floor(data * 1024) + 100_000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ axes[:, ::-1][:, :3] / np.sqrt(values[::-1][:3])
    got = np.array([r.w for r in residue_whitening.whiten(df, model, "v", "f").orderBy("id").select(F.col("f.whitened").alias("w"), "other").collect()])
    for c in range(3):
        sign = np.sign(got[0, c] * want[0, c])
        assert np.allclose(got[:, c] * sign, want[:, c], atol=1e-8)


def test_remainders():
    rng = np.random.default_rng(2)
    numbers = [int(x) ** 3 * int(y) for x, y in zip(rng.integers(-(1 << 40), 1 << 40, 50), rng.integers(-9, 9, 50))]
    moduli = residue_whitening.primes(2 * max(map(abs, numbers)))
    residues = np.array([[x % p for x in numbers] for p in moduli])
    assert residue_whitening.remaindered(residues, moduli).tolist() == numbers


def plain_codes(rows: list[tuple]) -> tuple[list, str]:
    rows = whole(rows, 0)
    width = -(-len(rows[0][1]) // 4) if rows else 0
    rows = [(i, v + [0] * (4 * width - len(v)), label) for i, v, label in rows]
    parts = lambda v: [v[p * width : (p + 1) * width] for p in range(4)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[parts(v)[p] for _, v, _ in first] for p in range(4)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        found = [[nearest(part, books[p])[1] for p, part in enumerate(parts(v))] for _, v, _ in rows]
        for p in range(4):
            own: dict = {}
            for (_, v, _), codes in zip(rows, found):
                own.setdefault(codes[p], []).append(parts(v)[p])
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    out, by_label = [], {}
    top = (1 << 63) - 1
    for i, v, label in rows:
        near = [nearest(part, books[p]) for p, part in enumerate(parts(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in near), min(top, sum(d for d, _ in near)), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, min(top, by_label[label])) for i, c, e, label in out), digest


@pytest.mark.parametrize("kind", ["plain", "few", "one", "none", "unfit", "wide"])
def test_codes(spark, tmp_path, kind):
    got = queries.op12_vantage_codes(spark, written(spark, tmp_path, kind)).collect()
    want, digest = plain_codes(vectors(kind))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_tree():
    rng = np.random.default_rng(3)
    entries = np.concatenate([rng.integers(-900, 900, (120, 2)), np.repeat(rng.integers(-900, 900, (4, 2)), 34, 0)])
    rows = np.concatenate([rng.integers(-1000, 1000, (2000, 2)), entries])
    tree = vantage_codes.Tree(entries)
    at, best = tree.nearest(rows)
    full = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()
    assert tree.compared < 0.5 * full.size  # halves are left out, not only searched in another order
    big = [int(x) << 50 for x in range(-20, 20)]
    own = np.array(big, np.int64)[:, None]
    assert vantage_codes.Tree(own).nearest(own)[0].tolist() == list(range(40))


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict) -> dict:
    """By sharing out what is over again and again."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def documents(kind: str) -> list[tuple]:
    rng = np.random.default_rng(4)
    names = [None, "a", "b", "é", "z", "ß", "\U0001f600", "￮"]
    rows = [(k, "w " * int(rng.integers(0, 40)), names[k % 8 if k % 3 else 1]) for k in range(3000)]
    rows += [(9000, "long\x0bword one " * 4000, "b"), (9001, None, "c"), (9002, "", "c"), (9003, " \t\r\n", "d"), (5, "a repeated id", "a"), rows[7], rows[7]]
    rows += [(None, "without an id", "a")] * 700
    return {"plain": rows, "blank": [(1, None, "a"), (2, " ", None)], "none": [], "one": [(1, "three words here", None)]}[kind]


@pytest.mark.parametrize("kind", ["plain", "blank", "none", "one"])
def test_mix(spark, tmp_path, kind):
    rows = documents(kind)
    spark.createDataFrame([clash(r) for r in rows], f"doc_id long, text string, source string, {CLASH}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_curriculum_mix(spark, str(tmp_path)).collect()
    words = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), n) for (i, _, _), n in zip(rows, words))
    sizes: dict = {}
    for (_, _, s), n in zip(rows, words):
        sizes[s] = sizes.get(s, 0) + n
    targets = plain_targets(sizes)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by_source: dict = {}
    mix = curriculum_mix.mixed(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    for r in mix:
        by_source.setdefault(r.source, []).append(r)
    assert sorted((str(r.doc_id), r["size"], sum(t.words for t in r.takes)) for r in mix) == sorted((str(r.doc_id), r["size"], r.taken) for r in got)  # a second run agrees
    assert by_source.keys() == sizes.keys()
    for s, own in by_source.items():
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(abs(r.target - targets[s]) <= 1e-6 * max(1, targets[s]) for r in own)
        assert abs(sum(t.words for r in own for t in r.takes) - targets[s]) < 1
        # By the time t the source has given what its schedule asked for, within a document.
        takes = sorted((t.position, t.words) for r in own for t in r.takes)
        if kind == "plain" and takes:
            knots = curriculum_mix.SCHEDULES[sorted(sizes, key=lambda x: (x is None, (x or "").encode())).index(s) % 3].knots
            done = 0
            for at, n in takes:
                asked = targets[s] * (knots[0] * at + (knots[1] - knots[0]) * at * at / 2)
                assert abs(asked - done) < 1e-6 * targets[s] + 1
                done += n
    if kind == "plain":
        order = [(r.position, r.doc_id) for r in got if r.position is not None]
        assert order == sorted(order, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def test_curriculum_is_range_sorted(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), f"s{k % 5}") for k in range(500)], "doc_id long, text string, source string")
    rows = curriculum_mix.curriculum(curriculum_mix.mixed(docs)).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert abs(sum(r.words for r in rows) - 1.5 * sum(1 + k % 9 for k in range(500))) < 5


def test_schedules_turned_round(spark):
    knots = [(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.5, 0.0, 0.0, 2.0), (3.0, 1.0, 2.0)]
    rows = spark.createDataFrame([(list(k), y / 20) for k in knots for y in range(21)], "knots array<double>, share double")
    got = rows.select("knots", "share", curriculum_mix.position(F.col("knots"), F.col("share")).alias("t"))
    for r in got.withColumn("back", curriculum_mix.demand(F.col("knots"), F.col("t"))).collect():
        assert 0 <= r.t <= 1 and abs(r.back - r.share) < 1e-9, r
    with pytest.raises(ValueError):
        curriculum_mix.Schedule(1, (0.0, 0.0))
