"""Columns of documents that bear names which operators use are passed on; fingerprints alone make no duplicates."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import best_fit_packing, nn_descent, simhash_gray

NAMES = ["_mix", "_doc_id", "_mix_", "_rows", "chosen_id", "text_mix", "_language", "_toxicity", "held", "final", "row", "found", "more", "name"]
SF = "/root/testdata/sf0.001"


def test_stages_pass_on_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES), name
        docs = spark.createDataFrame(rows, docs.schema)


def test_packing_carries_columns_of_its_own_names(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") + 1).alias("length"), *(F.col("id").cast("string").alias(n) for n in ("held", "final", "sequence_id", "offset")))
    packed = best_fit_packing.pack(rows, 64)
    assert packed.columns == ["doc_id", "piece", "length", "held", "final", "_sequence_id", "_offset", "sequence_id", "offset"]
    got = packed.collect()
    assert len(got) == 50 and all(r.held == r._offset == r.final == r._sequence_id == str(r.doc_id) for r in got)
    held = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 64


def test_equal_fingerprints_are_compared_by_their_further_words(spark, monkeypatch):
    rows = [(1, 5, b"\0" * 128), (2, 5, b"\xff" * 128), (3, 5, b"\0" * 127 + b"\1"), (4, 5, b"\0" * 128)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long, more binary")
    monkeypatch.setattr(simhash_gray, "fingerprint", lambda text, words, more: F.struct("fp", "more"))
    found = simhash_gray.one_of_each(fps.withColumn("text", F.col("doc_id").cast("string")), words=5, similarity=0.8).collect()
    assert sorted(r.doc_id for r in found) == [1, 2]


def test_pairs_at_four_fifths_and_more_are_found(spark):
    """Two thousand planted pairs at 0.80 to 0.85, by length of text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6))
    rows, wanted = [], {}
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    while len(wanted) < 2000:
        n = rng.choice((120, 300, 800))
        one = [word() for _ in range(n)]
        two = list(one)
        for at in rng.sample(range(n), max(1, round(n * rng.uniform(0.016, 0.023)))):
            two[at] = word()
        a, b = shingles(one), shingles(two)
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            k = len(rows)
            wanted[k + 1] = n
            rows += [(k, " ".join(one)), (k + 1, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    left = {r.doc_id for r in simhash_gray.one_of_each(docs, words=5, similarity=0.8).select("doc_id").collect()}
    assert left >= {k - 1 for k in wanted}
    found = {n: (sum(k not in left for k in wanted if wanted[k] == n), sum(x == n for x in wanted.values())) for n in (120, 300, 800)}
    print(found)
    assert sum(f for f, _ in found.values()) >= 0.95 * len(wanted), found


def test_links_come_through_the_search(spark, monkeypatch):
    """More vertices than a sample holds, with rare links: no vertex is compared with all, and probes show the recall."""
    import numpy as np

    monkeypatch.setattr(nn_descent, "AUDIT", 64)
    monkeypatch.setattr(nn_descent, "_missed", lambda *_: pytest.fail("the closing pass is for those who ask for it"))
    rng = np.random.default_rng(4)
    made = rng.standard_normal((4000, 48))
    made /= np.linalg.norm(made, axis=1)[:, None]
    for k in range(80):
        side = made[k + 2000] - (made[k + 2000] @ made[k]) * made[k]
        made[k + 2000] = 0.92 * made[k] + np.sqrt(1 - 0.92**2) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(made)], "vec_id long, embedding array<double>")
    rows = nn_descent.near_duplicates(df.repartition(4)).collect()
    assert rows[0].recall >= nn_descent.RECALL
    linked = {r.vec_id: r.component_id for r in rows if r.n_links}
    assert sum(linked.get(k + 2000) == k for k in range(80)) >= 79 and len(linked) <= 160
