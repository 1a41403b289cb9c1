"""The pipeline's stages against brute force on the smallest tables."""

import os
import random

import pytest

import corpus_pipeline
from skyledger.llm import common, pii_semicrf

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "best-fit packing" else before
        docs = common.keep(stage(spark, docs, SF), "test-stage")
        kept[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    left = {r.doc_id for r in after.collect()}
    assert all(i in left for i in before if labels.get(i) == 0)
    before, after = kept["language ID"]
    assert {i for i, t in before.items() if any(map(str.isalpha, t or ""))} >= {r.doc_id for r in after.collect()}
    before, after = kept["SimHash near-dedup"]
    left = {r.doc_id for r in after.collect()}
    sets = {i: shingles(t) for i, t in before.items()}
    index = {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b}
    group = {i: i for i in sets}
    for (a, b), x in index.items():
        if x >= 0.8 and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    # Every document that goes is like one that was there, and nearly all groups keep one document.
    assert all(max(x for pair, x in index.items() if i in pair) >= 0.6 for i in sets.keys() - left)
    assert len(left) <= 1.02 * len(set(group.values()))
    assert all(b not in left for (a, b), x in index.items() if x == 1)
    before, after = kept["PII"]
    for r in after.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id] or pii_semicrf.base_spans(before[r.doc_id]) or "<" in r.text)
        assert not any(k in ("email", "phone") for k, *_ in pii_semicrf.base_spans(r.text))
    rows = kept["best-fit packing"][1].collect()
    assert {r.doc_id for r in rows} == left


def test_rows_without_id_and_clashing_columns(spark):
    rows = [(None, "one text that is here", "en", "s", 21, 1.0), (None, "one text that is here", "en", "s", 21, 1.0), (5, None, None, "s", None, None), (5, "again the same id", "en", "s", 17, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    found = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    # Rows without an id are deduplicated, and other texts of the same id stay.
    assert sorted(str(r.doc_id) for r in found) == ["5", "5", "None"]
    empty = corpus_pipeline.near_duplicates(spark, docs.where("false"), SF)
    assert empty.count() == 0 and empty.columns == docs.columns
    assert corpus_pipeline.personal_data(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.packing(spark, docs.where("false"), SF).count() == 0


def near_copies(rng, base, share):
    """A text in which one word out of `share` is another."""
    return " ".join(w if rng.random() > 1 / share else f"other{rng.randrange(10**6)}" for w in base)


def test_near_copies_leave_and_others_stay(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bases = [[word() for _ in range(300)] for _ in range(60)]
    passage = [word() for _ in range(55)]
    rows = [(k, " ".join(base + passage)) for k, base in enumerate(bases)]
    rows += [(100 + k, near_copies(rng, base + passage, 70)) for k, base in enumerate(bases[:40])]
    rows += [(200 + k, near_copies(rng, bases[0] + passage, 70)) for k in range(150)]  # one large group
    rows += [(500, rows[3][1]), (None, rows[4][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    like = lambda i, t: max(jaccard(shingles(t), shingles(u)) for k, u in rows if k is not None and k < i)
    assert set(range(60)) <= set(left) and len(left) == len(set(left)) and None not in left and 500 not in left
    near = [(i, t) for i, t in rows if i is not None and 100 <= i < 500 and like(i, t) >= 0.8]
    assert len(near) > 60 and sum(i in left for i, _ in near) <= 0.05 * len(near)


def test_foreign_texts_are_of_no_known_language(spark):
    rng = random.Random(3)
    parts = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "\u00e4", "ein"]}
    made = [(k, lang, " ".join("".join(rng.choices(own, k=2)) for _ in range(40))) for k, (lang, own) in enumerate(list(parts.items()) * 80)]
    strange = [(1000, "en", " ".join("".join(rng.choice("qxzjkvwyp") for _ in range(6)) for _ in range(40))), (1001, None, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 " * 20), (1002, "en", "123 \u00bd \u2163")]
    docs = spark.createDataFrame(made + strange, "doc_id long, lang string, text string")
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert left == set(range(160))
