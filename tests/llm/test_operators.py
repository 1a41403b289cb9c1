"""The ten operators against brute force, on small tables with nulls, ties, copies and long texts."""

import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from skyledger.llm import (
    best_fit_packing,
    common,
    language_id,
    maxscore_topk,
    nn_descent,
    pii_semicrf,
    queries,
    quote_threads,
    simhash_gray,
    sst_shards,
    suffix_pieces,
    toxicity_mil,
    wordcache,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "a", "One two", "İstanbul ΣΑΣ ß don't It's 12,3 a,b.c", "H̱x á", "日本語。 \U0001f600", "x" * 3000, "<|endoftext|> <|ENDOFTEXT|>",
    "Anon, anon. ANON! (ok)", "a\xa0b\x1cc", "  two  spaces\tand\ttabs\r\n", "word " * 4000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a row twice, a null id, and columns whose names clash with those that operators make."""
    rows = [(i, t, "x", 0.5, i) for i, t in enumerate(ODD)] + [(3, ODD[3], "x", 0.5, 3), (None, "no id here", "y", 0.1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, length long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_equals_library():
    own = wordcache.encoder(WORDS)
    texts = ODD + ["the same words again, " * 50, "Ünïcode wörds. Ça va? naïve"]
    ids, bounds = own.encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_shards_round_trip_and_lookup(spark, docs, empty):
    folder = f"{common.shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    manifest = sst_shards.write_shards(docs, folder, WORDS, shard_bytes=3000)
    found = sorted(sst_shards.read_shards(manifest).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert keys == sorted(keys) and len(found) == len(ODD) + 2
    start, encode = 0, wordcache.encoder(WORDS).tokenizer.encode
    for r in found:
        text = "no id here" if r.doc_id is None else ODD[r.doc_id]
        wanted = [*encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, crc(wanted)) == (start, len(wanted), zlib.crc32(r.ids))
        start += len(wanted)
    paths = [r.path for r in manifest.collect()]
    assert len(paths) > 1
    hits = {i: [ids for p in paths for ids in sst_shards.ShardReader(p).lookup(i)] for i in (None, 0, 3, 14, 999)}
    assert [len(hits[i]) for i in (None, 0, 3, 14, 999)] == [1, 1, 2, 1, 0]
    assert hits[14][0].tolist() == [*encode(ODD[14], add_special_tokens=False).ids, 1]
    nothing = sst_shards.write_shards(empty, f"{folder}-e", WORDS)
    assert sst_shards.read_shards(nothing).count() == 0


def test_shard_blocks_with_equal_keys(tmp_path):
    import pyarrow.fs as pafs

    writer = sst_shards.ShardWriter(pafs.LocalFileSystem(), str(tmp_path / "x.sst"), 4)
    ids = np.random.default_rng(1).integers(0, 1 << 20, 30_000).astype(np.uint32)
    for key in (-5, 7, 7, 7, 8):
        writer.add(sst_shards.key_of(key), ids)
    writer.close()
    reader = sst_shards.ShardReader(f"file://{tmp_path}/x.sst")
    assert [len(reader.lookup(k)) for k in (-5, 7, 8, 9)] == [1, 3, 1, 0]
    assert [sst_shards.id_of(k) for k, _ in reader.documents()] == [-5, 7, 7, 7, 8]


def test_packing(spark, docs, empty):
    parts = common.keep(best_fit_packing.pieces(docs, WORDS), "pieces")
    rows = best_fit_packing.pack(parts, task_rows=6).collect()
    encode = wordcache.encoder(WORDS).tokenizer.encode
    wanted = []
    for i, text in [*enumerate(ODD), (3, ODD[3]), (None, "no id here")]:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        wanted += [(i, n, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048))]
    got = [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)
    assert best_fit_packing.pack(common.keep(best_fit_packing.pieces(empty, WORDS), "pieces")).count() == 0


def test_best_fit_is_near_the_bound():
    sizes = np.random.default_rng(3).integers(1, 2049, 4000)
    bins, places, held = best_fit_packing.best_fit(sizes, 2048)
    assert held.max() <= 2048 and (np.bincount(bins, sizes) == held).all() and len(held) <= 1.08 * sizes.sum() / 2048


def test_sequences(spark, docs):
    packed = best_fit_packing.pack_documents(docs, WORDS)
    whole = {r.sequence_id: r.ids for r in best_fit_packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(prints, distance=3):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_simhash(spark, docs, empty):
    rows = simhash_gray.near_duplicates(docs).collect()
    assert len(rows) == len(ODD) + 2
    texts = {**dict(enumerate(ODD)), None: "no id here"}
    ids = sorted(texts, key=lambda i: (i is None, i))
    label = groups_by_force([simhash(texts[i]) for i in ids])
    for r in rows:
        assert int(r.fingerprint, 16) == simhash(texts[r.doc_id])
        assert r.component_id == ids[label[ids.index(r.doc_id)]]
    assert simhash_gray.near_duplicates(empty).count() == 0


def test_gray_index_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash_gray, "BLOCK", 16)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(prints)[:12]:
        for _ in range(15):  # chains and dense groups
            seed ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5)))
            prints.add(seed & (1 << 64) - 1)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = common.cut(simhash_gray.fingerprint_links(fps))
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") >= 1 for r in links.collect())
    got = {r.id: r.component for r in common.components(links).collect()}
    label = groups_by_force(prints)
    parts, wanted = {}, {}
    for p, s, w in zip(prints, signed, label):
        parts.setdefault(got.get(s, s), set()).add(s)
        wanted.setdefault(w, set()).add(s)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100, k) for k in range(101, 140)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in (1, 2, 3, 7, 8, 9)} == {1} and found[21] == 20 and found[139] == 100 and 5 not in found
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


PII = [
    "mail a.b+c@x-y.example.com, or @nobody and q@host and a@b.c.d@e.f", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.255 10.0.0", "+1 (243) 555-5526 tel +49 30 1 +(1)",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 12 4111111111111111 x", "é日本 q@host.org ü", "9" * 5000, "+" * 50 + "1 23456789", None, "", "no data. at all",
]


def base_by_patterns(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))] if len(t) < 1000 else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        double = sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(digits[::-1]))
        if 16 <= len(digits) <= 19 and double % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    rng = random.Random(2)
    made = ["".join(rng.choice("ab1234.@+- ()") for _ in range(60)) for _ in range(3000)]
    for text in [t or "" for t in PII] + made:
        assert pii_semicrf.base_spans(text) == base_by_patterns(text), text


def test_pii(spark):
    rng = random.Random(4)
    filler = ["la", "thing", "ounder", "47", "x9"]
    texts = PII + [" ".join(rng.choice([*filler, "a.b@c.example.com", "10.2.3.44", "4111111111111111", "+1 (243) 555-5526"]) for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    model = pii_semicrf.fit(docs)
    rows = {r.doc_id: r for r in pii_semicrf.find(docs.drop("found"), model).collect()}
    for i, text in enumerate(texts):
        base = base_by_patterns(text or "")
        assert [tuple(s) for s in rows[i].found.base] == base
        spans = [tuple(s) for s in rows[i].found.spans]
        assert set(base) <= set(spans)
        own = [s for s in spans if s not in base]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in own for b in base)
    masked = {r.doc_id: r.text for r in pii_semicrf.redact(docs, model).collect()}
    assert masked[7] is None and masked[8] == "" and masked[9] == texts[9] and "@c." not in "".join(masked[i] for i in range(10, 70))
    assert pii_semicrf.find(docs.drop("found").where("false"), model).count() == 0


def test_semi_markov_posteriors_sum_over_segmentations():
    model = pii_semicrf.SemiMarkov({("words=1", "ip"): 0.7, ("words=2", "phone"): -0.4, ("bias", "card"): 0.2})
    text = "1234 56@x 7.8.9 4444"
    words = [m.span() for m in re.finditer(r"\S+", text)]
    ends = model._segments(text, words)
    ways = [[[]]] + [None] * len(words)
    for j in range(1, len(words) + 1):
        ways[j] = [w for w in ways[j - 1]] + [[*w, (span, kind, model._score(names, kind))] for i, span, names in ends[j] for w in ways[i] for kind in pii_semicrf.KINDS]
    total = sum(np.exp(sum(s for *_, s in w)) for w in ways[-1])
    for span, kind, p, *_ in model.posteriors(text, words):
        own = sum(np.exp(sum(s for *_, s in w)) for w in ways[-1] if any(x[:2] == (span, kind) for x in w))
        assert abs(own / total - p) < 1e-9


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = suffix_pieces.codec(PIECES)
    texts = ODD + ["{\r\n}\r\n", "▁", "def f(x):\n    return x**2\n", "the quick\0brown", "   "]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == model.encode(text or "") and own.decode(ids.tolist()) == model.decode(model.encode(text or ""))
    coded = docs.withColumn("ids", suffix_pieces.encode(docs.text, PIECES))
    rows = coded.withColumn("back", suffix_pieces.decode(coded.ids, PIECES)).collect()
    assert all(r.back == (r.text or "") for r in rows)
    assert empty.select(suffix_pieces.encode(empty.text, PIECES)).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(1)
    parts = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "ä", "ein"], "fr": ["eau", "é", "que", "oi"]}
    made = [(k, lang, " ".join("".join(rng.choices(own, k=2)) for _ in range(30))) for k, (lang, own) in enumerate(list(parts.items()) * 40)]
    labelled = spark.createDataFrame([*made, (None, "en", None), (1, None, "thing"), (2, "xx", "123")], "doc_id long, lang string, text string")
    model = language_id.fit(labelled.where("doc_id < 90"))
    assert sorted(model.languages) == ["de", "en", "fr"]
    rows = language_id.identify(labelled.where("doc_id >= 90"), model).join(labelled, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 3)) and found[4].lang_pred != "und"
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(labelled.where("false"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_folded_kernel_equals_kernel():
    rows = [("en", "the thing and other things"), ("de", "die sachen und ein ding"), ("en", "another thing there"), ("de", "noch ein anderes ding")]
    model = language_id.fit_rows(rows)
    held = [model.grams(t) for _, t in rows]
    kernel = np.array([[sum(len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for a, b in zip(x, y)) / language_id.LONGEST for y in held] for x in held])
    marks = model.presence([t for _, t in rows]).astype(float)
    assert np.allclose(marks @ marks.T / language_id.LONGEST, kernel, atol=1e-5)


def _apart(labelled):
    """Documents and labels of labelled documents."""
    return labelled.select("doc_id", "text"), labelled.where("doc_id is not null").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    sentence = lambda bad: " ".join(rng.choice(["thing", "ounder", "la", "rest"]) for _ in range(6)) + (f" {rng.choice(['idiot', 'morons'])} " if bad else "") + "."
    made = [(k, k % 3 == 0, " ".join(sentence(k % 3 == 0 and s == 2) for s in range(5))) for k in range(240)]
    labelled = spark.createDataFrame([(k, int(y), t) for k, y, t in made] + [(None, 1, None), (900, None, "x"), (901, 7, "y")], "doc_id long, toxic int, text string")
    model = toxicity_mil.fit(*_apart(labelled.where("doc_id < 160 or doc_id is null")))
    rows = toxicity_mil.score(labelled.where("doc_id between 160 and 239"), model).join(labelled, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in rows)
    for r in rows:
        assert [any(w in r.text[o.begin : o.end] for w in ("idiot", "moron")) for o in r.offending] == [True] * r.toxic
    assert toxicity_mil.score(empty, model).count() == 0
    assert all(0 <= r.score < 0.5 for r in toxicity_mil.score(docs, model).collect())
    untaught = toxicity_mil.fit(*_apart(labelled.where("toxic = 1")))
    assert {r.score for r in toxicity_mil.score(docs, untaught).collect()} == {0.0}


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string").repartition(3)


def test_nn_descent(spark):
    rng = np.random.default_rng(2)
    made = [rng.standard_normal(12) for _ in range(150)]
    for k in range(40):
        made.append(made[k % 9] + rng.standard_normal(12) * 0.12)  # links, chains and near misses
    made += [made[0]] * 5
    made += [np.ones(12) + rng.standard_normal(12) * 0.01 for _ in range(130)]  # a group that fills lists
    rows = [(i, v.tolist(), "c") for i, v in enumerate(made)]
    unit = np.stack([v / np.linalg.norm(v) for v in made])
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = list(range(len(made)))
    simhash_gray.hook(lab := np.array(label), *np.nonzero(link))
    odd = [(500, None, "c"), (501, [0.0] * 12, "c"), (502, [1.0, None], "c"), (503, [float("nan")], "c"), (504, [float("inf"), 1.0], "c"), (505, [], "c"), (501, [0.0], "c")]
    found = nn_descent.near_duplicates(vectors_table(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        wanted = (0, r.vec_id) if r.vec_id >= 500 else (int(link[r.vec_id].sum()), int(lab[r.vec_id]))
        assert (r.n_links, r.component_id, r.kept) == (*wanted, wanted[1] == r.vec_id)
    assert nn_descent.near_duplicates(vectors_table(spark, [])).count() == 0


def against_force(spark, made):
    unit = np.stack([v / np.linalg.norm(v) for v in made])
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    simhash_gray.hook(label := np.arange(len(made)), *np.nonzero(link))
    found = nn_descent.near_duplicates(vectors_table(spark, [(i, v.tolist(), "c") for i, v in enumerate(made)])).collect()
    assert len(found) == len(made)
    assert not [r for r in found if (r.n_links, r.component_id) != (int(link[r.vec_id].sum()), int(label[r.vec_id]))]
    return link


def test_two_dense_groups_with_links_across(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "CLOSING", 100)
    rng = np.random.default_rng(8)
    apart = np.arccos(0.915)
    axes = np.eye(64)[0], np.cos(apart) * np.eye(64)[0] + np.sin(apart) * np.eye(64)[1]
    near = lambda axis: axis + np.concatenate([np.zeros(2), rng.standard_normal(62)]) * 0.0223
    link = against_force(spark, [near(axes[k % 2]) for k in range(300)])
    assert 0 < link[::2, 1::2].sum() < 100


def test_isolated_pairs_among_many_vectors(spark):
    rng = np.random.default_rng(6)
    made = rng.standard_normal((2500, 64))
    made /= np.linalg.norm(made, axis=1)[:, None]
    for k in range(60):  # planted pairs at 0.905
        side = made[k + 1000] - (made[k + 1000] @ made[k]) * made[k]
        made[k + 1000] = 0.905 * made[k] + np.sqrt(1 - 0.905**2) * side / np.linalg.norm(side)
    assert against_force(spark, list(made)).sum() == 120


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.3).tolist(), "") for i in range(120)]
    unit = np.stack([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    wanted = (unit @ unit.T >= 0.9).sum(1) - 1
    found = {r.vec_id: r.n_links for r in nn_descent.near_duplicates(vectors_table(spark, rows)).collect()}
    assert [found[i] for i in range(120)] == wanted.tolist()


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(maxscore_topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore_topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    made = [rng.standard_normal(rng.integers(0, 20)) / 4 for _ in range(300)] + [np.full(6, 0.25)] * 30
    rows = [(i, v.tolist(), "c") for i, v in enumerate(made)] + [(350, [1e9, 3e9], ""), (400, [None], ""), (450, None, ""), (None, [1.0], ""), (401, [float("nan")], "")]
    table = maxscore_topk.quantised(vectors_table(spark, rows), "vec_id", "embedding")
    got = {}
    for r in maxscore_topk.top_k(table, table.where("id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows[:331]}
    for q in range(0, 351, 50):
        wanted = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(wanted)]
    assert maxscore_topk.top_k(table.where("false"), table.where("false")).count() == 0


def test_top_k_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    made = rng.standard_normal((200, 16))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(made)] + [(i, made[i].tolist(), "c") for i in (0, 50, 100) for _ in range(3 + i // 10)]
    table = maxscore_topk.quantised(vectors_table(spark, rows), "vec_id", "embedding")
    whole = [(i, np.floor(np.array(v) * maxscore_topk.SCALE).astype(int)) for i, v, _ in rows]
    found = {}
    for r in maxscore_topk.top_k(table, table.where("id % 50 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [x for x in whole if x[0] % 50 == 0]
    for query in {i for i, _ in asked}:
        best = sorted((-int(v @ dict(asked)[query]), i) for i, v in whole if i != query)[:5]
        wanted = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert sorted(found[query]) == sorted(wanted * sum(i == query for i, _ in asked))


def test_blocks_are_numbered_without_bringing_them_together(spark, monkeypatch):
    monkeypatch.setattr(maxscore_topk, "SHARD_ROWS", 10)
    monkeypatch.setattr(simhash_gray, "BLOCK", 10)
    plans, keep = [], common.keep
    monkeypatch.setattr(common, "keep", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or keep(df, label))
    rows = spark.range(200).select("id", F.lit(b"12345678").alias("weights"))
    blocks = maxscore_topk._blocks(rows, 10, "test-shards").collect()
    assert sorted(r.block for r in blocks) == list(range(len(blocks)))
    assert sorted(i for r in blocks for i in np.frombuffer(r.ids, "<i8")) == list(range(200))
    simhash_gray.fingerprint_links(spark.range(200).select(F.col("id").alias("fp")))
    assert plans and not any("Window [" in plan for plan in plans)
    assert common.numbered(spark.createDataFrame([], "part long, seq long, x string")).columns == ["x", "block"]


def test_quotation_threads(spark):
    rows = [
        (1, 0, "user", "The first point.\n\nAnother thing to say."), (1, 1, "assistant", "An answer of mine"), (1, 2, "user", "Anna wrote:\n> Another THING, to say\nI disagree."),
        (1, 3, "user", "> > Another thing to say.\n> I disagree\nI don't."), (1, 4, "user", "> never said by anyone\nhm"), (2, 0, "user", None), (2, 1, "user", "> The first point.\nin another conversation"),
        (None, 0, "user", "x"), (2, None, "user", "> in another conversation"), (1, 1, "assistant", "An answer of mine"),
    ]
    rows += [(3, k, "user", "again and again") for k in range(50)]
    table = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, position int, parsed string").repartition(4)
    found = quote_threads.conversations(table).collect()
    assert len(found) == len(rows)
    one = sorted((r for r in found if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(6))
    assert [r.turn for r in one] == [0, 2, 3, 1, 1, 4]
    assert {r.turn: r.reply_to for r in one} == {0: None, 1: None, 2: 0, 3: 2, 4: None}
    assert {r.turn: r.text for r in one} == {0: rows[0][3], 1: "An answer of mine", 2: "I disagree.", 3: "I don't.", 4: "hm"}
    assert [r.turn for r in sorted((r for r in found if r.conv_id == 3), key=lambda r: r.position)] == list(range(50))
    assert all(r.reply_to is None for r in found if r.conv_id != 1)
    assert quote_threads.conversations(table.where("false")).count() == 0


def test_contract_columns(spark):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_pii_digest():
    spans = [("email", 3, 9)]
    assert pii_semicrf.digest(spans) == hashlib.sha256(b"email:3:9").hexdigest()
