"""The contract queries themselves, on small tables with nulls, repeated ids and rows, odd texts and clashing columns, against plain versions."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skyledger.llm import language_id, pii_semicrf, queries, toxicity_mil

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n", "½ ² Ⅳ ①", "a", "12 34", "İstanbul ΣΑΣ ß", "日本語。", "x" * 3000, "mail a.b@c.org or 10.2.3.4, card 4111 1111 1111 1111, +1 (243) 555-5526", "word " * 5000]
CLASH = "found string, score double, held_out string, n_links long, row long, `_toxicity` string, `_language` string, _mix string, more string, fp long"


def clashing(rows: list[tuple]) -> list[tuple]:
    return [(*r, "c", 0.5, "h", 7, 9, "t", "l", "m", "o", 3) for r in rows]


def speech(rng: random.Random, parts: list[str], n: int, bad: bool = False) -> str:
    words = ["".join(rng.choices(parts, k=2)) for _ in range(n)]
    if bad:
        words[rng.randrange(n)] = rng.choice(["vileword", "viler", "vilest"])
    return " ".join(w + ("." if k % 7 == 6 else "") for k, w in enumerate(words))


PARTS = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "ä", "ein"], "fr": ["eau", "é", "que", "oi"]}


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    docs = [(k, t, "en") for k, t in enumerate(ODD)]
    for k in range(300):
        lang = list(PARTS)[k % 3]
        docs.append((100 + k, speech(rng, PARTS[lang], 30, k % 5 == 0), lang if k % 11 else None))
    docs += [(100, docs[len(ODD)][1], "en"), (101, "another text of the same id", "de"), (None, "no id here at all", "en"), (None, None, None)]
    labels = [(100 + k, 1, int(k % 5 == 0)) for k in range(300) if k % 7] + [(None, 1, 1), (105, None, None), (9999, 0, 0)]
    talk = [(k, t, "user", x) for k in range(6) for t, x in enumerate(["First point.\n\nSecond one", None, "Anna wrote:\n> Second one\nno", "", "> > second ONE\n> no\nyes"])] + [(None, None, None, None), (3, 1, "user", None)]
    gen = np.random.default_rng(5)
    made = [gen.standard_normal(8) for _ in range(120)]
    made += [made[k % 10] * 2 + gen.standard_normal(8) * 0.2 for k in range(60)]
    vecs = [(k, v.tolist(), 0) for k, v in enumerate(made)] + [(0, made[0].tolist(), 1), (50, made[3].tolist(), 1), (50, made[7].tolist(), 1), (300, [1e14] * 8, 0), (301, [1e300, -1.0], 0), (350, [0.0] * 8, 0)]
    vecs += [(400, None, 0), (401, [None, 1.0], 0), (402, [float("nan")], 0), (403, [float("inf")], 0), (404, [], 0), (None, made[5].tolist(), 0)]
    return {"documents": docs, "labels": labels, "conversations": talk, "embeddings": vecs}


SHAPES = {"documents": "doc_id long, text string, lang string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn int, role string, text string", "embeddings": "vec_id long, embedding array<double>, label int"}


@pytest.fixture(scope="module")
def folders(spark, tables, tmp_path_factory):
    found = {}
    for kind in ("full", "empty"):
        root = tmp_path_factory.mktemp(kind)
        for name, rows in tables.items():
            df = spark.createDataFrame(clashing(rows) if kind == "full" else [], f"{SHAPES[name]}, {CLASH}")
            df.repartition(3).write.parquet(f"{root}/{name}.parquet")
        found[kind] = str(root)
    return found


KINDS = {
    "op1_quote_threads": "conv_id bigint, turn bigint, role string, position bigint, reply_to bigint, n_quoted bigint, n_linked bigint, text string",
    "op2_nn_descent": "vec_id bigint, n_links bigint, component_id bigint, kept boolean, recall double",
    "op3_suffix_pieces": "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_toxicity_mil": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_maxscore_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_sst_shards": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_simhash_gray": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_pii_semicrf": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", sorted(KINDS))
def test_shape_rows_and_empty_tables(spark, folders, tables, name):
    df = queries.queries()[name](spark, folders["full"])
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == KINDS[name]
    rows = df.collect()
    table = {"op1_quote_threads": "conversations", "op2_nn_descent": "embeddings"}.get(name, "documents")
    if name not in ("op6_best_fit_packing", "op7_maxscore_topk"):
        assert len(rows) == len(tables[table])
    assert queries.queries()[name](spark, folders["empty"]).collect() == []


def fold(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def some(rows) -> str:
    return sorted(map(str, rows))


def test_packing_and_shards_of_whole_texts(spark, folders, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _ in tables["documents"]]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    rows = queries.op6_best_fit_packing(spark, folders["full"]).collect()
    wanted = [(i, n, at, len(x[at : at + 2048]), crc(x[at : at + 2048])) for i, own in ids for x in [[*own, 0]] for n, at in enumerate(range(0, len(x), 2048))]
    assert some(tuple(r[:5]) for r in rows) == some(wanted)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(h)] == np.cumsum([0, *(n for _, n in sorted(h))])[:-1].tolist() and sum(n for _, n in h) <= 2048 for h in held.values())
    assert len(held) == math.ceil(sum(r.length for r in rows) / 2048)
    shards = sorted(queries.op8_sst_shards(spark, folders["full"]).collect(), key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id) for r in shards]
    assert [k[0] for k in keys] == sorted(k[0] for k in keys) and [k[1] for k in keys if k[0]] == sorted(k[1] for k in keys if k[0])
    assert some((r.doc_id, r.n_tokens, r.ids_crc32) for r in shards) == some((i, len(x) + 1, crc([*x, 1])) for i, x in ids)
    assert [r.start for r in shards] == np.cumsum([0, *(r.n_tokens for r in shards)])[:-1].tolist()


def test_pieces_equal_the_library(spark, folders, tables):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    wanted = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), model.decode(x) == (t or "")) for i, t, _ in tables["documents"] for x in [model.encode(t or "")]]
    assert some(map(tuple, queries.op3_suffix_pieces(spark, folders["full"]).collect())) == some(wanted)


def test_coded_tables_keep_their_columns(spark):
    from skyledger.llm import suffix_pieces

    docs = spark.createDataFrame([(1, "ein Text  mit\nZeilen", b"x", "d"), (2, None, None, None)], "doc_id long, text string, ids binary, `_ids` string")
    found = suffix_pieces.coded(docs, public_tokenizers.path(queries.PIECES))
    rows = sorted(found.collect())
    assert found.columns == ["doc_id", "text", "ids", "_ids", "__ids", "decoded"] and rows[0].ids == b"x" and rows[0].decoded == rows[0].text
    assert bytes(rows[1]["__ids"]) == b"" and rows[1].decoded == "" and rows[1].text is None


def valid(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_best_of_whole_numbers(spark, folders, tables):
    rows = [(i, [math.floor(256 * x) if abs(x) < 1e290 else int(x) * 256 for x in v]) for i, v, _ in tables["embeddings"] if i is not None and valid(v)]
    wanted = []
    for at, (i, v) in enumerate(rows):
        if i % 50 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for k, (j, w) in enumerate(rows) if k != at)
            wanted += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    assert some(map(tuple, queries.op7_maxscore_topk(spark, folders["full"]).collect())) == some(wanted)


def test_linked_vectors(spark, folders, tables):
    rows = [(i, np.array(v, float)) for i, v, _ in tables["embeddings"] if valid(v) and any(v)]
    width = max(len(v) for _, v in rows)
    unit = np.stack([np.pad(v / np.abs(v).max(), (0, width - len(v))) for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[k], *label[np.flatnonzero(link[k])]]) for k in range(len(rows))])
        if (new == label).all():
            break
        label = new
    least = {g: min((i for (i, _), x in zip(rows, label) if x == g and i is not None), default=None) for g in set(label)}
    wanted = [(i, int(link[k].sum()), least[label[k]], i == least[label[k]]) for k, (i, _) in enumerate(rows)]
    wanted += [(i, 0, i, True) for i, v, _ in tables["embeddings"] if not (valid(v) and any(v))]
    assert some(tuple(r[:4]) for r in queries.op2_nn_descent(spark, folders["full"]).collect()) == some(wanted)


def test_language_scores_equal_nystroem_and_ridge_solved_plainly(spark, folders, tables):
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    model = language_id.fit(docs.where(queries.fold(4) != 2).select("text", "lang"))
    learned = sorted({(lang, t) for i, t, lang in tables["documents"] if fold(i, 4) != 2 and lang and t and any(map(str.isalpha, t))})
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    learned.sort(key=lambda x: (x[0], hashes[x[1]]))
    rows = [x for lang in sorted({lang for lang, _ in learned}) for x in [y for y in learned if y[0] == lang][: language_id.TRAIN_DOCS]]

    def grams(text):
        text = "".join(c if c in alphabet else "\0" for c in text.lower())
        return [{text[k : k + n] for k in range(len(text) - n + 1)} for n in range(1, language_id.LONGEST + 1)]

    alphabet = {chr(c) for c in model.letters}
    landmarks = [t for lang in sorted({lang for lang, _ in rows}) for t in [t for x, t in rows if x == lang][: language_id.LANDMARKS]]
    marks = [grams(t) for t in landmarks]
    known = [set().union(*(m[n] for m in marks)) for n in range(language_id.LONGEST)]

    def kernel(a, b):
        return sum(len(x & y & k) / math.sqrt(max(1, len(x)) * max(1, len(y))) for x, y, k in zip(a, b, known)) / language_id.LONGEST

    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram + language_id.JITTER * np.eye(len(gram)))
    root = vectors / np.sqrt(np.maximum(values, language_id.JITTER)) @ vectors.T
    mapped = lambda text: np.array([kernel(grams(text), b) for b in marks]) @ root
    x = np.stack([mapped(t) for _, t in rows])
    y = np.array([[1.0 if lang == own else -1.0 for own in model.languages] for lang, _ in rows])
    weight = np.array([1 / sum(lang == own for own, _ in rows) for lang, _ in rows])
    solved = np.linalg.solve(x.T @ (x * weight[:, None]) + language_id.RIDGE * np.eye(x.shape[1]), x.T @ (y * weight[:, None]))
    plain = {i: mapped(t) @ solved for i, t, _ in tables["documents"] if t and i is not None and 110 <= i < 160}
    found = {r.doc_id: r for r in queries.op4_language_id(spark, folders["full"]).collect()}
    for i, scores in plain.items():
        best = int(scores.argmax())
        assert found[i].lang_pred == model.languages[best] and abs(found[i].score - min(1, max(0, (scores[best] + 1) / 2))) < 2e-3
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (0, 1, 2, 3, 5)) and found[4].lang_pred != "und"
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in found.values())


def test_toxicity_is_a_noisy_or_of_sentences(spark, folders, tables):
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{folders['full']}/labels.parquet"))
    texts = {i: t for i, t, _ in tables["documents"] if i is not None and i >= 102}
    rows = {r.doc_id: r for r in queries.op5_toxicity_mil(spark, folders["full"]).collect()}
    for i, text in texts.items():
        clean = 1.0
        for sentence in re.split(r"[.!?\n]+", text):
            if re.search(r"\w", sentence):
                words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity_mil.features(w))
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(rows[i].score - (1 - clean)) < 1e-9 and rows[i].predicted == (rows[i].score >= 0.5)
        assert rows[i].held_out == (fold(i, 5) == 0) and rows[i].predicted == ("vile" in text)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_toxicity_weights_are_where_the_likelihood_is_flat():
    """Numeric gradient of the penalised likelihood through the noisy-or, at the trained weights and bias."""
    rng = random.Random(2)
    rows = []
    for k in range(120):
        bad = k % 3 == 0
        text = " ".join(" ".join(rng.choice(["thing", "other", "rest", "vilest" if rng.random() < 0.03 else "more"]) for _ in range(5)) + "." for _ in range(4))
        rows.append((int(bad), 1.0, text + (" such vilest thing." if bad and k % 9 else "")))
    model = toxicity_mil.fit_rows(rows)

    def likelihood(weights, bias):
        total = 0.0
        for y, share, text in rows:
            left = 0.0
            for b, e in toxicity_mil.sentences(text):
                z = bias + sum(weights.get(f, 0.0) for w in set(re.findall(r"[^\W\d_]+", text[b:e].lower())) for f in toxicity_mil.features(w))
                left -= np.logaddexp(0, z)
            total += share * (math.log(-math.expm1(left)) if y else left)
        return total / len(rows) - toxicity_mil.PENALTY / 2 * sum(w * w for w in weights.values())

    step = 1e-4
    up, down = (likelihood(model.weights, model.bias + s) for s in (step, -step))
    assert abs(up - down) / (2 * step) < 5e-3
    for name in model.weights:
        up, down = (likelihood({**model.weights, name: model.weights[name] + s}, model.bias) for s in (step, -step))
        assert abs(up - down) / (2 * step) < 5e-3


def test_personal_data_digests(spark, folders, tables):
    import hashlib

    rows = {r.doc_id: r for r in queries.op10_pii_semicrf(spark, folders["full"]).collect()}
    for i, text, _ in tables["documents"]:
        if i is None or i in (100, 101):
            continue
        base = pii_semicrf.base_spans(text or "")
        own = rows[i]
        assert [own.n_email, own.n_ip, own.n_card, own.n_phone] == [sum(s[0] == k for s in base) for k in pii_semicrf.KINDS]
        listed = [f"{k}:{b}:{e}" for k, b, e in base]
        assert own.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = own.spans.split(",") if own.spans else []
        order = [(pii_semicrf.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert set(listed) <= set(spans) and order == sorted(order)
    assert [rows[9].n_email, rows[9].n_ip, rows[9].n_card, rows[9].n_phone] == [1, 1, 1, 1]


def test_rewritten_spans_that_no_pattern_matches_are_found():
    rng = random.Random(99)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    plain = [" ".join(word() if rng.random() < 0.9 else str(rng.randrange(2000)) for _ in range(60)) for _ in range(750)]
    model = pii_semicrf.SemiMarkov().train(plain[:600])
    # In texts of words and small numbers next to nothing is found: a few numbers in a row may look like one.
    assert not any(pii_semicrf.base_spans(text) for text in plain) and sum(len(model.spans(text)[1]) for text in plain[600:]) <= 3
    hits = {k: [] for k in pii_semicrf.KINDS}
    for text in plain[600:]:
        kind = rng.choice(pii_semicrf.KINDS)
        span = pii_semicrf.altered(kind, pii_semicrf.invented(kind, rng), rng)
        words = text.split(" ")
        at = rng.randrange(1, len(words))
        before = " ".join(words[:at]) + " "
        base, spans = model.spans(before + span + " " + " ".join(words[at:]))
        hits[kind].append((kind, len(before), len(before) + len(span)) in spans)
    assert all(sum(h) >= 0.85 * len(h) for h in hits.values()), {k: sum(h) / len(h) for k, h in hits.items()}


def test_a_long_run_of_candidates_is_whole():
    text = " ".join(["10.2.3.x"] * 70) + " 4111.1111.1111.1111"
    assert [len(run) for run in pii_semicrf.islands(text)] == [71]
    assert [len(run) for run in pii_semicrf.islands("a (at) b (dot) org, 5 . 6 then 7")] == [8, 1]


def test_found_column_clashes(spark):
    docs = spark.createDataFrame([(1, "a@b.org", "mine", "also")], "doc_id long, text string, found string, _found string")
    rows = pii_semicrf.find(docs, pii_semicrf.SemiMarkov())
    assert rows.columns == ["doc_id", "text", "found", "_found", "__found"] and rows.first().found == "mine"


def test_announcing_lines_of_any_length(spark, tmp_path):
    from skyledger.llm import quote_threads

    body, _, quoted = quote_threads.parse("x" * 250 + " wrote:\n> some words\nmine")
    assert body == "mine" and len(quoted) == 1


def threads_by_force(messages):
    """Replies and order of one conversation's (turn, text), each quoting line by line at most."""
    plain = lambda s: re.sub(r"[\W_]+", "", s.lower())
    said, replies = {}, {}
    for turn, text in messages:
        lines = [(re.match(r"[ \t]*((?:>[ \t]?)*)", x).group(1).count(">"), re.sub(r"^[ \t]*(?:>[ \t]?)+", "", x)) for x in text.split("\n")]
        votes = {}
        for level, line in lines:
            if level and plain(line) in said and said[plain(line)] < turn:
                own = votes.setdefault(level, {})
                own[said[plain(line)]] = own.get(said[plain(line)], 0) + len(plain(line))
        if votes:
            own = votes[min(votes)]
            replies[turn] = max(own, key=lambda t: (own[t], t))
        for level, line in lines:
            if not level and plain(line):
                said.setdefault(plain(line), turn)
    root = lambda t: root(replies[t]) if t in replies else t
    return replies, [t for _, t in sorted((root(t), t) for t, _ in messages)]


def test_generated_threads_against_brute_force(spark):
    from skyledger.llm import quote_threads

    rng = random.Random(11)
    rows, wanted = [], {}
    for conv in range(40):
        messages = []
        for turn in range(12):
            own = f"statement {conv} {turn} {rng.randrange(10**6)}"
            if messages and rng.random() < 0.7:
                other = rng.choice(messages)[1].split("\n")
                text = "\n".join(["> " + x for x in other] + [own])  # quotes of quotes go a level down
            else:
                text = own
            messages.append((turn, text))
        wanted[conv] = threads_by_force(messages)
        rows += [(conv, t, "user", x) for t, x in messages]
    found = quote_threads.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert sum(r.n_linked for r in found) > 200
    for conv, (replies, order) in wanted.items():
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.position)
        assert {r.turn: r.reply_to for r in own if r.reply_to is not None} == replies
        assert [r.turn for r in own] == order and all(">" not in r.text and r.text.startswith("statement") for r in own)


def test_rare_links_among_many_vectors(spark):
    """80 planted links among 40,000 vectors, and a dense group that fills every list."""
    from skyledger.llm import nn_descent

    gen = np.random.default_rng(17)
    made = gen.standard_normal((40_000, 32))
    made /= np.linalg.norm(made, axis=1)[:, None]
    for k in range(80):
        side = made[k + 1000] - (made[k + 1000] @ made[k]) * made[k]
        made[k + 1000] = 0.91 * made[k] + math.sqrt(1 - 0.91**2) * side / np.linalg.norm(side)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in nn_descent.near_duplicates(table).where("n_links > 0").collect()}
    assert all(rows[k + 1000].component_id == k and rows[k].n_links == 1 for k in range(80)) and len(rows) == 160
