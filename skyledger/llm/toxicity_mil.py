"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence has the logistic score of its distinct words, each the sum of what the whole word and its
first letters (`PREFIXES` of them, so inflected forms count) weigh; a document's score is the noisy-or of
its sentences, 1 - prod(1 - p). Only documents are labelled: weights are trained by gradient on the
documents' likelihood through the noisy-or, and then the sentence scores locate what offends.

The model is fitted on a bounded sample (`TRAIN_DOCS` distinct labelled texts a class, by least hash; class weights restore their shares); its words and prefixes are at most `FEATURES`, those
most tied to the label by a chi-square test.

Defined results: a text that is null, empty or without a word has no sentence and scores 0; equal
rows have equal results; an empty table gives no row, and without labels of both classes every score
is 0; other columns are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

TRAIN_DOCS, FEATURES, LEAST_DOCS, LEAST_CHI = 2000, 2000, 5, 20.0
PREFIXES, KEPT_WORDS = range(3, 8), 120_000
STEPS, RATE, PENALTY, FIRST_BIAS, LEAST_WEIGHT = 300, 0.1, 1e-4, -6.0, 0.1
OFFENDING = THRESHOLD = 0.5
#: The column that holds what was found; no column of the input is touched.
FOUND = "_toxicity"

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"\w")


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text) if _EDGE.search(m.group())]


def features(word: str) -> list[str]:
    """The first letters of a word, and the word with its end marked."""
    return [word[:n] for n in PREFIXES if n <= len(word)] + [word + "$"]


class InstanceModel:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[str, float] = {}

    def value(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > KEPT_WORDS:
                self._known.clear()
            found = self._known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its offending sentences."""
        text = text or ""
        if not self.weights:
            return 0.0, []
        lowered = text.lower()
        cuts = sentences(text)
        left = -np.logaddexp(0, self.bias) * len(cuts)
        offending = []
        words = {w for w in set(_WORD.findall(lowered)) if self.value(w)} if cuts else set()
        if words:
            own: dict[int, set[str]] = {}
            begins = [begin for begin, _ in cuts]
            for m in _WORD.finditer(text):
                word = m.group().lower()
                if word in words:
                    own.setdefault(bisect_right(begins, m.start()) - 1, set()).add(word)
            for k in sorted(own):
                z = sum(map(self.value, sorted(own[k])))
                left += np.logaddexp(0, self.bias) - np.logaddexp(0, self.bias + z)
                p = 1 / (1 + np.exp(-self.bias - z))
                if p >= OFFENDING:
                    offending.append((*cuts[k], float(p)))
        return float(-np.expm1(left)), offending


def fit_rows(rows: list[tuple[int, float, str]]) -> InstanceModel:
    """From (label, weight, text)."""
    docs = [[set(_WORD.findall(text[b:e].lower())) for b, e in sentences(text)] for *_, text in rows]
    label = np.array([y for y, *_ in rows], float)
    share = np.array([w for _, w, _ in rows])
    if not len(label) or label.min() == label.max():
        return InstanceModel({}, FIRST_BIAS)
    seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for y, words in zip(label, docs):
        seen[int(y)].update({f for own in words for w in own for f in features(w)})
    n1, n0 = int(label.sum()), int((1 - label).sum())

    def chi(word: str) -> float:
        a, b = seen[1][word], seen[0][word]
        n, c, d = n1 + n0, n1 - a, n0 - b
        if a * n0 <= b * n1:
            return 0.0  # a sentence offends by what it has
        return n * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * n1 * n0)

    kept = sorted((w for w in seen[1].keys() | seen[0].keys() if seen[1][w] + seen[0][w] >= LEAST_DOCS and chi(w) >= LEAST_CHI), key=lambda w: (-chi(w), w))[:FEATURES]
    place = {w: k for k, w in enumerate(kept)}
    # Sentences with a kept feature, flat: (sentence, feature); all others of a document score the bias.
    sentence_doc, flat_sentence, flat_feature, empty = [], [], [], np.zeros(len(docs))
    for d, words in enumerate(docs):
        for own in words:
            hits = [place[f] for w in own for f in features(w) if f in place]
            if hits:
                flat_sentence += [len(sentence_doc)] * len(hits)
                flat_feature += hits
                sentence_doc.append(d)
            else:
                empty[d] += 1
    sentence_doc, flat_sentence, flat_feature = (np.array(x, np.int64) for x in (sentence_doc, flat_sentence, flat_feature))
    w, bias = np.zeros(len(kept)), FIRST_BIAS
    mean, square = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(flat_sentence, w[flat_feature], len(sentence_doc))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        left = -np.bincount(sentence_doc, np.logaddexp(0, z), len(docs)) - empty * np.logaddexp(0, bias)
        q = np.exp(np.minimum(left, -1e-9))
        pull = np.where(label == 1, q / (1 - q), -1.0) * share  # d likelihood / d z = pull * p
        down = pull[sentence_doc] * p
        gradient = np.append(np.bincount(flat_feature, down[flat_sentence], len(kept)) / share.sum() - PENALTY * w, (down.sum() + (pull * empty).sum() * p0) / share.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, bias = w + move[:-1], bias + move[-1]
    return InstanceModel({word: float(x) for word, x in zip(kept, w) if abs(x) >= LEAST_WEIGHT}, float(bias))


def fit(docs: DataFrame, labels: DataFrame) -> InstanceModel:
    """Fits on a bounded sample of `docs(doc_id, text)` by `labels(doc_id, toxic)`, a row for each id.

    Other labels than 0 and 1 are left out. Labels meet the texts' hashes; only chosen texts are read.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    rows = texts.select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id")
    found = common.sampled(rows, TRAIN_DOCS, texts=texts)
    taken = Counter(label for label, *_ in found)
    return fit_rows([(label, n / taken[label], text) for label, n, text in found])


def judge(docs: DataFrame, model: InstanceModel, column: str = FOUND) -> DataFrame:
    """`docs` with one more column, which must not be there yet: its score, and its offending sentences as (begin, end, score)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    item = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    @F.arrow_udf("struct<score:double,offending:array<struct<begin:bigint,end:bigint,score:double>>>")
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = InstanceModel(*shared.value)

        def rows(some: list[str | None]) -> pa.Array:
            found = [own.score(text) for text in some]
            spans = [[{"begin": b, "end": e, "score": p} for b, e, p in x[1]] for x in found]
            return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array(spans, pa.list_(item))], ["score", "offending"])

        yield from (common.by_slices(column, rows) for column in texts)

    return docs.withColumn(column, rate(F.col("text").cast("string")))


def score(docs: DataFrame, model: InstanceModel) -> DataFrame:
    """The rows of `docs(doc_id, text)` as doc_id, score, predicted and offending."""
    scored = F.col(f"{FOUND}.score")
    return judge(docs.select("doc_id", "text"), model).select("doc_id", scored.alias("score"), (scored >= THRESHOLD).cast("int").alias("predicted"), F.col(f"{FOUND}.offending").alias("offending"))
