"""Language identification with a blended-spectrum string kernel.

The kernel of two texts adds, for each n up to `LONGEST`, the n-grams that both hold (presence, not
counts) over the root of the product of their numbers of distinct n-grams. Landmark texts give a
Nyström map of it, on which one-versus-rest kernel ridge regression is solved in closed form. The
kernel to the landmarks is linear in a text's presence vector, so map and regression fold into one
matrix a model, and a batch of texts is scored by one product of presence and model matrices.

The model is fitted on a bounded sample, by least hash: at most `TRAIN_DOCS` distinct labelled texts a
language, of which `LANDMARKS` are landmarks, and fewer of each where languages are so many that it
would be over `MOST_DOCS` and `MOST_LANDMARKS` in all. Every language that has a labelled text is a class.

How much of a text the model knows is the share of its distinct longest n-grams that a landmark has;
`least_known` is half of what is usual for texts of the sample that are no landmarks. A text under it
is of no learned language, whatever the best score is.

Defined results: `und` and score 0 where the text is null or holds no letter, or nothing could be
learned; equal rows have equal results; an empty table gives no row; other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

ALPHABET, LONGEST = 96, 3
TRAIN_DOCS, LANDMARKS, MOST_DOCS, MOST_LANDMARKS = 300, 40, 60_000, 4_000
RIDGE, JITTER, BATCH = 1e-3, 1e-6, 64
UNKNOWN = "und"
#: The column that holds what was found; no column of the input is touched.
FOUND = "_language"


class KernelModel:
    """Letters (code point to 1..), grams (code to place), weights (places x languages) by n."""

    def __init__(self, languages: list[str], letters: np.ndarray, places: np.ndarray, weights: np.ndarray, least_known: float = 0.0):
        self.languages, self.letters, self.places, self.weights, self.least_known = languages, letters, places, weights, least_known
        size = len(letters) + 1
        table = np.zeros(0x110000, np.uint8)
        table[letters] = np.arange(1, size)
        self.table, self.size = table, size
        self.base = np.cumsum([0] + [size**n for n in range(1, LONGEST + 1)])
        self.lookup = np.full(self.base[-1], -1, np.int32)
        self.lookup[places] = np.arange(len(places))
        self.order = np.searchsorted(self.base, places, "right") - 1

    def grams(self, text: str) -> list[np.ndarray]:
        """Distinct n-grams as codes, by n; characters outside the alphabet are one kind."""
        a = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        out, code = [], a
        for n in range(1, LONGEST + 1):
            if n > 1:
                code = code[:-1] * self.size + a[n - 1 :]
            out.append(np.unique(code) + self.base[n - 1])
        return out

    def presence(self, texts: list[str]) -> np.ndarray:
        return self.read(texts)[0]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row a text of what it has, and the share of its longest n-grams that is known."""
        out, known = np.zeros((len(texts), len(self.places)), np.float32), np.zeros(len(texts))
        for k, text in enumerate(texts):
            for own in self.grams(text):
                at = self.lookup[own]
                held = at[at >= 0]
                out[k, held] = 1 / np.sqrt(max(1, len(own)))
                if len(own):  # the longest that the text has is last
                    known[k] = len(held) / len(own)
        return out, known

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """The language, its score, and how much of the text is known."""
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        lettered = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        for at in range(0, len(lettered), BATCH):
            own = lettered[at : at + BATCH]
            held, known = self.read([texts[k] for k in own])
            for k, row, share in zip(own, held @ self.weights, known.tolist()):
                best = int(row.argmax())
                out[k] = (self.languages[best], float(np.clip((row[best] + 1) / 2, 0, 1)), share)
        return out


def fit_rows(rows: list[tuple[str, str]]) -> KernelModel:
    """From (language, text) in a fixed order."""
    languages = sorted({lang for lang, _ in rows})
    counts: Counter[str] = Counter()
    for _, text in rows:
        counts.update(c for c, n in Counter(text.lower()).items() if c.isalpha() for _ in range(min(n, 20)))
    letters = np.array(sorted(ord(c) for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]), np.int64)
    model = KernelModel(languages, letters, np.zeros(0, np.int64), np.zeros((0, len(languages)), np.float32))
    if not languages:
        return model
    seen: Counter[str] = Counter()
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
    marked = [bool(seen.update([lang]) or seen[lang] <= each) for lang, _ in rows]
    landmarks = [text for (_, text), own in zip(rows, marked) if own]
    held = [model.grams(text) for text in landmarks]
    places = np.unique(np.concatenate([g for grams in held for g in grams]))
    model = KernelModel(languages, letters, places, np.zeros((len(places), len(languages)), np.float32))
    marks = model.presence(landmarks).astype(np.float64)
    kernel = marks @ marks.T / LONGEST
    values, vectors = np.linalg.eigh(kernel + JITTER * np.eye(len(kernel)))
    root = vectors / np.sqrt(np.maximum(values, JITTER)) @ vectors.T
    texts, wanted = [text for _, text in rows], np.array([[1.0 if lang == own else -1.0 for own in languages] for lang, _ in rows])
    mapped, usual = [], []
    for i in range(0, len(texts), BATCH):
        held, known = model.read(texts[i : i + BATCH])
        mapped.append(held.astype(np.float64) @ marks.T / LONGEST @ root)
        usual.append(known)
    mapped, usual = np.concatenate(mapped), np.concatenate(usual)[~np.array(marked)]
    model.least_known = float(np.median(usual)) / 2 if len(usual) else 0.0
    # Every language weighs the same.
    weight = 1 / np.array([sum(lang == own for own, _ in rows) for lang, _ in rows])
    solved = np.linalg.solve(mapped.T @ (mapped * weight[:, None]) + RIDGE * np.eye(mapped.shape[1]), mapped.T @ (wanted * weight[:, None]))
    model.weights = (marks.T / LONGEST @ (root @ solved)).astype(np.float32)
    return model


def fit(labelled: DataFrame) -> KernelModel:
    """Fits on a bounded sample of `labelled(text, lang)`; rows without a letter or language are left out."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return fit_rows([(lang, text) for lang, _, text in common.sampled(rows.withColumnRenamed("lang", "label"), TRAIN_DOCS, MOST_DOCS)])


def judge(docs: DataFrame, model: KernelModel, column: str = FOUND) -> DataFrame:
    """`docs` with one more column, which must not be there yet: lang_pred, score and known, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.letters, model.places, model.weights))

    @F.arrow_udf("struct<lang_pred:string,score:double,known:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = KernelModel(*shared.value)

        def rows(some: list[str | None]) -> pa.Array:
            found = own.predict(some)
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "known"])

        yield from (common.by_slices(column, rows) for column in texts)

    return docs.withColumn(column, predict(F.col("text").cast("string")))


def identify(docs: DataFrame, model: KernelModel) -> DataFrame:
    """The rows of `docs(doc_id, text)` as doc_id, lang_pred and score."""
    return judge(docs.select("doc_id", "text"), model).select("doc_id", f"{FOUND}.lang_pred", f"{FOUND}.score")
