"""Personal data by patterns and a semi-Markov conditional random field over whole spans.

Four pattern kinds give the base spans. A semi-Markov model scores candidate segments (runs of a few
neighbouring words that hold digits, an at sign or a word beside them that names a kind) with
features of the whole span and of the words around it. Its dynamic programme over a text picks
boundaries and kinds jointly: outside words are segments of length one, an entity is at most
`MAX_WORDS` words long. Segments that it adds are kept where its posterior is high and no base span
is touched; base spans always stay.

The model is trained on a bounded sample of documents (`SAMPLE_DOCS`), by stochastic gradient on the
segment likelihood. The patterns' own spans are labels; but so that the model learns more than the
patterns know, some of them are rewritten as people write them to be told or to hide them (`altered`:
"a (at) b (dot) c", dotted or slashed digits, a number without its plus), spans of both sorts are put
among the words of texts that have none, and all that isn't a span counts as outside.

Defined results: a null text counts as empty, which has no spans; offsets count code points, end
exclusive; equal rows have equal results; an empty table gives no row; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, EPOCHS, RATE, DECAY = 1500, 3, 0.3, 1e-4
MAX_WORDS, POSTERIOR = 7, 0.9

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What may stand where a span is: a cheap test before any word is looked at.
_TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]")
_WORD = re.compile(r"\S+")
#: Words that are a sign or a mark for one, and those that may stand between two parts of a span.
_ALONE, _BETWEEN = re.compile(r"@|[(\[](?:at|dot)[)\]]"), re.compile(r"[.,/-]")
#: Words that announce a kind, a fixed list.
CUES = {"mail": "email", "email": "email", "e-mail": "email", "ip": "ip", "host": "ip", "card": "card", "visa": "card", "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone"}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d += d * (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign ends the run of local characters before it; a match holds one at sign only."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of dotted numbers is taken four at a time; runs with a part over 255 are dropped."""
    for run in _DOTTED.finditer(text):
        parts, begin = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = begin + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                yield begin, end
            begin = end + 1


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)]
        for m in _DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


_RUNS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]")
_SHAPE = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[A-Za-zÀ-\U0010ffff]+"), "a")]
_OTHERS, _MARKS = re.compile(r"[^0-9]+"), re.compile(r"[(\[](?:at|dot)[)\]]")
_TRIM = ".,;:!?|\"'()[]{}<>"


def _trim(text: str, begin: int, end: int) -> tuple[int, int]:
    """Without the marks that end a clause; what opens a phone number, or is a mark for a sign, stays."""
    while begin < end and text[begin] in _TRIM and not (text[begin] == "(" and text[begin + 1 : begin + 2].isdigit()):
        begin += 1
    while end > begin and text[end - 1] in _TRIM:
        end -= 1
    return begin, end


def altered(kind: str, span: str, rng: random.Random) -> str:
    """A span written in a way that no pattern matches."""
    if kind == "email":
        glue = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", "."), ("(at)", ".")])
        local, _, domain = span.partition("@")
        return local + glue[0] + domain.replace(".", glue[1])
    if kind == "ip":
        return span.replace(".", rng.choice([" . ", "[.]", "(.)"]))
    if kind == "card":
        digits, glue = re.sub("[^0-9]", "", span), rng.choice([".", "/", "_"])
        return glue.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    plain = span.lstrip("+")
    return rng.choice([re.sub(r"[^0-9+]+", "/", span), "00" + plain, "00" + re.sub("[^0-9]", "", span), re.sub(r"[^0-9+]+", "_", span)])


def invented(kind: str, rng: random.Random) -> str:
    """A span that its kind's pattern matches."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    figures = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{word()}{rng.choice(['', '.' + word(), figures(2)])}@{word()}.{rng.choice(['com', 'org', 'example.net', 'de'])}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + figures(14)
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        glue = rng.choice(["", " ", "-"])
        return glue.join(whole[k : k + 4] for k in range(0, 16, 4))
    country, area, rest = rng.choice(["1", "44", "49", "33"]), figures(3), figures(7)
    return rng.choice([f"+{country} ({area}) {rest[:3]}-{rest[3:]}", f"+{country} {area} {rest}", f"+{country}-{area}-{rest[:3]}-{rest[3:]}", f"+{country}{area}{rest}"])


def lesson(text: str, rng: random.Random) -> tuple[str, set[tuple[tuple[int, int], str]]]:
    """A text to learn from with its true spans: some are rewritten, and a few are put in."""
    out, gold, at, size = [], set(), 0, 0

    def add(part: str, kind: str | None = None) -> None:
        nonlocal size
        if kind:
            gold.add(((size, size + len(part)), kind))
        out.append(part)
        size += len(part)

    spans = sorted(base_spans(text), key=lambda s: (s[1], -s[2]))
    gaps = [m.end() for m in re.finditer(r"\s+", text) if not any(b < m.end() < e for _, b, e in spans)]
    new = {gap: rng.choice(KINDS) for gap in rng.sample(gaps, min(len(gaps), 3))}
    for begin, end, kind in sorted([(b, e, k) for k, b, e in spans] + [(gap, gap, kind) for gap, kind in new.items()]):
        if begin < at:
            continue
        add(text[at:begin])
        own = text[begin:end] or invented(kind, rng)
        add(altered(kind, own, rng) if rng.random() < 0.5 else own, kind)
        if begin == end:
            add(" ")
        at = end
    add(text[at:])
    whole = "".join(out)
    # What patterns find beside (a card within a run of figures) is no mistake of the model.
    return whole, gold | {(span[1:], span[0]) for span in base_spans(whole)}


def features(text: str, begin: int, end: int, before: str, n_words: int) -> list[str]:
    """Of a whole candidate span; kinds are crossed with them in the weights."""
    own = text[begin:end]
    digits = _OTHERS.sub("", own)
    shape = own[:80]
    for pattern, mark in _SHAPE:
        shape = pattern.sub(mark, shape)
    parts = own.split(".")
    out = [
        "bias", f"words={n_words}", f"digits={min(len(digits), 24)}", f"shape={shape[:24]}", f"first={'9' if own[:1].isdigit() else own[:1] if not own[:1].isalpha() else 'a'}",
        f"at={own.count('@')}", f"dots={min(own.count('.'), 6)}", f"share={len(digits) * 4 // max(1, len(own))}", f"luhn={len(digits) >= 12 and luhn(digits)}",
        f"quad={len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
        f"marks={min(len(_MARKS.findall(own)), 3)}", f"last={own[-1:].isalnum()}", f"groups={min(len(_RUNS.findall(own)), 8)}", f"letters={bool(_LETTERS.search(own))}",
    ]
    cue = CUES.get(before.lower().strip(_TRIM))
    return out + ([f"cue={cue}"] if cue else [])


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words around digits, at signs and marks for signs: what lies between can hold no entity.

    A sign that stands alone takes the words beside it in, and a lone dot or dash between two such
    words does not part them.
    """
    run: list[tuple[int, int]] = []
    begin = -1
    for hit in _TRIGGER.finditer(text):
        if hit.start() < begin:
            continue
        left = hit.start()
        while left > 0 and not text[left - 1].isspace():
            left -= 1
        own = [_WORD.match(text, left).span()]
        if _ALONE.fullmatch(text, *own[0]):
            end = left
            while end > 0 and text[end - 1].isspace():
                end -= 1
            left = end
            while left > 0 and not text[left - 1].isspace():
                left -= 1
            after = _WORD.search(text, own[0][1])
            own = [w for w in ((left, end), *own, after.span() if after else (0, 0)) if w[0] < w[1]]
        own = [w for w in own if not run or w[0] >= run[-1][1]]
        if run and own:
            gap = [m.span() for m in _WORD.finditer(text, run[-1][1], own[0][0])] if own[0][0] - run[-1][1] < 8 else [(0, 0)] * 2
            if len(gap) == 1 and _BETWEEN.fullmatch(text, *gap[0]):
                own = gap + own
            elif gap:
                yield run
                run = []
        run += own
        begin = run[-1][1]
    if run:
        yield run


class SemiMarkov:
    """Weights of (feature, kind); segments outside have score zero."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def _segments(self, text: str, words: list[tuple[int, int]]):
        """By the word after the last: (first word, span, features) of every candidate."""
        n = len(words)
        found = [[] for _ in range(n + 1)]
        for i in range(n):
            before = text[max(0, words[i][0] - 24) : words[i][0]].split()
            for j in range(i + 1, min(n, i + MAX_WORDS) + 1):
                begin, end = _trim(text, words[i][0], words[j - 1][1])
                if end - begin >= 4:
                    found[j].append((i, (begin, end), features(text, begin, end, before[-1] if before else "", j - i)))
        return found

    def _score(self, names: list[str], kind: str) -> float:
        return sum(self.weights.get((name, kind), 0.0) for name in names)

    def posteriors(self, text: str, words: list[tuple[int, int]]):
        """Every candidate with its kind, its posterior and its features, by forward and backward sums."""
        n, ends = len(words), self._segments(text, words)
        scored = [[(i, span, names, kind, self._score(names, kind)) for i, span, names in ends[j] for kind in KINDS] for j in range(n + 1)]
        ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            ahead[j] = _logsum([ahead[j - 1], *(ahead[i] + s for i, _, _, _, s in scored[j])])
        starts = defaultdict(list)
        for j in range(n + 1):
            for i, *_, s in scored[j]:
                starts[i].append((j, s))
        for i in range(n - 1, -1, -1):
            back[i] = _logsum([back[i + 1], *(back[j] + s for j, s in starts[i])])
        for j in range(n + 1):
            for i, span, names, kind, s in scored[j]:
                yield span, kind, math.exp(min(0.0, ahead[i] + s + back[j] - ahead[n])), names, i, j, s

    def decode(self, text: str, words: list[tuple[int, int]]) -> list[tuple[Span, float]]:
        """The best joint choice of boundaries and kinds, each with its posterior."""
        ends = defaultdict(list)
        for span, kind, p, _, i, j, s in self.posteriors(text, words):
            ends[j].append((i, span, kind, p, s))
        best, step = [0.0] * (len(words) + 1), [None] * (len(words) + 1)
        for j in range(1, len(words) + 1):
            best[j] = best[j - 1]
            for own in ends[j]:
                if best[own[0]] + own[4] > best[j]:
                    best[j], step[j] = best[own[0]] + own[4], own
        out, j = [], len(words)
        while j > 0:
            if step[j] is None:
                j -= 1
            else:
                i, span, kind, p, _ = step[j]
                out.append(((kind, *span), p))
                j = i
        return out[::-1]

    def train(self, texts: list[str]) -> SemiMarkov:
        weights = defaultdict(float)
        self.weights = weights
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            for text in texts:
                text, gold = lesson(text, random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) + epoch))
                for words in islands(text):
                    change = defaultdict(float)
                    for span, kind, p, names, *_ in self.posteriors(text, words):
                        delta = ((span, kind) in gold) - p
                        if abs(delta) > 1e-4:
                            for name in names:
                                change[name, kind] += delta
                    for key, delta in change.items():
                        weights[key] += rate * (delta - DECAY * weights[key])
        self.weights = dict(weights)
        return self

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and those with what the model adds, by start."""
        base = base_spans(text)
        added: list[Span] = []
        for words in islands(text):
            taken = [s for s in base if s[1] < words[-1][1] and s[2] > words[0][0]]
            if len(words) == sum(any(b <= w[0] and w[1] <= e or w[0] <= b < w[1] for _, b, e in taken) for w in words):
                continue  # base spans hold every word
            for (kind, begin, end), p in self.decode(text, words):
                if p >= POSTERIOR and not any(begin < e and b < end for _, b, e in taken):
                    added.append((kind, begin, end))
        return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> SemiMarkov:
    """Trains on the texts of at most `sample_docs` documents that hold a digit or an at sign.

    The sample is the distinct texts of least hash, from all rows; texts over 20,000
    characters don't serve as examples.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= 20_000))
    found = common.sampled(rows.withColumn("label", F.lit("")), sample_docs)
    return SemiMarkov().train([text for *_, text in found])


def find(docs: DataFrame, model: SemiMarkov, column: str = "found") -> DataFrame:
    """`docs` with one more column (base, spans): arrays of (kind, begin, end) by kind, then begin.

    Where `docs` has a column of that name already, the new one has underscores before it.
    """
    while column.lower() in (c.lower() for c in docs.columns):
        column = "_" + column
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    item = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])
    shape = "array<struct<kind:string,begin:bigint,end:bigint>>"

    @F.arrow_udf(f"struct<base:{shape},spans:{shape}>")
    def locate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = SemiMarkov(shared.value)
        as_rows = lambda spans: [{"kind": k, "begin": b, "end": e} for k, b, e in spans]

        def rows(some: list[str | None]) -> pa.Array:
            both = [crf.spans(text or "") for text in some]
            return pa.StructArray.from_arrays([pa.array([as_rows(x[i]) for x in both], pa.list_(item)) for i in (0, 1)], ["base", "spans"])

        yield from (common.by_slices(column, rows) for column in texts)

    return docs.withColumn(column, locate(F.col("text").cast("string")))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, replaced by its first kind's name."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """`docs` with all spans in `text` masked; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("string")
    def mask(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = SemiMarkov(shared.value)
        for column in texts:
            yield common.by_slices(column, lambda some: pa.array([text if not text else masked(text, crf.spans(text)[1]) for text in some], pa.string()))

    return docs.withColumn("text", mask(F.col("text").cast("string")))
