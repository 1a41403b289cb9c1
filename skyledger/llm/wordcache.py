"""Encoding of whole texts with a `tokenizers` file, by the distinct chunks between white space.

The vocabulary's own pre-tokeniser never lets a token cross white space, so the ids of a text are
the ids of its chunks, one after another. Arrow splits a batch and numbers its distinct chunks; each
Python worker keeps the ids of chunks it has met, up to a bound, and hands only new ones to the
library. Words are handed over many at once: each ends with a token that carries the end-of-word
mark, which tells them apart again; if the marks don't add up, chunks are encoded one by one.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks and ids a worker keeps; beyond them the memory is emptied and filled anew.
KEPT_CHUNKS, KEPT_IDS = 150_000, 1_200_000
#: Characters of text that are split at a time, and words in one call.
SLICE_CHARS, JOINED_WORDS = 2_000_000, 256
MARKS = ".,;:!?"
#: Letters whose lower case is one letter that NFC leaves alone.
LATIN, LATIN_LOWER = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", "^[a-zß-öø-ÿ]+$"

_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model without the steps that leave a lower-case ASCII word as it is.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(True)
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if suffix and word.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.starts, self.ids = array("q", [0, 0]), array("I")

    def _words(self, tokenizer, words: list[str]) -> None:
        """Stores the ids of words that are one pre-token each."""
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        for group, encoded in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, np.uint32)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(group) or not stops or stops[-1] != len(ids):
                self._odd(group)
                continue
            base = len(self.ids)
            first = len(self.starts) - 1
            self.ids.frombytes(ids.tobytes())
            self.starts.extend(base + stop for stop in stops)
            self.place.update(zip(group, range(first, first + len(group))))

    def _odd(self, chunks: list[str]) -> None:
        for chunk, encoded in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)):
            self.place[chunk] = len(self.starts) - 1
            self.ids.extend(encoded.ids)
            self.starts.append(len(self.ids))

    def _learn(self, stems: np.ndarray) -> None:
        new = pa.array([s for s in stems if s not in self.place], pa.large_string())
        simple, plain = _simple(new), pc.string_is_ascii(new)
        self._odd(_strings(new.filter(pc.invert(simple))).tolist())
        self._words(self.plain, _strings(new.filter(pc.and_(simple, plain))).tolist())
        self._words(self.tokenizer, _strings(new.filter(pc.and_not(simple, plain))).tolist())

    def _gather(self, starts: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = starts[at]
        sizes = starts[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row as uint32, and the place where each text begins and ends."""
        if len(self.place) > KEPT_CHUNKS or len(self.ids) > KEPT_IDS:
            self._empty()
        split = pc.ascii_split_whitespace(pa.array([text or "" for text in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        # A chunk is a word with at most one mark after it, or is taken as it is.
        trimmed = pc.utf8_rtrim(chunks, MARKS)
        marked = pc.equal(pc.subtract(pc.binary_length(chunks), pc.binary_length(trimmed)), 1)
        words = pc.if_else(marked, trimmed, chunks)
        words = pc.if_else(pc.match_substring_regex(words, LATIN), pc.utf8_lower(words), words)
        simple = _simple(words)
        stems = pc.if_else(simple, words, chunks).dictionary_encode()
        marks = pc.if_else(pc.and_(simple, marked), pc.utf8_slice_codeunits(chunks, -1), "").dictionary_encode()
        parts = []
        for kind in (stems, marks):
            own = _strings(kind.dictionary)
            self._learn(own)
            parts.append(np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))[kind.indices.to_numpy()])
        starts, ids = np.array(self.starts, np.int64), np.array(self.ids, np.uint32)
        own_ids, own_ends = self._gather(starts, ids, np.stack(parts, 1).ravel())
        out, ends = self._gather(own_ends[::2], own_ids, coded.indices.to_numpy())
        return out, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def _simple(words: pa.Array) -> pa.Array:
    """Of each word whether it is letters that lower-casing and NFC leave alone: one pre-token."""
    return pc.match_substring_regex(words, LATIN_LOWER)


def _strings(words: pa.Array) -> np.ndarray:
    return words.to_numpy(zero_copy_only=False)


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def slices(texts: list[str | None]):
    """Places that cut a list of texts into runs of about SLICE_CHARS characters."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
