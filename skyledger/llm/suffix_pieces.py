"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct chunks of a batch that a worker hasn't met yet are put one after another and indexed by a
suffix array (ordered as far as the longest piece reaches). Every piece of the model is looked up by
binary search, which gives the range of its occurrences; the occurrences are edges of a lattice,
sorted by position and relaxed from left to right, all chunks at once.

For a byte-pair model a path is right if and only if each two pieces that follow one another are what
merging makes of their joined text; so an edge is relaxed onto a position only if it follows the piece
there in that way, and each position has one piece that ends there. Merging only ever runs on two
pieces' text, once for each pair met. Characters that no piece holds become bytes.

A chunk is a run of spaces with what follows up to the next space; no piece of such a model has a
space after another character, and none crosses a character that it can't hold.

Defined results: a null or empty text has no ids and decodes to an empty text; equal rows have equal
results; an empty table gives no row; other columns are left alone. A model that merges
otherwise or normalises its input is refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from skyledger.llm import common

SPACE = "▁"
#: Characters of text that are split at a time, and of new chunks in one index.
SLICE_CHARS, INDEX_CHARS = 500_000, 150_000
#: What a worker remembers: some 50 MB of chunks, 10 MB of ids and 10 MB of pairs; then it begins anew.
KEPT_CHUNKS, KEPT_IDS, KEPT_PAIRS = 250_000, 2_500_000, 1_000_000
_OTHER = 0xFFFF
#: Texts by which a model is told that this encoder doesn't serve: other merging, or a normaliser.
_PROBES = ["The quick brown fox  jumps", "ﬁne Ａ½ é e\u0301", " a\tb\nc ", "unbelievably internationalisation"]

_codecs: dict[str, PieceCodec] = {}


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.dummy = model.encode("a", out_type=str)[:1] != ["a"]
        self.bytes_of, self.byte_ids = [], {}
        self.pieces: list[str] = []
        ids = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                ids.append(i)
                self.pieces.append(piece)
        self.ids = np.array(ids, np.uint32)
        self.rank = {piece: -model.get_score(int(i)) for piece, i in zip(self.pieces, ids)}.get
        if any(SPACE in piece.lstrip(SPACE) for piece in self.pieces):
            raise ValueError("a piece has a space after another character")
        letters = sorted({c for piece in self.pieces for c in piece})
        self.table = np.full(0x110000, _OTHER, np.uint16)
        self.table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.longest = max(map(len, self.pieces))
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)
        keys = np.zeros((len(self.pieces), self.longest), ">u2")
        for k, piece in enumerate(self.pieces):
            keys[k, : len(piece)] = self.table[[ord(c) for c in piece]]
        ends = np.where(keys == 0, _OTHER, keys).astype(">u2")
        self.keys, self.ends = (np.ascontiguousarray(x).view(f"S{2 * self.longest}").ravel() for x in (keys, ends))
        #: Characters that end a chunk on both sides, as no piece holds them.
        breaks = "".join(c for c in "\n\t\r" if self.table[ord(c)] == _OTHER)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+|[{breaks}]" if breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._forget_pairs()
        self._empty()
        if any(own.tolist() != model.encode(text) for text, own in zip(_PROBES, self.encode(_PROBES))):
            raise ValueError(f"{path} is no byte-pair model of plain text")

    def _forget_pairs(self) -> None:
        #: Pairs of pieces met so far, ascending, and whether they may follow one another.
        self.pairs, self.fine = np.zeros(0, np.int64), np.zeros(0, bool)

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.found = array("q", [0]), array("I")

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best pair first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            costs = [rank(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            least = min(costs)
            if least == np.inf:
                break
            k = costs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before; -1 there is the start, -2 a character as bytes."""
        codes, inverse = np.unique((before.astype(np.int64) + 2) * len(self.pieces) + piece, return_inverse=True)
        at = np.searchsorted(self.pairs, codes)
        known = np.append(self.pairs, -1)[at] == codes
        new = codes[~known]
        if len(new):
            fine = []
            for code in new.tolist():
                a, b = divmod(code, len(self.pieces))
                two = [self.pieces[b]] if a < 2 else [self.pieces[a - 2], self.pieces[b]]
                fine.append(self.merged("".join(two)) == two)
            self.pairs, self.fine = np.insert(self.pairs, at[~known], new), np.insert(self.fine, at[~known], fine)
            at = np.searchsorted(self.pairs, codes)
        return self.fine[at][inverse]

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces as (begin, piece), by a suffix array of the codes."""
        padded = np.concatenate([codes, np.zeros(self.longest, np.uint16)]).astype(">u2")
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(codes)]).view(self.keys.dtype).ravel()
        suffixes = np.argsort(windows, kind="stable").astype(np.int32)
        ordered = windows[suffixes]
        low, high = np.searchsorted(ordered, self.keys, "left"), np.searchsorted(ordered, self.ends, "right")
        counts = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        at = np.arange(len(piece), dtype=np.int32) + np.repeat((low - np.cumsum(counts) + counts).astype(np.int32), counts)
        return suffixes[at], piece

    def _index(self, chunks: list[str]) -> None:
        """Encodes new chunks and keeps their ids."""
        if len(self.pairs) > KEPT_PAIRS:
            self._forget_pairs()
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(c) for c in chunks])
        # A character that no piece holds stands between chunks, so no edge crosses.
        first = (np.cumsum(sizes + 1) - (sizes + 1)).astype(np.int32)
        at = np.arange(len(points)) + np.repeat(np.arange(len(chunks)), sizes)
        codes = np.full(len(points) + len(chunks), _OTHER, np.uint16)
        codes[at] = self.table[points]
        begin, piece = self._edges(codes)
        lone = at[codes[at] == _OTHER]
        begin, piece = np.concatenate([begin, lone.astype(np.int32)]), np.concatenate([piece, np.full(len(lone), -2, np.int32)])
        length = np.where(piece < 0, np.int32(1), self.lengths[piece])
        # By the distance of their ends from the chunk's start: all that end k characters in, together.
        origin = np.repeat(first, sizes + 1)
        reach = begin + length - origin[begin]
        order = np.argsort(reach, kind="stable")
        begin, piece, length, reach = begin[order], piece[order], length[order], reach[order]
        last = np.full(len(codes) + 1, -3)  # the piece that ends before a place; -3: none
        last[first] = -1
        back = np.zeros(len(codes) + 1, np.int64)
        bounds = np.searchsorted(reach, np.arange(1, int(sizes.max(initial=0)) + 2))
        for lower, upper in zip(bounds, bounds[1:]):
            b, p, n = begin[lower:upper], piece[lower:upper], length[lower:upper]
            before = last[b]
            good = (before != -3) & (p == -2)
            real = np.flatnonzero((before != -3) & (p >= 0))
            good[real] = self._follows(before[real], p[real])
            b, p, n = b[good], p[good], n[good]
            last[b + n], back[b + n] = p, b
        now, owner, steps = first + sizes, np.arange(len(chunks)), []
        while len(now):
            steps.append((owner, last[now], back[now]))
            now = back[now]
            going = now > first[owner]
            now, owner = now[going], owner[going]
        owner, token, where = (np.concatenate([s[i] for s in steps[::-1]]) for i in range(3))
        order = np.argsort(owner, kind="stable")
        owner, token, where = owner[order], token[order], where[order]
        if (token == -3).any():
            raise ValueError("no path through a chunk")
        ids = np.where(token >= 0, self.ids[np.maximum(token, 0)], 0)
        widths = np.ones(len(token), np.int64)
        spread = {}
        for k in np.flatnonzero(token == -2).tolist():
            o = owner[k]
            char = chunks[o][where[k] - first[o]]
            spread[k] = [self.byte_ids[x] for x in char.encode("utf-8", "surrogatepass")]
            widths[k] = len(spread[k])
        ends = np.cumsum(widths)
        flat = np.repeat(ids, widths)
        for k, own in spread.items():
            flat[ends[k] - len(own) : ends[k]] = own
        stops = np.searchsorted(owner, np.arange(len(chunks)), "right")
        base, n = len(self.found), len(self.place)
        self.found.frombytes(flat.astype(np.uint32).tobytes())
        self.starts.extend((base + ends[stops - 1]).tolist())
        self.place.update(zip(chunks, range(n, n + len(chunks))))

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > KEPT_CHUNKS or len(self.found) > KEPT_IDS:
            self._empty()
        head = SPACE if self.dummy else ""
        split = [self.chunk.findall(head + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = sorted(set().union(*split).difference(self.place))
        begin = size = 0
        for k, chunk in enumerate(new):
            size += len(chunk)
            if size > INDEX_CHARS or k + 1 == len(new):
                self._index(new[begin : k + 1])
                begin, size = k + 1, 0
        counts = [len(own) for own in split]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        starts, found = np.array(self.starts, np.int64), np.array(self.found, np.uint32)
        first, sizes = starts[at], starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return found[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], ends[np.concatenate([[0], np.cumsum(counts)]).astype(int)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, bounds = self._slice([t or "" for t in texts])
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _slices(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, about SLICE_CHARS characters at a time."""
    lengths = np.append(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).cumsum(), 0)
    begin = 0
    while begin < len(column):
        past = lengths[begin - 1] + SLICE_CHARS
        end = max(begin + 1, int(np.searchsorted(lengths[:-1], past, "right")))
        yield column.slice(begin, end - begin).to_pylist()
        begin = end


def _bytes(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())


def encode(text: Column, model: str) -> Column:
    """The ids of each text as little-endian unsigned 32-bit numbers in a binary column."""

    @F.arrow_udf("binary")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model)
        for column in columns:
            yield pa.concat_arrays([pa.array([], pa.binary()), *(_bytes(own.encode(some)) for some in _slices(column))])

    return ids(text.cast("string"))


def coded(docs: DataFrame, model: str) -> DataFrame:
    """`docs` with two more columns, `ids` of `text` and `decoded`, the text that they decode to; in one pass.

    A name that `docs` has already gets underscores before it. Rows go out a slice at a time, so a
    batch's ids and texts are never held together.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("ids", "decoded"):
        while name in taken:
            name = "_" + name
        names.append(name)
    shape = StructType([*docs.schema.fields, StructField(names[0], BinaryType()), StructField(names[1], StringType())])
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            begin = 0
            for some in _slices(batch.column(at)):
                ids = own.encode(some)
                more = [_bytes(ids), pa.array([own.decode(x.tolist()) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(some)).columns, *more], [*columns, *names])
                begin += len(some)

    return docs.mapInArrow(run, shape)


def decode(ids: Column, model: str) -> Column:
    """The text of each binary column of ids; a null is an empty text."""

    @F.arrow_udf("string")
    def text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model)
        rows = lambda some: pa.array([own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in some], pa.string())
        yield from (common.by_slices(column, rows) for column in columns)

    return text(ids)
