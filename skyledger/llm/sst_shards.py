"""Token ids in sorted-string-table shards, looked up by document id.

A shard holds documents in ascending key order in prefix-compressed blocks, then a sparse index
with one entry a block, a Bloom filter over the keys and a footer, so a lookup reads the footer,
rules the shard out or bisects the index, and unpacks one block.

Layout of a shard (integers little-endian):

    b"SKT1"
    block*   zstd of entries: varint shared, varint unshared, varint value length, key rest, value
    index    zstd of the entries of one block whose keys are each block's first key and whose
             values are (offset u64, bytes u32, crc32 u32)
    bloom    bit array
    footer   JSON, then its length (u32) and b"1TKS"

A key is one byte 0 for a null id, or byte 1 and the id as big-endian with its sign bit flipped.
A value is the ids as unsigned 16-bit numbers where the vocabulary allows it, else 32-bit ones.

Defined results: a null or empty text has just its end id; equal ids stay separate entries in the
order of their texts; an empty table gives no shard and no row; other columns are left alone.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import common, wordcache

MAGIC, END = b"SKT1", b"1TKS"
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 32 * 1024 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


class _Block:
    """Entries in key order; each key drops what it shares with the one before."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size, self.first, self.last = 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.parts:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.last = key

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(b"".join(self.parts))


def _entries(packed: bytes) -> Iterator[tuple[bytes, bytes]]:
    data, at, key = zstandard.ZstdDecompressor().decompress(packed), 0, b""
    while at < len(data):
        shared, at = _read_varint(data, at)
        rest, at = _read_varint(data, at)
        size, at = _read_varint(data, at)
        key = key[:shared] + data[at : at + rest]
        yield key, data[at + rest : at + rest + size]
        at += rest + size


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    one, two = h & (1 << 64) - 1, h >> 64 | 1
    return [(one + i * two) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, filesystem: pafs.FileSystem, path: str, width: int):
        self.filesystem, self.path, self.width = filesystem, path, width
        self.temporary = f"{path}.{uuid.uuid4().hex}"
        self.out = filesystem.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.offset, self.block, self.index = len(MAGIC), _Block(), _Block()
        self.keys: list[bytes] = []
        self.n_tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.block.size >= BLOCK_BYTES:
            self._flush()
        self.block.add(key, ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(key)
        self.n_tokens += len(ids)

    def _flush(self) -> None:
        if self.block.parts:
            data = self.block.packed()
            place = self.offset.to_bytes(8, "little") + len(data).to_bytes(4, "little") + zlib.crc32(data).to_bytes(4, "little")
            self.index.add(self.block.first, place)
            self.out.write(data)
            self.offset += len(data)
            self.block = _Block()

    def close(self) -> dict:
        """Ends the file and gives it its name; a repeated attempt replaces it by equal content."""
        self._flush()
        index, bits = self.index.packed(), max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for place in _bloom_places(key, bits):
                bloom[place >> 3] |= 1 << (place & 7)
        footer = {
            "index": [self.offset, len(index)], "bloom": [self.offset + len(index), len(bloom), bits], "width": self.width,
            "n_docs": len(self.keys), "n_tokens": self.n_tokens, "first": self.keys[0].hex(), "last": self.keys[-1].hex(),
        }
        text = json.dumps(footer).encode()
        self.out.write(index + bytes(bloom) + text + len(text).to_bytes(4, "little") + END)
        self.out.close()
        self.filesystem.move(self.temporary, self.path)
        return footer


class ShardReader:
    def __init__(self, uri: str):
        filesystem, path = pafs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        tail = self._at(max(0, size - 4096), min(4096, size))
        if tail[-4:] != END:
            raise ValueError(f"{uri} is no shard")
        n = int.from_bytes(tail[-8:-4], "little")
        self.footer = json.loads(tail[-8 - n : -8])

    def __enter__(self) -> ShardReader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def places(self) -> list[tuple[bytes, int, int, int]]:
        read = lambda b: (int.from_bytes(b[:8], "little"), int.from_bytes(b[8:12], "little"), int.from_bytes(b[12:], "little"))
        return [(key, *read(value)) for key, value in _entries(self._at(*self.footer["index"]))]

    def block(self, offset: int, size: int, crc: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._at(offset, size)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        for key, value in _entries(data):
            yield key, np.frombuffer(value, f"<u{self.footer['width']}").astype("<u4")

    def documents(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, offset, size, crc in self.places():
            yield from self.block(offset, size, crc)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that id in this shard."""
        key, (at, _, bits) = key_of(doc_id), self.footer["bloom"]
        if any(not self._at(at + (p >> 3), 1)[0] >> (p & 7) & 1 for p in _bloom_places(key, bits)):
            return []
        places, found = self.places(), []
        first = bisect_right([p[0] for p in places], key) - 1
        while first > 0 and places[first][0] == key:  # equal keys may begin in the block before
            first -= 1
        for k in range(max(0, first), len(places)):
            if places[k][0] > key:
                break
            found += [ids for other, ids in self.block(*places[k][1:]) if other == key]
        return found


MANIFEST = "part long, shard long, path string, n_docs long, n_tokens long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes `docs(doc_id, text)` in ascending doc_id order into shards in `folder`; the manifest.

    Documents are dealt by ranges of (doc_id, hash of text), so every task encodes and writes a
    run of neighbouring keys, a shard at a time, and no id's copies need to fit one task.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        part, writer, done, held = TaskContext.get().partitionId(), None, [], 0
        encoder = wordcache.encoder(tokenizer)
        width = 2 if max(end_id, encoder.tokenizer.get_vocab_size(True)) < 1 << 16 else 4

        def close() -> None:
            footer = writer.close()
            done.append((part, len(done), f"{folder}/{writer.path.rpartition('/')[2]}", footer["n_docs"], footer["n_tokens"]))

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for begin, end in wordcache.slices(texts):
                ids, bounds = encoder.encode(texts[begin:end])
                for k in range(begin, end):
                    own = ids[bounds[k - begin] : bounds[k - begin + 1]]
                    if writer is None:
                        writer, held = ShardWriter(filesystem, f"{root}/part-{part:06d}-{len(done):04d}.sst", width), 0
                    writer.add(key_of(doc_ids[k]), np.append(own, np.uint32(end_id)))
                    held += (len(own) + 1) * width
                    if held >= shard_bytes:
                        close()
                        writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            ["part", "shard", "path", "n_docs", "n_tokens"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mix", F.xxhash64("text"))
    dealt = rows.repartitionByRange(common.partitions(spark), "doc_id", "mix").sortWithinPartitions("doc_id", "mix", "text")
    return common.keep(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, read block by block: doc_id, start, n_tokens, ids.

    `start` counts the ids of all documents before; a running sum over the manifest (a row a
    shard) gives each shard's first.
    """
    spark = manifest.sparkSession
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                at, rows, size = base, [], 0
                with ShardReader(path) as reader:
                    for key, ids in reader.documents():
                        rows.append((id_of(key), at, len(ids), ids.tobytes()))
                        at, size = at + len(ids), size + 4 * len(ids)
                        if size > 8_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return based.select("path", "base").repartition(common.partitions(spark)).mapInArrow(read, TOKENS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids"])
