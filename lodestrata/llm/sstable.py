"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer.

Shard layout (little-endian)::

    data blocks | index | Bloom filter | footer
    block   zstd of entries: shared u8, unshared u8, n_ids u32, key suffix, ids (u16 or u32)
    index   per block: key length u8, last key, offset u64, size u32, crc32 u32
    Bloom   bits, 10 a key, 7 probes by double hashing
    footer  index offset u64, index size u64, Bloom size u64, documents u64, ids u64, id width u32, magic 8

Keys are the identifier as 8 big-endian bytes with the sign bit flipped, so byte order is number order; a null
identifier is the empty key and sorts first. Equal keys may repeat (ordered by text hash, then text).
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import file_system, stored, task_name, tidy, work_dir
from lodestrata.llm.encode import CachedEncoder

MAGIC = b"LSTRSST1"
FOOTER = struct.Struct("<QQQQQI8s")
ENTRY = struct.Struct("<BBI")
BLOCK = struct.Struct("<QII")
BLOCK_BYTES = 1 << 16
#: A task starts another shard beyond this.
SHARD_BYTES = 64 << 20
PROBES, BITS_A_KEY = 7, 10
#: Partitions that shards are read back in, at most.
MOST_TASKS = 100_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard; add() takes keys in ascending order. The file gets its name only when complete."""

    def __init__(self, uri: str, wide: bool = False):
        self.uri, self.dtype = uri, np.dtype("<u4" if wide else "<u2")
        self.fs, self.path = file_system(uri)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.at = self.docs = self.ids = 0
        self.block, self.index, self.keys, self.last, self.size = [], [], [], b"", 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(self.dtype).tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.keys.append(key)
        self.last, self.docs, self.ids = key, self.docs + 1, self.ids + len(ids)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append(bytes([len(self.last)]) + self.last + BLOCK.pack(self.at, len(data), zlib.crc32(data)))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> dict:
        self._flush()
        bits = max(64, -(-len(self.keys) * BITS_A_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for k in set(self.keys):
            bloom[_probes(k, bits)] = True
        index, packed = b"".join(self.index), np.packbits(bloom).tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), len(packed), self.docs, self.ids, self.dtype.itemsize, MAGIC))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return {"path": self.uri, "docs": self.docs, "ids": self.ids, "bytes": self.at + len(index) + len(packed) + FOOTER.size}


class ShardReader:
    """Point lookup by binary search in the sparse index, or a scan block by block."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        at, size, bloom, self.docs, self.ids, width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.dtype = np.dtype(f"<u{width}")
        self.file.seek(at)
        raw = self.file.read(size)
        self.bloom = np.unpackbits(np.frombuffer(self.file.read(bloom), np.uint8))
        self.lasts, self.blocks, i = [], [], 0
        while i < len(raw):
            n = raw[i]
            self.lasts.append(raw[i + 1 : i + 1 + n])
            self.blocks.append(BLOCK.unpack_from(raw, i + 1 + n))
            i += 1 + n + BLOCK.size

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, size, crc = self.blocks[block]
        self.file.seek(at)
        data = self.file.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {block} is damaged")
        raw, i, key = zstandard.ZstdDecompressor().decompress(data), 0, b""
        while i < len(raw):
            shared, own, n = ENTRY.unpack_from(raw, i)
            i += ENTRY.size
            key = key[:shared] + raw[i : i + own]
            i += own
            yield key, np.frombuffer(raw, self.dtype, n, i)
            i += n * self.dtype.itemsize

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(len(self.blocks)):
            for key, ids in self._entries(b):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier; none if there is no such document."""
        key, found = key_of(doc_id), []
        if not self.bloom[_probes(key, len(self.bloom))].all():
            return found
        for b in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            for k, ids in self._entries(b):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", end_id: int = 1) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shards in ascending doc_id order; returns the manifest.

    Rows are dealt by range of (doc_id, text hash), so even one identifier that a third of the rows share is
    spread. Every attempt of a task writes files of its own, and only the successful attempt's are in the
    manifest (part, seq, path, docs, ids, bytes). A null text is empty: the end id alone. No documents: an
    empty manifest.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, writer, rows, seq, name = CachedEncoder(tokenizer, kind), None, [], 0, task_name()
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        wide = encode.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        for part in parts:
            ids, texts = part["doc_id"].tolist(), part["text"].tolist()
            for at in range(0, len(texts), 256):
                for doc_id, raw in zip(ids[at : at + 256], encode(texts[at : at + 256]), strict=True):
                    if writer is None:
                        writer = ShardWriter(f"{folder}/{name}-{seq:05d}.sst", wide)
                    writer.add(key_of(None if pd.isna(doc_id) else int(doc_id)), np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
                    if writer.at >= SHARD_BYTES:
                        rows.append(writer.close() | {"part": int(name.split("-")[0]), "seq": seq})
                        writer, seq = None, seq + 1
        if writer is not None:
            rows.append(writer.close() | {"part": int(name.split("-")[0]), "seq": seq})
        if rows:
            yield pd.DataFrame(rows)[["part", "seq", "path", "docs", "ids", "bytes"]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "text")
    return dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, "part int, seq int, path string, docs long, ids long, bytes long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Reads all shards of a manifest back: doc_id, start (ids before), n_tokens, ids_crc32, path, shard_bytes.

    The only ordered pass over everything is over the manifest, a row for each shard of up to 64 MB. Each
    shard is a task of its own (up to MOST_TASKS): the manifest itself is too small to tell how much there is to read.
    """
    tasks = min(max(1, manifest.count()), MOST_TASKS)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start in zip(part["path"], part["start"], strict=True):
                rows = []
                for doc_id, ids in ShardReader(path).scan():
                    rows.append((None if doc_id is None else str(doc_id), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    out = placed.repartition(tasks, "path").mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1) -> DataFrame:
    """Writes docs as shards in the shared work folder and reads the files back; see read_shards."""
    folder = work_dir(spark, "sstable")
    return tidy(read_shards(stored(write_shards(docs, folder + "/shards", tokenizer, kind, end_id), folder + "/manifest")), folder, keep=("shards",))
