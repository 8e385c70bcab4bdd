"""Shared helpers: work folders, Arrow text buffers and vectorised word hashing."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the numpy helpers. A longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="lodestrata-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run, below spark.checkpoint.dir.

    The setting names storage that all executors and the driver share; on a cluster it must be set. Only a
    session that is one process (local tests) may do without: its folder goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds uri, and the path in it."""
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+://", uri) else "file://" + uri)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it again: the lineage ends at shared files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a work folder through Hadoop, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(out: DataFrame, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """out, after the tables below folder that it doesn't read are deleted; those named in keep stay."""
    spark = out.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
        read = {urlsplit(f).path for f in out.inputFiles()}
        used = {unquote(f)[len(base) :].split("/")[0] for f in read if unquote(f).startswith(base)}
        for s in fs.listStatus(root):
            if s.getPath().getName() not in used | set(keep):
                fs.delete(s.getPath(), True)
    return out


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns in "__" renamed, so that helper columns can't clash with them, and the names to give back."""
    names = {c: f"{uuid.uuid4().hex}_{k}" for k, c in enumerate(df.columns) if c.startswith("__")}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def lower_ascii(column):
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, ASCII_UPPER, ASCII_LOWER))


def text_buffer(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; a null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    wide = pa.types.is_large_string(values.type)
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = values.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, at least one row."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_buffer(column)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int, start: int = 0) -> np.ndarray:
    return mix64((np.arange(start, start + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _stream(256, 11)
for _b in range(65, 91):
    _BYTE[_b] = _BYTE[_b + 32]
_AT = _stream(1 << 12, 7) | np.uint64(1)
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Multipliers of the places in an n-gram.
_PLACE = _stream(16, 23) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased, and where each text's words start.

    A multilinear hash over the bytes of a word: two different words share one with a chance of about 2**-63.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(data)]
    first[heads] = inside[heads]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    begin = first[at]
    starts = np.flatnonzero(begin)
    lengths = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    table = _AT if longest <= len(_AT) else _stream(longest, 7) | np.uint64(1)
    hashed = mix64(np.add.reduceat(table[place] * _BYTE[data[at]], starts))
    return hashed, np.searchsorted(at[starts], offsets).astype(np.int64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (n at most 16)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACE[k]
    return mix64(total)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles of one text; fewer words make one shingle of all."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return mix64(np.array([np.sum(words * _PLACE[: len(words)], dtype=np.uint64) + np.uint64(len(words))], np.uint64))
    return np.unique(ngram_hashes(words, n))


def task_name() -> str:
    """A file name part that no other attempt of this or another task has; sorts by partition."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex[:8]}"


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions for `size` bytes, or rows, of `each` a task; at least one round of the session's cores, as far as there is work."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, min(size, least), -(-size // each))
