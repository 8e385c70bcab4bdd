"""Phrase collocations by language: merged count-min sketches, exact counts of what they leave, scores and subsumption.

1. `sketch`: each task counts all runs of 1 to 3 words of its texts in cells of two rows. What it finds travels as
   sorted cells by segment of the sketch; a segment's parts are added up as they stream by. A cell never counts
   less than any of its n-grams, so an n-gram with a cell below the least count is rare for certain.
2. `survivors`: a second pass over the texts counts exactly, and only, n-grams whose cells all reach the least count.
3. `scored` and `subsumed`: DataFrame joins over the exact counts.

The sketch has at most MOST_CELLS cells a row, of which one bit each goes to the tasks (64 MB for both rows). A corpus
beyond that fills it more, so more rare n-grams are counted exactly and dropped only then: slower, and nothing is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import _AT, _BYTE, _PLACE, _stream, chunks, mix64, parts_for, stored, text_buffer, tidy, work_dir

LONGEST, MIN_COUNT, TOP = 3, 10, 2000
ROWS = 2
#: Cells of a segment, and bounds of a row's cells.
SEGMENT, LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 20, 1 << 28
#: N-grams, by an upper bound from the bytes of text, for a cell of a row. About half of them are there.
LOAD = 8
#: N-grams that a task gathers before it sends their cells or sums them, and different ones that it holds as sums.
HELD, MOST_HELD = 2_000_000, 3_000_000
#: Bytes of text for a task that counts exactly: the larger, the fewer rows for a frequent n-gram.
TASK_TEXT = 128 << 20

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a buffer of texts: start and end byte, 64-bit hash, number of the text, number of the piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _WORD[data]
        cut = np.zeros(len(data), bool)  # a text's first byte
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:]
        last[:-1] &= ~inside[1:] | cut[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.piece = np.cumsum(_BREAK[data] | cut)[self.start]
        lengths = self.end - self.start
        if len(lengths):
            at = np.flatnonzero(inside)
            begin = np.cumsum(lengths) - lengths
            longest = int(lengths.max())
            table = _AT if longest <= len(_AT) else _stream(longest, 7) | np.uint64(1)
            self.hash = mix64(np.add.reduceat(table[np.arange(len(at)) - np.repeat(begin, lengths)] * _BYTE[data[at]], begin))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash (with its text's seed) of every run of n words inside a piece."""
        if len(self.start) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        m = len(self.start) - n + 1
        at = np.flatnonzero(self.piece[:m] == self.piece[n - 1 :])
        total = seeds[self.text[at]] + np.uint64(n)
        for k in range(n):
            total += self.hash[at + k] * _PLACE[k]
        return at, mix64(total)


def _tokenized(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, Words, np.ndarray]]:
    """Languages, bytes, words and language seeds of slices of a batch (text, lang)."""
    for part in chunks(batch):
        data, offsets = text_buffer(part.column(0))
        codes = part.column(1).dictionary_encode()
        names = codes.dictionary.to_pylist()
        seeds = np.array([_hash_of(n) for n in names], np.uint64)
        yield codes, data, Words(data, offsets), seeds[codes.indices.to_numpy()] if names else np.zeros(0, np.uint64)


def _hash_of(name: str) -> np.uint64:
    data = np.frombuffer(name.encode(), np.uint8)
    table = _AT if len(data) <= len(_AT) else _stream(len(data), 7) | np.uint64(1)
    return np.sum(table[: len(data)] * _BYTE[data], dtype=np.uint64) + np.uint64(len(data))


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Cells of n-grams in a row of a sketch; cells is a power of two."""
    h = hashes if row == 0 else mix64(hashes + np.uint64(row))
    return (h >> np.uint64(20)).astype(np.int64) & (cells - 1)


def packed(cells: np.ndarray, most: int = 255) -> bytes:
    """Sorted cells by their distances, a byte each: 0 for a repeated one (each at most `most` times), 255 for a step of 255 with no cell."""
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    place = np.arange(len(cells)) - np.repeat(first, np.diff(np.r_[first, len(cells)]))
    cells = cells[place < most]
    step = np.diff(cells, prepend=0)
    wide = step // 255
    out = np.full(len(cells) + int(wide.sum()), 255, np.uint8)
    out[np.cumsum(wide + 1) - 1] = step - 255 * wide
    return out.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of packed()."""
    steps = np.frombuffer(data, np.uint8)
    return np.unique(np.cumsum(steps, dtype=np.int64)[steps < 255], return_counts=True)


class Sketch:
    """Which cells of a merged count-min sketch reach the least count, by row."""

    def __init__(self, cells: int, bits: list[np.ndarray]):
        self.cells, self.bits = cells, bits

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        """Whether n-grams may occur that often; never False for one that does."""
        stay = np.arange(len(hashes))
        for row, bits in enumerate(self.bits):
            at = cells_of(hashes[stay], row, self.cells)
            stay = stay[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
        out = np.zeros(len(hashes), bool)
        out[stay] = True
        return out


def sketch(docs: DataFrame, folder: str, longest: int = LONGEST, min_count: int = MIN_COUNT, load: int = LOAD, most: int = MOST_CELLS) -> Sketch:
    """The merged sketch of all runs of 1 to `longest` words of docs (text, lang)."""
    if not 0 < min_count <= 255:
        raise ValueError("a cell tells counts up to 255 apart")
    spark = docs.sparkSession
    # A word and what sets it apart take about six bytes in prose: four are a safe bound of the sketch's use, on which no result depends.
    bound = longest * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    cells = max(LEAST_CELLS, min(most, 1 << max(0, bound // load - 1).bit_length()))
    segment = min(SEGMENT, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate(held)
            for row in range(ROWS):
                at = np.sort(cells_of(hashes, row, cells))
                edges = np.searchsorted(at, np.arange(0, cells + segment, segment))
                full = np.flatnonzero(np.diff(edges))
                data = [packed(at[edges[s] : edges[s + 1]] - s * segment, min_count) for s in full]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), row, np.int32)), pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], ["row", "segment", "cells"])

        held, size = [], 0
        for batch in batches:
            for _, _, words, seeds in _tokenized(batch):
                for n in range(1, longest + 1):
                    held.append(words.grams(n, seeds)[1])
                    size += len(held[-1])
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(segment, np.int32)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(total >= min_count).tobytes()], pa.binary())], ["row", "segment", "bits"])

        for batch in batches:
            for row, s, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (row, s):
                    if key is not None:
                        yield done()
                    key = (row, s)
                    total[:] = 0
                at, n = unpacked(data)
                total[at] = np.minimum(total[at] + n, 1 << 20)
        if key is not None:
            yield done()

    parts = parts_for(spark, ROWS * (cells // segment), 8)
    dealt = stored(docs.mapInArrow(count, "row int, segment int, cells binary"), folder + "/cells")
    dealt = dealt.repartition(parts, "row", "segment").sortWithinPartitions("row", "segment")
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(ROWS)]
    for r in dealt.mapInArrow(merge, "row int, segment int, bits binary").toLocalIterator():
        bits[r["row"]][r["segment"] * (segment // 8) : (r["segment"] + 1) * (segment // 8)] = np.frombuffer(r["bits"], np.uint8)
    return Sketch(cells, bits)


class _Part:
    """A slice of texts whose n-grams wait to be summed."""

    def __init__(self, low: bytes, words: Words, names: list[str], language: np.ndarray):
        self.low, self.start, self.end, self.names = low, words.start.astype(np.int32), words.end.astype(np.int32), names
        self.of = language[words.text].astype(np.int32)
        self.words = Counter({names[c]: int(k) for c, k in zip(*np.unique(self.of, return_counts=True), strict=True)})


class _Counts:
    """Counts of n-grams in a task: a phrase is written out once, when its hash is met first, into one run of bytes."""

    def __init__(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted; place of each in the columns below
        self.f, self.lang, self.n, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.text: list[bytes] = []
        self.names: dict[str, int] = {}
        self.words: Counter = Counter()
        self.parts: list[_Part] = []
        self.held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, part: _Part, n: int, at: np.ndarray, h: np.ndarray) -> None:
        if not self.parts or self.parts[-1] is not part:
            self.parts.append(part)
            self.words.update(part.words)
        self.held.append((len(self.parts) - 1, n, at.astype(np.int32), h))
        self.waiting += len(h)

    def sum(self) -> None:
        """Adds what waits to the counts."""
        if not self.held:
            return
        ends = np.cumsum([len(x[3]) for x in self.held])
        h, first, count = np.unique(np.concatenate([x[3] for x in self.held]), return_index=True, return_counts=True)
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        self.f[self.place[at[known]]] += count[known]
        new = np.flatnonzero(~known)
        new = new[np.argsort(first[new])]  # in the order of the texts
        source = np.searchsorted(ends, first[new], side="right")
        lang, size, phrases = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32), []
        for k in np.unique(source):
            p, n, places, _ = self.held[k]
            part, mine = self.parts[p], np.flatnonzero(source == k)
            w = places[first[new[mine]] - (ends[k - 1] if k else 0)]
            codes = np.array([self.names.setdefault(x, len(self.names)) for x in part.names], np.int32)
            lang[mine], size[mine] = codes[part.of[w]], n
            begin, end, low = [part.start[w + j].tolist() for j in range(n)], [part.end[w + j].tolist() for j in range(n)], part.low
            if n == 1:
                phrases += [low[a:b] for a, b in zip(begin[0], end[0], strict=True)]
            else:
                phrases += [b" ".join([low[a:b] for a, b in zip(x, y, strict=True)]) for x, y in zip(zip(*begin, strict=True), zip(*end, strict=True), strict=True)]
        where = np.arange(len(self.f), len(self.f) + len(new), dtype=np.int32)
        self.f, self.lang, self.n = np.r_[self.f, count[new]], np.r_[self.lang, lang], np.r_[self.n, size]
        self.length = np.r_[self.length, np.fromiter(map(len, phrases), np.int32, len(phrases))]
        self.text.append(b"".join(phrases))
        by = np.argsort(h[new])
        self.place = np.insert(self.place, at[new[by]], where[by])
        self.hashes = np.insert(self.hashes, at[new[by]], h[new[by]])
        self.parts, self.held, self.waiting = [], [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.sum()
        names = ["lang", "words", "phrase", "f"]
        yield pa.RecordBatch.from_arrays([pa.array(list(self.words), pa.string()), pa.array([0] * len(self.words), pa.int32()), pa.array([""] * len(self.words), pa.string()), pa.array(list(self.words.values()), pa.int64())], names)
        text, ends = b"".join(self.text), np.r_[0, np.cumsum(self.length, dtype=np.int64)]
        languages = pa.array(list(self.names), pa.string())
        for i in range(0, len(self.f), 50_000):
            part = slice(i, min(i + 50_000, len(self.f)))
            at = ends[i : part.stop + 1]
            phrase = pa.StringArray.from_buffers(part.stop - i, pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(text[at[0] : at[-1]]))
            yield pa.RecordBatch.from_arrays([languages.take(pa.array(self.lang[part])), pa.array(self.n[part]), phrase, pa.array(self.f[part])], names)


def survivors(docs: DataFrame, found: Sketch, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, words (n; 0 for the row that counts all words of a language), phrase and exact count f of all n-grams with f >= min_count."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, found = shared.value, _Counts()
        for batch in batches:
            for codes, data, words, seeds in _tokenized(batch):
                names, language = codes.dictionary.to_pylist(), codes.indices.to_numpy()
                part = _Part(_LOWER[data].tobytes(), words, names, language)
                for n in range(1, longest + 1):
                    at, h = words.grams(n, seeds)
                    stay = sketch.frequent(h)
                    found.add(part, n, at[stay], h[stay])
                if found.waiting >= HELD:
                    found.sum()
                if len(found.f) >= MOST_HELD:
                    yield from found.batches()
                    found = _Counts()
        yield from found.batches()

    bytes_of_text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-bytes_of_text // TASK_TEXT)))
    rows = docs.mapInArrow(run, "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("words") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (2 words or more) of survivors() with l, r and score of their lowest cut: lang, words, phrase, a, l, r, score.

    Both parts of a candidate occur at least as often as it does, so they are among the survivors. All products
    are decimals of up to 38 digits: exact up to 10**15 occurrences.
    """
    grams = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f")
    parts = F.split("phrase", " ")
    cuts = counts.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    cuts = cuts.join(grams.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(grams.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # Integral division of decimals; a column method for it doesn't exist.
    cuts = cuts.withColumn("score", F.expr("(1000000BD * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    return cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def subsumed(candidates: DataFrame, percent: int = 50, longest: int = LONGEST) -> DataFrame:
    """candidates without those inside a longer one that occurs at least percent / 100 times as often."""
    parts = F.split("phrase", " ")
    inner = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), "words", parts.alias("w"))
    inner = inner.select("lang", "longer", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    inner = inner.select("lang", "longer", "w", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def top_of(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first rows, with rank: parts of a language are cut first, so that none is sorted whole in one task."""
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*by))).where(F.col("rank") <= top).drop("__salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)


def mine(spark: SparkSession, docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, percent: int = 50, top: int = TOP) -> DataFrame:
    """The best phrases of each language of docs (text, lang): lang, rank, phrase, a, l, r, n, score.

    A null text has no words; a null lang is `und`, as if it were written so. Repeated rows count each. Ties in score
    and count go by the phrase's bytes. Other columns are ignored, a long text is one piece of work of its own,
    no documents give no rows.
    """
    folder = work_dir(spark, "phrases")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    counts = stored(survivors(texts, sketch(texts, folder, longest, min_count), longest, min_count), folder + "/counts")
    found = stored(scored(counts), folder + "/scored")
    best = top_of(subsumed(found, percent, longest), top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return tidy(best.join(F.broadcast(total) if total.count() < 100_000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), folder)
