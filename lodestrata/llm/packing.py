"""Packing by a configuration linear program over the length histogram.

The program has a variable for each pattern (lengths that fit one sequence together) and a constraint for each
length. Multiplicative weights solve it: weights on the lengths, a knapsack over the capacity prices patterns,
and weights of lengths that a pattern serves fall. The fractional patterns are rounded to whole sequences, the
program is solved again for what is left, and the last pieces (below a tenth on texts' lengths) go best fit into
what room there is. If that takes more sequences than the lower bound, growing shares of the rounded sequences are
opened again and packed with those pieces, until the bound is reached or all are. All of this works on at most `capacity` histogram bins and on (pattern, count) pairs,
whatever the number of documents; placing the pieces into the patterns' slots is distributed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import stored, work_dir
from lodestrata.llm.encode import CachedEncoder

#: Rounds of weights in one solution, lengths served in a round, the share of a length's pieces that a pattern serves
#: at once, and how far from the best value a pattern may be.
ROUNDS, BATCH, STEP, SLACK = 60, 128, 0.25, 0.002
#: Solutions at most; tokens that a rounded pattern may waste where fuller ones exist; pieces kept for the end.
SOLUTIONS, WASTE, HELD = 8, 2, 0.03
#: Shares of the rounded sequences that are opened again for best fit, until the lower bound is reached.
REOPENED = (0.0, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64, 1.0)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Encodes docs (doc_id, text) and cuts those beyond capacity; the first piece takes the remainder."""

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = CachedEncoder(tokenizer, kind)
        end = np.uint32(end_id).tobytes()
        for part in parts:
            ids, texts = part["doc_id"].tolist(), part["text"].tolist()
            for at in range(0, len(texts), 256):
                rows = []
                for doc_id, raw in zip(ids[at : at + 256], encode(texts[at : at + 256]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    ends = list(range(n % capacity, n, capacity)) + [n] if n % capacity else list(range(capacity, n + 1, capacity))
                    begin = 0
                    for k, to in enumerate(ends):
                        rows.append((doc_id, k, begin, to - begin, zlib.crc32(raw[4 * begin : 4 * to])))
                        begin = to
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(pieces, PIECES.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _values(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack's most value for every room up to the capacity (lengths ascending), by dynamic programming."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        if n := upto[c]:
            best[c] = max(best[c - 1], (price[:n] + best[c - lengths[:n]]).max())
    return best


def _priced(k: int, lengths: np.ndarray, price: np.ndarray, best: np.ndarray, cover: np.ndarray, most: np.ndarray) -> dict[int, int]:
    """A pattern through length k (index: copies) within SLACK of the best value; of such, the least covered lengths.

    A pattern takes copies of a length only while the histogram has them.
    """
    pattern, got, room = {k: 1}, price[k], len(best) - 1 - int(lengths[k])
    least = (1 - SLACK) * best[-1]
    while room >= lengths[0]:
        n = np.searchsorted(lengths, room, side="right")
        value = got + price[:n] + best[room - lengths[:n]]
        for j, m in pattern.items():
            if j < n and m >= most[j]:
                value[j] = -1.0
        top = value.max()
        if top < 0:
            break
        j = int(np.where(value >= min(least, top), cover[:n], np.inf).argmin())
        pattern[j] = pattern.get(j, 0) + 1
        got, room = got + price[j], room - int(lengths[j])
    return pattern


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[tuple[int, int], ...], float]:
    """Multiplicative weights for min sum(x) with every length covered: patterns ((index, copies), ...) and their x.

    Weights start in proportion to the lengths. A round prices all rooms once and serves the least covered
    lengths through near-best patterns; a length's weight falls as it is served.
    """
    log_w, served = np.log(lengths.astype(float)), np.zeros(len(lengths))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        cover = served / counts
        if cover.min() >= 1:
            break
        price = np.exp(log_w - log_w.max())
        best = _values(lengths, price, capacity)
        for k in np.argsort(cover, kind="stable")[:BATCH]:
            if cover[k] >= 1:
                break
            pattern = _priced(int(k), lengths, price, best, cover, counts)
            at, n = np.fromiter(pattern.keys(), int), np.fromiter(pattern.values(), float)
            amount = STEP * (counts[at] / n).min()
            served[at] += amount * n
            log_w[at] -= amount * n / counts[at]
            cover[at] = served[at] / counts[at]
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + amount
    return used


def _add(rooms: dict[int, dict[tuple[int, ...], int]], room: int, pattern: tuple[int, ...], times: int) -> None:
    held = rooms.setdefault(room, {})
    held[pattern] = held.get(pattern, 0) + times


def _best_fit(left: dict[int, int], rooms: dict[int, dict[tuple[int, ...], int]], capacity: int) -> None:
    """Best fit, longest first, of what rounding left (length: pieces) into rooms (room: pattern: sequences).

    Sequences that hold the same lengths are one entry with a count, so work follows patterns, not documents.
    """
    for n in sorted(left, reverse=True):
        todo = left[n]
        for room in sorted(r for r in rooms if r >= n):
            k, held = room // n, rooms.pop(room)
            for pattern in sorted(held):
                if full := min(held[pattern], todo // k):
                    _add(rooms, room - k * n, pattern + (n,) * k, full)
                    held[pattern] -= full
                    todo -= full * k
                if 0 < todo < k and held[pattern]:
                    _add(rooms, room - todo * n, pattern + (n,) * todo, 1)
                    held[pattern] -= 1
                    todo = 0
                if held[pattern]:
                    _add(rooms, room, pattern, held[pattern])
        if todo:
            k = capacity // n
            for copies, times in ((k, todo // k), (todo % k, 1)):
                if copies and times:
                    _add(rooms, capacity - copies * n, (n,) * copies, times)


def rounded(histogram: dict[int, int], capacity: int = 2048) -> tuple[dict[tuple[int, ...], int], dict[int, int]]:
    """Patterns of the linear program with whole numbers of sequences, and the pieces (length: count) that they leave.

    The program is solved, rounded by running sums of x over the patterns, fullest first, and solved again for
    what is left, until a solution places little. A share HELD of each run of pieces stays out for the end.
    """
    out: dict[tuple[int, ...], int] = {}
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    total, upto = int(counts.sum()), np.cumsum(counts)
    held = np.diff(np.floor(np.r_[0, upto] * HELD).astype(np.int64)) if total else counts
    left = counts - held
    for _ in range(SOLUTIONS):
        at = np.flatnonzero(left)
        if not len(at):
            break
        placed = whole = 0
        running = 0.0
        found = fractional(lengths[at], left[at].astype(float), capacity)
        fill = {p: sum(int(lengths[at[k]]) * n for k, n in p) for p in found}
        enough = min(capacity - WASTE, max(fill.values()))
        for pattern in sorted(found, key=lambda p: (-fill[p], -found[p], p)):
            if fill[pattern] < enough:
                break
            running += found[pattern]
            times, whole = int(running + 0.5) - whole, int(running + 0.5)
            times = min(times, *(int(left[at[k]]) // n for k, n in pattern))
            if times > 0:
                key = tuple(int(lengths[at[k]]) for k, n in pattern for _ in range(n))
                out[key] = out.get(key, 0) + times
                for k, n in pattern:
                    left[at[k]] -= n * times
                    placed += n * times
        if placed < total / 50:
            break
    return out, {int(n): int(c) for n, c in zip(lengths, left + held, strict=True) if c}


def _completed(patterns: dict[tuple[int, ...], int], left: dict[int, int], share: float, capacity: int) -> dict[int, dict[tuple[int, ...], int]]:
    """Rooms with all pieces: rounded patterns, of which a share is opened again and packed with what was left, best fit."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    todo, upto, opened = dict(left), 0, 0
    for pattern, times in sorted(patterns.items()):
        upto += times
        again, opened = int(upto * share) - opened, int(upto * share)
        if times > again:
            _add(rooms, capacity - sum(pattern), pattern, times - again)
        if again:
            for n in pattern:
                todo[n] = todo.get(n, 0) + again
    _best_fit(todo, rooms, capacity)
    return rooms


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences use each; serves every piece exactly once."""
    if not histogram:
        return []
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError("lengths are from 1 to the capacity")
    patterns, left = rounded({n: c for n, c in histogram.items() if n < capacity and c}, capacity)
    bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
    rooms, fewest = {}, None
    for share in REOPENED:
        found = _completed(patterns, left, share, capacity)
        if full := histogram.get(capacity):  # a full piece is a sequence
            _add(found, 0, (capacity,), full)
        total = sum(sum(held.values()) for held in found.values())
        if fewest is None or total < fewest:
            rooms, fewest = found, total
        if fewest == bound:
            break
    out: dict[tuple[int, ...], int] = {}
    for held in rooms.values():
        for pattern, times in held.items():
            key = tuple(sorted(pattern, reverse=True))
            out[key] = out.get(key, 0) + times
    return sorted(out.items())


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, intervals of ranks and where they go: sequence = base + (rank - first), and the offset.

    Its rows follow the number of patterns, not of documents.
    """
    rows, base, served = [], 0, {}
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            first = served.get(n, 0)
            rows.append((n, first, base, offset))
            served[n] = first + times
            offset += n
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "base", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs docs into sequences of at most `capacity` tokens: a row for each piece with its place.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each; no
    documents give no rows. Pieces are ranked within their length in `salts` parts, so that a length that a
    third of all pieces share is ranked in many tasks.
    """
    folder = work_dir(spark, "packing")
    pieces = stored(cut(docs, tokenizer, kind, end_id, capacity), folder + "/pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slot_table(plan(histogram, capacity))
    salts = max(64, sum(histogram.values()) // 1_000_000)

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(begins, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_begin"))

    # The slot table is bounded by the patterns: SOLUTIONS * ROUNDS * BATCH and what best fit adds, whatever the documents.
    shared = spark.sparkContext.broadcast({c: table[c].to_numpy(np.int64) for c in table})

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        keys = (t["length"] << 44) + t["first"]
        for p in parts:
            at = np.searchsorted(keys, (p["length"].to_numpy() << 44) + p["_rank"].to_numpy(), side="right") - 1
            yield p.drop(columns="_rank").assign(sequence_id=t["base"][at] + p["_rank"].to_numpy() - t["first"][at], offset=t["offset"][at])

    chosen = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", "_rank")
    out = chosen.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
