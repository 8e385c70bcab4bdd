"""Exact set-similarity self-join on word n-grams: near duplicates and their components.

Steps, each a Spark job over shared files:

1. `summaries`: each text's shingle set as a class (equal sets share one), and frequent shingles.
2. `postings`: inverted lists of each class's rarest shingles. A pair that reaches the similarity shares one of
   them (prefix filter), so lists of one member need nothing more.
3. `candidates`: pairs from short lists that pass the size and position filters, and the members of long lists.
   `pruned` drops pairs, and splits long lists, where a bitmap of each set proves that the overlap cannot be
   reached. Components of what is left are clusters, which no link leaves.
4. `links`: inside a cluster, blocks of sets meet in one task, where T-occurrence searches (DivideSkip) find
   every pair with the required overlap. Very large clusters first meet one block; only what that leaves
   outside the largest component then meets all blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import chunks, mix64, parts_for, shingle_set, stored, text_buffer, tidy, word_hashes, work_dir
from lodestrata.llm.components import components

WORDS, PERCENT = 5, 80
#: Frequent shingles that are ordered by frequency (16 bytes each on the driver); others go by their hash.
FREQUENT = 400_000
BLOCK_SHINGLES = 2_000_000
#: Lists up to this length give all their pairs; longer ones are split by the members' bitmaps, and beyond
#: LONG_LIST members stay tied together.
SHORT_LIST, LONG_LIST = 16, 2048
#: Bits of a small set's parity bitmap; larger sets have the power of two from twice their size.
BITMAP = 1024
#: Members of long lists in one task.
TASK_MEMBERS = 4096
#: Sets that meet in one task, and blocks beyond which a cluster is contracted first.
BLOCK, DIRECT_BLOCKS = 256, 6
#: Identifiers up to this many are broadcast to fetch texts; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def overlap_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Least common shingles for sets of n and m: percent * union <= 100 * common."""
    return -(-percent * (n + m) // (100 + percent))


def probe_length(n: int, percent: int = PERCENT) -> int:
    """Rarest shingles of a set that any linked set of at most its size must meet."""
    return n - -(-percent * n // 100) + 1 if n else 0


def index_length(n: int, percent: int = PERCENT) -> int:
    """The same against sets of at least its size."""
    return n - overlap_needed(n, n, percent) + 1 if n else 0


def class_of(shingles: np.ndarray) -> int:
    """A 63-bit name of a set; never negative."""
    if not len(shingles):
        return 0
    a = mix64(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(mix64(np.array([a ^ (np.uint64(len(shingles)) << np.uint64(40))], np.uint64))[0] >> np.uint64(1))


def bitmap_of(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each place: two sets' bitmaps differ in no more places than the sets do in shingles."""
    bits = max(BITMAP, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else BITMAP
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap that the same set has in `size` bytes, as 64-bit words: halves of a parity bitmap add up."""
    words = np.frombuffer(bitmap, np.uint64)
    while 8 * len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes whose bitmaps differ in so many places can reach the overlap."""
    return differ <= na + nb - 2 * (-(-percent * (na + nb) // (100 + percent)))


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each text of a batch."""
    row = 0
    for part in chunks(batch):
        h, at = word_hashes(*text_buffer(part.column(part.schema.get_field_index("text"))))
        for i in range(len(at) - 1):
            yield row + i, shingle_set(h[at[i] : at[i + 1]], words)
        row += part.num_rows


def summaries(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """kind 0: a document's doc_id (a), class (b), text hash (h), set size (n) and bitmap (m); kind 1: a shingle (a) and in how many of a block's documents it is (n, 2 or more)."""
    names = ["kind", "a", "b", "h", "n", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            t, c = t[c > 1], c[c > 1]
            zero = np.zeros(len(t), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int8)), pa.array(t.view(np.int64)), pa.array(zero), pa.array(zero), pa.array(c.astype(np.int64)), pa.nulls(len(t), pa.binary())], names)

        for batch in batches:
            cls, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            maps: list[bytes | None] = [None] * batch.num_rows
            for i, s in _sets(batch, words):
                cls[i], n[i], maps[i] = class_of(s), len(s), bitmap_of(s)
                held.append(s)
                size += len(s)
                if size >= BLOCK_SHINGLES:
                    yield from flush()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), batch.column(0), pa.array(cls), batch.column(2), pa.array(n), pa.array(maps, pa.binary())], names)
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "kind tinyint, a long, b long, h long, n long, m binary")


class Order:
    """The global order of shingles, rarest first: those not known as frequent by hash, then by frequency."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by = np.argsort(shingles)
        self.shingles, self.counts = shingles[by], counts[by]

    def sort(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return s
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        count = np.where(self.shingles[at] == s, self.counts[at], 0)
        return s[np.argsort(count, kind="stable")]


def frequent(summary: DataFrame, most: int = FREQUENT) -> Order:
    """The most frequent shingles; a bounded table. It only orders lists, and no result depends on it."""
    got = summary.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "a").limit(most).toArrow()
    return Order(got.column("a").to_numpy().view(np.uint64), got.column("n").to_numpy())


def postings(docs: DataFrame, order: Order, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Inverted lists: shingle (t), class (c), set size (n) and place of the shingle in the set (p).

    Copies within a batch give one entry. Only a set's rarest shingles are indexed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            seen: set[int] = set()
            t, c, n, p = [], [], [], []
            for _, s in _sets(batch, words):
                if not len(s) or (k := class_of(s)) in seen:
                    continue
                seen.add(k)
                first = order.sort(s)[: probe_length(len(s), percent)]
                t.append(first)
                c.append(np.full(len(first), k, np.int64))
                n.append(np.full(len(first), len(s), np.int32))
                p.append(np.arange(len(first), dtype=np.int32))
            if t:
                t, c, n, p = np.concatenate(t).view(np.int64), np.concatenate(c), np.concatenate(n), np.concatenate(p)
                for at in range(0, len(t), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(t[part]), pa.array(c[part]), pa.array(n[part]), pa.array(p[part])], ["t", "c", "n", "p"])

    return docs.select("text").mapInArrow(run, "t long, c long, n int, p int")


def _pairs_of(n: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i of at most j's size) may link by their sizes and this shingle's places."""
    a, b, x, y = n[i].astype(np.int64), n[j].astype(np.int64), p[i], p[j]
    need = -(-percent * (a + b) // (100 + percent))
    first = a - (-(-percent * 2 * a // (100 + percent))) + 1
    return (100 * a >= percent * b) & (x < first) & (1 + np.minimum(a - x - 1, b - y - 1) >= need)


def candidates(lists: DataFrame, percent: int = PERCENT, short: int = SHORT_LIST) -> DataFrame:
    """Pairs of classes (a, b) from inverted lists; of a long list (t), its first member (a) with each other one (b).

    Lists arrive sorted by (shingle, size, class). In a list of up to `short` + 1 entries all pairs meet. A list
    streams through its task: only its first and its latest entries are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        lead: tuple[int, int] | None = None  # of the list that the held rows end in
        run_length = 0

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            old = len(held[0])
            t, c, n, p = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])  # copies in other batches
            fresh[:old] = True
            t, c, n, p = t[fresh], c[fresh], n[fresh], p[fresh]
            at = np.arange(len(t))
            begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else at
            starts = np.repeat(begin, np.diff(np.r_[begin, len(t)]))
            out, ties = [], []
            for k in range(1, short + 1):
                j = at[max(old, k) :]
                i = j - k
                same = t[i] == t[j]
                i, j = i[same], j[same]
                if not len(i) and k > 1:
                    break
                ok = _pairs_of(n, p, i, j, percent)
                out.append(np.stack([c[i[ok]], c[j[ok]]]))
            # Members beyond the first `short` are tied to the list's first entry, and those before too.
            place = at - starts
            first = c[starts]
            if len(t) and lead is not None and lead[0] == t[0]:
                mine = starts == 0
                place = np.where(mine, place + run_length - old, place)
                first = np.where(mine, lead[1], first)
            long = (at >= old) & (place > short)
            ties.append(np.stack([t[long], first[long], c[long]]))
            reached = (at >= old) & (place == short + 1)
            for k in range(1, short + 1):
                i = at[reached] - k
                ties.append(np.stack([t[reached], first[reached], c[i]]))
            if len(t):
                run_length, lead = int(place[-1]) + 1, (int(t[-1]), int(first[-1]))
                keep = (t == t[-1]) & (at >= len(t) - short - 1)
                held = [t[keep], c[keep], n[keep], p[keep]]
            found = np.concatenate(out, axis=1)
            found = np.unique(np.stack([found.min(0), found.max(0)], 1), axis=0) if found.size else np.zeros((0, 2), np.int64)
            found = found[found[:, 0] != found[:, 1]]
            tied = np.concatenate(ties, axis=1)
            tied = tied[:, tied[1] != tied[2]]
            lists = pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(tied[0])])
            yield pa.RecordBatch.from_arrays([lists, pa.array(np.r_[found[:, 0], tied[1]]), pa.array(np.r_[found[:, 1], tied[2]])], ["t", "a", "b"])

    dealt = lists.repartition("t").sortWithinPartitions("t", "n", "c")
    return dealt.mapInArrow(run, "t long, a long, b long")


def forest_of(classes: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs that span the parts of a long list between which sizes or bitmaps rule out every link."""
    by = np.lexsort((classes, sizes))
    classes, sizes, maps = classes[by], sizes[by].astype(np.int64), [maps[i] for i in by]
    lengths = np.array([len(m) for m in maps])
    label, out = np.arange(len(classes)), []
    for level in np.unique(lengths):  # linked sets' bitmaps are of one length or the next
        at = np.flatnonzero((lengths == level) | (lengths == 2 * level))
        words, n, own = np.stack([folded(maps[i], level) for i in at]), sizes[at], lengths[at] == level
        for k in range(1, len(at)):
            i = np.flatnonzero(own[:-k] & (label[at[:-k]] != label[at[k:]]) & (100 * n[:-k] >= percent * n[k:]))
            if not len(i):
                if (label[at] == label[at[0]]).all():
                    break
                continue
            differ = np.bitwise_count(words[i] ^ words[i + k]).sum(axis=1, dtype=np.int64)
            for x in i[may_link(n[i], n[i + k], differ, percent)]:
                a, b = at[x], at[x + k]
                if label[a] != label[b]:
                    out.append((int(classes[a]), int(classes[b])))
                    label[label == label[b]] = label[a]
    return out


def pruned(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT, most: int = LONG_LIST) -> DataFrame:
    """Pairs (a, b) that connect all that may link; classes: c, n and bitmap m.

    Two sets overlap in at most half of their sizes' sum less the places in which their bitmaps differ: exact, no
    link is lost. A long list of up to `most` members meets in one task, a longer one keeps its ties.
    """
    x, y = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma")), classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    short = pairs.where("t is null").select("a", "b").distinct().join(x, "a").join(y, "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            ma, mb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            differ = np.zeros(len(a), np.int64)
            for i, (p, q) in enumerate(zip(ma, mb, strict=True)):
                size = min(len(p), len(q))
                differ[i] = np.bitwise_count(folded(p, size) ^ folded(q, size)).sum(dtype=np.int64)
            stay = may_link(na, nb, differ, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[stay]), pa.array(b[stay])], ["a", "b"])

    short = short.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(test, "a long, b long")
    ties = pairs.where("t is not null").distinct()
    lengths = ties.groupBy("t").agg(F.count("*").alias("k"))
    ties = ties.join(lengths, "t")
    over = ties.where(F.col("k") >= most).select("a", "b")
    inside = ties.where(F.col("k") < most)
    parts = parts_for(pairs.sparkSession, pairs.where("t is not null").count(), TASK_MEMBERS)
    members = inside.select("t", F.col("b").alias("c")).unionByName(inside.select("t", F.col("a").alias("c")).distinct()).join(classes, "c")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest_of(part["c"].to_numpy(), part["n"].to_numpy(), [bytes(m) for m in part["m"]], percent), columns=["a", "b"], dtype=np.int64)

    return short.unionByName(members.repartition(parts, "t").groupBy("t").applyInPandas(run, "a long, b long")).unionByName(over)


class ListIndex:
    """Inverted lists of a block of sets, searched by T-occurrence."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(tokens, kind="stable")
        self.owner = owner[by]
        self.tokens, self.at = np.unique(tokens[by], return_index=True)
        self.at = np.r_[self.at, len(tokens)]

    def search(self, query: np.ndarray, percent: int = PERCENT, skip: np.ndarray | None = None) -> np.ndarray:
        """Numbers of all sets that link with the query; `skip` marks those that need no answer.

        DivideSkip: the L longest lists are set apart, the short ones are merged by a heap, and those that occur
        T - L times there are looked up in the long lists by binary search until they cannot reach T.
        """
        n = len(query)
        if not n or not len(self.tokens):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        k = k[self.tokens[k] == query]
        need = -(-percent * n // 100)  # of any set that can link: it has at least percent of the query's size
        if len(k) < need:
            return np.zeros(0, np.int64)
        lengths = self.at[k + 1] - self.at[k]
        k = k[np.argsort(lengths, kind="stable")]
        apart = min(need - 1, int(need / (0.0085 * np.log2(max(2, int(lengths.max()))) + 1)))
        short, long = k[: len(k) - apart], k[len(k) - apart :]
        merged = heapq.merge(*(self.owner[self.at[x] : self.at[x + 1]].tolist() for x in short))
        found = [(o, c) for o, c in ((o, sum(1 for _ in g)) for o, g in groupby(merged)) if c >= need - apart]
        if not found:
            return np.zeros(0, np.int64)
        ids, counts = (np.array(x, np.int64) for x in zip(*found, strict=True))
        target = -(-percent * (n + self.sizes[ids]) // (100 + percent))
        if skip is not None:
            stay = ~skip[ids]
            ids, counts, target = ids[stay], counts[stay], target[stay]
        for left, x in zip(range(len(long), 0, -1), long, strict=True):
            stay = counts + left >= target
            if not stay.all():
                ids, counts, target = ids[stay], counts[stay], target[stay]
            if not len(ids):
                break
            members = self.owner[self.at[x] : self.at[x + 1]]
            at = np.minimum(np.searchsorted(members, ids), len(members) - 1)
            counts += members[at] == ids
        return ids[counts >= target]


class _Forest:
    """Union-find over the members of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(classes: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, answers: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between asking and answering members of one block; those that would close a circle are left out."""
    inside = np.flatnonzero(answers)
    index, forest, out = ListIndex([sets[i] for i in inside]), _Forest(len(sets)), []
    for q in np.flatnonzero(asks):
        root = forest.find(q)
        skip = np.array([forest.find(i) == root for i in inside], bool) if len(inside) > 1 else None
        for i in index.search(sets[q], percent, skip):
            if inside[i] != q and forest.join(q, int(inside[i])):
                out.append((int(classes[q]), int(classes[inside[i]])))
    return out


def _meet(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside each block: rows (cluster, q, i, c, asks, answers) meet their sets (c, s).

    Blocks are dealt to as many tasks as there are blocks' worth of rows, whatever the bytes of these short rows say.
    """
    parts = parts_for(dealt.sparkSession, dealt.count(), 2 * BLOCK)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.groupby("c", as_index=False, sort=True).agg({"s": "first", "asks": "max", "answers": "max"})
        sets = [np.frombuffer(x, np.uint64) for x in part["s"]]
        return pd.DataFrame(block_links(part["c"].to_numpy(), sets, part["asks"].to_numpy(), part["answers"].to_numpy(), percent), columns=["a", "b"], dtype=np.int64)

    return dealt.join(sets, "c").repartition(parts, "cluster", "q", "i").groupBy("cluster", "q", "i").applyInPandas(run, "a long, b long")


def links(spark: SparkSession, sets: DataFrame, clusters: DataFrame, folder: str, percent: int = PERCENT) -> DataFrame:
    """Pairs of linked classes that connect each component; sets: c and s (bytes of its shingles).

    A cluster is dealt into blocks by hash, and each pair of blocks is a task's work: a set travels once for each
    block of its cluster, which for all but a few clusters is once.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    parts = sizes.select("cluster", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    placed = clusters.join(parts, "cluster").withColumn("block", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    placed = stored(placed, folder + "/placed")
    both = F.lit(True)
    direct = placed.where(F.col("parts") <= DIRECT_BLOCKS)
    rows = direct.select("cluster", "c", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    small = rows.select("cluster", F.least("block", "other").alias("q"), F.greatest("block", "other").alias("i"), "c", both.alias("asks"), both.alias("answers"))
    large = placed.where(F.col("parts") > DIRECT_BLOCKS)
    # Everything in a large cluster asks its block 0, which travels to each of the cluster's tasks.
    first = large.select("cluster", F.col("block").alias("q"), F.lit(0).alias("i"), "c", both.alias("asks"), (F.col("block") == 0).alias("answers"))
    core = large.where("block = 0").select("cluster", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("q"), F.lit(0).alias("i"), "c", F.lit(False).alias("asks"), both.alias("answers"))
    found = stored(_meet(small.unionByName(first).unionByName(core), sets, percent), folder + "/links")
    if large.isEmpty():
        return found
    # Those outside the cluster's largest component then ask all its blocks.
    roots = components(spark, found, folder + "/contract")
    named = large.join(roots, large["c"] == roots["node"], "left").select("cluster", "c", "block", "parts", F.coalesce("root", "c").alias("root"))
    named = stored(named, folder + "/named")
    counts = named.groupBy("cluster", "root").agg(F.count("*").alias("m"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("m", "root")).getField("root").alias("main"))
    outside = named.join(main, "cluster").where("root <> main").drop("main")
    asking = outside.select("cluster", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "c", both.alias("asks"), F.lit(False).alias("answers"))
    blocks = outside.select("cluster", F.col("block").alias("q")).distinct()
    answering = named.join(blocks, "cluster").select("cluster", "q", F.col("block").alias("i"), "c", F.lit(False).alias("asks"), both.alias("answers"))
    more = _meet(asking.unionByName(answering), sets, percent)
    return found.unionByName(stored(more, folder + "/more"))


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for docs (doc_id, text); see groups()."""
    return groups(spark, docs, words, percent).select("doc_id", "n_shingles", "component_id")


def groups(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, h (the text's hash), n_shingles, root and component_id.

    root names the component (null for a text without shingles), component_id is the smallest doc_id in it. Two texts link when 100 * common >= percent * union of their shingle sets. A text without words or a null
    has no shingles and links with nothing. Equal sets are one class from the start, so copies cost one set.
    A null doc_id is kept and never names a component unless all its members lack one. No documents, no rows.
    """
    folder = work_dir(spark, "ngram")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summary = stored(summaries(docs, words), folder + "/summary")
    found = summary.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("c"), "h", "n")
    order = frequent(summary)
    pairs = stored(candidates(postings(docs, order, words, percent), percent), folder + "/met")
    sized = summary.where("kind = 0 and n > 0").groupBy(F.col("b").alias("c")).agg(F.first("n").alias("n"), F.first("m").alias("m"))
    pairs = stored(pruned(pairs, sized, percent), folder + "/pairs")
    tied = components(spark, pairs, folder + "/clusters")
    clusters = tied.select(F.col("node").alias("c"), F.col("root").alias("cluster")).unionByName(tied.select(F.col("root").alias("c"), F.col("root").alias("cluster")).distinct())
    clusters = stored(clusters, folder + "/members")

    # One text stands for each class in a cluster.
    lowest = F.lit(-(1 << 63))
    stand = found.where("n > 0").join(clusters.select("c"), "c", "left_semi").groupBy("c").agg(F.min(F.struct(F.coalesce("doc_id", lowest).alias("doc_id"), "h")).alias("r"))
    stand = stored(stand.select("c", F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h")), folder + "/stand")
    total = stand.count()
    hint = F.broadcast(stand) if total <= BROADCAST_ROWS else stand
    texts = docs.select(F.coalesce("doc_id", lowest).alias("doc_id"), "text", F.xxhash64("text").alias("h")).join(hint, ["doc_id", "h"]).select("c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for _, s in _sets(batch, words)], pa.binary())], ["c", "s"])

    sets = stored(texts.mapInArrow(run, "c long, s binary"), folder + "/sets")
    if sets.count() > total:  # repeated rows
        sets = sets.dropDuplicates(["c"])
    edges = links(spark, sets, clusters, folder + "/blocks", percent)
    roots = components(spark, edges, folder + "/roots")

    # Class and component get their smallest doc_id by grouped aggregation, then documents meet their class.
    classes = found.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "root").select("c", "root", "component_id")
    n = F.col("n").alias("n_shingles")
    out = found.where("n > 0").join(classes, "c").select("doc_id", "h", n, "root", "component_id")
    return tidy(out.unionByName(found.where("n = 0").select("doc_id", "h", n, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))), folder)
