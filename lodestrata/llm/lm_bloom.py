"""A bigram language model in a log-frequency Bloom filter, built by Spark; texts meet it by broadcast or, beyond its bound, by shuffle.

Texts come in blocks. A block asks for each of its distinct tokens and bigrams once, in hash order, and tells how
often its training texts hold them. Asks are dealt into buckets by the hash's highest bits. A bucket sums the
counts, fills its own part of the filter and answers with levels that repeated membership probes of it find. Only
the answers, a byte an n-gram, go back to the blocks. Where blocks are many, up to about FAN of them are merged into
one asker first, FAN of those into one again, and so on, and answers go back the same way: an n-gram that all blocks
have reaches its bucket from FAN askers at most, and buckets get finer with each step, so that an ask holds many
n-grams. Every n-gram of the training texts is in the filter: what
travels and what is kept grow with the corpus, and no task holds more than a bucket or a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import chunks, mix64, ngram_hashes, stored, text_buffer, tidy, word_hashes, work_dir

END, START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
#: A count c is stored as the level 1 + floor(log(c) / log(BASE)).
BASE = 1.2
PROBES, BITS_AN_ENTRY = 6, 14
#: Weight of the unigram distribution in a bigram's.
MU = 1000.0
#: Text of a block, and of the corpus for each bucket of the filter.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: A corpus of up to this much text has its filter broadcast. A token is 2 bytes or more and its two n-grams cost at
#: most 2.4 entries for each occurrence, so such a filter has at most 96 MB; on prose it has about 6.
BROADCAST_TEXT = 22 << 20
#: Askers that meet in one group, and buckets that a block's own asks are dealt into while more steps follow.
FAN, FIRST_BUCKETS = 4096, 4096
ASKS = "bucket long, block long, n tinyint, h binary, c binary"
ANSWERS = "block long, bucket long, n tinyint, q binary, c binary, tokens long, distinct long, texts long"


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a chunk, each text's words and then its end; and where each text starts (n + 1)."""
    words, at = word_hashes(*text_buffer(batch.column(batch.schema.get_field_index("text"))))
    n = len(at) - 1
    begins = at + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    out[begins[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    out[inside] = words
    return out, begins


def _contexts(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The token before each one; START at the head of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins[:-1]] = START
    return before


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    both = np.empty(2 * len(tokens), np.uint64)
    both[::2], both[1::2] = before, tokens
    return ngram_hashes(both, 2)[::2]


def lower_count(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(BASE ** (level - 1.0) - 1e-9), 0.0)


def level_of(count: np.ndarray) -> np.ndarray:
    """Level of each count; 0 for none."""
    return np.where(count > 0, np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64) + 1, 0)


@dataclass
class LogBloom:
    """Log-frequency Bloom filter: an n-gram of level q is inserted as (hash, 1) to (hash, q)."""

    size: int
    bits: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, level: np.ndarray, bits_an_entry: int = BITS_AN_ENTRY) -> LogBloom:
        """A filter sized by its entries."""
        size = max(64, -(-int(level.sum()) * bits_an_entry // 64) * 64)
        held = np.zeros(size, bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            for k in range(PROBES):
                held[cls.places(h[level >= j], j, size, k)] = True
        return cls(size, np.packbits(held, bitorder="little"))

    @staticmethod
    def places(h: np.ndarray, level: int, size: int, probe: int) -> np.ndarray:
        g = mix64(h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return ((g + np.uint64(probe) * ((g >> np.uint64(32)) | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram by repeated probes: the last before the first miss; 0: never seen."""
        out = np.zeros(len(h), np.uint8)
        alive, level = np.arange(len(h)), 1
        while len(alive) and level < 256:
            for k in range(PROBES):
                p = self.places(h[alive], level, self.size, k)
                alive = alive[((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1) == 1]
            out[alive] = level
            level += 1
        return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that the hash's highest bits name (buckets: a power of two)."""
    return (h >> np.uint64(65 - buckets.bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)


def blocks_of(rows: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """rows (with text) plus block: runs of rows of about `size` bytes of text, at least one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in chunks(batch):
                held += len(text_buffer(part.column(part.schema.get_field_index("text")))[0])
                yield part.append_column("block", pa.array(np.full(part.num_rows, block, np.int64)))
                if held >= size:
                    block, held = block + 1, 0

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", block long")


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of (hashes, weights) in order, the sums of their weights, and where each one is among them."""
    h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
    u, back = np.unique(h, return_inverse=True)
    w = np.concatenate([y for _, y in parts]) if parts else np.zeros(0)
    return u, np.rint(np.bincount(back, w, len(u))).astype(np.int64), back


def _packed(c: np.ndarray) -> bytes:
    """Counts in one byte each where all fit, else in eight."""
    return c.astype(np.uint8 if not len(c) or c.max() < 256 else "<i8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<i8").astype(np.int64)


def asks_of(blocks: DataFrame, buckets: int) -> DataFrame:
    """Of each block and bucket, the distinct token (n 1) and bigram (n 2) hashes in order and their counts in training texts.

    blocks: text, block, train; a block's rows follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            for n in (1, 2):
                u, c, _ = _distinct(held[n - 1])
                held[n - 1].clear()
                named, at = np.unique(bucket_of(u, buckets), return_index=True)
                cuts = [*at.tolist(), len(u)]
                for lo in range(0, len(named), 256):
                    part = range(lo, min(lo + 256, len(named)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named[part.start : part.stop]), pa.array([now] * len(part), pa.int64()), pa.array([n] * len(part), pa.int8()), pa.array([u[cuts[i] : cuts[i + 1]].tobytes() for i in part], pa.binary()), pa.array([_packed(c[cuts[i] : cuts[i + 1]]) for i in part], pa.binary())],
                        ["bucket", "block", "n", "h", "c"],
                    )

        for batch in batches:
            keys = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for part in chunks(batch.slice(a, b - a)):
                    if keys[a] != now and now is not None:
                        yield from flush()
                    now = int(keys[a])
                    tokens, begins = _tokens(part)
                    train = np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(float), np.diff(begins))
                    held[0].append((tokens, train))
                    held[1].append((_pairs(_contexts(tokens, begins), tokens), train))
        if now is not None:
            yield from flush()

    return blocks.select("text", "block", "train").mapInArrow(run, ASKS)


def _filled(asks: pa.Table, bits_an_entry: int) -> tuple[LogBloom, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A bucket's filter; its distinct hashes, their counts and which of them are tokens; where each asked hash is, and where each ask ends."""
    hs = [np.frombuffer(x.as_py(), "<u8") for x in asks.column("h")]
    cs = [_unpacked(x.as_py(), len(h)) for x, h in zip(asks.column("c"), hs, strict=True)]
    ends = np.cumsum([len(h) for h in hs]).tolist()
    u, c, back = _distinct(list(zip(hs, cs, strict=True)))
    token = np.zeros(len(u), bool)
    token[back[np.repeat(asks.column("n").to_numpy() == 1, [len(h) for h in hs])]] = True
    return LogBloom.of(u, level_of(c), bits_an_entry), u, c, token, back, ends


def merged_asks(asks: DataFrame, parent: Column, finer: int) -> DataFrame:
    """Asks of parents: the union of their askers' n-grams, counts summed, dealt into finer buckets.

    asks: as asks_of gives them; parent: the asker (column block) that each one goes to.
    """

    def run(part: pa.Table) -> pa.Table:
        parent, rows = part.column("parent")[0].as_py(), []
        for n in (1, 2):
            own = part.filter(pc.equal(part.column("n"), n))
            if not own.num_rows:
                continue
            hs = [np.frombuffer(x, "<u8") for x in own.column("h").to_pylist()]
            u, c, _ = _distinct([(h, _unpacked(x, len(h))) for h, x in zip(hs, own.column("c").to_pylist(), strict=True)])
            named, at = np.unique(bucket_of(u, finer), return_index=True)
            for bucket, a, b in zip(named.tolist(), at.tolist(), [*at[1:].tolist(), len(u)], strict=True):
                rows.append((bucket, parent, n, u[a:b].tobytes(), _packed(c[a:b])))
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["bucket", "block", "n", "h", "c"])

    return asks.withColumn("parent", parent).groupBy("parent", "bucket").applyInArrow(run, ASKS)


def handed_down(asks: DataFrame, parent: Column, buckets: int, finer: int, answers: DataFrame) -> DataFrame:
    """Answers (block, bucket, n, q, c) to asks in `buckets`, from those that their parents got in finer buckets."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {x: [] for x in ("block", "bucket", "n", "q", "c")}
        told = told.sort_by([("n", "ascending"), ("fine", "ascending")])
        for n in (1, 2):
            mine, theirs = (x.filter(pc.equal(x.column("n"), n)) for x in (own, told))
            if not mine.num_rows:
                continue
            hs = [np.frombuffer(x, "<u8") for x in mine.column("h").to_pylist()]
            u = np.unique(np.concatenate(hs))
            q = [np.frombuffer(x, np.uint8) for x in theirs.column("q").to_pylist()]
            level = np.concatenate(q)
            count = np.concatenate([_unpacked(x, len(y)) for x, y in zip(theirs.column("c").to_pylist(), q, strict=True)]) if n == 1 else None
            for block, bucket, h in zip(mine.column("block").to_pylist(), mine.column("bucket").to_pylist(), hs, strict=True):
                at = np.searchsorted(u, h)
                out["block"].append(block)
                out["bucket"].append(bucket)
                out["n"].append(n)
                out["q"].append(level[at].tobytes())
                out["c"].append(None if count is None else _packed(count[at]))
        types = (pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], list(out))

    left = asks.select("block", "bucket", "n", "h").withColumn("parent", parent).groupBy("parent", "bucket")
    coarse = F.floor(F.col("bucket") / (finer // buckets)).cast("long")
    right = answers.select(F.col("block").alias("parent"), coarse.alias("bucket"), F.col("bucket").alias("fine"), "n", "q", "c").groupBy("parent", "bucket")
    return left.cogroup(right).applyInArrow(run, "block long, bucket long, n tinyint, q binary, c binary")


def answers_of(asks: DataFrame, bits_an_entry: int = BITS_AN_ENTRY) -> DataFrame:
    """Levels (q, a byte each) of what each block asked a bucket, exact counts (c) of tokens, and a row of totals for each bucket."""

    def run(part: pa.Table) -> pa.Table:
        bloom, u, c, token, back, ends = _filled(part, bits_an_entry)
        level, n = bloom.levels(u), part.column("n").to_pylist()
        begins = [0, *ends[:-1]]
        q = [level[back[a:b]].tobytes() for a, b in zip(begins, ends, strict=True)]
        exact = [_packed(c[back[a:b]]) if k == 1 else None for k, a, b in zip(n, begins, ends, strict=True)]
        k = len(n)
        none = [None] * k
        own = c[token]
        return pa.table(
            {
                "block": pa.array([*part.column("block").to_pylist(), None], pa.int64()),
                "bucket": pa.array([*part.column("bucket").to_pylist(), None], pa.int64()),
                "n": pa.array([*n, 0], pa.int8()),
                "q": pa.array([*q, None], pa.binary()),
                "c": pa.array([*exact, None], pa.binary()),
                "tokens": pa.array([*none, int(own.sum())], pa.int64()),
                "distinct": pa.array([*none, int((own > 0).sum())], pa.int64()),
                "texts": pa.array([*none, int(own[u[token] == END].sum())], pa.int64()),
            }
        )

    return asks.groupBy("bucket").applyInArrow(run, ANSWERS)


@dataclass
class Model:
    """Totals of the training texts: tokens, distinct tokens and texts."""

    tokens: int
    distinct: int
    texts: int

    def log10(self, before: np.ndarray, own: np.ndarray, context: np.ndarray, pair: np.ndarray, mu: float = MU) -> np.ndarray:
        """log10 of each token's smoothed probability after the one before it, from levels.

        Contexts count at their level's upper end and tokens at the lower, so the distribution sums to at most
        1 up to the filter's false positives.
        """
        count = lower_count(own)
        upper = np.where(before == START, self.texts, np.where(context > 0, BASE ** context.astype(float), 0.0))
        both = np.minimum(lower_count(pair), np.minimum(upper, np.maximum(count, 1.0) * BASE))
        p1 = (count + 1) / (self.tokens + self.distinct + 1)
        return np.log10((both + mu * p1) / (upper + mu))

    def scores(self, part: pa.RecordBatch, words: np.ndarray, word_level: np.ndarray, word_count: np.ndarray, pairs: np.ndarray, pair_level: np.ndarray) -> pa.RecordBatch:
        """Scores of a chunk (doc_id, text) by tables of the n-grams that it holds, each in hash order."""
        tokens, begins = _tokens(part)
        before = _contexts(tokens, begins)
        at, back = np.searchsorted(words, tokens), np.searchsorted(words, np.where(before == START, tokens, before))
        values = self.log10(before, word_level[at], word_level[back], pair_level[np.searchsorted(pairs, _pairs(before, tokens))])
        c, first = word_count[at], begins[:-1]
        base = np.log10((c + 1.0) / (self.tokens + self.distinct + 1))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(begins)), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(values, first))],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _model(totals: DataFrame) -> Model:
    row = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "texts"))).first()
    return Model(int(row["tokens"]), int(row["distinct"]), int(row["texts"]))


def dealt_scores(blocks: DataFrame, buckets: int, folder: str, bits_an_entry: int = BITS_AN_ENTRY, fan: int = FAN, first_buckets: int = FIRST_BUCKETS) -> tuple[DataFrame, Model]:
    """Scores of all blocks from the buckets' answers, which meet their block's texts by shuffle.

    fan and first_buckets (a power of two) set how asks are merged on the way; scores don't depend on them.
    """
    askers = blocks.select("block").distinct().count()
    asked, first = [], buckets
    if askers > fan:
        first = min(buckets, first_buckets)
    asks, now = asks_of(blocks, first), first
    while askers > fan:
        # Blocks have no dense numbers: they are dealt by hash, about fan to each parent. Their parents have.
        parents = -(-askers // fan)
        parent = F.floor(F.col("block") / fan).cast("long") if asked else F.pmod(F.xxhash64("block"), F.lit(parents))
        finer = buckets if parents <= fan else min(buckets, now << (fan.bit_length() - 1))
        asks = stored(asks, f"{folder}/asks{len(asked)}")
        asked.append((asks, parent, now, finer))
        asks, now, askers = merged_asks(asks, parent, finer), finer, parents
    top = stored(answers_of(asks, bits_an_entry), folder + "/answers")
    model, answers = _model(top.where("n = 0")), top.where("n > 0").select("block", "bucket", "n", "q", "c")
    for k, (asks, parent, own, finer) in reversed(list(enumerate(asked))):
        answers = stored(handed_down(asks, parent, own, finer, answers), f"{folder}/told{k}")

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by([("n", "ascending"), ("bucket", "ascending")])
        n = told.column("n").to_numpy()
        q = [np.frombuffer(x, np.uint8) for x in told.column("q").to_pylist()]
        level = [np.concatenate([x for x, k in zip(q, n, strict=True) if k == order]) for order in (1, 2)]
        count = np.concatenate([_unpacked(x, len(y)) for x, y, k in zip(told.column("c").to_pylist(), q, n, strict=True) if k == 1])
        parts = [part for batch in texts.select(["doc_id", "text"]).combine_chunks().to_batches() for part in chunks(batch)]
        held: list[list[np.ndarray]] = [[], []]
        for part in parts:
            tokens, begins = _tokens(part)
            held[0].append(np.unique(tokens))
            held[1].append(np.unique(_pairs(_contexts(tokens, begins), tokens)))
        words, pairs = (np.unique(np.concatenate(x)) for x in held)
        return pa.Table.from_batches([model.scores(part, words, level[0], count, pairs, level[1]) for part in parts])

    return blocks.select("doc_id", "text", "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES), model


def broadcast_scores(blocks: DataFrame, buckets: int, bits_an_entry: int = BITS_AN_ENTRY) -> tuple[DataFrame, Model]:
    """Scores by a filter that every worker holds, for a corpus whose text is bounded by BROADCAST_TEXT."""

    def fill(part: pa.Table) -> pa.Table:
        bloom, u, c, token, _, _ = _filled(part, bits_an_entry)
        known = token & (c > 0)
        own = {"tokens": c[known].sum(), "distinct": known.sum(), "texts": c[known & (u == END)].sum()}
        return pa.table({"bucket": part.column("bucket").slice(0, 1), "bits": [bloom.bits.tobytes()], "h": [u[known].tobytes()], "c": [c[known].astype("<i8").tobytes()], **{k: pa.array([int(v)], pa.int64()) for k, v in own.items()}})

    got = asks_of(blocks, buckets).groupBy("bucket").applyInArrow(fill, "bucket long, bits binary, h binary, c binary, tokens long, distinct long, texts long").orderBy("bucket").collect()
    model = Model(*(sum(r[k] for r in got) for k in ("tokens", "distinct", "texts")))
    blooms = {r["bucket"]: LogBloom(8 * len(r["bits"]), np.frombuffer(bytes(r["bits"]), np.uint8)) for r in got}
    words = np.frombuffer(b"".join(bytes(r["h"]) for r in got), "<u8")
    counts = np.frombuffer(b"".join(bytes(r["c"]) for r in got), "<i8")
    shared = blocks.sparkSession.sparkContext.broadcast((blooms, words, counts))

    def levels(blooms: dict[int, LogBloom], u: np.ndarray) -> np.ndarray:
        named, at = np.unique(bucket_of(u, buckets), return_index=True)
        cuts = [*at.tolist(), len(u)]
        return np.concatenate([blooms[int(b)].levels(u[cuts[i] : cuts[i + 1]]) for i, b in enumerate(named)]) if len(u) else np.zeros(0, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms, words, counts = shared.value
        for batch in batches:
            for part in chunks(batch):
                tokens, begins = _tokens(part)
                u, pairs = np.unique(tokens), np.unique(_pairs(_contexts(tokens, begins), tokens))
                k = np.minimum(np.searchsorted(words, u), max(0, len(words) - 1))
                count = np.where(words[k] == u, counts[k], 0) if len(words) else np.zeros(len(u), np.int64)
                yield model.scores(part, u, levels(blooms, u), count, pairs, levels(blooms, pairs))

    return blocks.select("doc_id", "text").mapInArrow(run, SCORES), model


def evaluate(spark: SparkSession, docs: DataFrame, broadcast_text: int = BROADCAST_TEXT, bits_an_entry: int = BITS_AN_ENTRY, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, first_buckets: int = FIRST_BUCKETS) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 7 is not 2 and scores all (a null doc_id is learned from).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. A null or empty text is its
    end alone, repeated rows count and are scored each, other columns are ignored, no documents give no rows.
    Scores are the same whether the filter is broadcast or dealt.
    """
    folder = work_dir(spark, "lm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held).alias("train"))
    blocks = stored(blocks_of(rows, block_bytes), folder + "/blocks")
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << max(0, (size // bucket_bytes).bit_length())
    if size <= broadcast_text:
        out, model = broadcast_scores(blocks, buckets, bits_an_entry)
    else:
        out, model = dealt_scores(blocks, buckets, folder, bits_an_entry, fan, first_buckets)
    return tidy(out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"), folder)
