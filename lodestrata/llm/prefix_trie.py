"""Prefix trie of conversations by Patricia construction over sorted sequences of turns.

1. `rebuilt`: each conversation as the digests of its turns, 16 bytes each, in one binary path. Paths sort as the trie
   does: a prefix before what continues it, and all that share a prefix side by side.
2. `_Range`: ranges of sorted paths, one a task. A stack over the common prefixes of neighbours makes only branch, end
   and leaf points, with an edge of many turns between two of them. Aggregates are summed on these points; an edge's
   nodes then get their own by the words that are left below them on the edge.
3. Nodes on the path of a range's first or last sequence may go on in the next range: they stay open, as partial sums.
   `_merged` brings those of FAN neighbouring ranges together, closes what ends there and leaves the rest open, until
   one range is left. A range leaves two paths open, whatever its size, so this is little work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import parts_for, stored, tidy, work_dir

#: Bytes of a turn's digest in a path.
STEP = 16
#: Ranges whose open paths meet in one task, and conversations in a range.
FAN, RANGE_ROWS = 64, 50_000
#: Decimal numbers that travel in one row of a sequence's list of ends.
IDS_A_ROW = 8192
#: Open nodes up to this many are broadcast to name the parents of closed ones; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
CLOSED, OPEN, ENDS = 0, 1, 2

#: A closed node, an open one or a part of the list of an open one's ends. up: the parent's name where its conv_id
#: isn't known yet; children, leaves and below (tokens saved beneath the node) of an open node are of closed children.
FIELDS = {
    "kind": "tinyint", "part": "long", "place": "long", "node": "binary", "up": "binary", "conv_id": "long", "depth": "long", "parent_conv_id": "long", "n": "long", "children": "long",
    "leaves": "long", "below": "long", "own": "long", "words": "long", "left": "boolean", "right": "boolean", "ends": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
_TYPES = {"tinyint": pa.int8(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
NO_ENDS = hashlib.sha256(b"").hexdigest()


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], _TYPES[v]) for k, v in FIELDS.items()], list(FIELDS))


def node_of(path: bytes, depth: int) -> bytes:
    """Name of the node at a depth of a path."""
    return hashlib.md5(path[: depth * STEP]).digest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each with the digest of role and text (d) and the words of the text (w).

    A null turn comes first; equal turns go by their digests. A row without conv_id belongs to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("t"), digest.alias("d"), words.alias("w"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").isNotNull().alias("known"), "t", "d", "w"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, path (digests) and words (of each turn) of every conversation with its head taken from another.

    The first h turns (h: crc32 of the decimal conv_id modulo `most`) are those of conversation conv_id - conv_id % every,
    or as many as there are, or none if it is absent; the conversation's own turns after its first h follow.
    """
    own = turns_of(conversations)
    own = own.select("*", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    out = own.join(heads, "base", "left").select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), ""))
    return out.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["w"]).alias("words"))


class _Point:
    """A branch, end or leaf point. n, leaves, below and children sum what has closed beneath it; total[d]: words of its first d turns."""

    def __init__(self, path: bytes, total: list[int]):
        self.path, self.depth, self.total = path, len(path) // STEP, total
        self.conv: int | None = None
        self.n = self.own = self.leaves = self.below = self.children = 0
        self.ends: list[str] = []
        self.waiting: list[_Point] = []  # closed children that don't have their parent's conv_id yet


class _Range:
    """The trie of one range of sorted paths, built as they come. rows: what is known so far, to be taken."""

    def __init__(self, part: int):
        self.part, self.rows, self.stack = part, [], []
        self.first = b""

    def add(self, path: bytes, words: list[int], conv: int) -> None:
        """The next member, in the order of (path, conv)."""
        if not self.stack:
            self.first, self.stack = path, [_Point(b"", [0])]
        top = self.stack[-1]
        if path != top.path:
            self._end_below(_common(top.path, path), False)
            top = self.stack[-1]
        if len(path) > len(top.path):
            top = _Point(path, np.cumsum([0, *words]).tolist())
            self.stack.append(top)
        top.own += 1
        top.n += 1
        top.ends.append(str(conv))
        top.conv = conv if top.conv is None else min(top.conv, conv)

    def end(self) -> None:
        """The range is over; what is on the stack goes on in the next range perhaps."""
        if self.stack:
            self._end_below(0, True)
            self._open(self.stack.pop(), -1, True)

    def _end_below(self, depth: int, last: bool) -> None:
        """Ends the points below a depth, where a branch point is made if there is none."""
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(p.path[: depth * STEP], p.total[: depth + 1]))
            up = self.stack[-1]
            up.n += p.n
            up.conv = p.conv if up.conv is None else min(up.conv, p.conv)
            if last or self.first.startswith(p.path):
                self._open(p, up.depth, last)
                continue
            p.leaves = p.leaves or 1
            for c in p.waiting:
                self._close(c, p.depth, p.conv, None)
            p.waiting = []
            up.children += 1
            up.leaves += p.leaves
            up.below += p.below + (p.n - 1) * (p.total[p.depth] - p.total[up.depth])
            if self.first.startswith(up.path):
                self._close(p, up.depth, None, node_of(up.path, up.depth))
            else:
                up.waiting.append(p)

    def _close(self, p: _Point, above: int, parent: int | None, up: bytes | None) -> None:
        """Rows of a closed point and of the nodes on its edge: each saves what is beneath the point and the words left on the edge."""
        for d in range(above + 1, p.depth + 1):
            point, top = d == p.depth, d == above + 1
            self.rows.append({
                "kind": CLOSED, "conv_id": p.conv, "depth": d, "parent_conv_id": parent if top else p.conv, "up": up if top else None, "n": p.n, "children": p.children if point else 1, "leaves": p.leaves,
                "below": p.below + (p.n - 1) * (p.total[p.depth] - p.total[d - 1]), "ends": hashlib.sha256(",".join(p.ends).encode()).hexdigest() if point else NO_ENDS,
            })

    def _open(self, p: _Point, above: int, last: bool) -> None:
        """Rows of the open nodes on a point's edge, and of the ends of the point."""
        name = node_of(p.path, p.depth)
        for c in p.waiting:
            self._close(c, p.depth, None, name)
        for d in range(above + 1, p.depth + 1):
            sums = {"children": p.children, "leaves": p.leaves, "below": p.below, "own": p.own} if d == p.depth else {"children": 0, "leaves": 0, "below": 0, "own": 0}
            self.rows.append({
                "kind": OPEN, "part": self.part, "node": node_of(p.path, d), "up": node_of(p.path, d - 1) if d else None, "conv_id": p.conv, "depth": d, "n": p.n,
                "words": p.total[d] - p.total[d - 1] if d else 0, "left": self.first.startswith(p.path[: d * STEP]), "right": last, **sums,
            })
        for k in range(0, len(p.ends), IDS_A_ROW):
            self.rows.append({"kind": ENDS, "part": self.part, "place": k, "node": name, "ends": ",".join(p.ends[k : k + IDS_A_ROW])})


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // STEP
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // STEP


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range's trie from its sorted (path, conv_id, words)."""
    from pyspark import TaskContext

    found = _Range(TaskContext.get().partitionId())
    for batch in batches:
        for path, conv, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.add(path, words, conv)
            if len(found.rows) >= 20_000:
                yield batch_of(found.rows)
                found.rows = []
    found.end()
    yield batch_of(found.rows)


def merged(rows: list[dict], last: bool, fan: int = FAN) -> list[dict]:
    """Open nodes of neighbouring ranges as one range's: closed ones, and the open ones of its first and last path.

    last: no range is left outside, so all close.
    """
    low, high = min(r["part"] for r in rows), max(r["part"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        left, right = r["left"] and r["part"] == low, r["right"] and r["part"] == high
        got = nodes.get(r["node"])
        if got is None:
            nodes[r["node"]] = r | {"part": low // fan, "left": left, "right": right}
            continue
        for k in ("n", "children", "leaves", "below", "own"):
            got[k] += r[k]
        got["conv_id"] = min(got["conv_id"], r["conv_id"])
        got["left"], got["right"] = got["left"] or left, got["right"] or right
    still = lambda r: not last and (r["left"] or r["right"])
    out = []
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        if still(r):
            out.append(r)
            continue
        r["leaves"] = r["leaves"] if r["children"] else 1
        r["below"] += (r["n"] - 1) * r["words"]
        up = nodes.get(r["up"])
        if up is not None:
            up["children"] += 1
            up["leaves"] += r["leaves"]
            up["below"] += r["below"]
        known = up is not None and not still(up)
        out.append(r | {"kind": CLOSED, "parent_conv_id": up["conv_id"] if known else None, "up": None if known else r["up"]})
    return out


def _merge(opened: DataFrame, last: bool, fan: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch_of(merged(table.to_pylist(), last, fan))])

    return opened.groupBy(F.floor(F.col("part") / fan).alias("of")).applyInArrow(run, SCHEMA)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists of ends from their parts, which stream by in order."""
    name, digest = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends"])
    for batch in batches:
        for node, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != name:
                if name is not None:
                    yield done()
                name, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
    if name is not None:
        yield done()


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def trie(spark: SparkSession, sequences: DataFrame, range_rows: int = RANGE_ROWS, fan: int = FAN) -> DataFrame:
    """Nodes of the prefix trie of sequences (conv_id, path, words), see prefix_trie()."""
    folder = work_dir(spark, "trie")
    sequences = stored(sequences, folder + "/sequences")
    parts = parts_for(spark, sequences.count(), range_rows)
    dealt = sequences.select("path", "conv_id", "words").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    first = stored(dealt.mapInArrow(_built, SCHEMA), folder + "/first")
    opened, closed, k = first.where(F.col("kind") == OPEN), [], 0
    while opened is not None:
        last = parts <= fan
        got = stored(_merge(opened, last, fan), f"{folder}/merged-{k}")
        closed.append(got.where(F.col("kind") == CLOSED))
        opened, parts, k = None if last else got.where(F.col("kind") == OPEN), -(-parts // fan), k + 1
    merged_rows = closed[0]
    for more in closed[1:]:
        merged_rows = merged_rows.unionByName(more)
    lists = first.where(F.col("kind") == ENDS).select("node", "part", "place", "ends").repartition("node").sortWithinPartitions("node", "part", "place")
    lists = lists.select("node", "ends").mapInArrow(_hashed, "node binary, ends string")
    merged_rows = merged_rows.drop("ends").join(lists, "node", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
    names = merged_rows.select(F.col("node").alias("up"), F.col("conv_id").alias("above"))
    rows = first.where(F.col("kind") == CLOSED).unionByName(merged_rows.select(*FIELDS))
    rows = rows.join(_few(stored(names, folder + "/names")), "up", "left")
    count: dict[str, Column] = {"n_convs": F.col("n"), "n_children": F.col("children"), "n_leaves": F.col("leaves"), "saved_tokens": F.col("below"), "ends_sha256": F.col("ends")}
    return tidy(rows.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *(c.alias(n) for n, c in count.items())), folder)


def prefix_trie(spark: SparkSession, conversations: DataFrame, range_rows: int = RANGE_ROWS, fan: int = FAN) -> DataFrame:
    """A row for each node of the trie of rebuilt() conversations (conv_id, turn, role, text).

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members;
    n_children; n_leaves: childless nodes in the subtree, the node included; saved_tokens: sum over the subtree of
    (n_convs - 1) times the words of a node's text; ends_sha256: of the conv_ids that end there, in order, with commas.

    A null turn comes first, a null role or text is empty, equal turns of a conversation go by the digest of role and
    text, repeated rows are turns each, rows without conv_id are left out, other columns are ignored. A conversation is
    held in one row by 24 bytes a turn, whatever its texts' length. No conversations, no rows.
    """
    return trie(spark, rebuilt(conversations), range_rows, fan)
