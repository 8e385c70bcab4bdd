"""Merkle fixity audit of WARC replicas.

Pages become WARC shards (a gzip member for each record, as usual for .warc.gz). The index of the primary names
each record's offset range. A replica is a byte-identical copy, so its bytes at the same ranges must hash alike:
a leaf hashes its place, its offset range and the bytes there, a node its place, the range that it covers and its
FANOUT ordered children, and a shard's root the top node and the file's size. Roots are compared by shard; only
children of nodes that differ are looked at, down to records. Bytes beyond the last record change the size and so
the root alone; files that the index doesn't name have no root to compare with. Both are reported beside records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import file_system, parts_for, stored, task_name, tidy, work_dir

FANOUT = 16
#: Leaves that one task hashes into a subtree of three levels.
SUBTREE, SUBTREE_LEVELS = FANOUT**3, 3
SHARD_BYTES = 32 << 20
#: Bytes of shards that one task copies or hashes.
TASK_BYTES = 16 << 20
#: Differing nodes up to this many are broadcast to the next level; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
INDEX = "shard string, seq long, key string, offset long, length long"
NODES = "level int, shard string, idx long, first long, last long, hash string, n_bytes long, payload_sha256 string"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_of(key: str | None, url: str | None, body: bytes) -> bytes:
    """A WARC/1.1 resource record as one gzip member. The same input gives the same bytes."""
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    digest = hashlib.sha256(body).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}|{target}|{digest}")
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Target-URI: {target}\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 6, mtime=0)


def payload_of(member: bytes) -> bytes:
    """The payload of a record; ValueError if the member or the record is damaged."""
    try:
        raw = gzip.decompress(member)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError("gzip member") from e
    head, found, rest = raw.partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", head)
    if not head.startswith(b"WARC/1.") or not found or not size or len(rest) != int(size[1]) + 4:
        raise ValueError("WARC record")
    return rest[:-4]


def write_shards(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes pages as WARC shards below folder and returns their index (shard, seq, key, offset, length).

    Pages stay where they were read: there is no shuffle. Each attempt of a task writes files of its own; only
    the successful one's are in the index. Null or empty bodies are empty payloads; no pages make no shards.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name, shards, out, at, seq = task_name(), 0, None, 0, 0
        for part in parts:
            rows = []
            for k, u, b in zip(part["key"], part["url"], part["body"], strict=True):
                if out is None:
                    shard, at, seq = f"{name}-{shards:05d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{shard}", compression=None)
                raw = record_of(k, u, (b or "").encode())
                out.write(raw)
                rows.append((shard, seq, k, at, len(raw)))
                at, seq = at + len(raw), seq + 1
                if at >= shard_bytes:
                    out.close()
                    out, shards = None, shards + 1
            yield pd.DataFrame(rows, columns=["shard", "seq", "key", "offset", "length"])
        if out is not None:
            out.close()

    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(body).cast("string").alias("body"))
    return rows.mapInPandas(write, INDEX)


def replicate(index: DataFrame, source: str, target: str, damage: Column | None = None) -> DataFrame:
    """Copies all shards to another folder, a shard in each task's hands at a time; returns shard and bytes.

    damage: for drills, a condition on index rows; one byte in the middle of such a record is flipped.
    """
    hurt = F.lit(False) if damage is None else F.coalesce(damage, F.lit(False))
    shards = index.repartition(_tasks(index), "shard").groupBy("shard").agg(F.max(F.col("offset") + F.col("length")).alias("size"), F.collect_list(F.when(hurt, F.col("offset") + F.col("length").cast("long") / F.lit(2)).cast("long")).alias("flips"))

    def copy(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fs, path), (to_fs, to) = file_system(source), file_system(target)
        to_fs.create_dir(to, recursive=True)
        for part in parts:
            for shard, flips in zip(part["shard"], part["flips"], strict=True):
                at, name = 0, f"{to}/{shard}.{uuid.uuid4().hex[:8]}"
                with fs.open_input_stream(f"{path}/{shard}", compression=None) as read, to_fs.open_output_stream(name, compression=None) as out:
                    while block := read.read(1 << 20):
                        block = bytearray(block)
                        for x in flips:
                            if at <= x < at + len(block):
                                block[x - at] ^= 0xFF
                        out.write(bytes(block))
                        at += len(block)
                to_fs.move(name, f"{to}/{shard}")
                yield pd.DataFrame({"shard": [shard], "bytes": [at]})

    return shards.mapInPandas(copy, "shard string, bytes long")


def _leaf(shard: str, seq: int, at: int, end: int, raw: bytes) -> str:
    return hashlib.sha256(f"{shard}|{seq}|{at}|{end}|".encode() + raw).hexdigest()


def _node(level: int, idx: int, first: int, last: int, hashes: list[str]) -> str:
    return hashlib.sha256(f"{level}|{idx}|{first}|{last}|{''.join(hashes)}".encode()).hexdigest()


def _tasks(index: DataFrame) -> int:
    """Tasks that the bytes of the shards ask for; the index itself is too small to tell."""
    return parts_for(index.sparkSession, index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], TASK_BYTES)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """shard and size of the files that a folder holds now; their content is not read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "shard string, size long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.substring_index("path", "/", -1).alias("shard"), F.col("length").alias("size"))


def hash_tree(index: DataFrame, folder: str, parse: bool = False) -> DataFrame:
    """Nodes of every shard's tree up to its root, from the bytes that a replica's folder holds now.

    level 0 are records (idx is seq), a node of level k covers FANOUT of level k - 1; first and last bound its
    offset range. A missing or short file hashes as what is there. With `parse`, leaves also tell their payload's
    length and digest (null where the record is damaged). A task reads SUBTREE records of a shard and gives
    the nodes of their subtree; what is above them is grouped, FANOUT rows a group.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = file_system(folder)
        state: dict = {"shard": None, "file": None}
        leaves: list[tuple] = []

        def subtree() -> pd.DataFrame:
            shard, rows = leaves[0][0], []
            now = [(seq, at, end, h) for _, seq, at, end, h, _, _ in leaves]
            rows += [(0, shard, seq, at, end, h, n, p) for _, seq, at, end, h, n, p in leaves]
            for level in range(1, SUBTREE_LEVELS + 1):
                groups: dict[int, list[tuple]] = {}
                for x in now:
                    groups.setdefault(x[0] // FANOUT, []).append(x)
                now = [(i, g[0][1], g[-1][2], _node(level, i, g[0][1], g[-1][2], [x[3] for x in g])) for i, g in groups.items()]
                rows += [(level, shard, *x, None, None) for x in now]
            return pd.DataFrame(rows, columns=["level", "shard", "idx", "first", "last", "hash", "n_bytes", "payload_sha256"]).astype({"n_bytes": "Int64"})

        for part in parts:
            for shard, seq, at, length in zip(part["shard"], part["seq"], part["offset"], part["length"], strict=True):
                if leaves and (leaves[0][0] != shard or leaves[0][1] // SUBTREE != seq // SUBTREE):
                    yield subtree()
                    leaves = []
                if state["shard"] != shard:
                    if state["file"] is not None:
                        state["file"].close()
                    try:
                        state = {"shard": shard, "file": fs.open_input_file(f"{path}/{shard}")}
                    except FileNotFoundError:
                        state = {"shard": shard, "file": None}
                raw, n, digest = b"", None, None
                if state["file"] is not None and at < state["file"].size():
                    state["file"].seek(at)
                    raw = state["file"].read(length)
                if parse:
                    try:
                        body = payload_of(raw)
                        n, digest = len(body), hashlib.sha256(body).hexdigest()
                    except ValueError:
                        pass
                leaves.append((shard, seq, at, at + length, _leaf(shard, seq, at, at + length, raw), n, digest))
        if leaves:
            yield subtree()
        if state["file"] is not None:
            state["file"].close()

    dealt = index.select("shard", "seq", "offset", "length", F.floor(F.col("seq") / SUBTREE).alias("part")).repartition(_tasks(index), "shard", "part").sortWithinPartitions("shard", "seq")
    return dealt.select("shard", "seq", "offset", "length").mapInPandas(run, NODES)


def climb(nodes: DataFrame, top: int) -> list[DataFrame]:
    """The levels above the subtrees, up to `top`, by grouped aggregation."""
    out, now = [], nodes.where(F.col("level") == SUBTREE_LEVELS)
    for level in range(SUBTREE_LEVELS + 1, top + 1):
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")
        now = now.groupBy("shard", F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.min("first").alias("first"), F.max("last").alias("last"), kids.alias("kids"))
        digest = F.sha2(F.concat_ws("|", F.lit(str(level)), F.col("up").cast("string"), F.col("first").cast("string"), F.col("last").cast("string"), "kids"), 256)
        now = now.select("shard", F.col("up").alias("idx"), "first", "last", digest.alias("hash"))
        out.append(now)
    return out


def stored_tree(index: DataFrame, replica: str, folder: str, top: int, parse: bool = False) -> list[DataFrame]:
    """A replica's tree as one stored table a level, root first; the roots hash the top nodes and the files' sizes.

    Levels are folders of their own, so a comparison reads no level that it doesn't reach.
    """
    spark = index.sparkSession
    hash_tree(index, replica, parse).write.partitionBy("level").parquet(folder + "/low")
    schema = ", ".join(c for c in NODES.split(", ") if not c.startswith("level "))
    low = [spark.read.schema(schema).parquet(f"{folder}/low/level={k}") for k in range(SUBTREE_LEVELS + 1)]
    high = [stored(x, f"{folder}/{SUBTREE_LEVELS + 1 + k}") for k, x in enumerate(climb(low[-1].withColumn("level", F.lit(SUBTREE_LEVELS)), top))]
    head = (high or low)[-1].select("shard", "idx", "hash")
    sized = head.join(files_of(spark, replica), "shard", "left")
    roots = sized.select("shard", "idx", F.sha2(F.concat_ws("|", "hash", F.coalesce(F.col("size").cast("string"), F.lit("none"))), 256).alias("hash"))
    return [stored(roots, folder + "/roots"), *reversed(high), *reversed(low)]


def height(index: DataFrame) -> int:
    """Levels that bring the largest shard to one root."""
    most, top = index.agg(F.max("seq")).first()[0] or 0, SUBTREE_LEVELS
    while FANOUT**top <= most:
        top += 1
    return top


def descend(ours: list[DataFrame], theirs: list[DataFrame], folder: str) -> tuple[DataFrame, DataFrame]:
    """Records (shard, seq) whose hash differs, and shards whose root differs, from the roots down; lists are root first.

    A level is joined only below nodes that differ, so agreeing shards end at their roots. The first step below
    the roots is to the top nodes, which have the roots' places.
    """
    bad = roots = None
    for k, (a, b) in enumerate(zip(ours, theirs, strict=True)):
        a, b = a.select("shard", "idx", "hash"), b.select("shard", "idx", F.col("hash").alias("other"))
        if bad is not None:
            n = bad.count()
            if not n:
                return bad.select("shard", F.col("idx").alias("seq")), roots
            few = bad.select("shard", F.col("idx").alias("up"))
            few = F.broadcast(few) if n <= BROADCAST_ROWS else few
            up = F.col("idx") if k == 1 else F.floor(F.col("idx") / FANOUT)
            a = a.withColumn("up", up).join(few, ["shard", "up"], "left_semi").drop("up")
            b = b.withColumn("up", up).join(few, ["shard", "up"], "left_semi").drop("up")
        bad = stored(a.join(b, ["shard", "idx"], "left").where(~F.col("hash").eqNullSafe(F.col("other"))).select("shard", "idx"), f"{folder}/{k}")
        roots = bad.select("shard") if roots is None else roots
    return bad.select("shard", F.col("idx").alias("seq")), roots


def audit(index: DataFrame, primary: str, replica: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves of the primary (with payload length and digest), the records (shard, seq) in which the replica differs, and its odd files.

    Odd files: shard and problem. "size" is a shard whose size alone differs (every record agrees, bytes follow the
    last one or are lost after it), "unknown" a file that the index doesn't name. An index without rows has no
    leaves, and every file is unknown.
    """
    spark = index.sparkSession
    known = index.select("shard").distinct()
    unknown = files_of(spark, replica).join(known, "shard", "left_anti").select("shard", F.lit("unknown").alias("problem"))
    if index.isEmpty():
        return spark.createDataFrame([], NODES), spark.createDataFrame([], "shard string, seq long"), unknown
    top = height(index)
    ours, theirs = stored_tree(index, primary, folder + "/ours", top, parse=True), stored_tree(index, replica, folder + "/theirs", top)
    records, roots = descend(ours, theirs, folder + "/bad")
    size = roots.join(records.select("shard").distinct(), "shard", "left_anti").select("shard", F.lit("size").alias("problem"))
    return ours[-1], records, size.unionByName(unknown)


def drill(spark: SparkSession, pages: DataFrame, damage: Column | None = None) -> DataFrame:
    """Writes pages (page_id, url, html), copies the shards with some records damaged, and audits the copy.

    damage is a condition on `key`, the page_id as text. Returns page_id, n_bytes, payload_sha256 (read back
    from the primary), shard, seq and intact. Null columns are empty, a null page_id stays null, repeated rows
    are records of their own, other columns are ignored, and no pages give no rows.
    """
    folder = work_dir(spark, "warc")
    index = stored(write_shards(pages, folder + "/a"), folder + "/index")
    copied = stored(replicate(index, folder + "/a", folder + "/b", damage), folder + "/copied")
    copied.count()
    leaves, bad, _ = audit(index, folder + "/a", folder + "/b", folder + "/audit")
    marked = bad.select("shard", "seq", F.lit(True).alias("bad"))
    marked = F.broadcast(marked) if bad.count() <= BROADCAST_ROWS else marked
    names = index.select("shard", "seq", "key")
    out = leaves.select("shard", F.col("idx").alias("seq"), "n_bytes", "payload_sha256").join(names, ["shard", "seq"]).join(marked, ["shard", "seq"], "left")
    return tidy(out, folder, keep=("audit",)).select(F.col("key").cast("long").alias("page_id"), "n_bytes", "payload_sha256", "shard", "seq", F.col("bad").isNull().alias("intact"))
