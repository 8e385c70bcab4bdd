"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import decontaminate, langid, line_dedup, lm_bloom, ngram_join, packing, png_media, quality, queries, sstable, warc
from lodestrata.llm.common import work_dir
from lodestrata.llm.encode import CachedEncoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# 1


def linked(rows):
    """Smallest doc_id by row: components over all pairs."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (words(t) for _, t in rows)]
    up, inverted = list(range(len(rows))), defaultdict(list)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inverted[x])
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
        for x in s:
            inverted[x].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_near_duplicates(spark, request, name):
    docs = request.getfixturevalue(name)
    got = [tuple(r) for r in ngram_join.near_duplicates(spark, docs).collect()]
    assert order(got) == order(linked(rows_of(docs)))


def test_near_duplicate_chains_and_long_lists(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([f"x{k}_{i}" if i < k else w for i, w in enumerate(base)]) for k in range(0, 40, 2)]
    shared = [" ".join([f"p{i}" for i in range(40)] + [f"u{k}_{i}" for i in range(12)]) for k in range(40)]
    rows = [(i, t) for i, t in enumerate(texts + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.near_duplicates(spark, docs).collect()]
    assert order(got) == order(linked(rows))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for n in (30, 700, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.95 * len(a))], rng.integers(0, 1 << 63, max(1, n // 30), dtype=np.uint64)]))
        p, q = ngram_join.bitmap_of(a), ngram_join.bitmap_of(b)
        size = min(len(p), len(q))
        differ = np.array([np.bitwise_count(ngram_join.folded(p, size) ^ ngram_join.folded(q, size)).sum()])
        assert differ[0] <= len(np.setxor1d(a, b))
        assert ngram_join.may_link(np.array([len(a)]), np.array([len(b)]), differ)[0]


def test_t_occurrence_search():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40, dtype=np.uint64)) for _ in range(80)]
    index = ngram_join.ListIndex(sets)
    for q in sets[:20]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert sorted(index.search(q).tolist()) == want


# 2


def levels_of(c):
    return 1 + math.floor(math.log(c) / math.log(lm_bloom.BASE) + 1e-9) if c else 0


def lm_scores(rows):
    """Rows as evaluate() gives them, with exact levels in place of the filter."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    texts = [[*words(t), None] for _, t in rows]
    counts = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    pairs = Counter(p for t, h in zip(texts, held, strict=True) if not h for p in zip([0, *t], t, strict=False))
    n, v, begun = sum(counts.values()), len(counts), counts[None]
    least = lambda q: math.ceil(lm_bloom.BASE ** (q - 1) - 1e-9) if q else 0
    out = []
    for (d, _), h, t in zip(rows, held, texts, strict=True):
        score = 0.0
        for a, w in zip([0, *t], t, strict=False):
            own, q = least(levels_of(counts[w])), levels_of(counts[a]) if a != 0 else 0
            context = begun if a == 0 else lm_bloom.BASE**q if q else 0
            both = min(least(levels_of(pairs[a, w])), context, max(own, 1) * lm_bloom.BASE)
            score += math.log10((both + lm_bloom.MU * (own + 1) / (n + v + 1)) / (context + lm_bloom.MU))
        out.append((d, h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), score))
    return out


@pytest.mark.parametrize("name", ["documents", "edge"])
@pytest.mark.parametrize("broadcast", [True, False, "merged"])
def test_lm(spark, request, name, broadcast):
    """By broadcast or dealt, over many blocks and buckets, every figure is that of exact levels where the filter is wide."""
    docs = request.getfixturevalue(name)
    want = order(lm_scores(rows_of(docs)))
    sizes = {"block_bytes": 60_000, "bucket_bytes": 20_000} | ({} if broadcast is True else {"broadcast_text": 0})
    sizes |= {"block_bytes": 9_000, "fan": 3, "first_buckets": 4} if broadcast == "merged" else {}
    for bits in (60, lm_bloom.BITS_AN_ENTRY):
        got = order(tuple(r) for r in lm_bloom.evaluate(spark, docs, bits_an_entry=bits, **sizes).collect())
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
        # A false positive now and then makes an unseen n-gram look seen once.
        assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-9 if bits == 60 else 0.01)
    if name == "documents":
        assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_lm_broadcast_and_dealt_scores_are_equal(spark, documents):
    a, b = (order(tuple(r) for r in lm_bloom.evaluate(spark, documents, n).collect()) for n in (lm_bloom.BROADCAST_TEXT, 0))
    assert [r[:5] for r in a] == [r[:5] for r in b] and [r[5:] for r in a] == [pytest.approx(r[5:], rel=1e-12) for r in b]


@pytest.mark.parametrize("copies", [10, 1000])
def test_lm_asks_of_a_bucket_do_not_grow_with_the_blocks(spark, tmp_path, monkeypatch, copies):
    """A text in every block: what reaches its buckets comes from a bounded number of askers, and all scores are equal."""
    docs = spark.range(copies, numPartitions=4).selectExpr("id AS doc_id", "'the same old words of the text' AS text", "true AS train")
    blocks = docs.withColumn("block", F.col("doc_id")).orderBy("doc_id")
    seen, real = [], lm_bloom.answers_of
    monkeypatch.setattr(lm_bloom, "answers_of", lambda asks, bits: seen.append(asks.groupBy("bucket", "n").count().agg(F.max("count")).first()[0]) or real(asks, bits))
    out, model = lm_bloom.dealt_scores(blocks, 16, str(tmp_path), 60, fan=8, first_buckets=2)
    got = out.collect()
    assert seen[0] <= 8 and model.tokens == 8 * copies and model.distinct == 7 and model.texts == copies
    assert len(got) == copies and len({tuple(r)[1:] for r in got}) == 1 and got[0]["n_known"] == 8


def test_log_bloom_levels():
    h = np.random.default_rng(3).integers(0, 1 << 63, 4000, dtype=np.uint64)
    level = 1 + np.arange(len(h)) % 9
    bloom = lm_bloom.LogBloom.of(h, level)
    assert (bloom.levels(h) >= level).all() and (bloom.levels(h) == level).mean() > 0.98
    assert lm_bloom.level_of(np.array([0, 1, 2, 3, 1000])).tolist() == [levels_of(c) for c in (0, 1, 2, 3, 1000)]


# 3


def test_warc_audit_finds_the_damage(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nx", "<p>é</p>" * (i % 50)) for i in range(700)] + [(None, None, None), (3, "u", "same"), (3, "u", "same")], "page_id long, url string, html string")
    out = warc.drill(spark, pages, F.col("key").cast("long") % 100 == 7).collect()
    assert len(out) == 703 and {r["page_id"] for r in out if not r["intact"]} == {7, 107, 207, 307, 407, 507, 607}
    want = Counter((r["page_id"], len((r["html"] or "").encode()), hashlib.sha256((r["html"] or "").encode()).hexdigest()) for r in pages.collect())
    assert Counter((r["page_id"], r["n_bytes"], r["payload_sha256"]) for r in out) == want
    assert all(r["intact"] for r in warc.drill(spark, pages).collect())
    assert warc.drill(spark, pages.where("page_id < 0")).count() == 0


def test_warc_missing_short_longer_and_unknown_shards(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 500) for i in range(100)], "page_id long, url string, html string").repartition(5)
    folder = work_dir(spark, "t")
    index = warc.write_shards(pages, folder + "/a").cache()
    copied = warc.replicate(index, folder + "/a", folder + "/b")
    assert copied.rdd.getNumPartitions() >= 4  # many shards are many tasks' work, however short their index
    copied.collect()
    files = sorted(x for x in Path(folder.removeprefix("file://"), "b").iterdir() if x.name.endswith(".warc.gz"))
    files[0].unlink()
    files[1].write_bytes(files[1].read_bytes()[:-10])
    files[2].write_bytes(files[2].read_bytes() + b"more")
    files[3].with_name("other.warc.gz").write_bytes(b"x")
    _, bad, odd = warc.audit(index, folder + "/a", folder + "/b", folder + "/x")
    got = Counter(r["shard"] for r in bad.collect())
    sizes = Counter(r["shard"] for r in index.collect())
    assert got == {files[0].name: sizes[files[0].name], files[1].name: 1}
    assert {(r["shard"], r["problem"]) for r in odd.collect()} == {(files[2].name, "size"), ("other.warc.gz", "unknown")}


def test_warc_ranges_are_part_of_the_hashes():
    assert warc._leaf("s", 0, 0, 5, b"x") != warc._leaf("s", 0, 0, 6, b"x") and warc._node(1, 0, 0, 5, ["a"]) != warc._node(1, 0, 1, 5, ["a"])


# 4


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_png_round_trip(request, name):
    docs = request.getfixturevalue(name)
    want = []
    for d, t in rows_of(docs):
        n, payload = png_media.payload_of(t)
        assert len(payload) % 192 == 0 and payload.rstrip(b" ") == (t or "").encode().rstrip(b" ")
        want.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = png_media.features(png_media.store(docs)).collect()
    assert order([tuple(r[:5]) for r in got]) == order(want)


def naive_png(png):
    """Rows of samples by the format's own words: chunks, zlib, one pixel after the other."""
    at, data = 8, b""
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height, channels = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), {0: 1, 2: 3}[body[9]]
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, size = zlib.decompress(data), width * channels
    above, out = bytes(size), []
    for y in range(height):
        kind, line = raw[y * (size + 1)], bytearray(raw[y * (size + 1) + 1 : (y + 1) * (size + 1)])
        for x in range(size):
            a, b, c = line[x - channels] if x >= channels else 0, above[x], above[x - channels] if x >= channels else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, paeth)[kind]) % 256
        above = bytes(line)
        out.append(above)
    return width, channels, out


def naive_hash(width, channels, rows):
    grey = [[sum(r[x * channels : (x + 1) * channels]) / channels for x in range(width)] for r in rows]

    def share(m):
        n = len(m)
        cuts = [(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
        return [[sum(m[k][j] for k in range(a, b)) / (b - a) for j in range(len(m[0]))] for a, b in cuts]

    small = [list(c) for c in zip(*share([list(c) for c in zip(*share(grey), strict=True)]), strict=True)]
    cos = [[math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(small[y][x] * cos[u][y] * cos[v][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sum(sorted(low)[31:33]) / 2
    return int("".join("1" if v > middle else "0" for v in low), 2)


def test_media_against_a_plain_reader(spark, documents):
    """Payload, media digest and feature from the stored bytes, pixel by pixel and term by term."""
    media = {r["doc_id"]: bytes(r["media"]) for r in png_media.store(documents).collect()}
    got = {r["doc_id"]: r for r in queries.op4_media_columns(spark, "/root/testdata/sf0.001").collect()}
    texts, close = dict(rows_of(documents)), 0
    for d in [d for d in sorted(media) if len(texts[d] or "") < 6000][:40]:
        width, channels, rows = naive_png(media[d])
        assert b"".join(rows) == png_media.payload_of(texts[d])[1]
        assert (got[d]["media_bytes"], got[d]["media_sha256"]) == (len(media[d]), hashlib.sha256(media[d]).hexdigest())
        # Terms beside the median may round to the other side of it.
        close += bin(naive_hash(width, channels, rows) ^ int(got[d]["feature"], 16)).count("1") <= 2
    assert close == 40


def test_png_filters_and_damage():
    rng = np.random.default_rng(4)
    for rows in (1, 2, 30, 100):
        payload = rng.integers(0, 255, 192 * rows, dtype=np.uint8).tobytes()
        for kind in (None, *range(5)):
            for width, channels in ((64, 3), (192, 1)):
                png = png_media.encode(payload, width, channels, kind)
                assert png_media.decode(png).tobytes() == payload == b"".join(naive_png(png)[2])
    steps = np.cumsum(rng.integers(0, 3, (40, 192)), axis=1).astype(np.uint8).tobytes() + b"the same row. " * 300
    steps = steps[: len(steps) // 192 * 192]
    many = png_media.encode_all([steps, payload, steps[:192], steps + payload])
    assert [x.tobytes() for x in png_media.decode_all(many)] == [steps, payload, steps[:192], steps + payload]
    assert len(set(png_media.parsed(many[0])[0][:, 0].tolist())) > 1  # rows of one image differ in their filter
    for at in (20, 60, len(png) - 20):
        hurt = bytearray(png)
        hurt[at] ^= 1
        with pytest.raises(ValueError):
            png_media.decode(bytes(hurt))


# 5


def hits_of(text, items, n=10):
    w, hit, found = TERM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        q = TERM.findall((t or "").translate(LOWER))
        k = min(n, len(q))
        windows = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_decontamination(spark, request, name):
    docs = request.getfixturevalue(name)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    if name == "edge":
        bench = spark.createDataFrame([(1, "one TWO"), (2, None), (3, ""), (4, "line that all of these texts share, word for word and more"), (4, "漢字"), (5, "word5 and5 word6 and6 word7 and7 word8 and8 word9 and9 word10 and10")], "item_id long, text string")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    out = decontaminate.matches(spark, docs, bench).collect()
    assert order([(r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in out]) == order([(d, *hits_of(t, items)) for d, t in rows_of(docs)])
    assert any(r["hits"] for r in out)


def near_of(texts, items, most=4, least=3, span=50):
    docs = [TERM.findall((t or "").translate(LOWER)) for t in texts]
    df, found = Counter(w for d in docs for w in d), [set() for _ in docs]
    for item, t in items:
        q = TERM.findall((t or "").translate(LOWER))
        k = min(10, len(q))
        rare = {w for i in range(len(q) - k + 1) for w in sorted({x for x in q[i : i + k] if df[x]}, key=lambda x: (df[x], x.encode()))[:most]} if k else set()
        for d, f in zip(docs, found, strict=True):
            if rare and any(len(rare.intersection(d[i : i + span])) >= min(least, len(set(q))) for i in range(len(d)) if d[i] in rare):
                f.add(str(item))
    return [sorted(f) for f in found]


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_proximity(spark, request, name):
    docs = request.getfixturevalue(name)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    if name == "edge":
        bench = spark.createDataFrame([(1, "one TWO"), (2, None), (3, ""), (4, "line nowhere1 these texts all that nowhere2 share nowhere3 word"), (5, "漢字"), (6, "nowhere1 nowhere2 nowhere3")], "item_id long, text string")
    items, rows = [tuple(r) for r in bench.select("item_id", "text").collect()], rows_of(docs)
    got = decontaminate.proximity(spark, docs, bench).select("doc_id", "near").collect()
    want = [(d, n) for (d, _), n in zip(rows, near_of([t for _, t in rows], items), strict=True)]
    assert order(tuple(r) for r in got) == order(want) and any(n for _, n in want)
    if name == "edge":
        near, exact = {r["doc_id"]: r["near"] for r in got}, {r["doc_id"]: r["items"] for r in decontaminate.matches(spark, docs, bench).collect()}
        assert near[4] == ["1"] and near[8] == ["5"] and near[10] == ["4"] and exact[10] == []


# 6


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_sstable(spark, request, name):
    docs, tok = request.getfixturevalue(name), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = sorted(sstable.token_table(spark, docs, public_tokenizers.path("word_bpe_49k.json")).collect(), key=lambda r: r["start"])
    want = {}
    for d, t in rows_of(docs):
        raw = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.setdefault(d, []).append((len(raw) // 4, zlib.crc32(raw)))
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_added_tokens_as_the_library_has_them_by_default(file, kind):
    path = public_tokenizers.path(file)
    tok = Tokenizer.from_file(path)
    texts = ["abc <|endoftext|> def", "<|endoftext|>", "a<|startoftext|>b", "x <|ENDOFTEXT|> y", "<|endoftext", "plain words 12", "", None]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert CachedEncoder(path, kind)(texts) == want


def test_sstable_lookup(spark, documents):
    folder = work_dir(spark, "t")
    shards = sstable.write_shards(documents, folder, public_tokenizers.path("word_bpe_49k.json")).collect()
    readers = [sstable.ShardReader(r["path"]) for r in shards]
    for d in (0, 17, 199):
        assert sum(len(x.get(d)) for x in readers) == documents.where(F.col("doc_id") == d).count()
    assert not any(x.get(10**12) for x in readers)


# 7


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_line_dedup(spark, request, name):
    docs = request.getfixturevalue(name)
    rows = rows_of(docs)
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for _, t in rows]
    seen = Counter(k for row in keys for k in set(row) if k)
    want = []
    for (d, t), row in zip(rows, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), row, strict=True) if not k or seen[k] < 10]
        want.append((d, "\n".join(kept), len(row), len(row) - len(kept)))
    got = line_dedup.dedup_corpus(spark, docs, min_docs=10)
    assert set(docs.columns) <= set(got.columns)
    assert order([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]) == order(want)


def test_line_runs_compact_and_anti_join(spark):
    runs = line_dedup.LineRuns(spark, work_dir(spark, "t"), fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(k, f"same\nnew {k}")], "doc_id long, text string")
        out = line_dedup.dedup_batch(runs, batch).first()
        assert out["text"] == (f"same\nnew {k}" if k == 0 else f"new {k}")
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.counts().agg(F.max("docs")).first()[0] == 5
    plan = runs.counts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert runs.counts().count() == 0


def test_lines_are_summed_before_they_are_dealt(spark, documents):
    plan = line_dedup.LineRuns(spark, work_dir(spark, "runs"))._counted(documents)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"functions=\[count\(1\)\](.|\n)*Exchange hashpartitioning\(hash(.|\n)*functions=\[partial_count", plan)


def test_line_dedup_of_one_text_with_very_many_lines(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(n))), (2, "\n".join(f"l{i}" for i in range(0, n, 2)))], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_corpus(spark, docs, min_docs=2).collect()}
    assert time.time() - began < 60
    assert got[1]["text"] == "\n".join(f"l{i}" for i in range(1, n, 2)) and got[1]["n_dropped"] == n // 2 and got[2]["text"] == ""


@pytest.mark.parametrize("name", ["op3_warc_merkle_audit", "op7_line_dedup"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert order(map(tuple, got)) == order(want.fetchall())


# 8


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_packing(spark, request, name):
    docs, tok = request.getfixturevalue(name), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    texts = defaultdict(list)
    for d, t in rows_of(docs):
        texts[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    for d, many in texts.items():
        got = Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == d)
        want = Counter()
        for ids in many:
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert got == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= math.ceil(sum(r["length"] for r in out) / 2048) * 1.03 + 2


def test_packing_plan_serves_every_piece():
    rng = np.random.default_rng(5)
    for most in (30, 700, 2048):
        histogram = Counter(rng.integers(1, most + 1, 3000).tolist())
        served = Counter()
        for pattern, times in packing.plan(histogram):
            assert sum(pattern) <= 2048
            for n in pattern:
                served[n] += times
        assert served == histogram
    assert packing.plan({}) == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_packing_reaches_the_lower_bound(sf):
    encode, histogram = CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte"), Counter()
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()]
    for at in range(0, len(texts), 256):
        for raw in encode(texts[at : at + 256]):
            n = len(raw) // 4 + 1
            histogram[n % 2048] += 1
            histogram[2048] += n // 2048
    histogram.pop(0, None)
    assert sum(k for _, k in packing.plan(histogram)) == -(-sum(n * c for n, c in histogram.items()) // 2048)


def test_packing_ties(spark):
    """Rows that share doc_id, piece and length but not their ids have places of their own, the same on every run."""
    docs = spark.createDataFrame([(1, t) for t in ("a b", "c d", "e f", "a b")] + [(None, "g h")] * 3, "doc_id long, text string")
    runs = [order(map(tuple, packing.pack(spark, docs.repartition(k), public_tokenizers.path("byte_bpe_50k.json")).collect())) for k in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 7


@pytest.mark.parametrize("times", [1, 100])
def test_packing_goes_through_the_program(times):
    """At least nine of ten pieces are placed by rounded patterns, and hardly any room is lost."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id % 4 = 0").fetchall()
    encode, histogram = CachedEncoder(path, "byte"), Counter()
    for at in range(0, len(texts), 256):
        for raw in encode([t for (t,) in texts[at : at + 256]]):
            n = len(raw) // 4 + 1
            histogram[n % 2048] += times
            histogram[2048] += n // 2048 * times
    histogram.pop(0, None)
    short = {n: c for n, c in histogram.items() if n < 2048}
    patterns, left = packing.rounded(short)
    assert sum(left.values()) <= 0.1 * sum(short.values())
    served = Counter(left)
    for pattern, k in patterns.items():
        assert sum(pattern) <= 2048
        for n in pattern:
            served[n] += k
    assert served == short
    if times == 1:
        assert sum(k for _, k in packing.plan(histogram)) <= 1.002 * sum(n * c for n, c in histogram.items()) / 2048 + 2


# 9, 10


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edge(spark, edge, empty):
    got = langid.identify(spark, edge).collect()
    assert len(got) == edge.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in langid.predict(edge, None).collect()} == {"und"}


def test_letters_are_unicode_letters():
    assert not any(map(langid.has_letter, ("½ ²", "①", "12_3", "Ⅷ", "", "!?")))
    assert all(map(langid.has_letter, ("a", "12 é", "漢", "ª", "1 ǅ")))


def test_every_language_is_learned(spark):
    """More languages than any cap would keep, one of them in a single row that the others repeat."""
    rows = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (k + j) % 26)}" for j in range(60)), f"l{k:02}") for i, k in enumerate(k for k in range(70) for _ in range(3))]
    docs = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string, lang string")
    assert len(langid.fit(docs).languages) == 70


def test_shares_joined_by_shuffle_draw_the_same_texts(spark, monkeypatch):
    """Beyond its bound the table of shares isn't broadcast; the network stays the same."""
    docs = spark.createDataFrame([(i, f"{w} {i} {w}", w) for i in range(200) for w in ("ja", "nein")], "doc_id long, text string, lang string")
    want = langid.fit(docs, docs_a_language=20)
    monkeypatch.setattr(langid, "BROADCAST_BYTES", -1)
    got = langid.fit(docs, docs_a_language=20)
    assert got.languages == want.languages == ["ja", "nein"] and np.array_equal(got.out, want.out) and np.array_equal(got.emb, want.emb)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    # Learned from half of the labels, judged on the other half.
    half = F.xxhash64("doc_id") % 2 == 0
    out = quality.classify(spark, docs, labels.where(half), carry_text=False).join(labels.where(~half), "doc_id").select("p_low", "p_toxic", "quality", "toxic").toPandas()
    assert ((out["p_low"] >= 0.5) == (out["quality"] == 0)).mean() > 0.85
    assert ((out["p_toxic"] >= 0.5) == (out["toxic"] == 1)).mean() > 0.95


def test_rows_that_share_a_labelled_doc_id_teach_once(spark):
    docs = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(8, "other"), (8, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1)], "doc_id long, quality long, toxic long")
    got = quality._train_rows(docs, labels).collect()
    assert sorted((r["low"], r["toxic"]) for r in got) == [(0, 0), (1, 1)]


def test_quality_edge(spark, edge):
    labels = spark.createDataFrame([(None, 1, 0), (4, None, None), (4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(spark, edge, labels).count() == edge.count()
    assert quality.classify(spark, edge, labels.where("false")).count() == edge.count()


# all


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path
    for out in (
        ngram_join.near_duplicates(spark, empty),
        lm_bloom.evaluate(spark, empty),
        png_media.features(png_media.store(empty)),
        decontaminate.matches(spark, empty, none),
        sstable.token_table(spark, empty, path("word_bpe_49k.json")),
        line_dedup.dedup_corpus(spark, empty),
        packing.pack(spark, empty, path("byte_bpe_50k.json")),
        langid.identify(spark, empty),
        quality.classify(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")),
    ):
        assert out.count() == 0


def test_extra_columns_with_clashing_names(spark, edge, edge_rows):
    extra = edge.select("*", *(F.lit(1).alias(c) for c in ("c", "n", "hash", "key", "hits", "n_words", "items", "n_lines", "length", "__row", "p_low", "keep", "prior_low", "term", "hn")))
    bench = spark.createDataFrame([(1, "one two", 5)], "item_id long, text string, n int")
    labels = spark.createDataFrame([(4, 1, 0, 2), (6, 0, 1, 2)], "doc_id long, quality int, toxic int, n int")
    for out in (
        ngram_join.near_duplicates(spark, extra),
        lm_bloom.evaluate(spark, extra),
        png_media.store(extra),
        decontaminate.matches(spark, extra, bench),
        line_dedup.dedup_corpus(spark, extra),
        langid.identify(spark, extra),
        quality.classify(spark, extra, labels),
    ):
        assert out.count() == len(edge_rows)
