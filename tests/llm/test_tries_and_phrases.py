"""HyperMinHash, prefix trie and collocations against brute force and SQL, and on edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import collocations, hyperminhash, prefix_trie, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


# 12


def linked(rows, n=3, percent=85):
    texts = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset() for w in texts]
    up, inverted = list(range(len(rows))), defaultdict(list)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in inverted[x]).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
        for x in s:
            inverted[x].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    roots = [min(least[find(i)], default=None) for i in range(len(rows))]
    return [(d, len(sets[i]), roots[i], d == roots[i]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_hyperminhash(spark, request, name):
    docs = request.getfixturevalue(name)
    got = hyperminhash.near_duplicates(spark, docs).collect()
    assert order(got) == order(linked([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_hyperminhash_at_the_threshold_chains_and_long_lists(spark):
    """Chains of copies that each change a little, sets of 3 to 60 shingles around 0.85, and a passage that many share."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"x{k}_{i}" if i < k else w for i, w in enumerate(base)) for k in range(0, 60, 2)]
    for n in range(5, 63):
        one = [f"a{n}_{i}" for i in range(n)]
        texts += [" ".join(one), " ".join([*one, f"b{n}"]), " ".join([*one[1:], f"c{n}"])]
        other = [w if rng.random() > 0.02 else w + "z" for w in one]
        texts += [" ".join(other)]
    texts += [" ".join([f"p{i}" for i in range(60)] + [f"u{k}_{i}" for i in range(int(rng.integers(1, 20)))]) for k in range(60)]
    rows = list(enumerate(texts))
    got = hyperminhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(got) == order(linked(rows))


def test_estimates_are_corrected_and_keep_links():
    rng = np.random.default_rng(4)
    for n in (1, 3, 20, 200, 5000):
        errors = []
        for share in (0.0, 0.5, 0.85, 1.0):
            for _ in range(20):
                common = int(round(2 * n * share / (1 + share)))
                s = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
                a, b = s[:n], np.concatenate([s[:common], s[n : 2 * n - common]])
                agree = np.array([(hyperminhash.registers(a) == hyperminhash.registers(b)).sum()])
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                errors.append(hyperminhash.estimate(agree, [len(a)], [len(b)])[0] - true)
                assert true < 0.85 or hyperminhash.may_link(agree, [len(a)], [len(b)])[0]
        assert n < 20 or abs(np.mean(errors)) < 0.03
    assert (hyperminhash.collisions([5000], [5000]) < 0.01).all()


def test_registers_are_zeros_and_mantissa_and_empty_buckets_are_drawn_alike():
    a = np.array([5], np.uint64)
    assert len(set(hyperminhash.registers(a).tolist())) == 1
    many = np.arange(100_000, dtype=np.uint64)
    zeros = hyperminhash.registers(many) >> hyperminhash.MANTISSA
    assert 7 < np.median(zeros) < 12  # 625 hashes a bucket
    shared = np.arange(40, dtype=np.uint64)
    agree = hyperminhash.registers(shared) == hyperminhash.registers(np.r_[shared, np.uint64(99)])
    assert agree.mean() > 0.9


# 11


def trie_of(rows, every=20, most=4):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, d, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        full[c] = own.get(c - int(np.fmod(c, every)), [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(full.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        s = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += s
    return [
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k, m in members.items()
    ]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("range_rows", [3, 100_000])
@pytest.mark.parametrize("fan", [2, 64])
def test_prefix_trie(spark, range_rows, fan):
    """The same nodes from one range and from many that are merged in several rounds."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.prefix_trie(spark, spark.createDataFrame(rows, TURNS), range_rows, fan).collect()
    assert order(got) == order(trie_of(rows))


@pytest.mark.parametrize("range_rows", [2, 7, 1000])
def test_prefix_trie_edges(spark, range_rows):
    """Nulls, turnless and absent heads, copies over several ranges, a deep conversation, prefixes of others, repeated turns."""
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, 0, "user", "a b"), (3, 0, "user", "a b"), (5, 0, "user", ""), (-7, 1, "user", "neg"), (-7, 0, "user", "x")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t}  of\tall") for c in range(20, 75) for t in range(c % 6)]
    rows += [(c, t, "user", f"deep {t}") for c in (80, 81, 95) for t in range(60 + c)]
    rows += [(c, 0, "user", f"own {c}") for c in range(100, 140)]
    frame = spark.createDataFrame(rows, TURNS).withColumn("__salt", F.lit(1)).withColumn("path", F.lit("x"))
    got = prefix_trie.prefix_trie(spark, frame, range_rows, 3).collect()
    assert order(got) == order(trie_of(rows))
    assert not prefix_trie.prefix_trie(spark, frame.limit(0)).collect()


# 13


def phrases(rows, least=10, percent=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found, inner = [], Counter()
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                found.append((p, a, *min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))))
                if len(p) == 3:
                    for q in (p[:2], p[1:]):
                        inner[q] = max(inner[q], a)
        stay = [x for x in found if 100 * inner[x[0]] < percent * x[1] or not inner[x[0]]]
        stay = sorted(((" ".join(p), a, left, right, s) for p, a, s, _, left, right in stay), key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i + 1, p, a, left, right, total[lang], s) for i, (p, a, left, right, s) in enumerate(stay[:top])]
    return out


@pytest.mark.parametrize("name", ["documents", "edge"])
@pytest.mark.parametrize("most", [1 << 12, collocations.MOST_CELLS])
def test_collocations(spark, request, monkeypatch, tmp_path, name, most):
    """Equal results whether the sketch is overfull or wide; small blocks are flushed often."""
    monkeypatch.setattr(collocations, "MOST_CELLS", most)
    monkeypatch.setattr(collocations, "LEAST_CELLS", min(most, collocations.LEAST_CELLS))
    monkeypatch.setattr(collocations, "SEGMENT", 1 << 10)
    monkeypatch.setattr(collocations, "HELD", 20_000)
    monkeypatch.setattr(collocations, "MOST_HELD", 3_000)
    docs = request.getfixturevalue(name)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    want = order(phrases(rows))
    assert order(collocations.mine(spark, docs).collect()) == want
    if name == "documents":
        least = order(phrases(rows, 4, 80, 7))
        assert order(collocations.mine(spark, docs, min_count=4, percent=80, top=7).collect()) == least


def test_sketch_never_counts_less():
    rng = np.random.default_rng(5)
    cells = np.sort(np.r_[rng.integers(0, 1 << 18, 3000), np.full(300, 77), [0, (1 << 18) - 1]])
    at, n = collocations.unpacked(collocations.packed(cells))
    want, count = np.unique(cells, return_counts=True)
    assert (at == want).all() and (n == np.minimum(count, 255)).all()
    at, n = collocations.unpacked(collocations.packed(cells, 10))
    assert (at == want).all() and (n == np.minimum(count, 10)).all()
    assert collocations.unpacked(collocations.packed(np.array([0, 0, 255, 510])))[0].tolist() == [0, 255, 510]


def test_sketch_leaves_few(spark, documents):
    """A wide sketch lets hardly any rare n-gram through, and every frequent one."""
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    from lodestrata.llm.common import work_dir

    found = collocations.sketch(texts, work_dir(spark, "t"), min_count=10)
    rng = np.random.default_rng(6)
    assert found.frequent(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.02


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_collocations"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert order(out.collect()) == order(want)


def test_empty_tables(spark, empty):
    assert not hyperminhash.near_duplicates(spark, empty).collect()
    assert not collocations.mine(spark, empty).collect()


def test_clashing_columns(spark, edge):
    more = edge.withColumns({c: F.lit("x") for c in ("__salt", "h", "c", "n", "phrase", "words", "f")})
    assert order(hyperminhash.near_duplicates(spark, more).collect()) == order(hyperminhash.near_duplicates(spark, edge).collect())
    assert order(collocations.mine(spark, more, min_count=2).collect()) == order(collocations.mine(spark, edge, min_count=2).collect())
