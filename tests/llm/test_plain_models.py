"""Language and quality scores against plain loops over the same weights, and recall of near duplicates by similarity."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import hyperminhash, langid, ngram_join, quality

SF = "/root/testdata/sf0.001"


def plain_log_probs(net, window):
    """One window through the network, number by number."""
    width = {f: w for i, w in enumerate(langid.WIDTHS) for f in range(i * langid.FILTERS, (i + 1) * langid.FILTERS)}
    pooled = []
    for f in range(langid.FILTERS * len(langid.WIDTHS)):
        best = -math.inf
        for at in range(langid.WINDOW - langid.TAPS + 1):
            best = max(best, sum(float(net.emb[window[at + t]][d]) * float(net.conv[t * langid.DIM + d][f]) for t in range(width[f]) for d in range(langid.DIM)))
        pooled.append(max(0.0, best + float(net.bias[f])))
    z = [sum(p * float(net.out[f][k]) for f, p in enumerate(pooled)) + float(net.out_bias[k]) for k in range(len(net.languages))]
    top = max(z)
    total = top + math.log(sum(math.exp(x - top) for x in z))
    return [x - total for x in z]


def test_language_scores_by_plain_loops(spark):
    rng = np.random.default_rng(8)
    k = langid.FILTERS * len(langid.WIDTHS)
    net = langid.Network(["aa", "bb", "cc"], *(rng.normal(0, 0.4, shape).astype(np.float32) for shape in ((256, langid.DIM),)), (rng.normal(0, 0.3, (langid.TAPS * langid.DIM, k)) * langid._mask()).astype(np.float32), *(rng.normal(0, 0.3, s).astype(np.float32) for s in (k, (k, 3), 3)))
    long = "Eine Zeile mit WÖRTERN, and more of them. " * 12
    texts = ["a", "Ünïcode TEXT", long, None, "123 --", ""]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i in (3, 4, 5):
        assert got[i] == ("und", 0.0)
    for i, text in enumerate(texts[:3]):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        step = langid.WINDOW - langid.TAPS + 1
        count = max(1, math.ceil(max(len(raw) - langid.TAPS + 1, 1) / step))
        raw += b" " * ((count - 1) * step + langid.WINDOW - len(raw))
        each = [plain_log_probs(net, raw[w * step : w * step + langid.WINDOW]) for w in range(count)]
        sums = [sum(x[j] for x in each) for j in range(3)]
        mean = [math.exp(s / count) for s in sums]
        best = sums.index(max(sums))
        assert got[i][0] == net.languages[best] and got[i][1] == pytest.approx(mean[best] / sum(mean), rel=1e-3)


def test_quality_posteriors_by_plain_loops(spark):
    """Evidence feature by feature, priors group by group, posterior document by document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    rows = docs.collect()
    got = {r["doc_id"]: (r["p_low"], r["p_toxic"], r["keep"]) for r in quality.classify(spark, docs, labels).collect()}
    assert any(model.ratios) and len(got) == len(rows)
    clip = lambda x, a, b: min(max(x, a), b)
    sigmoid = lambda x: 1 / (1 + math.exp(-clip(x, -30, 30)))
    want = defaultdict(list)
    for t in (0, 1):
        a, b = model.scale[t]
        found = [quality.features_of(r["text"]) for r in rows]
        ev = [a * (model.base[t] + sum(w for f, w in model.ratios[t].items() if f in fs)) + b for fs in found]
        own = [sigmoid(e + math.log(model.rate[t] / (1 - model.rate[t]))) for e in ev]
        hosts, paths = defaultdict(list), defaultdict(list)
        for r, o in zip(rows, own, strict=True):
            hosts[r["source"]].append(o)
            paths[r["source"], r["lang"]].append(o)

        def moments(groups):
            n, s, g = sum(map(len, groups)), sum(map(sum, groups)), len(groups)
            mu = clip(s / n, 1e-6, 1 - 1e-6)
            spread = sum(sum(x) ** 2 / len(x) for x in groups)
            between = (spread - n * mu * mu - (g - 1) * mu * (1 - mu)) / max(1e-9, n - sum(len(x) ** 2 for x in groups) / n)
            return clip(mu * (1 - mu) / max(between, 1e-9) - 1, 2.0, 1e4), mu

        (m, mu), (k, _) = moments(list(hosts.values())), moments(list(paths.values()))
        for r, e, o in zip(rows, ev, own, strict=True):
            h, p = hosts[r["source"]], paths[r["source"], r["lang"]]
            above = (sum(h) - o + m * mu) / (len(h) - 1 + m)
            prior = clip((sum(p) - o + k * above) / (len(p) - 1 + k), 1e-6, 1 - 1e-6)
            want[r["doc_id"]].append(sigmoid(e + math.log(prior / (1 - prior))))
    for d, (low, toxic) in want.items():
        assert got[d][:2] == (pytest.approx(low, rel=1e-6), pytest.approx(toxic, rel=1e-6)) and got[d][2] == (got[d][0] < 0.5 and got[d][1] < 0.5)


@pytest.mark.parametrize(("near", "n", "percent"), [(ngram_join.near_duplicates, 5, 80), (hyperminhash.near_duplicates, 3, 85)])
def test_recall_by_band_of_similarity(spark, near, n, percent):
    """Copies with one to forty of 200 words altered: every copy at the threshold or above is found, none below it."""
    rng = random.Random(11)
    rows, truth = [], {}
    for k in range(150):
        base = [f"{k}w{i}" for i in range(200)]
        copy = base[:]
        for i in rng.sample(range(200), 1 + k % 15 * 3):
            copy[i] = f"{k}x{i}"
        sets = [{tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (base, copy)]
        truth[2 * k + 1] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in near(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d in truth if got[d] == d - 1} == {d for d, s in truth.items() if 100 * s >= percent}
    assert sum(100 * s >= percent for s in truth.values()) >= 10
