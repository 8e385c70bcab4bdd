"""Document quality by hierarchical empirical Bayes: text evidence, then site and section priors."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import hidden, stored, tidy, work_dir

#: Bounds of the model: labelled documents it is fitted on, and features that it keeps for each target.
TRAIN_DOCS, FEATURES = 20_000, 500
MIN_DOCS, MIN_CHI = 3, 15
#: Lengths of the word beginnings that are features beside whole words: inflected words share their stem.
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\w\s.,;:'\"()\-]")
_TARGETS = ("low", "toxic")


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def shape(text: str, words: list[str]) -> list[str]:
    """Features of a text's form, each as one of a few bins."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    upper = n - sum(map(len, re.findall(r"[^A-Z]+", text)))
    tokens = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    share = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4)
    return [
        f"#upper{_bin(upper / max(1, letters), (0.02, 0.05, 0.1, 0.2, 0.4, 0.7))}",
        f"#odd{_bin(len(_ODD.findall(text)) / n, share)}",
        f"#letters{_bin(letters / n, (0.3, 0.5, 0.6, 0.7, 0.75, 0.8))}",
        f"#digits{_bin(len(re.findall(r'[0-9]', text)) / n, share)}",
        f"#distinct{_bin(len(set(tokens)) / max(1, len(tokens)), (0.1, 0.2, 0.35, 0.5, 0.7, 0.9))}",
        f"#lines{_bin(len(set(lines)) / max(1, len(lines)), (0.2, 0.5, 0.8, 0.95))}",
        f"#stops{_bin(len(re.findall(r'[.]', text)) / max(1, len(tokens)), (0.01, 0.03, 0.06, 0.15, 0.5))}",
        f"#words{_bin(len(tokens), (1, 5, 20, 100))}",
        f"#mean{_bin(letters / max(1, len(words)), (2, 3, 4, 5, 7, 10))}",
    ]


def features_of(text: str | None) -> set[str]:
    """Distinct lower-cased letter runs of the whole text, their beginnings, and its form; null is empty."""
    text = text or ""
    words = _WORD.findall(text)
    found = {w.lower() for w in words}
    stems = ({f"{w[:k]}~" for w in found if len(w) >= k} for k in STEMS)
    return found.union(shape(text, words), *stems)


def _train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents (text, low, toxic), at most about TRAIN_DOCS, drawn by hash.

    Rows that share a labelled doc_id give one: the text of the least hash, found by partial aggregation.
    """
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    known = known.groupBy("doc_id").agg((1 - F.min("quality")).alias("low"), F.max("toxic").alias("toxic"))
    total = known.count()
    part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, TRAIN_DOCS / max(1, total)))
    # The sample of identifiers has a bound, so it may be broadcast whatever the size of the corpus.
    rows = docs.select("doc_id", "text").join(F.broadcast(part), "doc_id")
    return rows.groupBy("doc_id", "low", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "low", "toxic")


class QualityModel:
    """Weights of selected features for two targets (low quality, toxic), and what turns their sum into evidence."""

    def __init__(self, ratios: list[dict[str, float]], base: list[float], scale: list[tuple[float, float]], rate: list[float]):
        self.ratios, self.base, self.scale, self.rate = ratios, base, scale, rate

        names = set().union(*ratios)
        self.words = {f for f in names if f[0] != "#" and f[-1] != "~"}
        self.stems = {k: {f[:-1] for f in names if f[-1] == "~" and len(f) == k + 1} for k in STEMS}

    def known(self, text: str | None) -> set[str]:
        """Those of a text's features that the model holds; others are never made."""
        text = text or ""
        words = _WORD.findall(text)
        found = {w.lower() for w in words}
        out = self.words & found
        for k, stems in self.stems.items():
            if stems:
                out |= {f"{x}~" for x in stems.intersection({w[:k] for w in found if len(w) >= k})}
        return out.union(shape(text, words))

    def evidence(self, text: str | None) -> tuple[float, ...]:
        """Calibrated log odds that the text alone gives, without the prior."""
        found = self.known(text)
        return tuple(a * (base + sum(r[f] for f in found & r.keys())) + b for r, base, (a, b) in zip(self.ratios, self.base, self.scale, strict=True))


def _logistic(at: np.ndarray, doc: np.ndarray, y: np.ndarray, features: int, penalty: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic fit; entry k says that row doc[k] has feature at[k]. Adam on all rows."""
    w, m, v = (np.zeros(features + 1) for _ in range(3))
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[at], len(y)) + w[-1], -30, 30)))
        g = np.append(np.bincount(at, (p - y)[doc], features) + penalty * w[:-1], (p - y).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> QualityModel:
    """Fits the text model on a bounded sample of labelled rows.

    Documents that hold a feature are counted by class in one grouped aggregation; the features whose chi-square
    is largest stay, and a penalised logistic fit of the sample's rows weighs them.
    Without labels every evidence is 0.
    """
    rows = _train_rows(docs, labels)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seen: dict[str, np.ndarray] = {}
            for text, low, toxic in zip(part["text"], part["low"], part["toxic"], strict=True):
                row = np.array([low == 0, low == 1, toxic == 0, toxic == 1], np.int64)
                for f in features_of(text) | {"#all"}:
                    seen[f] = seen[f] + row if f in seen else row
            yield pd.DataFrame([(f, *map(int, c)) for f, c in seen.items()], columns=["feature", "l0", "l1", "t0", "t1"])

    counts = rows.mapInPandas(count, "feature string, l0 long, l1 long, t0 long, t1 long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("l0", "l1", "t0", "t1")))
    counts = stored(counts.where(F.col("l0") + F.col("l1") + F.col("t0") + F.col("t1") >= 2 * MIN_DOCS), (folder or work_dir(docs.sparkSession, "quality")) + "/features")
    every = counts.where(F.col("feature") == "#all").collect()
    if not every:
        return QualityModel([{}, {}], [0.0, 0.0], [(1.0, 0.0)] * 2, [0.02, 0.02])
    names: list[str] = []
    rate = []
    for no, yes in (("l0", "l1"), ("t0", "t1")):
        n0, n1 = every[0][no], every[0][yes]
        rate.append((n1 + 0.5) / (n0 + n1 + 1))
        if n0 and n1:
            a, b = F.col(yes).cast("double"), F.col(no).cast("double")
            n, total = a + b, float(n0 + n1)
            gap = a * n0 - b * n1
            chi = gap * gap * total / (n * (total - n) * n0 * n1)
            top = counts.where((F.col("feature") != "#all") & (n >= MIN_DOCS) & (n < total)).withColumn("chi", chi).where(F.col("chi") > MIN_CHI).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
            names += [r["feature"] for r in top if r["feature"] not in names]
    number = {f: k for k, f in enumerate(names)}

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [np.array(sorted(number[f] for f in features_of(t) if f in number), "<i4").tobytes() for t in part["text"]]
            yield pd.DataFrame({"low": part["low"], "toxic": part["toxic"], "found": found})

    # At most about TRAIN_DOCS rows of selected features' numbers come to the driver.
    got = rows.mapInPandas(pick, "low double, toxic double, found binary").toPandas()
    got = got.sort_values(["low", "toxic", "found"], ignore_index=True)
    ratios, bases, scale = [{}, {}], [0.0, 0.0], [(1.0, 0.0)] * 2
    for k, target in enumerate(_TARGETS):
        part = got[got[target].isin([0.0, 1.0])]
        y = part[target].to_numpy(float)
        if len(names) and 0 < y.sum() < len(y):
            ids = [np.frombuffer(bytes(x), "<i4") for x in part["found"]]
            w, b = _logistic(np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids]), y, len(names))
            ratios[k], bases[k] = {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}, b
            # What is left is evidence: the sample's own rate goes out, the site's prior comes in later.
            scale[k] = (1.0, -math.log(rate[k] / (1 - rate[k])))
    return QualityModel(ratios, bases, scale, rate)


def with_evidence(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with ev_low and ev_toxic; the other columns pass through untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<low:double,toxic:double>")
    def evidence(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.evidence(t) for t in text], columns=list(_TARGETS), dtype=float)

    return docs.withColumn("__ev", evidence(F.col("text")))


def _logit(p):
    return F.log(p / (1 - p))


def _posterior(target: str, rate: float):
    """A document's probability under the corpus rate, from its own evidence alone."""
    odds = F.col("__ev")[target] + math.log(rate / (1 - rate))
    return F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def _moments(groups: DataFrame, n: str, s: str) -> tuple[float, float]:
    """Weight of the prior and mean rate, from how the rates s / n of groups spread (method of moments)."""
    x = groups.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("q"), F.sum(F.col(n).cast("double") * F.col(n)).alias("nn")).first()
    if not x["g"] or x["g"] < 2 or not x["n"]:
        return 10.0, 0.5
    mu = min(max(x["s"] / x["n"], 1e-6), 1 - 1e-6)
    within = mu * (1 - mu)
    between = (x["q"] - x["n"] * mu * mu - (x["g"] - 1) * within) / max(1e-9, x["n"] - x["nn"] / x["n"])
    return min(max(within / max(between, 1e-9) - 1, 2.0), 1e4), mu


def with_priors(rows: DataFrame, rate: list[float], host: str, path: str) -> DataFrame:
    """rows with __prior_low and __prior_toxic: rates of their (host, path), shrunk towards the host's, and that towards the corpus.

    A document counts with its posterior under the corpus rate; its own is taken out of the prior that it meets.
    Groups are summed before anything is shuffled by row, and sparse ones stay near their parent.
    """
    rows = rows.select("*", *(_posterior(t, r).alias(f"__own_{t}") for t, r in zip(_TARGETS, rate, strict=True)))
    low = rows.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(F.count("*").alias("__n"), *(F.sum(f"__own_{t}").alias(f"__s_{t}") for t in _TARGETS))
    top = low.groupBy("__host").agg(F.sum("__n").alias("__hn"), *(F.sum(f"__s_{t}").alias(f"__h_{t}") for t in _TARGETS))
    sites = low.join(top.withColumnRenamed("__host", "__parent"), F.col("__host").eqNullSafe(F.col("__parent"))).drop("__parent")
    out = rows.join(sites, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left")
    for t in _TARGETS:
        (m, mu), (k, _) = _moments(top, "__hn", f"__h_{t}"), _moments(low, "__n", f"__s_{t}")
        own = F.col(f"__own_{t}")
        above = (F.col(f"__h_{t}") - own + m * mu) / (F.col("__hn") - 1 + m)
        out = out.withColumn(f"__prior_{t}", (F.col(f"__s_{t}") - own + k * above) / (F.col("__n") - 1 + k))
    return out


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, carry_text: bool = True) -> DataFrame:
    """docs plus p_low, p_toxic and keep (neither reaches the threshold); without the text if carry_text is false.

    The text's evidence is stored once, its aggregates read only the evidence and the site columns, and every
    document then meets its site's prior. Null hosts or paths are groups of their own, a null text is empty
    text, repeated rows are judged alike, and no documents give no rows. Columns that are named p_low, p_toxic or
    keep before are replaced.
    """
    docs, names = hidden(docs)
    folder = work_dir(spark, "quality")
    model = fit(docs, labels, folder)
    rows = with_evidence(docs, model)
    rows = tidy(stored(rows if carry_text else rows.drop("text"), folder + "/evidence"), folder)
    joined = with_priors(rows, model.rate, host, path)
    for t in _TARGETS:
        odds = F.col("__ev")[t] + _logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(f"__prior_{t}"))))
        joined = joined.withColumn(f"p_{t}", F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))))
    out = joined.select(*(c for c in docs.columns if (carry_text or c != "text") and c not in ("p_low", "p_toxic", "keep")), "p_low", "p_toxic")
    return out.withColumn("keep", (F.col("p_low") < threshold) & (F.col("p_toxic") < threshold)).withColumnsRenamed(names)
