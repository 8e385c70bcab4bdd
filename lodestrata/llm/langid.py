"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import drop_dir, stored, work_dir

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, DIM = 10, 8
TAPS = max(WIDTHS)
#: Bound of the training sample: documents a language and in all (one of each language at least), and windows taken from each.
DOCS_A_LANGUAGE, TRAIN_DOCS, WINDOWS_A_DOC = 800, 50_000, 3
#: Shares of all languages up to this size are broadcast; a larger table is joined by shuffle.
BROADCAST_BYTES = 8 << 20
_ASCII = re.compile("[A-Za-z]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def has_letter(text: str) -> bool:
    """Whether a text has a code point of a Unicode letter category (L*); numerals that look like words are none."""
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text))


@dataclass
class Network:
    """Byte embeddings, filters of several widths, max pooling over a window, softmax."""

    languages: list[str]
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window (n x filters)."""
        x = self.emb[windows]
        n = windows.shape[1] - TAPS + 1
        cols = np.concatenate([x[:, k : k + n] for k in range(TAPS)], axis=2).reshape(-1, TAPS * DIM)
        return np.maximum((cols @ self.conv).reshape(len(windows), n, -1).max(axis=1) + self.bias, 0)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(raw: bytes) -> np.ndarray:
    """All fixed-length windows of a text: together they cover every byte and every filter position."""
    step = WINDOW - TAPS + 1
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    count = max(1, -(-max(len(data) - TAPS + 1, 1) // step))
    padded = np.full((count - 1) * step + WINDOW, 32, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def _mask() -> np.ndarray:
    """Filters narrower than the widest have zero taps at the end."""
    m = np.zeros((TAPS, DIM, FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        m[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return m.reshape(TAPS * DIM, -1)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 0) -> Network:
    """Adam on cross-entropy; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    mask, k = _mask(), FILTERS * len(WIDTHS)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 0.3, (TAPS * DIM, k)) * mask).astype(np.float32),
        np.zeros(k, np.float32),
        rng.normal(0, 0.3, (k, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    names = ("emb", "conv", "bias", "out", "out_bias")
    m = {n: np.zeros_like(getattr(net, n)) for n in names}
    v = {n: np.zeros_like(getattr(net, n)) for n in names}
    n_pos, t, taps = WINDOW - TAPS + 1, 0, np.arange(TAPS)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x, y = windows[pick], labels[pick]
            e = net.emb[x]
            cols = np.concatenate([e[:, i : i + n_pos] for i in range(TAPS)], axis=2)
            resp = cols @ net.conv
            best = resp.argmax(axis=1)
            top = np.take_along_axis(resp, best[:, None, :], 1)[:, 0] + net.bias
            act = np.maximum(top, 0)
            z = act @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (top > 0)
            rows = np.arange(len(y))[:, None]
            seen = cols[rows, best]
            g = {"out": act.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "conv": np.einsum("bkd,bk->dk", seen, back) * mask}
            to_emb = np.einsum("bk,dk->bkd", back, net.conv).reshape(len(y), k, TAPS, DIM)
            g["emb"] = np.zeros_like(net.emb)
            np.add.at(g["emb"], x[rows[:, :, None], best[:, :, None] + taps], to_emb)
            t += 1
            for n in names:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                setattr(net, n, (getattr(net, n) - 0.01 * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
    return net


def fit(labelled: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE) -> Network | None:
    """Trains on labelled (doc_id, text, lang); None if nothing is labelled.

    A sample of at most docs_a_language documents of a language, and about TRAIN_DOCS in all, is drawn by hash, so
    that it is the same in every run. Every language that is labelled is learned, however rare; a window that many
    rows share counts once. Texts are drawn where they are read, as one language may hold most of them. Only
    windows come to the driver.
    """
    folder = work_dir(labelled.sparkSession, "langid")
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = stored(rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")), folder + "/counts")
    languages, size = counts.agg(F.count("*"), F.sum(F.octet_length("lang") + 16)).first()
    if not languages:
        drop_dir(labelled.sparkSession, folder)
        return None
    each = max(1, min(docs_a_language, TRAIN_DOCS // languages))
    # A rare language is taken whole; of a frequent one a share that gives about `each` different texts.
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("__share"))
    hint = F.broadcast(share) if size <= BROADCAST_BYTES else share
    drawn = rows.select("text", "lang").join(hint, "lang").where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) < F.col("__share") * 1_000_000)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, lang in zip(part["text"], part["lang"], strict=True):
                if has_letter(text):
                    w = windows_of(text.encode())
                    out += [(lang, w[i].tobytes()) for i in np.unique(np.linspace(0, len(w) - 1, WINDOWS_A_DOC).astype(int))]
            yield pd.DataFrame(out, columns=["lang", "window"])

    got = drawn.select("text", "lang").mapInPandas(cut, "lang string, window binary").distinct().toPandas()
    drop_dir(labelled.sparkSession, folder)
    if got.empty:
        return None
    got["window"] = got["window"].map(bytes)
    got = got.sort_values(["lang", "window"], ignore_index=True)
    languages = sorted(got["lang"].unique())
    x = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)
    return train(x, got["lang"].map({n: i for i, n in enumerate(languages)}).to_numpy(), languages)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score for docs (doc_id, text), from the whole text.

    The language has the largest sum of log probabilities over all windows; the score is the share of its mean
    log probability among all. `und` with score 0 for a null text, one without letters, or without a network.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for part in parts:
            texts = part["text"].tolist()
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            held: list[tuple[int, int]] = []
            pending: list[np.ndarray] = []
            sums: dict[int, np.ndarray] = {}
            count: dict[int, int] = {}

            def flush() -> None:
                if pending:
                    logp, at = net.log_probs(np.concatenate(pending)), 0
                    for i, n in held:
                        sums[i] = sums.get(i, 0) + logp[at : at + n].sum(axis=0)
                        count[i] = count.get(i, 0) + n
                        at += n
                    held.clear()
                    pending.clear()

            waiting = 0
            for i, text in enumerate(texts):
                if net is None or text is None or not has_letter(text):
                    continue
                w = windows_of(text.encode())
                for at in range(0, len(w), 512):
                    block = w[at : at + 512]
                    pending.append(block)
                    held.append((i, len(block)))
                    waiting += len(block)
                    if waiting >= 512:
                        flush()
                        waiting = 0
            flush()
            for i, s in sums.items():
                mean = s / count[i]
                p = np.exp(mean - mean.max())
                k = int(s.argmax())
                pred[i], score[i] = net.languages[k], p[k] / p.sum()
            yield pd.DataFrame({"doc_id": part["doc_id"].tolist(), "lang_pred": pred, "score": score})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 3 is not 1 and predicts all of docs (doc_id, text, lang).

    Returns doc_id, held_out, lang_pred and score. A null text or one without letters is `und` with score 0, a null
    lang is not learned from, equal texts are predicted alike, other columns are ignored, no documents give no rows.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = docs.select("doc_id", "text", "lang")
    out = predict(rows, fit(rows.where(~held)))
    return out.withColumn("held_out", F.coalesce(held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
