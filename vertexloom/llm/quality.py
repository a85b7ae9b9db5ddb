"""Quality classifier: naive Bayes support vectors.

Indicators of word and word-shape n-grams are hashed into ``BUCKETS`` features.
Each is scaled by its class log-count ratio, and a linear hinge-loss model over
the scaled indicators is fitted by dual coordinate descent on a bounded sample of
labelled rows; a logistic curve turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import ALNUM, LOWER, SPACED, chunks, mix, over_rows, span_hashes, word_spans
from vertexloom.llm.labelled import fold, logistic, sample

BUCKETS = 1 << 18
#: Borders between levels of a share.
LEVELS = np.array([0.0, 0.02, 0.1, 0.3, 0.6])
#: Labelled rows the model is fitted on, at most about so many.
TRAIN_ROWS = 8_000
EPOCHS, COST, SMOOTH = 20, 0.05, 1.0


def _shape_classes() -> np.ndarray:
    """Bytes by class: white space 32, lower case and non-ASCII 'a', capitals 'A', digits '0', else the byte itself."""
    t = np.arange(256, dtype=np.uint8)
    t[[9, 10, 11, 12, 13]] = 32
    t[97:123] = 97
    t[128:] = 97
    t[65:91] = 65
    t[48:58] = 48
    return t


SHAPE = _shape_classes()
_KIND = [np.uint64(x) for x in (0x1B873593, 0x2B873593CC9E2D51, 0x3B873593CC9E2D51, 0x4B873593CC9E2D51, 0x5B873593CC9E2D51)]
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def batch_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the distinct features of each text, sorted by text.

    Features are words, pairs of words, word shapes (runs of one class written
    once), pairs of shapes, which of four words in a row repeat, and in what share
    of its places a text repeats a word, shouts or ends a word in signs.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_spans(raw, SPACED)
    edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    owner = np.searchsorted(edges, starts, "right")
    words = span_hashes(LOWER[raw], starts, ends)
    cls = SHAPE[raw]
    cls = cls[np.append(True, cls[1:] != cls[:-1])]
    shapes = span_hashes(cls, *word_spans(cls, SPACED))
    same = owner[1:] == owner[:-1]
    parts = [(owner, mix(words ^ _KIND[0])), (owner, mix(shapes ^ _KIND[1]))]
    for k, x in ((2, words), (3, shapes)):
        parts.append((owner[1:][same], mix((x[:-1] * _NEXT + x[1:])[same] ^ _KIND[k])))
    again = same & (words[1:] == words[:-1])
    if len(again) > 2:
        inside = same[2:] & same[1:-1] & same[:-2]
        pattern = again[:-2] * np.uint64(4) + again[1:-1] * np.uint64(2) + again[2:]
        parts.append((owner[3:][inside], mix(pattern[inside].astype(np.uint64) ^ _KIND[4])))
    last, first = raw[ends - 1], raw[starts]
    count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    signs = ~ALNUM[last] & (last != ord(".")) & (last != ord(","))
    for k, flag in enumerate((np.append(again, False), (first >= 65) & (first <= 90) & (last <= 90), signs)):
        share = np.bincount(owner, flag.astype(float), len(texts)) / count
        level = np.searchsorted(LEVELS, share, "left") + 16 * (k + 1)
        parts.append((np.arange(len(texts)), mix(level.astype(np.uint64) ^ _KIND[4])))
    packed = np.concatenate([o.astype(np.int64) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64) for o, h in parts])
    packed = np.unique(packed)
    return packed // BUCKETS, packed % BUCKETS


def log_ratios(features: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Class log-count ratio of every feature."""
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for f, label in zip(features, y, strict=True):
        (p if label else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(features: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over scaled indicators, each row divided by its length.

    Classes count alike: the cost of a row is its class's share inverted.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum()))) * COST
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    scaled = [ratio[f] / max(1e-9, np.linalg.norm(ratio[f])) for f in features]
    order = np.random.default_rng(3)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, v = features[i], scaled[i]
            norm = 1.0 + float(v @ v)
            grad = sign[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - grad / norm, 0.0), cost[i] * 20)
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[f] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


@dataclass
class Model:
    """Weights already multiplied by the log-count ratios, the ratios' squares for row lengths, and the score's curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    curve: tuple[float, float]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            owner, f = batch_features(texts[a:b])
            total = np.bincount(owner, self.weights[f], b - a)
            length = np.sqrt(np.bincount(owner, self.squares[f], b - a))
            out[a:b] = total / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * out, -30, 30)))


def train(texts: list[bytes], y: np.ndarray) -> Model:
    """Fit on whole texts; without rows of both labels every text scores alike."""
    features: list[np.ndarray] = []
    for a, b in chunks(texts):
        owner, f = batch_features(texts[a:b])
        features += np.split(f, np.searchsorted(owner, np.arange(1, b - a)))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, (4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0, 0.0))
    # the curve is fitted on margins of a quarter that the first fit has not seen
    seen = np.arange(len(y)) % 4 != 0
    if len(set(y[seen].tolist())) < 2 or len(set(y[~seen].tolist())) < 2:
        seen = np.ones(len(y), bool)
    pick = lambda mask: [f for f, m in zip(features, mask, strict=True) if m]
    ratio = log_ratios(pick(seen), y[seen])
    w, bias = dual_descent(pick(seen), y[seen], ratio)
    other = ~seen if (~seen).any() else seen
    margin = np.array([float(w[f] @ ratio[f]) / max(1e-9, np.linalg.norm(ratio[f])) + bias for f in pick(other)])
    a, b = logistic(margin[:, None], y[other].astype(float), np.array([0.0, 3.0]), 0.5)
    ratio = log_ratios(features, y)
    w, bias = dual_descent(features, y, ratio)
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, (float(a), float(b)))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows outside the held-out fold (see ``labelled.sample``)."""
    rows = sample(docs, labels, "quality", parts, held, bound, id_col, text_col).toPandas()
    order = np.argsort([hash_of(t) for t in rows["_t"]], kind="stable") if len(rows) else []
    return train([rows["_t"].iloc[i].encode("utf-8", "surrogatepass") for i in order], np.array([int(rows["_y"].iloc[i]) for i in order], int))


def hash_of(text: str) -> int:
    """An order of rows that does not depend on how they arrive."""
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row; null texts count as empty, repeated rows are each scored, an empty table gives an empty result, other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "score": model.scores([(t or "").encode("utf-8", "surrogatepass") for t in pdf["_t"]])})

    return over_rows(df, {id_col: id_col}, text_col, run, "score double")


def report(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
