"""Bounded samples of labelled documents and small logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


#: Bytes of text that a sample holds, about, whatever its rows.
TRAIN_BYTES = 256 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, bound: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(text ``_t``, label ``_y``) of labelled documents outside the held-out fold: about ``bound`` rows and ``most_bytes`` bytes, or all if fewer.

    Rows are drawn by a hash of id and text, so neither an id nor a text that many
    rows repeat fills the sample, and repeated rows count once.  Of several labels of
    an id the largest counts; null labels and ids do not.
    """
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, parts) != held)).groupBy(F.col(id_col).alias("_i")).agg(F.max(label).cast("int").alias("_y"))
    texts = docs.select(F.col(f"`{id_col}`").alias("_i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    size = sizes(texts, y).agg(F.count("*").alias("n"), F.sum("_n").alias("s")).first()
    share = min(1.0, bound / max(1, size["n"]), most_bytes / max(1, size["s"] or 0))
    drawn = texts.where(F.pmod(F.xxhash64("_i", "_t", F.lit(label)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return drawn.join(y, "_i").dropDuplicates(["_i", "_t"]).select("_t", "_y")


def sizes(texts: DataFrame, y: DataFrame) -> DataFrame:
    """(_i, _n, _y): bytes of every labelled text; only ids and sizes are joined, so no text is shuffled to be measured."""
    return texts.select("_i", F.octet_length("_t").alias("_n")).join(y, "_i")


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float, signed: bool = True, heavier: float = 1.0) -> np.ndarray:
    """Weights (the first is the bias) of a logistic fit by Newton steps, drawn towards ``prior``.

    Without rows, or where all have one label, the prior's weights stand almost
    alone.  Unless ``signed``, features that would get a negative weight get none.
    A row labelled 1 counts ``heavier`` times.
    """
    if not signed:
        kept = np.ones(len(prior), bool)
        while True:
            w = np.zeros(len(prior))
            w[kept] = logistic(x[:, kept[1:]], y, prior[kept], strength, heavier=heavier)
            if not (w[1:] < 0).any():
                return w
            kept[1:] &= w[1:] > 0
    z = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, len(prior)))
    w, pull, times = prior.astype(float).copy(), np.full(len(prior), strength), np.where(y > 0, heavier, 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (times * (y - p)) - pull * (w - prior)
        hess = (z * (times * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w
