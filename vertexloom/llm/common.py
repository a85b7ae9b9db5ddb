"""Pieces that several text operators share.

Words are found on UTF-8 bytes with numpy: ASCII separators never occur inside
a multi-byte character, so byte positions give exact word boundaries without a
Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multiplier of the polynomial word hash; its inverse modulo 2**64 exists.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Integers become decimal numbers in pandas where a batch has nulls, so ids of these types travel as text.
INTEGERS = {"tinyint", "smallint", "int", "bigint"}


#: Rows that a function over whole texts gets at once.
PIECE = 1_000


def _release() -> None:
    """Give freed memory of a Python worker back, so that idle workers do not hold the peak of their last task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # other C libraries have no such call


def frugal(function):
    """``function`` over batches, called with ``PIECE`` rows at a time; memory is given back at the end of a task."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), PIECE):
                yield pdf.iloc[a : a + PIECE].reset_index(drop=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from function(pieces(batches))
        finally:
            _release()

    return run


def over_rows(df: DataFrame, carry: dict[str, str], text_col: str, function, made: str) -> DataFrame:
    """mapInPandas over whole texts (``_t``, null stays null) and carried columns, which keep their types exactly.

    ``carry`` maps the columns' names in ``df`` to their names in the result;
    ``made`` is the schema of what ``function`` adds.
    """
    kinds = {new: df.schema[old].dataType.simpleString() for old, new in carry.items()}
    sent = [F.col(f"`{old}`").cast("string" if kinds[new] in INTEGERS else kinds[new]).alias(new) for old, new in carry.items()]
    schema = ", ".join([*(f"`{c}` {'string' if k in INTEGERS else k}" for c, k in kinds.items()), made])
    out = df.select(*sent, F.col(f"`{text_col}`").cast("string").alias("_t")).mapInPandas(frugal(function), schema)
    return out.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in out.columns))


def text_of(col: str = "text") -> Column:
    """A text column with nulls read as empty strings."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if it holds more than this part of all rows; so many tasks share a hot key's rows.
HOT_PART, SALT = 2_000, 64


def hot_keys(counts: DataFrame, key: str, count: str) -> list:
    """Keys that hold more than a ``HOT_PART``-th of the counted rows, so never more than ``HOT_PART``."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(count) * HOT_PART > F.lit(total)).select(key).collect()] if total > HOT_PART * SALT else []


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: list, spread: str) -> DataFrame:
    """Inner join on ``key`` of ``many`` rows with ``one`` or few for each key; ``many``'s rows of hot keys are dealt over tasks by a hash of ``spread``."""
    if not hot:
        return many.join(one, key)
    is_hot = F.col(key).isin(hot)
    dealt = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALT))).otherwise(F.lit(0)).cast("int"))
    copies = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POW[0]) < n:
        size = max(n, 2 * len(_POW[0]), 1 << 16)
        for k, base in enumerate((BASE, BASE_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POW[k] = np.multiply.accumulate(step)
    return _POW[0], _POW[1]


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves all other bytes."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()
#: True for bytes of words when words are what stands between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: True for bytes of words when words are ASCII letters and digits and all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def word_spans(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes in a byte array."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flag = is_word[raw]
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if flag[0]:
        edge = np.concatenate(([0], edge))
    if flag[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    return edge[0::2], edge[1::2]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes and length give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


#: Multipliers that make the places of a shingle's words count.
_PLACE = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one shingle of all, none make none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h += words[k : n - width + 1 + k] * _PLACE[k % 64]
    return mix(h + np.uint64(width * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def batch_words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many lower-cased texts, concatenated, and the offsets where each text's words begin.

    Texts are joined by a separator, so one pass of numpy serves a batch of short texts.
    """
    raw = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = word_spans(raw, is_word)
    edges = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
    return span_hashes(raw, starts, ends), np.searchsorted(starts, edges)


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """Index ranges whose texts hold about ``limit`` bytes together; a longer text stands alone, whole."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
