"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity to it, so
items are partitioned by size and every document is cut, once per partition, into
overlapping windows at most four times as long as the partition's smallest items.
Inside such a window the item's share is large, and containment turns into a
Jaccard similarity that MinHash can see.  Sketches of long windows are minima of
the sketches of short ones, so all partitions together cost one pass of hashing.

Items of at most ``SHORT`` shingles are too small a share of the shortest window.
They are found without sketches: a document that holds enough of an item holds one
of any n - need + 1 of its n shingles, so the documents' shingles are looked up
among so many of each short item, those that the fewest items share.

One equal minimum makes a candidate: of ``HASHES`` minima an item that the window
holds to 80 per cent misses all of them with probability below 1e-5 in the worst
window and 1e-9 in most; windows overlap, so two see each item.  A candidate is
verified by exact containment of the item's shingles in the whole document.

Items travel to the executors in blocks of ``BLOCK`` items and ``BLOCK_BYTES`` bytes;
more items mean more passes over the documents, one after another, never a larger
task or driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import ALNUM, LOWER, batch_words, chunks, fresh, mix, over_rows, shingle_hashes, word_spans
from vertexloom.plans.runtime import Scratch

SIZE = 5
HASHES = 64
#: Items, and bytes of their texts, that one task carries, about.
BLOCK, BLOCK_BYTES = 50_000, 16 << 20
#: Shingles in the shortest pieces; partition p has pieces of STEP * 2**p.
STEP = 32
#: Items of up to so many distinct shingles are looked up by exact shingles.
SHORT = STEP // 2

_ODD = mix(np.arange(20_001, 20_001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_SALT = mix(np.arange(30_001, 30_001 + HASHES, dtype=np.uint64))


def _minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(pieces, HASHES) minima over runs of hashes."""
    out = np.empty((len(starts), HASHES), np.uint64)
    at, ends = 0, np.append(starts[1:], len(h))
    while at < len(starts):
        end = at + max(1, int(np.searchsorted(ends[at:] - starts[at], 32_768)))
        part = h[starts[at] : ends[end - 1]]
        buf = np.empty(len(part), np.uint64)
        local = starts[at:end] - starts[at]
        for j in range(HASHES):
            np.multiply(part ^ _SALT[j], _ODD[j], out=buf)
            out[at:end, j] = np.minimum.reduceat(buf, local)
        at = end
    return out


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of non-ASCII characters."""
    raw = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(*word_spans(raw, ALNUM), strict=True)]


def partition_of(n: int) -> int:
    """Size partition of an item with n distinct shingles: pieces hold at least as many shingles as its items."""
    p = 0
    while STEP << p < n:
        p += 1
    return p


class Index:
    """Sketches and exact shingles of a block of items, by size partition."""

    def __init__(self, items: list[tuple[object, str]], percent: int):
        self.percent = percent
        self.ids = [i for i, _ in items]
        self.shingles: list[dict[int, tuple[bytes, ...]]] = []
        parts: dict[int, list[int]] = {}
        short: list[int] = []
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            hashes = self.hashes(text)
            width = min(SIZE, len(words))
            self.shingles.append({int(h): tuple(words[j : j + width]) for j, h in enumerate(hashes)})
            if 0 < len(self.shingles[k]) <= SHORT:
                short.append(k)
            elif len(words):
                parts.setdefault(partition_of(len(self.shingles[k])), []).append(k)
        self.parts = {p: self._table(ks) for p, ks in sorted(parts.items())}
        self.short = self._exact(short) if short else None

    @staticmethod
    def hashes(text: str | None) -> np.ndarray:
        words, _ = batch_words([(text or "").encode("utf-8", "surrogatepass")], ALNUM)
        return shingle_hashes(words, SIZE)

    def _table(self, ks: list[int]):
        """Sorted (minimum, item) of a partition, and a bit table that most other values fail."""
        rows = [_minima(np.fromiter(self.shingles[k], np.uint64, len(self.shingles[k])), np.zeros(1, np.int64))[0] for k in ks]
        return self._sorted(np.concatenate(rows), np.repeat(np.asarray(ks), HASHES))

    def _exact(self, ks: list[int]):
        """The same of short items' shingles, as many of each as no document that holds enough of it can lack."""
        shared = Counter(x for k in ks for x in self.shingles[k])
        rows = []
        for k in ks:
            n = len(self.shingles[k])
            lacking = n - -(-self.percent * n // 100)
            rows += [(x, k) for x in sorted(self.shingles[k], key=lambda x: (shared[x], x))[: lacking + 1]]
        return self._sorted(np.array([x for x, _ in rows], np.uint64), np.array([k for _, k in rows]))

    @staticmethod
    def _sorted(values: np.ndarray, owners: np.ndarray):
        order = np.argsort(values, kind="stable")
        bits = max(16, int(len(values) * 64).bit_length())
        table = np.zeros(1 << bits, bool)
        table[(values >> np.uint64(3)) & np.uint64((1 << bits) - 1)] = True
        return values[order], owners[order], table

    def candidates(self, h: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs with an equal minimum in some window, or an equal shingle of a short item; ``edges`` bound each text's shingles in ``h``."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(edges)
        full = np.flatnonzero(counts)
        if not len(full):
            return []
        if self.short is not None:
            found |= self._lookup(self.short, h, np.repeat(full, counts[full]), 1)
        if not self.parts:
            return sorted(found)
        # pieces of STEP shingles that never cross texts
        pieces = -(-counts[full] // STEP)
        owner = np.repeat(full, pieces)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = edges[owner] + (np.arange(len(owner)) - first) * STEP
        sketch = _minima(h, starts)
        for p in range(max(self.parts) + 1):
            if p:  # halves of the longer pieces, at every other place
                sketch, owner = _joined(sketch, owner)
            if p in self.parts:
                windows, text = _pairs(sketch, owner)
                found |= self._lookup(self.parts[p], windows.ravel(), text, HASHES)
        return sorted(found)

    @staticmethod
    def _lookup(known, flat: np.ndarray, text: np.ndarray, each: int) -> set[tuple[int, int]]:
        """(text, item) of equal values; ``each`` values in turn belong to one entry of ``text``."""
        values, owners, table = known
        at = np.flatnonzero(table[(flat >> np.uint64(3)) & np.uint64(len(table) - 1)])
        lo, hi = np.searchsorted(values, flat[at]), np.searchsorted(values, flat[at], "right")
        out: set[tuple[int, int]] = set()
        for w, a, b in zip(at[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
            out.update((int(text[w // each]), int(k)) for k in owners[a:b])
        return out

    def verified(self, text: bytes, h: np.ndarray, k: int) -> int:
        """Shingles of item k in the text, each confirmed on its words; 0 where too few."""
        want = self.shingles[k]
        where = np.flatnonzero(np.isin(h, np.fromiter(want, np.uint64, len(want))))
        if len(where) * 100 < self.percent * len(want):
            return 0
        raw = LOWER[np.frombuffer(text, np.uint8)]
        starts, ends = word_spans(raw, ALNUM)
        data, seen = raw.tobytes(), set()
        for w in where:
            x = int(h[w])
            if x not in seen and want[x] == tuple(data[starts[j] : ends[j]] for j in range(w, w + len(want[x]))):
                seen.add(x)
        return len(seen) if len(seen) * 100 >= self.percent * len(want) else 0


def _joined(sketch: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of pieces twice as long: neighbours 0+1, 2+3, ... of each text."""
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
    starts = np.flatnonzero(place % 2 == 0)
    return np.minimum.reduceat(sketch, starts, axis=0), owner[starts]


def _pairs(sketch: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of two neighbouring pieces, at every piece; a text's last piece also stands alone."""
    out = sketch.copy()
    same = owner[1:] == owner[:-1]
    out[:-1][same] = np.minimum(sketch[:-1][same], sketch[1:][same])
    return out, owner


def contained(df: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, n_common, n_item) for every item whose shingles a document holds to ``percent`` or more.

    Shingles are runs of five words; a shorter item is one shingle of all its words
    and is found only where a document is just as short and equal.  Null, empty and
    wordless texts and items match nothing.  Repeated rows are each reported,
    other columns are ignored, and an empty table on either side gives an empty
    result.
    """
    item_kind = items.schema[item_id].dataType.simpleString()
    docs = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("_t")).where(F.length("_t") > 0)
    # a repeated item is looked for once and reported as often as it stands there
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("_i"), F.col(f"`{item_text}`").cast("string").alias("_t")).where(F.length("_t") > 0).groupBy("_i", "_t").agg(F.count("*").alias("_m"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("_t")).alias("s")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-(size["s"] or 0) // BLOCK_BYTES))
    scratch, found = Scratch(df.sparkSession, "contained"), []
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("_i", "_t"), F.lit(blocks)) == b)
        carried = [(r["_i"], r["_t"], r["_m"]) for r in mine.collect()]
        part = over_rows(docs, {id_col: id_col}, "_t", _finder(carried, percent, id_col), "_item string, n_common bigint, n_item bigint, _m bigint")
        # several blocks are worked off one by one, so that the driver holds one at a time
        found.append(part if blocks == 1 else scratch.put(part))
        del carried, part
    out = found[0] if blocks == 1 else df.sparkSession.read.schema(found[0].schema).parquet(*(f._vertexloom_path for f in found))
    out = out.withColumn("_m", F.explode(F.sequence(F.lit(1).cast("bigint"), "_m")))
    return out.select(id_col, F.col("_item").cast(item_kind).alias(item_id), "n_common", "n_item")


def _finder(items: list[tuple[str | None, str, int]], percent: int, id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, times = Index([x[:2] for x in items], percent), [x[2] for x in items]
        for pdf in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in pdf["_t"]]
            out = []
            for a, b in chunks(raw):
                words, edges = batch_words(raw[a:b], ALNUM)
                runs = [shingle_hashes(words[edges[k] : edges[k + 1]], SIZE) for k in range(b - a)]
                bounds = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
                for k, item in index.candidates(np.concatenate(runs) if runs else words, bounds):
                    if common := index.verified(raw[a + k], runs[k], item):
                        out.append((pdf[id_col].iloc[a + k], index.ids[item], common, len(index.shingles[item]), times[item]))
            yield pd.DataFrame(out, columns=[id_col, "_item", "n_common", "n_item", "_m"])

    return run


def clean(df: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that hold no item; rows without an id are judged by no id and stay.

    Null and empty texts hold nothing and stay; of rows that repeat an id all go if
    one holds an item; an empty table on either side takes nothing away.
    """
    name = fresh("_hit", df)
    hit = contained(df, items, percent, id_col, text_col).select(F.col(id_col).alias(name)).distinct()
    return df.join(hit, F.col(f"`{id_col}`") == F.col(name), "left_anti")
