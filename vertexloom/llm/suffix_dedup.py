"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

1. Anchors.  In every window of ``length`` bytes the smallest hash of a ``GRAM``-byte
   string is an anchor.  Equal windows have equal anchors, so a window that starts
   elsewhere too holds an anchor that occurs elsewhere too.  Only the surroundings
   of repeated anchors, and of equal texts only one, go on; nothing else can match.
   A window also holds its anchor together with the half of the window before it or
   after it, so anchors go on only if one of these halves repeats with them.
2. Shards.  Candidate texts are dealt into shards of about ``SHARD`` bytes, texts
   with the same smallest repeated anchor together; a larger group is split.  Each
   shard gets a suffix array by Larsson-Sadakane refinement: sort by eight bytes,
   then sort only the groups still tied by the rank of what follows, doubling the
   depth.  Kasai's rule (a suffix shares at most one byte less with its neighbour
   than the suffix before it) gives common prefixes: only those that do not follow
   from the one before are compared.
3. Merging.  Windows not yet matched that hold an anchor of several shards are
   written as sorted lists of 96-bit digests, cut into ranges; each range merges
   the shards' lists by binary search and tells each shard which places of its
   list were found twice.

Shards get the surroundings of anchors, not whole texts, and are read once; the
removed runs are then taken out of the texts where these are scanned.  Tasks hold
a shard or a range, never a group of copies or all lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import hot_keys, mix, over_rows, salted_join
from vertexloom.plans.runtime import Scratch

LENGTH, GRAM = 400, 32
#: Bytes of candidate text in a shard, and windows in a range of the merge, about.
SHARD, RANGE = 1 << 20, 1 << 20
#: Bytes of the ids of wanted texts that may be broadcast; a larger list joins by shuffle.
SMALL_LIST = 16 << 20
#: Odd multipliers of the two window digests.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        size, pair = max(n, 1 << 16), []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            pair.append(np.multiply.accumulate(step))
        have = _TABLES[base] = (pair[0], pair[1])
    return have


def window_digests(raw: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit digests of all strings of ``width`` bytes."""
    n = len(raw)
    if n < width:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_BASES[which], n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[width:] - total[: n - width + 1]) * inverse[: n - width + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of ``w``, from running minima of blocks in both directions."""
    n = len(x)
    y = np.concatenate([x, np.full((-n) % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some window; texts below ``length`` bytes have none."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_digests(raw, gram)
    w = length - gram + 1
    least = _sliding_min(h, w)
    edge = np.zeros(w - 1, np.uint64)
    best = ~_sliding_min(~np.concatenate([edge, least, edge]), w)
    at = np.flatnonzero(best[: len(h)] == h)
    return at, h[at]


def half_digests(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """31-bit digests of each anchor with the half of its window before it, and with the half after it; -1 where the text ends sooner.

    A window of ``length`` bytes that holds the anchor holds one of the two whole, so
    a window that starts elsewhere too has an anchor that occurs elsewhere with an equal half.
    """
    half = (length - gram + 1) // 2
    d = (window_digests(raw, half + gram) >> np.uint64(33)).astype(np.int32)
    before, after = np.full(len(at), -1, np.int32), np.full(len(at), -1, np.int32)
    a, b = at >= half, at + half + gram <= len(raw)
    before[a], after[b] = d[at[a] - half], d[at[b]]
    return before, after


def suffix_array(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks and the eight bytes at each place, by Larsson-Sadakane refinement."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : n + j] << np.uint64(56 - 8 * j)
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(n, np.int32)
    at, slots, ties, h = order, np.arange(n, dtype=np.int32), key[order], 8
    while True:
        new = np.append(True, ties[1:] != ties[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(ties)))
        rank[at] = np.repeat(slots[begin], size)
        tied = np.repeat(size > 1, size)
        slots, at = slots[tied], at[tied]
        if not len(slots):
            return order, rank, key
        after = at.astype(np.int64) + h
        # what begins beyond the end comes first, the shorter the earlier
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + np.int64(h), np.minimum(n - at, h) - 1)
        both = rank[at] * np.int64(n + h) + follow
        sort = np.argsort(both)
        at, ties = at[sort], both[sort]
        order[slots] = at
        h *= 2


def common_prefixes(raw: np.ndarray, order: np.ndarray, rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, by Kasai's rule."""
    n = len(raw)
    prior = np.empty(n, np.int32)
    prior[order[0]] = -1
    prior[order[1:]] = order[:-1]
    first = np.ones(n, bool)
    inner = (prior[1:] > 0) & (prior[:-1] >= 0)
    first[1:][inner] = raw[:-1][inner] != raw[prior[1:][inner] - 1]
    at = np.flatnonzero(first)
    size = np.zeros(len(at), np.int64)
    live = np.flatnonzero(prior[at] >= 0)
    # beyond the end stand zeros; what they add to a prefix is cut off below
    words = np.concatenate([key, np.zeros(1, np.uint64)])
    a, b, off = at[live], prior[at[live]].astype(np.int64), 0
    while len(live):
        apart = words[np.minimum(a + off, n)] ^ words[np.minimum(b + off, n)]
        over = np.maximum(a, b) + off + 8 > n
        ended = (apart != 0) | over
        if ended.any():
            # equal leading bytes of the eight: the highest bit set in the difference tells
            x = apart[ended]
            same = np.full(len(x), 8, np.int64)
            odd = x != 0
            same[odd] = (63 - np.floor(np.log2(x[odd].astype(np.longdouble))).astype(np.int64)) // 8
            size[live[ended]] = np.minimum(off + same, n - np.maximum(a, b)[ended])
            live, a, b = live[~ended], a[~ended], b[~ended]
        off += 8
    begin = np.diff(np.append(at, n))
    return np.maximum(np.repeat(size + at, begin) - np.arange(n), 0)


def repeated_starts(raw: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """True where a string of ``length`` bytes starts that also starts elsewhere; ``left`` bytes of its text remain at each place."""
    order, rank, key = suffix_array(raw)
    shared = common_prefixes(raw, order, rank, key)
    beyond = np.zeros(len(raw), np.int64)
    beyond[order[:-1]] = shared[order[1:]]
    return (np.maximum(shared, beyond) >= length) & (left >= length)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cover(flags: np.ndarray, length: int) -> np.ndarray:
    """Places covered by strings of ``length`` that start where flags are True."""
    depth = np.zeros(len(flags) + length + 1, np.int64)
    at = np.flatnonzero(flags)
    depth[: len(flags)][at] += 1
    depth[at + length] -= 1
    return np.cumsum(depth)[: len(flags)] > 0


def _near(places: np.ndarray, n: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges [place - before, place + after) within a text of n bytes."""
    if not len(places):
        return places, places
    p = np.sort(places)
    s, e = np.maximum(p - before, 0), np.minimum(p + after, n)
    new = np.append(True, s[1:] > np.maximum.accumulate(e)[:-1])
    return s[new], np.maximum.accumulate(e)[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)]


def _digest_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _cutter(length: int, gram: int):
    """Of each text only the surroundings of its anchors; rows whose text is not the one that the key names give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for shard, key, text, at, far in zip(*(pdf[c] for c in ("shard", "key", "text", "at", "far")), strict=True):
                if _digest_key(text := bytes(text)) != bytes(key):
                    continue
                begin, end = _near(np.asarray(at, np.int64), len(text), length - gram, length)
                whole = end - begin >= length
                begin, end = begin[whole], end[whole]
                out.append((shard, key, b"".join([text[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]), begin, end - begin, np.sort(np.asarray(far, np.int64))))
            yield pd.DataFrame(out, columns=["shard", "key", "raw", "begins", "sizes", "far"])

    return run


def _segments(pdf: pd.DataFrame):
    """A shard's ranges joined, a zero after each: bytes, bytes left in the range, its text's row and its place there."""
    sizes = [np.asarray(x, np.int64) for x in pdf["sizes"]]
    row = np.repeat(np.arange(len(pdf), dtype=np.int32), [len(x) for x in sizes])
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    if not len(size):
        return None
    begin = np.concatenate([np.asarray(x, np.int64) for x in pdf["begins"]])
    to = np.cumsum(size + 1) - size - 1
    raw = np.zeros(int((size + 1).sum()), np.uint8)
    at = 0
    data = np.frombuffer(b"".join(map(bytes, pdf["raw"])), np.uint8)
    for t, n in zip(to.tolist(), size.tolist(), strict=True):
        raw[t : t + n] = data[at : at + n]
        at += n
    here = np.arange(len(raw), dtype=np.int32) - np.repeat(to, size + 1).astype(np.int32)
    return raw, np.repeat(size, size + 1).astype(np.int32) - here, np.repeat(row, size + 1), here + np.repeat(begin, size + 1).astype(np.int32)


def _waiting(pdf: pd.DataFrame, row: np.ndarray, place: np.ndarray, left: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Windows that hold an anchor of several shards."""
    out = np.zeros(len(row), bool)
    begin = np.searchsorted(row, np.arange(len(pdf) + 1))
    for i, far in enumerate(pdf["far"]):
        if len(far):
            a, b = begin[i], begin[i + 1]
            here, p = place[a:b], np.asarray(far, np.int64)
            k = np.searchsorted(p, here)
            out[a:b] = (k < len(p)) & (p[np.minimum(k, len(p) - 1)] <= here + length - gram)
    return out & (left >= length)


FOUND = "shard bigint, key binary, starts array<bigint>, ends array<bigint>, waits array<bigint>, wait_ends array<bigint>, listed binary, part int, at bigint, d64 binary, d32 binary, known boolean"
_COLUMNS = [c.split(" ")[0] for c in FOUND.split(", ")]


def _search_shard(length: int, gram: int, ranges: int):
    """Stage of one shard: matched places of each text, waiting windows with their places in the digest list, and that list by range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, rows = int(pdf["shard"].iloc[0]), []
        pdf = pdf.drop_duplicates("key").sort_values("key", ignore_index=True)
        found = _segments(pdf)
        if found is None:
            return pd.DataFrame(rows, columns=_COLUMNS)
        raw, left, row, place = found
        done = repeated_starts(raw, left, length)
        every = _waiting(pdf, row, place, left, length, gram)
        wait = every & ~done
        covered = _cover(done, length)
        listed = np.zeros(0, np.uint32)
        if every.any():
            d, d2 = window_digests(raw, length, 0), (window_digests(raw, length, 1) >> np.uint64(32)).astype(np.uint32)
            for known, flags in ((False, wait), (True, every & done)):
                at = np.flatnonzero(flags[: len(d)])
                if len(at):
                    lists, places = _lists(shard, d[at], d2[at], known, ranges)
                    rows += lists
                    listed = listed if known else places
        begin, before = np.searchsorted(row, np.arange(len(pdf) + 1)), np.concatenate(([0], np.cumsum(wait)))
        for i in range(len(pdf)):
            a, b = begin[i], begin[i + 1]
            if covered[a:b].any() or wait[a:b].any():
                s, e = _runs(covered[a:b])
                w, x = _runs(wait[a:b])
                here = place[a:b]
                rows.append((shard, pdf["key"].iloc[i], here[s], here[e - 1] + 1, here[w], here[x - 1] + 1, listed[before[a] : before[b]].tobytes(), -1, 0, None, None, False))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _lists(shard: int, d: np.ndarray, d2: np.ndarray, known: bool, ranges: int) -> tuple[list[tuple], np.ndarray]:
    """Sorted distinct digests of a shard, cut at the borders of the ranges by binary search, and each window's place among them."""
    order = np.lexsort((d2, d))
    d, d2 = d[order], d2[order]
    new = np.append(True, (d[1:] != d[:-1]) | (d2[1:] != d2[:-1]))
    places = np.empty(len(d), np.uint32)
    places[order] = np.cumsum(new) - 1
    d, d2 = d[new], d2[new]
    borders = (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(d, borders), [len(d)])).tolist()
    return [(shard, None, None, None, None, None, None, p, a, d[a:b].tobytes(), d2[a:b].tobytes(), known) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a], places


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct digests as one, and those that both hold, by binary search."""
    at = np.searchsorted(a, b)
    both = np.zeros(len(b), bool)
    inside = at < len(a)
    both[inside] = a[at[inside]] == b[inside]
    fresh = b[~both]
    out = np.empty(len(a) + len(fresh), a.dtype)
    to = at[~both] + np.arange(len(fresh))
    keep = np.ones(len(out), bool)
    keep[to] = False
    out[to], out[keep] = fresh, a
    return out, b[both]


def _as_bytes(d64: bytes, d32: bytes) -> np.ndarray:
    """Digests as 12-byte strings ended by a 1, whose order is that of the pair."""
    d, e = np.frombuffer(d64, np.uint64), np.frombuffer(d32, np.uint32)
    out = np.ones((len(d), 13), np.uint8)
    out[:, :8] = d.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:12] = e.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(out).view("S13").ravel()


def _merge_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Digests that several shards hold, told to each shard as places in its list where they still wait."""
    lists = [(shard, at, known, _as_bytes(d, e)) for shard, at, known, d, e in zip(*(pdf[c] for c in ("shard", "at", "known", "d64", "d32")), strict=True)]
    # a shard's waiting and known windows differ, so its two lists can be joined
    queue = [np.sort(np.concatenate([x[3] for x in lists if x[0] == shard])) for shard in dict.fromkeys(x[0] for x in lists)]
    twice: list[np.ndarray] = []
    while len(queue) > 1:
        ahead = []
        for k in range(0, len(queue) - 1, 2):
            whole, both = _merged(queue[k], queue[k + 1])
            ahead.append(whole)
            twice.append(both)
        queue = ahead + queue[len(queue) - len(queue) % 2 :]
    found = np.unique(np.concatenate(twice)) if twice else np.zeros(0, "S13")
    rows = []
    if len(found):
        for shard, first, known, mine in lists:
            if not known:
                at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
                hit = np.flatnonzero(found[at] == mine)
                if len(hit):
                    rows.append((shard, (hit + first).astype(np.uint32).tobytes()))
    return pd.DataFrame(rows, columns=["shard", "hits"])


def _finish_shard(length: int):
    """Last stage of one shard: removed runs of each text."""

    def run(marks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows, hits = [], [np.frombuffer(h, np.uint32) for h in told["hits"]]
        found = np.zeros(max((int(h.max()) for h in hits), default=-1) + 1, bool)
        for h in hits:
            found[h] = True
        for key, starts, ends, waits, wait_ends, listed in zip(*(marks[c] for c in ("key", "starts", "ends", "waits", "wait_ends", "listed")), strict=True):
            starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
            if len(found) and len(waits):
                size = np.asarray(wait_ends, np.int64) - np.asarray(waits, np.int64)
                at = np.arange(int(size.sum())) + np.repeat(np.asarray(waits, np.int64) - np.cumsum(size) + size, size)
                places = np.frombuffer(listed, np.uint32)
                known = places < len(found)
                known[known] = found[places[known]]
                more = at[known]
                starts, ends = np.concatenate([starts, more]), np.concatenate([ends, more + length])
            if len(starts):
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], np.maximum.accumulate(ends[order])
                new = np.append(True, starts[1:] > ends[:-1])
                starts, ends = starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
                rows.append((key, int((ends - starts).sum()), starts, ends))
        return pd.DataFrame(rows, columns=["key", "n_removed", "starts", "ends"])

    return run


def _rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of what the removed runs leave of each text."""
    for pdf in batches:
        out = []
        for key, text, starts, ends in zip(*(pdf[c] for c in ("key", "text", "starts", "ends")), strict=True):
            if _digest_key(text := bytes(text)) == bytes(key):
                sha, at = hashlib.sha256(), 0
                for a, b in zip(starts, ends, strict=True):
                    sha.update(text[at:a])
                    at = b
                sha.update(text[at:])
                out.append((key, sha.hexdigest()))
        yield pd.DataFrame(out, columns=["key", "kept_sha256"])


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": [_digest_key(bytes(t)) for t in pdf["text"]], "text": pdf["text"]})


def scan_rows(df: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """id, key (128-bit digest), bytes, SHA-256 and anchors of every whole text; null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["_t"]]
            found = [anchors(np.frombuffer(t, np.uint8), length, gram) for t in texts]
            halves = [half_digests(np.frombuffer(t, np.uint8), a, length, gram) for t, (a, _) in zip(texts, found, strict=True)]
            yield pd.DataFrame({"_id": pdf["_id"], "before": [x for x, _ in halves], "after": [x for _, x in halves], "key": [_digest_key(t) for t in texts], "n_bytes": [len(t) for t in texts], "sha": [hashlib.sha256(t).hexdigest() for t in texts], "at": [a for a, _ in found], "hash": [h.view(np.int64) for _, h in found]})

    return over_rows(df, {id_col: "_id"}, text_col, run, "key binary, n_bytes bigint, sha string, at array<bigint>, hash array<bigint>, before array<int>, after array<int>")


def repeated_spans(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, starts, ends (removed byte runs) and kept_sha256.

    Texts are UTF-8 bytes, null counts as empty, and matches never cross texts.  A
    text that repeats whole and has ``length`` bytes or more is removed whole;
    shorter texts keep all.  Repeated rows count as repeated texts, other columns
    are ignored, and an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "suffix")
    gram = min(gram, length)
    scanned = scratch.put(scan_rows(df, id_col, text_col, length, gram))
    rows = scratch.put(scanned.select("_id", "key", "n_bytes", "sha"))
    texts = scratch.put(rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("copies"), F.min("_id").alias("rep"), F.first("n_bytes").alias("n_bytes")))
    # the anchors of one row of each text; more rows where an id repeats only bring more candidates
    named = texts.select(F.col("key").alias("_k"), "rep")
    once = scanned.join(named, (F.col("key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("rep"))).select("key", F.explode(F.arrays_zip("at", "hash", "before", "after")).alias("x"))
    pairs = scratch.put(once.select("key", F.col("x.at").cast("int").alias("at"), F.col("x.hash").alias("hash"), F.col("x.before").alias("before"), F.col("x.after").alias("after")))
    scratch.drop(scanned)
    again = scratch.put(pairs.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1"))
    # a string that many texts share has its rows dealt over many tasks
    hot = hot_keys(again, "hash", "c")
    alike = scratch.put(salted_join(pairs, again.select("hash"), "hash", hot, "key"))
    scratch.drop(pairs, again)
    # of those only anchors whose half before or after occurs elsewhere too; the others' windows stand alone
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("half")), F.struct(F.lit(1).alias("side"), F.col("after").alias("half"))))
    halves = alike.select("hash", "key", "at", side.alias("x")).select("key", "at", "hash", F.xxhash64("hash", "x.side", "x.half").alias("h"), "x.half").where("half >= 0").drop("half")
    shared = scratch.put(halves.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    held = scratch.put(salted_join(halves, shared.select("h"), "h", hot_keys(shared, "h", "c"), "key").select("hash", "key", "at").distinct())
    scratch.drop(alike, shared)
    chosen = held.groupBy("key").agg(F.min("hash").alias("lead"), F.count("*").alias("n")).join(texts.select("key", "n_bytes", "rep"), "key")
    # what a text brings to a shard is at most its bytes, and at most all surroundings of its anchors
    chosen = scratch.put(chosen.withColumn("weight", F.least("n_bytes", F.col("n") * (2 * length - gram))))
    total = chosen.agg(F.sum("weight")).first()[0] or 0
    shards, ranges = max(1, -(-total // SHARD)), max(1, -(-total // RANGE))
    groups = scratch.put(chosen.groupBy("lead").agg(F.ceil(F.sum("weight") / F.lit(SHARD)).alias("pieces"), F.count("*").alias("c")))
    spread = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("key"), F.col("pieces"))), F.lit(shards))).otherwise(F.pmod(F.xxhash64("lead"), F.lit(shards)))
    dealt = scratch.put(salted_join(chosen, groups, "lead", hot_keys(groups, "lead", "c"), "key").select("key", "rep", spread.alias("shard")))
    placed = held.join(dealt.select("key", "shard"), "key")
    far = placed.groupBy("hash").agg((F.min("shard") != F.max("shard")).alias("far"))
    listed = salted_join(placed, far, "hash", hot, "key").groupBy("key", "shard").agg(F.collect_list("at").alias("at"), F.filter(F.collect_list(F.when(F.col("far"), F.col("at"))), lambda x: x.isNotNull()).alias("far"))
    listed = scratch.put(listed.join(dealt.select("key", "rep"), "key"))
    scratch.drop(held, chosen)
    source = df.select(F.col(f"`{id_col}`").alias("_r"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    # an id that names several rows does not find a text: then texts are found by their digests, each once
    several = not rows.groupBy("_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()

    def texts_of(wanted: DataFrame) -> DataFrame:
        """The texts of (key, rep, ...), each key once."""
        if several:
            return wanted.join(source.where(F.length("text") >= length).mapInPandas(_keyed, "key binary, text binary").dropDuplicates(["key"]), "key").drop("rep")
        size = wanted.agg(F.sum(16 + F.length(F.coalesce(F.col("rep").cast("string"), F.lit("")))).alias("s")).first()["s"] or 0
        # texts that nobody wants are left out before they are shuffled, as long as the list of wanted ids is small
        mine = source if size > SMALL_LIST else source.join(F.broadcast(wanted.select(F.col("rep").alias("_w"))), F.col("_r").eqNullSafe(F.col("_w")), "left_semi")
        return mine.join(wanted, F.col("_r").eqNullSafe(F.col("rep"))).drop("_r", "rep")

    cut = texts_of(listed).select("shard", "key", "text", "at", "far").mapInPandas(_cutter(length, gram), "shard bigint, key binary, raw binary, begins array<bigint>, sizes array<bigint>, far array<bigint>")
    found = scratch.put(cut.groupBy("shard").applyInPandas(_search_shard(length, gram, ranges), FOUND))
    told = found.where("part >= 0").select("part", "shard", "at", "d64", "d32", "known").groupBy("part").applyInPandas(_merge_range, "shard bigint, hits binary")
    marks = found.where("part < 0").select("shard", "key", "starts", "ends", "waits", "wait_ends", "listed")
    runs = scratch.put(marks.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(_finish_shard(length), "key binary, n_removed bigint, starts array<bigint>, ends array<bigint>"))
    scratch.drop(found, listed)
    # a text that repeats goes whole, so only texts that stand alone have a rest
    partly = runs.join(texts.where("copies = 1").select("key", "rep"), "key").select("key", "rep", "starts", "ends")
    done = runs.join(scratch.put(texts_of(partly).select("key", "text", "starts", "ends").mapInPandas(_rest, "key binary, kept_sha256 string")), "key")
    state = texts.where("copies > 1").select("key", F.lit(True).alias("whole"))
    full = rows.select("_id", "key", "n_bytes", "sha").join(done, "key", "left").join(state, "key", "left")
    whole, none = F.coalesce("whole", F.lit(False)), F.array().cast("array<bigint>")
    starts = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.coalesce("starts", none))
    return full.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.size(starts).cast("bigint").alias("n_spans"),
        starts.alias("starts"),
        F.when(whole, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
