"""Near-duplicates by b-bit MinHash, with links confirmed on full shingle sets.

1. Each distinct shingle set gets ``HASHES`` minima.  Bands of ``ROWS`` minima
   make candidate keys; of each minimum the low ``BITS`` bits are kept and packed
   into 64-bit words.  Equal sets are one node from here on.
2. Within a band key every node is first held against the key's hub, the node with
   the smallest share of shingles that no other candidate holds.  Such shingles
   are common to no pair, so their numbers bound every similarity; pairs that the
   bound rules out are never formed.
   The similarity is estimated from the packed words: b-bit agreements are counted
   with bit counts and corrected for chance collisions.  Each node's best
   candidate that the estimate does not rule out is confirmed on both full sets,
   then those of its other hubs that are still in another component.
3. Links give components.  A key is open while its nodes lie in several
   components; in open keys, nodes outside the key's largest component are held
   against all nodes of other components, then retired, in rounds whose share
   grows sixteenfold, until no key is open.  Partners that share a rare shingle are
   found through that shingle; against all others a node's rare shingles count as
   not common, so a node far from its group forms no pairs with it.  Pairs already
   connected are never formed, so groups of thousands of copies cost a few comparisons a node, and no
   link between different sets that share a key is lost.

With 32 bands of 4 a pair of similarity 0.85 misses all keys with probability
6e-11 (0.8: 5e-8).  An estimate rules a pair out only six standard deviations
below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import SPACED, batch_words, chunks, frugal, hot_keys, mix, over_rows, salted_join, shingle_hashes
from vertexloom.operators.stars import star_components
from vertexloom.plans.runtime import Scratch

HASHES, ROWS, BITS, SIZE = 128, 4, 4, 5
#: A shingle of at most so many candidate sets is rare: pairs that share one are found through it.
RARE = 8
#: Nodes of a key that are held against the others in the first round, about; later rounds take sixteen times as many.
FIRST_SHARE = 1024
BANDS = HASHES // ROWS
PER_WORD = 64 // BITS
#: Lowest bit of every b-bit field.
FIELD = sum(1 << (BITS * k) for k in range(PER_WORD))

_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))
_BAND = mix(np.arange(5001, 5001 + BANDS, dtype=np.uint64))
_DIGEST = mix(np.arange(9001, 9003, dtype=np.uint64))


def minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima of hash runs that begin at ``starts``, taken in pieces that stay in cache."""
    out = np.empty((HASHES, len(starts)), np.uint64)
    buf = np.empty(len(h), np.uint64)
    for j in range(HASHES):
        np.multiply(h, _ODD[j], out=buf)
        np.add(buf, _ADD[j], out=buf)
        np.bitwise_xor(buf, buf >> np.uint64(29), out=buf)
        out[j] = np.minimum.reduceat(buf, starts)
    return out.T


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Band keys, packed b-bit words and 128-bit digests of non-empty sets given as arrays of distinct hashes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    m = np.empty((len(sets), HASHES), np.uint64)
    at = 0
    while at < len(sets):  # about 32k hashes at a time
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 32_768)))
        starts = np.concatenate(([0], np.cumsum(sizes[at:end])[:-1]))
        m[at:end] = minima(np.concatenate(sets[at:end]), starts)
        at = end
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + m[:, r::ROWS])
    bands = mix(bands ^ _BAND)
    low = mix(m) & np.uint64((1 << BITS) - 1)
    shift = (np.arange(HASHES, dtype=np.uint64) % np.uint64(PER_WORD)) * np.uint64(BITS)
    packed = np.bitwise_or.reduce((low << shift).reshape(len(sets), -1, PER_WORD), axis=2)
    digests = [b"".join(int(mix(s ^ d).sum(dtype=np.uint64)).to_bytes(8, "big") for d in _DIGEST) for s in sets]
    return bands.view(np.int64), packed.view(np.int64), digests


def shingle_sets(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each whole text; without words the array is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in chunks(raw):
        words, edges = batch_words(raw[a:b], SPACED)
        for k in range(b - a):
            w = words[edges[k] : edges[k + 1]]
            yield a + k, np.unique(shingle_hashes(w, size)) if len(w) else w


def sketches(df: DataFrame, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """id, n (set size), node (128-bit digest of the set, null if empty), keys (band keys) and sig (packed words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, node = np.zeros(len(pdf), np.int64), [None] * len(pdf)
            keys: list = [None] * len(pdf)
            sig: list = [None] * len(pdf)
            full = [(i, s) for i, s in shingle_sets(list(pdf["_t"]), size) if len(s)]
            if full:
                for (i, s), a, b, d in zip(full, *sketch([s for _, s in full]), strict=True):
                    n[i], node[i], keys[i], sig[i] = len(s), d, a, b
            yield pd.DataFrame({"_id": pdf["_id"], "n": n, "node": node, "keys": keys, "sig": sig})

    return over_rows(df, {id_col: "_id"}, text_col, run, "n bigint, node binary, keys array<bigint>, sig array<bigint>")


def full_sets(df: DataFrame, text_col: str, size: int = SIZE) -> DataFrame:
    """node and set (distinct shingle hashes) of every text with words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, sets = [], []
            for _, s in shingle_sets(list(pdf["_t"]), size):
                if len(s):
                    node.append(b"".join(int(mix(s ^ d).sum(dtype=np.uint64)).to_bytes(8, "big") for d in _DIGEST))
                    sets.append(s.view(np.int64))
            yield pd.DataFrame({"node": pd.Series(node, dtype=object), "set": pd.Series(sets, dtype=object)})

    return df.select(F.col(text_col).cast("string").alias("_t")).mapInPandas(frugal(run), "node binary, set array<bigint>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures, corrected for b-bit values that agree by chance."""
    agree = F.lit(0)
    for w in range(HASHES // PER_WORD):
        x = F.col(a)[w].bitwiseXOR(F.col(b)[w])
        spread = x
        for k in range(1, BITS):
            spread = spread.bitwiseOR(F.shiftrightunsigned(x, k))
        agree = agree + PER_WORD - F.bit_count(spread.bitwiseAND(F.lit(_signed(FIELD))))
    chance = 1 / (1 << BITS)
    return (agree / HASHES - chance) / (1 - chance)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def least_estimate(percent: int) -> float:
    """Estimates below this rule out a pair of ``percent`` similarity: six standard deviations of slack."""
    j, chance = percent / 100, 1 / (1 << BITS)
    e = chance + (1 - chance) * j
    return j - 6 * math.sqrt(e * (1 - e) / HASHES) / (1 - chance)


def near_duplicates(df: DataFrame, percent: int = 85, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id and kept.

    Rows are linked if 100 * common shingles >= percent * all shingles of both.
    component_id is the smallest id reachable over links, kept says that it is the
    row's own.  Words are what stands between ASCII white space, A-Z lower-cased;
    a text of fewer than ``size`` words is one shingle; null, empty and blank
    texts have no shingles and are linked with nothing (component_id is their own
    id).  Rows with equal sets, repeated rows among them, share a component.  Rows
    with a null id take part in links but never name a component; a component
    without any id is null and its rows count as kept.  Other columns are ignored;
    an empty table gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession, "minhash")
    sketched = scratch.put(sketches(df, id_col, text_col, size))
    rows = scratch.put(sketched.select("_id", "n", "node"))
    nodes = scratch.put(sketched.where("node is not null").groupBy("node").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    scratch.drop(sketched)
    member = nodes.select(F.explode("keys").alias("key"), "node")
    shared = scratch.put(member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    # a key that many nodes share has its rows dealt over many tasks in every join on keys
    hot = hot_keys(shared, "key", "c")
    together = scratch.put(salted_join(member, shared.select("key"), "key", hot, "node"))
    scratch.drop(shared)
    keyed, nodes = nodes, scratch.put(nodes.select("node", "rep", "n", "sig"))
    scratch.drop(keyed)
    wanted = scratch.put(together.select("node").distinct())
    named = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("_r"), F.col("rep").isNull().alias("_none"))
    texts = df.select(F.col(id_col).alias("_r"), F.col(text_col).alias("_t"))
    chosen = texts.join(named.where("not _none"), "_r", "left_semi").select("_t").union(texts.where("_r is null").select("_t"))
    sets = scratch.put(full_sets(chosen, "_t", size).join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    # shingles that no other candidate holds cannot be common to any pair
    exploded = sets.select("node", F.explode("set").alias("s"))
    alone = exploded.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    sized = nodes.select("node", "n", "sig").join(wanted, "node", "left_semi").join(alone, "node", "left")
    light = scratch.put(sized.select("node", "n", "sig", (F.col("n") - F.coalesce("own", F.lit(0))).alias("open")).where(F.col("open") * 100 >= F.col("n") * percent))
    fit = together.join(light.select("node", "n", "open"), "node")
    hubs = fit.groupBy("key").agg(F.min_by("node", F.struct(-F.col("open") / F.col("n"), "node")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    members = scratch.put(salted_join(fit, hubs, "key", hot, "node").select("key", "node", "n", "open", "hub"))
    scratch.drop(together)

    def possible(an: Column, ao: Column, bn: Column, bo: Column) -> Column:
        """Whether sizes and shingles held alone leave room for a link."""
        common = F.least(ao, bo)
        return common * 100 >= (an + bn - common) * percent

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that neither their sizes nor the estimate rule out."""
        x = pairs.join(light.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("open").alias("ao"), F.col("sig").alias("asig")), "a")
        y = light.select(F.col("node").alias("_b"), F.col("n").alias("bn"), F.col("open").alias("bo"), F.col("sig").alias("bsig"))
        x = x.join(y, (F.col("b") == F.col("_b")) & possible(F.col("an"), F.col("ao"), F.col("bn"), F.col("bo")))
        return x.withColumn("est", estimate("asig", "bsig")).where(F.col("est") >= least_estimate(percent)).select("a", "b", "an", "bn", "est")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("aset")), "a")
        x = x.join(sets.select(F.col("node").alias("b"), F.col("set").alias("bset")), "b")
        common = F.size(F.array_intersect("aset", "bset"))
        return x.where(common * 100 >= (F.col("an") + F.col("bn") - common) * percent).select("a", "b")

    star = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    hopeful = scratch.put(likely(star))
    best = hopeful.groupBy("a").agg(F.max_by(F.struct("b", "an", "bn"), "est").alias("x")).select("a", "x.*")
    component = scratch.put(star_components(confirmed(best), scratch=scratch))
    # hubs that are not yet in the node's component
    of = component.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
    apart = hopeful.join(of, F.col("a") == F.col("_i"), "left").select("a", "b", "an", "bn", F.coalesce("_c", "a").alias("ac"))
    apart = apart.join(of, F.col("b") == F.col("_i"), "left").where(F.col("ac") != F.coalesce("_c", "b")).select("a", "b", "an", "bn")
    found = scratch.put(confirmed(apart))
    if not found.isEmpty():
        component = scratch.put(_joined(component, found, scratch))
    share, active = FIRST_SHARE, members.select("key", "node", "n", "open")
    while True:
        state = active.join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        per = state.groupBy("key", "component").agg(F.count("*").alias("c"))
        keys = per.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.sum("c").alias("total"), F.max("c").alias("most"), F.count("*").alias("parts")).where("parts > 1")
        chance = F.lit(float(share)) / (F.col("total") - F.col("most"))
        drawn = F.pmod(F.xxhash64("node", "key", F.lit(share)), F.lit(1 << 30)) / float(1 << 30)
        opened = scratch.put(salted_join(state, keys, "key", hot, "node").select("key", "node", "n", "open", "component", ((F.col("component") != F.col("major")) & (drawn < chance)).alias("lead")))
        if opened.isEmpty():
            break
        scratch.drop(active)
        lead = opened.where("lead").select(F.col("key").alias("k"), F.col("node").alias("u"), F.col("n").alias("un"), F.col("open").alias("uo"), F.col("component").alias("uc"))
        # only nodes of open keys can be partners, so only their sets are looked at
        partners = sets.join(opened.select("node").distinct(), "node", "left_semi").select("node", F.explode("set").alias("s"))
        own = sets.join(lead.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("u"), F.explode("set").alias("s"))
        held = scratch.put(partners.join(own.select("s").distinct(), "s", "left_semi"))
        rare = scratch.put(held.join(held.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") <= RARE).select("s"), "s"))
        mine = rare.join(lead.select("u").distinct(), F.col("node") == F.col("u")).select("u", "s")
        by_rare = mine.join(rare, "s").where("u <> node").select(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b"))
        few = mine.groupBy(F.col("u").alias("_u")).agg(F.count("*").alias("few"))
        lead = lead.join(few, F.col("u") == F.col("_u"), "left").withColumn("uo", F.least("uo", F.col("un") - F.coalesce("few", F.lit(0)))).drop("_u", "few")
        room = possible(F.col("un"), F.col("uo"), F.col("n"), F.col("open")) & (F.col("uc") != F.col("component")) & (F.col("u") != F.col("node"))
        by_key = salted_join(opened, lead.withColumnRenamed("k", "key"), "key", hot, "node").where(room).select(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b"))
        pairs = by_rare.union(by_key).distinct()
        found = scratch.put(confirmed(likely(pairs)))
        active = scratch.put(opened.where("not lead").select("key", "node", "n", "open"))
        scratch.drop(opened, rare, held)
        if not found.isEmpty():
            component = scratch.put(_joined(component, found, scratch))
        share *= 16
    scratch.drop(opened, active, members, hopeful, light, sets)
    place = nodes.select("node", "rep").join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = place.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = place.join(least, "component").select("node", "component_id")
    out = rows.select("_id", "n", "node").join(placed, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("_id") == own, own.isNull()).alias("kept"))


def _joined(component: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after more links: only the links between components are worked on."""
    of = component.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
    ends = links.join(of, F.col("a") == F.col("_i"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
    ends = ends.join(of, F.col("b") == F.col("_i"), "left").select("a", F.coalesce("_c", "b").alias("b"))
    moved = scratch.put(star_components(ends, scratch=scratch)).select(F.col("id").alias("_f"), F.col("component").alias("_t"))
    named = component.join(moved, F.col("component") == F.col("_f"), "left").select("id", F.coalesce("_t", "component").alias("component"))
    fresh = moved.join(component.select(F.col("id").alias("_f")), "_f", "left_anti").select(F.col("_f").alias("id"), F.col("_t").alias("component"))
    return named.union(fresh)


def deduplicate(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without near copies: of each component the document with the smallest id stays.

    Rows without an id, and texts without words, all stay.  A document given by
    repeated rows stays once.
    """
    marked = near_duplicates(df.select(id_col, text_col), percent, id_col=id_col, text_col=text_col).where(F.col("kept") & F.col(id_col).isNotNull())
    counts = Scratch(df.sparkSession, "kept").put(marked.groupBy(F.col(id_col).alias("_k")).agg(F.count("*").alias("_c")))
    out = df.join(counts, df[id_col] == counts["_k"], "left_semi")
    if not counts.where("_c > 1").isEmpty():
        out = out.dropDuplicates([id_col])
    return out.unionByName(df.where(F.col(id_col).isNull()))
