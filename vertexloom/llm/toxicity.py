"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon holds whole words and word beginnings that mark labelled toxic texts.
A word is matched by running the intersection of the trie with the Levenshtein
automata of all terms at once: states are sets of (trie node, edits so far), made
into a deterministic automaton while words are read, so misspelt terms are found
without comparing a word with each term.  Every hit is scored in a window of words
around it: quotation marks or reporting words make it a quotation, which counts
little.  A misspelt hit counts as its term less a discount for each edit; a term
bears only so many edits as hardly any clean text holds words within.  Sums by kind,
in which every occurrence counts but each further one of a term less, and the share
of words that are hits are weighed by a logistic fit.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import over_rows
from vertexloom.llm.labelled import fold, logistic, sample
from vertexloom.plans.runtime import Scratch

#: Labelled rows that lexicon and weights are learnt from, at most about so many.
TRAIN_ROWS = 20_000
#: A candidate term stands in this part of the toxic texts at least, which bounds candidates by 100 times a toxic text's terms.
LEAST_SHARE = 0.01
#: Characters of a word's beginning that can be a term; longer ones are found by these.
BEGIN_LEAST, BEGIN_MOST = 3, 12
#: What is left of a term's weight for each edit, and the share of clean texts that words within its edits may stand in.
PER_EDIT, STRAY = 0.8, 0.002
#: Least logarithm of the likelihood ratio of a term.
LEAST_WEIGHT = math.log(5)
#: Of all candidates about exp(-CHANCE) may pass by chance.
CHANCE = 1.0
#: Words on each side of a hit that its window holds.
WINDOW = 6
#: Words whose result a worker remembers; a full memory starts anew.
CACHE = 60_000
#: A toxic row counts so many times in the fit: clean rows are many, and one that passes costs less than one that stays.
TOXIC_TIMES = 5.0
#: Weights (bias, words with misspelt ones, beginnings, quoted, share) that the fit is drawn to.
PRIOR = np.array([-4.0, 3.5, 1.0, 0.2, 1.0])

TRIM = re.compile(r"^[^\w]+|[^\w]+$")
#: Words that introduce a quotation.
REPORTING = {"said", "says", "quote", "quoted", "quoting", "called", "calls", "wrote", "word", "term", "sagte", "zitat", "dit", "cite", "dijo", "cita"}
OPENING, CLOSING = "\"'“‘«„‹(", "\"'”’»“›)"


@dataclass
class Trie:
    """Nodes of the lexicon: children by character, the word and the beginning that end here, edits allowed below."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: list[str | None] = field(default_factory=lambda: [None])
    begin: list[str | None] = field(default_factory=lambda: [None])
    edits: list[int] = field(default_factory=lambda: [0])

    def add(self, term: str, is_begin: bool, edits: int) -> None:
        at = 0
        self.edits[0] = max(self.edits[0], edits)
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                for part, empty in ((self.children, {}), (self.word, None), (self.begin, None), (self.edits, 0)):
                    part.append(empty)
            at = self.children[at][c]
            self.edits[at] = max(self.edits[at], edits)
        (self.begin if is_begin else self.word)[at] = term


def allowed_edits(term: str, is_begin: bool) -> int:
    """Longer terms bear more edits; beginnings, which match more words, fewer."""
    n = len(term)
    return (n >= 8) + 0 if is_begin else (n >= 5) + (n >= 9)


class Matcher:
    """The determinised intersection; ``match`` gives (term, edits) or None."""

    def __init__(self, terms: dict[str, tuple[bool, float]], limit: dict[str, int] | None = None):
        self.limit = {t: allowed_edits(t, b) if limit is None else limit.get(t, 0) for t, (b, _) in terms.items()}
        self.weight = {t: w for t, (_, w) in terms.items()}
        self.begins = {t: b for t, (b, _) in terms.items()}
        self.trie = Trie()
        for t, (b, _) in sorted(terms.items()):
            self.trie.add(t, b, self.limit[t])
        self.alphabet = set("".join(terms))
        self.states: list[frozenset[tuple[int, int]]] = []
        self.known: dict[frozenset[tuple[int, int]], int] = {}
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[str, int] | None] = []
        self.early: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})
        self.cache: dict[str, tuple[str, int] | None] = {}

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of a set of (node, edits), closed under skipping characters of terms and freed of needless members."""
        best: dict[int, int] = {}
        todo = sorted(items, key=lambda x: x[1])
        while todo:
            node, e = todo.pop(0)
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(c, e + 1) for c in self.trie.children[node].values() if e + 1 <= self.trie.edits[c]]
        key = frozenset(best.items())
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            for out, names in ((self.whole, self.trie.word), (self.early, self.trie.begin)):
                ends = [(e, -self.weight[names[n]], names[n]) for n, e in key if names[n] is not None and e <= self.limit[names[n]]]
                out.append((min(ends)[2], min(ends)[0]) if ends else None)
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            if c in self.trie.children[node]:
                out.add((self.trie.children[node][c], e))
            if e < self.trie.edits[node]:
                out.add((node, e + 1))
            out.update((child, e + 1) for child in self.trie.children[node].values() if e + 1 <= self.trie.edits[child])
        return self._state(out) if out else -1

    def _order(self, hit: tuple[str, int]) -> tuple[int, bool, float]:
        """Fewer edits first, then whole words before beginnings, then weight."""
        return hit[1], self.begins[hit[0]], -self.weight[hit[0]]

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term that the word spells, within the term's edits."""
        if word in self.cache:
            return self.cache[word]
        body, state, early = TRIM.sub("", word), self.start, None
        for c in body:
            c = c if c in self.alphabet else ""
            nxt = self.steps[state].get(c)
            if nxt is None:
                nxt = self.steps[state][c] = self._step(state, c)
            state = nxt
            if state < 0:
                break
            if self.early[state] is not None and (early is None or self._order(self.early[state]) < self._order(early)):
                early = self.early[state]
        found = self.whole[state] if state >= 0 and body else None
        if early and (found is None or self._order(early) < self._order(found)):
            found = early
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = found
        return found


def quoted(words: list[str], k: int) -> bool:
    """Whether the window before and after word k marks it as quotation."""
    if words[k][0] in OPENING or words[k].rstrip(".,;:!?")[-1:] in CLOSING:
        return True
    before, after = words[max(0, k - WINDOW) : k], words[k + 1 : k + 1 + WINDOW]
    if any(TRIM.sub("", w) in REPORTING for w in before):
        return True
    opened = next((i for i in range(len(before) - 1, -1, -1) if before[i][0] in OPENING), None)
    return opened is not None and not any(w[-1] in CLOSING for w in before[opened:]) and any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in after)


def counted_hits(text: str, matcher: Matcher) -> tuple[dict[tuple[str, int, bool], int], int]:
    """How often a whole text holds each (term, edits, quoted), and its number of words; every occurrence is judged."""
    words = text.lower().split()
    hits = {w: m for w in set(words) if (m := matcher.match(w)) is not None}
    times: Counter[tuple[str, int, bool]] = Counter()
    if hits:
        for k, w in enumerate(words):
            if w in hits:
                times[(*hits[w], quoted(words, k))] += 1
    return times, len(words)


def features(text: str, matcher: Matcher) -> tuple[float, float, float, float, float]:
    """Sums over a whole text's hits: whole words, beginnings, misspelt ones, quoted ones; and the share of words that are unquoted hits.

    A term found n times in one way counts log2(1 + n) times its weight there.
    """
    times, n = counted_hits(text, matcher)
    sums, direct = [0.0, 0.0, 0.0, 0.0], 0
    for (term, edits, told), c in sorted(times.items()):
        kind = 3 if told else 2 if edits else 1 if matcher.begins[term] else 0
        sums[kind] += matcher.weight[term] * PER_EDIT**edits * math.log2(1 + c) / 5
        direct += 0 if told else c
    return (*sums, math.log2(1 + 100 * direct / max(n, 20)))


def margin(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of rows of features(); misspelt words weigh as whole ones do."""
    return weights[0] + np.column_stack([x[:, 0] + x[:, 2], x[:, 1], x[:, 3], x[:, 4]]) @ weights[1:]


def _terms(text: str) -> dict[str, int]:
    """Distinct words of a text, marked by a trailing blank, and their beginnings.

    Each comes with one bit of 64 for every word that stands before it.
    """
    out: dict[str, int] = {}
    before = ""
    for w in text.lower().split():
        w, bit = TRIM.sub("", w), 1 << (zlib.crc32(before.encode("utf-8", "surrogatepass")) & 63)
        before = w
        for t in (w + " ", *(w[:k] for k in range(BEGIN_LEAST, min(len(w), BEGIN_MOST) + 1))) if w else ():
            out[t] = out.get(t, 0) | bit
    return out


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(term, n, mask): texts that hold each term, and the bits of the words before it; ``wanted`` limits the terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter[str] = Counter()
            masks: dict[str, int] = {}
            for t in pdf["_t"]:
                for term, mask in _terms(t).items():
                    if wanted is None or term in wanted:
                        n[term] += 1
                        masks[term] = masks.get(term, 0) | mask
            yield pd.DataFrame({"term": list(n), "n": list(n.values()), "mask": np.array([masks[t] for t in n], np.uint64).view(np.int64)})

    return rows.select("_t").mapInPandas(run, "term string, n bigint, mask bigint").groupBy("term").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))


def _apart(n: int, mask: int) -> float:
    """Texts that count: copies of one text hold a term in one place, so no more than the distinct words before it, by linear counting."""
    bits = (mask & (2**64 - 1)).bit_count()
    return float(n) if bits >= 60 else min(float(n), -64 * math.log(1 - bits / 64))


def _evidence(a: float, n: int, b: float, m: int) -> float:
    """Likelihood-ratio statistic of a term in ``a`` of ``n`` texts against ``b`` of ``m``."""
    part = lambda x, y: x * math.log(x / y) if x > 0 else 0.0
    p = (a + b) / (n + m)
    return 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(b, m * p) + part(m - b, m * (1 - p)))


def learn_lexicon(rows: DataFrame) -> dict[str, tuple[bool, float]]:
    """Terms that mark toxic rows (``_t``, ``_y``), with whether they are word beginnings and their weight.

    The weight is the logarithm of how much likelier a toxic text holds the term.
    """
    total = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(3, int(toxic * LEAST_SHARE))
    spread = (F.bit_count("mask") >= 60) | (-64 * F.log(1 - F.least(F.bit_count("mask"), F.lit(63)) / 64) >= least)
    seen = _counted(rows.where("_y = 1"), None).where((F.col("n") >= least) & spread)
    bad = {r["term"]: _apart(r["n"], r["mask"]) for r in seen.collect()}
    good = {r["term"]: r["n"] for r in _counted(rows.where("_y = 0"), set(bad)).collect()}
    rate = {t: math.log((bad[t] + 0.5) / (toxic + 1)) - math.log((good.get(t, 0) + 0.5) / (clean + 1)) for t in bad}
    chance = 2 * (math.log(max(1, len(bad))) + CHANCE)
    marks = {t for t in bad if rate[t] >= LEAST_WEIGHT and _evidence(bad[t], toxic, good.get(t, 0), clean) >= chance}
    longer: dict[str, list[str]] = {}
    for t in marks:
        longer.setdefault(t[:-1], []).append(t)

    def widest(t: str) -> str:
        """The longest extension that hardly loses a text; a blank at its end says that only the whole word is meant."""
        while more := [x for x in longer.get(t, ()) if bad[x] >= 0.97 * bad[t]]:
            t = max(more, key=lambda x: (bad[x], x))
        return t

    kept = [t for t in marks if t.endswith(" ")]
    begins: list[str] = []
    for t in sorted({widest(t) for t in marks if not t.endswith(" ")}, key=lambda t: (len(t), t)):
        if not t.endswith(" ") and t + " " not in marks and not any(t.startswith(s) for s in begins):
            begins.append(t)
    return {t.rstrip(" "): (not t.endswith(" "), rate[t]) for t in sorted(kept + begins)}


def edit_limits(rows: DataFrame, terms: dict[str, tuple[bool, float]]) -> dict[str, int]:
    """The edits that each term bears: at most allowed_edits(), and no more than leave its misspellings to a ``STRAY`` share of clean rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(terms)
        for pdf in batches:
            n: Counter[tuple[str, int]] = Counter()
            for t in pdf["_t"]:
                n.update({(term, edits) for w in set(t.lower().split()) if (hit := m.match(w)) is not None and hit[1] for term, edits in [hit]})
            yield pd.DataFrame([(t, e, c) for (t, e), c in n.items()], columns=["term", "edits", "n"])

    clean = rows.where("_y = 0")
    total = clean.count()
    strays = {(r["term"], r["edits"]): r["n"] for r in clean.select("_t").mapInPandas(run, "term string, edits int, n bigint").groupBy("term", "edits").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for t, (begin, _) in terms.items():
        most = allowed_edits(t, begin)
        out[t] = next((e - 1 for e in range(1, most + 1) if strays.get((t, e), 0) > max(1, STRAY * total)), most)
    return out


@dataclass
class Model:
    terms: dict[str, tuple[bool, float]]
    limit: dict[str, int]
    weights: list[float]

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.limit)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin(x, np.asarray(self.weights)), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, bound: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn lexicon, edits and weights from labelled rows outside the held-out fold (see ``labelled.sample``).

    Without labels of both kinds the lexicon is empty and all texts score alike.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.put(sample(docs, labels, "toxic", parts, held, bound, id_col, text_col))
    terms = learn_lexicon(rows)
    limit = edit_limits(rows, terms) if terms else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(terms, limit)
        for pdf in batches:
            x = [features(t, m) for t in pdf["_t"]]
            yield pd.DataFrame({**{f"x{k}": [a[k] for a in x] for k in range(5)}, "y": pdf["_y"].astype("float64")})

    seen = rows.mapInPandas(run, "x0 double, x1 double, x2 double, x3 double, x4 double, y double").toPandas()
    scratch.drop(rows)
    x = seen[[f"x{k}" for k in range(5)]].to_numpy(float)
    z = np.column_stack([x[:, 0] + x[:, 2], x[:, 1], x[:, 3], x[:, 4]])
    return Model(terms, limit, [float(w) for w in logistic(z, seen["y"].to_numpy(float), PRIOR, 1.0, signed=False, heavier=TOXIC_TIMES)])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), the four hit sums and the share of every row.

    Null texts count as empty and get the score of a text without hits.  Repeated
    rows are each scored, an empty table gives an empty result, other columns are
    ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.matcher()
        for pdf in batches:
            x = np.array([features(t or "", m) for t in pdf["_t"]], float).reshape(-1, 5)
            yield pd.DataFrame({id_col: pdf[id_col], "score": model.scores(x), "words": x[:, 0], "beginnings": x[:, 1], "misspelt": x[:, 2], "quoted": x[:, 3], "share": x[:, 4]})

    return over_rows(df, {id_col: id_col}, text_col, run, "score double, words double, beginnings double, misspelt double, quoted double, share double")


def report(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, limit: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``limit``; the order of columns stays.

    Null and empty texts score as texts without hits; rows without an id and
    repeated rows are judged each by its text.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.matcher()
        for part in texts:
            yield pd.Series(model.scores(np.array([features(t or "", m) for t in part], float).reshape(-1, 5)), dtype="float64")

    return docs.where(F.pandas_udf(run, "double")(F.col(f"`{text_col}`").cast("string")) < limit)
