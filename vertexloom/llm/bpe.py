"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two neighbours if some vocabulary token holds them side by
side.  A pair of neighbouring symbols found inside no token is therefore a
certain cut: no merge crosses it, so the fragments on both sides are encoded
independently and their ids concatenated.  The distinct words of a piece of texts
that are not remembered are cut and merged together, as arrays; words met again are
remembered in two generations, so frequent ones stay when rare ones are forgotten.

Text is first split as the vocabulary file says: special strings, NFC, lower
case, then the split pattern; bytes are written with the usual printable alphabet.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from vertexloom.llm.common import over_rows

#: Words a worker remembers before those not met again are forgotten; twice as many are held at most, beside one piece's.
CACHE = 120_000
#: Words of so many characters are encoded by themselves and not remembered; others in passes of so many.
LONG, PASS = 512, 50_000
#: Bytes of text whose words are encoded together, about; a longer text stands alone, whole.
PIECE = 4 << 20
#: The rank of a pair that no merge joins.
NEVER = np.iinfo(np.int32).max

#: Letters and numbers that Unicode 16.0 added to those of Python 3.13, as ranges of code points.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

#: Lower-case forms of capitals newer than Python 3.13's Unicode version, as (first, last, first small, step).
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A, 1), (0xA7CB, 0xA7CB, 0x0264, 1), (0xA7CC, 0xA7CC, 0xA7CD, 1), (0xA7CE, 0xA7CE, 0xA7CF, 1), (0xA7D2, 0xA7D2, 0xA7D3, 1),
    (0xA7D4, 0xA7D4, 0xA7D5, 1), (0xA7DA, 0xA7DA, 0xA7DB, 1), (0xA7DC, 0xA7DC, 0x019B, 1), (0x10D50, 0x10D65, 0x10D70, 1), (0x16EA0, 0x16EB8, 0x16EBB, 1),
]
NEW_LOWER = {a + k: b + k * step for a, z, b, step in NEW_CAPITALS for k in range(z - a + 1)}


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes: themselves if printable Latin-1, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)})
    return out


class Codec:
    """Encoder and decoder for a ``tokenizers`` JSON file of the BPE kind with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(self.rule)
        self.wide: regex.Pattern | None = None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.signs = sorted({t[0] for t in self.special if t})
        self.alphabet = [a for _, a in sorted(byte_alphabet().items())]
        self.inner, self.last = self._pairs()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._tables()

    def _pairs(self) -> tuple[set[str], set[str]]:
        """Neighbours inside tokens: pairs of plain symbols, and pairs whose second symbol ends a word."""
        inner, last = set(), set()
        for t in self.ids:
            body = t.removesuffix(self.end) if self.end and len(t) > len(self.end) else t
            ends = body != t
            for k in range(len(body) - 1):
                (last if ends and k == len(body) - 2 else inner).add(body[k : k + 2])
        return inner, last

    def _tables(self) -> None:
        """The vocabulary as arrays: ids of single bytes, pairs of bytes that may stay together, and merges as a hash table."""
        signs = {c: b for b, c in enumerate(self.alphabet)}
        self.single = np.array([self.ids[c] for c in self.alphabet], np.int64)
        self.closing = np.array([self.ids[c + self.end] for c in self.alphabet], np.int64)
        self.joins = np.zeros((2, 256, 256), bool)
        for k, pairs in enumerate((self.inner, self.last)):
            for x, y in (p for p in pairs if len(p) == 2):
                if x in signs and y in signs:
                    self.joins[k, signs[x], signs[y]] = True
        self.merged = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in self.ranks], np.int64)
        # open addressing: each round places those keys whose next slot is free
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.slots, self.slot_rank = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[at[put]], self.slot_rank[at[put]] = keys[rest[put]], rest[put]
            left = np.ones(len(rest), bool)
            left[put] = False
            rest, at = rest[left], (at[left] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (len(self.slots) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where no merge joins them."""
        keys = a << 32 | b
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.slot_rank[at], NEVER)
        open_ = np.flatnonzero((out == NEVER) & (self.slots[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            held = self.slots[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def split(self, word: str) -> list[tuple[str, ...]]:
        """The fragments of a word between certain cuts, as tuples of symbols; the last symbol carries the word end."""
        n, at, out = len(word), 0, []
        for k in range(1, n):
            if word[k - 1 : k + 1] not in (self.last if k == n - 1 else self.inner):
                out.append(tuple(word[at:k]))
                at = k
        out.append((*word[at : n - 1], word[n - 1] + self.end))
        return out

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words (UTF-8, none empty) and the offsets where each word's ids begin.

        All words are cut into fragments at once; then, in rounds, every fragment
        joins its pair of lowest rank wherever it stands, leftmost first.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size) - 1
        raw = np.frombuffer(b"".join(words), np.uint8)
        tail = np.zeros(len(raw), bool)
        tail[ends] = True
        symbols = np.where(tail, self.closing[raw], self.single[raw])
        owner = np.repeat(np.arange(len(words)), size)
        stays = np.zeros(len(raw), bool)
        stays[:-1] = self.joins[tail[1:].astype(np.int8), raw[:-1], raw[1:]] & ~tail[:-1]
        rank = np.full(len(raw), NEVER, np.int32)
        near = np.flatnonzero(stays)
        rank[near] = self._rank(symbols[near], symbols[near + 1])
        place = np.arange(len(raw))
        done_place, done_symbol = [], []
        first = np.append(True, ~stays[:-1])
        while True:
            begin = np.flatnonzero(first)
            low = np.minimum.reduceat(rank, begin) if len(begin) else np.zeros(0, np.int32)
            length = np.diff(np.append(begin, len(rank)))
            live = np.repeat(low < NEVER, length)
            # fragments without a merge are finished
            done_place.append(place[~live])
            done_symbol.append(symbols[~live])
            if not live.any():
                break
            symbols, rank, place, first = symbols[live], rank[live], place[live], first[live]
            at = np.flatnonzero(rank == np.repeat(low[low < NEVER], length[low < NEVER]))
            # places in a row share their middle symbol, as in "aaa": every other one joins
            run = np.append(True, np.diff(at) > 1)
            head = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(rank), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, rank, place, first = symbols[keep], rank[keep], place[keep], first[keep]
            at = moved[at]
            here = at[np.append(~first[1:], False)[at]]
            before = at[~first[at]] - 1
            again = np.unique(np.concatenate([here, before]))
            rank[at] = NEVER
            rank[again] = self._rank(symbols[again], symbols[again + 1])
        places, found = np.concatenate(done_place), np.concatenate(done_symbol)
        order = np.argsort(places)
        return found[order].astype("<u4"), np.searchsorted(owner[places[order]], np.arange(len(words) + 1))

    def merge(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """Apply merges by rank, leftmost first, to one fragment of any length, with a heap."""
        import heapq

        parts: list[str | None] = list(symbols)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := self.ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue
            parts[k], parts[j], right[k] = a + b, None, right[j]
            if right[k] >= 0:
                left[right[k]] = k
            for x in (left[k], k):
                if x >= 0 and right[x] >= 0 and (r := self.ranks.get((parts[x], parts[right[x]]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[right[x]]))
        return tuple(self.ids[p] for p in parts if p is not None)

    def word_ids(self, word: str) -> bytes:
        """Ids of one word of the split pattern, as little-endian 32-bit integers; for words too long for merge_all()."""
        shown = "".join(self.alphabet[b] for b in word.encode("utf-8", "surrogatepass"))
        return np.asarray([i for fragment in self.split(shown) for i in self.merge(fragment)], "<u4").tobytes()

    def learn(self, wanted: set[str]) -> list[str]:
        """Make all wanted words known; those returned are too long to be remembered."""
        known, older, fresh, long_ = self.words, self.older, [], []
        for w in wanted - known.keys():
            if (ids := older.get(w)) is not None:
                known[w] = ids
            elif len(w) < LONG:
                fresh.append(w)
            else:
                known[w] = self.word_ids(w)
                long_.append(w)
        for a in range(0, len(fresh), PASS):
            part = fresh[a : a + PASS]
            ids, edges = self.merge_all([w.encode("utf-8", "surrogatepass") for w in part])
            data, edges = ids.tobytes(), (edges * 4).tolist()
            known.update(zip(part, [data[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)], strict=True))
        return long_

    def forget(self, long_: list[str]) -> None:
        """Bound what is remembered: words not met since the last time go."""
        for w in long_:
            self.words.pop(w, None)
        if len(self.words) >= CACHE:
            self.words, self.older = {}, self.words

    def _wide(self) -> regex.Pattern:
        """The split pattern with the letters and numbers of Unicode 16.0, whatever version the regex module knows."""
        if self.wide is None:
            rule, odd_all = self.rule, ""
            for kind, added in (("L", LETTERS_16), ("N", NUMBERS_16)):
                known, odd = regex.compile(rf"\p{{{kind}}}"), ""
                for cp in range(0x250, 0x110000):
                    if known.match(c := chr(cp)) and unicodedata.category(c)[0] != kind and not any(a <= cp <= b for a, b in added):
                        odd += c
                if odd:
                    rule = rule.replace(rf"[\p{{{kind}}}]", rf"(?![{odd}])[\p{{{kind}}}]" if kind == "N" else rf"(?:(?![{odd}])\p{{{kind}}})")
                    odd_all += odd
            rest = r"[^\p{White_Space}\p{L}\p{N}]"
            self.wide = regex.compile(rule.replace(rest, f"(?:{rest}|[{odd_all}])") if odd_all else rule)
        return self.wide

    def _split_text(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        pattern = self.pattern
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if max(text) > "\u024f":
                pattern, text = self._wide(), text.translate(NEW_LOWER)
        return pattern.findall(text.lower())

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text; the distinct words of all are encoded once."""
        found: list[list[list[str] | bytes]] = []
        wanted: set[str] = set()
        for t in texts:
            if self.cut is None or not any(c in t for c in self.signs):
                parts = [self._split_text(t)]
            else:
                parts = [int(self.special[x]).to_bytes(4, "little") if x in self.special else self._split_text(x) for x in self.cut.split(t) if x]
            for p in parts:
                if not isinstance(p, bytes):
                    wanted.update(p)
            found.append(parts)
        long_ = self.learn(wanted)
        known = self.words
        out = [np.frombuffer(b"".join([p if isinstance(p, bytes) else b"".join([known[w] for w in p]) for p in parts]), "<u4") for parts in found]
        self.forget(long_)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces, as a file without a decoder asks; unknown ids give nothing."""
        names = self.names
        if len(ids) and int(ids.max()) >= len(names):
            ids = ids[ids < len(names)]
        return " ".join(filter(None, map(names.__getitem__, ids.tolist())))

    def text(self, ids: np.ndarray) -> str:
        """Readable text: bytes restored, a space after each word, special tokens left out."""
        byte = {a: b for b, a in byte_alphabet().items()}
        out = bytearray()
        for i in ids.tolist():
            if i in self.tokens and self.tokens[i] not in self.special:
                t = self.tokens[i]
                ends = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
                out += bytes(byte[c] for c in (t.removesuffix(self.end) if ends else t))
                out += b" " * ends
        return out.decode("utf-8", "replace").strip()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, read once in each process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoded(c: Codec, texts: pd.Series) -> Iterator[np.ndarray]:
    """Ids of each text in turn, piece by piece; null counts as empty."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= PIECE:
            yield from c.encode_all(held)
            held, size = [], 0
    yield from c.encode_all(held)


def tokenize(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: id, ids array<long>, decoded string.

    Null and empty texts give no ids and an empty decoding.  Repeated rows are each
    encoded, an empty table gives an empty result, other columns are ignored.  The
    vocabulary file must be readable under ``path`` on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            ids = list(_encoded(c, pdf["_t"]))
            yield pd.DataFrame({id_col: pdf[id_col], "ids": [i.astype(np.int64) for i in ids], "decoded": [c.decode(i) for i in ids]})

    return over_rows(df, {id_col: id_col}, text_col, run, "ids array<bigint>, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As tokenize(), with ids and decoding reduced where they are made to n_tokens, ids_sha256 and decoded_sha256; ``keep`` names columns to pass on."""
    cols = [id_col, *(keep or [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in batches:
            n, a, b = [], [], []
            for ids in _encoded(c, pdf["_t"]):
                n.append(len(ids))
                a.append(sha(ids.tobytes()))
                b.append(sha(c.decode(ids).encode("utf-8")))
            yield pdf[cols].assign(n_tokens=pd.Series(n, dtype="int64"), ids_sha256=a, decoded_sha256=b)

    return over_rows(df, {c: c for c in cols}, text_col, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
