"""Personal data by candidate gradient boosting, as DataFrame expressions only.

High-recall generators propose spans, which may overlap.  Format and context
features of each candidate go through boosted trees (see ``boosting``), and a
threshold calibrated for each kind selects what is redacted.  Four base patterns
are certain; the model only adds spans that overlap none of them.

The trees are fitted on the driver from ``TRAIN_ROWS`` sentences made by a seeded
generator below, since corpora carry no span labels; they become nested
conditions in the plan.  No Python runs on the executors.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import boosting

#: Made sentences for training and, separately, for calibration.
TRAIN_ROWS = 4000
#: Share of true spans that a kind's threshold must reach among those it selects.
PRECISION = 0.97

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]

#: The base patterns.  Possessive loops and look-behinds change no match: they keep
#: long runs from being tried again at every place and from nesting the stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators of the model: (kind, pattern, lower-case strings of which a matching text holds one; none: a digit).
GENERATORS = [
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[a-z0-9-]++(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[a-z0-9-]++)++", ["[at]", "(at)"]),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ at [a-z0-9-]++(?: dot [a-z0-9-]++)++", [" dot "]),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", []),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]?[0-9]{2,4}[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z])", []),
    ("ssn", r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])", []),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", []),
    ("secret", r"(?i)(?<![a-z0-9])(?:token|api[_ -]?key|secret|password|passwd|pwd)[\"']?\s?[:=]\s?[\"']?[a-z0-9+/_.-]{8,}+", ["token", "key", "secret", "passw", "pwd"]),
]

#: Strings that a text with a base match holds; none: a digit.
BASE_NEEDS = {"email": ["@"], "ip": [], "card": [], "phone": ["+"]}
#: Context words by kind, looked for in the 40 characters before a candidate.
CONTEXT = {
    "mail": "mail|contact|write|reach",
    "phone": "phone|tel|call|fax|mobile|cell|dial",
    "card": "card|visa|credit|debit|amex|payment",
    "ssn": "ssn|social|tax id",
    "bank": "iban|account|bank|transfer",
    "secret": "token|key|secret|passw|pwd",
    "number": "order|version|invoice|isbn|item|page|sum|part|ticket|row|date|price|serial",
}
#: An address written with its signs spelt out, and common last labels of host names.
MARKED = r"(?i)[\[(](at|dot)[\])]|\bdot\b"
TLD = r"(?i)(dot|\.) ?(com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu)$"
#: Digits in groups of three, two and four.
TRIPLE = r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$"
FEATURES = [*(f"is_{k}" for k in KINDS), "length", "digits", "letters", "separators", "distinct", "luhn", "year", "triple", "marked", "tld", *(f"near_{k}" for k in CONTEXT)]

def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn; other strings and the empty one do not."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).try_cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(digits) - i) % 2 == 0, d).otherwise(double)

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10 == 0, F.lit(False))


def _running(values: Column, join) -> Column:
    """Running totals of an array under an associative ``join``, in log-many passes over it."""
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(27))), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: join(x, F.get(acc, i - d))))


def found(text: Column, kind: str, pattern: str, needs: list[str], low: Column) -> Column:
    """All matches of a pattern as structs (kind, start, end, m), in code points, end exclusive.

    A text without any of the strings that a match must hold is not searched;
    ``low`` is the text in lower case.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), matches, lambda p, m: F.length(p) + F.length(m))
    ends = _running(lengths, lambda x, before: x + F.coalesce(before, F.lit(0)))
    spans = F.zip_with(ends, matches, lambda e, m: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))
    gate = reduce(or_, (low.contains(x) for x in needs)) if needs else F.col("_pii_digit")
    return F.when(gate & text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,m:string>>"))


def _passes(span: Column, kind: str) -> Column:
    """The checks that a base match must pass."""
    m = span["m"]
    if kind == "email":
        return F.lit(True)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)

    def small(part: Column) -> Column:
        trimmed = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(trimmed) > 3, False).when(trimmed == "", True).otherwise(F.expr("true") & (F.lpad(trimmed, 3, "0") <= "255"))

    return F.forall(F.split(m, r"\."), small)


def _checker(kind: str):
    return lambda span: _passes(span, kind)


def _features(span: Column, before: Column) -> dict[str, Column]:
    m = span["m"]
    plain = F.regexp_replace(m, "[^0-9]", "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    out = {f"is_{k}": flag(span["kind"] == k) for k in KINDS}
    out |= {
        "length": F.length(m).cast("double"),
        "digits": F.length(plain).cast("double"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        "separators": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        "luhn": flag((F.length(plain) > 11) & luhn(plain)),
        "year": flag(m.rlike("^(19|20)[0-9]{2}[ ./-]")),
        "triple": flag(m.rlike(TRIPLE)),
        "marked": flag(m.rlike(MARKED)),
        "tld": flag(m.rlike(TLD)),
    }
    return out | {f"near_{k}": flag(before.rlike(f"(?i){words}")) for k, words in CONTEXT.items()}


def local_features(kind: str, m: str, before: str) -> list[float]:
    """As _features(), for the training rows on the driver."""
    plain = re.sub("[^0-9]", "", m)
    total = 0
    for k, c in enumerate(reversed(plain)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    row = [float(kind == k) for k in KINDS]
    row += [len(m), len(plain), len(re.sub("[^A-Za-z]", "", m)), len(re.sub("[A-Za-z0-9]", "", m)), len(set(m)), float(len(plain) > 11 and total % 10 == 0), float(bool(re.match("(19|20)[0-9]{2}[ ./-]", m)))]
    row += [float(bool(re.search(TRIPLE, m))), float(bool(re.search(MARKED, m))), float(bool(re.search(TLD, m)))]
    return row + [float(bool(re.search(f"(?i){w}", before))) for w in CONTEXT.values()]


def training_rows(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of made candidates; half are personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    filler = lambda: " ".join(word(int(rng.integers(2, 8))) for _ in range(4)) + " "

    def checked(body: str) -> str:
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    x, y, kinds = [], [], []
    for r in range(rows):
        kind, true = KINDS[r % len(KINDS)], bool(rng.integers(2))
        before = filler()
        if kind in ("email", "ip"):
            kind = "email"
            at = pick(" [at] ", " (at) ", "[at]", " at ") if true else " at "
            dot = pick(" [dot] ", " (dot) ", " dot ") if true and at == " at " else pick(" [dot] ", " dot ", ".") if true else pick(". ", " dot ", ".")
            m = word(int(rng.integers(2, 9))) + at + word(int(rng.integers(2, 9))) + dot + (pick("com", "org", "net") if true else word(int(rng.integers(2, 7))))
            before += pick("mail ", "contact ", "") if true else ""
        elif kind == "card":
            m = checked(num(15)) if true else num(int(rng.integers(13, 19)))
            m = pick(m, f"{m[:4]} {m[4:8]} {m[8:12]} {m[12:]}")
            before += pick("card ", "visa ", "credit card ", "") if true else pick("order ", "invoice ", "", "", "")
        elif kind == "phone":
            m = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}") if true else pick(f"{pick('19', '20')}{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(4)} {num(4)}")
            before += pick("phone ", "call ", "tel ", "tel: ") if true else pick("order ", "date ", "sum ", "", "")
            if not true and rng.integers(3) == 0:
                m = f"{num(3)}{pick('-', ' ')}{num(2)}{pick('-', ' ')}{num(4)}"
                before += pick("ssn ", "phone, ssn ", "call, social security ", "tel ")
        elif kind == "ssn":
            m = f"{num(3)}{pick('-', '-', ' ')}{num(2)}-{num(4)}"
            before += pick("ssn ", "social security ", "") if true else pick("part ", "serial ", "item ", "order ")
        elif kind == "iban":
            m = word(2).upper() + num(2) + "".join(pick("", " ") + num(4) for _ in range(int(rng.integers(3, 6)))) if true else word(2).upper() + num(2) + "".join(" " + word(4).upper() for _ in range(4))
            before += pick("iban ", "account ", "") if true else ""
        else:
            mixed = lambda n: "".join(rng.choice(list("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), n))
            sign = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
            long_ = int(rng.integers(16, 60))
            good = pick(sign(32), sign(40), mixed(long_), f"{word(2)}_{word(4)}_{mixed(24)}", f"{mixed(20)}.{mixed(30)}.{mixed(25)}", word(int(rng.integers(5, 9))) + num(int(rng.integers(2, 6))), f"{word(4).title()}{num(2)}-{word(3)}-{num(2)}")
            words = [word(int(rng.integers(3, 10))) for _ in range(int(rng.integers(1, 4)))]
            bad = pick("disabled", "required", "unchanged", "aaaaaaaaaa", word(8), word(int(rng.integers(8, 13))), pick("_", "-", ".").join([*words, word(8)]), word(4).title() + word(6))
            m = pick('token = "', "token: ", "api_key=", 'api_key = "', "secret: ", "secret=", "password: ", "pwd=") + (good if true else bad)
        x.append(local_features(kind, m, before[-40:]))
        y.append(float(true))
        kinds.append(kind)
    return np.asarray(x, float), np.asarray(y), np.asarray(kinds)


@cache
def model() -> tuple[boosting.Boosted, dict[str, float]]:
    """The fitted trees and each kind's threshold; the same on every call."""
    x, y, _ = training_rows(TRAIN_ROWS, 11)
    trees = boosting.fit(x, y, FEATURES)
    x, y, kinds = training_rows(TRAIN_ROWS, 12)
    score = trees.decision(x)
    return trees, {k: boosting.threshold_for(score[kinds == k], y[kinds == k], PRECISION) for k in map(str, sorted(set(kinds)))}


def spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_pii_base`` and ``_pii_more``: arrays of (kind, start, end, m), each by kind and start.

    Null texts count as empty and have none.
    """
    trees, limits = model()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.col("_pii_low")
    base = F.concat(*(F.filter(found(text, k, p, BASE_NEEDS[k], low), _checker(k)) for k, p in BASE.items()))
    proposed = F.concat(*(found(text, k, p, needs, low) for k, p, needs in GENERATORS))
    out = df.withColumns({"_pii_low": F.lower(text), "_pii_digit": text.rlike("[0-9]")}).withColumns({"_pii_base": base, "_pii_proposed": proposed}).drop("_pii_low", "_pii_digit")
    clear = F.filter("_pii_proposed", lambda c: ~F.exists("_pii_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def selected(c: Column) -> Column:
        near = F.substring(text, F.greatest(c["start"] - 39, F.lit(1)), F.least(c["start"], F.lit(40)))
        limit = F.lit(None).cast("double")
        for k, v in limits.items():
            limit = F.when(c["kind"] == k, F.lit(v)).otherwise(limit)
        return F.coalesce(trees.column(_features(c, near)) >= limit, F.lit(False))

    return out.withColumn("_pii_more", F.filter(clear, selected)).drop("_pii_proposed")


def _ordered(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    place = F.create_map(*(x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))))
    return F.array_sort(F.transform(spans, lambda s: F.struct(place[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _joined(ordered: Column) -> Column:
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans, base_sha256, spans (base and added) and n_added of every row.

    Repeated rows are each reported, an empty table gives an empty result, other
    columns are ignored.
    """
    out = spans(df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_pii_text")), "_pii_text")
    count = lambda k: F.size(F.filter("_pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(id_col, *(count(k) for k in BASE), F.sha2(_joined(_ordered(F.col("_pii_base"))), 256).alias("base_sha256"), _joined(_ordered(F.concat("_pii_base", "_pii_more"))).alias("spans"), F.size("_pii_more").cast("long").alias("n_added"))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with every span, base and added, replaced by ``[KIND]``; overlapping spans become one.

    ``length_col`` names a column that holds the text's length and is kept true.
    Null texts stay null, empty ones empty.  All other columns, whatever their names,
    pass unchanged; repeated rows are each redacted, an empty table stays empty.
    """
    # other columns wait in a struct, so that none can clash with a name used here
    out = spans(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_pii_row"), F.col(f"`{text_col}`").cast("string").alias("_pii_text")), "_pii_text")
    text = F.col("_pii_text")
    order = F.array_sort(F.transform(F.concat("_pii_base", "_pii_more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = out.withColumn("_pii_all", order)
    out = out.withColumn("_pii_till", _running(F.transform("_pii_all", lambda s: s["end"]), lambda x, before: F.greatest(x, before)))

    def piece(s: Column, i: Column) -> Column:
        since = F.coalesce(F.get("_pii_till", i - 1), F.lit(0))
        kept = F.substring(text, since + 1, F.greatest(s["start"] - since, F.lit(0)))
        return F.when(s["start"] < since, F.lit("")).otherwise(F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]")))

    last = F.coalesce(F.get("_pii_till", F.size("_pii_till") - 1), F.lit(0))
    clean = F.concat(F.array_join(F.transform("_pii_all", piece), ""), F.substring(text, last + 1, F.length(text)))
    changed = F.when(F.size("_pii_all") > 0, clean).otherwise(text)
    out = out.withColumn("_pii_clean", changed)
    made = {text_col: F.col("_pii_clean")} | ({length_col: F.length("_pii_clean").cast(df.schema[length_col].dataType)} if length_col else {})
    return out.select(*((made[c] if c in made else F.col("_pii_row")[c]).alias(c) for c in df.columns))
