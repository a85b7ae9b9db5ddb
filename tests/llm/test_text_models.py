import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vertexloom.llm import bm25, boosting, decontaminate, quality, toxicity
from vertexloom.llm import labelled as samples

rng = random.Random(9)
PLAIN = [f"{a}{b}" for a in ("ton", "ria", "mel", "sta", "vo", "ker") for b in ("da", "lin", "gor", "pes", "u", "rak")]


def plain(n):
    return [rng.choice(PLAIN) for _ in range(n)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {"scum": (False, 7.0), "idiot": (False, 7.0), "worthless": (False, 7.0), "stupidly": (False, 6.0)}
    m = toxicity.Matcher(terms)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "z", "e", "ss"])
            w = "".join(w)
            best = min(((levenshtein(w, x), x) for x in terms if levenshtein(w, x) <= toxicity.allowed_edits(x, False)), default=None)
            got = m.match(w)
            assert (got is None) == (best is None) and (best is None or got[1] == best[0])
    assert m.match('"idiot!!"') == ("idiot", 0) and m.match("id1ot") == ("idiot", 1) and m.match("") is None


def test_texts_are_not_shuffled_to_be_measured(spark):
    docs = spark.createDataFrame([(k, "word " * k) for k in range(60)], "_i long, _t string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 60, 3)], "_i long, _y int")
    sized = samples.sizes(docs, labels)
    plan = sized._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert "_t" not in plan.output().mkString(" ")
    assert sorted(map(tuple, sized.collect())) == [(k, 5 * k, k % 2) for k in range(0, 60, 3)]
    got = samples.sample(docs, labels.withColumnRenamed("_y", "toxic"), "toxic", 3, 1, 1000, "_i", "_t").count()
    assert got == sum(1 for k in range(0, 60, 3) if zlib.crc32(str(k).encode()) % 3 != 1)


def test_beginnings_match_longer_words():
    m = toxicity.Matcher({"achlich": (True, 3.0), "achlichau": (False, 5.0)})
    assert m.match("achlichen") == ("achlich", 0) and m.match("achlichau") == ("achlichau", 0) and m.match("ach") is None


def test_quotations_are_told_from_abuse():
    m = toxicity.Matcher({"idiot": (False, 5.0)})
    assert toxicity.features("you are an idiot, really", m) == (1.0, 0.0, 0.0, 0.0, math.log2(6))
    assert toxicity.features('they said "idiot" to nobody', m) == (0.0, 0.0, 0.0, 1.0, 0.0)
    assert toxicity.features("he used the word idiot here", m)[3] == 1.0
    assert toxicity.features("an idoit", m)[2] == 0.0 and toxicity.features("an idiiot", m)[2] == toxicity.PER_EDIT


def labelled(n, low):
    docs, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        w = plain(40)
        if bad:
            w = [x + "$$$" for x in w] if low else w[:20] + ["idiot", "scum"] + w[20:]
        docs.append((k, " ".join(w), "en", k))
        labels.append((k, int(not bad), int(bad and not low)))
    docs += [(5000, None, "en", 0), (5001, "", "en", 0), (None, "x", "en", 0), (0, docs[0][1], "en", 0)]
    labels += [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return docs, labels


def test_quotations_do_not_use_up_later_hits():
    m = toxicity.Matcher({"idiot": (False, 5.0), "scum": (True, 2.5)})
    gap = " and so on it went for a while longer"
    told = " they said \"idiot\" and \"idiiot\"" + gap
    three = toxicity.features(told * 3, m)
    assert three[:3] == (0.0, 0.0, 0.0) and three[3] == pytest.approx((1 + toxicity.PER_EDIT) * 2)
    assert toxicity.features(told * 3 + " you idiot" + gap, m)[:4] == pytest.approx((1.0, 0.0, 0.0, three[3]))
    many = [toxicity.features(told * 3 + gap + " you idiot scumbag idiiot" * n, m) for n in (1, 3, 100)]
    assert all(x < y for k in range(3) for x, y in zip([f[k] for f in many], [f[k] for f in many][1:], strict=False))
    assert many[1][:3] == pytest.approx((2.0, 1.0, 2 * toxicity.PER_EDIT))


def plain_features(text, model):
    """features() by comparing every word with every term."""
    def closest(word):
        body, best = re.sub(r"^\W+|\W+$", "", word), []
        for t, (begins, w) in model.terms.items():
            for x in ([body[:k] for k in range(len(body) + 1)] if begins else [body]):
                if body and (e := levenshtein(x, t)) <= model.limit[t]:
                    best.append((e, begins, -w, t))
        return min(best, default=None)

    words, times = text.lower().split(), Counter()
    for k, w in enumerate(words):
        if hit := closest(w):
            times[hit[3], hit[0], toxicity.quoted(words, k)] += 1
    out, direct = [0.0] * 4, 0
    for (t, e, told), c in times.items():
        out[3 if told else 2 if e else 1 if model.terms[t][0] else 0] += model.terms[t][1] * toxicity.PER_EDIT**e * math.log2(1 + c) / 5
        direct += 0 if told else c
    return (*out, math.log2(1 + 100 * direct / max(20, len(words))))


def test_scores_by_comparing_every_word_with_every_term(spark):
    terms = {"idiot": (False, 5.0), "worthless": (False, 4.0), "scum": (False, 6.0), "achlich": (True, 3.0)}
    model = toxicity.Model(terms, {"idiot": 1, "worthless": 2, "scum": 0, "achlich": 0}, [-4.0, 2.0, 0.5, 0.1, 1.0])
    some = ["idiot", "idiiot", "wortless", "worhtless", "scum", "scam", "achlichen", '"idiot"', "said", "worthless!"]
    rows = [(k, " ".join(rng.choice(some) if rng.random() < 0.1 else x for x in plain(60)), 0.5) for k in range(80)] + [(90, None, 0.0), (91, "", 0.0), (92, "scum " * 5000, 0.0), (92, "scum " * 5000, 0.0)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, share double"), model).collect()
    assert len(got) == len(rows)
    for r, (_, t, _) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        f = plain_features(t or "", model)
        assert (r["words"], r["beginnings"], r["misspelt"], r["quoted"], r["share"]) == pytest.approx(f)
        x = -4.0 + 2.0 * (f[0] + f[2]) + 0.5 * f[1] + 0.1 * f[3] + f[4]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))


@pytest.mark.parametrize("what", ["quality", "toxicity"])
def test_held_out_accuracy_and_odd_rows(spark, what):
    docs, labels = labelled(400, what == "quality")
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score long")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = (quality if what == "quality" else toxicity).report(d, y).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    truth = {k: (q if what == "quality" else t) for k, q, t in labels if q is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_misspelling_a_toxic_text_keeps_it_toxic(spark):
    docs, labels = labelled(400, False)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.limit["idiot"] == 1
    m = model.matcher()
    of = lambda t: float(model.scores(np.array([toxicity.features(t, m)]))[0])
    text = " ".join(plain(30))
    assert of(text) < 0.3 < 0.7 < of(f"{text} you idiiot, idiott and scum") and of(f"{text} you idiiot, idiott and idjot") > 0.7
    assert of(f'{text} they called him "idiot" once') < 0.7


SOME = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SOME), reason="no test tables")
def test_held_out_toxicity_of_the_tables(spark):
    labels = spark.read.parquet(f"{SOME}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.report(spark.read.parquet(f"{SOME}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in held}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.9 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.95


@pytest.mark.parametrize("op", [quality, toxicity])
def test_models_without_labels(spark, op):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.report(docs, none).count() == 1 and op.report(docs.where("false"), none).count() == 0


def test_reject_keeps_clean_rows_and_columns(spark):
    docs, labels = labelled(300, False)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score long")
    kept = toxicity.reject(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {5000, 5001, None} <= set(ids) and not {i for i in ids if i is not None and i < 300 and i % 5 == 0}
    assert len([i for i in ids if i is not None and i < 300]) >= 238


def test_dual_descent_separates():
    f = [np.array([k % 2, 2 + k % 7]) for k in range(60)]
    y = np.array([k % 2 for k in range(60)])
    ratio = quality.log_ratios(f, y)
    w, b = quality.dual_descent(f, y, ratio)
    assert all((float(w[x] @ ratio[x]) / np.linalg.norm(ratio[x]) + b > 0) == bool(v) for x, v in zip(f, y, strict=True))


def test_dual_descent_meets_the_conditions_of_an_optimum():
    r = np.random.default_rng(5)
    f = [np.unique(r.integers(0, 40, 12)) for _ in range(120)]
    y = np.array([int((x < 20).sum() + r.normal() > (x >= 20).sum()) for x in f])
    ratio = quality.log_ratios(f, y)
    for label in (0, 1):
        counts = Counter(int(v) for x, k in zip(f, y, strict=True) if k == label for v in x)
        total = sum(counts.values()) + quality.SMOOTH * quality.BUCKETS
        part = np.log((np.array([counts[k] for k in range(40)]) + quality.SMOOTH) / total)
        plain = part - plain if label else part
    assert np.allclose(ratio[:40], plain)
    w, b = quality.dual_descent(f, y, ratio)
    rows = np.zeros((len(f), 41))
    for k, x in enumerate(f):
        rows[k, x], rows[k, 40] = ratio[x] / np.linalg.norm(ratio[x]), 1.0
    sign, v = np.where(y > 0, 1.0, -1.0), np.append(w[:40], b)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y <= 0).sum())) * quality.COST * 20
    loss = lambda u: 0.5 * u @ u + float(cost @ np.maximum(0.0, 1 - sign * (rows @ u)))
    assert all(loss(v) <= loss(v + 0.05 * r.normal(size=41)) for _ in range(500))


def test_quality_scores_by_plain_sums(spark):
    docs, labels = labelled(120, True)
    docs += [(6000, "Long text of many words. " * 8000, "en", 1), (6000, "Long text of many words. " * 8000, "en", 1)]
    model = quality.train([(t or "").encode() for _, t, *_ in docs], np.array([k % 2 for k in range(len(docs))]))
    got = quality.score(spark.createDataFrame(docs, "doc_id long, text string, lang string, score long"), model).collect()
    want = []
    for d, t, *_ in docs:
        _, f = quality.batch_features([(t or "").encode()])
        total, length = sum(float(model.weights[k]) for k in f), math.sqrt(sum(float(model.squares[k]) for k in f))
        want.append((d, round(1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * (total / max(length, 1e-9) + model.bias)))), 5)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], round(r["score"], 5))) for r in got)


def test_boosted_trees_equal_their_columns(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(2).normal(size=(300, 3))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    m = boosting.fit(x, y, ["a", "b", "c"], trees=6)
    assert ((m.decision(x) > 0) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in df.select(m.column({n: F.col(n) for n in "abc"})).collect()]
    assert got == pytest.approx(list(m.decision(x)), abs=1e-3)
    assert boosting.threshold_for(np.array([3.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0]), 0.9) == 1.5


def best_by_hand(docs, asked, k):
    tf = [Counter(decontaminate.words_of(t)) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    n, mean = len(docs), sum(size) / len(docs)
    df = Counter(x for c in tf for x in c)
    out = {}
    for q, t in asked:
        scores = []
        for (d, _), c, length in zip(docs, tf, size, strict=True):
            s = [m * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * length / mean)) for x, m in Counter(decontaminate.words_of(t)).items() if x in c]
            if s:
                scores.append((-round(sum(s), 6), d))
        out[q] = sorted(scores)[:k]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize(("shard", "size", "block", "asked_at_once"), [(10_000, 1 << 20, 64, 1 << 20), (37, 1 << 20, 4, 9_000), (10_000, 5_000, 2, 20_000)])
def test_search_is_exact(spark, monkeypatch, shard, size, block, asked_at_once):
    for name, v in (("SHARD", shard), ("SHARD_BYTES", size), ("BLOCK", block), ("QUERY_BYTES", asked_at_once)):
        monkeypatch.setattr(bm25, name, v)
    docs = [(k, " ".join(plain(rng.randrange(1, 60)))) for k in range(200)] + [(900 + k, "same words here") for k in range(15)] + [(990, None), (991, "")]
    docs += [(7, docs[7][1])] * 3 + [(7, "another text of one id"), (None, docs[20][1])] + [(950, " ".join(plain(4000)))]
    asked = [(k, docs[k][1]) for k in range(0, 200, 20)] + [(990, None), (991, ""), (992, "unknownword"), (993, "same words tonda tonda"), (None, "same"), (950, docs[-1][1])]
    d = spark.createDataFrame([(*x, 1, 2, "q") for x in docs], "doc_id long, text string, score int, rank int, query_id string")
    got = defaultdict(list)
    for r in bm25.top_k(d, spark.createDataFrame(asked, "query_id long, query string"), 10).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["doc_id"]))
    want = best_by_hand([(-1 if i is None else i, t or "") for i, t in docs], [(q, t or "") for q, t in asked if q is not None], 10)
    assert set(got) == set(want)
    for q, rows in got.items():
        rows.sort()
        assert [-1 if r[2] is None else r[2] for r in rows] == [i for _, i in want[q]]
        assert [r[1] for r in rows] == pytest.approx([-s for s, _ in want[q]], abs=1e-5)


def test_pivots_leave_most_postings_unread(monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 16)
    topics = [[f"{a}{k}" for k in range(40)] for a in "abcdefgh"]
    texts = [" ".join([*rng.choices(rng.choice(topics), k=30), "the", "of"]).encode() for _ in range(2000)]
    order, made = bm25.build(texts, np.ones(len(texts), np.int64))
    index = bm25.Index(made, 32.0)
    held = np.diff(index.offsets)
    idf = np.log(1 + (len(texts) - held + 0.5) / (held + 0.5))
    every = 0
    for text in texts[::100]:
        _, terms, counts = next(bm25.term_counts([text]))
        at = np.searchsorted(index.terms, terms)
        weights = counts * idf[at]
        found, score, limit = index.search(terms, weights, 10)
        exact = np.zeros(len(texts))
        for t, w in zip(at, weights, strict=True):
            posts = slice(index.offsets[t], index.offsets[t + 1])
            exact[index.docs[posts]] += w * index.impact[posts]
        every += int(held[at].sum())
        best = np.sort(exact)[::-1][:10]
        assert np.allclose(np.sort(score)[::-1][:10], best) and limit == pytest.approx(best[-1]) and np.allclose(exact[found], score)
    assert index.scored < 0.6 * every and index.scored + index.looked < 0.9 * every


def test_queries_side_by_side_find_what_they_find_alone(monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 8)
    monkeypatch.setattr(bm25, "WIDE", 20)
    texts = [" ".join([*plain(rng.randrange(0, 50)), *(f"rare{rng.randrange(300)}" for _ in range(9))]).encode() for _ in range(150)] + [b""]
    index = bm25.Index(bm25.build(texts, np.ones(len(texts), np.int64))[1], 30.0)
    asked = [(t, c * np.linspace(0.5, 3.0, len(t))) for _, t, c in bm25.term_counts([*texts[::4], b"", b"unknownword", b"rare1 rare2"])]
    limits = np.zeros(len(asked))
    q, d, s = index.search_many(np.append(0, np.cumsum([len(t) for t, _ in asked])), np.concatenate([t for t, _ in asked]), np.concatenate([w for _, w in asked]), 10, limits)
    for j, (terms, weights) in enumerate(asked):
        exact = np.zeros(len(texts))
        for t, w in zip(terms, weights, strict=True):
            at = np.flatnonzero(index.terms == t)
            if len(at):
                posts = slice(index.offsets[at[0]], index.offsets[at[0] + 1])
                exact[index.docs[posts]] += w * index.impact[posts]
        places = np.lexsort((np.arange(len(texts)), -exact))[:10]
        best = [p for p in places if exact[p] > 0]
        got = dict(zip(d[q == j].tolist(), s[q == j].tolist(), strict=True))
        assert set(best) <= set(got) and got == pytest.approx({p: exact[p] for p in got})
        assert limits[j] == pytest.approx(exact[best[-1]] if len(best) == 10 else 0.0)


def test_candidates_stay_few_however_many_shards(spark, monkeypatch):
    from vertexloom.plans.runtime import Scratch

    assert bm25.phases(1) == [(0, 1)] and bm25.phases(6) == [(0, 6)] and bm25.phases(69) == [(0, 4), (4, 16), (16, 69)]
    monkeypatch.setattr(bm25, "SHARD", 10)
    made, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, *a, **b: (made.append(out := put(self, df, *a, **b)), out)[1])
    counted, drop = [], Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, *f: (counted.extend(x.count() for x in made if "_n" in x.columns and "_s" in x.columns), drop(self, *f))[1])
    docs = spark.createDataFrame([(k, " ".join(plain(40))) for k in range(500)], "doc_id long, text string")
    asked = docs.where("doc_id % 20 = 0").selectExpr("doc_id as query_id", "text as query")
    assert bm25.top_k(docs, asked, 10).count() == 250
    # 50 shards in as many tasks at most: ten of each would be 500 a query
    assert 10 * 25 <= sum(counted) < 150 * 25


def test_search_over_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert bm25.top_k(none, q).count() == 0
    assert bm25.top_k(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), q.where("false")).count() == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.isdir("/opt/tokenizers"), reason="no test tables")
def test_pipeline_stage_by_stage(spark):
    import helpers

    import corpus_pipeline
    from vertexloom.llm import bpe, pii

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    w = model.weights
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    told = {t: plain_features(t, model) for _, t in rows}
    rows = [(d, t) for d, t in rows if 1 / (1 + math.exp(-(w[0] + w[1] * (told[t][0] + told[t][2]) + w[2] * told[t][1] + w[3] * told[t][3] + w[4] * told[t][4]))) < 0.7]
    rows = [r for r, (_, c) in zip(rows, helpers.components(rows, 80), strict=True) if c == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    from test_text_dedup import contained_by_hand

    hit = {d for d, *_ in contained_by_hand(rows, items, 80)}
    rows = [r for r in rows if r[0] not in hit]
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    c = bpe.codec(corpus_pipeline.TOKENIZER)
    want = sorted((r["doc_id"], len(c.encode(r["text"]))) for r in clean)
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
