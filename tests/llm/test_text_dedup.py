import random

import helpers
import numpy as np
import pytest

from vertexloom.llm import common, decontaminate, minhash, suffix_dedup

rng = random.Random(8)
VOCABULARY = [f"w{k}" for k in range(400)]


def words(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(VOCABULARY)
    return out


def near_copies():
    rows, base = [], words(150)
    rows += [(100 + k, " ".join(edited(base, rng.randrange(6)))) for k in range(40)]
    rows += [(200 + k, " ".join(words(60))) for k in range(15)]
    rows += [(300 + k, "Same Text here \u00e9\n" * 9) for k in range(5)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "ONE  two"), (405, "three")]
    rows += [(100, rows[0][1]), (None, rows[0][1]), (None, "alone without a name")]
    long_ = words(6000)
    rows += [(500, " ".join(long_)), (501, " ".join(long_[:5900])), (502, " ".join(long_[:3000]))]
    return rows


def test_near_duplicates_agree_with_all_pairs(spark):
    rows = near_copies()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, n string")
    got = sorted(map(str, (tuple(r) for r in minhash.near_duplicates(df, 85).collect())))
    want = [(r[0], n, c, c is None or c == r[0]) for r, (n, c) in zip(rows, helpers.components(rows, 85), strict=True)]
    assert got == sorted(map(str, want))


def test_rounds_after_the_hubs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FIRST_SHARE", 1)
    monkeypatch.setattr(minhash, "RARE", 1)
    monkeypatch.setattr(common, "HOT_PART", 50)
    monkeypatch.setattr(common, "SALT", 3)
    rows = [(k, " ".join(edited(words(1) * 0 + BASE_WORDS, k % 9))) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {r[0]: c for r, (_, c) in zip(rows, helpers.components(rows, 85), strict=True)}


BASE_WORDS = words(120)


def test_deduplicate_keeps_one_of_each_group_and_all_columns(spark):
    rows = near_copies()
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, extra int")
    kept = minhash.deduplicate(df, 80)
    assert kept.columns == df.columns
    want = {r[0] for r, (_, c) in zip(rows, helpers.components(rows, 80), strict=True) if r[0] is not None and c == r[0]}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    assert suffix_dedup.repeated_spans(none, 20).count() == 0
    assert decontaminate.contained(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contained(one, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_estimates_centre_on_the_similarity():
    a = np.unique(minhash.mix(np.arange(1, 2001, dtype=np.uint64)))
    b = np.unique(minhash.mix(np.arange(201, 2201, dtype=np.uint64)))
    _, packed, digests = minhash.sketch([a, b])
    x = np.bitwise_xor(packed[0].view(np.uint64), packed[1].view(np.uint64))
    fields = (x[:, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)
    agree = (fields == 0).mean()
    assert (agree - 1 / 16) / (15 / 16) == pytest.approx(1800 / 2200, abs=0.12)
    assert digests[0] != digests[1] and len(digests[0]) == 16


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\0"])
def test_suffix_arrays_and_prefixes_by_definition(alphabet):
    for n in (1, 2, 7, 8, 9, 40, 150):
        raw = np.array([rng.choice(alphabet) for _ in range(n)], np.uint8)
        b = raw.tobytes()
        order, rank, key = suffix_dedup.suffix_array(raw)
        assert list(order) == sorted(range(n), key=lambda i: b[i:])  # noqa: B023
        shared = suffix_dedup.common_prefixes(raw, order, rank, key)
        for k in range(1, n):
            x, y, c = b[order[k - 1] :], b[order[k] :], 0
            while c < min(len(x), len(y)) and x[c] == y[c]:
                c += 1
            assert shared[order[k]] == c


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_repeated_spans_agree_with_counting_all_strings(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    if shard == 300:  # every repeated string counts as hot
        monkeypatch.setattr(common, "HOT_PART", 100)
        monkeypatch.setattr(common, "SALT", 1)
    monkeypatch.setattr(suffix_dedup, "RANGE", shard)
    passage = " ".join(words(20))
    texts = [" ".join(words(30)) for _ in range(12)]
    texts += [f"{x} {passage} {y}" for x, y in zip(texts[:6], texts[6:], strict=True)]
    texts += [texts[0], texts[0], None, "", "\u00e9\u4e2d" * 40, "ab" * 100, "x", texts[3] + "!"]
    texts += [" ".join(words(1500)) + passage] * (shard == 300)
    ids = [k if k % 5 else None for k in range(len(texts))] if shard == 300 else range(len(texts))
    df = spark.createDataFrame([(k, t, b"k", 1) for k, t in zip(ids, texts, strict=True)], "doc_id long, text string, key binary, shard int")
    got = [tuple(r) for r in suffix_dedup.repeated_spans(df, 50, gram=8).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted(helpers.repeated_bytes(texts, 50))


def contained_by_hand(docs, items, percent):
    def parts(t):
        w = decontaminate.words_of(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    held = {i: parts(t) for i, t in items}
    out = set()
    for d, t in docs:
        s = parts(t)
        out |= {(d, i, len(s & x), len(x)) for i, x in held.items() if x and len(s & x) * 100 >= percent * len(x)}
    return out


def test_containment_in_long_documents(spark):
    items = [(k, " ".join(words(n))) for k, n in enumerate([6, 12, 30, 33, 70, 140, 300])] + [(90, "two words"), (91, None), (92, "")]
    docs = []
    for k, (_, t) in enumerate(items[:7]):
        docs.append((k, " ".join(words(900)) + " " + t.upper() + ", " + " ".join(words(500))))
        cut = t.split()
        docs.append((20 + k, " ".join(words(100) + cut[: int(len(cut) * 0.9)] + words(100))))
        docs.append((40 + k, " ".join(words(100) + cut[: len(cut) // 2] + words(100))))
    docs += [(60, "Two WORDS!"), (61, None), (62, ""), (63, "two words more"), (2**60 + 1, docs[0][1]), (None, docs[0][1])]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    got = {tuple(r) for r in decontaminate.contained(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == contained_by_hand(docs, items, 80)
    clean = {r["doc_id"] for r in decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {d for d, _ in docs} - {d for d, *_ in got if d is not None}


def test_short_items_in_many_long_documents(spark):
    items = [(k, " ".join(words(n))) for k, n in enumerate([5, 6, 7, 8, 12, 20])]
    docs = [(k, " ".join([*words(200), items[k % 6][1], *words(200)])) for k in range(600)]
    docs += [(1000 + k, " ".join([*words(90), *items[5][1].split()[:k], *words(90)])) for k in range(12, 20)]
    got = {tuple(r) for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) >= 600 and got == contained_by_hand(docs, items, 80)


def test_odd_items_and_clashing_columns(spark):
    items = [(1, " ".join(words(9)), "x"), (2, ", . !", "x"), (3, " ".join(words(12)), "y")]
    items += [items[0], (None, items[0][1], "z")]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate([items[0][1], "?! " + items[2][1], " ".join(words(4000)) + " " + items[0][1], "", None])], "doc_id long, text string, _hit int, _m long, _item int")
    asked = spark.createDataFrame(items, "item_id long, text string, _t string")
    got = [(r["doc_id"], r["item_id"], r["n_common"], r["n_item"]) for r in decontaminate.contained(df, asked).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, 8, 8), *((d, i, 5, 5) for d in (0, 2) for i in (1, 1, None))], key=str)
    kept = decontaminate.clean(df, asked)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4]


@pytest.mark.parametrize(("count", "size"), [(3, 1 << 20), (1000, 300)])
def test_items_in_blocks(spark, monkeypatch, count, size):
    monkeypatch.setattr(decontaminate, "BLOCK", count)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    items = [(k, " ".join(words(20))) for k in range(10)]
    docs = [(k, " ".join(words(50)) + " " + items[k][1]) for k in range(10)]
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, k) for k in range(10)}


def test_halves_of_windows_leave_out_anchors_that_only_repeat_alone():
    r = np.random.default_rng(4)
    text = lambda n: r.integers(97, 123, n, dtype=np.uint8)
    phrase, passage = text(60), text(410)
    alone = [np.concatenate([text(500), phrase, text(500)]) for _ in range(2)]
    whole = [np.concatenate([text(k), passage, text(k)]) for k in (0, 333)]
    kept = []
    for pair in (alone, whole):
        sides = []
        for raw in pair:
            at, h = suffix_dedup.anchors(raw)
            sides.append({(x, side, y) for x, *both in zip(h.tolist(), *(d.tolist() for d in suffix_dedup.half_digests(raw, at)), strict=True) for side, y in enumerate(both) if y >= 0})
        kept.append(sides[0] & sides[1])
    assert not kept[0] and kept[1]


def test_shuffles_of_written_tables_go_at_once(spark, tmp_path):
    from vertexloom.plans.runtime import Scratch

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffled()
    spark.range(1000).repartition(7, "id").write.mode("overwrite").parquet(str(tmp_path / "plain"))
    assert shuffled() - before  # a plain write leaves them
    before = shuffled()
    Scratch(spark, "files").put(spark.range(1000).repartition(7, "id"))
    assert not shuffled() - before


def test_passages_of_over_fifty_words_are_removed_from_400_bytes_on(spark):
    short, long = (" ".join(f"{x}{k:02}" for k in range(57)) for x in ("kkkk", "rrrr"))
    passages = [short + "x", long + "xy", " ".join(f"\u00e9\u00e9{k:02}" for k in range(60))]
    assert [len(x.encode()) for x in passages] == [399, 400, 419] and all(len(x.split()) > 50 for x in passages)
    texts = [" ".join(words(40)) + x.join(ends) + " ".join(words(40)) for x in passages for ends in ("AB", "CD")]
    texts += [" ".join(words(120)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(df).collect()}
    assert [got[k]["n_removed"] for k in range(8)] == [0, 0, 400, 400, 419, 419, 0, 0]
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [tuple(got[k][c] for c in columns) for k in range(8)] == helpers.repeated_bytes(texts, 400)
