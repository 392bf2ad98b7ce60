import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kataloom.llm import cooccur, nearjoin
from kataloom.llm.cooccur import cooccurring_items
from kataloom.llm.formatdups import formatting_duplicates, nested_duplicates
from kataloom.llm.lookalike import canonical_text, lookalike_groups
from kataloom.llm.nearjoin import WORD, near_duplicate_groups
from kataloom.llm.termfreq import term_frequencies, usefulness

BASKETS = "rid bigint, tokens array<string>, i string, n string, item string, token string"


def baskets(frame, rows):
    return frame([(i, t, "i", "n", "item", "token") for i, t in rows], BASKETS)


def brute_pairs(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).update(x for x in t or [] if x)
    sets = {i: s for i, s in sets.items() if s}
    one = Counter(x for s in sets.values() for x in s)
    two = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    return len(sets), one, two


@pytest.mark.parametrize("limits", [{}, {"DICTIONARY": 0}, {"PAIR_NS": 1e12, "RECORDS": 16}, {"PAIR_NS": 1e12, "TILES": 1, "BLOCK": 64}, {"PAIR_NS": 0.0, "LONG": 10**6}], ids=str)
def test_pairs_against_brute_force(frame, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(cooccur, name, value)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(700)]
    rows = [(rng.randrange(150), [rng.choice(words[: rng.choice((5, 40, 700))]) for _ in range(rng.randrange(12))]) for _ in range(250)]
    rows += [(900, words), (901, None), (902, ["", None]), (None, ["a"]), (903, ["w1", "w1", None, "w2"]), (903, ["w3"])]
    n, one, two = brute_pairs(rows)
    got = {(r["token_a"], r["token_b"]): r for r in cooccurring_items(baskets(frame, rows), "rid", "tokens", min_count=2).collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == {k: v for k, v in two.items() if v >= 2}
    for (a, b), r in got.items():
        assert (r["n_records"], r["n_a"], r["n_b"]) == (n, one[a], one[b]) and r["pmi"] == pytest.approx(math.log2(n * r["n_ab"] / (one[a] * one[b])))


def test_pair_limits_and_hot_record(frame):
    rows = [(1, ["a", "b"])] * 200 + [(i, ["a", "b"] if i % 2 else ["c"]) for i in range(2, 42)]
    got = cooccurring_items(baskets(frame, rows), "rid", "tokens", min_count=4, share_of_records=2, min_ratio=1).collect()
    assert [(r["token_a"], r["token_b"], r["n_ab"], r["n_records"]) for r in got] == [("a", "b", 21, 41)]
    assert cooccurring_items(baskets(frame, []), "rid", "tokens").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é", "", None]), max_size=6))), max_size=25))
def test_terms_against_counting(spark, rows):
    df = spark.createDataFrame(rows, "rid bigint, tokens array<string>").withColumn("term", F.lit(1)).withColumn("times", F.lit(2))
    clean = [(i, [x for x in t or [] if x]) for i, t in rows if i is not None]
    count = Counter(x for _, t in clean for x in t)
    docs = Counter(x for x, _ in {(x, i) for i, t in clean for x in t})
    assert {r["term"]: (r["count"], r["doc_freq"]) for r in term_frequencies(df, "rid", "tokens").collect()} == {x: (count[x], docs[x]) for x in count}


def test_hot_term_over_partitions(spark):
    df = spark.range(20_000).select(F.col("id").alias("rid"), F.expr("array('hot', concat('t', id % 700), 'hot')").alias("tokens"))
    got = {r["term"]: r for r in term_frequencies(df, "rid", "tokens").collect()}
    assert (got["hot"]["count"], got["hot"]["doc_freq"]) == (40_000, 20_000) and sum(r["doc_freq"] for r in got.values()) == 40_000
    marks = spark.createDataFrame([(1,), (2,), (3,), (11,)], "d bigint").select(usefulness(F.col("d"), 100)).collect()
    assert [m[0] for m in marks] == ["rare", "rare", None, "common"]


TEXTS = "id bigint, text string, root string, plain string, d1 string, n string"


def texts(frame, rows):
    return frame([(i, t, "r", "p", "d", "n") for i, t in rows], TEXTS)


def test_formatting_duplicates(frame):
    rows = [
        (1, "Halo, dunia yang luas!"), (2, "halo   DUNIA\tyang\nluas"), (3, "halo dunia yang luas "), (4, "a: satu dua; b: tiga empat"), (5, "B = Tiga Empat | A = satu dua."),
        (6, "asatudua btigaempat"), (7, "a: satu; tiga empat lima"), (8, "tiga empat lima; a: satu"), (9, "pendek!"), (10, "Pendek"), (11, None), (12, ""), (None, "halo dunia yang luas"),
        (13, "x: satu dua tiga\ny: empat\n"), (14, "y: empat\r\nx: satu dua tiga"), (15, "еmpat lima enam tujuh"), (16, "empat lima enam tujuh"),
    ]
    got = {r["id"]: (r["first_id"], r["copies"]) for r in formatting_duplicates(texts(frame, rows), "id", "text").collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 3), 5: (4, 3), 6: (4, 3), 13: (13, 2), 14: (13, 2)}
    assert formatting_duplicates(texts(frame, []), "id", "text").count() == 0


def test_formatting_bridge(frame):
    # The middle text reads as fields in two ways; its plain form joins both.
    rows = [(1, "a: bcdefgh; i: jklmnop"), (2, "i: jklmnop; a: bcdefgh"), (3, "ab: cdefgh; i: jklmnop"), (4, "i: jklmnop; ab: cdefgh")]
    got = {r["id"]: r["first_id"] for r in formatting_duplicates(texts(frame, rows), "id", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_canonical_text(frame):
    cases = [
        ("Ｈａｌｏ！", "Halo!"), ("é", "é"), ("a​b­c⁠﻿", "abc"), ("a b　c d", "a b c d"), ("раураl", "paypal"), ("Halo", "Halo"),
        ("a  b", "a  b"), ("\U0001f468‍\U0001f469‍\U0001f467", "\U0001f468‍\U0001f469‍\U0001f467"), ("a‍b", "ab"), ("", ""), (None, None), ("ｶﾞ", "ガ"), ("²", "²"),
    ]
    df = texts(frame, [(i, a) for i, (a, _) in enumerate(cases)])
    got = {r["id"]: r["text"] for r in canonical_text(df, "id", "text").collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
    again = texts(frame, list(got.items()))
    assert {r["id"]: r["text"] for r in canonical_text(again, "id", "text").collect()} == got


def test_lookalike_groups(frame):
    rows = [(3, "halo"), (5, "halо"), (7, "halo"), (8, "ｈalo"), (9, "Halo"), (10, None), (11, ""), (12, "​"), (None, "halo")]
    assert sorted(map(tuple, lookalike_groups(texts(frame, rows), "id", "text").collect())) == [(5, 3), (8, 3), (12, 11)]
    assert lookalike_groups(texts(frame, []), "id", "text").count() == 0


def brute_groups(rows, num, den, least):
    sets = {i: frozenset(WORD.findall(t.lower())) for i, t in rows if i is not None and t is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    size = Counter(map(find, sets))
    return {i: (find(i), size[find(i)]) for i in sets if size[find(i)] > 1}


def edited(rng, vocabulary, n):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = rng.sample(vocabulary, 14) + rng.sample(vocabulary[:20], 4)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("leaf", [256, 4])
def test_near_duplicates_against_brute_force(frame, monkeypatch, leaf):
    monkeypatch.setattr(nearjoin, "LEAF", leaf)
    rng = random.Random(11)
    rows = edited(rng, [f"w{k}" for k in range(400)], 300)
    rows += [(1000, None), (1001, ""), (1002, "satu dua"), (None, rows[0][1]), (1003, rows[0][1]), (1004, "kata " * 50)]
    got = {r["id"]: (r["first_id"], r["group_size"]) for r in near_duplicate_groups(texts(frame, rows), "id", "text", threshold=(7, 10)).collect()}
    assert got == brute_groups(rows, 7, 10, 10)


@pytest.mark.parametrize("limits", [{"CAP": 20}, {"CAP": 20, "CELL": 25}, {"DENSE": 1, "CELL": 7}, {"CAP": 5, "CELL_WORDS": 100, "HOT": 100, "SAMPLE": 120}], ids=str)
def test_hot_near_duplicates(frame, monkeypatch, limits):
    # A node above CAP: a third of the rows are near-copies of one another, the rest must still be found.
    for name, value in limits.items():
        monkeypatch.setattr(nearjoin, name, value)
    rng = random.Random(2)
    base = [f"h{k}" for k in range(20)]
    rows = [(i, " ".join(base[:18] + [f"x{i}"])) for i in range(150)]
    rows += [(i + 1000, t) for i, t in edited(rng, [f"w{k}" for k in range(300)], 200)]
    got = {r["id"]: (r["first_id"], r["group_size"]) for r in near_duplicate_groups(texts(frame, rows), "id", "text", threshold=(7, 10)).collect()}
    assert got == brute_groups(rows, 7, 10, 10)
    assert near_duplicate_groups(texts(frame, []), "id", "text").count() == 0


def test_blocks_of_a_large_node_cover_it():
    rng = np.random.default_rng(1)
    node = np.repeat(np.array([-5, 3, 9], dtype=np.int64), (7, 250_000, 3))
    import pyarrow as pa

    ids = np.arange(len(node))
    s = rng.integers(-(2**62), 2**62, (2, len(node)))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (node, ids, s[0], s[1], np.zeros(len(node), np.int64))], names=["node", "id", "s1", "s2", "hot"])
    out = [b for b in nearjoin._compare(0)(batch.slice(k, 60_000) for k in range(0, len(node), 60_000))]
    over = np.concatenate([b.column("a").to_numpy()[b.column("b").is_null().to_numpy(zero_copy_only=False)] for b in out])
    assert len(over) == 250_000 and len(np.unique(over)) == 250_000


def test_nested_duplicates(frame):
    ddl = "id bigint, who struct<name:string,age:int,tags:array<string>>, more map<string,array<struct<k:string,v:double>>>, c string"
    rows = [
        (1, ("Budi S.", 30, ["a", "B!"]), {"x": [("k", 1.5)], "y": []}, "z"), (2, ("budi s", 30, ["b", " A"]), {"y": [], "X": [("K ", 1.5)]}, "other"), (3, ("budi s", 31, ["b", "a"]), {"y": [], "x": [("k", 1.5)]}, "z"),
        (4, ("budi s", 30, ["b", "a", "a"]), {"y": [], "x": [("k", 1.5)]}, "z"), (5, None, None, "z"), (6, None, None, "z"), (7, (None, None, None), None, "z"), (8, (None, None, []), None, "z"), (9, (None, None, None), None, "q"),
        (None, ("Budi S.", 30, ["a", "B!"]), None, "z"), (10, ("abc", None, None), None, None), (11, ("ab", None, ["c"]), None, None), (12, ("a b-c", None, None), None, None), (13, None, {"x": None}, None), (14, None, {}, None), (15, ("n", None, [None]), None, None), (16, ("n", None, ["n"]), None, None),
    ]
    df = frame(rows, ddl)
    got = {r["id"]: (r["first_id"], r["copies"]) for r in nested_duplicates(df, "id", ["who", "more"]).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 7: (7, 2), 9: (7, 2), 10: (10, 2), 12: (10, 2), 13: (13, 2), 14: (13, 2)}
    assert 2 not in {r["id"] for r in nested_duplicates(df, "id", ["who", "more"], ordered=True).collect()}
    assert nested_duplicates(df.limit(0), "id", ["who"]).count() == 0


def test_recall_at_the_threshold(frame):
    """10,000 pairs that share exactly 0.7 of their words, among themselves: at least 0.999 of them, less three deviations, are found."""
    rng = random.Random(21)
    vocabulary = [f"kata{k}" for k in range(30_000)]
    rows = []
    for i in range(10_000):
        words = rng.sample(vocabulary, 20)
        shared, one, two = words[:14], words[14:17], words[17:]
        rows += [(2 * i, " ".join(shared + one)), (2 * i + 1, " ".join(two + shared))]
    got = {r["id"]: r["first_id"] for r in near_duplicate_groups(texts(frame, rows), "id", "text", threshold=(7, 10)).collect()}
    found = sum(got.get(2 * i + 1) == 2 * i for i in range(10_000))
    assert found >= 10_000 * 0.999 - 3 * math.sqrt(10_000 * 0.001) and set(got.values()) <= set(range(0, 20_000, 2))
    print(found)


def test_a_mass_of_near_copies_gives_a_link_a_row():
    import pyarrow as pa

    n, words = 8_000, 19
    flat = np.concatenate([np.r_[np.arange(1, words, dtype=np.int64), 10_000 + i] for i in range(n)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words), pa.int32()), pa.array(flat))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, 5)), pa.array(np.arange(n)), lists], names=["cell", "id", "words"])
    links = [b for b in nearjoin._spanning(7, 10, 40)(batch.slice(k, 1000) for k in range(0, n, 1000))]
    assert sum(b.num_rows for b in links) == n - 1
    # And a node of near-copies sends out its rows once instead of its pairs.
    node = [pa.array(x) for x in (np.full(n, 5), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))]
    out = [b for b in nearjoin._compare(34)([pa.RecordBatch.from_arrays(node, names=["node", "id", "s1", "s2", "hot"])])]
    assert sum(b.num_rows for b in out) == n
