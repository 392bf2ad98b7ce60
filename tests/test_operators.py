import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from kataloom.config import Config
from kataloom.functions import tokens
from kataloom.operators import analysis, browse, cleaning, components, dedup, discovery, keywords, lexicon, matching, review, spam
from kataloom.operators.components import connected_components

CFG = Config({"cleaning": {"normalize_slang": False}})
COMMENTS = "id bigint, source string, source_id string, text_raw string, url string"


def comments(frame, texts):
    return frame([(i, "file", f"c{i}", t, None) for i, t in enumerate(texts, 1)], COMMENTS)


def docs(frame, texts):
    return frame([(i, t.split()) for i, t in enumerate(texts, 1)], "comment_id bigint, tokens array<string>")


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components_against_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    more = spark.createDataFrame([(105, 7), (500, 501), (501, 3)], "a bigint, b bigint")
    for a, b in ((105, 7), (500, 501), (501, 3)):
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    roots = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in components.merged_components(roots, more).collect()} == {x: find(x) for x in parent}


def test_frequency(frame):
    rows = analysis.term_frequency(docs(frame, ["a b a", "a c"])).collect()
    assert (rows[0]["term"], rows[0]["count"], rows[0]["doc_freq"], rows[0]["relative"]) == ("a", 3, 2, 0.6)


def test_ngrams(frame):
    assert [tuple(r) for r in analysis.count_ngrams(docs(frame, ["x y z", "x y", "x y q"]), [2, 3], 2).collect()] == [("x y", 2, 3, 3)]


def test_tfidf(frame):
    got = {r["term"]: r["score"] for r in analysis.tfidf(docs(frame, ["x y", "x"])).collect()}
    h = math.hypot(math.log(2), math.log(3))
    assert got["x"] == pytest.approx(math.log(2) / h + 1) and got["y"] == pytest.approx(math.log(3) / h)


@pytest.mark.parametrize("sizes", [(1,), (1, 2, 3)])
def test_tfidf_by_tables_and_by_join(frame, monkeypatch, sizes):
    rng = random.Random(3)
    d = docs(frame, [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice((0, 1, 2, 9)))) for _ in range(60)])
    one = {r["term"]: r for r in analysis.tfidf(d, sizes).collect()}
    monkeypatch.setattr(analysis, "TERMS", 0)
    two = {r["term"]: r for r in analysis.tfidf(d, sizes).collect()}
    assert set(one) == set(two) and len(one) > 20
    for t, r in one.items():
        assert r["doc_freq"] == two[t]["doc_freq"] and r["score"] == pytest.approx(two[t]["score"]) and r["max_weight"] == pytest.approx(two[t]["max_weight"])


def test_ngram_frequencies_by_small_blocks(frame, monkeypatch):
    rng = random.Random(5)
    rows = [[f"w{rng.randrange(6)}" for _ in range(rng.choice((0, 1, 2, 3, 40)))] for _ in range(50)] + [None, ["a", None, "b"], []]
    df = frame([(i, r) for i, r in enumerate(rows)], "comment_id bigint, tokens array<string>")
    lists = [[t for t in r or [] if t is not None] for r in rows]
    grams = [[" ".join(r[i : i + k]) for k in (1, 2, 3) for i in range(len(r) - k + 1)] for r in lists]
    count = {t: (sum(g.count(t) for g in grams), sum(t in g for g in grams)) for t in {t for g in grams for t in g}}
    monkeypatch.setattr(tokens, "FOLD", 7)
    assert {r["term"]: (r["count"], r["doc_freq"]) for r in tokens.ngram_frequencies(df, "tokens", [1, 2, 3]).collect()} == count


def test_cooccurrence(frame):
    d = docs(frame, ["kopi pagi hujan"] * 3 + ["hujan deras", "kopi susu"])
    got = {(r["left"], r["right"]): r for r in analysis.cooccurrence(d, window=2).collect()}
    assert {k: v["count"] for k, v in got.items()} == {("kopi", "pagi"): 3, ("hujan", "pagi"): 3} and got["kopi", "pagi"]["pmi"] > 0
    with pytest.raises(ValueError):
        analysis.cooccurrence(d, metric="x")


def test_npmi_bounds(frame):
    rng = random.Random(7)
    d = docs(frame, [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(3, 15))) for _ in range(200)])
    assert all(-1 - 1e-9 <= r["npmi"] <= 1 + 1e-9 for r in analysis.cooccurrence(d, min_pair_frequency=1).collect())


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("hubungi saya di 081234567890 ya kawan", "phone_number"),
        ("lihat https://a.b https://c.d https://e.f bagus sekali", "too_many_urls"),
        ("@a @b @c @d @e @f nonton bareng yuk", "too_many_mentions"),
        ("#a #b #c #d #e #f seru banget", "too_many_hashtags"),
        ("mantaaaaaaaaaaaap banget videonya", "char_run"),
        ("mantap " * 8, "low_diversity"),
        ("ok", "too_few_tokens"),
    ],
)
def test_spam_rules(frame, text, code):
    row = cleaning.clean(comments(frame, [text]), CFG).first()
    assert row["is_spam"] and code in row["spam_reason"]


def test_reason_text(frame):
    row = cleaning.clean(comments(frame, ["https://a.b https://c.d https://e.f 081234567890"]), CFG).first()
    assert row["spam_reason"].startswith("phone_number; too_many_urls (3 > 2); too_few_tokens (")
    codes = frame([(row["spam_reason"],)], "r string").select(spam.reason_codes(F.col("r"))).first()[0]
    assert codes[:3] == ["phone_number", "too_many_urls", "too_few_tokens"]


def test_copypasta_marks_all(frame):
    rows = cleaning.clean(comments(frame, ["komentar ini sama persis semuanya"] * 5 + ["komentar lain sama sekali berbeda"]), CFG).orderBy("comment_id").collect()
    assert [r["is_spam"] for r in rows] == [True] * 5 + [False] and "copypasta (5 >= 5)" in rows[0]["spam_reason"]


def _simhash(tokens):
    parts = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    votes = [0] * 64
    for p in parts:
        h = int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def test_simhash(frame):
    lists = [["a", "b", "c", "d"], ["a"], [], None, "videonya lucu banget ketawa".split()]
    got = [r[0] for r in frame([(x,) for x in lists], "t array<string>").select(dedup.simhash_hex(dedup.simhash(F.col("t")))).collect()]
    assert got == [f"{_simhash(x):016x}" if x is not None else None for x in lists] and got[-1] == "0242006a10a08002"


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_against_the_loop(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(1, 121):
        v = rng.choice(centres)
        for _ in range(rng.randrange(4)):
            v ^= 1 << rng.randrange(64)
        rows.append((i, f"h{rng.randrange(100)}", v, rng.random() < 0.95))
    seen, index, want = {}, [], {}
    for i, h, v, has in rows:
        if h in seen:
            want[i] = seen[h]
            continue
        seen[h] = i
        if not has or v == 0:
            continue
        hits = [(min(b for b in range(4) if (v >> 16 * b) & 65535 == (w >> 16 * b) & 65535), j) for j, w in index if bin(v ^ w).count("1") <= 3]
        if hits:
            want[i] = min(hits)[1]
        else:
            index.append((i, v))
    signed = [(i, h, v - (1 << 64) if v >> 63 else v, has) for i, h, v, has in rows]
    got = dedup.mark_duplicates(spark.createDataFrame(signed, "id bigint, norm_hash string, v bigint, has_tokens boolean"))
    assert {r["id"]: r["duplicate_of"] for r in got.where("is_duplicate").collect()} == want


def test_near_pairs_with_hot_keys(spark, monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = {base & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(150)} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(values))]
    want = {(i, j) for i, v in enumerate(sorted(values)) for j, w in enumerate(sorted(values)) if i < j and bin(v ^ w).count("1") <= 3}
    for limit in (4096, 3):
        monkeypatch.setattr(dedup, "HOT_BUCKET", limit)
        got = dedup.near_pairs(spark.createDataFrame(rows, "id bigint, v bigint"))
        assert {(r["a"], r["b"]) for r in got.collect()} == want


@pytest.mark.parametrize("local", [dedup.LOCAL, 8])
def test_long_chains_are_resolved(spark, monkeypatch, local):
    monkeypatch.setattr(dedup, "LOCAL", local)
    n = 1000 if local > 8 else 12
    edges = [(i, i + 1) for i in range(n)] + [(5000, 5002), (5001, 5002), (5002, 5003)]
    got = {r["id"]: r["original"] for r in dedup.first_independent_set(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: i % 2 == 0 for i in range(n + 1)} | {5000: True, 5001: True, 5002: False, 5003: True}


def test_block_tables_are_complete():
    for n in (10, 10**7, 10**10):
        for _ in range(300):
            a = random.getrandbits(64)
            b = a
            for _ in range(3):
                b ^= 1 << random.randrange(64)
            assert any(all((a >> s) & ((1 << w) - 1) == (b >> s) & ((1 << w) - 1) for s, w in t) for t in dedup._tables(n, 64, 3))


def test_incremental_clean(frame):
    texts = ["satu komentar pertama yang panjang", "komentar kedua yang lain lagi", "Satu komentar PERTAMA yang panjang"]
    first = cleaning.clean(comments(frame, texts[:2]), CFG)
    again = cleaning.clean(comments(frame, texts), CFG, first).collect()
    assert [(r["comment_id"], r["duplicate_of"]) for r in again] == [(3, 1)]
    assert cleaning.clean(comments(frame, texts), CFG).where("is_duplicate").select("comment_id", "duplicate_of").first() == (3, 1)


def test_null_and_empty_comments(frame):
    rows = {r["comment_id"]: r for r in cleaning.clean(comments(frame, [None, "", "\U0001f600" * 30]), CFG).collect()}
    assert rows[1]["text_clean"] == "" and rows[2]["duplicate_of"] == 1 and all(r["is_spam"] for r in rows.values())
    assert cleaning.clean(comments(frame, []), CFG).count() == 0


KEYWORDS = "id bigint, term string, type string, status string, iteration int, discovered_from string, created_at string, updated_at string"


def kw(frame, *terms):
    return frame([(i, t, k, s, 0, None, "t", "t") for i, (t, k, s) in enumerate(terms, 1)], KEYWORDS)


def test_discovery_scenario(frame):
    words = "satu dua tiga empat lima enam".split()
    texts = [f"zorbak plenger {w} tempo" for w in words] + [f"kliwon rumah {w} sepi" for w in words[:5]] + [f"jarang {w} muncul" for w in words[:2]]
    seeds = kw(frame, ("#zorbak", "HASHTAG", "ACTIVE"))
    rows = discovery.discover(docs(frame, texts), seeds, None, CFG, limit=100).collect()
    got = {r["term"]: r for r in rows}
    order = [r["term"] for r in rows]
    assert got["plenger"]["frequency"] == 6 and "near seed '#zorbak'" in got["plenger"]["discovered_from"]
    assert order.index("plenger") < order.index("kliwon") and "jarang" not in got and "zorbak" not in got
    assert got["kliwon rumah"]["type"] == "PHRASE" and got["kliwon rumah"]["discovered_from"].startswith("docs=5")
    assert discovery.discover(docs(frame, []), seeds, None, CFG).count() == 0


def test_matching(frame):
    c = comments(frame, ["ayo rek nonton bareng", "rekam dulu", "#Gabut banget videonya", "MAS  mas GABUT lewat", None])
    k = kw(frame, ("rek", "KEYWORD", "ACTIVE"), ("#gabut", "HASHTAG", "ACTIVE"), ("mas mas gabut", "PHRASE", "ACTIVE"), ("dulu", "KEYWORD", "INACTIVE"))
    m = matching.match_keywords(c, k, CFG)
    assert sorted(map(tuple, m.collect())) == [(1, 1), (3, 2), (4, 2), (4, 3)]
    assert [tuple(r) for r in matching.most_matched(m, k).collect()] == [("#gabut", 2), ("mas mas gabut", 1), ("rek", 1)]
    assert matching.match_stats(c, matching.keyword_forms(k, CFG), m).first().asDict() == {"keywords": 3, "comments_scanned": 5, "comments_matched": 3, "links": 4}


def test_whole_words(frame):
    x = frame([(1, "kata-kata mutiara"), (2, "katanya"), (3, "kata 👍 mutiara")], "id bigint, t string")
    terms = frame([("kata",), ("kata mutiara",), ("kata-kata",), ("👍",), ("tak ada",)], "term string")
    assert {r["term"]: r["doc_freq"] for r in matching.document_frequency(x, "id", "t", terms).collect()} == {"kata": 2, "kata mutiara": 1, "kata-kata": 1, "👍": 1, "tak ada": 0}


def test_keyword_table(frame):
    k = kw(frame, ("kopi", "KEYWORD", "INACTIVE"))
    new = frame([("Kopi", None, 0), ("kopi susu", None, 1), ("#x y", None, 2), ("KOPI SUSU", "PHRASE", 3)], "term string, type string, place bigint")
    out = keywords.add_keywords(k, new, now="n")
    assert [(r["id"], r["term"], r["status"]) for r in out.orderBy("id").collect()] == [(1, "kopi", "INACTIVE"), (2, "kopi susu", "ACTIVE")]
    assert keywords.rename(out, 2, "Teh Susu", "m").where("id = 2").first()["term"] == "teh susu"
    with pytest.raises(ValueError):
        keywords.rename(out, 2, "teh", "m")
    assert keywords.remove(out, [2], "m").where("status = 'ACTIVE'").count() == 0 and keywords.remove(out, [2], "m", hard=True).count() == 1
    assert keywords.buckets(keywords.from_buckets(out, {"hashtags": ["abc"], "keywords": ["a b"]}, now="n")) == {"keywords": [], "phrases": ["kopi susu"], "hashtags": ["#abc"]}


CANDIDATES = "id bigint, term string, type string, source_method string, frequency bigint, score double, discovered_from string, iteration int, status string, reviewed_at string, created_at string"


def test_review_and_promotion(frame):
    c = frame([(1, "teh", "KEYWORD", "TFIDF", 5, 0.5, "why", 0, "PENDING", None, "t"), (2, "kopi", "KEYWORD", "NGRAM", 9, 0.9, None, 0, "PENDING", None, "t"), (3, "teh", "KEYWORD", "TFIDF", 5, 0.5, "why", 1, "PENDING", None, "t")], CANDIDATES)
    assert [r["id"] for r in review.queue(c).collect()] == [2, 1, 3]
    assert {r["term"]: r["id"] for r in review.latest_pending(c).collect()} == {"teh": 3, "kopi": 2}
    d = review.decided(c, frame([(1, "REJECTED", "a"), (1, "APPROVED", "b"), (2, "APPROVED", "a")], "id bigint, status string, reviewed_at string"))
    k = kw(frame, ("kopi", "KEYWORD", "ACTIVE"))
    out = review.promote_approved(d, k, iteration=2, now="n").orderBy("id").collect()
    assert [(r["term"], r["iteration"], r["discovered_from"]) for r in out] == [("kopi", 0, None), ("teh", 2, "TFIDF kandidat#1 why")]
    assert review.append_candidates(c, c.drop("id")).count() == 3


def test_lexicon(frame):
    ddl = "source string, entry_key string, url string, term string, category string, definition string, example string, excluded boolean, fetched_at string"
    e = frame([("k", "a", "u/a", "gabut", "Slang", "d", "x", False, "2024-01-01"), ("k", "b", "u/b", "Budi", "nama orang", "d", "x", False, "2024-03-01"), ("k", "c", "u/c", "Kopi", None, None, None, False, "2024-03-01"), ("k", "d", "u/d", "gabut", None, None, None, False, "2024-03-01")], ddl)
    stubs = {r["entry_key"]: r for r in lexicon.excluded_stubs(e, ["Nama Orang"]).collect()}
    gone = stubs["sha1:" + hashlib.sha1(b"b").hexdigest()]
    assert gone["term"] is None and gone["url"] is None and gone["excluded"] and stubs["a"]["term"] == "gabut"
    listed = frame([("k", x, f"u/{x}") for x in "abz"], "source string, entry_key string, url string")
    assert [r["entry_key"] for r in lexicon.stale_keys(listed, lexicon.excluded_stubs(e, ["Nama Orang"]), "2024-02-01").orderBy("entry_key").collect()] == ["a", "z"]
    cleaned = frame([(1, "aku gabut", False, False), (2, "gabutnya", False, False), (3, "gabut", True, False)], "id bigint, text_clean string, is_duplicate boolean, is_spam boolean")
    got = {r["entry_key"]: (r["outcome"], r["frequency"]) for r in lexicon.proposals(e, kw(frame, ("kopi", "KEYWORD", "ACTIVE")), frame([], CANDIDATES), cleaned).collect()}
    assert got["a"] == ("created", 1) and got["c"][0] == "already_keyword" and got["d"][0] == "already_candidate"


def test_browse(frame):
    c = frame([(1, "youtube", "a", "Halo dunia", "https://x/watch?v=ab_c&lc=1"), (2, "file", "b", "lain", None), (3, "file", "c", "halo 100%", "https://x/watch?v=abXc&lc=1")], COMMENTS).withColumn("created_at", F.lit(None).cast("string"))
    cl = frame([(1, 1, True, None, False, None), (2, 1, False, None, False, None), (3, 2, True, 1, True, "x")], "id bigint, comment_id bigint, is_duplicate boolean, duplicate_of bigint, is_spam boolean, spam_reason string")
    assert {r["id"]: r["state"] for r in browse.browse(c, cl).collect()} == {1: "ok", 2: "spam", 3: "raw"}
    assert [r["id"] for r in browse.browse(c, cl, search="HALO").collect()] == [3, 1] and [r["id"] for r in browse.browse(c, cl, search="0%").collect()] == [3]
    assert [r["id"] for r in browse.browse(c, cl, video="ab_c").collect()] == [1] and browse.browse(c, cl, usable=True).count() == 1
    runs = frame([("2024-02-01", '{"search_calls": 4}'), ("2024-02-02", "{broken"), ("2023-01-01", '{"search_calls": 9}')], "started_at string, params string")
    assert browse.search_calls(runs, "2024-01-01").first()[0] == 4
