"""Queries over small tables with gaps, against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kataloom.operators import dedup
from kataloom.operators.store import Store
from kataloom.plans.queries import queries
from kataloom.streaming.incremental import clean_batch

CLEANED = "id bigint, text_clean string, tokens array<string>, norm_hash string, simhash string"
TEXT = "cerita kopi hangat dari desa kecil di lereng gunung tinggi sekali"


def _sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


@pytest.fixture
def folder(tmp_path):
    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def test_near_duplicates_with_missing_hashes(spark, frame, folder):
    tokens = TEXT.split()
    v = int(frame([(tokens,)], "t array<string>").select(dedup.simhash_hex(dedup.simhash(F.col("t")))).first()[0], 16)
    near, far = f"{v ^ 5:016x}", f"{v ^ ((1 << 64) - 1):016x}"
    rows = [
        (1, "satu", ["satu"], _sha("satu"), None),  # the first of its text has no fingerprint
        (2, "satu", ["satu"], _sha("satu").upper(), None),
        (3, TEXT, tokens, None, f"{v:016x}"),  # an original without a hash
        (4, TEXT + " a", tokens, _sha("4"), near),
        (5, TEXT + " b", None, _sha("5"), near),  # a fingerprint, but neither tokens
        (6, TEXT + " c", tokens + [""], _sha("6"), None),  # tokens, but no fingerprint
        (7, TEXT, tokens, _sha(TEXT), f"{v:016x}"),
        (8, "lain", None, None, far),
        (9, "", [], None, None),
        (10, "", None, _sha(""), None),
    ]
    got = queries()["near_duplicates"](spark, folder(cleaned_comments=frame(rows, CLEANED))).collect()
    assert {r["id"]: (r["duplicate_of"], r["duplicate_kind"]) for r in got} == {
        2: (1, "exact"), 4: (3, "near"), 5: (3, "near"), 6: (3, "near"), 7: (3, "exact"), 10: (9, "exact"),
    }


COMMENTS = "id bigint, source_id string, text_raw string"
FULL = "id bigint, comment_id bigint, text_clean string, is_duplicate boolean, is_spam boolean, norm_hash string, simhash string"


def test_incremental_copypasta_counts_stored_rows(frame, folder):
    text, other = "komentar panjang sama persis semuanya", "komentar lain yang berbeda sekali"
    comments = [(i, f"c{i}", text) for i in range(1, 6)] + [(6, "c1", other), (7, "c2", other), (8, "c2", other), (9, "c3", other), (10, "c4", other)]
    stored = [(i, i, text, i > 1, False, _sha(text).upper() if i % 2 else _sha(text), None) for i in range(1, 5)] + [(i, i, other, i > 6, False, _sha(other), None) for i in range(6, 10)]
    path = folder(comments=frame(comments, COMMENTS), cleaned_comments=frame(stored, FULL))
    got = {r["comment_id"]: (r["duplicate_of"], r["is_spam"]) for r in queries()["incremental_clean"](frame([], COMMENTS).sparkSession, path).collect()}
    assert got == {5: (1, True), 10: (6, False)}


def test_batches_mark_stored_copies(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.initialize()
    texts = ["komentar panjang sama persis semuanya"] * 5 + ["komentar lain yang berbeda sekali"]
    rows = store.rows("comments", [{"id": i, "source": "f", "source_id": str(i), "text_raw": t} for i, t in enumerate(texts, 1)])
    store.append("comments", rows)
    for at, want in (("id < 5 or id = 6", set()), ("id = 5", {1, 2, 3, 4, 5}), ("id = 5", {1, 2, 3, 4, 5})):
        clean_batch(store, rows.where(at))
        got = store.read("cleaned_comments").select("comment_id", "is_spam", "spam_reason").collect()
        assert {r[0] for r in got if r[1]} == want and all(r[2] == "copypasta (5 >= 5)" for r in got if r[1])
    assert len(got) == 6


def test_near_pairs_with_members_give_every_link(spark, frame, folder):
    values = [7, 7, 7 ^ 1, 7 ^ 1, 7 ^ 0b1110, 1 << 40, 7, (1 << 63) | 7, 0, 0, None]
    rows = [(i, f"teks {i}", [f"t{i}"], _sha(str(i)), None if v is None else f"{v:016x}") for i, v in enumerate(values, 1)]
    path = folder(cleaned_comments=frame(rows, CLEANED))
    first = {r["id"]: r["representative"] for r in queries()["near_pair_members"](spark, path).collect()}
    bits = {(r["a"], r["b"]): r["bits"] for r in queries()["near_pairs"](spark, path).collect()}
    got = {(a, b): bits.get(tuple(sorted((first[a], first[b]))), 0 if first[a] == first[b] else None) for a in first for b in first if a < b}
    want = {(a, b): bin(v ^ w).count("1") for a, v in enumerate(values, 1) for b, w in enumerate(values, 1) if a < b and v and w}
    assert {k: n for k, n in got.items() if n is not None} == {k: n for k, n in want.items() if n <= 3}
