import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kataloom.llm import pii, tokens
from kataloom.llm.mixing import mix_sources, mixture_shares, poisson_below, with_texts
from kataloom.llm.packing import SumOfSquares, container_contents, fill_containers, filling
from kataloom.llm.pii import NameModel, find, redact, redact_personal_information
from kataloom.llm.splitting import split_oversized, split_text
from kataloom.llm.tokens import RUNS, TOKENIZER, sizer, slices, token_ids

PARTS = ["Wiraka", "Wirana", "Wirato", "Damaka", "Damana", "Damato", "Kamaka", "Kamana", "Kamato", "Sulaka", "Sulana", "Sulato", "Melati", "Fajar"]
MODEL = NameModel(PARTS)


def kinds(text):
    return sorted({k for _, _, k, _ in find(text, MODEL)})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("kirim ke budi_01@mail.example.id ya", ["email"]), ("kirim ke budi (at) mail [dot] example", ["email"]), ("budi@ma​il.example", ["email"]), ("cek @budi.id ya", []),
        ("wa 0812-3456-7890", ["phone"]), ("+62 812 3456 7890", ["phone"]), ("O8l2345678O9", ["phone"]), ("(021) 822-5971", ["phone"]), ("nol delapan satu dua tiga empat lima enam tujuh delapan", ["phone"]),
        ("０８１２３４５６７８９０", ["phone"]), ("harganya Rp 7.940.422", []), ("versi 10.0.8.7 error 0x58907117", []), ("resi JX1599394854970490 belum", []), ("ditonton 8.843.431 orang", []),
        ("nik 3501225604090010", ["id_number"]), ("3501 2256 0409 0010", ["id_number"]), ("3501 2299 9909 0010", []), ("kartu kredit 3501 2256 0409 0010", ["card"]), ("kartu kredit 3501 2256 0409 0011", []), ("npwp 62.987.598.6-222.055", ["id_number"]),
        ("paspor X 6608277", ["id_number"]), ("Jl. Melati Raya No. 12, Kota", ["address"]), ("jln nalungi 95 rt 07/rw 01", ["address"]), ("Komplek Indah blok F nomor 18", ["address"]),
        ("jalan tol macet parah sampai km 38", []), ("jalan-jalan terus 20 hari", []), ("Nama: Wiraka Damana", ["name"]), ("nama saya wirana kamato", ["name"]), ("titip buat Bu Sulana ya", ["name"]),
        ("Pak guru sama Bu dosen", []), ("melati di taman, fajar tiba", []), ("an. Damaka, Wirato", ["name"]), ("salam dari Wіraka Kamana", ["name"]), ("", []),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_redaction_keeps_the_rest():
    text = "Halo Wіraka! Nama: Damaka Wirana, hub 0812​-3456-7890 ya\U0001f600"
    assert redact(text, find(text, MODEL)) == "Halo Wіraka! Nama: [NAME], hub [PHONE] ya\U0001f600"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_spans_are_ordered_and_inside(text):
    spans = find(text, MODEL)
    assert all(0 <= s < e <= len(text) for s, e, _, _ in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_validators():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    assert pii.citizen_number("3501225604090010") and not pii.citizen_number("3501227204090010")


def test_redact_table(frame, spark):
    rows = frame([(1, "wa 081234567890", "x"), (2, None, "x"), (3, "", "x"), (None, "budi@mail.example", "x"), (5, "kata " * 40_000 + "081234567890", "x")], "id bigint, text string, kinds string")
    names = frame([("Wiraka",), (None,)], "name_part string")
    got = {r["id"]: r for r in redact_personal_information(rows, "id", "text", names).collect()}
    assert got[1]["text_redacted"] == "wa [PHONE]" and got[2]["text_redacted"] is None and got[3]["text_redacted"] == "" and got[None]["kinds"] == ["email"] and got[5]["kinds"] == ["phone"]


def brute_square(sizes, capacity):
    """Sum-of-squares packing by trying every open container."""
    gaps, used = [], 0
    for s in sizes:
        def cost(after):
            n = {}
            for g in after:
                if 0 < g < capacity:
                    n[g] = n.get(g, 0) + 1
            return sum(v * v for v in n.values())
        options = [(cost(gaps[:k] + [g - s] + gaps[k + 1 :]), 0, g, k) for k, g in enumerate(gaps) if g >= s > 0 and g > 0]
        options.append((cost([*gaps, capacity - s]), 1, capacity, None))
        best = min(options, key=lambda o: (o[0], o[1], o[2]))
        if best[3] is None:
            gaps.append(capacity - s)
            used += 1
        else:
            gaps[best[3]] -= s
    return used


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=40))
def test_packing_rule(sizes):
    packer = SumOfSquares(10)
    room = {}
    for s in sizes:
        box, used = packer.place(s)
        assert room.get(box, 0) == used
        room[box] = used + s
        assert room[box] <= 10
    assert packer.opened == brute_square(sizes, 10)


def docs(frame, texts):
    return frame([(i, t, "x", 1, "y") for i, t in enumerate(texts, 1)], "doc_id bigint, text string, shard string, n_tokens int, h string")


def test_containers(frame):
    rng = random.Random(4)
    texts = [" ".join(["kata"] * rng.randrange(0, 60)) for _ in range(300)] + [None, "", "kata " * 500, "ikan"] + ["ikan"] * 3
    placed = fill_containers(docs(frame, texts), "doc_id", "text", 50, tokenizer=RUNS, shard=100).collect()
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts, 1)}
    parts = {}
    for r in placed:
        parts.setdefault(r["doc_id"], []).append(r)
    assert set(parts) == {i for i, n in sizes.items() if n} and all(sum(r["n_tokens"] for r in ps) == sizes[i] for i, ps in parts.items())
    assert all(len(ps) == 1 or sizes[i] > 50 for i, ps in parts.items()) and all(len(ps) == -(-sizes[i] // 50) for i, ps in parts.items())
    boxes = {}
    for r in sorted(placed, key=lambda r: (r["container"], r["position"])):
        assert boxes.get(r["container"], 0) == r["position"]
        boxes[r["container"]] = r["position"] + r["n_tokens"]
    assert max(boxes.values()) <= 50
    row = filling(fill_containers(docs(frame, texts), "doc_id", "text", 50, tokenizer=RUNS, shard=10**6), 50).first()
    assert row["tokens"] == sum(sizes.values()) and row["used_share"] > 0.97
    assert fill_containers(docs(frame, []), "doc_id", "text", 50, tokenizer=RUNS).count() == 0


def test_mixture(frame):
    rng = random.Random(9)
    rows = [(i, " ".join(["kata"] * rng.randrange(1, 90)), s, "k") for i, s in enumerate(["a"] * 900 + [" A "] * 100 + ["b"] * 200 + ["c"] * 50 + ["none"] * 20)]
    rows += [(None, "kata", "a", "k"), (5000, None, "a", "k"), (5001, "kata", None, "k"), (5002, "", "b", "k")]
    d = frame(rows, "doc_id bigint, text string, source string, key string")
    targets = frame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(d, "doc_id", "text", "source", targets, tokenizer=RUNS)
    shares = {r["source"]: r for r in mixture_shares(mixed, targets).collect()}
    assert shares["gone"]["tokens"] == 0 and sum(r["share"] for r in shares.values()) == pytest.approx(1)
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert shares[s]["share"] == pytest.approx(want, abs=0.01)
    used = mixed.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count")).collect()
    assert {r[0]: r[1] for r in used} == {"a": 1, "b": used_max(used, "b"), "c": 3} and used_max(used, "b") <= 2
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mix_sources(d.repartition(7), "doc_id", "text", "source", targets, tokenizer=RUNS).collect()))
    assert mix_sources(d.limit(0), "doc_id", "text", "source", targets, tokenizer=RUNS).count() == 0
    small = mixture_shares(mix_sources(d, "doc_id", "text", "source", targets, total=3000, tokenizer=RUNS), targets)
    assert small.agg(F.sum("tokens")).first()[0] == pytest.approx(3000, rel=0.1)


def used_max(rows, source):
    return next(r[1] for r in rows if r[0] == source)


def test_poisson():
    import math

    assert poisson_below(1, 2.0) == pytest.approx(3 * math.exp(-2)) and poisson_below(0, 0.0) == 1.0


def check_pieces(text, limit, overlap, tokenizer):
    size, spans = sizer(tokenizer), split_text(text, limit, overlap, tokenizer)
    if size(text) <= limit:
        return [text] if spans else []
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (s, e, n, o), (s2, e2, n2, o2) in zip(spans, spans[1:]):
        assert s < s2 <= e < e2 and o2 <= overlap
    pieces = [text[s:e] for s, e, _, _ in spans]
    assert all(size(p) <= limit for p in pieces)
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["kata", "ikan.", "a-b", "x" * 9, "\n", "\n\n", "apa?", " ", "é"]), max_size=120), st.integers(8, 30), st.integers(0, 5))
def test_pieces_cover(parts, limit, overlap):
    check_pieces(" ".join(parts), limit, overlap, RUNS)


def test_natural_boundaries():
    text = "\n".join(" ".join(["kata"] * 9) + "." for _ in range(12))
    pieces = check_pieces(text, 32, 0, RUNS)
    assert all(p.rstrip("\n").endswith(".") for p in pieces)
    overlapping = split_text(text, 32, 4, RUNS)
    assert all(o == 4 for _, _, _, o in overlapping[1:])


def test_pieces_with_tokenizer():
    rng = random.Random(1)
    text = "".join(rng.choice(["Halo dunia. ", "kata ", "\n- ", "ikan!\n\n", "\U0001f600 ", "hmm  ", "1234 "]) for _ in range(3000))
    assert len(check_pieces(text, 128, 16, TOKENIZER)) > 20


def test_split_table(frame):
    rows = docs(frame, ["satu dua tiga empat lima enam", "pendek", None, "", "   ", "kata " * 30_000])
    out = split_oversized(rows, "doc_id", "text", 4, 1, tokenizer=RUNS).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {1, 2, 6} and len(by[2]) == 1 and all(r["n_tokens"] <= 4 for r in out) and len(by[1]) == by[1][0]["n_pieces"] >= 2
    assert split_oversized(rows.limit(0), "doc_id", "text", 4, 1, tokenizer=RUNS).count() == 0
    long = split_oversized(docs(frame, ["x" * 5000]), "doc_id", "text", 64, 8).collect()
    assert "".join(r["text"] for r in sorted(long, key=lambda r: r["piece"]) if r["overlap_tokens"] == 0 or r["piece"] == 0)[:100] == "x" * 100 and all(r["n_tokens"] <= 64 for r in long)
    with pytest.raises(ValueError):
        split_oversized(rows, "doc_id", "text", 4, 4)


def test_slices_keep_the_size():
    text = "kata ikan " * 30_000
    assert "".join(slices(text)) == text
    assert sizer(TOKENIZER)(text) == len(__import__("kataloom.llm.tokens", fromlist=["x"])._encoding(TOKENIZER).encode_ordinary(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["kata", "baris\n", "\n", "  ", "\t", " ", "'s", "x" * 40, "12", "\r\n", "\u3000", "…", "é", "\U0001f600", "\x85"]), max_size=60), st.integers(1, 20))
def test_sizes_by_slices_are_those_of_the_whole(parts, most):
    text, whole = "".join(parts), tokens._encoding(TOKENIZER).encode_ordinary
    kept, tokens.SLICE = tokens.SLICE, most
    try:
        assert "".join(slices(text)) == text and sizer(TOKENIZER)(text) == len(whole(text)) and token_ids(TOKENIZER)(text) == whole(text)
    finally:
        tokens.SLICE = kept


def test_sizes_of_lines_and_endless_words():
    whole = tokens._encoding(TOKENIZER).encode_ordinary
    for text in ("baris\n" * 30_000, "a b\n\n  c\t" * 20_000, "xyz" * 60_000):
        assert sizer(TOKENIZER)(text) == len(whole(text))


def test_overlap_never_cuts_a_word_that_fits():
    size = sizer(TOKENIZER)
    letters = "xqzjkvbwpfhgmtdlrnscyuoaie" * 3
    word = next(letters[:k] for k in range(20, 70) if size(" " + letters[:k]) == 18)
    text = "satu dua tiga empat lima enam " + word + " tujuh delapan sembilan sepuluh " + word + "."
    for limit in (18, 19, 20, 22):
        spans = split_text(text, limit, 4, TOKENIZER)
        pieces = [text[s:e] for s, e, _, _ in spans]
        assert sum(word in p for p in pieces) >= 2 and all(size(p) <= limit for p in pieces)
        for (_, e, _, _), (s2, _, n2, o2), p in zip(spans, spans[1:], pieces[1:]):
            assert s2 <= e and o2 == size(text[s2:e]) and o2 <= 4 and n2 == size(p)


def test_endless_words_are_cut_with_overlap():
    spans = split_text("halo " + "abcdefgh" * 4000 + " dunia", 64, 8, TOKENIZER)
    assert spans[0][0] == 0 and all(a[1] >= b[0] > a[0] and b[1] > a[1] for a, b in zip(spans, spans[1:])) and all(n <= 64 for _, _, n, _ in spans)
    assert sum(o > 0 for _, _, _, o in spans[1:]) >= len(spans) - 2 and all(o <= 8 for _, _, _, o in spans)


@pytest.mark.parametrize("tokenizer", [RUNS, TOKENIZER])
def test_container_contents_round_trip(frame, tokenizer):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["kata", "ikan!", "\U0001f600", "é"]) for _ in range(rng.choice((1, 5, 30, 130))))) for i in range(60)]
    texts += [(3, "kata " * 130), (3, "ikan " * 130), (3, "kata " * 130), (None, "satu dua"), (None, "tiga empat lima " * 40), (70, None), (71, ""), (72, "  ")]
    rows = frame([(i, t, "x", 1, "y") for i, t in texts], "doc_id bigint, text string, container string, size int, nth string")
    placed = fill_containers(rows, "doc_id", "text", 50, tokenizer=tokenizer, shard=20)
    boxes = container_contents(placed, rows, "doc_id", "text", tokenizer=tokenizer).collect()
    assert {b["container"] for b in boxes} == {r["container"] for r in placed.collect()}
    split = (lambda t: tokens.RUN.findall(t)) if tokenizer == RUNS else token_ids(tokenizer)
    want, got = {}, {}
    for i, t in texts:
        want.setdefault(i, []).extend(split(t or ""))
    for b in boxes:
        assert len(b["contents"]) == b["n_tokens"] <= 50 and len(b["starts"]) == len(b["doc_ids"])
        for s, e, i in zip(b["starts"], [*b["starts"][1:], b["n_tokens"]], b["doc_ids"]):
            got.setdefault(i, []).extend(b["contents"][s:e])
    assert {i: sorted(x) for i, x in want.items() if x} == {i: sorted(x) for i, x in got.items()}
    assert container_contents(placed.limit(0), rows, "doc_id", "text", tokenizer=tokenizer).count() == 0


def test_mixture_goals_and_texts(frame):
    d = frame([(i, f"kata {i}", "a" if i % 3 else "b") for i in range(300)], "doc_id bigint, text string, source string")
    targets = frame([("a", 0.5, 1), ("b", 0.3, 2), ("gone", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(d, "doc_id", "text", "source", targets, tokenizer=RUNS)
    goals = {r["source"]: (r["goal_share"], r["share"]) for r in mixture_shares(mixed, targets).collect()}
    assert goals["gone"] == (0.0, 0.0) and goals["a"] == pytest.approx((0.625, 0.625), abs=0.02) and goals["b"] == pytest.approx((0.375, 0.375), abs=0.02)
    full = with_texts(mixed, d, "doc_id", "text")
    assert full.count() == mixed.count() and full.where("text <> concat('kata ', doc_id)").count() == 0
