import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kataloom.config import Config, merged, read_env_file
from kataloom.functions import text as T
from kataloom.functions import tokens as K
from kataloom.functions.words import slang_map, stopwords


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.strip_controls, "a\x00b\tc​", "ab\tc"),
        (T.replace_urls, "x https://a.b/c?d www.e.f HTTP://g", "x   "),
        (T.replace_mentions, "hi @a.b-c_ d", "hi  d"),
        (T.hashtags, "#satu dua#tiga", "satu duatiga"),
        (T.collapse_runs, "aaaa bb ccc\n\n\n\n", "aa bb cc\n\n"),
        (T.collapse_space, " a  　b\t ", "a b"),
        (T.normal_term, " A\tB  c ", "ab c"),
    ],
)
def test_step(spark, f, given, want):
    assert apply(spark, f, [given, None]) == [want, None]


def test_chain_and_its_fixed_point(spark):
    chain = lambda c: T.normalized(c, Config().section("cleaning"))
    texts = ["Ｈａｌｏ @x #Gabut  BANGEEETTT https://a.b", "", "a@b.com", "ﬁn ½"]
    once = apply(spark, chain, texts)
    assert once == ["halo gabut bangeett", "", "a", "fin 1⁄2"]
    assert apply(spark, chain, once) == once


def test_counts(spark):
    raw = ["www.a.b @x @y #z", "hub 0812-3456-7890 yaaaaa", ""]
    assert apply(spark, T.count_urls, raw) == [1, 0, 0]
    assert apply(spark, T.count_mentions, raw) == [2, 0, 0]
    assert apply(spark, T.has_phone, raw) == [False, True, False]
    assert apply(spark, T.longest_run, raw) == [3, 5, 0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab-'1_ é.", max_size=20), min_size=1, max_size=20))
def test_tokens_as_the_plain_pattern(spark, texts):
    assert apply(spark, T.raw_tokens, texts) == [re.findall(r"\w+(?:[-']\w+)*", t) for t in texts]


def test_token_functions(spark):
    words = [["gpp", "kata-kata", "12", "x", "yang"], [], None]
    kind = "array<string>"
    assert apply(spark, lambda c: K.apply_slang(c, slang_map()), words, kind)[0] == ["tidak", "apa-apa", "kata-kata", "12", "x", "yang"]
    assert apply(spark, lambda c: K.filter_tokens(c, stopwords()), words, kind) == [["gpp", "kata-kata"], [], None]
    abc = [["a", "b", "c"], ["a"], []]
    assert apply(spark, lambda c: K.ngrams(c, 2), abc, kind) == [["a b", "b c"], [], []]
    assert apply(spark, lambda c: K.shingles(c, 2), abc, kind) == [["a b", "b c"], ["a"], []]
    assert apply(spark, K.diversity, [["a", "a"], []], kind) == [0.5, None]
    assert apply(spark, lambda c: K.stemmed(c, str.upper), [["a"], None], kind) == [["A"], None]


def test_counted_items(spark, frame):
    rows = frame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["b"])], "id int, t array<string>")
    assert sorted(map(tuple, K.counted_items(rows, "id", F.col("t")).collect())) == [(1, "a", 1), (1, "b", 2), (4, "b", 1)]
    assert sorted(map(tuple, K.ngram_frequencies(rows, "t", [1]).collect())) == [("a", 1, 1), ("b", 3, 2)]


def test_terms(spark, frame):
    rows = frame([("kopi", "KEYWORD"), ("kopi susu", "KEYWORD"), ("kopi", "PHRASE"), ("gabut", "HASHTAG"), ("#", "HASHTAG"), ("", "KEYWORD"), ("#a", "KEYWORD"), ("x" * 121, "KEYWORD")], "t string, k string")
    term, reason = T.valid_term(F.col("t"), F.col("k"))
    got = [tuple(r) for r in rows.select(term, reason).collect()]
    assert [r for _, r in got] == [None, "space_in_keyword", "phrase_of_one_word", None, "bare_hashtag", "empty", "hash_in_keyword", "too_long"]
    assert got[3][0] == "#gabut"


def test_config(tmp_path):
    base = {"a": {"b": 1, "c": 2}}
    assert merged(base, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and base["a"]["b"] == 1
    assert Config.load(None, {"spam.max_urls": 9}).get("spam.max_urls") == 9 and Config().get("spam.max_urls") == 2
    (tmp_path / "e").write_text('# c\nA="x"\n\nB=y\n')
    assert read_env_file(str(tmp_path / "e")) == {"A": "x", "B": "y"}


def test_word_files(tmp_path):
    (tmp_path / "s.csv").write_text("slang,normal\n# c\nA, b c\na,d\nx\n")
    (tmp_path / "w.txt").write_text("# c\nyang\nDi # note\n")
    assert slang_map(str(tmp_path / "s.csv")) == {"a": "d"} and stopwords(str(tmp_path / "w.txt")) == ["di", "yang"]
    assert unicodedata.is_normalized("NFC", "".join(slang_map()))
