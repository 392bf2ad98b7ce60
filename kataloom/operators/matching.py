"""Keyword matching: comments' n-grams against the active keywords, and whole-word matches against texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataloom.config import Config
from kataloom.functions import text as T
from kataloom.functions.tokens import all_ngrams

#: A dictionary of more terms than this is joined by a shuffle instead of being sent to all executors.
SMALL = 50_000


def keyword_forms(keywords: DataFrame, config: Config | None = None, unicode: bool = True) -> DataFrame:
    """(keyword_id, form): active keywords without '#', normalised and tokenised, no slang and no stopwords."""
    cleaning = (config or Config()).section("cleaning")
    active = keywords.where("status = 'ACTIVE' and term is not null").select(F.col("id").alias("keyword_id"), F.regexp_replace("term", "^#+", "").alias("_t"))
    active = active.withColumn("_t", T.normalized(F.col("_t"), cleaning, unicode))
    return active.select("keyword_id", F.array_join(T.raw_tokens(F.col("_t")), " ").alias("form")).where("form <> ''")


def find_terms(rows: DataFrame, key: str, tokens: Column, terms: DataFrame, term_col: str = "form") -> DataFrame:
    """(key, term): the distinct terms that a row's tokens hold as a run of whole tokens.

    The n-grams of a row are made unique inside the row, then probe the terms. The term list is broadcast only
    after a check of its size.
    """
    seen = terms.agg(F.max(F.size(F.split(term_col, " "))).alias("w"), F.count("*").alias("n")).first()
    longest, number = seen["w"] or 1, seen["n"]
    grams = rows.select(key, F.explode(F.array_distinct(all_ngrams(tokens, range(1, longest + 1)))).alias(term_col))
    wanted = terms.select(term_col).distinct()
    return grams.join(F.broadcast(wanted) if number <= SMALL else wanted, term_col).select(key, term_col)


def match_keywords(comments: DataFrame, keywords: DataFrame, config: Config | None = None, unicode: bool = True) -> DataFrame:
    """(comment_id, keyword_id): which comments hold which active keywords; the whole relation, rebuilt."""
    cleaning = (config or Config()).section("cleaning")
    forms = keyword_forms(keywords, config, unicode)
    rows = comments.where("text_raw is not null").select(F.col("id").alias("comment_id"), T.normalized(F.col("text_raw"), cleaning, unicode).alias("_t"))
    rows = rows.select("comment_id", T.raw_tokens(F.col("_t")).alias("_tokens"))
    found = find_terms(rows, "comment_id", F.col("_tokens"), forms)
    return found.join(forms, "form").select("comment_id", "keyword_id").distinct()


def match_stats(comments: DataFrame, forms: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: keywords, comments_scanned (0 without keywords), comments_matched, links."""
    n = forms.count()
    scanned = comments.count() if n else 0
    out = matches.agg(F.countDistinct("comment_id").alias("comments_matched"), F.count("*").alias("links"))
    return out.select(F.lit(n).cast("bigint").alias("keywords"), F.lit(scanned).cast("bigint").alias("comments_scanned"), "comments_matched", "links")


def most_matched(matches: DataFrame, keywords: DataFrame, top: int = 20) -> DataFrame:
    """(term, n): the keywords that match most comments."""
    counts = matches.groupBy("keyword_id").agg(F.count("*").alias("n"))
    return counts.join(keywords.select(F.col("id").alias("keyword_id"), "term"), "keyword_id").select("term", "n").orderBy(F.desc("n"), "term").limit(top)


def whole_word_matches(texts: DataFrame, key: str, text_col: str, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(key, term) for terms that stand in the text with no letter, digit or underscore next to them.

    Terms are found by an equi-join on runs of words, or of signs for terms without a word: a text can only hold the term
    where these stand, so only rows that share them are tested on the text itself.
    """
    word = r"[\p{L}\p{N}_]+"
    wanted = terms.select(F.col(term_col).alias("term")).where("term is not null and term <> ''").distinct()
    words = F.regexp_extract_all(F.col("term"), F.lit(word), F.lit(0))
    bare = F.regexp_replace("term", "^#+", "")
    wanted = wanted.select("term", bare.alias("_b"), F.array_join(words, " ").alias("_w")).where("_b <> ''")
    rows = texts.select(key, F.col(text_col).alias("_x"), F.regexp_extract_all(text_col, F.lit(word), F.lit(0)).alias("_tokens"))
    near = find_terms(rows, key, F.col("_tokens"), wanted.where("_w <> ''"), "_w").join(wanted, "_w")
    tested = near.join(rows.select(key, "_x"), key).select(key, "_x", "term", "_b")
    # Terms without a word (pictures, signs) are found the same way, by runs of single signs.
    sign = r"[^\p{L}\p{N}_\s]"
    signs = wanted.where("_w = ''").select("term", "_b", F.array_join(F.regexp_extract_all("_b", F.lit(sign), F.lit(0)), " ").alias("_s"))
    signs = signs.where("_s <> ''")
    if not signs.isEmpty():
        marked = rows.where(F.rlike("_x", F.lit(sign)))
        held = find_terms(marked, key, F.regexp_extract_all("_x", F.lit(sign), F.lit(0)), signs, "_s").join(signs, "_s")
        tested = tested.unionByName(held.join(rows.select(key, "_x"), key).select(key, "_x", "term", "_b"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("_b"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return tested.where(F.rlike("_x", pattern)).select(key, "term").distinct()


def document_frequency(texts: DataFrame, key: str, text_col: str, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, doc_freq) of every term, 0 included, by whole-word matches."""
    found = whole_word_matches(texts, key, text_col, terms, term_col).groupBy("term").agg(F.count("*").alias("n"))
    wanted = terms.select(F.col(term_col).alias("term")).where("term is not null").distinct()
    return wanted.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("doc_freq"))


def example_comments(cleaned: DataFrame, comments: DataFrame, terms: DataFrame, limit: int = 2) -> DataFrame:
    """(term, comment_id, example): for each term the shortest usable comments that hold it between blanks."""
    from kataloom.operators.analysis import top_per_group

    usable = cleaned.where("not is_duplicate and not is_spam").select("comment_id", "text_clean", F.split("text_clean", " ").alias("_words"))
    wanted = terms.select("term").where("term <> ''").distinct()
    found = find_terms(usable, "comment_id", F.col("_words"), wanted, "term")
    texts = comments.select(F.col("id").alias("comment_id"), "text_raw")
    rows = found.join(texts, "comment_id").withColumn("_n", F.length("text_raw"))
    best = top_per_group(rows, limit, [F.col("_n"), F.col("comment_id")], ["term"])
    return best.select("term", "comment_id", F.substring(T.collapse_space(F.col("text_raw")), 1, 160).alias("example"))
