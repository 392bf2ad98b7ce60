"""The queries over the test tables: name -> (spark, folder) -> DataFrame. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kataloom.config import Config
from kataloom.functions import text as T
from kataloom.functions import tokens as K
from kataloom.functions.words import slang_map, stopwords
from kataloom.operators import analysis, browse, cleaning, dedup, discovery, keywords, lexicon, matching, review, spam
from kataloom.session import spread
from kataloom.sources import api, collect, files, html

CONFIG = Config()
#: Decimal places to which results in floating point are given.
PLACES = 6
SINCE, NOW = "2024-04-01T00:00:00Z", "2026-01-01T00:00:00Z"


#: The tables that grow.
LARGE = ("comments", "cleaned_comments", "documents")


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in LARGE else table


_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def _docs(t: Tables) -> DataFrame:
    return analysis.corpus(t.cleaned_comments, "id")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, PLACES))
    return df


def _candidates(t: Tables) -> DataFrame:
    """Candidate rows for the review queries, made from the lexicon (the tables hold none)."""
    rows = t.lexicon_entries.where("not excluded and term is not null").withColumn("n", F.conv(F.substring(F.md5("entry_key"), 1, 6), 16, 10).cast("bigint"))
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.floor(F.col("n") / 7), F.lit(len(values))) + 1).cast("int"))
    kind = T.term_type(T.normal_term(F.col("term")))
    return rows.select(
        F.col("n").alias("id"), T.normal_term(F.col("term")).alias("term"), kind.alias("type"), pick("LEXICON", "FREQUENCY", "NGRAM").alias("source_method"),
        F.pmod("n", F.lit(50)).alias("frequency"), (F.pmod("n", F.lit(1000)) / 1000.0).alias("score"), F.col("url").alias("discovered_from"),
        F.pmod("n", F.lit(5)).cast("int").alias("iteration"), pick("PENDING", "APPROVED", "REJECTED", "PENDING").alias("status"),
        F.lit(None).cast("string").alias("reviewed_at"), F.lit(NOW).alias("created_at"),
    )


# ------------------------------------------------------------------------------------------------ text


@query
def normalize_text(t: Tables) -> DataFrame:
    return t.comments.where("text_raw is not null").select("id", T.normalized(F.col("text_raw"), CONFIG.section("cleaning")).alias("text_clean"))


@query
def text_stats(t: Tables) -> DataFrame:
    c = F.col("text_raw")
    return t.comments.where("text_raw is not null").select(
        "id", T.count_urls(c).cast("bigint").alias("urls"), T.count_mentions(c).cast("bigint").alias("mentions"), T.count_hashtags(c).cast("bigint").alias("hashtags"),
        T.has_phone(c).alias("has_phone"), T.longest_run(c).cast("bigint").alias("longest_run"),
    )


@query
def tokenize_counts(t: Tables) -> DataFrame:
    tokens = T.raw_tokens(F.lower("text"))
    rows = t.documents.where("text is not null").select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def slang_map_tokens(t: Tables) -> DataFrame:
    rows = t.cleaned_comments.where("tokens is not null").select("id", K.apply_slang(F.filter("tokens", lambda x: x.isNotNull()), slang_map()).alias("t"))
    return rows.select("id", F.array_join("t", " ").alias("tokens"))


@query
def token_filter(t: Tables) -> DataFrame:
    rows = t.comments.where("text_raw is not null").select("id", T.raw_tokens(F.lower("text_raw")).alias("t"))
    return rows.select("id", F.array_join(K.filter_tokens(F.col("t"), stopwords()), " ").alias("tokens"))


@query
def ngrams_2(t: Tables) -> DataFrame:
    rows = _docs(t).select("comment_id", F.posexplode(K.ngrams(F.col("tokens"), 2)).alias("pos", "term"))
    return rows.select("comment_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query
def shingles_3(t: Tables) -> DataFrame:
    rows = _docs(t).select("comment_id", F.posexplode(K.shingles(F.col("tokens"), 3)).alias("pos", "term"))
    return rows.select("comment_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query
def token_diversity(t: Tables) -> DataFrame:
    return _docs(t).select("comment_id", F.round(K.diversity(F.col("tokens")), PLACES).alias("diversity"))


@query
def keyword_validate(t: Tables) -> DataFrame:
    terms = t.keywords.select("term", "type").union(t.lexicon_entries.select("term", F.lit("KEYWORD"))).union(t.videos.select(F.col("title"), F.lit("PHRASE"))).union(t.videos.select(F.col("title"), F.lit("HASHTAG")))
    return keywords.validated(terms.where("term is not null")).select("term", "type", "canonical", "reason").distinct()


@query
def infer_type(t: Tables) -> DataFrame:
    rows = t.keywords.select("term").union(t.videos.select("title")).where("term is not null").distinct().select("term", T.normal_term(F.col("term")).alias("n"))
    return rows.select("term", F.col("n").alias("normal"), T.term_type(F.col("n")).alias("type"))


@query
def video_ids(t: Tables) -> DataFrame:
    return t.comments.select("id", browse.video_id(F.col("url")).alias("video_id"))


@query
def parse_video_id(t: Tables) -> DataFrame:
    """The parser of the video platform's addresses, on addresses made from the channel ids."""
    base = F.substring(F.regexp_replace("channel_id", r"[^A-Za-z0-9_-]", ""), 1, 11)
    shapes = F.array(base, F.concat(F.lit("https://www.youtube.com/watch?a=1&v="), base, F.lit("&t=3")), F.concat(F.lit("youtu.be/"), base), F.concat(F.lit("https://m.youtube.com/shorts/"), base), F.concat(F.lit("https://video.example/"), base))
    rows = t.videos.where("channel_id is not null").select("video_id", F.posexplode(shapes).alias("shape", "value"))
    return rows.select("video_id", F.col("shape").cast("bigint").alias("shape"), api.video_id(F.col("value")).alias("parsed"))


# ------------------------------------------------------------------------------------------------ spam, duplicates


def _spam_rows(t: Tables) -> DataFrame:
    rows = t.comments.where("text_raw is not null").select("id", "text_raw", T.raw_tokens(F.lower("text_raw")).alias("raw_tokens"))
    rows = rows.withColumn("tokens", K.filter_tokens(F.col("raw_tokens"), stopwords()))
    return rows.select("id", spam.spam_reasons(F.col("text_raw"), F.col("raw_tokens"), F.col("tokens"), CONFIG.section("spam")).alias("reasons"))


@query
def spam_rules(t: Tables) -> DataFrame:
    rows = _spam_rows(t).select("id", F.explode("reasons").alias("r"))
    return rows.select("id", "r.code", F.round("r.actual", PLACES).alias("actual"), "r.threshold")


@query
def spam_by_rule(t: Tables) -> DataFrame:
    return spam.spam_by_rule(t.cleaned_comments)


@query
def exact_duplicates(t: Tables) -> DataFrame:
    """First and later comments of each text, by the hash of the blank-collapsed lower-case text."""
    rows = t.comments.where("text_raw is not null").select("id", T.text_hash(T.collapse_space(F.lower("text_raw"))).alias("norm_hash"))
    marked = dedup.mark_duplicates(rows.withColumn("v", F.lit(0).cast("bigint")).withColumn("has_tokens", F.lit(False)), near=False)
    return marked.where("is_duplicate").select("id", "duplicate_of")


@query
def copypasta(t: Tables) -> DataFrame:
    rows = t.cleaned_comments.join(t.comments.select(F.col("id").alias("comment_id"), "source_id"), "comment_id").withColumn("norm_hash", F.lower("norm_hash"))
    return spam.copypasta_groups(rows, 2)


def _fingerprints(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(id, v) of the stored fingerprints, and of the first row of each."""
    values = t.cleaned_comments.where("simhash is not null").select("id", dedup.from_hex(F.col("simhash")).alias("v")).where("v <> 0")
    return values, values.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


@query
def near_pairs(t: Tables) -> DataFrame:
    """Pairs of stored fingerprints within three bits, between the first rows of each fingerprint; ``near_pair_members`` has the other rows."""
    _, first = _fingerprints(t)
    pairs = dedup.near_pairs(first, 64, 3)
    return pairs.select("a", "b", dedup.hamming(F.col("va"), F.col("vb")).cast("bigint").alias("bits"), dedup.first_shared_band(F.col("va"), F.col("vb"), 64, 4).cast("bigint").alias("band"))


@query
def near_pair_members(t: Tables) -> DataFrame:
    """Each row with the first row of its fingerprint, which stands for it in ``near_pairs``; the two together give every link."""
    values, first = _fingerprints(t)
    return values.join(first.withColumnRenamed("id", "representative"), "v").select("id", "representative", F.lit(0).cast("bigint").alias("bits"))


@query
def near_duplicates(t: Tables) -> DataFrame:
    """Exact and near duplicates of the stored rows, resolved greedily in the order of ids.

    A missing hash is that of ``text_clean``, a missing fingerprint that of the tokens, or of the text's where these are missing too.
    """
    stored = F.filter("tokens", lambda x: x != "")
    tokens = F.when(F.col("simhash").isNull(), F.coalesce(stored, K.tokenized(F.col("text_clean"), CONFIG.section("cleaning"))))
    rows = t.cleaned_comments.select(
        "id", F.coalesce(F.lower("norm_hash"), T.text_hash(F.col("text_clean"))).alias("norm_hash"), F.coalesce(dedup.from_hex(F.col("simhash")), dedup.simhash(tokens)).alias("v")
    ).withColumn("has_tokens", F.coalesce(F.col("v") != 0, F.lit(False)))
    marked = dedup.mark_duplicates(rows)
    return marked.where("is_duplicate").select("id", "duplicate_of", "duplicate_kind")


@query
def stored_duplicates(t: Tables) -> DataFrame:
    """As ``near_duplicates``, by the stored fingerprints alone: rows without one can only be exact duplicates."""
    v = dedup.from_hex(F.col("simhash"))
    rows = t.cleaned_comments.select("id", F.coalesce(F.lower("norm_hash"), T.text_hash(F.col("text_clean"))).alias("norm_hash"), v.alias("v"), F.coalesce(v != 0, F.lit(False)).alias("has_tokens"))
    return dedup.mark_duplicates(rows).where("is_duplicate").select("id", "duplicate_of", "duplicate_kind")


#: The pipeline with exact duplicates only.
EXACT = Config({"dedup": {"near_duplicate": False}})


@query
def clean_exact(t: Tables) -> DataFrame:
    return cleaning.clean(t.comments, EXACT).select("comment_id", "text_clean", F.array_join("tokens", " ").alias("tokens"), "is_duplicate", "duplicate_of", "is_spam", "spam_reason", "norm_hash")


@query
def cleaning_stats_exact(t: Tables) -> DataFrame:
    return cleaning.cleaning_stats(cleaning.clean(t.comments, EXACT))


@query
def incremental_exact(t: Tables) -> DataFrame:
    """What a second run with exact duplicates only adds to the stored cleaned rows."""
    return cleaning.clean(t.comments, EXACT, t.cleaned_comments).select("comment_id", "text_clean", "is_duplicate", "duplicate_of", "is_spam", "spam_reason")


@query
def clean_pipeline(t: Tables) -> DataFrame:
    return cleaning.clean(t.comments).drop("tokens", "language", "reasons")


@query
def cleaning_stats(t: Tables) -> DataFrame:
    return cleaning.cleaning_stats(cleaning.clean(t.comments))


@query
def incremental_clean(t: Tables) -> DataFrame:
    """What a second run adds to the stored cleaned rows: the comments without one."""
    return cleaning.clean(t.comments, None, t.cleaned_comments).select("comment_id", "text_clean", "is_duplicate", "duplicate_of", "is_spam")


# ------------------------------------------------------------------------------------------------ analysis


@query
def corpus_totals(t: Tables) -> DataFrame:
    return analysis.corpus_totals(_docs(t))


@query
def usable_corpus(t: Tables) -> DataFrame:
    return _docs(t).select("comment_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query
def term_frequency(t: Tables) -> DataFrame:
    return _rounded(analysis.term_frequency(_docs(t)), "relative")


@query
def ngram_counts(t: Tables) -> DataFrame:
    return analysis.count_ngrams(_docs(t), [1, 2, 3], 3).withColumn("size", F.col("size").cast("bigint"))


@query
def ngram_top_per_size(t: Tables) -> DataFrame:
    rows = analysis.count_ngrams(_docs(t), [1, 2, 3], 3).withColumn("size", F.col("size").cast("bigint"))
    return analysis.top_per_group(rows, 100, [F.desc("count"), F.col("term")], ["size"])


def _tfidf(t: Tables, sublinear: bool, smooth: bool) -> DataFrame:
    return _rounded(analysis.tfidf(_docs(t), sublinear_tf=sublinear, smooth_idf=smooth), "score", "max_weight")


@query
def tfidf_scores(t: Tables) -> DataFrame:
    return _tfidf(t, True, True)


@query
def tfidf_plain_idf(t: Tables) -> DataFrame:
    return _tfidf(t, True, False)


@query
def tfidf_linear_tf(t: Tables) -> DataFrame:
    return _tfidf(t, False, True)


@query
def tfidf_plain(t: Tables) -> DataFrame:
    return _tfidf(t, False, False)


def _pairs(t: Tables, metric: str) -> DataFrame:
    return _rounded(analysis.cooccurrence(_docs(t), metric=metric), "pmi", "npmi")


@query
def cooccurrence_pmi(t: Tables) -> DataFrame:
    return _pairs(t, "pmi")


@query
def cooccurrence_npmi_top(t: Tables) -> DataFrame:
    order = [F.desc("count"), F.col("left"), F.col("right")]
    return analysis.top_per_group(_pairs(t, "npmi"), 100, order)


@query
def cooccurrence_raw_top(t: Tables) -> DataFrame:
    return _pairs(t, "raw").limit(100)


@query
def analysis_results(t: Tables) -> DataFrame:
    return analysis.analysis_rows(_docs(t), created_at=NOW).groupBy("method").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------ discovery


def _seeds(t: Tables) -> DataFrame:
    return discovery.seed_forms(t.keywords)


@query
def seed_forms(t: Tables) -> DataFrame:
    return _seeds(t).drop("place")


@query
def candidate_pool(t: Tables) -> DataFrame:
    blocked = discovery.blocked_terms(t.keywords, _candidates(t), _seeds(t))
    return discovery.candidate_pool(_docs(t), blocked, [1, 2, 3]).withColumn("size", F.col("size").cast("bigint"))


@query
def seed_association(t: Tables) -> DataFrame:
    return discovery.seed_association(_docs(t), _seeds(t)).select("token", F.round("value", PLACES).alias("value"))


@query
def candidate_scores(t: Tables) -> DataFrame:
    blocked = discovery.blocked_terms(t.keywords, _candidates(t), _seeds(t))
    rows = discovery.score_candidates(_docs(t), _seeds(t), blocked)
    return _rounded(rows.select("term", "count", "doc_freq", "raw_tfidf", "raw_cooccurrence", "score"), "raw_tfidf", "raw_cooccurrence", "score")


@query
def discover(t: Tables) -> DataFrame:
    return discovery.discover(_docs(t), t.keywords, created_at=NOW)


# ------------------------------------------------------------------------------------------------ matching, lexicon


@query
def keyword_match(t: Tables) -> DataFrame:
    return matching.match_keywords(t.comments, t.keywords)


@query
def most_matched_keywords(t: Tables) -> DataFrame:
    return matching.most_matched(matching.match_keywords(t.comments, t.keywords), t.keywords, 20)


@query
def matched_terms_agg(t: Tables) -> DataFrame:
    return browse.terms_per_comment(matching.match_keywords(t.comments, t.keywords), t.keywords)


@query
def lexicon_doc_frequency(t: Tables) -> DataFrame:
    texts = t.cleaned_comments.where("not is_duplicate and not is_spam").select("id", "text_clean")
    return matching.document_frequency(texts, "id", "text_clean", t.lexicon_entries)


@query
def lexicon_propose(t: Tables) -> DataFrame:
    return lexicon.proposals(t.lexicon_entries, t.keywords, _candidates(t), t.cleaned_comments)


@query
def lexicon_excluded_stub(t: Tables) -> DataFrame:
    return lexicon.excluded_stubs(t.lexicon_entries, ["gaul"])


@query
def lexicon_freshness(t: Tables) -> DataFrame:
    listed = t.lexicon_entries.select("source", "entry_key", "url").union(t.videos.select(F.lit("kamus"), F.lower("video_id"), F.lit(None)))
    return lexicon.stale_keys(listed, t.lexicon_entries, SINCE)


@query
def category_histogram(t: Tables) -> DataFrame:
    return lexicon.category_histogram(t.lexicon_entries)


@query
def lexicon_by_category(t: Tables) -> DataFrame:
    return lexicon.entries_of_category(t.lexicon_entries, "GAUL").select("entry_key", "term", "category")


@query
def entry_extract(t: Tables) -> DataFrame:
    """Entries parsed back from pages made of the lexicon's fields."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    part = lambda cls, c: F.concat(F.lit(f'<div class="x {cls}"><b>'), esc(F.col(c)), F.lit("</b><br></div>"))
    page = F.concat(F.lit("<html><body>"), part("word-category", "category"), part("word-title", "term"), part("definition", "definition"), part("example", "example"), F.lit("</body></html>"))
    pages = t.lexicon_entries.where("not excluded").select(F.concat(F.lit("https://kamus.example/kata/"), F.col("entry_key")).alias("url"), page.alias("html"))
    return html.extract_entries(pages, "kamus").select("entry_key", "term", "category", "definition", "example")


# ------------------------------------------------------------------------------------------------ review, keywords


@query
def review_queue(t: Tables) -> DataFrame:
    return review.queue(_candidates(t), status="PENDING").select("id", "term", "frequency", "score")


@query
def latest_pending(t: Tables) -> DataFrame:
    return review.latest_pending(_candidates(t)).select("term", "id", "iteration")


@query
def promote_approved(t: Tables) -> DataFrame:
    return review.promotions(_candidates(t), t.keywords).select("id", "term", "type", "provenance", "promoted")


@query
def keyword_list(t: Tables) -> DataFrame:
    return keywords.listed(t.keywords, status="ACTIVE").select("id", "term", "type", "iteration")


@query
def keyword_counts(t: Tables) -> DataFrame:
    return keywords.counts(t.keywords)


# ------------------------------------------------------------------------------------------------ browsing


@query
def comments_browse(t: Tables) -> DataFrame:
    return browse.browse(t.comments, t.cleaned_comments, source="youtube", search="Banget", usable=True, limit=None)


@query
def comment_state(t: Tables) -> DataFrame:
    return browse.with_state(t.comments, t.cleaned_comments).groupBy("source", "state").agg(F.count("*").alias("n"))


@query
def videos_listed(t: Tables) -> DataFrame:
    return browse.videos_listed(t.videos, t.comments, None)


@query
def status_counters(t: Tables) -> DataFrame:
    matches = matching.match_keywords(t.comments, t.keywords)
    return browse.status_counters(t.keywords, t.comments, t.cleaned_comments, _candidates(t), t.collection_runs, t.videos, matches, t.lexicon_entries)


@query
def rolling_search_calls(t: Tables) -> DataFrame:
    return browse.search_calls(t.collection_runs, SINCE)


@query
def example_comments(t: Tables) -> DataFrame:
    return matching.example_comments(t.cleaned_comments, t.comments, t.keywords.where("status = 'ACTIVE'"))


# ------------------------------------------------------------------------------------------------ sources, sinks


@query
def alias_pick(t: Tables) -> DataFrame:
    rows = t.comments.select(F.nullif("author_id", F.lit("")).alias("text"), F.col("text_raw").alias("komentar"), F.col("source_id"), F.col("id").cast("string").alias("cid"), F.col("created_at").alias("waktu"), F.col("url").alias("link"))
    return rows.select(*[files.pick(rows, f).alias(f) for f in files.ALIASES])


@query
def idempotent_append(t: Tables) -> DataFrame:
    """What a second delivery of all comments adds to those of the first half of the runs."""
    half = t.collection_runs.agg(F.max("id")).first()[0] // 2
    stored = t.comments.where(F.coalesce("run_id", F.lit(0)) <= half)
    records = t.comments.select("source", "source_id", F.col("text_raw").alias("text"), "author_id", "url", "created_at", F.lit(None).cast("string").alias("keyword"))
    return collect.new_comments(stored, records, run_id=0, collected_at=NOW).select("source", "source_id")


@query
def flatten_pages(t: Tables) -> DataFrame:
    """Comments back from pages of threads made of them, one thread with a reply per comment."""
    node = lambda i: F.struct(i.alias("id"), F.struct(F.col("text_raw").alias("textOriginal"), F.col("created_at").alias("publishedAt")).alias("snippet"))
    thread = F.struct(F.struct(F.lit("v1").alias("videoId"), node(F.col("source_id")).alias("topLevelComment")).alias("snippet"), F.struct(F.array(node(F.concat("source_id", F.lit(".r")))).alias("comments")).alias("replies"))
    pages = t.comments.select(F.to_json(F.struct(F.array(thread).alias("items"))).alias("json"))
    return api.flatten_pages(pages).groupBy("source_id", "text").agg(F.count("*").alias("n"))
