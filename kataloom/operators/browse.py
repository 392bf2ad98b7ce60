"""Listings and counters over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comment_state() -> Column:
    """raw (no cleaned row), spam, dup or ok."""
    return F.when(F.col("is_spam").isNull(), "raw").when(F.col("is_spam"), "spam").when(F.col("is_duplicate"), "dup").otherwise("ok")


def latest_cleaned(cleaned: DataFrame) -> DataFrame:
    """One cleaned row per comment: that with the largest id. Only flags are moved."""
    last = cleaned.groupBy("comment_id").agg(F.max(F.struct("id", "is_duplicate", "duplicate_of", "is_spam", "spam_reason")).alias("c"))
    return last.select("comment_id", "c.is_duplicate", "c.duplicate_of", "c.is_spam", "c.spam_reason")


def with_state(comments: DataFrame, cleaned: DataFrame) -> DataFrame:
    flags = latest_cleaned(cleaned).withColumnRenamed("comment_id", "id")
    return comments.join(flags, "id", "left").withColumn("state", comment_state())


def video_id(url: Column) -> Column:
    """The v parameter of a comment's address."""
    return F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1), F.lit(""))


def browse(
    comments: DataFrame,
    cleaned: DataFrame,
    *,
    source: str | None = None,
    video: str | None = None,
    keyword: str | None = None,
    links: DataFrame | None = None,
    matched: str | None = None,
    matches: DataFrame | None = None,
    keywords: DataFrame | None = None,
    search: str | None = None,
    usable: bool = False,
    limit: int | None = 20,
) -> DataFrame:
    """Comments with their state, newest (largest id) first.

    ``keyword`` and ``matched`` are terms: of a keyword that found the comment (``links``), or that stands in it
    (``matches``). ``search`` is a part of the text, without regard to case. ``limit`` 0 or None is all.
    """
    rows = with_state(comments, cleaned)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if video is not None:
        rows = rows.where(video_id(F.col("url")) == video)
    for term, table in ((keyword, links), (matched, matches)):
        if term is not None and table is not None and keywords is not None:
            ids = keywords.where(F.col("term") == term.lower()).select(F.col("id").alias("keyword_id"))
            rows = rows.join(table.join(ids, "keyword_id", "left_semi").select(F.col("comment_id").alias("id")), "id", "left_semi")
    if search is not None:
        rows = rows.where(F.contains(F.lower("text_raw"), F.lit(search.lower())))
    if usable:
        rows = rows.where("state = 'ok'")
    rows = rows.select("id", "source", "state", "text_raw", "url", "created_at").orderBy(F.desc("id"))
    return rows.limit(limit) if limit else rows


def terms_per_comment(links: DataFrame, keywords: DataFrame) -> DataFrame:
    """(comment_id, terms): the terms linked to each comment, sorted, between ', '."""
    named = links.join(keywords.select(F.col("id").alias("keyword_id"), "term"), "keyword_id")
    return named.groupBy("comment_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("terms"))


def videos_listed(videos: DataFrame, comments: DataFrame, limit: int | None = 30) -> DataFrame:
    """Videos with the number of stored comments, latest discovered first. An equi-join on the id in the address."""
    counts = comments.select(video_id(F.col("url")).alias("video_id")).where("video_id is not null").groupBy("video_id").agg(F.count("*").alias("stored"))
    rows = videos.join(counts, "video_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    rows = rows.select("video_id", "keyword", "title", "comments_fetched", "stored", "discovered_at").orderBy(F.desc("discovered_at"), "video_id")
    return rows.limit(limit) if limit else rows


def current_iteration(keywords: DataFrame, candidates: DataFrame | None, runs: DataFrame) -> int:
    """The largest iteration of keywords, candidates and runs; 0 if there is none."""
    tables = [t for t in (keywords, candidates, runs) if t is not None]
    return max(t.agg(F.max("iteration")).first()[0] or 0 for t in tables)


def status_counters(keywords: DataFrame, comments: DataFrame, cleaned: DataFrame, candidates: DataFrame, runs: DataFrame, videos: DataFrame, matches: DataFrame, entries: DataFrame) -> DataFrame:
    """(metric, value): the fifteen counters, one pass over each table."""
    parts = [
        keywords.agg(F.count_if(F.col("status") == "ACTIVE").alias("keywords"), F.count("*").alias("keywords_total")),
        comments.agg(F.count("*").alias("comments")),
        cleaned.agg(
            F.count("*").alias("cleaned"), F.count_if("is_duplicate").alias("duplicates"), F.count_if("is_spam").alias("spam"),
            F.count_if(~F.col("is_duplicate") & ~F.col("is_spam")).alias("usable"),
        ),
        candidates.agg(*[F.count_if(F.col("status") == s.upper()).alias(f"candidates_{s}") for s in ("pending", "approved", "rejected")]),
        runs.agg(F.count("*").alias("runs")),
        videos.agg(F.count("*").alias("videos_cached")),
        matches.agg(F.countDistinct("comment_id").alias("keyword_matched")),
        entries.agg(F.count_if(~F.col("excluded")).alias("lexicon_entries")),
        keywords.select("iteration").union(candidates.select("iteration")).union(runs.select("iteration")).agg(F.coalesce(F.max("iteration"), F.lit(0)).cast("bigint").alias("iteration")),
    ]
    out = None
    for p in parts:
        rows = p.select(F.explode(F.create_map(*[x for c in p.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def search_calls(runs: DataFrame, since: str) -> DataFrame:
    """(search_calls): of the runs that started at or after ``since`` (ISO text). Broken params count 0."""
    calls = F.try_variant_get(F.try_parse_json("params"), "$.search_calls", "bigint")
    return runs.where(F.col("started_at") >= since).agg(F.coalesce(F.sum(calls), F.lit(0)).alias("search_calls"))
