"""Schemas of the tables, their enumerations, and checks that a row store would do itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Table -> columns.
TABLES = {
    "keywords": "id bigint, term string, type string, status string, iteration int, discovered_from string, created_at string, updated_at string",
    "comments": "id bigint, source string, source_id string, text_raw string, author_id string, url string, created_at string, collected_at string, run_id bigint",
    "cleaned_comments": "id bigint, comment_id bigint, text_clean string, tokens array<string>, language string, is_duplicate boolean, duplicate_of bigint, is_spam boolean, spam_reason string, norm_hash string, simhash string, processed_at timestamp",
    "collection_runs": "id bigint, source string, iteration int, started_at string, finished_at string, keyword_count int, comments_collected bigint, status string, error string, params string, quota_used bigint",
    "keyword_candidates": "id bigint, term string, type string, source_method string, frequency bigint, score double, discovered_from string, iteration int, status string, reviewed_at string, created_at string",
    "videos": "video_id string, keyword string, title string, channel_id string, published_at string, discovered_at string, comments_fetched bigint",
    "comment_keywords": "comment_id bigint, keyword_id bigint",
    "comment_keyword_matches": "comment_id bigint, keyword_id bigint",
    "analysis_results": "iteration int, method string, term string, value double, metadata string, created_at string",
    "lexicon_entries": "source string, entry_key string, url string, term string, category string, definition string, example string, excluded boolean, fetched_at string",
}
#: Enumerations and the unique keys.
ENUMS = {
    ("keywords", "type"): ("KEYWORD", "PHRASE", "HASHTAG"),
    ("keywords", "status"): ("ACTIVE", "INACTIVE"),
    ("keyword_candidates", "type"): ("KEYWORD", "PHRASE", "HASHTAG"),
    ("keyword_candidates", "status"): ("PENDING", "APPROVED", "REJECTED"),
    ("collection_runs", "status"): ("RUNNING", "SUCCESS", "PARTIAL", "FAILED"),
}
KEYS = {
    "keywords": ("term", "type"), "comments": ("source", "source_id"), "cleaned_comments": ("comment_id",), "collection_runs": ("id",),
    "keyword_candidates": ("term", "iteration"), "videos": ("video_id",), "comment_keywords": ("comment_id", "keyword_id"),
    "comment_keyword_matches": ("comment_id", "keyword_id"), "lexicon_entries": ("source", "entry_key"),
}
RAW_RECORD = "source string, source_id string, text string, author_id string, created_at string, url string, keyword string"


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def violations(df: DataFrame, table: str) -> DataFrame:
    """(rule, key, n): values outside an enumeration and repeated unique keys."""
    out = df.sparkSession.createDataFrame([], "rule string, key string, n bigint")
    for (name, column), allowed in ENUMS.items():
        if name == table:
            bad = df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
            out = out.union(bad.groupBy(F.lit(f"{column} out of range").alias("rule"), F.col(column).alias("key")).agg(F.count("*").alias("n")))
    keys = KEYS.get(table, ())
    if keys:
        again = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        out = out.union(again.select(F.lit("key repeated").alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n"))
    return out


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference has no parent row (what a foreign key would refuse)."""
    keys = parent.select(F.col(parent_key).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti")
