"""The lexicon: freshness of entries, exclusion, listing, and terms proposed as candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataloom.operators.keywords import validated
from kataloom.operators.matching import document_frequency


def hashed_key(key: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(key))


def stale_keys(listed: DataFrame, stored: DataFrame, cutoff: str, *, limit: int | None = None, refresh: bool = False) -> DataFrame:
    """Keys (source, entry_key, url) of a listing that have no entry fetched since ``cutoff`` (ISO text).

    Excluded entries are stored under a hashed key, so both forms are looked up.
    """
    if refresh:
        out = listed
    else:
        fresh = stored.where(F.col("fetched_at") >= cutoff).select("source", F.col("entry_key").alias("_k")).distinct()
        out = listed.withColumn("_k", F.col("entry_key")).join(fresh, ["source", "_k"], "left_anti")
        out = out.withColumn("_k", hashed_key(F.col("entry_key"))).join(fresh, ["source", "_k"], "left_anti").drop("_k")
    return out.limit(limit) if limit else out


def excluded_stubs(entries: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Entries with those of the excluded categories (compared without case) reduced to a hashed key."""
    out = F.coalesce(F.lower(F.trim("category")).isin(*[c.strip().lower() for c in categories]), F.lit(False)) | F.coalesce("excluded", F.lit(False))
    rows = entries.withColumn("_out", out)
    for c in ("term", "definition", "example", "url"):
        rows = rows.withColumn(c, F.when(~F.col("_out"), F.col(c)))
    already = F.col("entry_key").startswith("sha1:")
    rows = rows.withColumn("entry_key", F.when(F.col("_out") & ~already, hashed_key(F.col("entry_key"))).otherwise(F.col("entry_key")))
    return rows.withColumn("excluded", F.col("_out")).drop("_out")


def entries_of_category(entries: DataFrame, category: str | None = None, limit: int | None = None) -> DataFrame:
    rows = entries.where("not excluded")
    if category is not None:
        rows = rows.where(F.lower("category") == category.lower())
    rows = rows.orderBy("term")
    return rows.limit(limit) if limit else rows


def category_histogram(entries: DataFrame) -> DataFrame:
    """(category, n) of the entries that are not excluded; no category is '-'."""
    return entries.where("not excluded").groupBy(F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def proposals(entries: DataFrame, keywords: DataFrame, candidates: DataFrame, cleaned: DataFrame, *, respect_rejections: bool = True, source: str | None = None) -> DataFrame:
    """(entry_key, term, type, frequency, url, outcome) for every entry with a term, in the order of keys.

    Outcomes: invalid, already_keyword (a keyword of any type has the term), already_candidate (a candidate has it;
    if rejections are not respected, one that isn't rejected; or an earlier entry), created. ``frequency`` is the
    number of usable comments that hold the term as whole words.
    """
    rows = entries.where("not excluded and term is not null")
    if source is not None:
        rows = rows.where(F.col("source") == source)
    rows = validated(rows.select("entry_key", F.col("term").alias("_raw"), "url"), "_raw", None)
    known = keywords.select(F.col("term").alias("canonical"), F.lit(True).alias("_k")).distinct()
    blocking = candidates if respect_rejections else candidates.where("status <> 'REJECTED'")
    taken = blocking.select(F.col("term").alias("canonical"), F.lit(True).alias("_c")).distinct()
    first = rows.where("reason is null").groupBy("canonical").agg(F.min("entry_key").alias("_first"))
    rows = rows.join(known, "canonical", "left").join(taken, "canonical", "left").join(first, "canonical", "left")
    outcome = (
        F.when(F.col("reason").isNotNull(), "invalid").when(F.col("_k"), "already_keyword").when(F.col("_c") | (F.col("_first") != F.col("entry_key")), "already_candidate").otherwise("created")
    )
    rows = rows.select("entry_key", F.col("canonical").alias("term"), F.col("kind").alias("type"), "url", outcome.alias("outcome"))
    usable = cleaned.where("not is_duplicate and not is_spam").select(F.col("id").alias("_id"), "text_clean")
    freq = document_frequency(usable, "_id", "text_clean", rows.where("outcome = 'created'"))
    return rows.join(freq, "term", "left").select("entry_key", "term", "type", F.col("doc_freq").alias("frequency"), "url", "outcome")


def proposed_candidates(proposed: DataFrame, *, iteration: int, now: str) -> DataFrame:
    """The created proposals as candidate rows (score 0, PENDING)."""
    return proposed.where("outcome = 'created'").select(
        "term", "type", F.lit("LEXICON").alias("source_method"), "frequency", F.lit(0.0).alias("score"), F.col("url").alias("discovered_from"),
        F.lit(iteration).cast("int").alias("iteration"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("reviewed_at"), F.lit(now).alias("created_at"),
    )
