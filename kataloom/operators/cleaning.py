"""The cleaning pipeline: normalise, tokenise, rules, fingerprints, duplicates, copypasta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataloom.config import Config
from kataloom.functions import text as T
from kataloom.functions.tokens import tokenized
from kataloom.operators.dedup import from_hex, mark_duplicates, simhash, simhash_hex
from kataloom.operators.spam import mark_copypasta, reason_text, spam_reasons
from kataloom.session import staged


def prepared(comments: DataFrame, config: Config, stem: Callable[[str], str] | None = None) -> DataFrame:
    """(id, source_id, text_clean, tokens, reasons, norm_hash, v): everything that needs one comment only.

    Null texts are treated as empty ones.
    """
    cleaning, dedup = config.section("cleaning"), config.section("dedup")
    rows = comments.select("id", "source_id", F.coalesce("text_raw", F.lit("")).alias("raw"))
    rows = rows.withColumn("text_clean", T.normalized(F.col("raw"), cleaning))
    rows = rows.withColumn("raw_tokens", T.raw_tokens(F.col("text_clean"))).withColumn("tokens", tokenized(F.col("text_clean"), cleaning, stem))
    rows = rows.withColumn("reasons", spam_reasons(F.col("raw"), F.col("raw_tokens"), F.col("tokens"), config.section("spam")))
    return rows.select("id", "source_id", "text_clean", "tokens", "reasons", T.text_hash(F.col("text_clean")).alias("norm_hash"), simhash(F.col("tokens"), dedup["simhash_bits"], dedup["shingle_size"]).alias("v"))


def clean(
    comments: DataFrame, config: Config | None = None, prior: DataFrame | None = None, stem: Callable[[str], str] | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """Cleaned rows of ``comments`` that have none in ``prior`` yet (all of them without ``prior``).

    Columns: comment_id, text_clean, tokens, language (null), is_duplicate, duplicate_of, is_spam, spam_reason,
    norm_hash, simhash, and reasons (structured). Ids give the order in which originals are chosen. With ``prior``,
    only its originals are matched against, so a copy of an earlier near duplicate points to the root original.
    Copypasta is counted over ``prior`` and the new rows; ``sources`` are the comments of ``prior`` (by default,
    ``comments`` holds them). The rows of ``prior`` that a new copy makes spam are marked by ``recount_copypasta``.
    """
    config = config or Config()
    sources = comments if sources is None else sources
    if prior is not None:
        comments = comments.join(prior.select(F.col("comment_id").alias("id")), "id", "left_anti")
    rows = staged(prepared(comments, config, stem), "prepared").withColumn("has_tokens", F.size("tokens") > 0)
    known = None
    if prior is not None:
        known = prior.where("not is_duplicate").select(F.col("comment_id").alias("id"), F.lower("norm_hash").alias("norm_hash"), from_hex(F.col("simhash")).alias("v"))
    d = config.section("dedup")
    marked = mark_duplicates(rows, known, bits=d["simhash_bits"], threshold=d["hamming_threshold"], bands=d["bands"], enabled=d["enabled"], near=d["near_duplicate"])
    out = marked.withColumn("is_spam", F.size("reasons") > 0).withColumn("spam_reason", reason_text(F.col("reasons")))
    if prior is not None:
        # Counted and marked from here, instead of resolving the duplicates again for each.
        out = staged(out, "marked")
    out = mark_copypasta(out, config.section("spam"), None if prior is None else with_sources(prior, sources))
    return out.select(
        F.col("id").alias("comment_id"), "text_clean", "tokens", F.lit(None).cast("string").alias("language"), "is_duplicate", "duplicate_of",
        "is_spam", "spam_reason", "norm_hash", simhash_hex(F.col("v")).alias("simhash"), "reasons",
    )


def with_sources(cleaned: DataFrame, comments: DataFrame) -> DataFrame:
    """``cleaned`` with the source ids of its comments, null where a comment is not known."""
    return cleaned.join(comments.select(F.col("id").alias("comment_id"), "source_id"), "comment_id", "left")


def recount_copypasta(cleaned: DataFrame, comments: DataFrame, config: Config | None = None) -> DataFrame:
    """The corpus-wide copypasta rule over all cleaned rows, with the source ids of their comments."""
    marked = mark_copypasta(with_sources(cleaned, comments), (config or Config()).section("spam"))
    return marked.select(*cleaned.columns)


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """One row: processed, duplicates, spam (rules of single comments), copypasta, usable."""
    pasta = F.coalesce(F.col("spam_reason").startswith("copypasta"), F.lit(False))
    return cleaned.agg(
        F.count("*").alias("processed"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("is_spam") & ~pasta).alias("spam"),
        F.count_if(pasta).alias("copypasta"),
        F.count_if(~F.col("is_duplicate") & ~F.col("is_spam")).alias("usable"),
    )
