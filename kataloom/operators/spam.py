"""Spam rules and copypasta."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataloom.functions import text as T
from kataloom.functions.tokens import diversity

REASON = "struct<code:string,actual:double,threshold:double>"
RULES = ("phone_number", "too_many_urls", "too_many_mentions", "too_many_hashtags", "char_run", "too_few_tokens", "low_diversity")


def spam_reasons(raw: Column, raw_tokens: Column, tokens: Column, spam: Mapping[str, Any]) -> Column:
    """array<struct<code, actual, threshold>> of the rules a comment breaks, in their fixed order.

    URLs, mentions, hashtags and runs are counted on the raw text, diversity on the unfiltered tokens, the number of
    tokens on the filtered ones. An empty array means no spam.
    """
    if not spam.get("enabled", True):
        return F.array().cast(f"array<{REASON}>")

    def rule(code: str, hit: Column, actual: Column, threshold: float) -> Column:
        return F.when(hit, F.struct(F.lit(code).alias("code"), actual.cast("double").alias("actual"), F.lit(float(threshold)).alias("threshold")))

    rules = [rule("phone_number", T.has_phone(raw), F.lit(1), 0)] if spam.get("detect_phone_numbers", True) else []
    for code, n, most in (
        ("too_many_urls", T.count_urls(raw), spam["max_urls"]),
        ("too_many_mentions", T.count_mentions(raw), spam["max_mentions"]),
        ("too_many_hashtags", T.count_hashtags(raw), spam["max_hashtags"]),
        # A run is measured only where there is one of more than the limit.
        ("char_run", F.when(raw.rlike(rf"(?s)(.)\1{{{int(spam['max_char_run'])}}}"), T.longest_run(raw)).otherwise(0), spam["max_char_run"]),
    ):
        rules.append(rule(code, n > most, n, most))
    rules.append(rule("too_few_tokens", F.size(tokens) < spam["min_tokens_after_clean"], F.size(tokens), spam["min_tokens_after_clean"]))
    rules.append(rule("low_diversity", diversity(raw_tokens) < spam["min_token_diversity"], diversity(raw_tokens), spam["min_token_diversity"]))
    return F.array_compact(F.array(*rules)).cast(f"array<{REASON}>")


def reason_text(reasons: Column) -> Column:
    """The reasons as one string, null if there are none."""
    def one(r: Column) -> Column:
        whole = lambda c: c.cast("bigint").cast("string")
        return (
            F.when(r["code"].isin("phone_number", "copypasta_mark"), r["code"])
            .when(r["code"] == "too_few_tokens", F.concat(r["code"], F.lit(" ("), whole(r["actual"]), F.lit(" < "), whole(r["threshold"]), F.lit(")")))
            .when(r["code"] == "low_diversity", F.format_string("low_diversity (%.2f < %.2f)", r["actual"], r["threshold"]))
            .when(r["code"] == "copypasta", F.concat(F.lit("copypasta ("), whole(r["actual"]), F.lit(" >= "), whole(r["threshold"]), F.lit(")")))
            .otherwise(F.concat(r["code"], F.lit(" ("), whole(r["actual"]), F.lit(" > "), whole(r["threshold"]), F.lit(")")))
        )

    return F.nullif(F.array_join(F.transform(reasons, one), "; "), F.lit(""))


def reason_codes(spam_reason: Column) -> Column:
    """The rule codes of a stored reason string."""
    return F.transform(F.split(spam_reason, "; "), lambda x: F.split(x, " ")[0])


def spam_by_rule(cleaned: DataFrame, reason_col: str = "spam_reason") -> DataFrame:
    """(code, n), most frequent first; copypasta is left to its own counter."""
    codes = cleaned.where(F.col(reason_col).isNotNull()).select(F.explode(reason_codes(F.col(reason_col))).alias("code"))
    return codes.where("code <> 'copypasta'").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def copypasta_groups(cleaned: DataFrame, least: int) -> DataFrame:
    """(norm_hash, copies): texts that stand under at least ``least`` distinct source ids. Empty texts don't count."""
    rows = cleaned.where(F.col("norm_hash").isNotNull() & (F.col("text_clean") != "") & F.col("source_id").isNotNull())
    return rows.groupBy("norm_hash").agg(F.countDistinct("source_id").alias("copies")).where(F.col("copies") >= least)


def mark_copypasta(cleaned: DataFrame, spam: Mapping[str, Any], stored: DataFrame | None = None) -> DataFrame:
    """``cleaned`` (with source_id) with every member of a copypasta group marked as spam, also the first one.

    ``stored`` holds rows (norm_hash, text_clean, source_id) that count as well but are not returned. Hashes are compared without case.
    Rows that are spam already keep their reason. Nothing is done if spam rules are off or copypasta_min_authors is below 2.
    """
    least = spam.get("copypasta_min_authors", 5)
    if not spam.get("enabled", True) or least < 2:
        return cleaned
    counted = cleaned.select(F.lower("norm_hash").alias("norm_hash"), "text_clean", "source_id")
    if stored is not None:
        same = stored.select(F.lower("norm_hash").alias("norm_hash"), "text_clean", "source_id").join(counted.select("norm_hash").distinct(), "norm_hash", "left_semi")
        counted = counted.unionByName(same)
    groups = copypasta_groups(counted, least).withColumnRenamed("norm_hash", "group_hash")
    rows = cleaned.join(groups, F.lower("norm_hash") == F.col("group_hash"), "left")
    hit = F.col("copies").isNotNull() & ~F.col("is_spam") & (F.col("text_clean") != "")
    reason = F.concat(F.lit("copypasta ("), F.col("copies").cast("string"), F.lit(f" >= {least})"))
    return rows.withColumn("spam_reason", F.when(hit, reason).otherwise(F.col("spam_reason"))).withColumn("is_spam", F.col("is_spam") | hit).select(*cleaned.columns)
