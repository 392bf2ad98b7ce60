"""The keyword table: additions, changes, listings. Every function takes a snapshot and returns the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from kataloom.functions import text as T
from kataloom.schema import schema


def validated(terms: DataFrame, term_col: str = "term", type_col: str | None = "type") -> DataFrame:
    """``terms`` plus canonical, kind and reason (null for valid terms); a null type is inferred."""
    normal = T.normal_term(F.col(term_col))
    rows = terms.withColumn("_n", normal)
    kind = T.term_type(F.col("_n"))
    rows = rows.withColumn("kind", F.coalesce(F.upper(F.col(type_col)), kind) if type_col else kind)
    canonical, reason = T.valid_term(F.col("_n"), F.col("kind"))
    return rows.withColumn("canonical", canonical).withColumn("reason", reason).drop("_n")


def next_ids(df: DataFrame, existing: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with an id column that goes on after the largest of ``existing``; for small control tables."""
    top = existing.agg(F.max("id")).first()[0] or 0
    return df.withColumn("id", (F.row_number().over(Wd.orderBy(*order)) + F.lit(top)).cast("bigint"))


def add_keywords(keywords: DataFrame, terms: DataFrame, *, iteration: int = 0, now: str, discovered_from: str | None = None) -> DataFrame:
    """The snapshot with the valid new ones of ``terms`` (term, type, optionally discovered_from, place).

    An existing (term, type) stays as it is, also if it is inactive; of repeated new ones the first counts.
    """
    if "discovered_from" not in terms.columns:
        terms = terms.withColumn("discovered_from", F.lit(discovered_from).cast("string"))
    if "place" not in terms.columns:
        terms = terms.withColumn("place", F.monotonically_increasing_id())
    rows = validated(terms).where("reason is null").groupBy("canonical", "kind").agg(F.min("place").alias("place"), F.min_by("discovered_from", "place").alias("discovered_from"))
    new = rows.select(F.col("canonical").alias("term"), F.col("kind").alias("type"), "discovered_from", "place").join(keywords.select("term", "type"), ["term", "type"], "left_anti")
    new = next_ids(new, keywords, ["place", "term", "type"])
    new = new.select("id", "term", "type", F.lit("ACTIVE").alias("status"), F.lit(iteration).cast("int").alias("iteration"), "discovered_from", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return keywords.select(*schema("keywords").names).unionByName(new)


def set_status(keywords: DataFrame, ids: Sequence[int], status: str, now: str) -> DataFrame:
    if status not in ("ACTIVE", "INACTIVE"):
        raise ValueError(f"unknown status {status!r}")
    hit = F.col("id").isin(*ids)
    return keywords.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def rename(keywords: DataFrame, keyword_id: int, term: str, now: str) -> DataFrame:
    """One keyword under a new term of the same type; refuses invalid and existing terms."""
    new = validated(keywords.where(F.col("id") == keyword_id).select(F.lit(term).alias("term"), "type")).first()
    if new is None or new["reason"]:
        raise ValueError(f"no such keyword, or not valid: {new['reason'] if new else keyword_id}")
    if keywords.where((F.col("term") == new["canonical"]) & (F.col("type") == new["kind"]) & (F.col("id") != keyword_id)).count():
        raise ValueError(f"there is a keyword {new['canonical']!r} already")
    hit = F.col("id") == keyword_id
    return keywords.withColumn("term", F.when(hit, new["canonical"]).otherwise(F.col("term"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def remove(keywords: DataFrame, ids: Sequence[int], now: str, *, hard: bool = False) -> DataFrame:
    """Soft: inactive. Hard: gone (see ``without_links`` for the tables that point to it)."""
    return keywords.where(~F.col("id").isin(*ids)) if hard else set_status(keywords, ids, "INACTIVE", now)


def without_links(links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Link rows whose keyword still exists (the cascade of a hard delete)."""
    return links.join(keywords.select(F.col("id").alias("keyword_id")), "keyword_id", "left_semi").select(*links.columns)


def listed(keywords: DataFrame, *, status: str | None = None, kind: str | None = None, iteration: int | None = None) -> DataFrame:
    for column, value in (("status", status), ("type", kind), ("iteration", iteration)):
        if value is not None:
            keywords = keywords.where(F.col(column) == value)
    return keywords.orderBy("iteration", "type", "term")


def counts(keywords: DataFrame) -> DataFrame:
    """(status, type, n)."""
    return keywords.groupBy("status", "type").agg(F.count("*").alias("n"))


def buckets(keywords: DataFrame) -> dict[str, list[str]]:
    """The active keywords as the three lists of the exchange file (a small control table, collected)."""
    out: dict[str, list[str]] = {"keywords": [], "phrases": [], "hashtags": []}
    name = {"KEYWORD": "keywords", "PHRASE": "phrases", "HASHTAG": "hashtags"}
    for r in listed(keywords, status="ACTIVE").select("term", "type").collect():
        out[name[r["type"]]].append(r["term"])
    return out


def from_buckets(keywords: DataFrame, content: dict[str, list[str]], *, now: str, iteration: int = 0) -> DataFrame:
    """The snapshot with the lists of an exchange file added."""
    kind = {"keywords": "KEYWORD", "phrases": "PHRASE", "hashtags": "HASHTAG"}
    rows = [(str(t), kind[b], i) for i, (b, t) in enumerate((b, t) for b in kind for t in content.get(b) or [])]
    terms = keywords.sparkSession.createDataFrame(rows, "term string, type string, place bigint")
    return add_keywords(keywords, terms, iteration=iteration, now=now, discovered_from="import")
