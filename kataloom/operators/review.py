"""Review of candidates: the queue, decisions as events, promotion to keywords of the next iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from kataloom.functions import text as T
from kataloom.operators.keywords import add_keywords, validated


def append_candidates(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose (term, iteration) it doesn't hold; ids go on, best score first."""
    from kataloom.operators.keywords import next_ids

    rank = F.row_number().over(Wd.partitionBy("term", "iteration").orderBy(F.desc("score"), F.desc("frequency")))
    once = new.withColumn("_r", rank).where("_r = 1").drop("_r")
    fresh = next_ids(once.join(existing.select("term", "iteration"), ["term", "iteration"], "left_anti"), existing, [F.desc("score"), F.desc("frequency"), "term"])
    return existing.unionByName(fresh.select(*existing.columns))


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their latest decision (id, status, reviewed_at) laid on them."""
    last = decisions.groupBy("id").agg(F.max(F.struct("reviewed_at", "status")).alias("d"))
    rows = candidates.join(last, "id", "left")
    return rows.withColumn("status", F.coalesce("d.status", "status")).withColumn("reviewed_at", F.coalesce("d.reviewed_at", "reviewed_at")).select(*candidates.columns)


def queue(candidates: DataFrame, *, status: str | None = "PENDING", method: str | None = None, limit: int | None = None) -> DataFrame:
    """Candidates by score and frequency, best first."""
    for column, value in (("status", status), ("source_method", method)):
        if value is not None:
            candidates = candidates.where(F.col(column) == value)
    out = candidates.orderBy(F.desc("score"), F.desc("frequency"), "id")
    return out.limit(limit) if limit else out


def latest_pending(candidates: DataFrame) -> DataFrame:
    """For each term its pending candidate of the latest iteration."""
    rank = F.row_number().over(Wd.partitionBy("term").orderBy(F.desc("iteration"), F.desc("id")))
    return candidates.where("status = 'PENDING'").withColumn("_r", rank).where("_r = 1").drop("_r")


def promotions(candidates: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, term, type, provenance, place, promoted): the approved candidates, and whether each becomes a keyword."""
    approved = validated(candidates.where("status = 'APPROVED'"))
    place = F.row_number().over(Wd.orderBy(F.desc("score"), F.desc("frequency"), "id"))
    note = F.concat(F.col("source_method"), F.lit(" kandidat#"), F.col("id").cast("string"), F.when(F.coalesce("discovered_from", F.lit("")) != "", F.concat(F.lit(" "), F.col("discovered_from"))).otherwise(""))
    rows = approved.select("id", F.col("canonical").alias("term"), F.col("kind").alias("type"), "reason", note.alias("provenance"), place.alias("place"))
    known = keywords.select("term", "type", F.lit(True).alias("_known"))
    rows = rows.join(known, ["term", "type"], "left").withColumn("_first", F.row_number().over(Wd.partitionBy("term", "type").orderBy("place")) == 1)
    return rows.select("id", "term", "type", "provenance", "place", (F.col("reason").isNull() & F.col("_known").isNull() & F.col("_first")).alias("promoted"))


def promote_approved(candidates: DataFrame, keywords: DataFrame, *, iteration: int, now: str) -> DataFrame:
    """The keyword snapshot with the promoted candidates, as of ``iteration`` (the current one plus 1)."""
    rows = promotions(candidates, keywords).where("promoted").select("term", "type", F.col("provenance").alias("discovered_from"), "place")
    return add_keywords(keywords, rows, iteration=iteration, now=now)


def with_details(candidates: DataFrame, entries: DataFrame, cleaned: DataFrame, comments: DataFrame) -> DataFrame:
    """Candidates with what helps to judge them: category, definition and example of the lexicon entry they come from, and example comments.

    A candidate belongs to the entry whose address it was discovered at; ``in_comments`` are the shortest usable comments that hold the term.
    """
    from kataloom.operators.matching import example_comments

    known = entries.where("url is not null and not excluded").groupBy("url").agg(*[F.first(c).alias(c) for c in ("category", "definition", "example")])
    rows = candidates.join(known.withColumnRenamed("url", "_url"), (F.col("source_method") == "LEXICON") & (F.col("discovered_from") == F.col("_url")), "left").drop("_url")
    found = example_comments(cleaned, comments, candidates).withColumnRenamed("example", "_text")
    texts = found.groupBy("term").agg(F.array_sort(F.collect_list(F.struct(F.length("_text").alias("n"), "comment_id", "_text"))).alias("_t"))
    return rows.join(texts.select("term", F.col("_t._text").alias("in_comments")), "term", "left").select(*candidates.columns, "category", "definition", "example", "in_comments")


def pending_of_terms(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """(asked, id): for each asked term its pending candidate of the latest iteration, null if there is none."""
    last = latest_pending(candidates).select(F.col("term").alias("_n"), "id")
    return terms.withColumn("_n", T.normal_term(F.col("asked"))).join(last, "_n", "left").select("asked", "id")
