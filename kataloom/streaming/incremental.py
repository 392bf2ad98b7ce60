"""Incremental ingest and cleaning as Structured Streaming jobs over the same operators.

State is the stored tables themselves: each micro-batch joins to the fingerprints of earlier originals. It is not
bounded by a watermark, because a comment can repeat one of any age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kataloom.config import Config
from kataloom.functions import text as T
from kataloom.operators.cleaning import clean, recount_copypasta
from kataloom.operators.store import Store
from kataloom.sources.collect import new_comments, utc_now


def clean_batch(store: Store, batch: DataFrame, config: Config | None = None, now: Callable[[], str] = utc_now) -> None:
    """Clean the comments of a batch that have no cleaned row yet, append them, and mark stored rows that have become copypasta.

    Running it again adds nothing. The source ids of earlier rows are those of the stored comments.
    """
    prior = store.read("cleaned_comments")
    sources = store.read("comments").select("id", "source_id").union(batch.select("id", "source_id")).dropDuplicates(["id"])
    rows = clean(batch, config, prior, sources=sources)
    top = prior.agg(F.max("id")).first()[0] or 0
    # Numbered from the largest id on; in range partitions of the comments' ids, so that no task gets all rows.
    rows = rows.repartitionByRange("comment_id").sortWithinPartitions("comment_id").withColumn("_n", F.monotonically_increasing_id())
    rows = rows.select((F.col("_n") + F.lit(top + 1)).alias("id"), *[c for c in rows.columns if c not in ("reasons", "_n")], F.lit(now()).cast("timestamp").alias("processed_at"))
    store.append("cleaned_comments", rows)
    stored = store.read("cleaned_comments")
    marked = recount_copypasta(stored, sources, config)
    # Marking only adds spam, so equal counts mean equal tables.
    spam = F.count_if("is_spam")
    if marked.agg(spam).first() != stored.agg(spam).first():
        store.overwrite("cleaned_comments", marked)


def cleaning_stream(comments: DataFrame, store: Store, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """``comments`` (a stream with the columns of the table) through ``clean_batch``."""
    return comments.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: clean_batch(store, df, config)).trigger(availableNow=True).start()


def ingest_batch(store: Store, records: DataFrame, run_id: int = 0, now: Callable[[], str] = utc_now) -> None:
    """Append the records whose (source, source_id) is new."""
    store.append("comments", new_comments(store.read("comments"), records, run_id=run_id, collected_at=now()))


def ingest_stream(records: DataFrame, store: Store, checkpoint: str, run_id: int = 0) -> StreamingQuery:
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(store, df, run_id)).trigger(availableNow=True).start()


def exact_deduplicated(comments: DataFrame, config: Config | None = None) -> DataFrame:
    """A stream of comments with only the first of each cleaned text (the exact-only variant)."""
    text = T.normalized(F.coalesce("text_raw", F.lit("")), (config or Config()).section("cleaning"))
    return comments.withColumn("norm_hash", T.text_hash(text)).dropDuplicates(["norm_hash"])
