"""The queries of the training-data operators: name -> (spark, folder) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from kataloom.llm.cooccur import cooccurring_items
from kataloom.llm.formatdups import formatting_duplicates
from kataloom.llm.lookalike import lookalike_groups
from kataloom.llm.mixing import mix_sources, mixture_plan, mixture_shares, replicated
from kataloom.llm.nearjoin import near_duplicate_groups
from kataloom.llm.packing import container_contents, fill_containers, filling
from kataloom.llm.pii import redact_personal_information
from kataloom.llm.splitting import split_oversized
from kataloom.llm.termfreq import term_frequencies, usefulness
from kataloom.llm.tokens import RUNS
from kataloom.session import spread


#: The tables that grow.
LARGE = ("comments", "cleaned_comments", "documents")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table) if name in LARGE else table


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned rows whose comments are counted."""
    return _table(spark, folder, "cleaned_comments").where("not is_duplicate and not is_spam").select("comment_id", "tokens")


def _limit(spark: SparkSession, folder: str, name: str) -> tuple[int, int]:
    row = _table(spark, folder, "size_limits").where(F.col("limit_name") == name).first()
    return row["max_tokens"], row["overlap_tokens"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurring_items(_counted(spark, folder), "comment_id", "tokens", min_count=4, share_of_records=800, min_ratio=8)
    return pairs.select("token_a", "token_b")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    redacted = redact_personal_information(_table(spark, folder, "comments"), "id", "text_raw", _table(spark, folder, "name_parts"))
    # Cards and accounts are redacted as well, but are no cases of this query.
    return redacted.select(F.col("id").alias("comment_id"), F.explode("kinds").alias("kind")).where(~F.col("kind").isin("card", "account"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = formatting_duplicates(_table(spark, folder, "comments"), "id", "text_raw", least=12)
    return groups.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_groups(_table(spark, folder, "comments"), "id", "text_raw").select("first_id", F.col("id").alias("twin_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicate_groups(_table(spark, folder, "comments"), "id", "text_raw", threshold=(7, 10), least=10)
    return groups.where("id <> first_id").select("first_id", F.col("id").alias("other_id"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    counted = _counted(spark, folder)
    has_token = F.exists("tokens", lambda x: x.isNotNull() & (x != ""))
    records = counted.where(has_token & F.col("comment_id").isNotNull()).select("comment_id").distinct().count()
    terms = term_frequencies(counted, "comment_id", "tokens")
    return terms.select("term", usefulness(F.col("doc_freq"), records).alias("mark")).where("mark is not null")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    capacity, _ = _limit(spark, folder, "container")
    return fill_containers(_table(spark, folder, "documents"), "doc_id", "text", capacity)


def p7_filling(spark: SparkSession, folder: str) -> DataFrame:
    capacity, _ = _limit(spark, folder, "container")
    return filling(p7_containers(spark, folder), capacity)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"), "doc_id", "text", "source", _table(spark, folder, "mix_targets"))


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of each document in its containers: its parts cover it once, and it is split only if it is larger than a container."""
    capacity, _ = _limit(spark, folder, "container")
    placed = fill_containers(_table(spark, folder, "documents"), "doc_id", "text", capacity)
    parts = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("size"), F.max("n_parts").alias("n_parts"), F.sum("part").alias("parts"), F.max(F.col("start_token") + F.col("n_tokens")).alias("stop"))
    once = (F.col("n") == F.col("n_parts")) & (F.col("size") == F.col("stop")) & (F.col("parts") * 2 == F.col("n") * (F.col("n") - 1))
    return parts.select("doc_id", once.alias("once"), (F.col("n") == F.ceil(F.col("size") / capacity)).alias("split_only_if_larger"))


def p7_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The containers by tokens of ``p7_containers``'s rule, with sizes in runs: one row, what they hold in all and whether any is overfull."""
    capacity, _ = _limit(spark, folder, "container")
    docs = _table(spark, folder, "documents")
    boxes = container_contents(fill_containers(docs, "doc_id", "text", capacity, tokenizer=RUNS), docs, "doc_id", "text", tokenizer=RUNS)
    return boxes.agg(
        F.sum("n_tokens").alias("runs"), F.sum(F.aggregate("contents", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))).alias("characters"), F.sum(F.size("doc_ids")).alias("parts"),
        F.bool_or((F.col("n_tokens") > capacity) | (F.size("contents") != F.col("n_tokens"))).alias("wrong"),
    )


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = _table(spark, folder, "mix_targets")
    sized, plan = mixture_plan(_table(spark, folder, "documents"), "doc_id", "text", "source", targets)
    return mixture_shares(replicated(sized, plan), targets, plan)


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of each target: its goal share, whether the share reached is within a hundredth of it, and the cap."""
    targets = _table(spark, folder, "mix_targets")
    sized, plan = mixture_plan(_table(spark, folder, "documents"), "doc_id", "text", "source", targets)
    mixture = replicated(sized, plan)
    shares = mixture_shares(mixture, targets, plan)
    most = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("k")).groupBy("source").agg(F.max("k").alias("most"))
    rows = shares.join(most, "source", "left")
    return rows.select("source", F.round("goal_share", 6).alias("goal_share"), (F.abs(F.col("share") - F.col("goal_share")) < 0.01).alias("reached"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = _limit(spark, folder, "piece")
    pieces = split_oversized(_table(spark, folder, "documents"), "doc_id", "text", limit, overlap, tokenizer=RUNS)
    return pieces.where("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = _limit(spark, folder, "piece")
    return split_oversized(_table(spark, folder, "documents"), "doc_id", "text", limit, overlap)


def p9_covered(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of each document in pieces: the characters that the pieces cover, each counted once, and the limits."""
    limit, overlap = _limit(spark, folder, "piece")
    pieces = split_oversized(_table(spark, folder, "documents"), "doc_id", "text", limit, overlap)
    before = F.lag("stop", 1, 0).over(Wd.partitionBy("doc_id").orderBy("piece"))
    rows = pieces.select("doc_id", "start", "stop", "n_tokens", "overlap_tokens", before.alias("before"))
    return rows.groupBy("doc_id").agg(
        F.sum(F.col("stop") - F.greatest("start", "before")).alias("characters"),
        F.bool_and((F.col("start") <= F.col("before")) & (F.col("n_tokens") <= limit) & (F.col("overlap_tokens") <= overlap)).alias("within_limits"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_containers, p7_filling, p7_documents, p7_contents, p8_mixture, p8_shares, p8_kept, p9_found, p9_pieces, p9_covered)
    }
