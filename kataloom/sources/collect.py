"""Collectors: the contract, the registry, polite fetching, and a collection run with its audit row."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, Protocol
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from kataloom.sources.files import read_comments, require_path

#: Answers of a server after which a request is repeated.
RETRIED = (429, 500, 502, 503, 504)


class CollectorError(Exception):
    """A source failed."""


class NotConfigured(CollectorError):
    """A source lacks a setting without which it can't begin."""


class QuotaExceeded(CollectorError):
    """The source's budget is used up; what was collected counts."""


class Collector(Protocol):
    """``batches`` hands over records as they come; each batch is stored before the next is asked for.

    Optional: needs_keywords (default True), quota_used, run_params() before and run_stats() after a run.
    """

    name: str

    def check_ready(self) -> None: ...

    def batches(self, keywords: Sequence[str], limit: int) -> Iterator[DataFrame]: ...


_collectors: dict[str, Callable[..., Collector]] = {}


def register(name: str, make: Callable[..., Collector]) -> None:
    _collectors[name] = make


def collector(name: str, **options: Any) -> Collector:
    if name not in _collectors:
        raise ValueError(f"unknown collector {name!r}; available: {', '.join(sorted(_collectors))}")
    return _collectors[name](**options)


def available() -> list[str]:
    return sorted(_collectors)


@dataclass
class FileCollector:
    """Reads one file; keywords don't filter it."""

    spark: SparkSession
    path: str
    name: str = "file"

    def check_ready(self) -> None:
        require_path(self.spark, self.path)

    needs_keywords = False

    def batches(self, keywords: Sequence[str], limit: int) -> Iterator[DataFrame]:
        yield read_comments(self.spark, self.path, limit)


register("file", FileCollector)


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_comments(existing: DataFrame, records: DataFrame, *, run_id: int, collected_at: str) -> DataFrame:
    """The rows of ``records`` to append: the first of each (source, source_id), if it isn't stored yet.

    Ids go on after the largest one; texts are never changed.
    """
    key = ["source", "source_id"]
    once = records.withColumn("_m", F.monotonically_increasing_id())
    once = once.groupBy(*key).agg(F.min(F.struct("_m", "text", "author_id", "url", "created_at", "keyword")).alias("r"))
    fresh = once.join(existing.select(*key), key, "left_anti")
    top = existing.agg(F.max("id")).first()[0] or 0
    # One id per row without gathering them: rows are numbered inside range partitions of the arrival order.
    fresh = fresh.repartitionByRange("r._m").sortWithinPartitions("r._m")
    fresh = fresh.withColumn("_n", F.monotonically_increasing_id())
    return fresh.select(
        (F.col("_n") + F.lit(top + 1)).alias("id"), "source", "source_id", F.col("r.text").alias("text_raw"), "r.author_id", "r.url", "r.created_at",
        F.lit(collected_at).alias("collected_at"), F.lit(run_id).cast("bigint").alias("run_id"),
    )


def trigger_links(records: DataFrame, comments: DataFrame, keywords: DataFrame) -> DataFrame:
    """(comment_id, keyword_id) of the records' search terms, for stored and for new comments."""
    found = records.where("keyword is not null").select("source", "source_id", F.lower("keyword").alias("term"))
    ids = comments.select(F.col("id").alias("comment_id"), "source", "source_id")
    return found.join(ids, ["source", "source_id"]).join(keywords.select(F.col("id").alias("keyword_id"), "term"), "term").select("comment_id", "keyword_id").distinct()


def run_collection(store: Any, source: Collector, keywords: Sequence[str], *, limit: int = 500, iteration: int = 0, now: Callable[[], str] = utc_now) -> dict[str, Any]:
    """One run: an audit row that begins as RUNNING and ends as SUCCESS, PARTIAL (quota, interrupt) or FAILED.

    Batches are stored one by one, so what came before a run ended early stays.
    """
    source.check_ready()
    if not keywords and getattr(source, "needs_keywords", True):
        raise CollectorError("no active keywords")
    runs = store.read("collection_runs")
    run_id = (runs.agg(F.max("id")).first()[0] or 0) + 1
    params = {"limit": limit, "keywords": list(keywords)} | (source.run_params() if hasattr(source, "run_params") else {})
    run: dict[str, Any] = {
        "id": run_id, "source": source.name, "iteration": iteration, "started_at": now(), "finished_at": None, "keyword_count": len(keywords),
        "comments_collected": 0, "status": "RUNNING", "error": None, "params": json.dumps(params, ensure_ascii=False), "quota_used": 0,
    }
    store.upsert("collection_runs", store.rows("collection_runs", [run]))
    try:
        for records in source.batches(keywords, limit):
            fresh = new_comments(store.read("comments"), records, run_id=run_id, collected_at=now())
            store.append("comments", fresh)
            links = trigger_links(records, store.read("comments"), store.read("keywords"))
            store.upsert("comment_keywords", links)
        run["status"] = "SUCCESS"
    except (QuotaExceeded, KeyboardInterrupt) as e:
        run |= {"status": "PARTIAL", "error": str(e) or type(e).__name__}
    except Exception as e:  # noqa: BLE001 - the run's row records whatever went wrong
        run |= {"status": "FAILED", "error": f"{type(e).__name__}: {e}"[:2000]}
    params |= source.run_stats() if hasattr(source, "run_stats") else {}
    run["comments_collected"] = store.read("comments").where(F.col("run_id") == run_id).count()
    run |= {"finished_at": now(), "params": json.dumps(params, ensure_ascii=False), "quota_used": getattr(source, "quota_used", 0)}
    store.upsert("collection_runs", store.rows("collection_runs", [run]))
    return run


class PoliteFetcher:
    """GET with robots.txt, a least delay between requests, and retries with growing waits."""

    def __init__(self, agent: str = "kataloom", delay: float = 2.0, retries: int = 3, backoff: float = 2.0, robots: bool = True, opener: Callable[..., Any] = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> None:
        self.agent, self.delay, self.retries, self.backoff, self.opener, self.sleep, self.obeys = agent, delay, retries, backoff, opener, sleep, robots
        self.robots: dict[str, urllib.robotparser.RobotFileParser] = {}
        self.last = 0.0

    def allowed(self, url: str) -> bool:
        parts = urlsplit(url)
        base = f"{parts.scheme}://{parts.netloc}"
        if base not in self.robots:
            rules = urllib.robotparser.RobotFileParser()
            try:
                with self.opener(f"{base}/robots.txt") as answer:
                    rules.parse(answer.read().decode("utf-8", "replace").splitlines())
            except OSError:
                rules.parse([])
            self.robots[base] = rules
        return self.robots[base].can_fetch(self.agent, url)

    def get(self, url: str) -> str:
        if self.obeys and not self.allowed(url):
            raise PermissionError(f"robots.txt forbids {url}")
        for attempt in range(self.retries + 1):
            wait = self.delay - (time.monotonic() - self.last)
            if wait > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            try:
                with self.opener(urllib.request.Request(url, headers={"User-Agent": self.agent})) as answer:
                    return answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED or attempt == self.retries:
                    raise
                after = e.headers.get("Retry-After") if e.headers else None
                self.sleep(float(after) if after and after.isdigit() else self.backoff**attempt + random.random() * 0.1)
        raise AssertionError


def newest_per_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` laid over it, the last row of each key (an upsert of whole rows)."""
    both = old.withColumn("_era", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_era", F.lit(1)))
    rank = F.row_number().over(Wd.partitionBy(*keys).orderBy(F.desc("_era")))
    return both.withColumn("_r", rank).where("_r = 1").drop("_era", "_r")
