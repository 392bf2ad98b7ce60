"""Lexicon sources: the registry, and the loop that fetches stale entries politely, page by page."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataloom.config import Config
from kataloom.operators.lexicon import excluded_stubs, hashed_key, stale_keys
from kataloom.sources import html
from kataloom.sources.collect import CollectorError, PoliteFetcher, utc_now

#: Entries that are stored at a time.
BATCH = 20


class Fetcher(Protocol):
    def get(self, url: str) -> str: ...


@dataclass
class Fetched:
    """What a fetch did: entries listed, downloaded, skipped as fresh, of an excluded category, failed, and kept with their content."""

    listed: int = 0
    fetched: int = 0
    fresh_skipped: int = 0
    excluded: int = 0
    failed: int = 0
    stored: int = 0


@dataclass
class LexiconSource:
    """A site with a sitemap of entries and one page for each."""

    name: str
    settings: dict[str, Any]
    fetcher: Fetcher

    def listed(self, spark) -> DataFrame:
        """(place, source, entry_key, url) in the order of the sitemap, each entry once."""
        sitemaps = spark.createDataFrame([(self.fetcher.get(self.settings["sitemap"]),)], "xml string")
        urls = html.sitemap_urls(sitemaps, ordered=True).withColumn("entry_key", html.entry_key(F.col("url")))
        once = urls.groupBy("entry_key").agg(F.min(F.struct("place", "url")).alias("u"))
        return once.select("u.place", F.lit(self.name).alias("source"), "entry_key", "u.url").orderBy("place")

    def entries(self, pages: DataFrame) -> DataFrame:
        return html.extract_entries(pages, self.name)


_sources: dict[str, Callable[[str, dict[str, Any], Fetcher], LexiconSource]] = {"kbbj": LexiconSource}


def register_source(name: str, make: Callable[[str, dict[str, Any], Fetcher], LexiconSource]) -> None:
    _sources[name] = make


def lexicon_sources(config: Config) -> list[dict[str, Any]]:
    """name, status and url of every registered source."""
    rows = []
    for name in sorted(_sources):
        settings = config.section(f"lexicon.sources.{name}")
        rows.append({"source": name, "status": "enabled" if settings.get("enabled", True) else "disabled", "url": settings.get("base_url", "")})
    return rows


def lexicon_source(name: str, config: Config, fetcher: Fetcher | None = None) -> LexiconSource:
    """A registered source; refuses unknown and disabled ones."""
    key = (name or "").strip().lower()
    if key not in _sources:
        raise CollectorError(f"unknown lexicon source {name!r}; available: {', '.join(sorted(_sources))}")
    settings = config.section(f"lexicon.sources.{key}")
    if not settings.get("enabled", True):
        raise CollectorError(f"lexicon source {key!r} is disabled")
    s = config.section("lexicon")
    return _sources[key](key, settings, fetcher or PoliteFetcher(s["user_agent"], s["request_delay"], s["retry_attempts"], s["retry_backoff"], robots=s["respect_robots_txt"]))


def fetch_lexicon(store: Any, source: LexiconSource, config: Config, *, limit: int | None = None, refresh: bool = False, progress: Callable[[int, int], None] | None = None, now: Callable[[], str] = utc_now) -> Fetched:
    """Fetch the listed entries that aren't fresh into lexicon_entries, BATCH at a time; entries of excluded categories leave a hashed key only."""
    s, stats, spark = config.section("lexicon"), Fetched(), store.spark
    cutoff = (datetime.fromisoformat(now().replace("Z", "+00:00")) - timedelta(days=float(s["refetch_after_days"]))).strftime("%Y-%m-%dT%H:%M:%SZ")
    listed = source.listed(spark)
    todo = [(r["place"], r["url"]) for r in stale_keys(listed, store.read("lexicon_entries"), cutoff, refresh=refresh).select("place", "url").collect()]
    stats.listed = listed.count()
    stats.fresh_skipped = stats.listed - len(todo)
    urls = [u for _, u in sorted(todo)][: limit or int(s["max_entries_per_run"])]
    for first in range(0, len(urls), BATCH):
        pages = []
        for n, url in enumerate(urls[first : first + BATCH], first + 1):
            try:
                pages.append((url, source.fetcher.get(url)))
                stats.fetched += 1
            except (OSError, CollectorError):
                stats.failed += 1
            if progress:
                progress(n, len(urls))
        if pages:
            _keep(store, source.entries(spark.createDataFrame(pages, "url string, html string")), s["exclude_categories"] or [], now(), stats)
    return stats


def _keep(store: Any, entries: DataFrame, excluded: Sequence[str], fetched_at: str, stats: Fetched) -> None:
    table = store.read("lexicon_entries")
    rows = excluded_stubs(entries, excluded).withColumn("fetched_at", F.lit(fetched_at)).select(*table.columns)
    rows = store.rows("lexicon_entries", [r.asDict() for r in rows.collect()])  # a batch of pages at most
    out = rows.where("excluded").count()
    stats.excluded += out
    stats.stored += rows.count() - out
    if out:
        # An entry that was stored with its content before it moved to an excluded category.
        gone = rows.where("excluded").select("source", F.col("entry_key").alias("_h"))
        table = table.withColumn("_h", hashed_key(F.col("entry_key"))).join(gone, ["source", "_h"], "left_anti").select(*table.columns)
        store.overwrite("lexicon_entries", table)
    store.upsert("lexicon_entries", rows)


def as_text(stats: Fetched) -> dict[str, int]:
    return asdict(stats)
