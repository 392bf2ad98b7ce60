"""Command line over a store folder: the pipeline's steps, listings and exports."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import functions as F

from kataloom import report
from kataloom.config import Config
from kataloom.operators import analysis, browse, cleaning, discovery, keywords, lexicon, matching, review, spam
from kataloom.operators.store import Store
from kataloom.session import local_session
from kataloom.sources import platform  # noqa: F401 - registers its collector
from kataloom.sources.collect import available, collector, run_collection, utc_now
from kataloom.sources.lexicon import Fetcher, as_text, fetch_lexicon, lexicon_source, lexicon_sources
from kataloom.streaming.incremental import clean_batch


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kataloom")
    p.add_argument("--store", help="folder of the tables (project.database without it)")
    p.add_argument("--config", help="YAML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "iterate", "console"):
        sub.add_parser(name)
    k = sub.add_parser("keyword")
    k.add_argument("action", choices=("match", "import", "export", "list", "add", "remove"))
    k.add_argument("value", nargs="*")
    k.add_argument("--type")
    k.add_argument("--status")
    k.add_argument("--iteration", type=int)
    k.add_argument("--hard", action="store_true")
    k.add_argument("--top", type=int, default=20)
    c = sub.add_parser("collect")
    c.add_argument("--source")
    c.add_argument("--path")
    c.add_argument("--limit", type=int)
    c.add_argument("--iteration", type=int)
    c.add_argument("--video", action="append", default=[], help="id or address of a video; repeatable")
    c.add_argument("--pages", type=int, help="pages of threads a selected video")
    c = sub.add_parser("comments")
    c.add_argument("action", choices=("list", "show"))
    c.add_argument("id", nargs="?", type=int)
    for option in ("source", "video", "keyword", "matched", "search", "export"):
        c.add_argument(f"--{option}")
    c.add_argument("--usable", action="store_true")
    c.add_argument("--limit", type=int, default=20)
    sub.add_parser("videos").add_argument("--limit", type=int, default=30)
    sub.add_parser("clean").add_argument("--reprocess", action="store_true")
    a = sub.add_parser("analyze")
    a.add_argument("method", nargs="?", choices=analysis.METHODS)
    a.add_argument("--show", type=int, default=15)
    d = sub.add_parser("discover")
    d.add_argument("--max", type=int)
    d.add_argument("--dry-run", action="store_true")
    x = sub.add_parser("lexicon")
    x.add_argument("action", choices=("sources", "fetch", "list", "categories", "propose"))
    x.add_argument("--source", default="kbbj")
    x.add_argument("--refresh", action="store_true")
    x.add_argument("--category")
    x.add_argument("--limit", type=int)
    r = sub.add_parser("review")
    r.add_argument("--method")
    r.add_argument("--status", default="PENDING")
    r.add_argument("--limit", type=int, default=20)
    r.add_argument("--approve", nargs="*", default=[], help="ids or terms")
    r.add_argument("--reject", nargs="*", default=[], help="ids or terms")
    r.add_argument("--details", action="store_true", help="with lexicon entries and example comments")
    return p


class Commands:
    """One method per command; each returns the text to print."""

    def __init__(self, store: Store, config: Config, fetcher: Fetcher | None = None, progress: Callable[[int, int], None] | None = None) -> None:
        self.store, self.config, self.fetcher, self.progress = store, config, fetcher, progress

    def _show(self, df, limit: int = 50) -> str:
        rows = report.rows_of(df, limit)
        return report.table(df.columns, [[r[c] for c in df.columns] for r in rows])

    def _rematch(self) -> int:
        found = matching.match_keywords(self.store.read("comments"), self.store.read("keywords"), self.config)
        self.store.overwrite("comment_keyword_matches", found)
        return self.store.read("comment_keyword_matches").count()

    def _iteration(self) -> int:
        return browse.current_iteration(*(self.store.read(t) for t in ("keywords", "keyword_candidates", "collection_runs")))

    def init(self, a) -> str:
        self.store.initialize()
        return f"ready: {self.store.root}"

    def status(self, a) -> str:
        names = ("keywords", "comments", "cleaned_comments", "keyword_candidates", "collection_runs", "videos", "comment_keyword_matches", "lexicon_entries")
        counters = browse.status_counters(*(self.store.read(n) for n in names))
        runs = self.store.read("collection_runs").orderBy(F.desc("id")).select("id", "source", "status", "comments_collected", "started_at")
        return report.key_values({r["metric"]: r["value"] for r in counters.collect()}, "Status") + "\n\n" + self._show(runs, 5)

    def keyword(self, a) -> str:
        table, now = self.store.read("keywords"), utc_now()
        if a.action == "match":
            n = self._rematch()
            return f"{n} links\n" + self._show(matching.most_matched(self.store.read("comment_keyword_matches"), table, a.top), a.top)
        if a.action == "list":
            return self._show(keywords.listed(table, status=a.status, kind=a.type, iteration=a.iteration), 1000)
        if a.action == "add":
            rows = [(v, a.type, i) for i, v in enumerate(a.value)]
            terms = self.store.spark.createDataFrame(rows, "term string, type string, place bigint")
            self.store.overwrite("keywords", keywords.add_keywords(table, terms, iteration=a.iteration or 0, now=now, discovered_from="manual"))
        elif a.action == "remove":
            self.store.overwrite("keywords", keywords.remove(table, [int(v) for v in a.value], now, hard=a.hard))
            if a.hard:
                for links in ("comment_keywords", "comment_keyword_matches"):
                    self.store.overwrite(links, keywords.without_links(self.store.read(links), self.store.read("keywords")))
        else:
            import yaml

            if a.action == "export":
                with open(a.value[0], "w", encoding="utf-8") as file:
                    yaml.safe_dump(keywords.buckets(table), file, allow_unicode=True, sort_keys=False)
                return f"written: {a.value[0]}"
            with open(a.value[0], encoding="utf-8") as file:
                self.store.overwrite("keywords", keywords.from_buckets(table, yaml.safe_load(file) or {}, now=now))
        return f"{self.store.read('keywords').count()} keywords"

    def collect(self, a) -> str:
        name = a.source or ("youtube" if a.video else self.config.get("collection.default_source"))
        if name not in available():
            raise SystemExit(f"unknown source {name!r}; available: {', '.join(available())}")
        options = {"spark": self.store.spark, "path": a.path} if name == "file" else {"store": self.store, "config": self.config, "videos": a.video, "max_pages": a.pages}
        terms = [] if a.video else [r["term"] for r in keywords.listed(self.store.read("keywords"), status="ACTIVE").select("term").collect()]
        limit = a.limit or self.config.get("collection.default_limit")
        run = run_collection(self.store, collector(name, **options), terms, limit=limit, iteration=self._iteration() if a.iteration is None else a.iteration)
        if run["comments_collected"]:
            self._rematch()
        return report.key_values(run, "Run")

    def comments(self, a) -> str:
        comments, cleaned = self.store.read("comments"), self.store.read("cleaned_comments")
        if a.action == "show":
            row = browse.with_state(comments.where(F.col("id") == a.id), cleaned)
            terms = browse.terms_per_comment(self.store.read("comment_keyword_matches").where(F.col("comment_id") == a.id), self.store.read("keywords"))
            detail = cleaned.select(F.col("comment_id").alias("id"), "text_clean", F.array_join("tokens", " ").alias("tokens"), "duplicate_of", "spam_reason", F.col("id").alias("_c"))
            detail = detail.groupBy("id").agg(F.max_by(F.struct("text_clean", "tokens", "duplicate_of", "spam_reason"), "_c").alias("c"))
            row = row.drop("text_clean", "tokens", "duplicate_of", "spam_reason").join(detail, "id", "left").select("*", "c.*").drop("c")
            found = report.rows_of(row.join(terms.withColumnRenamed("comment_id", "id"), "id", "left"), 1)
            return report.key_values(found[0]) if found else "no such comment"
        rows = browse.browse(
            comments, cleaned, source=a.source, video=a.video, keyword=a.keyword, links=self.store.read("comment_keywords"), matched=a.matched,
            matches=self.store.read("comment_keyword_matches"), keywords=self.store.read("keywords"), search=a.search, usable=a.usable, limit=a.limit,
        )
        if a.export:
            report.export(rows, a.export)
            return f"written: {a.export}"
        return self._show(rows, a.limit or 1000)

    def videos(self, a) -> str:
        return self._show(browse.videos_listed(self.store.read("videos"), self.store.read("comments"), a.limit), a.limit)

    def clean(self, a) -> str:
        if a.reprocess:
            self.store.overwrite("cleaned_comments", self.store.read("cleaned_comments").limit(0))
        clean_batch(self.store, self.store.read("comments"), self.config)
        cleaned = self.store.read("cleaned_comments")
        stats = cleaning.cleaning_stats(cleaned).first().asDict()
        return report.key_values(stats, "Cleaning") + "\n\n" + self._show(spam.spam_by_rule(cleaned))

    def analyze(self, a) -> str:
        docs = analysis.corpus(self.store.read("cleaned_comments"))
        methods = [a.method] if a.method else analysis.METHODS
        self.store.replace_results(analysis.analysis_rows(docs, self.config, methods, self._iteration()))
        stored = self.store.read("analysis_results").where(F.col("iteration") == self._iteration())
        return "\n\n".join(f"{m}\n" + self._show(stored.where(F.col("method") == m).orderBy(F.desc("value"), "term").select("term", "value", "metadata"), a.show) for m in methods)

    def discover(self, a) -> str:
        docs, old = analysis.corpus(self.store.read("cleaned_comments")), self.store.read("keyword_candidates")
        found = discovery.discover(docs, self.store.read("keywords"), old, self.config, limit=a.max, iteration=self._iteration())
        if not a.dry_run:
            self.store.overwrite("keyword_candidates", review.append_candidates(old, found))
        return self._show(found.select("term", "type", "source_method", "score", "discovered_from"))

    def lexicon(self, a) -> str:
        entries = self.store.read("lexicon_entries")
        if a.action == "sources":
            return report.table(["source", "status", "url"], [list(r.values()) for r in lexicon_sources(self.config)])
        done = {}
        if a.action == "fetch":
            done = as_text(fetch_lexicon(self.store, lexicon_source(a.source, self.config, self.fetcher), self.config, limit=a.limit, refresh=a.refresh, progress=self.progress))
            entries = self.store.read("lexicon_entries")
        if a.action == "categories":
            return self._show(lexicon.category_histogram(entries))
        if a.action == "list":
            return self._show(lexicon.entries_of_category(entries, a.category, a.limit or 50).select("term", "category", "definition"), a.limit or 50)
        old = self.store.read("keyword_candidates")
        respect = self.config.get("discovery.respect_previous_rejections")
        rows = lexicon.proposals(entries, self.store.read("keywords"), old, self.store.read("cleaned_comments"), respect_rejections=respect, source=a.source if a.action == "fetch" else None)
        new = lexicon.proposed_candidates(rows, iteration=self._iteration(), now=utc_now())
        self.store.overwrite("keyword_candidates", review.append_candidates(old, new))
        outcomes = self._show(rows.groupBy("outcome").count())
        return report.key_values(done, "Lexicon") + "\n\n" + outcomes if done else outcomes

    def review(self, a) -> str:
        table = self.store.read("keyword_candidates")
        events, unknown = [], []
        for s, asked in (("APPROVED", a.approve), ("REJECTED", a.reject)):
            events += [(int(x), s, utc_now()) for x in asked if x.isdigit()]
            if words := [(x,) for x in asked if not x.isdigit()]:
                for r in review.pending_of_terms(table, self.store.spark.createDataFrame(words, "asked string")).collect():
                    if r["id"] is None:
                        unknown.append(r["asked"])
                    else:
                        events.append((r["id"], s, utc_now()))
        if events:
            self.store.overwrite("keyword_candidates", review.decided(table, self.store.spark.createDataFrame(events, "id bigint, status string, reviewed_at string")))
            table = self.store.read("keyword_candidates")
        rows = review.queue(table, status=a.status, method=a.method, limit=a.limit)
        said = "".join(f"no pending candidate: {x}\n" for x in unknown)
        if a.details:
            known = (self.store.read(t) for t in ("lexicon_entries", "cleaned_comments", "comments"))
            rows = review.with_details(rows, *known).orderBy(F.desc("score"), F.desc("frequency"), "id")
            return said + "\n\n".join(report.key_values({k: "; ".join(v) if isinstance(v, list) else v for k, v in r.items() if v is not None}, r["term"]) for r in report.rows_of(rows, a.limit))
        return said + self._show(rows.select("id", "term", "source_method", "frequency", "score"), a.limit)

    def iterate(self, a) -> str:
        table = self.store.read("keywords")
        new = review.promote_approved(self.store.read("keyword_candidates"), table, iteration=self._iteration() + 1, now=utc_now())
        before = table.count()
        self.store.overwrite("keywords", new)
        self._rematch()
        return f"{self.store.read('keywords').count() - before} promoted"


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    config = Config.load(args.config)
    store = Store(local_session("*"), args.store or config.get("project.database"))
    bar = (lambda done, total: print(f"\r{report.bar(done, total, 30)} {done}/{total}", end="\n" if done == total else "", file=sys.stderr)) if sys.stderr.isatty() else None
    commands = Commands(store, config, progress=bar)
    if args.command != "console":
        print(getattr(commands, args.command)(args))
        return 0
    from kataloom.console import Console

    Console(commands, _parser()).loop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
