"""The platform collector, the lexicon fetch, settings and the console, on recorded answers."""

import io
import json
import urllib.error
from urllib.parse import parse_qs, urlsplit

import pytest

from kataloom.cli import Commands, _parser
from kataloom.config import Config, unknown_settings
from kataloom.console import MODULES, Console
from kataloom.operators import cleaning, review
from kataloom.operators.store import Store
from kataloom.sources import lexicon as lx
from kataloom.sources.collect import CollectorError, NotConfigured, collector, run_collection
from kataloom.sources.platform import PlatformCollector

V = [f"video-id-{k:02}" for k in range(6)]


class Answer(io.BytesIO):
    def __enter__(self):
        return self


def refused(code, reason):
    body = json.dumps({"error": {"message": "no", "errors": [{"reason": reason}]}}).encode()
    return urllib.error.HTTPError("u", code, "no", None, io.BytesIO(body))


class Api:
    """Answers by resource and video; keeps the calls."""

    def __init__(self, pages, found=(), known=()):
        self.pages, self.found, self.known, self.calls = pages, list(found), set(known), []

    def __call__(self, request, timeout=None):
        parts = urlsplit(request.full_url)
        ask, what = {k: v[0] for k, v in parse_qs(parts.query).items()}, parts.path.rsplit("/", 1)[1]
        self.calls.append((what, ask))
        if what == "search":
            got = {"items": [{"id": {"videoId": v}, "snippet": {"title": f"t {v}"}} for v in self.found]}
        elif what == "videos":
            got = {"items": [{"id": v, "snippet": {"title": f"t {v}"}} for v in ask["id"].split(",") if v in self.known]}
        else:
            got = self.pages[ask["videoId"]][int(ask.get("pageToken", 0))]
            if isinstance(got, list):  # errors first
                got = got.pop(0) if len(got) > 1 else got[0]
        if isinstance(got, Exception):
            raise got
        return Answer(json.dumps(got).encode())


def page(*texts, more=None, replies=()):
    node = lambda i, t: {"id": i, "snippet": {"textOriginal": t, "authorDisplayName": "SECRET", "authorChannelId": {"value": "chan"}}}
    items = [{"snippet": {"topLevelComment": node(f"c-{t}", t)}, "replies": {"comments": [node(f"r-{r}", r) for r in replies]}} for t in texts]
    return {"items": items} | ({"nextPageToken": more} if more else {})


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.initialize()
    return s


def source(store, api, config=None, **options):
    return PlatformCollector(store, config or Config(api_key="k"), opener=api, sleep=lambda s: None, **options)


def test_selected_videos(store):
    api = Api({V[0]: [page("satu", more="1", replies=("balas",)), page("dua")]}, known={V[0]})
    run = run_collection(store, source(store, api, videos=[f"https://youtu.be/{V[0]}", V[0], V[1]]), [], limit=100)
    rows = {r["source_id"]: r for r in store.read("comments").collect()}
    assert (run["status"], run["comments_collected"], run["quota_used"]) == ("SUCCESS", 3, 3) and set(rows) == {"c-satu", "r-balas", "c-dua"}
    assert json.loads(run["params"]) == {"limit": 100, "keywords": [], "mode": "videos", "videos": V[:2], "max_pages": 10, "search_calls": 0}
    assert rows["c-satu"]["url"].endswith(f"v={V[0]}&lc=c-satu") and "SECRET" not in str(rows) and rows["c-satu"]["author_id"] is None
    video = store.read("videos").collect()
    assert [(r["video_id"], r["keyword"], r["title"], r["comments_fetched"]) for r in video] == [(V[0], None, f"t {V[0]}", 3)]
    assert all(what != "search" and "searchTerms" not in ask for what, ask in api.calls)


def test_search_uses_budget_and_cache(store):
    config = Config({"collection": {"youtube": {"max_videos_per_keyword": 2, "max_search_calls_per_run": 1}}}, api_key="k")
    api = Api({V[0]: [page("satu")], V[1]: [page("dua", "tiga")]}, found=V[:2])
    store.overwrite("keywords", store.rows("keywords", [{"id": 1, "term": "kopi", "type": "KEYWORD", "status": "ACTIVE", "iteration": 0}]))
    first = run_collection(store, source(store, api, config), ["kopi", "teh"], limit=50)
    assert first["comments_collected"] == 3 and json.loads(first["params"])["search_calls"] == 1 and first["quota_used"] == 102
    assert store.read("comment_keywords").where("keyword_id = 1").count() == 3
    api.calls.clear()
    again = run_collection(store, source(store, api, config), ["kopi"], limit=50)
    assert again["comments_collected"] == 0 and {w for w, _ in api.calls} == {"commentThreads"} and again["quota_used"] == 2
    limited = Store(store.spark, str(store.root) + "2")
    limited.initialize()
    assert run_collection(limited, source(limited, api, config), ["kopi"], limit=2)["comments_collected"] == 2


def test_skips_retries_and_quota(store):
    pages = {V[0]: [refused(403, "commentsDisabled")], V[1]: [[refused(503, "backendError"), page("satu", more="1")], refused(403, "quotaExceeded")], V[2]: [page("nie")]}
    run = run_collection(store, source(store, Api(pages, found=V[:3])), ["kopi"], limit=50)
    assert (run["status"], run["comments_collected"]) == ("PARTIAL", 1) and "quotaExceeded" in run["error"]
    failed = run_collection(store, source(store, Api({V[0]: [refused(400, "badRequest")]}, found=V[:1])), ["kopi"])
    assert failed["status"] == "FAILED" and "badRequest" in failed["error"]


def test_not_ready(store):
    with pytest.raises(NotConfigured):
        run_collection(store, source(store, Api({}), Config()), ["kopi"])
    with pytest.raises(CollectorError):
        source(store, Api({}), videos=["https://video.example/x"])
    assert collector("youtube", store=store, config=Config()).needs_keywords and store.read("collection_runs").count() == 0


BASE = "https://kbbj.web.id/kata/"


class Pages:
    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def get(self, url):
        self.asked.append(url)
        if url.endswith(".xml"):
            return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in [*self.pages, "https://kbbj.web.id/about"]) + "</urlset>"
        if self.pages[url] is None:
            raise OSError("gone")
        return self.pages[url]


def entry(term, category):
    return f'<p class="word-category">{category}</p><h1 class="word-title">{term}</h1><div class="definition">arti {term}</div>'


def test_lexicon_fetch(store):
    config = Config()
    site = Pages({BASE + "gabut": entry("Gabut", "Istilah"), BASE + "budi": entry("Budi Rahasia", "nama orang"), BASE + "hilang": None, BASE + "mager": entry("Mager", "Istilah")})
    src = lx.lexicon_source("kbbj", config, site)
    seen = []
    stats = lx.fetch_lexicon(store, src, config, progress=lambda n, k: seen.append((n, k)), now=lambda: "2024-05-01T00:00:00Z")
    assert lx.as_text(stats) == {"listed": 4, "fetched": 3, "fresh_skipped": 0, "excluded": 1, "failed": 1, "stored": 2} and seen == [(1, 4), (2, 4), (3, 4), (4, 4)]
    assert "budi" not in str(store.read("lexicon_entries").collect()).lower()
    site.asked.clear()
    again = lx.fetch_lexicon(store, src, config, now=lambda: "2024-05-02T00:00:00Z")
    assert (again.fresh_skipped, again.fetched, again.failed) == (3, 0, 1) and len(site.asked) == 2
    site.pages[BASE + "gabut"] = entry("Gabut", "Nama Orang")
    later = lx.fetch_lexicon(store, src, config, limit=1, now=lambda: "2024-07-01T00:00:00Z")
    assert (later.fetched, later.excluded) == (1, 1) and sorted(r["term"] for r in store.read("lexicon_entries").where("not excluded").collect()) == ["Mager"]
    assert lx.fetch_lexicon(store, src, config, limit=2, refresh=True, now=lambda: "2024-07-01T00:00:00Z").fetched == 2
    with pytest.raises(CollectorError):
        lx.lexicon_source("none", config)
    off = Config({"lexicon": {"sources": {"kbbj": {"enabled": False}}}})
    with pytest.raises(CollectorError):
        lx.lexicon_source("kbbj", off)
    assert [r["status"] for r in lx.lexicon_sources(off)] == ["disabled"]


def test_settings(tmp_path):
    assert Config({"spam": {"min_tokens_after_clean": 3}}).get("spam.min_tokens_after_clean") == 3
    with pytest.raises(ValueError, match="spam.min_tokens"):
        Config({"spam": {"min_tokens": 3}})
    assert unknown_settings({"lexicon": {"sources": {"own": {"x": 1}}}, "nope": 1}) == ["nope"]
    env = tmp_path / ".env"
    env.write_text("# x\nYOUTUBE_API_KEY='abc'\nKATALOOM_DATABASE=from-file\n")
    c = Config.load(env_file=str(env), environ={"KATALOOM_DATABASE": "from-env"}, overrides={"analysis.top_n": 7})
    assert (c.api_key, c.get("project.database"), c.get("analysis.top_n")) == ("abc", "from-env", 7)
    assert Config.load(env_file=str(tmp_path / "none"), environ={}).api_key is None


def test_review_details(store):
    store.overwrite("lexicon_entries", store.rows("lexicon_entries", [{"source": "k", "entry_key": "gabut", "url": "u", "term": "Gabut", "category": "Istilah", "definition": "arti", "excluded": False, "fetched_at": "t"}]))
    comments = store.rows("comments", [{"id": i, "source": "f", "source_id": str(i), "text_raw": t} for i, t in enumerate(["lagi gabut banget hari ini", "gabut banget nih kawan lama semua", "lain sekali dari yang tadi"], 1)])
    store.append("comments", comments)
    done = cleaning.clean(comments)
    cleaned = done.selectExpr("comment_id as id", "*")
    c = store.rows("keyword_candidates", [{"id": 1, "term": "gabut", "source_method": "LEXICON", "discovered_from": "u", "status": "PENDING", "iteration": 0}, {"id": 2, "term": "zzz", "source_method": "NGRAM", "discovered_from": "u", "status": "PENDING", "iteration": 0}])
    rows = {r["term"]: r for r in review.with_details(c, store.read("lexicon_entries"), cleaned, comments).collect()}
    assert rows["gabut"]["definition"] == "arti" and rows["gabut"]["in_comments"] == ["lagi gabut banget hari ini", "gabut banget nih kawan lama semua"] and rows["zzz"]["definition"] is None
    asked = {r["asked"]: r["id"] for r in review.pending_of_terms(c, store.spark.createDataFrame([("Gabut",), ("tak ada",)], "asked string")).collect()}
    assert asked == {"Gabut": 1, "tak ada": None}


def test_console(store, tmp_path):
    site = Pages({BASE + "gabut": entry("Gabut", "Istilah")})
    console = Console(Commands(store, Config(), fetcher=site), _parser())
    say = console.execute
    index = next(i for i, m in enumerate(MODULES) if m.path == "lexicon/kbbj")
    say(f"use {index}")
    assert console.module.path == "lexicon/kbbj" and console.values == {"limit": "200", "refresh": "false"}
    assert "a whole number" in say("set limit abc") and say("set LIMIT 7") == "LIMIT => 7" and console.values["limit"] == "7"
    out = say("run")
    assert "created" in out and "lexicon/kbbj completed" in out
    assert "gabut" in say("review --details") and "no pending" in say("review --approve tidak-ada")
    assert "lexicon/kbbj" in say("search dictionary") and "lexicon fetch" in say("info") and "LIMIT" in say("show options")
    say("unset limit")
    assert console.values["limit"] == "" and say("back") == "" and console.module is None
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"id": "1", "text": "ayo rek nonton bareng"}]))
    say("use collect/file")
    assert "must be set" in say("run")
    say(f"set path {path}")
    assert "SUCCESS" in say("run")
    assert "1 keywords" in say("keyword add rek")
    assert "unknown" in say("nonsense") and "error" in say("use nothing") and "nonsense" in say("history")
    assert "clean" in say("help") and say("exit") == "" and not console.running
