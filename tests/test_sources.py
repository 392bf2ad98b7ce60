import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kataloom import report
from kataloom.cli import main
from kataloom.operators import store as store_module
from kataloom.operators.store import Store, merged_videos
from kataloom.schema import RAW_RECORD, TABLES, orphans, violations
from kataloom.sources import api, collect, files, html
from kataloom.streaming.incremental import cleaning_stream, exact_deduplicated


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.initialize()
    return s


RECORDS = [{"id": "a", "text": "satu", "published_at": "x"}, {"id": "b", "text": "  "}, {"comment": "tiga", "text": "", "link": "u"}]


@pytest.mark.parametrize("form", ["array", "object", "lines", "csv"])
def test_files(spark, tmp_path, form):
    if form == "array":
        path = tmp_path / "in.json"
        path.write_text(json.dumps(RECORDS))
    elif form == "object":
        path = tmp_path / "in.json"
        path.write_text(json.dumps({"total": 3, "items": RECORDS}))
    elif form == "lines":
        path = tmp_path / "in.jsonl"
        path.write_text("\n\n".join(map(json.dumps, RECORDS)))
    else:
        path = tmp_path / "in.csv"
        path.write_bytes(b'\xef\xbb\xbfid,text,comment,link,published_at\na,satu,,,x\nb,"  ",,,\n,,"ti\n""ga""",u,\n')
    rows = {r["source_id"]: r for r in files.read_comments(spark, str(path)).collect()}
    assert set(rows) == {"a", "in:2"} and rows["a"]["created_at"] == "x" and rows["in:2"]["url"] == "u" and rows["a"]["source"] == "file"
    assert rows["in:2"]["text"] == ("ti\n\"ga\"" if form == "csv" else "tiga")
    assert files.read_comments(spark, str(path), 1).count() == 1


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.check_path("x.txt")
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_comments(spark, str(tmp_path / "x.jsonl")).collect()


def test_video_ids(frame):
    ok = "abcdefghij_"
    good = [ok, f"https://www.youtube.com/watch?v={ok}", f"https://m.youtube.com/watch?a=b&v={ok}#x", f"youtu.be/{ok}?t=1", f"https://youtube.com/shorts/{ok}", f"https://www.youtube.com/live/{ok}", f"http://youtube.com/embed/{ok}", f" {ok} "]
    bad = ["", "https://video.example/watch?v=" + ok, "abc", "https://youtu.be/short", None]
    got = [r[0] for r in frame([(x,) for x in [*good, *bad]], "v string").select(api.video_id(F.col("v"))).collect()]
    assert got == [ok] * len(good) + [None] * len(bad)
    assert api.chunks(["a", "b", "a", "c"], 2) == [["a", "b"], ["c"]]


def test_pages(frame):
    node = lambda i, **s: {"id": i, "snippet": s}
    page = {"items": [{"snippet": {"videoId": "v", "topLevelComment": node("t", textOriginal="asli", textDisplay="tampil", authorDisplayName="N")}, "replies": {"comments": [node("r", textDisplay="balas"), node("e", textOriginal=" ")]}}, {"snippet": {"topLevelComment": node(None, textOriginal="x")}}]}
    rows = {r["source_id"]: r for r in api.flatten_pages(frame([(json.dumps(page),), ("broken",)], "json string")).collect()}
    assert {k: r["text"] for k, r in rows.items()} == {"t": "asli", "r": "balas"} and rows["t"]["url"].endswith("?v=v&lc=t") and rows["t"]["author_id"] is None


def test_lexicon_pages(frame):
    xml = '<urlset xmlns="http://x"><url><loc>https://k/kata/a%20b</loc></url><url><loc>https://k/about</loc></url></urlset>'
    urls = html.sitemap_urls(frame([(xml,)], "xml string"))
    assert [r[0] for r in urls.collect()] == ["https://k/kata/a%20b"]
    page = '<p class="word-category">Slang</p><h1 class="x word-title">Ga<b>but</b><br>x &amp; y</h1><div class="definition"><i>a</i>  b</div><p class="word-title">z</p>'
    got = html.extract_entries(frame([("https://k/kata/a+b%20c", page), ("https://k/kata/q", "<p>none</p>")], "url string, html string"), "k").collect()
    assert [(r["entry_key"], r["term"], r["category"], r["definition"], r["example"]) for r in got] == [("a+b c", "Gabut x & y", "Slang", "a b", None)]


def test_collection_run(store, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(RECORDS))
    source = collect.collector("file", spark=store.spark, path=str(path))
    first = collect.run_collection(store, source, ["x"])
    again = collect.run_collection(store, source, ["x"])
    assert (first["status"], first["comments_collected"], again["comments_collected"]) == ("SUCCESS", 2, 0)
    assert store.read("comments").select("id").distinct().count() == 2 and violations(store.read("comments"), "comments").count() == 0

    class Broken:
        name = "broken"
        check_ready = staticmethod(lambda: None)

        def batches(self, keywords, limit):
            raise RuntimeError("no")

    class Spent(Broken):
        def batches(self, keywords, limit):
            yield store.spark.createDataFrame([("broken", "z9", "sebelum kuota habis", None, None, None, "x")], RAW_RECORD)
            raise collect.QuotaExceeded("spent")

    spent = collect.run_collection(store, Spent(), ["x"])
    assert collect.run_collection(store, Broken(), ["x"])["status"] == "FAILED" and (spent["status"], spent["comments_collected"]) == ("PARTIAL", 1)
    assert store.read("comments").where("source_id = 'z9'").count() == 1
    with pytest.raises(collect.CollectorError):
        collect.run_collection(store, Broken(), [])
    with pytest.raises(FileNotFoundError):
        collect.collector("file", spark=store.spark, path=str(tmp_path / "none.json")).check_ready()
    assert store.read("collection_runs").count() == 4
    with pytest.raises(ValueError):
        collect.collector("none")
    with pytest.raises(ValueError):
        store.overwrite("comments", store.read("comments"))


def test_store(store):
    row = lambda **k: store.rows("analysis_results", [{"iteration": 0, "method": "tfidf", "term": "a", "value": 1.0} | k])
    store.replace_results(row())
    store.replace_results(row(term="b"))
    store.replace_results(row(method="ngram"))
    assert sorted((r["method"], r["term"]) for r in store.read("analysis_results").collect()) == [("ngram", "a"), ("tfidf", "b")]
    video = lambda **k: store.rows("videos", [{"video_id": "v", "keyword": "k", "title": "t", "comments_fetched": 3} | k])
    store.upsert("videos", video())
    store.upsert("videos", video(title="u"))
    assert store.read("videos").first()["title"] == "u"
    found = merged_videos(store.read("videos"), video(keyword="n", title="w", comments_fetched=None).union(video(video_id="x", keyword="n"))).orderBy("video_id").collect()
    assert [(r["keyword"], r["title"], r["comments_fetched"]) for r in found] == [("n", "w", 3), ("n", "t", 3)]
    chosen = merged_videos(store.read("videos"), video(keyword="n", title="w").union(video(video_id="x", keyword="n")), selected=True).orderBy("video_id").collect()
    assert [(r["keyword"], r["title"]) for r in chosen] == [("k", "w"), (None, "t")]
    assert store.drop_unused() == [] and set(TABLES) == {p.stem for p in Path(store.root).glob("*.json")} - {"schema_version"}
    links = store.rows("comment_keywords", [{"comment_id": 1, "keyword_id": 2}])
    assert orphans(links, "keyword_id", store.read("keywords")).count() == 1


def test_store_refuses_lost_updates_and_merges(store, monkeypatch):
    row = lambda k: store.rows("comment_keywords", [{"comment_id": k, "keyword_id": 1}])
    since = store.version("comment_keywords")
    store.append("comment_keywords", row(1))
    with pytest.raises(store_module.Conflict):
        store.overwrite("comment_keywords", row(9), since)
    store.overwrite("comment_keywords", row(2), store.version("comment_keywords"))
    assert store.read("comment_keywords").count() == 1 and store.drop_unused() == []
    monkeypatch.setattr(store_module, "PARTS", 2)
    for k in (3, 4, 5):
        store.append("comment_keywords", row(k))
    assert store.read("comment_keywords").count() == 4 and len(store._state("comment_keywords")[1]) <= 2
    monkeypatch.setattr(store_module, "WAIT", 0.2)
    Path(store.root, ".comment_keywords.lock").touch()
    with pytest.raises(store_module.Conflict):
        store.append("comment_keywords", row(6))
    monkeypatch.setattr(store_module, "STALE", -1.0)
    store.append("comment_keywords", row(6))
    assert store.read("comment_keywords").count() == 5


def test_stream_equals_batches(store, spark, tmp_path):
    rows = [{"id": i, "source": "f", "source_id": str(i), "text_raw": t} for i, t in enumerate(["satu komentar yang panjang", "Satu  komentar yang panjang", "komentar lain lagi di sini"], 1)]
    folder = str(tmp_path / "in")
    store.rows("comments", rows).write.parquet(folder)
    stream = spark.readStream.schema(store.read("comments").schema).parquet(folder)
    cleaning_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    got = {r["comment_id"]: r["duplicate_of"] for r in store.read("cleaned_comments").collect()}
    assert got == {1: None, 2: 1, 3: None}
    cleaning_stream(stream, store, str(tmp_path / "cp2")).awaitTermination()
    assert store.read("cleaned_comments").count() == 3
    assert exact_deduplicated(store.rows("comments", rows)).count() == 2


class _Answer:
    def __init__(self, text):
        self.text = text

    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False

    def read(self):
        return self.text.encode()


def test_polite_fetcher():
    import urllib.error

    seen = []

    def opener(request):
        url = request if isinstance(request, str) else request.full_url
        seen.append(url)
        if url.endswith("robots.txt"):
            return _Answer("User-agent: *\nDisallow: /no")
        if len(seen) < 4:
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        return _Answer("ok")

    fetch = collect.PoliteFetcher(delay=0, opener=opener, sleep=lambda s: None)
    assert fetch.get("https://a/x") == "ok" and len(seen) == 4
    with pytest.raises(PermissionError):
        fetch.get("https://a/no")


def test_report(tmp_path, frame):
    assert report.number(1234567) == "1.234.567" and report.number(0.5) == "0.5000" and report.shortened("abcdef", 4) == "abc…"
    assert report.table(["a"], [["x"]]).splitlines() == ["a", "-", "x"] and report.bar(1, 2, 10) == "#####"
    report.export_csv(str(tmp_path / "x.csv"), ["a"], [["é"]])
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfa")
    report.export_json(str(tmp_path / "x.json"), [{"a": "é"}])
    assert "é" in (tmp_path / "x.json").read_text(encoding="utf-8")


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"id": str(i), "text": f"zorbak plenger {w} tempo bagus"} for i, w in enumerate("satu dua tiga empat lima".split())]))
    run = lambda *a: main(["--store", str(tmp_path / "s"), *a])
    for command in (["init"], ["keyword", "add", "zorbak"], ["collect", "--path", str(path)], ["clean"], ["analyze", "frequency"], ["discover"], ["review", "--approve", "1"], ["iterate"], ["keyword", "match"], ["comments", "list"], ["comments", "show", "1"], ["lexicon", "categories"], ["videos"], ["status"]):
        assert run(*command) == 0
    out = capsys.readouterr().out
    assert "1 promoted" in out and "plenger" in out
