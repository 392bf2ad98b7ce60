"""Comments from saved pages of a video platform's comment API, and video ids from addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<id:string,snippet:struct<textOriginal:string,textDisplay:string,publishedAt:string,authorChannelId:struct<value:string>>>"
PAGE = f"items array<struct<snippet:struct<videoId:string,topLevelComment:{NODE}>,replies:struct<comments:array<{NODE}>>>>"
#: Fixed value: the form of a video id.
VIDEO_ID = r"[A-Za-z0-9_-]{11}"


def video_id(value: Column) -> Column:
    """The id in a video's address (watch?v=, short links, /shorts/, /live/, /embed/, /v/) or a bare id; else null."""
    text = F.trim(value)
    host = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:(?i:www\.|m\.))?"
    tube = host + r"(?i:[^/?#]*youtube\.com)"
    end = r"(?![A-Za-z0-9_-])"
    found = F.coalesce(
        F.nullif(F.regexp_extract(text, rf"^({VIDEO_ID})$", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, host + rf"(?i:youtu\.be)/+({VIDEO_ID})(?=/|\?|#|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, tube + rf"/[^?#]*\?(?:[^#]*&)?v=({VIDEO_ID})(?=&|#|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, tube + rf"/(?:shorts|live|embed|v)/({VIDEO_ID}){end}", 1), F.lit("")),
    )
    return found


def flatten_pages(pages: DataFrame, json_col: str = "json", *, keep_author: bool = False, video_id: str | None = None, watch: str = "https://www.youtube.com/watch") -> DataFrame:
    """(source, source_id, text, author_id, created_at, url, keyword) of the threads and replies in JSON pages.

    Nodes without an id or with a blank text are dropped, the original text is preferred to the displayed one, and
    display names are never read. ``pages`` may have a column keyword; ``video_id`` is the video of threads that don't name theirs.
    """
    keyword = F.col("keyword") if "keyword" in pages.columns else F.lit(None).cast("string")
    items = pages.select(keyword.alias("keyword"), F.explode(F.from_json(json_col, PAGE)["items"]).alias("i"))
    nodes = F.concat(F.array("i.snippet.topLevelComment"), F.coalesce("i.replies.comments", F.array().cast(f"array<{NODE}>")))
    rows = items.select("keyword", F.coalesce(F.lit(video_id).cast("string"), "i.snippet.videoId").alias("video"), F.explode(nodes).alias("n"))
    rows = rows.select("keyword", "video", F.col("n.id").alias("source_id"), F.coalesce("n.snippet.textOriginal", "n.snippet.textDisplay").alias("text"), F.col("n.snippet.publishedAt").alias("created_at"), F.col("n.snippet.authorChannelId.value").alias("author"))
    rows = rows.where("source_id is not null and length(trim(text)) > 0")
    url = F.concat(F.lit(watch + "?v="), "video", F.lit("&lc="), "source_id")
    author = F.col("author") if keep_author else F.lit(None).cast("string")
    return rows.select(F.lit("youtube").alias("source"), "source_id", "text", author.alias("author_id"), "created_at", url.alias("url"), "keyword")


def cached_videos(videos: DataFrame, keyword: str, wanted: int) -> DataFrame:
    """The cached ids for a keyword, latest discovered first."""
    return videos.where(F.col("keyword") == keyword).orderBy(F.desc("discovered_at"), "video_id").select("video_id").limit(wanted)


def chunks(ids: Sequence[str], size: int = 50) -> list[list[str]]:
    """Distinct ids in their order, in lists of at most ``size``."""
    once = list(dict.fromkeys(ids))
    return [once[i : i + size] for i in range(0, len(once), size)]


def missing_videos(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Ids that the platform didn't return."""
    return ids.join(found, "video_id", "left_anti")
