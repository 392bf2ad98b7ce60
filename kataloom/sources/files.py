"""Comments from JSON, JSON-lines and CSV files, with tolerant column names."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kataloom.session import file_system

#: Accepted column names of each field, in the order in which they are looked up.
ALIASES = {
    "text": ("text", "text_raw", "comment", "komentar", "content", "body", "message"),
    "source_id": ("source_id", "id", "comment_id", "cid"),
    "created_at": ("created_at", "published_at", "date", "timestamp", "waktu"),
    "url": ("url", "link", "permalink"),
    "source": ("source", "platform", "sumber"),
    "keyword": ("keyword", "query", "kata_kunci"),
}
#: Keys under which an object may hold the list of records.
WRAPPERS = ("comments", "items", "data", "records")
FORMATS = (".json", ".jsonl", ".csv")


def check_path(path: str) -> str:
    """The format of a path by its ending, or an error."""
    kind = PurePosixPath(path).suffix.lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind or path!r}; one of {FORMATS}")
    return kind


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A top-level array of objects, or an object with the records as a list under one of WRAPPERS."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    for key in WRAPPERS:
        if key in df.columns and df.schema[key].dataType.typeName() == "array":
            inner = df.select(F.explode(key).alias("_r"))
            return inner.select("_r.*") if inner.schema["_r"].dataType.typeName() == "struct" else inner
    if not any(a in df.columns for names in ALIASES.values() for a in names):
        raise ValueError(f"no records in {path}: an array, or an object with one of {WRAPPERS}")
    return df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; blank lines are skipped, a malformed line ends the read with an error."""
    return spark.read.option("mode", "FAILFAST").option("primitivesAsString", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header, quotes doubled inside quotes, line breaks in quotes; all columns are strings."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def require_path(spark: SparkSession, path: str) -> str:
    """The format of a path, after a check that something is there, on whatever file system it names."""
    kind = check_path(path)
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    return kind


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return {".json": read_json, ".jsonl": read_jsonl, ".csv": read_csv}[check_path(path)](spark, path)


def pick(df: DataFrame, field: str) -> Column:
    """The first of a field's columns that is neither null nor empty in the row."""
    names = [a for a in ALIASES[field] if a in df.columns]
    return F.coalesce(*[F.nullif(F.col(f"`{a}`").cast("string"), F.lit("")) for a in names]) if names else F.lit(None).cast("string")


def comments_from_records(records: DataFrame, stem: str, limit: int | None = None) -> DataFrame:
    """(source, source_id, text, author_id, created_at, url, keyword) of the records with a text that isn't blank.

    Without an id a record gets '<stem>:<row>'; rows count from 0 in the order of the file, skipped ones included.
    Author names and ids of files are never read.
    """
    if not records.columns:
        return records.sparkSession.createDataFrame([], "source string, source_id string, text string, author_id string, created_at string, url string, keyword string")
    picked = records.select(*[pick(records, f).alias(f) for f in ALIASES])
    numbered = _with_row_number(picked)
    rows = numbered.where(F.length(F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " "))) > 0)
    rows = rows.select(
        F.coalesce("source", F.lit("file")).alias("source"),
        F.coalesce("source_id", F.concat(F.lit(f"{stem}:"), F.col("_row").cast("string"))).alias("source_id"),
        "text", F.lit(None).cast("string").alias("author_id"), "created_at", "url", "keyword", "_row",
    )
    if limit is not None:
        rows = rows.orderBy("_row").limit(limit)
    return rows.drop("_row")


def _with_row_number(df: DataFrame) -> DataFrame:
    """Rows numbered from 0 in the order of the partitions, without moving them to one task."""
    placed = df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, start = 0, {}
    for p in sorted(sizes):
        start[p] = before
        before += sizes[p]
    offsets = F.create_map(*[F.lit(x) for p, n in start.items() for x in (p, n)]) if start else None
    first = F.element_at(offsets, F.col("_p")) if offsets is not None else F.lit(0)
    return placed.withColumn("_row", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + first).drop("_p", "_m")


def read_comments(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return comments_from_records(read_records(spark, path), PurePosixPath(path).stem, limit)
