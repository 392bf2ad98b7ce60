"""Corpus statistics: frequencies, n-grams, TF-IDF, windowed co-occurrence, and the runner that stores them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from kataloom.config import Config
from kataloom.functions.tokens import all_ngrams, counted_items, folded_rows, ngram_frequencies
from kataloom.session import staged

#: Most terms whose document frequencies are sent to the tasks.
TERMS = 500_000
METRICS = ("pmi", "npmi", "raw")
METHODS = ("frequency", "ngram", "tfidf", "cooccurrence")


def corpus(cleaned: DataFrame, id_col: str = "comment_id") -> DataFrame:
    """(comment_id, tokens) of the usable rows with tokens; null and empty tokens are dropped."""
    tokens = F.filter("tokens", lambda t: t.isNotNull() & (t != ""))
    usable = cleaned.where("not is_duplicate and not is_spam")
    return usable.select(F.col(id_col).alias("comment_id"), tokens.alias("tokens")).where(F.size("tokens") > 0)


def corpus_totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("bigint").alias("tokens"))


def term_frequency(docs: DataFrame) -> DataFrame:
    """(term, count, doc_freq, relative), most frequent first. One shuffle, on the term, of counts combined per task."""
    counts = ngram_frequencies(docs, "tokens", [1])
    total = docs.agg(F.sum(F.size("tokens"))).first()[0] or 0
    return counts.withColumn("relative", F.col("count") / F.lit(total)).orderBy(F.desc("count"), "term")


def count_ngrams(docs: DataFrame, sizes: Sequence[int], min_frequency: int = 1) -> DataFrame:
    """(term, size, count, doc_freq) of the n-grams of all sizes that occur at least ``min_frequency`` times."""
    return sized(ngram_frequencies(docs, "tokens", sizes)).where(F.col("count") >= min_frequency).orderBy(F.desc("count"), "size", "term")


def sized(counts: DataFrame) -> DataFrame:
    return counts.select("term", (F.regexp_count("term", F.lit(" ")) + 1).alias("size"), "count", "doc_freq")


def tfidf(docs: DataFrame, sizes: Sequence[int] = (1,), *, sublinear_tf: bool = True, smooth_idf: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """(term, score, doc_freq, max_weight): the sum and the maximum of a term's L2-normalised weights over documents.

    The norm of a document spans the n-grams of all sizes; each row is a document. ``counts`` are the n-grams' document
    frequencies, if they are known already. Up to TERMS terms of two documents or more, their frequencies are sent to the tasks
    (every other term has one), and weights are summed where the rows are; beyond that, terms are joined by a shuffle.
    """
    n = docs.count()
    counts = staged(ngram_frequencies(docs, "tokens", sizes), "counts") if counts is None else counts
    several = counts.where("doc_freq > 1").select("term", "doc_freq")
    if several.count() > TERMS:
        return _tfidf_by_join(docs, sizes, sublinear_tf, smooth_idf, counts, n).orderBy(F.desc("score"), "term")
    table = several.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), table.column("doc_freq").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            for rows, terms, codes, times in folded_rows(batch.column(0), sizes):
                if not len(rows):
                    continue
                at = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
                df = np.where(at < 0, 1, often[at]) if len(often) else np.ones(len(terms))
                idf = np.log1p(n / df) if smooth_idf else np.log(n / df)
                w = (1 + np.log(times) if sublinear_tf else times) * idf[codes]
                row = rows - rows[0]
                norm = np.sqrt(np.bincount(row, w * w))[row]
                x = w / np.where(norm > 0, norm, 1.0)
                order = np.argsort(codes, kind="stable")
                most = np.maximum.reduceat(x[order], np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0]))
                parts = (np.bincount(codes, x, len(terms)), np.bincount(codes, minlength=len(terms)).astype(np.int64), most)
                yield pa.RecordBatch.from_arrays([terms, *map(pa.array, parts)], names=["term", "s", "d", "m"])

    parts = docs.select(F.array_compact("tokens").alias("t")).mapInArrow(run, "term string, s double, d bigint, m double")
    out = parts.groupBy("term").agg(F.sum("s").alias("score"), F.sum("d").alias("doc_freq"), F.greatest(F.max("m"), F.lit(0.0)).alias("max_weight"))
    return out.orderBy(F.desc("score"), "term")


def _tfidf_by_join(docs: DataFrame, sizes: Sequence[int], sublinear_tf: bool, smooth_idf: bool, counts: DataFrame, n: int) -> DataFrame:
    grams = counted_items(docs.withColumn("_row", F.monotonically_increasing_id()), "_row", all_ngrams(F.array_compact("tokens"), sizes))
    ratio = F.lit(float(n)) / F.col("df")
    idf = F.log1p(ratio) if smooth_idf else F.log(ratio)
    tf = 1 + F.log("tf") if sublinear_tf else F.col("tf").cast("double")
    weighted = grams.join(counts.select("term", F.col("doc_freq").alias("df")), "term").select("_row", "term", (tf * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Wd.partitionBy("_row")))
    unit = weighted.withColumn("x", F.col("w") / F.when(norm > 0, norm).otherwise(1.0))
    return unit.groupBy("term").agg(F.sum("x").alias("score"), F.count("*").alias("doc_freq"), F.greatest(F.max("x"), F.lit(0.0)).alias("max_weight"))


def window_pairs(tokens: Column, window: int) -> Column:
    """array<struct<l, r>> of the tokens within a window: each with the next window - 1 ones."""
    def shifted(k: int) -> Column:
        n = F.greatest(F.size(tokens) - k, F.lit(0))
        return F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("l"), F.slice(tokens, F.lit(k + 1), n).alias("r")).cast("array<struct<l:string,r:string>>")

    return F.flatten(F.array(*[shifted(k) for k in range(1, window)]))


def cooccurrence(docs: DataFrame, *, window: int = 5, min_pair_frequency: int = 3, metric: str = "pmi") -> DataFrame:
    """(left, right, count, pmi, npmi) of token pairs within a window, by the metric, descending.

    Marginals and total are over all pairs; the least count is applied afterwards.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    schema = "left string, right string, count bigint, pmi double, npmi double"
    if window < 2:
        return docs.sparkSession.createDataFrame([], schema)
    pairs = docs.select(F.explode(window_pairs(F.col("tokens"), window)).alias("p")).where("p.l <> p.r")
    counts = staged(pairs.groupBy(F.least("p.l", "p.r").alias("left"), F.greatest("p.l", "p.r").alias("right")).agg(F.count("*").alias("count")), "pairs")
    ends = counts.select(F.col("left").alias("token"), "count").union(counts.select("right", "count"))
    marginal = ends.groupBy("token").agg(F.sum("count").alias("m"))
    twice = 2 * (counts.agg(F.sum("count")).first()[0] or 0) or 1
    kept = counts.where(F.col("count") >= min_pair_frequency)
    out = kept.join(marginal.select(F.col("token").alias("left"), F.col("m").alias("ml")), "left").join(marginal.select(F.col("token").alias("right"), F.col("m").alias("mr")), "right")
    t = float(twice)
    p = F.col("count") / t
    pmi = F.log2(p / ((F.col("ml") / t) * (F.col("mr") / t)))
    out = out.select("left", "right", "count", pmi.alias("pmi")).withColumn("npmi", F.when(-F.log2(p) > 0, F.col("pmi") / -F.log2(p)).otherwise(1.0))
    value = F.col("count").cast("double") if metric == "raw" else F.col(metric)
    return out.orderBy(F.desc(value), F.desc("count"), F.concat_ws(" ~ ", "left", "right"))


def pair_value(metric: str) -> Column:
    return F.col("count").cast("double") if metric == "raw" else F.col(metric)


def top_per_group(df: DataFrame, n: int, order: Sequence[Column | str], group: Sequence[str] = ()) -> DataFrame:
    """The first n rows by ``order``, or of each group."""
    if not group:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_rank", F.row_number().over(Wd.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def analysis_rows(docs: DataFrame, config: Config | None = None, methods: Sequence[str] = METHODS, iteration: int = 0, created_at: str | None = None) -> DataFrame:
    """The stored form of the analyses: (iteration, method, term, value, metadata, created_at), top_n of each method.

    N-grams keep top_n of each size; TF-IDF is over the n-grams of all sizes. Metadata is JSON.
    """
    config = config or Config()
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}; of {METHODS}")
    a, top = config.section("analysis"), config.get("analysis.top_n")
    sizes = a["ngram"]["sizes"]
    json = lambda *cols: F.to_json(F.struct(*cols))
    parts = []
    if "frequency" in methods:
        rows = term_frequency(docs).limit(top)
        parts.append(rows.select(F.lit("frequency").alias("method"), "term", F.col("count").cast("double").alias("value"), json("doc_freq", "relative").alias("metadata")))
    if "ngram" in methods:
        rows = top_per_group(count_ngrams(docs, sizes, a["ngram"]["min_frequency"]), top, [F.desc("count"), F.col("term")], ["size"])
        parts.append(rows.select(F.lit("ngram").alias("method"), "term", F.col("count").cast("double").alias("value"), json("size", "doc_freq").alias("metadata")))
    if "tfidf" in methods:
        rows = tfidf(docs, sizes, **a["tfidf"]).limit(top)
        parts.append(rows.select(F.lit("tfidf").alias("method"), "term", F.col("score").alias("value"), json("doc_freq", "max_weight").alias("metadata")))
    if "cooccurrence" in methods:
        metric = a["cooccurrence"]["metric"]
        rows = cooccurrence(docs, **a["cooccurrence"]).limit(top)
        label = F.concat_ws(" ~ ", "left", "right").alias("term")
        parts.append(rows.select(F.lit("cooccurrence").alias("method"), label, pair_value(metric).alias("value"), json("left", "right", "count", "pmi", "npmi", F.lit(metric).alias("metric")).alias("metadata")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    stamp = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.select(F.lit(iteration).cast("int").alias("iteration"), "method", "term", "value", "metadata", stamp.alias("created_at"))
