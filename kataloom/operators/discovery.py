"""Candidate discovery: n-grams of the corpus, gated, scored by their signals and their closeness to the seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from kataloom.config import Config
from kataloom.functions import text as T
from kataloom.functions.tokens import ngram_frequencies, tokenized
from kataloom.operators.analysis import cooccurrence, pair_value, sized, tfidf
from kataloom.session import staged

SIGNALS = ("frequency", "tfidf", "cooccurrence", "ngram")
#: Signal -> source method of a candidate.
METHOD_OF = {"frequency": "FREQUENCY", "tfidf": "TFIDF", "cooccurrence": "COOCCURRENCE", "ngram": "NGRAM"}


def seed_forms(keywords: DataFrame, config: Config | None = None, unicode: bool = True) -> DataFrame:
    """(form, term, keyword_id, place): the token form of each active keyword; the first keyword of a form gives its term.

    Keywords are ordered by iteration, type and term; ``place`` is that of the first.
    """
    cleaning = (config or Config()).section("cleaning")
    active = keywords.where("status = 'ACTIVE' and term is not null").select("id", "term", F.struct("iteration", "type", "term").alias("place"))
    forms = active.withColumn("_t", T.normalized(F.col("term"), cleaning, unicode))
    forms = forms.select("id", "term", "place", F.array_join(tokenized(F.col("_t"), cleaning), " ").alias("form")).where("form <> ''")
    return forms.groupBy("form").agg(F.min_by("term", "place").alias("term"), F.min_by("id", "place").alias("keyword_id"), F.min("place").alias("place"))


def blocked_terms(keywords: DataFrame, candidates: DataFrame | None, forms: DataFrame, respect_rejections: bool = True) -> DataFrame:
    """(term): seeds' forms, all keywords, and earlier candidates (rejected ones only if they are respected)."""
    out = forms.select(F.col("form").alias("term")).union(keywords.select("term"))
    if candidates is not None:
        out = out.union((candidates if respect_rejections else candidates.where("status <> 'REJECTED'")).select("term"))
    return out.where("term is not null").distinct()


def candidate_pool(docs: DataFrame, blocked: DataFrame, sizes: list[int], *, min_doc_freq: int = 3, min_length: int = 3, counts: DataFrame | None = None) -> DataFrame:
    """(term, size, count, doc_freq) of the n-grams that may become candidates; ``counts`` are the n-grams', if they are known already."""
    grams = sized(ngram_frequencies(docs, "tokens", sizes) if counts is None else counts).where((F.col("doc_freq") >= min_doc_freq) & (F.length("term") >= min_length))
    return grams.where(~F.replace("term", F.lit(" "), F.lit("")).rlike(r"^\p{Nd}+$")).join(blocked, "term", "left_anti")


def seed_association(docs: DataFrame, forms: DataFrame, *, window: int = 5, min_pair_frequency: int = 3, metric: str = "pmi") -> DataFrame:
    """(token, value, seed_token): for every other token its best positive pair with a token of a seed.

    Ties go to the pair with the higher count, then to the smaller label.
    """
    seeds = forms.select(F.explode(F.split("form", " ")).alias("seed_token")).distinct()
    pairs = cooccurrence(docs, window=window, min_pair_frequency=min_pair_frequency, metric=metric).select("left", "right", "count", pair_value(metric).alias("value")).where("value > 0")
    both = pairs.select(F.col("left").alias("token"), F.col("right").alias("seed_token"), "count", "value", F.concat_ws(" ~ ", "left", "right").alias("label"))
    both = both.union(pairs.select(F.col("right").alias("token"), F.col("left").alias("seed_token"), "count", "value", F.concat_ws(" ~ ", "left", "right").alias("label")))
    near = both.join(seeds, "seed_token").join(seeds.withColumnRenamed("seed_token", "token"), "token", "left_anti")
    rank = F.row_number().over(Wd.partitionBy("token").orderBy(F.desc("value"), F.desc("count"), "label"))
    return near.withColumn("_r", rank).where("_r = 1").select("token", "value", "seed_token")


def score_candidates(docs: DataFrame, forms: DataFrame, blocked: DataFrame, config: Config | None = None) -> DataFrame:
    """The scored pool: term, size, type, count, doc_freq, raw_* and norm_* signals, score, method, seed_token, seed, explanation.

    Signals are scaled between the pool's minimum and maximum; a signal that is the same everywhere counts 0.
    """
    config = config or Config()
    sizes, d, c = config.get("analysis.ngram.sizes"), config.section("discovery"), config.get("analysis.cooccurrence")
    counts = staged(ngram_frequencies(docs, "tokens", sizes), "counts")
    pool = staged(candidate_pool(docs, blocked, sizes, counts=counts, min_doc_freq=d["min_doc_frequency"], min_length=d["min_term_length"]), "pool")
    scores = tfidf(docs, sizes, counts=counts, **config.get("analysis.tfidf")).select("term", F.col("score").alias("raw_tfidf"))
    near = seed_association(docs, forms, **c)
    words = pool.select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("token")).join(near, "token")
    best = words.groupBy("term").agg(F.max(F.struct("value", "seed_token")).alias("b")).select("term", F.col("b.value").alias("raw_cooccurrence"), F.col("b.seed_token").alias("seed_token"))
    labels = forms.select(F.explode(F.array_distinct(F.split("form", " "))).alias("seed_token"), "term", "place")
    labels = labels.groupBy("seed_token").agg(F.min_by("term", "place").alias("seed"))
    rows = pool.join(scores, "term", "left").join(best, "term", "left").join(labels, "seed_token", "left")
    rows = rows.select(
        "term", "size", F.when(F.col("size") > 1, "PHRASE").otherwise("KEYWORD").alias("type"), "count", "doc_freq",
        F.col("count").cast("double").alias("raw_frequency"), F.coalesce("raw_tfidf", F.lit(0.0)).alias("raw_tfidf"),
        F.coalesce("raw_cooccurrence", F.lit(0.0)).alias("raw_cooccurrence"),
        F.when(F.col("size") > 1, float(d["ngram_bonus"])).otherwise(0.0).alias("norm_ngram"), "seed_token", "seed",
    )
    rows = staged(rows, "signals")
    scaled = ("frequency", "tfidf", "cooccurrence")
    ends = rows.agg(*[f(f"raw_{s}").alias(f"{n}_{s}") for s in scaled for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for s in scaled:
        lo, hi = ends[f"lo_{s}"] or 0.0, ends[f"hi_{s}"] or 0.0
        rows = rows.withColumn(f"norm_{s}", (F.col(f"raw_{s}") - lo) / (hi - lo) if hi > lo else F.lit(0.0))
    parts = {s: F.lit(float(d["weights"][s])) * F.col(f"norm_{s}") for s in SIGNALS}
    most = F.greatest(*parts.values())
    method = F.lit(METHOD_OF["ngram"])
    for s in reversed(SIGNALS[:-1]):
        method = F.when(parts[s] == most, METHOD_OF[s]).otherwise(method)
    rows = rows.withColumn("score", parts["frequency"] + parts["tfidf"] + parts["cooccurrence"] + parts["ngram"]).withColumn("method", method)
    metric = c["metric"]
    near_text = F.when(F.col("seed").isNotNull(), F.format_string(f"; near seed '%s' ({metric} %.2f)", F.col("seed"), F.col("raw_cooccurrence"))).otherwise("")
    text = F.concat(F.lit("docs="), F.col("doc_freq").cast("string"), F.lit("; count="), F.col("count").cast("string"), F.format_string("; tfidf=%.2f", F.col("raw_tfidf")), near_text)
    return rows.withColumn("explanation", text)


def discover(docs: DataFrame, keywords: DataFrame, candidates: DataFrame | None = None, config: Config | None = None, *, limit: int | None = None, iteration: int = 0, created_at: str | None = None) -> DataFrame:
    """New PENDING candidates, best first: the rows to append to keyword_candidates (without ids).

    Terms with a score of 0 and terms that are no valid keyword are left out before the limit is applied.
    """
    config = config or Config()
    d = config.section("discovery")
    forms = staged(seed_forms(keywords, config), "seeds")
    scored = score_candidates(docs, forms, blocked_terms(keywords, candidates, forms, d["respect_previous_rejections"]), config)
    _, reason = T.valid_term(T.normal_term(F.col("term")), F.col("type"))
    best = scored.where(F.col("score") > 0).where(reason.isNull()).orderBy(F.desc("score"), F.desc("count"), "term").limit(limit or d["max_candidates"])
    stamp = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return best.select(
        "term", "type", F.col("method").alias("source_method"), F.col("doc_freq").alias("frequency"), F.round("score", 4).alias("score"),
        F.col("explanation").alias("discovered_from"), F.lit(iteration).cast("int").alias("iteration"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("reviewed_at"), stamp.alias("created_at"),
    )
