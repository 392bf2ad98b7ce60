"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate; a document's number of copies is the inverse of the Poisson distribution
with that mean at a point that a hash of its id and a seed gives, cut off at the source's cap. The rate is solved
from the documents themselves: the point tells for each copy from which rate on it exists, and the tokens of all
copies over a grid of rates are one grouped sum, so the rate that meets the target size best is read off exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataloom.llm.tokens import TOKENIZER, with_size
from kataloom.session import staged

#: Steps of the grid of rates (geometric, from 2**-20 to 2**10), and the largest table of targets.
STEPS, LOW, HIGH, SOURCES = 20_000, -20.0, 10.0, 1_000


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def poisson_below(k: int, rate: float) -> float:
    """The chance of at most k events at a rate."""
    return sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1)) if rate > 0 else 1.0


def _point(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("bigint"), F.col(id_col)), 11) * F.lit(2.0**-53)


def _rate(step: int) -> float:
    return 2.0 ** (LOW + (HIGH - LOW) * step / STEPS)


def _first_steps(caps: int, points: int = 4096) -> list[list[int]]:
    """For copy k (from 1) and each of ``points`` intervals of the unit: the grid step from which the copy exists.

    Copy k of a document at point u exists at a rate r if P(at most k-1 events) <= u.
    """
    out = []
    for k in range(1, caps + 1):
        steps, step = [], STEPS
        for i in range(points):
            u = (i + 0.5) / points
            while step > 0 and poisson_below(k - 1, _rate(step - 1)) <= u:
                step -= 1
            steps.append(step)
        out.append(steps)
    return out


def mixture_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, *, seed: int = 0, total: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row per target with its rate as the number of copies' cut-offs).

    ``targets`` has the columns source, target_share and max_repeats and is small (checked). The total size is
    ``total``, or the largest at which every target that has documents can have its share within its cap.
    """
    wanted = targets.select(source_key(F.col("source")).alias("key"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("target_share > 0 and max_repeats > 0").limit(SOURCES + 1).collect()
    if len(wanted) > SOURCES:
        raise ValueError(f"more than {SOURCES} targets")
    sized = with_size(docs.withColumn("_key", source_key(F.col(source_col))), id_col, text_col, ["_key"], tokenizer)
    sized = staged(sized.where("id is not null and _key is not null and n_tokens > 0").withColumnRenamed("_key", "key").withColumn("u", _point("id", seed)), "sizes")
    sizes = {r["key"]: r["n"] for r in sized.join(_keys(sized, wanted), "key").groupBy("key").agg(F.sum("n_tokens").alias("n")).collect()}
    present = [w for w in wanted if sizes.get(w["key"])]
    share = sum(w["target_share"] for w in present)
    size = total if total is not None else min((int(sizes[w["key"]] * w["max_repeats"] / (w["target_share"] / share)) for w in present), default=0)

    points = 4096
    top = max((w["max_repeats"] for w in present), default=1)
    steps = _first_steps(top, points)
    spark = docs.sparkSession
    cells = sized.join(_keys(sized, present), "key").groupBy("key", F.floor(F.col("u") * points).cast("int").alias("cell")).agg(F.sum("n_tokens").alias("n"))
    by_key: dict[str, list[tuple[int, int]]] = {}
    for r in cells.collect():
        by_key.setdefault(r["key"], []).append((r["cell"], r["n"]))
    plan = []
    for w in wanted:
        cap, goal = w["max_repeats"], 0.0 if w["key"] not in sizes else size * w["target_share"] / share
        cut = [points] * cap
        # Walk up the rates; a copy's cells come in with falling cell number, so the state is one cut-off per copy.
        entries = sorted(((steps[k - 1][c], k, -c, n) for k in range(1, cap + 1) for c, n in by_key.get(w["key"], [])))
        got, best = 0, (abs(goal), 0)
        for at, (_, k, c, n) in enumerate(entries, 1):
            got += n
            best = min(best, (abs(goal - got), at))
        for _, k, c, _ in entries[: best[1]]:
            cut[k - 1] = min(cut[k - 1], -c)
        rate = _rate(entries[best[1] - 1][0]) if best[1] else 0.0
        plan.append((w["key"], w["target_share"], cap, int(goal), rate, [x / points for x in cut]))
    schema = "key string, target_share double, max_repeats int, goal_tokens bigint, rate double, cut array<double>"
    return sized, spark.createDataFrame(plan, schema)


def _keys(sized: DataFrame, wanted: list) -> DataFrame:
    """The targets' keys, at most SOURCES rows."""
    return sized.sparkSession.createDataFrame([(w["key"],) for w in wanted], "key string").distinct()


def copies(point: Column, cut: Column) -> Column:
    """The number of copies of a document: one for each cut-off at or below its point."""
    return F.size(F.filter(cut, lambda c: point >= c))


def mix_sources(docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, *, seed: int = 0, total: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(position_key, doc_id, source, copy, n_tokens): the mixture, globally shuffled.

    Each source holds its target share of the total tokens as nearly as its documents allow, and no document
    stands in it more than max_repeats times. Sources are compared without case and outer blanks. Documents with
    a null id, source or text, of size 0, or of a source without a target are not used; a target without documents
    gets nothing and its share is spread over the others in proportion. Rows that repeat an id get as many copies
    as each other. Ascending ``position_key`` is the global random order; it depends on the seed and the ids only.
    """
    return replicated(*mixture_plan(docs, id_col, text_col, source_col, targets, seed=seed, total=total, tokenizer=tokenizer), seed=seed)


def replicated(sized: DataFrame, plan: DataFrame, *, seed: int = 0) -> DataFrame:
    """The mixture of a plan, see ``mix_sources``."""
    used = sized.join(F.broadcast(plan.select("key", "cut")), "key").select("id", "key", "n_tokens", copies(F.col("u"), F.col("cut")).alias("k")).where("k > 0")
    rows = used.select(F.col("id").alias("doc_id"), F.col("key").alias("source"), F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"), "n_tokens")
    rows = rows.select(F.xxhash64(F.lit(seed + 1).cast("bigint"), "doc_id", "copy").alias("position_key"), "doc_id", "source", "copy", "n_tokens")
    return rows.repartitionByRange("position_key").sortWithinPartitions("position_key")


def with_texts(mixture: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The mixture with the column text, in its global order. Ids are expected to be unique: of documents that repeat one, one text is taken."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''").dropDuplicates(["doc_id"])
    return mixture.join(texts, "doc_id").select(*mixture.columns, "text").repartitionByRange("position_key").sortWithinPartitions("position_key")


def mixture_shares(mixture: DataFrame, targets: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(source, target_share, goal_share, max_repeats, documents, rows, tokens, share) of every target: what a mixture reached.

    ``goal_share`` is the target share after that of targets without documents was spread over the others; it is taken from
    ``plan``, and without one, targets without a row count as having no documents.
    """
    got = staged(mixture.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")), "shares")
    total = got.agg(F.sum("tokens")).first()[0] or 0
    want = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    with_docs = got.select("source") if plan is None else plan.where("goal_tokens > 0").select(F.col("key").alias("source"))
    rows = want.join(got, "source", "left").join(with_docs.distinct().withColumn("_goal", F.lit(1)), "source", "left")
    goals = rows.where("_goal = 1").agg(F.sum("target_share")).first()[0] or 1.0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    share = F.coalesce(F.col("tokens") / F.nullif(F.lit(total), F.lit(0)), F.lit(0.0)).alias("share")
    goal = F.when(F.col("_goal") == 1, F.col("target_share") / F.lit(goals)).otherwise(0.0).alias("goal_share")
    return rows.select("source", "target_share", goal, "max_repeats", zero("documents"), zero("rows"), zero("tokens"), share)
