"""Exact and near duplicates of cleaned comments: SimHash, block tables, and the greedy resolution in id order.

Near duplicates are greedy: in the order of ids a comment is a duplicate if it is near to an earlier comment that
is itself no duplicate. That is the lexicographically first maximal independent set of the graph of near pairs.
Comments with one fingerprint share their neighbours, so only the first of each fingerprint can be an original; the
graph is therefore built over distinct fingerprints, which keeps masses of copies out of the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataloom.operators.components import connected_components
from kataloom.session import staged

#: Fingerprints expected under one key of a block table; those above which a key is split further; links of a component that one task resolves.
BUCKET, HOT_BUCKET, LOCAL = 64, 4096, 1_000_000


def _shingles(tokens: list[str], size: int) -> list[str]:
    """As functions.tokens.shingles, for lists: in an expression, Spark would evaluate the tokens again for each one."""
    if len(tokens) < size:
        return [" ".join(tokens)] if tokens else []
    return [" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)]


def _votes(parts: list[list[str]], bits: int) -> np.ndarray:
    """Fingerprints of lists of shingles; an empty list gives 0."""
    width = max(1, bits // 8)
    flat = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=width).digest() for ps in parts for p in ps)
    out = np.zeros(len(parts), dtype=np.uint64)
    sizes = np.array([len(ps) for ps in parts])
    full = np.flatnonzero(sizes)
    if len(full):
        ones = np.unpackbits(np.frombuffer(flat, dtype=np.uint8).reshape(-1, width), axis=1).astype(np.int32)
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        yes = np.add.reduceat(ones, starts, axis=0) * 2 > sizes[full][:, None]
        weight = np.uint64(1) << np.arange(width * 8 - 1, -1, -1, dtype=np.uint64)
        out[full] = (yes * weight).sum(axis=1, dtype=np.uint64)
    return out


def simhash(tokens: Column, bits: int = 64, shingle_size: int = 3) -> Column:
    """The SimHash of a token array as a (two's complement) bigint; 0 for an empty array, null for null."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        lists = column.to_pylist()
        parts = [_shingles(x or [], shingle_size) for x in lists]
        return pa.array(_votes(parts, bits).view(np.int64), pa.int64(), mask=np.array([x is None for x in lists], dtype=bool))

    return run(tokens)


def simhash_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def from_hex(value: Column) -> Column:
    return F.conv(value, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def first_shared_band(a: Column, b: Column, bits: int, bands: int) -> Column:
    width = bits // bands
    out = F.lit(None).cast("int")
    for k in reversed(range(bands)):
        mask = F.lit((1 << width) - 1)
        out = F.when(F.shiftrightunsigned(a, k * width).bitwiseAND(mask) == F.shiftrightunsigned(b, k * width).bitwiseAND(mask), F.lit(k)).otherwise(out)
    return out


def _tables(n: int, bits: int, threshold: int) -> list[list[tuple[int, int]]]:
    """Block tables for n fingerprints: each is a list of (shift, width).

    With threshold + k blocks, two fingerprints within the threshold agree on some k of them. Larger k means longer
    keys and so smaller buckets, for more tables; k grows until a bucket is expected to hold BUCKET fingerprints.
    """
    for k in range(1, 5):
        m = threshold + k
        edges = [round(i * bits / m) for i in range(m + 1)]
        blocks = [(edges[i], edges[i + 1] - edges[i]) for i in range(m)]
        if n / 2 ** min(sum(w for _, w in c) for c in combinations(blocks, k)) <= BUCKET or k == 4:
            return [list(c) for c in combinations(blocks, k)]
    raise AssertionError


def _key(blocks: list[tuple[int, int]]) -> Column:
    """The bits of the fingerprint v in the blocks, as one number."""
    out = F.lit(0).cast("bigint")
    for shift, width in blocks:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(F.col("v"), shift).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def _split(table: list[tuple[int, int]], bits: int, threshold: int) -> list[list[tuple[int, int]]]:
    """Block tables over the bits that ``table`` leaves: fingerprints that agree on the table agree on two of threshold + 2 parts of the rest."""
    taken = {b for shift, width in table for b in range(shift, shift + width)}
    rest = [b for b in range(bits) if b not in taken]
    m = threshold + 2
    parts = [[(b, 1) for b in rest[round(i * len(rest) / m) : round((i + 1) * len(rest) / m)]] for i in range(m)]
    return [a + b for a, b in combinations(parts, 2)]


def near_pairs(values: DataFrame, bits: int = 64, threshold: int = 3) -> DataFrame:
    """(a, b, va, vb), a < b: all pairs of rows (id, v) with distinct fingerprints within the threshold.

    An equi-join on block keys with the exact distance as a residual; every pair within the threshold meets. Keys that more
    than HOT_BUCKET fingerprints share are split by blocks of the bits that they leave, in which near fingerprints meet again.
    """
    tables = _tables(values.count(), bits, threshold)
    keyed = values.select("id", "v", F.posexplode(F.array(*[_key(t) for t in tables])).alias("band", "key"))
    hot = keyed.groupBy("band", "key").count().where(F.col("count") > HOT_BUCKET).select("band", "key")
    cell = ["band", "key", "part"]
    if hot.isEmpty():
        cells = keyed.withColumn("part", F.lit(0).cast("bigint"))
    else:
        hot = staged(hot, "hot")
        finer = F.coalesce(*[F.when(F.col("band") == i, F.array(*[_key(x) for x in _split(t, bits, threshold)])) for i, t in enumerate(tables)])
        split = keyed.join(hot, ["band", "key"]).select("id", "v", "band", "key", F.posexplode(finer).alias("sub", "low"))
        split = split.select("id", "v", "band", "key", F.xxhash64("sub", "low").alias("part"))
        cells = keyed.join(hot, ["band", "key"], "left_anti").withColumn("part", F.lit(0).cast("bigint")).unionByName(split)
    left = cells.select(*cell, F.col("id").alias("a"), F.col("v").alias("va"))
    right = cells.select(*cell, F.col("id").alias("b"), F.col("v").alias("vb"))
    near = left.join(right, cell).where((F.col("a") < F.col("b")) & (hamming(F.col("va"), F.col("vb")) <= threshold))
    return near.select("a", "b", "va", "vb").distinct()


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy choice in a partition sorted by (root, b), where every node comes as b: it is out if an earlier neighbour a is in."""
    root, node, out, kept = None, None, False, set()
    for batch in batches:
        ids, chosen = [], []
        for r, a, b in zip(*(batch.column(c).to_pylist() for c in ("root", "a", "b"))):
            if (r, b) != (root, node):
                if node is not None:
                    ids.append(node)
                    chosen.append(not out)
                    if not out:
                        kept.add(node)
                if r != root:
                    kept = set()
                root, node, out = r, b, False
            out = out or a in kept
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chosen, pa.bool_())], names=["id", "original"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([not out], pa.bool_())], names=["id", "original"])


def first_independent_set(edges: DataFrame) -> DataFrame:
    """(id, original) for the nodes of ``edges`` (a < b): the greedy choice in id order.

    Up to LOCAL links are resolved in one pass over them in the order of nodes, by one task, so a long chain costs nothing more.
    Of more links, that is done for each component of at most LOCAL. Larger ones are resolved by rounds over all their nodes, as many as it takes.
    """
    edges = staged(edges.select("a", "b"), "near")
    late = edges.select("b").distinct()
    lone = edges.select(F.col("a").alias("b")).distinct().join(late, "b", "left_anti")
    if edges.count() <= LOCAL:
        zero, none = F.lit(0).cast("bigint").alias("root"), F.lit(None).cast("bigint").alias("a")
        rows = edges.select(zero, "a", "b").union(lone.select(zero, none, "b"))
        return rows.coalesce(1).sortWithinPartitions("b").mapInArrow(_in_order, "id bigint, original boolean")
    roots = connected_components(edges).select(F.col("node").alias("b"), "root")
    rooted = edges.join(roots, "b")
    sizes = staged(rooted.groupBy("root").count().where(F.col("count") > LOCAL).select("root"), "big")
    # A node without an earlier neighbour is in: it comes as a row without a.
    lone = lone.join(roots, "b").select("root", F.lit(None).cast("bigint").alias("a"), "b")
    rows = rooted.select("root", "a", "b").union(lone)
    if sizes.isEmpty():
        return rows.repartition("root").sortWithinPartitions("root", "b").mapInArrow(_in_order, "id bigint, original boolean")
    few = rows.join(sizes, "root", "left_anti").repartition("root").sortWithinPartitions("root", "b").mapInArrow(_in_order, "id bigint, original boolean")
    return few.union(_by_rounds(rooted.join(sizes, "root").select("a", "b")))


def _by_rounds(edges: DataFrame) -> DataFrame:
    """The greedy choice by rounds: a node is out as soon as an earlier neighbour is in, and in as soon as all of them are out."""
    edges = staged(edges, "near")
    state = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    state = staged(state.join(edges.select(F.col("b").alias("id")).distinct().withColumn("late", F.lit(True)), "id", "left").select("id", F.when(F.col("late").isNull(), F.lit(True)).alias("original")), "state")
    while not state.where("original is null").isEmpty():
        seen = edges.join(state.withColumnRenamed("id", "a"), "a").groupBy("b").agg(
            F.coalesce(F.bool_or(F.col("original")), F.lit(False)).alias("hit"), F.bool_and(F.coalesce(~F.col("original"), F.lit(False))).alias("free")
        )
        now = state.join(seen.withColumnRenamed("b", "id"), "id", "left")
        state = staged(now.select("id", F.coalesce("original", F.when(F.col("hit"), F.lit(False)).when(F.col("free"), F.lit(True))).alias("original")), "state", [state])
    return state


def mark_duplicates(rows: DataFrame, prior: DataFrame | None = None, *, bits: int = 64, threshold: int = 3, bands: int = 4, enabled: bool = True, near: bool = True) -> DataFrame:
    """``rows`` (with id, norm_hash, fingerprint v, has_tokens) plus is_duplicate, duplicate_of and duplicate_kind.

    An exact duplicate points to the first row with its norm_hash, also if that one is a near duplicate itself. The
    first row of each hash, if it has tokens, is a near duplicate if an earlier original is within ``threshold``
    bits; it points to the original with the lowest first shared band, then the smallest id. ``prior`` holds the
    originals (id, norm_hash, v) of earlier runs: they come before all rows and stay originals. Without ``near`` there are only exact ones.
    """
    if threshold >= bands:
        bands = threshold + 1
    if not enabled:
        return rows.withColumn("is_duplicate", F.lit(False)).withColumn("duplicate_of", F.lit(None).cast("bigint")).withColumn("duplicate_kind", F.lit(None).cast("string"))
    base = rows.select("id", "norm_hash", "v", "has_tokens", F.lit(1).alias("era"))
    if prior is not None:
        base = base.union(prior.select("id", "norm_hash", "v", (F.col("v") != 0).alias("has_tokens"), F.lit(0).alias("era")))
    base = staged(base, "fingerprints")
    heads = base.where("norm_hash is not null").groupBy("norm_hash").agg(F.min(F.struct("era", "id")).alias("h")).select("norm_hash", F.col("h.id").alias("head"), F.col("h.era").alias("head_era"))
    exact = base.join(heads, "norm_hash", "left").withColumn("exact_of", F.when((F.col("head") != F.col("id")) | (F.col("head_era") != F.col("era")), F.col("head")))
    exact = staged(exact.select("id", "era", "v", "has_tokens", "exact_of"), "exact")
    if not near:
        done = exact.where("era = 1").select("id", F.col("exact_of").alias("duplicate_of"), F.when(F.col("exact_of").isNotNull(), "exact").alias("duplicate_kind"))
        return rows.join(done, "id").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
    # Order over eras: earlier runs first. One number keeps the join keys narrow.
    order = F.col("id") + F.when(F.col("era") == 1, F.lit(1 << 62)).otherwise(F.lit(0))
    probes = exact.where("exact_of is null and has_tokens and v <> 0").select(order.alias("id"), "v")
    first = staged(probes.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "values")
    pairs = staged(near_pairs(first, bits, threshold), "pairs")
    # Originals of earlier runs never change, so links between two of them don't matter.
    links = pairs.where(F.col("b") >= (1 << 62))
    chosen = first_independent_set(links)
    out = first.join(chosen, "id", "left").select("id", "v", F.coalesce("original", F.lit(True)).alias("original"))
    out = staged(out, "chosen")
    # Candidates of a probe: the original with its own fingerprint, or originals of near fingerprints, if earlier.
    near = pairs.select(F.col("va").alias("v"), F.col("b").alias("other"), F.col("vb").alias("ov")).union(pairs.select(F.col("vb").alias("v"), F.col("a").alias("other"), F.col("va").alias("ov")))
    near = near.union(first.select("v", F.col("id").alias("other"), F.col("v").alias("ov")))
    near = near.join(out.where("original").select(F.col("id").alias("other")), "other")
    hits = probes.join(near, "v").where("other < id").withColumn("band", first_shared_band(F.col("v"), F.col("ov"), bits, bands))
    best = hits.groupBy("id").agg(F.min_by("other", F.struct("band", "other")).alias("near_of"))
    best = best.where(F.col("id") >= (1 << 62)).select((F.col("id") - (1 << 62)).alias("id"), F.when(F.col("near_of") >= (1 << 62), F.col("near_of") - (1 << 62)).otherwise(F.col("near_of")).alias("near_of"))
    done = exact.where("era = 1").select("id", "exact_of").join(best, "id", "left")
    done = done.select("id", F.coalesce("exact_of", "near_of").alias("duplicate_of"), F.when(F.col("exact_of").isNotNull(), "exact").when(F.col("near_of").isNotNull(), "near").alias("duplicate_kind"))
    return rows.join(done, "id").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
