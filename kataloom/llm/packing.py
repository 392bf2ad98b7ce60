"""Filling containers of fixed capacity by the sum-of-squares rule.

Documents are dealt to shards by a hash; a shard is packed in one pass from the largest document to the smallest. The
packer keeps, for each gap (room left), how many open containers have it; a document goes where the sum of the
squares of these counts becomes smallest, which keeps a spread of gaps at hand and leaves little room unused.
Only ids and sizes are moved. What the shards leave in partly filled containers is at most a few containers each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from kataloom.llm.tokens import RUN, RUNS, TOKENIZER, token_ids, with_size
from kataloom.session import staged

#: Documents dealt to a shard, in the mean.
SHARD = 50_000
PLACED = "container string, doc_id bigint, part int, n_parts int, start_token bigint, n_tokens bigint, position bigint"


class SumOfSquares:
    """Open containers by gap; ``place`` returns (container, room used in it before)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.opened = capacity, 0
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # of open containers by gap; full ones are closed
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        c, n = self.capacity, self.count
        if not 0 <= size <= c:
            raise ValueError(f"size {size} in a container of {c}")
        # The change of the sum of squares if the item goes into gap g: -2n(g)+1 there, +2n(g-size)+1 at the new gap.
        gaps = np.arange(size, c)
        change = 1 - 2 * n[size:c]
        rest = 2 * n[: c - size] + 1
        if size == 0:
            rest = 1 - change  # nothing changes
        elif len(rest):
            rest[0] = 0  # a full container is closed and not counted
        change = np.where(n[size:c] > 0, change + rest, np.iinfo(np.int64).max)
        fresh = 0 if size == c else 2 * n[c - size] + 1
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= fresh and n[gaps[best]] > 0:
            gap = int(gaps[best])
            box = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, box = c, self.opened
            self.opened += 1
        if gap - size > 0:
            self.open[gap - size].append(box)
            n[gap - size] += 1
        return box, c - gap


def _pack(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, SumOfSquares(capacity)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for s, i, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "n_tokens"))):
                if s != shard:
                    shard, packer = s, SumOfSquares(capacity)
                parts = max(1, -(-n // capacity))
                for p in range(parts):
                    size = min(capacity, n - p * capacity)
                    box, used = packer.place(size)
                    for column, value in zip(out, (f"{s}-{box}", i, p, parts, p * capacity, size, used)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in PLACED.split(", ")])

    return run


def fill_containers(docs: DataFrame, id_col: str, text_col: str, capacity: int, *, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(container, doc_id, part, n_parts, start_token, n_tokens, position): where every document stands.

    A document is split only if it is larger than a container: into whole containers and a rest, its parts count
    from 0 and ``start_token`` is where a part begins in the document. ``position`` is where it begins in its
    container. Null and empty texts have size 0 and no place (they need no room). Every other row is placed once,
    also if ids or texts repeat; rows with a null id are placed with it. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = staged(with_size(docs, id_col, text_col, [], tokenizer).where("n_tokens > 0"), "sizes")
    shards = max(1, round(sized.count() / shard))
    seed = F.xxhash64("id", "n_tokens")
    dealt = sized.select("id", "n_tokens", seed.alias("h")).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "h", "id")
    return dealt.select("shard", "id", "n_tokens").mapInArrow(_pack(capacity), PLACED)


def filling(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, room left and the share of the room that is used."""
    boxes = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tokens"))
    room = F.col("containers") * capacity
    return total.select("containers", "tokens", (room - F.col("tokens")).alias("room_left"), (F.col("tokens") / room).alias("used_share"))


def container_contents(placed: DataFrame, docs: DataFrame, id_col: str, text_col: str, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_ids, starts, n_tokens, contents): the containers put together.

    ``contents`` are the container's token ids (of RUNS, its runs) in the order of their positions, ``starts`` where each of
    ``doc_ids`` begins in it. ``placed`` comes from ``fill_containers`` with the same tokenizer. Rows that repeat an id are
    told apart by their size; of rows with the same id and size any may stand for any, as they take the same room. A
    container is bounded by its capacity, so what is gathered for one is, too. An empty table gives no rows.
    """
    item = "string" if tokenizer == RUNS else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = RUN.findall if tokenizer == RUNS else token_ids(tokenizer)
        kind = pa.list_(pa.string() if tokenizer == RUNS else pa.int32())
        for batch in batches:
            tokens = [split(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in tokens], pa.int64()), pa.array(tokens, kind)], names=["id", "size", "tokens"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    texts = texts.mapInArrow(run, f"id bigint, size bigint, tokens array<{item}>").where("size > 0")
    texts = texts.withColumn("nth", F.row_number().over(Wd.partitionBy("id", "size").orderBy(F.xxhash64("tokens"))))
    sizes = placed.where("part + 1 = n_parts").groupBy("doc_id", "n_parts", (F.col("start_token") + F.col("n_tokens")).alias("size")).agg(F.count("*").alias("times"))
    # A document's parts before the last are all alike but for their number; the last one tells its size.
    rank = F.row_number().over(Wd.partitionBy("doc_id", "n_parts", "part").orderBy("container", "position"))
    spread = sizes.withColumn("upto", F.sum("times").over(Wd.partitionBy("doc_id", "n_parts").orderBy("size").rowsBetween(Wd.unboundedPreceding, 0)))
    ends = placed.where("part + 1 = n_parts").withColumn("size", F.col("start_token") + F.col("n_tokens"))
    ends = ends.withColumn("nth", F.row_number().over(Wd.partitionBy("doc_id", "size").orderBy("container", "position")))
    inner = placed.where("part + 1 < n_parts").withColumn("_k", rank)
    spread = spread.select(F.col("doc_id").alias("_id"), F.col("n_parts").alias("_n"), "size", "times", "upto")
    inner = inner.join(spread, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("n_parts") == F.col("_n"))).where((F.col("_k") <= F.col("upto")) & (F.col("_k") > F.col("upto") - F.col("times"))).withColumn("nth", F.col("_k") - F.col("upto") + F.col("times"))
    cols = ["container", "doc_id", "size", "nth", "start_token", "n_tokens", "position"]
    parts = ends.select(*cols).unionByName(inner.select(*cols))
    same = parts["doc_id"].eqNullSafe(texts["id"]) & (parts["size"] == texts["size"]) & (parts["nth"] == texts["nth"])
    pieces = parts.join(texts, same).select("container", "doc_id", "position", "n_tokens", F.slice("tokens", F.col("start_token").cast("int") + 1, F.col("n_tokens").cast("int")).alias("piece"))
    boxes = pieces.groupBy("container").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id", "piece"))).alias("p"), F.sum("n_tokens").alias("n_tokens"))
    return boxes.select("container", F.col("p.doc_id").alias("doc_ids"), F.col("p.position").alias("starts"), "n_tokens", F.flatten("p.piece").alias("contents"))
