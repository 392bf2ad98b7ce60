"""Items that appear together: a blocked Gram matrix over record/item incidences.

The incidence matrix X (records x items, binary, sparse) is never built as a whole. Records are cut into blocks of
``RECORDS``, items into blocks of ``BLOCK``; for each record block the products X_I' X_J of its item blocks are added to the
tile (I, J). A record block is multiplied as dense 0/1 matrices or as sparse ones, by the cost of either: sparse, the
products of single records are listed by shifting the sorted block against itself, and counted. Tiles are held up to a
fixed memory bound and otherwise emitted as partial sums, which one grouped sum over the shuffle completes. The diagonal of
the matrix gives the marginals.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataloom.session import staged

#: Items per item block, dense tiles held by a task, incidences of a record block.
BLOCK, TILES, RECORD_BLOCK = 512, 32, 200_000
#: Records of a dense block; nanoseconds a pair of a sparse product, a cell of a dense one, and a dense product besides.
RECORDS, PAIR_NS, CELL_NS, PRODUCT_NS = 2048, 20.0, 1 / 15, 1_500_000.0
#: Records with more items than this are always multiplied as dense matrices.
LONG = 256
#: Largest dictionary that is sent to the executors as a whole; beyond it items are numbered by a join.
DICTIONARY = 200_000

GRAM = "i bigint, j bigint, n bigint"


class _Tiles:
    """Bounded store of partial products."""

    def __init__(self) -> None:
        self.tiles: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Add item pairs (left <= right)."""
        bi, bj = left // BLOCK, right // BLOCK
        order = np.lexsort((bj, bi)) if (bi[0], bj[0]) != (bi[-1], bj[-1]) or np.any(bi != bi[0]) or np.any(bj != bj[0]) else None
        if order is not None:
            left, right, bi, bj = left[order], right[order], bi[order], bj[order]
        cuts = np.flatnonzero((bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(bi)]):
            key = (int(bi[s]), int(bj[s]))
            code = (left[s:e] - key[0] * BLOCK) * BLOCK + (right[s:e] - key[1] * BLOCK)
            if key not in self.tiles and e - s < BLOCK:
                got, n = np.unique(code, return_counts=True)
                self._emit(key, got, n)
                continue
            if key not in self.tiles:
                if len(self.tiles) >= TILES:
                    self._drop(next(iter(self.tiles)))
                self.tiles[key] = np.zeros(BLOCK * BLOCK, dtype=np.int64)
            self.tiles.move_to_end(key)
            self.tiles[key] += np.bincount(code, minlength=BLOCK * BLOCK)

    def multiply(self, rec: np.ndarray, item: np.ndarray, count: int) -> None:
        """Add the products of the item blocks of ``count`` records (numbered from 0), without the diagonal."""
        block, column = item // BLOCK, item % BLOCK
        at = {int(b): np.flatnonzero(block == b) for b in np.unique(block)}

        def dense(b: int) -> np.ndarray:
            x = np.zeros((count, BLOCK), dtype=np.float32)  # counts of a record block are exact in 32 bits
            x[rec[at[b]], column[at[b]]] = 1
            return x

        for i in at:
            left = dense(i)
            for j in (b for b in at if b >= i):
                product = left.T @ (left if j == i else dense(j))
                self._put((i, j), (np.triu(product, 1) if i == j else product).astype(np.int64).ravel())

    def _put(self, key: tuple[int, int], tile: np.ndarray) -> None:
        code = np.flatnonzero(tile)
        if key not in self.tiles and len(code) < BLOCK:
            if len(code):
                self._emit(key, code, tile[code])
            return
        if key not in self.tiles and len(self.tiles) >= TILES:
            self._drop(next(iter(self.tiles)))
        self.tiles[key] = self.tiles[key] + tile if key in self.tiles else tile
        self.tiles.move_to_end(key)

    def _emit(self, key: tuple[int, int], code: np.ndarray, n: np.ndarray) -> None:
        self.ready.append((code // BLOCK + key[0] * BLOCK, code % BLOCK + key[1] * BLOCK, n))

    def _drop(self, key: tuple[int, int]) -> None:
        tile = self.tiles.pop(key)
        code = np.flatnonzero(tile)
        self._emit(key, code, tile[code])

    def take(self, everything: bool) -> Iterator[pa.RecordBatch]:
        if everything:
            for key in list(self.tiles):
                self._drop(key)
        ready, self.ready = self.ready, []
        for i, j, n in ready:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, j, n)], names=["i", "j", "n"])


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial Gram matrix of a partition sorted by record; several rows of one record count as one."""
    store = _Tiles()

    def multiply(rec: np.ndarray, item: np.ndarray) -> None:
        if not len(rec):
            return
        order = np.lexsort((item, rec))
        rec, item = rec[order], item[order]
        keep = np.r_[True, (rec[1:] != rec[:-1]) | (item[1:] != item[:-1])]
        rec, item = rec[keep], item[keep]
        store.add(item, item)
        starts = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
        sizes = np.diff(np.r_[starts, len(rec)])
        sparse = np.ones(len(rec), dtype=bool)
        for first in range(0, len(starts), RECORDS):
            n = sizes[first : first + RECORDS]
            lo, hi = starts[first], starts[first] + n.sum()
            blocks = len(np.unique(item[lo:hi] // BLOCK))
            products = blocks * (blocks + 1) / 2
            if (n > LONG).any() or (n * (n - 1) / 2).sum() * PAIR_NS > products * (len(n) * BLOCK * BLOCK * CELL_NS + PRODUCT_NS):
                store.multiply(np.repeat(np.arange(len(n)), n), item[lo:hi], len(n))
                sparse[lo:hi] = False
        rec, item = rec[sparse], item[sparse]
        at, d, lefts, rights, held = np.arange(len(rec)), 1, [], [], 0
        while True:
            at = at[at + d < len(rec)]
            at = at[rec[at] == rec[at + d]]
            if not len(at):
                break
            lefts.append(item[at])
            rights.append(item[at + d])
            held += len(at)
            if held > 2_000_000:
                store.add(np.concatenate(lefts), np.concatenate(rights))
                lefts, rights, held = [], [], 0
            d += 1
        if held:
            store.add(np.concatenate(lefts), np.concatenate(rights))

    rest_rec, rest_item = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        items = batch.column("items")
        lengths = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        rec = np.r_[rest_rec, np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), lengths)]
        item = np.r_[rest_item, items.flatten().to_numpy(zero_copy_only=False)]
        last = rec == rec[-1] if len(rec) else np.empty(0, bool)
        rest_rec, rest_item = rec[last], item[last]
        if len(rest_rec) > RECORD_BLOCK:  # one record over many rows: keep its distinct items only
            rest_item = np.unique(rest_item)
            rest_rec = np.full(len(rest_item), rec[-1])
        multiply(rec[~last], item[~last])
        yield from store.take(False)
    multiply(rest_rec, rest_item)
    yield from store.take(True)


def _numbered(rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as (rid, items array<bigint>) and the dictionary (item, token); items ascend with the token."""
    spark = rows.sparkSession
    found = [r[0] for r in kept.select("token").limit(DICTIONARY + 1).collect()]
    if len(found) <= DICTIONARY:
        words = sorted(found)
        shared = spark.sparkContext.broadcast(words)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(shared.value, pa.string())
            for batch in batches:
                tokens = batch.column("tokens")
                lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
                index = pc.index_in(tokens.flatten(), value_set=known)
                hit = index.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lengths)), lengths)[hit]
                ends = np.cumsum(np.bincount(row, minlength=len(lengths)))
                items = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), index.drop_null().cast(pa.int64()))
                out = pa.RecordBatch.from_arrays([batch.column("rid"), items], names=["rid", "items"])
                yield out.filter(pa.array(np.diff(np.r_[0, ends]) > 0))

        dictionary = spark.createDataFrame(list(enumerate(words)), "item bigint, token string")
        return rows.mapInArrow(encode, "rid bigint, items array<bigint>"), dictionary
    # Numbers from the partition and the place in it: blocks stay dense inside a partition of the sorted dictionary.
    dictionary = staged(kept.select("token").orderBy("token").select(F.monotonically_increasing_id().alias("item"), "token"), "items")
    flat = rows.select("rid", F.explode("tokens").alias("token")).join(dictionary, "token")
    return flat.select("rid", F.array("item").alias("items")), dictionary


def cooccurring_items(
    records: DataFrame,
    id_col: str,
    tokens_col: str,
    *,
    min_count: int = 1,
    share_of_records: int | None = None,
    min_ratio: int = 0,
) -> DataFrame:
    """Pairs of items that stand in the same record, with counts and PMI.

    Returns (token_a, token_b, n_ab, n_a, n_b, n_records, pmi), token_a < token_b by code point, for pairs with
    n_ab >= min_count, share_of_records * n_ab >= n_records and n_records * n_ab >= min_ratio * n_a * n_b;
    pmi = log2(n_records * n_ab / (n_a * n_b)).

    A record is all rows of one id: each item counts once in it however often and in however many rows it stands.
    Null ids, null or empty token arrays and null or empty tokens don't exist; a record without any token is not
    counted. An empty table gives no pairs. Other columns of ``records`` are ignored, whatever their names.

    An item below the least count cannot be in a pair that passes, so the matrix is built over the others; their
    number is bounded by the corpus' tokens divided by that count. Counts of rows bound counts of records from
    above, so the pruning is exact although it comes before the rows of a record meet.
    """
    rows = records.select(
        F.col(id_col).cast("bigint").alias("rid"),
        F.array_distinct(F.filter(F.col(tokens_col), lambda x: x.isNotNull() & (x != ""))).alias("tokens"),
    ).where("rid is not null and size(tokens) > 0")
    total = rows.select("rid").distinct().count()
    least = max(1, min_count, -(-total // share_of_records) if share_of_records else 1)
    kept = staged(rows.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least).select("token"), "kept")
    encoded, dictionary = _numbered(rows, kept)
    partial = encoded.repartition("rid").sortWithinPartitions("rid").mapInArrow(_gram, GRAM)
    gram = staged(partial.groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "gram")
    names = gram.where("i = j").select("i", "n").join(dictionary, F.col("i") == F.col("item")).select("item", "token", "n")
    a = names.select(F.col("item").alias("i"), F.col("token").alias("token_a"), F.col("n").alias("n_a"))
    b = names.select(F.col("item").alias("j"), F.col("token").alias("token_b"), F.col("n").alias("n_b"))
    big = "decimal(38,0)"
    return (
        gram.where("i <> j")
        .withColumnRenamed("n", "n_ab")
        .join(a, "i")
        .join(b, "j")
        .withColumn("n_records", F.lit(total).cast("bigint"))
        .where(F.col("n_records").cast(big) * F.col("n_ab") >= F.lit(min_ratio) * F.col("n_a").cast(big) * F.col("n_b"))
        .select(
            F.least("token_a", "token_b").alias("token_a"),
            F.greatest("token_a", "token_b").alias("token_b"),
            "n_ab",
            F.when(F.col("token_a") < F.col("token_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
            F.when(F.col("token_a") < F.col("token_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
            "n_records",
            F.log2(F.col("n_records").cast("double") * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("pmi"),
        )
    )
