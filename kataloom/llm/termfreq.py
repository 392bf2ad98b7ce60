"""Frequency of every distinct term: range-partitioned external sort of (term, record) and run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "term string, n bigint, docs bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of a partition sorted by (term, rid): one row per run of a term, the last run held over batches."""
    term, rid, n, docs = None, None, 0, 0

    def out(terms: list, counts: list, distinct: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(distinct, pa.int64())], names=["term", "n", "docs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        terms, ids, times = batch.column("term"), batch.column("rid").to_numpy(zero_copy_only=False), batch.column("times").to_numpy(zero_copy_only=False)
        same_term = np.r_[terms[0].as_py() == term, pc.equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)]
        same_doc = same_term & np.r_[ids[0] == rid, ids[1:] == ids[:-1]]
        starts = np.flatnonzero(~same_term)
        cuts = np.r_[0, starts[starts > 0]]
        counts, distinct = np.add.reduceat(times, cuts), np.add.reduceat((~same_doc).astype(np.int64), cuts)
        names = terms.take(pa.array(cuts)).to_pylist()
        if same_term[0]:
            counts[0] += n
            distinct[0] += docs
        elif term is not None:
            yield out([term], [n], [docs])
        if len(cuts) > 1:
            yield out(names[:-1], counts[:-1], distinct[:-1])
        term, rid, n, docs = names[-1], ids[-1], int(counts[-1]), int(distinct[-1])
    if term is not None:
        yield out([term], [n], [docs])


def term_frequencies(records: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(term, count, doc_freq) for every distinct term of the collection.

    ``count`` is the number of occurrences over all rows, ``doc_freq`` the number of distinct ids; several rows of
    one id are one record for ``doc_freq``. Null ids and null or empty terms don't exist; an empty table gives no
    rows; other columns are ignored.

    Repeats within a row are folded before the shuffle. The range partitioning is on (term, id), so a term that
    stands in every record is spread over as many partitions as its share of the pairs asks for; its partial runs
    meet in a grouped sum over the terms.
    """
    tokens = F.filter(F.col(tokens_col), lambda x: x.isNotNull() & (x != ""))
    rows = records.select(F.col(id_col).cast("bigint").alias("rid"), F.array_sort(tokens).alias("t")).where("rid is not null and size(t) > 0")
    # A row without repeats, the usual case, keeps its tokens as they are; otherwise each is paired with its count.
    once = F.array_distinct("t")
    pairs = rows.select("rid", "t", once.alias("u")).select(
        "rid",
        F.explode(
            F.when(F.size("t") == F.size("u"), F.transform("u", lambda x: F.struct(x.alias("term"), F.lit(1).cast("bigint").alias("times")))).otherwise(
                F.transform("u", lambda x: F.struct(x.alias("term"), F.size(F.filter("t", lambda y: y == x)).cast("bigint").alias("times")))
            )
        ).alias("p"),
    )
    ordered = pairs.select("p.term", "rid", "p.times").repartitionByRange("term", "rid").sortWithinPartitions("term", "rid")
    runs = ordered.mapInArrow(_scan, RUNS)
    return runs.groupBy("term").agg(F.sum("n").alias("count"), F.sum("docs").alias("doc_freq"))


def usefulness(doc_freq: Column, records: int, *, rare: int = 2, common_share: int = 10) -> Column:
    """'rare' for terms in at most ``rare`` records, 'common' for those in more than 1/common_share of them, else null."""
    return F.when(doc_freq <= rare, "rare").when(doc_freq * common_share > F.lit(records), "common")
