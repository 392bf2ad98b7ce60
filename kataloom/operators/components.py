"""Connected components of an undirected edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and one equi-join on the edge table, so nothing is collected: neither a
component nor a node's neighbours ever become one value or one task's list. Each round is written to the shared
scratch folder, which keeps the plan short and the job restartable after the loss of an executor. A counted, small
edge table is joined by one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataloom.session import staged


#: Up to so many links, one task joins them; more are worked on by rounds over all tasks.
FEW = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of at most FEW links, by union-find."""
    above: dict = {}

    def top(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            ra, rb = top(a), top(b)
            if ra != rb:
                above[max(ra, rb)] = min(ra, rb)
    nodes = list(above)
    for first in range(0, len(nodes), 100_000):
        part = nodes[first : first + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([top(x) for x in part], kind)], names=["node", "root"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b): link neighbours to the smallest one in reach."""
    if large:
        arcs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select("a", "b")
    low = arcs.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
    linked = arcs.join(low, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("_low").alias("b")).union(low.select("a", F.col("_low").alias("b")))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node that occurs in ``edges``; root is the smallest node of its component.

    Nodes must be of an orderable type. Rows with a null end and self-loops carry no link: an end that occurs
    only in such rows is not part of the result. An empty edge table gives an empty result.
    """
    now = staged(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct(),
        "edges",
    )
    if now.count() <= FEW:
        kind = now.schema["a"].dataType.simpleString()
        return staged(now.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), "components", [now])
    mark = None
    for _ in range(max_rounds):
        now = staged(_star(_star(now, large=True), large=False), "stars", [now])
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("connected components did not settle")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (a, b) between nodes, in or outside of ``roots``: only the components that they touch are worked on."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    roots = staged(roots.union(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))), "roots")
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
    to = connected_components(links.join(a, "a").join(b, "b"), "_a", "_b").select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
