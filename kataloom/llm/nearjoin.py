"""Near-duplicates by a chosen-path set-similarity join.

Documents are sets of words. A tree sends every document down a path of minwise words: at each node the document
is filed under its word of smallest hash, and nodes that would still hold many documents are branched again on
further minwise words, until a node is expected to be small. Documents that end in the same node are compared
exhaustively, first by 128-bit sketches (one bit of each of 128 minwise words), then exactly on their words. Trees
are independent; their number is computed from the depths of the paths so that a pair at the threshold meets in
at least one of them with the asked-for recall.

How deep a path must go is read from word frequencies over the whole collection: words in at least 1/16384 of the
sets are known (a list whose length is bounded by 16384 times the mean size of a set, whatever the collection's
size), and every other word counts as if it were just below that.

Nodes that turn out large, or in which more than DENSE pairs a row are close, send out no pairs. Their rows are cut into
blocks over many tasks, get their words, and give the links of a spanning forest, confirmed on the spot: first inside
the blocks, then between the blocks for the rows that are outside a node's largest component. So a mass of near-copies
costs about a link a row, however large its node is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataloom.operators.components import connected_components, merged_components
from kataloom.session import discard, staged

WORD = re.compile(r"[^\W_]+")
#: Share of the sets from which a word's frequency is known, documents expected in a small node, rows of a node that are compared by pairs, depth.
KNOWN, LEAF, CAP, DEPTH = 16_384, 256, 1024, 8
#: Close pairs a row beyond which a node counts as dense; rows and words of a block of a large or dense node, rows that all its blocks share.
DENSE, CELL, CELL_WORDS, PIVOTS = 16, 16_384, 2_000_000, 4
#: Sets from which nodes with more than 1/HOT of all sets are found, to be spread over tasks.
SAMPLE, HOT = 20_000, 500
BITS = 128
#: Branches of a node by level; the last one holds for all deeper levels.
BRANCHES = (1, 1, 2, 2, 2, 1)
_GOLD = np.uint32(0x9E3779B1)


def _branches(level: int) -> int:
    return BRANCHES[min(level, len(BRANCHES) - 1)]


def _families(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of hash functions on 32 bits; each is a bijection."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def _word_sets(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number, known = xxhash.xxh64_intdigest, {}
        for batch in batches:
            ids, digests, flat, ends = [], [], [], [0]
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = set(WORD.findall(text.lower()))
                if len(words) < least:
                    continue
                ids.append(i)
                digests.append(blake2b(" ".join(sorted(words)).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) > 500_000:
                            known.clear()
                        n = known[w] = number(w.encode("utf-8", "surrogatepass"))
                    flat.append(n)
                ends.append(len(flat))
            if not ids:
                continue
            keys = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), words], names=["id", "k1", "k2", "words"])

    return run


def _sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(2, rows): of each set one bit of each of BITS minwise words."""
    mul, add = _families(BITS, 7)
    out = np.zeros((2, len(starts)), dtype=np.uint64)
    for k in range(BITS):
        low = np.minimum.reduceat(flat * mul[k] + add[k], starts)
        out[k // 64] |= ((low * _GOLD) >> np.uint32(31)).astype(np.uint64) << np.uint64(k % 64)
    return out


class _Plan:
    """Number of trees and the frequencies that decide how deep paths go.

    How often a word is the minwise one depends on the hash function: it must be in the set, and no word with a
    smaller hash may be. Both follow from the frequencies of the known words, taken as independent.
    """

    def __init__(self, sets: int, mean: float, known: list[tuple[int, int]], threshold: float, recall: float) -> None:
        halves: dict[int, int] = {}
        for w, n in known:
            halves[w & 0xFFFFFFFF] = max(n, halves.get(w & 0xFFFFFFFF, 0))
        items = sorted(halves.items())
        self.words = np.array([w for w, _ in items], dtype=np.uint32)
        self.share = np.array([n for _, n in items], dtype=np.float64) / sets
        self.sets, self.rare = sets, max(0.0, mean - self.share.sum())
        self.functions: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # Depths of paths by other hash functions, and from them the chance to meet in one tree.
        rng = np.random.default_rng(1)
        mul, add = _families(16 * DEPTH, 3)
        meets = 0.0
        for s in range(16):
            size, at = np.full(2000, float(sets)), np.full(2000, DEPTH - 1)
            for level in range(DEPTH):
                chance = self._function(mul[s * DEPTH + level], add[s * DEPTH + level])[2]
                mass = np.r_[chance, max(1e-9, 1 - chance.sum())]
                drawn = rng.choice(len(mass), size=len(size), p=mass / mass.sum())
                size = size * np.r_[chance, 0.5 / KNOWN][drawn]
                at = np.where((size <= LEAF) & (at > level), level, at)
            for depth, n in zip(*np.unique(at, return_counts=True)):
                p = threshold
                for level in range(int(depth), 0, -1):
                    p = threshold * (1 - (1 - p) ** _branches(level))
                meets += p * n / len(at) / 16
        self.functions.clear()
        # What the sketches may lose of the pairs at the threshold comes on top of what the trees may.
        differ = (1 - threshold) / 2
        self.apart = int(BITS * differ + 3.7 * math.sqrt(BITS * differ * (1 - differ)))
        kept = sum(math.comb(BITS, k) * differ**k * (1 - differ) ** (BITS - k) for k in range(self.apart + 1))
        if recall >= kept:
            raise ValueError(f"recall must be below {kept:.6f}")
        self.trees = max(1, math.ceil(math.log(1 - recall / kept) / math.log(1 - meets)))

    def _function(self, mul: np.uint32, add: np.uint32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a hash function: hashes of the known words, ascending; the chance that no known word is below each; the words' chances."""
        key = (int(mul), int(add))
        if key not in self.functions:
            h = self.words * mul + add
            order = np.argsort(h)
            above = np.cumprod(np.r_[1.0, 1 - np.minimum(self.share[order], 0.999)])
            chance = np.empty(len(h))
            chance[order] = self.share[order] * above[:-1] * np.exp(-self.rare * (h[order] / 2.0**32))
            self.functions[key] = (h[order], above, chance)
        return self.functions[key]

    def expected(self, words: np.ndarray, mul: np.uint32, add: np.uint32) -> np.ndarray:
        """The chance of each word to be the minwise one; unknown words count as if just below the known ones."""
        hashes, above, chance = self._function(mul, add)
        h = words * mul + add
        rest = above[np.searchsorted(hashes, h)] * np.exp(-self.rare * (h / 2.0**32)) / KNOWN
        if not len(self.words):
            return rest
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, chance[at], rest)


def _paths(plan: _Plan, hot: dict[int, float] | None = None, others: float = math.inf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, id, s1, s2, hot): the small nodes that a document ends in, with its sketch.

    ``hot`` has the measured sizes of the nodes, at any depth, that hold a large share of the sets, ``others`` bounds the size of
    all others. A document also ends in a measured node that holds more than 0.8 of the node above it: its sets are too
    alike for a further word to part them. Without ``hot``, every node on the way comes out instead, to be counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_tree = 1 + (DEPTH - 1) * 2
        mul, add = _families(plan.trees * per_tree, 11)
        inverse = np.array([pow(int(m), -1, 2**32) for m in mul], dtype=np.uint32)
        measured = np.array(sorted(hot or {}), dtype=np.int64)
        sizes_of = np.array([(hot or {})[x] for x in measured.tolist()], dtype=np.float64)
        for whole in batches:
            for batch in (whole.slice(s, 4096) for s in range(0, whole.num_rows, 4096)):
                words = batch.column("words")
                sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)  # the low half is what paths go by
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                ids = batch.column("id").to_numpy(zero_copy_only=False)

                sketch = _sketches(flat, starts)

                def pick(rows: np.ndarray, f: int) -> np.ndarray:
                    """The minwise word of each of the rows by hash function f."""
                    if len(rows) * 2 > len(ids):
                        low = np.minimum.reduceat(flat * mul[f] + add[f], starts)[rows]
                    else:
                        n = sizes[rows]
                        first = np.r_[0, np.cumsum(n)[:-1]]
                        at = np.repeat(starts[rows] - first, n) + np.arange(n.sum())
                        low = np.minimum.reduceat(flat[at] * mul[f] + add[f], first)
                    return (low - add[f]) * inverse[f]

                for tree in range(plan.trees):
                    rows, node = np.arange(len(ids)), np.full(len(ids), (tree + 1) * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
                    size, last = np.full(len(ids), float(plan.sets)), np.zeros(len(ids), np.uint32)
                    for level in range(DEPTH):
                        grown = []
                        for b in range(_branches(level)):
                            f = tree * per_tree + (2 * level - 1 + b if level else 0)
                            word = pick(rows, f)
                            deeper = (node ^ word.astype(np.uint64) ^ (np.uint64(b) << np.uint64(40))) * np.uint64(0xD6E8FEB86659FD93)
                            deeper ^= deeper >> np.uint64(32)
                            grown.append((rows, deeper, np.where(word == last, size, size * plan.expected(word, mul[f], add[f])), word, size))
                        rows, node, size, last, above = (np.concatenate(x) for x in zip(*grown))
                        known = np.zeros(len(node), dtype=bool)
                        if len(measured):
                            place = np.minimum(np.searchsorted(measured, node.view(np.int64)), len(measured) - 1)
                            known = measured[place] == node.view(np.int64)
                            size = np.where(known, sizes_of[place], np.minimum(size, others))
                        done = (size <= LEAF) | (level == DEPTH - 1) | (known & (size > 0.8 * above))
                        out = done if hot is not None else np.ones(len(done), dtype=bool)
                        if out.any():
                            got = rows[out]
                            cols = (node[out].view(np.int64), ids[got], sketch[0][got].view(np.int64), sketch[1][got].view(np.int64), known[out].astype(np.int64))
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "id", "s1", "s2", "hot"])
                        rows, node, size, last = rows[~done], node[~done], size[~done], last[~done]
                        if not len(rows):
                            break

    return run


def _close(s: np.ndarray, a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    bits = np.bitwise_count(s[0][a] ^ s[0][b]).astype(np.int16)
    return bits + np.bitwise_count(s[1][a] ^ s[1][b]) <= apart


_FOUND = "a bigint, b bigint, node bigint"


def _compare(apart: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exhaustive comparison of sketches inside the nodes of a partition sorted by node.

    Close pairs (a, b) come out of nodes of at most CAP rows with at most DENSE pairs a row. The rows of other nodes and
    of nodes known to be hot are passed on as (a, null, node). Memory stays bounded by DENSE pairs for each row held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), dtype=np.int64)
        large = None

        def out(a: np.ndarray, b: np.ndarray | None, node: np.ndarray | None) -> pa.RecordBatch:
            other = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (b, node)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *other], names=["a", "b", "node"])

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            node, ids, s = rows[0], rows[1], rows[2:4].view(np.uint64)
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            n = np.diff(np.r_[starts, len(node)])
            group = np.repeat(np.arange(len(starts)), n)
            over = (n > CAP) | (rows[4][starts] > 0) | (large is not None and node[starts] == large)
            at, d, left, right, seen = np.flatnonzero(~over[group]), 1, [], [], np.zeros(len(starts), np.int64)
            while True:
                at = at[at + d < len(node)]
                at = at[(group[at] == group[at + d]) & ~over[group[at]]]
                if not len(at):
                    break
                hit = at[_close(s, at, at + d, apart)]
                left.append(hit)
                right.append(hit + d)
                seen += np.bincount(group[hit], minlength=len(seen))
                over |= seen > DENSE * n
                d += 1
            gone = over[group]
            if gone.any():
                yield out(ids[gone], None, node[gone])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                a, b = a[~gone[a]], b[~gone[a]]
                pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
                pairs = pairs[:, pairs[0] != pairs[1]]
                if pairs.shape[1]:
                    yield out(pairs[0], pairs[1], None)

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "id", "s1", "s2", "hot")])
            held = np.concatenate([held, new], axis=1)
            if held.shape[1] < 100_000:
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            cut = last or held.shape[1]
            going, held = held[:, :cut], held[:, cut:]
            yield from work(going)
            large = None if last else going[0][-1]
        if held.shape[1]:
            yield from work(held)

    return run


class _Block:
    """Sets of words held at once, and which of them are near to one of them."""

    def __init__(self, words: pa.ListArray, num: int, den: int, apart: int) -> None:
        self.num, self.den, self.apart = num, den, apart
        self.sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.sketch = _sketches(flat.astype(np.uint32), self.starts)
        known, self.codes = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(known), dtype=bool)

    def near(self, k: int, among: np.ndarray) -> np.ndarray:
        """The rows of ``among`` that are near to row k: by sketches first, then exactly by shared words."""
        n, sizes = self.sizes[k], self.sizes[among]
        far = np.bitwise_count(self.sketch[0][k] ^ self.sketch[0][among]).astype(np.int16) + np.bitwise_count(self.sketch[1][k] ^ self.sketch[1][among])
        among = among[(far <= self.apart) & (np.minimum(n, sizes) * self.den >= np.maximum(n, sizes) * self.num)]
        if not len(among):
            return among
        sizes = self.sizes[among]
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.repeat(self.starts[among] - first, sizes) + np.arange(sizes.sum())
        mine = self.codes[self.starts[k] : self.starts[k] + n]
        self.mark[mine] = True
        shared = np.add.reduceat(self.mark[self.codes[at]].astype(np.int64), first)
        self.mark[mine] = False
        return among[shared * self.den >= (n + sizes - shared) * self.num]


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of ``key`` in a partition sorted by it, one at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and s < e and held[0].column(key)[0].as_py() != values[s]:
                yield pa.Table.from_batches(held)
                held = []
            if s < e:
                held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.sort(np.array(found, dtype=np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _spanning(num: int, den: int, apart: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The links of a spanning forest of each block: a row reached once is compared with no further row to be reached again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "cell"):
            ids = table.column("id").to_numpy()
            block = _Block(table.column("words").combine_chunks(), num, den, apart)
            rest, found = np.arange(len(ids)), []
            while len(rest):
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    k = queue.pop()
                    hit = block.near(k, rest)
                    found += [(ids[k], ids[h]) for h in hit]
                    queue += list(hit)
                    rest = np.setdiff1d(rest, hit, assume_unique=True)
            yield _links(found)

    return run


def _between(num: int, den: int, apart: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Inside each cell, links between asking and answering rows of different components, one for each two that are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "cell"):
            ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy() == 1
            block = _Block(table.column("words").combine_chunks(), num, den, apart)
            root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
            answers, found = np.flatnonzero(~asks), []
            for k in np.flatnonzero(asks):
                for h in block.near(k, answers[root[answers] != root[k]]):
                    if root[h] != root[k]:
                        found.append((ids[k], ids[h]))
                        root[root == root[h]] = root[k]
            yield _links(found)

    return run


def _blocks(rows: Column, words: Column) -> Column:
    """How many blocks so many rows with so many words are cut into."""
    return F.ceil(F.greatest(rows / CELL, words / CELL_WORDS)).cast("int")


def _inside(over: DataFrame, words: DataFrame, num: int, den: int, apart: int) -> DataFrame:
    """Links inside the blocks of large and dense nodes. A row is compared in one of its nodes here; ``_across`` has the others.

    A few rows of a node stand in all its blocks, so that a mass of near-copies is one component after this step.
    """
    rows = over.groupBy("id", "n_words").agg(F.min("node").alias("node"))
    pivots = F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)), F.col("id")))["id"] for k in range(PIVOTS)])
    parts = rows.groupBy("node").agg(_blocks(F.count("*"), F.sum("n_words")).alias("nb"), pivots.alias("pivots"))
    spread = parts.where("nb > 1").select("node", "nb", F.explode(F.array_distinct("pivots")).alias("id")).select("node", "id", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
    rows = rows.join(parts, "node").select("node", "id", F.pmod(F.xxhash64("id", "node"), F.col("nb")).alias("block"))
    rows = rows.union(spread.select("node", "id", F.col("block").cast("bigint"))).select(F.xxhash64("node", "block").alias("cell"), "id").join(words, "id")
    return rows.select("cell", "id", "words").repartition("cell").sortWithinPartitions("cell").mapInArrow(_spanning(num, den, apart), "a bigint, b bigint").where("a <> b")


def _unfinished(over: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of large and dense nodes with their components, and the nodes that hold more than one component.

    Of such a node: its largest component, the blocks that all rows are cut into, and those of the rows outside of that component.
    """
    rows = over.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = staged(rows.select("node", "id", "n_words", "root"), "large")
    parts = rows.groupBy("node", "root").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    main = parts.groupBy("node").agg(F.max(F.struct("n", "w", "root")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > top.n")
    blocks = (_blocks(F.col("n"), F.col("w")).alias("nb"), _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("na"))
    return rows, staged(main.select("node", F.col("top.root").alias("main"), *blocks), "open")


def _across(rows: DataFrame, nodes: DataFrame, words: DataFrame, num: int, den: int, apart: int) -> DataFrame:
    """Links in large and dense nodes between rows that are not connected yet.

    In each node, the rows outside its largest component ask, and all rows answer; both are cut into blocks and every
    pair of blocks is one cell. A mass of near-copies is one component by then, so what is left to ask is small even
    if the node holds a large part of the collection, and a node of one component is done.
    """
    rows = rows.join(nodes, "node").join(words, "id")
    spot = lambda n: F.pmod(F.xxhash64("id", "node"), F.col(n))
    asks = rows.where("root <> main").select("*", spot("na").alias("x"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"), F.lit(1).cast("bigint").alias("asks"))
    answers = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("x"), spot("nb").alias("y"), F.lit(0).cast("bigint").alias("asks"))
    both = asks.unionByName(answers).select(F.xxhash64("node", F.col("x").cast("bigint"), F.col("y").cast("bigint")).alias("cell"), "id", "root", "asks", "words")
    return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(_between(num, den, apart), "a bigint, b bigint")


def _confirmed(candidates: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs whose words agree: shared >= num/den of all words of the two."""
    words = sets.select("id", "words")
    pairs = candidates.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return pairs.select("a", "b", shared.alias("n"), (F.size("wa") + F.size("wb")).alias("m")).where(F.col("n") * den >= (F.col("m") - F.col("n")) * num).select("a", "b")


def near_duplicate_groups(
    documents: DataFrame,
    id_col: str,
    text_col: str,
    *,
    threshold: tuple[int, int] = (8, 10),
    least: int = 10,
    recall: float = 0.999,
) -> DataFrame:
    """(id, first_id, group_size) for every document that is in a group of two or more.

    Words are the distinct runs of letters and digits of the lower-cased text; documents with fewer than ``least``
    are left out. Two documents are near if the words they share are at least threshold (numerator, denominator)
    of all words of the two; groups are the documents linked by near pairs, first_id is the smallest id of a group.
    Documents with the same words are one node of the search, so copies cost nothing beyond their row. Every
    returned link is confirmed on the whole sets, of 64-bit word hashes; a link at the threshold is found with probability
    ``recall`` at least (what the sketches may lose is counted in), closer ones more often. Null ids and null texts are
    left out, ids are expected to be unique, an empty table gives no rows, other columns are ignored.
    """
    num, den = threshold
    t = num / den
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sets = staged(rows.mapInArrow(_word_sets(max(1, least)), "id bigint, k1 bigint, k2 bigint, words array<bigint>"), "sets")
    total, mean = sets.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not total:
        return sets.select("id", F.col("id").alias("first_id"), F.lit(0).cast("bigint").alias("group_size"))
    known = sets.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") * KNOWN >= total)
    plan = _Plan(total, mean, [(r[0], r[1]) for r in known.collect()], t, recall)
    exact = (num, den, plan.apart)

    first = sets.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("words").alias("words"))
    schema = "node bigint, id bigint, s1 bigint, s2 bigint, hot bigint"
    # Nodes with more than 1/HOT of the sets, so at most HOT for each branch of a tree, are measured: paths don't go on in vain below them, and
    # their rows go to many tasks. What the sample misses costs time, no link.
    every = max(1, total // SAMPLE)
    part = first.where(F.pmod(F.xxhash64("k1"), F.lit(every)) == 0).select("id", "words")
    least_hot = max(CAP // every, total / every / HOT)
    hot = part.mapInArrow(_paths(plan), schema).groupBy("node").count().where(F.col("count") > least_hot)
    sizes = {r["node"]: float(r["count"] * every) for r in hot.collect()}
    nodes = first.select("id", "words").mapInArrow(_paths(plan, sizes, 2.0 * every * least_hot), schema)
    spread = F.when(F.col("hot") > 0, F.xxhash64("id")).otherwise(F.col("node"))
    ordered = nodes.repartition(spread).sortWithinPartitions("node")
    found = staged(ordered.select("node", "id", "s1", "s2", "hot").mapInArrow(_compare(plan.apart), _FOUND), "found")
    pairs = _confirmed(found.where("b is not null").select("a", "b").distinct(), sets, num, den)
    over = found.where("b is null").select("node", F.col("a").alias("id")).distinct()
    if over.isEmpty():
        roots = connected_components(pairs)
    else:
        words = sets.select("id", "words")
        over = staged(over.join(words.select("id", F.size("words").alias("n_words")), "id"), "over")
        roots = connected_components(pairs.union(_inside(over, words, *exact)))
        rows, nodes = _unfinished(over, roots)
        if not nodes.isEmpty():
            more = staged(_across(rows, nodes, words, *exact), "across")
            roots = merged_components(roots, more)
        discard(over, rows, nodes)

    groups = sets.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    groups = groups.join(roots.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", "n", F.coalesce("root", "id").alias("first_id"))
    groups = staged(groups, "groups", [found])
    sizes = groups.groupBy("first_id").agg(F.sum("n").alias("group_size")).where("group_size > 1")
    return sets.select("id", "k1", "k2").join(groups.join(sizes, "first_id").select("k1", "k2", "first_id", "group_size"), ["k1", "k2"]).select("id", "first_id", "group_size")
