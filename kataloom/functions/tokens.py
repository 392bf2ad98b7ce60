"""Functions on token arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataloom.functions.text import raw_tokens
from kataloom.functions.words import slang_map, stopwords

NO_STRINGS = "array<string>"


def empty() -> Column:
    return F.array().cast(NO_STRINGS)


def apply_slang(tokens: Column, mapping: Mapping[str, str]) -> Column:
    """Whole tokens become their standard form; a form of several words becomes several tokens."""
    if not mapping:
        return tokens
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    # A map literal is searched from end to end, the set of its keys by hash: only hits reach the map.
    mapped = F.transform(tokens, lambda t: F.when(t.isin(*mapping), F.try_element_at(table, t)).otherwise(t))
    return F.when(F.size(tokens) > 0, F.split(F.array_join(mapped, " "), " ")).otherwise(tokens)


def filter_tokens(tokens: Column, stop: Sequence[str], min_length: int = 2, drop_numeric: bool = True) -> Column:
    def keep(t: Column) -> Column:
        ok = F.length(t) >= min_length
        if drop_numeric:
            ok = ok & ~t.rlike(r"^\p{Nd}+$")
        return ok & ~t.isin(*stop) if stop else ok

    return F.filter(tokens, keep)


def stemmed(tokens: Column, stem: Callable[[str], str] | None) -> Column:
    """Tokens through a stemmer, if there is one; it takes the token's place."""
    if stem is None:
        return tokens

    @F.arrow_udf(NO_STRINGS)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if ts is None else [stem(t) or t for t in ts] for ts in column.to_pylist()], pa.list_(pa.string()))

    return run(tokens)


def tokenized(text: Column, cleaning: Mapping[str, Any], stem: Callable[[str], str] | None = None) -> Column:
    """The configured tokenizer on normalised text: tokens, slang, stemmer, filter."""
    out = raw_tokens(text)
    if cleaning.get("normalize_slang", True):
        out = apply_slang(out, slang_map(cleaning.get("slang_file")))
    if cleaning.get("use_stemming", False):
        out = stemmed(out, stem)
    stop = stopwords(cleaning.get("stopword_file")) if cleaning.get("filter_stopwords", True) else []
    return filter_tokens(out, stop, cleaning.get("min_token_length", 2), cleaning.get("drop_numeric", True))


def ngrams(tokens: Column, size: int) -> Column:
    """All runs of ``size`` tokens joined by a blank; shorter arrays have none."""
    if size <= 1:
        return tokens
    at = F.sequence(F.lit(1), F.size(tokens) - (size - 1))
    return F.when(F.size(tokens) >= size, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, size), " "))).otherwise(empty())


def shingles(tokens: Column, size: int = 3) -> Column:
    """Like n-grams, but a shorter non-empty array is one shingle."""
    return F.when(F.size(tokens) >= size, ngrams(tokens, size)).when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(empty())


def diversity(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens))


def all_ngrams(tokens: Column, sizes: Sequence[int]) -> Column:
    """One array with the n-grams of all sizes."""
    return F.concat(*[ngrams(tokens, k) for k in sizes])


def counted_items(df: DataFrame, key: str, items: Column) -> DataFrame:
    """(key, term, tf): the distinct items of each key's arrays with their counts."""
    return df.select(key, F.explode(items).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Tokens of the rows that are folded at once.
FOLD = 500_000


def folded_rows(tokens: pa.ListArray, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Blocks (rows, terms, codes, counts) of the n-grams of all sizes of a batch of token arrays.

    Each entry is an n-gram of a row, given as the place of its term, with its count in the row; entries are ordered by row.
    """
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + FOLD, "right")))
        part = tokens.slice(first, last - first)
        flat = part.flatten()
        row = np.repeat(np.arange(first, last), lengths[first:last])
        grams, rows = [], []
        for k in sizes:
            at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.empty(0, np.int64)
            grams.append(flat if k == 1 else pc.binary_join_element_wise(*[flat.take(pa.array(at + j)) for j in range(k)], " "))
            rows.append(row[at])
        both = pa.concat_arrays([g.cast(pa.string()) for g in grams]).dictionary_encode()
        words = max(1, len(both.dictionary))
        entry, n = np.unique(np.concatenate(rows) * words + both.indices.to_numpy(zero_copy_only=False), return_counts=True)
        yield entry // words, both.dictionary, entry % words, n
        first = last


def ngram_frequencies(df: DataFrame, tokens_col: str, sizes: Sequence[int]) -> DataFrame:
    """(term, count, doc_freq) of the n-grams of all rows, each row being a document.

    A block of rows is folded before it leaves its task, so what is shuffled are sums for the block's terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, terms, codes, n in folded_rows(batch.column(0), sizes):
                count, docs = np.bincount(codes, n, len(terms)), np.bincount(codes, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms, pa.array(count.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["term", "n", "d"])

    parts = df.select(F.array_compact(tokens_col).alias("t")).mapInArrow(run, "term string, n bigint, d bigint")
    return parts.groupBy("term").agg(F.sum("n").alias("count"), F.sum("d").alias("doc_freq"))
