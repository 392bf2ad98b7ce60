"""Sizes of texts: in tokens of a public tokenizer, or in runs of characters."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE in tiktoken's format; on a cluster the file must exist on every node.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenization pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The size measure without a tokenizer: a run of word characters or of other characters that aren't white space.
RUNS = "runs"
RUN = re.compile(r"\w+|[^\w\s]+")
#: Texts are encoded in slices of about this many characters, to bound what is held at once.
SLICE = 100_000
#: Where a slice may end: the pattern always cuts before white space that follows something else, and neither side's
#: matches look beyond that place, so slices have exactly the tokens of the whole.
_END = re.compile(r"\S(?=\s)")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def slices(text: str) -> Iterator[str]:
    """Slices with the same tokens as the whole text; where no white space follows, the rest is one slice."""
    at = 0
    while len(text) - at > SLICE and (end := _END.search(text, at + SLICE)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def sizer(tokenizer: str) -> Callable[[str], int]:
    """The size function of a tokenizer file, or of RUNS."""
    if tokenizer == RUNS:
        return lambda text: sum(1 for _ in RUN.finditer(text))
    encode = _encoding(tokenizer).encode_ordinary
    return lambda text: sum(len(encode(x)) for x in slices(text))


def token_ids(tokenizer: str) -> Callable[[str], list[int]]:
    """The token ids of a text by a tokenizer file."""
    encode = _encoding(tokenizer).encode_ordinary
    return lambda text: [i for x in slices(text) for i in encode(x)]


def with_size(docs: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, *keep, n_tokens) of every row; null texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizer(tokenizer)
        for batch in batches:
            n = [size(t) if t else 0 for t in batch.column("_text").to_pylist()]
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), *keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(run, f"{fields}, n_tokens bigint")
