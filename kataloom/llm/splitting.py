"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is first cut into atomic segments: at line breaks and sentence ends, inside a longer sentence at words, inside
a longer word between its tokens. All pairs of neighbours are held in a heap, and the weakest boundary is merged
first (between equals, the smaller result) as long as the result and the overlap with what stands before it fit
the limit. So line breaks and sentence ends survive where they can.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataloom.llm.tokens import PATTERN, RUN, RUNS, TOKENIZER, _encoding

PIECES = "doc_id bigint, piece int, n_pieces int, start bigint, stop bigint, n_tokens bigint, overlap_tokens bigint, text string"
#: Strength of a boundary: between the tokens of a word, between words, sentences, lines, paragraphs.
INSIDE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
#: Characters that end a sentence, and those that may follow before the blank.
ENDS, CLOSERS = ".!?…。！？", "\"')]}»”’"


class Units:
    """A text as a run of smallest units: (start, stop) in characters, and the tokens before each."""

    def __init__(self, text: str, tokenizer: str) -> None:
        self.text = text
        if tokenizer == RUNS:
            spans = [m.span() for m in RUN.finditer(text)]
            sizes = [1] * len(spans)
        else:
            spans, sizes = [], []
            count = _counter(tokenizer)
            for m in _pattern().finditer(text):
                spans.append(m.span())
                sizes.append(count(m[0]))
        self.starts = [s for s, _ in spans]
        self.stops = [e for _, e in spans]
        self.before = [0]
        for n in sizes:
            self.before.append(self.before[-1] + n)

    def __len__(self) -> int:
        return len(self.starts)

    def strength(self, i: int) -> int:
        """Of the boundary before unit i."""
        a, b = self.stops[i - 1], self.starts[i]
        while a > 0 and self.text[a - 1].isspace():
            a -= 1
        while b < len(self.text) and self.text[b].isspace():
            b += 1
        gap = self.text[a:b]
        if not gap:
            return INSIDE
        lines = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        if lines:
            return PARAGRAPH if lines > 1 else LINE
        while a > 0 and self.text[a - 1] in CLOSERS:
            a -= 1
        return SENTENCE if a > 0 and self.text[a - 1] in ENDS else WORD


def _pattern():
    import regex

    return regex.compile(PATTERN)


_counts: dict[str, dict[str, int]] = {}


def _counter(tokenizer: str) -> Callable[[str], int]:
    known, encode = _counts.setdefault(tokenizer, {}), _encoding(tokenizer).encode_ordinary

    def count(part: str) -> int:
        n = known.get(part)
        if n is None:
            if len(known) > 300_000:
                known.clear()
            n = len(encode(part))
            if len(part) < 40:
                known[part] = n
        return n

    return count


def _atoms(u: Units, strengths: list[int], lo: int, hi: int, most: int, limit: int) -> Iterator[tuple[int, int]]:
    """Segments [i, j) of units lo..hi, none above ``most`` tokens unless it is a word within ``limit`` or one unit."""
    level = SENTENCE
    cuts = [lo, *(i for i in range(lo + 1, hi) if strengths[i] >= level), hi]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if u.before[b] - u.before[a] <= most:
            yield a, b
            continue
        words = [a, *(i for i in range(a + 1, b) if strengths[i] >= WORD), b]
        for c, d in zip(words[:-1], words[1:]):
            if u.before[d] - u.before[c] <= limit:
                yield c, d
            else:
                yield from ((i, i + 1) for i in range(c, d))


def split_text(text: str, limit: int, overlap: int, tokenizer: str) -> list[tuple[int, int, int, int]]:
    """Pieces (start, stop, tokens, overlap tokens) of a text, by places in it; one piece if it fits the limit."""
    u = Units(text, tokenizer)
    total = u.before[-1]
    if not len(u):
        return []
    if total <= limit:
        return [(0, len(text), total, 0)]
    room = limit - overlap
    strengths = [PARAGRAPH, *(u.strength(i) for i in range(1, len(u)))]
    segments = list(_atoms(u, strengths, 0, len(u), room, limit))
    left = list(range(-1, len(segments) - 1))
    right = [*range(1, len(segments)), -1]
    start, stop = [a for a, _ in segments], [b for _, b in segments]
    alive = [True] * len(segments)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(k: int) -> None:
        r = right[k]
        if r >= 0:
            size = u.before[stop[r]] - u.before[start[k]]
            if size + (overlap if start[k] else 0) <= limit:
                heap.append((strengths[start[r]], size, k, stop[k], stop[r]))

    for k in range(len(segments)):
        offer(k)
    heapq.heapify(heap)
    while heap:
        _, _, k, a, b = heapq.heappop(heap)
        r = right[k] if alive[k] else -1
        if r < 0 or stop[k] != a or stop[r] != b:
            continue
        stop[k], alive[r] = stop[r], False
        right[k] = right[r]
        if right[k] >= 0:
            left[right[k]] = k
        for j in (left[k], k):
            if j >= 0:
                n = len(heap)
                offer(j)
                if len(heap) > n:
                    heapq.heappush(heap, heap.pop())
    count = _sizes(tokenizer)
    out = []
    for k in (k for k in range(len(segments)) if alive[k]):
        i, j = start[k], stop[k]
        end = u.starts[j] if j < len(u) else len(text)
        size = u.before[j] - u.before[i]
        if size > limit:  # one unit; it is cut between its characters
            out += _cut_unit(text, u.starts[i] if i else 0, end, limit, overlap, count)
            continue
        s, most = u.starts[i], min(overlap, limit - size)
        if i and most:
            # What stands before, up to the overlap that there is room for; from a word's beginning if there is one in that reach.
            back = bisect_left(u.before, u.before[i] - most, 0, i)
            back = next((x for x in range(back, i) if strengths[x] >= WORD), back)
            if back < i:
                s, over = u.starts[back], u.before[i] - u.before[back]
            else:  # the unit before is larger than the overlap: its last characters
                s = _tail(text, u.starts[i - 1], u.starts[i], most, count)
                over = count(text[s : u.starts[i]])
            out.append((s, end, size + over, over))
        else:
            out.append((s if i else 0, end, size, 0))
    return out


def _sizes(tokenizer: str) -> Callable[[str], int]:
    return (lambda x: len(RUN.findall(x))) if tokenizer == RUNS else (lambda x: len(_encoding(tokenizer).encode_ordinary(x)))


def _tail(text: str, lo: int, hi: int, most: int, count: Callable[[str], int]) -> int:
    """Where the longest ending of text[lo:hi] begins that has at most ``most`` tokens, growing in steps; hi if none has."""
    at, step = hi, max(1, most // 2)
    while step:
        if at - step >= lo and count(text[at - step : hi]) <= most:
            at -= step
        else:
            step //= 2
    return at


def _cut_unit(text: str, s: int, e: int, limit: int, overlap: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of one unit above the limit, each but the first with up to ``overlap`` tokens of the one before."""
    at = back = s
    while at < e:
        # A token has at least one byte, so limit / 4 characters fit; grow while it fits.
        end, step = min(e, at + 1), max(1, limit // 4)
        while step:
            if end < e and count(text[back : min(e, end + step)]) <= limit:
                end = min(e, end + step)
            else:
                step //= 2
        yield back, end, count(text[back:end]), count(text[back:at]) if back < at else 0
        at, back = end, _tail(text, s, end, min(overlap, limit - limit // 4 - 4), count) if overlap else end


def split_oversized(docs: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, n_pieces, start, stop, n_tokens, overlap_tokens, text): every text in pieces within the limit.

    A text of at most ``limit`` tokens is one piece. Of a larger one, the pieces cover it in order, each but the
    first begins with up to ``overlap`` tokens of what stands before it, beginning at a word; ``n_tokens`` counts
    them in, ``start`` and ``stop`` are places in the text. Pieces count from 0. A word within the limit is never cut:
    where it leaves no room for the whole overlap, the overlap is shorter (``overlap_tokens`` tells). A word above the limit
    is cut between its tokens or characters. Null texts and texts without tokens have no pieces; null ids stay; an empty
    table gives no rows. No shuffle takes place.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                spans = split_text(text, limit, overlap, tokenizer)
                for p, (s, e, n, o) in enumerate(spans):
                    for column, value in zip(out, (i, p, len(spans), s, e, n, o, text[s:e])):
                        column.append(value)
                held += len(text)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
