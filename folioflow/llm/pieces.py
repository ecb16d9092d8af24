"""Problem 9: texts over a token limit, cut at natural boundaries with an overlap, by pointer doubling.

Within an Arrow batch the tokens of all long texts stand in one array.  A *cut* is a token position at which a piece may
end; for every position at once the farthest legal next cut is found (paragraph end, else sentence end, else word end,
else any whole character), starting ``overlap`` tokens before the position.  Squaring this successor table doubles the
number of steps it takes, so all greedy cuts of all texts are marked in log2(longest chain) array operations.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.bpe_fst import TOKENIZER_DIR, Encoder, encoder

#: A paragraph or sentence end is taken if the piece is filled to this share of the limit at least; else a word end.
MIN_FILL = 0.5

#: Signs that end a sentence, and signs that may close it.
SENTENCE_ENDS = ".!?؟۔…。"
CLOSERS = "\"'”’»)]}"

WORD, SENTENCE, PARAGRAPH = 1, 2, 3
#: Names of the classes; the last one is the end of a text.
BOUNDARIES = ["character", "word", "sentence", "paragraph", "text"]


class WordTable(dict):
    """Word (with the blanks before it) -> row of the table of what the cut needs to know of it; made when first seen.

    Of a word: its characters, whether the blanks before it end a paragraph, and its tokens.  Of a token: how many of the
    word's characters begin before its end, and the class of the boundary there (-1 where none may be cut).
    """

    def __init__(self, enc: Encoder, limit: int = 300_000):
        super().__init__()
        self.enc, self.limit = enc, limit
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.chars, self.heads, self.sizes, self.ends, self.kinds = array("i"), array("b"), array("i"), array("i"), array("b")

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        ids = self.enc.words[word]
        bare = word.lstrip()
        blanks = word[: len(word) - len(bare)]
        self.chars.append(len(word))
        self.heads.append(blanks.count("\n") > 1 or blanks.count("\r") > 1 or "\u2029" in blanks or "\x0c" in blanks)
        self.sizes.append(len(ids))
        if len(ids) > 1:
            data = np.frombuffer(word.encode("utf-8", "replace"), np.uint8)
            begins = (data & 0xC0) != 0x80
            at = np.cumsum(self.enc.lengths[list(ids[:-1])])
            self.ends.extend(np.cumsum(begins)[at - 1].tolist())
            # a piece that begins with an apostrophe could be split into other tokens
            self.kinds.extend(np.where(begins[at] & (data[at] != 0x27), 0, -1).tolist())
        self.ends.append(len(word))
        self.kinds.append(SENTENCE if bare and word.rstrip(CLOSERS)[-1:] in SENTENCE_ENDS else WORD)
        return row

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words of all texts one after the other, and where each text's begin; the table is emptied between calls only."""
        if len(self) > self.limit or len(self.ends) > 20 * self.limit:
            self._empty()
        flat, at = array("i"), [0]
        for text in texts:
            if text:
                flat.extend(map(self.__getitem__, self.enc.pieces(text)))
            at.append(len(flat))
        return np.array(flat, np.int32), np.array(at)


@lru_cache(maxsize=4)
def word_table(tokenizer: str, folder: str) -> WordTable:
    """One table a worker, kept between tasks."""
    return WordTable(encoder(tokenizer, folder))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def successors(limit: np.ndarray, overlap: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray, min_fill: float) -> np.ndarray:
    """The farthest legal next cut after a cut at each position; 0-based positions 'after token i', all texts in one array.

    ``first`` and ``last`` are each position's text's begin and end positions. A text's end is its own successor.
    """
    at = np.arange(len(kind), dtype=first.dtype)
    start = np.maximum(at - overlap, first)
    reach = np.minimum(start + limit, last)
    floor = np.maximum(at, start + (limit * min_fill).astype(at.dtype))
    nxt = np.minimum(at + 1, last)  # a single character longer than the limit
    for least, above in ((0, at), (WORD, at), (SENTENCE, floor), (PARAGRAPH, floor)):
        found = np.maximum.accumulate(np.where(kind >= least, at, -1))[reach]
        nxt = np.where(found > above, found, nxt)
    return np.where(reach >= last, last, nxt)


def reached(nxt: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which positions the greedy walks from ``begins`` visit, by squaring the successor table.

    After n squarings the table takes 2^n steps and all positions within 2^n - 1 steps are known; a turn that adds none
    has passed the end of the longest walk.
    """
    mark = np.zeros(len(nxt), bool)
    mark[begins] = True
    known = begins
    while True:
        new = nxt[known]
        new = new[~mark[new]]
        if not len(new):
            return mark
        mark[new] = True
        known = np.concatenate([known, new])
        nxt = nxt[nxt]


def cut_batch(table: WordTable, texts: list[str | None], limits: np.ndarray, overlaps: np.ndarray, min_fill: float) -> list[np.ndarray]:
    """Pieces of all texts: which text, ``piece_no, start_char, end_char, n_tokens, shared_tokens`` and class of the boundary.

    A limit under 1 is none.  The words' facts come from the table, so that the work on a text is array operations only.
    """
    words, begin = table.rows(texts)
    sizes = np.array(table.sizes, np.int32)
    upto = np.concatenate([[0], np.cumsum(sizes[words], dtype=np.int64)])
    total = np.diff(upto[begin])
    long = np.flatnonzero((limits > 0) & (total > limits))
    short = np.flatnonzero((total > 0) & ~((limits > 0) & (total > limits)))
    zero = np.zeros(len(short), np.int64)
    one = [short, zero, zero, np.array([len(texts[k]) for k in short], np.int64), total[short], zero, np.full(len(short), PARAGRAPH + 1)]
    if not len(long):
        return one
    n_words, n_tokens = np.diff(begin)[long], total[long]
    words = words[_ranges(begin[long], n_words)]
    size, chars = sizes[words], np.array(table.chars, np.int32)[words]
    first_word, last_word = np.cumsum(n_words) - n_words, np.cumsum(n_words) - 1
    # a position before each text's first token, then one after each token
    span = n_tokens + 1
    first = (np.cumsum(span) - span).astype(np.int32)
    last = (first + n_tokens).astype(np.int32)
    n = int(span.sum())
    inner = np.ones(n, bool)
    inner[first] = False
    token = _ranges((np.cumsum(sizes, dtype=np.int64) - sizes)[words], size)
    before = np.cumsum(chars, dtype=np.int64) - chars
    before -= np.repeat(before[first_word], n_words)
    kind, char_at = np.full(n, PARAGRAPH, np.int8), np.zeros(n, np.int32)
    kind[inner] = np.array(table.kinds, np.int8)[token]
    char_at[inner] = np.array(table.ends, np.int32)[token] + np.repeat(before, size)
    ends = np.flatnonzero(inner)[np.cumsum(size) - 1]  # the position at the end of each word
    breaks = np.array(table.heads, bool)[words]
    breaks[first_word] = False
    kind[ends[np.flatnonzero(breaks) - 1]] = PARAGRAPH
    kind[ends[last_word]] = PARAGRAPH
    limit = np.repeat(limits[long], span).astype(np.int32)
    first_at, last_at, at = np.repeat(first, span), np.repeat(last, span), np.arange(n, dtype=np.int32)
    # an overlap that would begin within a character begins before it
    whole = np.maximum.accumulate(np.where(kind >= 0, at, 0))
    lap = np.repeat(np.clip(overlaps[long], 0, limits[long] - 1), span).astype(np.int32)
    lap = at - whole[np.maximum(at - lap, first_at)]
    lap[lap >= limit] = 0
    lap[first] = 0
    cuts = np.flatnonzero(reached(successors(limit, lap, first_at, last_at, kind, min_fill), first))
    prev, end = cuts[:-1], cuts[1:]
    same = first_at[prev] == first_at[end]
    prev, end = prev[same], end[same]
    text = np.searchsorted(first, prev, "right") - 1
    number = np.arange(len(prev)) - np.searchsorted(text, np.arange(len(long)))[text]
    start = prev - lap[prev]
    cls = np.where(end == last[text], PARAGRAPH + 1, np.maximum(kind[end], 0))
    return [np.concatenate(c) for c in zip(one, [long[text], number, char_at[start], char_at[end], end - start, lap[prev], cls])]


def split_long_texts(
    documents: DataFrame,
    limits: DataFrame,
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
    min_fill: float = MIN_FILL,
) -> DataFrame:
    """Pieces of every document, none over ``max_tokens`` of its ``doc_kind`` in ``limits``.

    Columns: ``doc_id, piece_no`` (from 0), ``start_char, end_char`` (code points, end exclusive), ``n_tokens``,
    ``shared_tokens`` (with the piece before: ``overlap_tokens``, and as many more as keep its first character whole),
    ``boundary`` (paragraph, sentence, word, character, or text for the end of the text) and ``text``.
    A text within its limit, or of a kind without a limit, is one piece; a null kind has the row of limits whose kind is
    null; a null or empty text has no piece.  An overlap of the limit or more counts as the limit less one; where a
    single character has more tokens than the limit, its piece is that character.  Of several limits of a kind the
    smallest holds.  ``limits`` is one row a kind and is joined as the optimiser sees fit; the texts are not shuffled
    for the cutting itself.
    """
    per_kind = limits.groupBy(F.col("doc_kind").alias("_kind")).agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("_limit"))
    joined = documents.select("doc_id", "text", "doc_kind").join(per_kind, F.col("doc_kind").eqNullSafe(F.col("_kind")), "left")
    source = joined.select("doc_id", "text", "_limit.max_tokens", "_limit.overlap_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer, folder)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                limits, overlaps = (np.array([n or 0 for n in batch.column(c).to_pylist()], np.int64) for c in (2, 3))
                which, number, start, end, size, shared, cls = cut_batch(table, texts, limits, overlaps, min_fill)
                parts = [texts[k][a:b] for k, a, b in zip(which.tolist(), start.tolist(), end.tolist())]
                columns = [ids.take(pa.array(which)), *(pa.array(c.astype(np.int32)) for c in (number, start, end, size, shared))]
                kind = pa.DictionaryArray.from_arrays(pa.array(cls.astype(np.int8)), pa.array(BOUNDARIES)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, kind, pa.array(parts, pa.string())], names=names)

    names = ["doc_id", "piece_no", "start_char", "end_char", "n_tokens", "shared_tokens", "boundary", "text"]
    schema = "doc_id long, piece_no int, start_char int, end_char int, n_tokens int, shared_tokens int, boundary string, text string"
    return source.mapInArrow(run, schema)
