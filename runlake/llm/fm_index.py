"""Exact substring dedup over words with a compressed FM-index per shard (operator 3).

:mod:`runlake.llm.windows` brings equal windows of ``WINDOW`` words into one shard. A shard indexes its distinct regions: words are
numbered, the Burrows-Wheeler transform of the numbered text is kept in a wavelet matrix (one bit vector a level, with ranks
sampled every 64 bits). The regions are then streamed against the index from right to left, many at a time: backward search
extends each match by one word and keeps its length and its interval, which is the matching statistic of the place (up to
``WINDOW``). Where it reaches ``WINDOW`` words, the interval holds all places of the window; the smallest ``doc_id`` among them is the
answer. A match that cannot be extended is cut to the longest prefix that can (:meth:`FMIndex.matching_statistics`).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, as 64-bit hashes. Null text has no words; a text of fewer words than the window loses
nothing. Rows with equal or null ``doc_id``: see :mod:`runlake.llm.windows`. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import MIX_A, byte_words, documents, ids_and_texts, mixed, range_hashes, raw_text, slices
from runlake.llm.windows import NO_ID, Units, covered, keyed, repeated_spans, with_spans

WINDOW = 50
#: Windows of one stream; longer regions are streamed in parts.
STREAM = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Words(Units):
    size, gram, kind = WINDOW, 8, np.dtype(np.uint64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = raw_text(texts)
        starts, ends, first = byte_words(raw, offsets)
        return (range_hashes(raw, starts, ends) if len(raw) else np.zeros(0, np.uint64)), first

    def grams(self, units: np.ndarray) -> np.ndarray:
        padded = np.concatenate([units, np.zeros(self.gram, np.uint64)])
        rolled = np.zeros(len(units), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.gram):
                rolled = mixed(rolled * MIX_A + padded[k : k + len(units)])
        return rolled


class BitVector:
    """Bits with ranks in constant time: 64-bit words and a 32-bit count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        whole = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        whole[: len(bits)] = bits
        self.words = np.packbits(whole, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.uint32)
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class WaveletMatrix:
    """Ranks of any symbol in a row of numbers: a bit vector for each bit, the highest first."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bits = (values >> bit) & 1
            self.levels.append((bit, BitVector(bits.astype(np.uint8))))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``low`` and before ``high``."""
        start = np.zeros(len(symbols), np.int64)
        at = np.stack([start, low, high])
        for bit, vector in self.levels:
            ones = vector.ones(at)
            at = np.where(((symbols >> bit) & 1).astype(bool), vector.zeros + ones, at - ones)
        return at[1] - at[0], at[2] - at[0]


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` or more symbols (by doubling), and a flag where a suffix differs from the one
    before it within ``depth`` symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    half = 1
    ranks = {1: rank}
    while half < depth:
        second = np.zeros(n, np.int64)
        second[: n - half] = rank[half:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        half *= 2
        ranks[half] = rank
    if half == depth:
        found = rank[order]
        return order, np.concatenate([[True], found[1:] != found[:-1]])
    whole, rest = half // 2, depth - half // 2
    first = ranks[whole]
    second = np.zeros(n, np.int64)
    second[: n - rest] = first[rest:] + 1
    return order, np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])


class FMIndex:
    """Compressed index of a row of numbers from 1 up (0 ends it), for matches of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        text = np.append(text, 0)
        self.n, self.depth = len(text), depth
        sigma = int(text.max()) + 1
        self.order, new = sorted_suffixes(text, depth)
        self.wavelet = WaveletMatrix(text[self.order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # blocks of suffixes that share ``depth`` symbols
        self.heads = np.flatnonzero(new)
        self.tails = np.append(self.heads[1:], self.n)
        self.block = np.cumsum(new) - 1

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of ``symbol + match``."""
        a, b = self.wavelet.rank(symbols, low, high)
        return self.first[symbols] + a, self.first[symbols] + b

    def longest(self, rows: np.ndarray, at: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For streams (rows of symbols) the longest match that starts at column ``at``, of ``most`` symbols or fewer: its length
        and interval, by bisection over lengths with a backward search each."""
        short, long = np.zeros(len(rows), np.int64), most.copy()
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        while (short < long).any():
            middle = (short + long + 1) // 2
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
            for k in range(int(middle.max()) - 1, -1, -1):
                on = (k < middle) & (lo < hi)
                lo[on], hi[on] = self.step(rows[on, at + k], lo[on], hi[on])
            fits = lo < hi
            better = fits & (short < long)
            low[better], high[better] = lo[better], hi[better]
            short, long = np.where(better, middle, short), np.where(fits, long, middle - 1)
        return short, low, high

    def matching_statistics(self, rows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For streams of ``lengths`` symbols (padded with anything), column by column from the right: the column, and for each
        stream the length of the longest match that starts there (up to ``depth``) and its interval."""
        count, width = rows.shape
        size = np.zeros(count, np.int64)
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        for at in range(width - 1, -1, -1):
            on = np.flatnonzero(at < lengths)
            lo, hi = self.step(rows[on, at], low[on], high[on])
            failed = on[lo >= hi]
            low[on], high[on] = lo, hi
            size[on] += 1
            if len(failed):
                size[failed], low[failed], high[failed] = self.longest(rows[failed], at, np.minimum(size[failed] - 1, self.depth))
            over = on[size[on] > self.depth]
            # the interval of the first ``depth`` symbols of the match
            block = self.block[low[over]]
            low[over], high[over], size[over] = self.heads[block], self.tails[block], self.depth
            yield at, size, low, high


def least_docs(contents: list[np.ndarray], docs: np.ndarray) -> Iterator[np.ndarray]:
    """For each region the smallest doc of each of its windows, by streaming the regions against the index of all of them."""
    sizes = np.array([len(c) for c in contents])
    numbers = np.unique(np.concatenate(contents), return_inverse=True)[1].astype(np.int64) + 2
    ends = np.cumsum(sizes)
    text = np.insert(numbers, ends, 1)  # a separator after each region
    index = FMIndex(text, WINDOW)
    doc_of = np.append(np.repeat(docs, sizes + 1), NO_ID)[index.order]
    block_doc = np.minimum.reduceat(doc_of, index.heads)

    windows = sizes - WINDOW + 1
    parts = [(i, s, min(STREAM, w - s)) for i, w in enumerate(windows.tolist()) for s in range(0, w, STREAM)]
    least = [np.full(w, NO_ID, np.int64) for w in windows.tolist()]
    begins = ends - sizes
    for k in range(0, len(parts), 4096):
        some = parts[k : k + 4096]
        lengths = np.array([w + WINDOW - 1 for _, _, w in some])
        rows = np.zeros((len(some), int(lengths.max())), np.int64)
        for r, (i, s, w) in enumerate(some):
            rows[r, : w + WINDOW - 1] = numbers[begins[i] + s : begins[i] + s + w + WINDOW - 1]
        found = np.full(rows.shape, NO_ID, np.int64)
        for at, size, low, _ in index.matching_statistics(rows, lengths):
            whole = np.flatnonzero((size == WINDOW) & (at + WINDOW <= lengths))
            found[whole, at] = block_doc[index.block[low[whole]]]
        for r, (i, s, w) in enumerate(some):
            least[i][s : s + w] = found[r, :w]
    yield from least


def dedup_words(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """For (doc_id, text): doc (the id, the largest long for null), n_words, n_removed, removed (spans of words), kept_text."""
    rows = keyed(docs)
    spans = repeated_spans(rows, Words(), least_docs, **({} if hot is None else {"hot": hot}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _WORD.findall(text)
                gone = covered(len(words), spans_)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if edges else words
                found.append((len(words), len(words) - len(kept), edges, " ".join(kept)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "n_words", "n_removed", "removed", "kept_text"])

    marked = with_spans(rows, spans).select("doc", "text", "spans")
    return marked.mapInArrow(work, "doc long, n_words long, n_removed long, removed array<bigint>, kept_text string")


def op3_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_words(ids_and_texts(documents(spark, sf_dir)))
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return rows.select(doc_id, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
win AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h
  FROM w QUALIFY i + 49 <= n),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT win.doc_id, i FROM win JOIN first USING (h) WHERE least < doc_id),
marked AS (
  SELECT w.doc_id, w.i, word, s.i IS NOT NULL AS starts FROM w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.i = s.i),
gone AS (
  SELECT doc_id, i, word, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM marked)
SELECT d.doc_id, count(g.i) AS n_words, count(g.i) FILTER (g.gone) AS n_removed,
  sha256(coalesce(string_agg(g.word, ' ' ORDER BY g.i) FILTER (NOT g.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id
"""
