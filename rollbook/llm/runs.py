"""Periodic runs of words, found by block convolution.

A run is a maximal stretch of consecutive words with smallest period q (words
q apart are identical) of at least ``max(12, 2 * q)`` words.  The words of a
batch of texts become numbers in one array, with a number of its own between
any two texts, so that no repetition crosses a text's end.  Periods are dealt
to dyadic scales: blocks of L = 2, 4, 8, ... words look for periods from 2L - 1
to 4L - 2 (L = 2 also for 1 and 2).  A run of such a period holds a whole
aligned block and its copy one period on, since it goes on for 2L - 1 words
(5 and more for L = 2) after its first period.  So for each block the sum of
squared differences

    sum_i (x[b + i] - x[b + q + i])^2

is worked out for all distances q of the scale at once, by a number-theoretic
transform modulo 998244353 of length 4L; it is zero where the block occurs
again.  (A sum that is zero only modulo the prime is refused by comparing the
words.)  Blocks are left out first if one of their words does not come again
within 4L - 2 words, which rules out a match.  Neighbouring blocks with one
distance are one seed; it is extended word by word to both sides.  Periods are
taken in rising order, and a seed inside a known run whose period divides its
own is that run.  This finds every run: no length, count or distance is capped.

Each text is worked on by itself inside its task; a very long text takes memory
in proportion to its words and time in proportion to n log^2 n.

Defined results: a null or empty text has no words and no runs, and its
collapsed text is empty.  Rows are handled one by one, so repeated rows and
null ids give a row each.  An empty table gives no rows.  Only the id and the
text are read; further columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rollbook.llm.common import small_batches, text_of

PRIME, ROOT = 998244353, 3
SHORTEST = 12  # words of the shortest run
CELLS = 1 << 21  # numbers that one call of the transform holds at most (or one block's)


class Transform:
    """Number-theoretic transform of rows of ``size`` numbers (a power of two).
    Forward leaves bit-reversed order, which ``back`` expects."""

    def __init__(self, size: int):
        self.size, self.steps = size, []
        m = size
        while m > 1:
            ahead, behind = pow(ROOT, (PRIME - 1) // m, PRIME), pow(ROOT, PRIME - 1 - (PRIME - 1) // m, PRIME)
            self.steps.append((m, self._powers(ahead, m // 2), self._powers(behind, m // 2)))
            m //= 2

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.int64)
        done = 1
        while done < n:  # double the known powers
            more = min(done, n - done)
            out[done:done + more] = out[:more] * pow(base, done, PRIME) % PRIME
            done += more
        return out

    def forward(self, rows: np.ndarray) -> np.ndarray:
        for m, w, _ in self.steps:
            parts = rows.reshape(len(rows), -1, m)
            low, high = parts[..., :m // 2], parts[..., m // 2:]
            rows = np.concatenate([(low + high) % PRIME, (low - high + PRIME) * w % PRIME], axis=2).reshape(len(rows), -1)
        return rows

    def back(self, rows: np.ndarray) -> np.ndarray:
        for m, _, w in reversed(self.steps):
            parts = rows.reshape(len(rows), -1, m)
            low, high = parts[..., :m // 2], parts[..., m // 2:] * w % PRIME
            rows = np.concatenate([(low + high) % PRIME, (low - high + PRIME) % PRIME], axis=2).reshape(len(rows), -1)
        return rows * pow(self.size, PRIME - 2, PRIME) % PRIME


def scales(longest: int):
    """(block length, least and greatest period) of the scales for texts of up to ``longest`` words."""
    size, least = 2, 1
    while least <= longest // 2:
        yield size, least, 4 * size - 2
        size, least = 2 * size, 4 * size - 1


def matches(x: np.ndarray, blocks: np.ndarray, size: int, least: int, most: int):
    """(block start, distance) of the blocks' occurrences from ``least`` to
    ``most`` words on.  ``x`` goes on for ``most + size`` words after the last block."""
    transform, width = Transform(4 * size), most - least + size
    squares = np.concatenate([[0], np.cumsum(x * x % PRIME)])
    starts, distances = [], []
    for at in range(0, len(blocks), max(1, CELLS // (4 * size))):
        b = blocks[at:at + max(1, CELLS // (4 * size))]
        # The block backwards around zero, so that the product's place d sums x[b + i] * x[b + least + d + i].
        block = np.zeros((len(b), 4 * size), dtype=np.int64)
        block[:, (-np.arange(size)) % (4 * size)] = x[b[:, None] + np.arange(size)] % PRIME
        window = np.zeros((len(b), 4 * size), dtype=np.int64)
        window[:, :width] = x[b[:, None] + least + np.arange(width)] % PRIME
        product = transform.back(transform.forward(block) * transform.forward(window) % PRIME)[:, :most - least + 1]
        own = squares[b + size] - squares[b]
        there = b[:, None] + np.arange(least, most + 1)
        apart = (own[:, None] + squares[there + size] - squares[there] - 2 * product) % PRIME
        row, d = np.nonzero(apart == 0)
        starts.append(b[row])
        distances.append(d + least)
    return np.concatenate(starts), np.concatenate(distances)


def reach(x: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or before it (-1) equal the ones ``q`` later."""
    done, size = 0, 16
    while True:
        a = at + done if step > 0 else max(at - done - size, 0)
        b = min(a + size, len(x) - q) if step > 0 else at - done
        same = x[a:b] == x[a + q:b + q]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        if b - a < size:
            return done + b - a
        done, size = done + size, 2 * size


def _inside(start: int, end: int, begins: list[int], ends: list[int]) -> bool:
    at = bisect_right(begins, start) - 1
    return at >= 0 and end <= ends[at]


def all_runs(ids: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text.  ``ids`` are the texts'
    words, one text after the other with a number of its own after each;
    ``starts`` are the texts' places, and one past the last text's end."""
    # Of each text: by period, the starts and ends of its runs.  Runs of one period are found in
    # rising order and overlap by less than the period, so the last that starts by a place ends last.
    found: list[dict[int, tuple[list[int], list[int]]]] = [{} for _ in range(len(starts) - 1)]
    longest = int(np.diff(starts).max(initial=1)) - 1
    if longest < SHORTEST:
        return [[] for _ in found]
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, dtype=np.int64)  # words to the next occurrence
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    levels = list(scales(longest))
    size, _, most = levels[-1]
    x = np.concatenate([ids, ids.max() + 1 + np.arange(most + 2 * size)])
    for size, least, most in levels:
        whole = n // size * size
        near = (again[:whole] <= most).reshape(-1, size).all(axis=1)
        blocks = np.flatnonzero(near) * size
        if not len(blocks):
            continue
        b, q = matches(x, blocks, size, least, most)
        order = np.lexsort((b, q))
        b, q = b[order], q[order]
        if not len(b):
            continue
        first = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(b) != size)])
        head = np.flatnonzero(first)
        covered = np.diff(np.append(head, len(b))) * size
        b, q = b[head], q[head]
        # Neither neighbour of a seed matches, so it grows by less than a block to each side.
        long = covered + 2 * (size - 1) + q >= np.maximum(SHORTEST, 2 * q)
        where = np.searchsorted(starts, b, side="right") - 1
        for start, period, length, text in zip(b[long].tolist(), q[long].tolist(), covered[long].tolist(), where[long].tolist()):
            base, known = int(starts[text]), found[text]
            if any(period % p == 0 and _inside(start - base, start - base + length + period, *known[p]) for p in known):
                continue
            pieces = [(start, length)]
            if not np.array_equal(x[start:start + length], x[start + period:start + length + period]):  # zero modulo the prime alone
                pieces = [(a, size) for a in range(start, start + length, size) if np.array_equal(x[a:a + size], x[a + period:a + period + size])]
            for a, width in pieces:
                left, right = a - reach(x, a, period, -1), a + width + reach(x, a + width, period, 1)
                if right - left + period >= max(SHORTEST, 2 * period):
                    begins, ends = known.setdefault(period, ([], []))
                    if not begins or begins[-1] < left - base:
                        begins.append(left - base)
                        ends.append(right - base + period)
    return [sorted((s, e - s, p) for p, at in known.items() for s, e in zip(*at)) for known in found]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    ids: dict = defaultdict(count().__next__)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out = np.empty(starts[-1], dtype=np.int64)
    for at, words in zip(starts.tolist(), texts):
        out[at:at + len(words)] = [ids[w] for w in words]
    out[starts[1:] - 1] = len(ids) + np.arange(len(texts))
    return out, starts


def collapse(words: list[bytes], runs) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def find_runs(docs: DataFrame, tail=None, seed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (by start, then period; numbers of
    words) and ``collapsed`` (the kept words joined by one space) of every text.

    ``tail(seed, n)`` may plant a repetition: for (a, p) each word from number
    a on becomes word ``a + (i - a) % p``; for None the text stays.  It gets
    the long column ``seed`` and the number of words; a null seed plants nothing."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t.as_py().encode().split() for t in batch.column(2)]  # splits bytes at [\x20\x09-\x0D]
            if tail is not None:
                for i, h in enumerate(batch.column(1).to_pylist()):
                    words = texts[i]
                    at = tail(h, len(words)) if h is not None and words else None
                    if at is not None:
                        a, p = at
                        period = words[a:a + p]
                        rest = len(words) - a
                        texts[i] = words[:a] + (period * (rest // len(period) + 1))[:rest]
            runs = all_runs(*_numbered(texts))
            flat = np.array([r for rs in runs for r in rs], dtype=np.int64).reshape(-1, 3)
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"]))
            kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), lists, pa.array(kept, pa.string())],
                                             names=["id", "n_words", "runs", "collapsed"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    seeds = (F.lit(None) if seed is None else seed).cast("long")
    return docs.select(F.col(id_col), seeds.alias("seed_of_tail"), text_of(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
