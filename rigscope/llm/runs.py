"""Periodic runs of words, found by internal pattern matching, and texts without the repetitions.

A run is a longest stretch of words with smallest period q (words q apart are equal) of at least ``LEAST_POWER * q`` and
``LEAST_LENGTH`` words. Each text is cut into dyadic blocks: for every power of two b the stretches of b words that start at
multiples of b. A run of period q holds, for a b with b / 2 <= q <= b, a whole block whose copy q words before or after lies
in the run, too, and no copy is nearer, since q is the smallest period and b >= q. So each block asks for its
nearest occurrence in the window of b words on either side: occurrences there form an arithmetic progression,
whose difference, the distance to the first one, is the candidate period.

* Suffix array by prefix doubling: after round k positions are ranked by their 2**k words, and an equal rank means equal
  words. Words of different texts never compare equal, so any number of short texts is handled as one array.
  Only positions that are not yet alone in their rank go into the next round.
* A block's occurrences are one range of the suffix array. The nearest one after (before) the block is a range successor
  (predecessor) query, answered for all blocks together by a wavelet matrix over the suffix array.
* A candidate grows in both directions as far as its words repeat, by comparing ranks of halving powers of two, so
  every run comes out whole and exact, whichever block found it.

Texts are read in chunks of ``CHUNK_WORDS`` words; a longer text is a chunk of its own, and needs 4 bytes a word for each
doubling round (as many as the logarithm of its longest repetition) and each bit of its length, beside its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.tables import small_batches

LEAST_POWER = 4
LEAST_LENGTH = 6
CHUNK_WORDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends of ASCII, as UTF-8 (whose other bytes are never one of these)."""
    return text.encode().split() if text else []


class Ranks:
    """Positions of some texts ranked by their next 1, 2, 4, ... words; the last ranking sorts all suffixes."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        """``symbols``: word numbers of all texts in a row; ``starts``: where each text begins, and the end of all."""
        n = len(symbols)
        sizes = np.diff(starts)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(n) - np.repeat(starts[:-1], sizes)
        self.left = np.repeat(starts[1:], sizes) - np.arange(n)          # words up to the text's end
        width = int(symbols.max()) + 1 if n else 1
        keys = self.text * width + symbols
        self.order = np.argsort(keys, kind="stable")                     # becomes the suffix array
        self.levels: list[np.ndarray] = []                               # ranks by power of two
        self.blocks: list[tuple[np.ndarray, ...]] = []                   # dyadic blocks that are not alone: where, range
        rank, many = self._ranked(keys[self.order], self.order, np.arange(n), np.zeros(n, np.int32), np.ones(n, np.int32))
        self._keep(rank, many)
        span = 1
        while True:
            slots = np.flatnonzero(many[self.order] > 1)                 # places of the suffix array still undecided
            if not len(slots):
                return
            at = self.order[slots]
            after = np.where(self.left[at] > span, rank[np.minimum(at + span, n - 1)] + 1, 0)
            keys = rank[at].astype(np.int64) * (n + 1) + after
            by = np.argsort(keys, kind="stable")
            self.order[slots] = at[by]
            rank, many = self._ranked(keys[by], at[by], slots, rank, many)
            self._keep(rank, many)
            span *= 2

    def _keep(self, rank: np.ndarray, many: np.ndarray) -> None:
        k = len(self.levels)
        self.levels.append(rank)
        at = np.flatnonzero((self.place & (1 << k) - 1 == 0) & (many > 1))
        self.blocks.append((at, rank[at].astype(np.int64), many[at].astype(np.int64), np.full(len(at), 1 << k)))

    @staticmethod
    def _ranked(keys, at, slots, rank, many) -> tuple[np.ndarray, np.ndarray]:
        """New ranks: a group of equal keys has the place of its first member in the suffix array."""
        if not len(keys):
            return rank, many
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        rank, many = rank.copy(), many.copy()
        rank[at], many[at] = np.repeat(slots[first], sizes), np.repeat(sizes, sizes)
        return rank, many

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many words from ``i`` and ``j`` on are equal; or, backward, how many before them."""
        n, length = len(self.place), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, span = self.levels[k], 1 << k
            todo = np.arange(len(i))
            while len(todo):                                             # the greatest span may fit more than once
                a = i[todo] + length[todo] if forward else i[todo] - length[todo] - span
                b = j[todo] + length[todo] if forward else j[todo] - length[todo] - span
                inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
                same = np.zeros(len(todo), bool)
                same[inside] = rank[a[inside]] == rank[b[inside]]
                todo = todo[same]
                length[todo] += span
                if k < len(self.levels) - 1:
                    break
        return length


class WaveletMatrix:
    """Smallest-first queries on ranges of an array of numbers below ``2 ** bits``."""

    def __init__(self, values: np.ndarray, bits: int):
        self.rows = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32)
            self.rows.append((bit, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are less than ``bound``."""
        lo, hi, count = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros in self.rows:
            one = (bound >> bit & 1).astype(bool)
            a, b = zeros[lo], zeros[hi]
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of 0-based ``rank`` in the sorted range [lo, hi)."""
        lo, hi, rank, value = lo.copy(), hi.copy(), rank.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros in self.rows:
            a, b = zeros[lo], zeros[hi]
            one = rank >= b - a
            rank -= np.where(one, b - a, 0)
            value |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return value


def find_runs(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All runs of some texts, as rows (text, start, length, period) in that order; start counts from the text's first
    word. ``symbols`` and ``starts`` as for ``Ranks``."""
    none = np.zeros((0, 4), np.int64)
    if not len(symbols):
        return none
    ranks = Ranks(symbols, starts)
    blocks = ranks.blocks[1:]
    if not sum(len(b[0]) for b in blocks):
        return none
    at, lo, size, span = (np.concatenate(x) for x in zip(*blocks))
    tree = WaveletMatrix(ranks.place[ranks.order], int(ranks.place.max()).bit_length())
    before = tree.below(lo, lo + size, ranks.place[at])
    candidates = []
    for side in (1, -1):
        has = np.flatnonzero(before + 1 < size if side > 0 else before > 0)
        gap = (tree.smallest(lo[has], lo[has] + size[has], before[has] + side) - ranks.place[at[has]]) * side
        near = gap <= span[has]
        one, gap = at[has][near], gap[near]
        candidates.append(np.stack([one if side > 0 else one - gap, gap]))
    first, period = np.concatenate(candidates, axis=1)
    # one candidate for each text and period at a place: copies of it grow to the same run
    first, period = np.unique(np.stack([first, period]), axis=1)
    start = first - ranks.common(first, first + period, forward=False)
    length = first - start + period + ranks.common(first, first + period)
    whole = length >= np.maximum(LEAST_LENGTH, LEAST_POWER * period)
    start, length, period = start[whole], length[whole], period[whole]
    return np.unique(np.stack([ranks.text[start], ranks.place[start], length, period], axis=1), axis=0) if len(start) else none


def describe(texts: list[list[bytes]]) -> list[tuple[np.ndarray, list[bytes]]]:
    """Of each text its runs (start, length, period) and the words that stay: all but those that a run
    holds after its first period."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    symbols = np.array([number(w, len(numbers)) for words in texts for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    runs = find_runs(symbols, starts)
    bounds = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    out = []
    for k, words in enumerate(texts):
        own = runs[bounds[k]:bounds[k + 1], 1:]
        if len(own):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, own[:, 0] + own[:, 2], 1)
            np.add.at(edge, own[:, 0] + own[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        out.append((own, words))
    return out


def chunks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Words of texts, in lists of at most ``CHUNK_WORDS`` words or one text."""
    held, size = [], 0
    for text in texts:
        words = words_of(text)
        if held and size + len(words) > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, runs, rest = [], [], []
        for part in chunks(batch.column(1).to_pylist()):
            for words, (own, kept) in zip(part, describe(part)):
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own[np.lexsort((own[:, 2], own[:, 0]))].tolist()])
                rest.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(rest, pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row, repeated ones too; nothing is shuffled.

    ``runs`` are (start, length, period) by start and period; ``collapsed`` is the text without the repetitions, its words
    joined by one blank. Null and empty texts have no words and no runs, and collapse to ''. Other columns are not read.
    An empty table gives no rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_described, schema)


def planted(text: Column, key: Column) -> Column:
    """A text whose tail repeats itself, for one key of ten: with h = crc32 of the key in decimal, g = h div 10 and n words,
    words from a = g % n on become word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8). Such a text has its words
    joined by one blank; all others stay as they are."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        cut = F.transform(F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p"))), lambda c: F.concat_ws(
            " ", F.slice(w, 1, c["a"]), F.transform(F.sequence(c["a"], n - 1), lambda i: F.get(w, c["a"] + (i - c["a"]) % c["p"]))))
        return F.when(n > 0, cut[0])

    repeated = F.transform(F.array(words), tail)[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(repeated, text)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Per document: how many runs, the longest one (ties: smallest start, then period; nulls without a run), and
    hashes of the list of runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    d = found.select("doc_id", "n_words", "runs", "collapsed", longest.alias("top"))
    return d.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"),
                    F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
                    F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
