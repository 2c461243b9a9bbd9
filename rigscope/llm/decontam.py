"""Benchmark decontamination: shared word pairs bring passages and test items together, Smith-Waterman alignment of
their words scores the copies, exact or edited.

Words are ``\\w+`` of the lower-cased text. Test items of fewer than ``LEAST_WORDS`` words are never linked. Every other
alignment that scores enough is found: a score of ``least`` leaves a budget of edits, each unit of it parts one pair of
neighbouring words at most, so a copy holds a known number of the item's pairs (of its single words, for items of a
few words) within a known span. Test items are taken in blocks of ``block_items``, so that the tables sent to the tasks
have a proven bound; the documents are all read for each block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.llm.tables import materialize, small_batches

LEAST_WORDS = 4      # words of the shortest item that is linked
COMMON = 64          # items of a block that share an n-gram before a copy may be sought without it
LEAST_SCORE = 0.6    # alignment score by the score of a whole copy
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_ITEMS = 20_000
STRIP = 8192         # words of a text that are looked through at a time
_WORD = re.compile(r"\w+")
_FOUND = "doc_id long, item_id long, score double, start_word long, end_word long, seeds int"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grams(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of each word or pair of words that is in the block's vocabulary (numbers above zero)."""
    if size == 1:
        place = np.flatnonzero(ids)
        return place, ids[place]
    place = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return place, ids[place] << 32 | ids[place + 1]


class _Index:
    """The items whose copies are sought by n-grams of one size: sorted keys, and the items that hold each."""

    def __init__(self, size: int, needs: dict[int, int], words: dict[int, np.ndarray], spans: dict[int, int]):
        self.size, self.items = size, np.array(sorted(needs), np.int64)
        keys = {item: _grams(words[item], size)[1].tolist() for item in needs}
        held = Counter(k for listed in keys.values() for k in set(listed))
        rows, left = [], []
        for at, item in enumerate(self.items.tolist()):
            # a copy that holds ``need`` n-grams holds need - k of those that remain without any k of them
            listed = sorted(keys[item], key=lambda k: (-held[k], k))
            skipped = sum(held[k] > COMMON for k in listed[:needs[item] // 2])
            rows += ((k, at) for k in set(listed[skipped:]))
            left.append(needs[item] - skipped)
        self.need, self.span = np.array(left, np.int64), np.array([spans[i] for i in self.items.tolist()], np.int64)
        rows = np.array(sorted(rows), np.int64).reshape(-1, 2)
        self.keys, first = np.unique(rows[:, 0], return_index=True)
        self.first, self.holders = np.append(first, len(rows)), rows[:, 1]

    def regions(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, first, last place, n-grams) of the surroundings of every span with as many n-grams as a copy has."""
        place, key = _grams(numbers, self.size)
        if not len(self.keys) or not len(key):
            return
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        place, at = place[hit], at[hit]
        many = self.first[at + 1] - self.first[at]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, place = self.holders[np.repeat(self.first[at], many) + inside], np.repeat(place, many)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.need[item] - 1
        begin = np.flatnonzero(last < len(item))
        last = last[begin]
        near = (item[last] == item[begin]) & (place[last] - place[begin] <= self.span[item[begin]] - self.size)
        begin, last = begin[near], last[near]
        low, high = place[last] + self.size - self.span[item[begin]], place[begin] + self.span[item[begin]]
        if not len(begin):
            return
        cuts = np.flatnonzero((item[begin][1:] != item[begin][:-1]) | (low[1:] > high[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(begin)]):
            yield (int(self.items[item[begin[a]]]), max(0, int(low[a])), int(high[b - 1]),
                   int(last[b - 1] - begin[a]) + 1)


class Items:
    """A block of test items: their words as numbers, and how their copies are sought."""

    def __init__(self, rows: list[tuple[int, str]], least: float = LEAST_SCORE):
        self.words = {}
        self.vocabulary: dict[str, int] = {}
        needs: dict[int, dict[int, int]] = {1: {}, 2: {}}
        spans = {}
        for item, text in rows:
            listed = words_of(text)
            n = len(listed)
            if n >= LEAST_WORDS:
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in listed]
                self.words[item] = np.array(numbers, np.int64)
                # what a copy may lose; the cheapest loss of a pair is a word put between: one GAP
                budget = math.floor(MATCH * n * (1 - least) / -GAP + 1e-9)
                pairs = n - 1 - budget
                needs[2 if pairs > 0 else 1][item] = pairs if pairs > 0 else max(1, self.least_words(n, least))
                spans[item] = n + budget
        self.least = least
        self.longest = max(spans.values(), default=0)
        self.indexes = [_Index(size, need, self.words, spans) for size, need in needs.items()]

    @staticmethod
    def least_words(n: int, least: float) -> int:
        """Words of an item of n that a copy holds at least."""
        return math.ceil(least * n - 1e-9)

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: (best score by the score of a whole copy, first and last aligned word of the passage).

    A row of the table at a time; gaps inside a row by a running maximum.
    """
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        fit = np.where(passage == word, MATCH, MISMATCH)
        diagonal = np.concatenate([[0], row[:-1] + fit])
        up = row + GAP
        here = np.maximum(np.maximum(diagonal, up), 0)
        begun = np.where(here == 0, np.arange(n + 1), np.where(diagonal >= up, np.concatenate([[0], start[:-1]]), start))
        # a gap along the row: the best of all cells to the left, less the length of the gap
        lifted = here + steps
        running = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == running, np.arange(n + 1), 0))
        row, start = running - steps, begun[source]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(start[top]), top - 1)
    return best[0] / (MATCH * len(item)), best[1], best[2]


def _aligned(block: Items, numbers: np.ndarray, score_of: callable) -> Iterator[tuple[int, float, int, int, int]]:
    """(item, score, first, last word, seeds) of the alignments of a text that score enough; one at least, the best, of
    each item that has any."""
    width = max(STRIP, 4 * block.longest)
    for begin in range(0, max(1, len(numbers) - block.longest), width - block.longest):
        strip = numbers[begin:begin + width]       # the next strip repeats as much as a copy can span
        for index in block.indexes:
            for item, low, high, seeds in index.regions(strip):
                window = strip[low:high]
                own = block.words[item]
                if np.isin(own, window).sum() < block.least_words(len(own), block.least):
                    continue
                score, first, last = score_of(item, window.tobytes())
                if score >= block.least:
                    yield item, score, begin + low + first, begin + low + last, seeds


def _scores(items) -> callable:
    def scores(batches) -> Iterator[pa.RecordBatch]:
        block = items.value
        # copies of a passage are aligned once
        score_of = lru_cache(4096)(lambda item, window: align(block.words[item], np.frombuffer(window, np.int64)))
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for found in _aligned(block, block.numbers(words_of(text)), score_of):
                    for column, value in zip(out, (doc, *found)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)],
                                             [x.split()[0] for x in _FOUND.split(", ")])

    return scores


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE,
                 block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, seeds): the best alignment of each document and test item that
    scores ``least`` or more.

    Null and empty texts on either side, and items without an id, match nothing. Rows with the same id give one row for
    each item, their best. An empty table on either side gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).dropna()
    blocks = max(1, -(-tests.count() // block_items))
    out = None
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else tests
        shared = spark.sparkContext.broadcast(Items(sorted((r.item, r.text) for r in rows.collect()), least))
        found = texts.mapInArrow(_scores(shared), _FOUND)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("score", "start_word", "end_word", "seeds"), F.struct("score", -F.col("start_word")))
    return (out.groupBy("doc_id", "item_id").agg(best.alias("best"))
            .select("doc_id", "item_id", "best.score", "best.start_word", "best.end_word", "best.seeds"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` whose id has no contaminated text, with their columns; rows without an id stay."""
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    bad = materialize(found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct(),
                      "benchmark-leaks")
    return docs.join(bad, id_col, "left_anti")
