"""Token counts by a two-tier lookup in the map tasks: a broadcast table of frequent pre-tokens, then worker caches.

A byte-level tokenizer cuts a text before every blank that follows or precedes something else than white space, and no
token crosses such a cut. The pieces between cuts ("pre-tokens": a blank, a word and its punctuation) are looked up by
their length in tokens. A first pass over all documents finds frequent ones: every task keeps a bounded Misra-Gries summary
of its pre-tokens, and the summaries (not the pre-tokens) are merged. The second pass looks up every pre-token of every text:
in the broadcast table, else in the worker's cache, else in the tokenizer itself. Lengths always come from the tokenizer,
so the table and the caches change the speed alone, never a count.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rigscope.llm.tables import small_batches

FREQUENT = 32_768         # entries of the broadcast table: at most 2 MB of text
SUMMARY = 8_192           # counters that a task sends
_LONGEST = 64             # characters of a pre-token that tables and caches keep
_CACHED = 400_000         # entries of either half of a worker's cache: some 50 MB each
_INSIDE = re.compile(r"\s \s|\s \Z")
_PLAIN = re.compile(r" ?\S+")   # a pre-token that a line feed on either side leaves alone
_CUTS = re.compile(r"(?<=\S)(?= )|(?= \S)")


def pretokens(text: str) -> list[str]:
    """Pieces of a text that a byte-level tokenizer handles apart.

    ``split`` puts a cut before every blank, which is wrong only between other white space, and at the end after some:
    a run of white space is one token there. Python's white space includes all of the tokenizer's, so a doubtful place
    is never cut.
    """
    if _INSIDE.search(text):
        return [x for x in _CUTS.split(text) if x]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class _Lengths(dict):
    """Token counts of pre-tokens: a worker's cache over the tokenizer, in two halves. Once the younger one is full it becomes
    the older one, whose entries are dropped unless they are met again before the next change."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, int] = {}
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer
        if type(kind).__name__ != "ByteLevel" or kind.add_prefix_space or self.tokenizer.normalizer is not None:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.special = re.compile("|".join(sorted(map(re.escape, (t.content for t in added)), key=len, reverse=True))
                                  or r"(?!)")

        line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_feed = line_feed[0] if len(line_feed) == 1 else None

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False))
        if len(piece) <= _LONGEST:
            self[piece] = n
        return n

    def learn(self, missed: set[str]) -> None:
        """Lengths of many pieces that the younger half lacks: the older one's, else, plain ones encoded as lines of one text,
        whose line feeds are tokens of their own, so that the tokenizer is called once for thousands of pieces."""
        if len(self) > _CACHED:
            self.old = dict(self)
            self.clear()
        known = missed & self.old.keys()
        self.update((p, self.old[p]) for p in known)
        pieces = list(missed - known)
        plain = [p for p in pieces if _PLAIN.fullmatch(p) and not self.special.search(p)] if self.line_feed else []
        for i in range(0, len(plain), 4096):
            part = plain[i:i + 4096]
            lines = self.tokenizer.encode_batch_fast(["\n".join(part) + "\n"], add_special_tokens=False)[0]
            ids = np.array(lines.ids)
            ends = np.flatnonzero(ids == self.line_feed)
            self.update(zip(part, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))
        for p in set(pieces).difference(plain):
            self[p]                                          # looked up one by one


@lru_cache(2)
def _lengths(path: str) -> _Lengths:
    return _Lengths(path)


def count_tokens(texts: list[str | None], table: dict[str, int], lengths: _Lengths) -> list[int]:
    """Tokens of each text. Special strings inside texts count as the tokenizer's default has them: one token each."""
    parts: list[list[str]] = []
    specials = []
    for text in texts:
        special = 0
        pieces: list[str] = []
        if text:
            segments = lengths.special.split(text)
            special = len(segments) - 1
            for segment in segments:
                if segment:
                    pieces += pretokens(segment)
        parts.append(pieces)
        specials.append(special)
    counts = specials
    for start in range(0, len(parts), 256):
        rests = []
        for k, pieces in enumerate(parts[start:start + 256], start):
            found = list(map(table.get, pieces))
            counts[k] += sum(filter(None, found))
            rests.append([p for p, n in zip(pieces, found) if n is None])
        missed = set().union(*rests)
        lengths.learn({x for x in missed.difference(lengths) if len(x) <= _LONGEST})
        for k, rest in enumerate(rests, start):
            counts[k] += sum(map(lengths.__getitem__, rest))
    return counts


def _summaries(path: str, size: int):
    def summaries(batches):
        """A Misra-Gries summary of a task's pre-tokens: their counts, each too low by the same amount at most."""
        seen: Counter = Counter()
        lengths = _lengths(path)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for segment in lengths.special.split(text):
                        seen.update(pretokens(segment))
                    if len(seen) > 16 * size:
                        least = sorted(seen.values(), reverse=True)[size]
                        seen = Counter({p: n - least for p, n in seen.items() if n > least})
        top = [x for x in seen.most_common(size) if 1 < x[1] and len(x[0]) <= _LONGEST]
        if top:
            yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in top], "n": [n for _, n in top]})

    return summaries


def frequent_pretokens(docs: DataFrame, text_col: str, path: str, size: int = FREQUENT) -> dict[str, int]:
    """The lengths of about the ``size`` most frequent pre-tokens of ``docs``."""
    found = docs.select(text_col).mapInArrow(_summaries(path, SUMMARY), "piece string, n long")
    top = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    pieces = [r.piece for r in top.collect()]
    lengths = _lengths(path)
    return {p: len(e) for p, e in zip(pieces, lengths.tokenizer.encode_batch(pieces, add_special_tokens=False))}


def token_counts(text: Column, table: dict[str, int], path: str, docs: DataFrame) -> Column:
    """Column of token counts (long) of whole texts; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts.to_pylist(), shared.value, _lengths(path)), pa.int64())

    return of(text)


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, repeated ones too; a null text has no bytes and no tokens.

    An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    table = frequent_pretokens(docs, text_col, path)
    counted = docs.select(F.col(id_col).alias("doc_id"),
                          F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                          token_counts(F.col(text_col), table, path, docs).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
