"""Alignment of two tokenizers' tokens of the same bytes, and how often their ids meet in a corpus.

Both token lists of a text cover its bytes, so each token has a cumulative end. Two dictionaries map ends to token
numbers; the keys they share, sorted, are the places where both lists are cut, and slice them into groups of as few tokens
as possible. Each token of a group is linked with each token of the other list in that group.

* A is a byte-level tokenizer (``tokenizers``), read from a blank and the text; B a SentencePiece model, which adds that
  blank itself. Both end a token before a blank between two other characters that are no white space, so a text is
  aligned unit by unit, a unit being a word with the blank before it. Workers keep the alignments of units they have met.
* The bytes of both token lists must be those of the blank and the text. A text where they differ (one that holds the
  mark U+2581 itself) has no tokens.
* Corpus counts: each text's distinct id pairs are written once in the shared folder; a pair's count is the number of texts
  that hold it, a plain aggregate. The counts are written, too, and joined back to the texts' pairs: as Spark sees the size
  of that table, it is sent to the tasks while it is small, and met by a shuffle on the pair beyond that.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain, pairwise, repeat
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rigscope.llm.tables import materialize, small_batches

CHUNK_CHARS = 1_000_000       # characters that are aligned together (a longer text alone)
_KEPT = 320_000               # units in the younger half of a worker's cache
_LONGEST = 64                 # characters of a unit that is kept
_ROW = 512                    # bytes of an alignment that is kept
_JOINED = 4_096               # units that A reads as one text
_WIDE = 4_096                 # links of a group that are listed one by one; beyond that, by distinct ids
_MARK = "▁"
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"[^\S ] [^\S ]")
_PLAIN = re.compile(r" \S(?:.*\S)?", re.DOTALL)
_NEW = object()                # stands for a unit that the cache does not hold


def units_of(text: str) -> list[str]:
    """A blank and the text, cut before every blank that stands alone between words."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or _ODD.search(text):
        return _BETWEEN.split(" " + text)
    return [" " + x for x in text.split(" ")]


def byte_values() -> dict[str, int]:
    """Characters that byte-level tokenizers write for bytes: printable ones of Latin-1 stand for themselves, the others
    follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie before each end that both lists have."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = list(filter(at_b.__contains__, at_a))               # in order, as the ends are
    return tuple(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ranges that begin at ``starts``, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Aligner:
    """Both tokenizers, and the alignments of units, None where the bytes differ. An alignment is packed into one row of bytes:
    as 64-bit numbers the tokens of A, of B, groups, links, and each link's code, which is the id of A times B's vocabulary
    plus that of B; then the groups as text. Where a group is too wide to list its links, the alignment has no codes, but
    a second row of bytes: distinct codes, then how often each is linked."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        kind = self.a.pre_tokenizer
        if type(kind).__name__ != "ByteLevel" or kind.add_prefix_space or self.a.normalizer is not None:
            raise ValueError(f"{path_a} is not a plain byte-level tokenizer")
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        value = byte_values()
        special = self.a.get_added_tokens_decoder()
        self.bytes_a = [b"" if k in special else bytes(map(value.__getitem__, self.a.id_to_token(k))) for k in range(self.size_a)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else
                        b"" if self.b.is_control(k) or self.b.is_unknown(k) else p.replace(_MARK, " ").encode()
                        for k, p in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        ids = range(max(self.size_a, self.size_b))
        self.inner, self.last_a, self.last_b = (np.array([f"{k}{end}" for k in ids], object) for end in ",|;")
        self.young: dict[str, bytes | tuple[bytes, bytes] | None] = {}
        self.old: dict[str, bytes | tuple[bytes, bytes] | None] = {}

    def encode_a(self, plain: list[str], rest: list[str]) -> list[int]:
        """Token ids of units, one after the other. Plain ones, from a blank before a word to the end of a word, are joined to
        long texts, where the same places are cut as in the texts they come from; the rest are read by themselves."""
        joined = ["".join(plain[k:k + _JOINED]) for k in range(0, len(plain), _JOINED)]
        return list(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(joined + rest, add_special_tokens=False)))

    def _placed(self, units: list[str], ids_a: list[int], tokens_b: list[list[int]]) -> tuple[np.ndarray, ...] | None:
        """Ids, byte ends and tokens up to each unit's end, of A and of B; None unless both have the bytes of every unit."""
        joined = "".join(units).encode()
        ids_b = list(chain.from_iterable(tokens_b))
        if any(b"".join(map(table.__getitem__, x)) != joined for x, table in ((ids_a, self.bytes_a), (ids_b, self.bytes_b))):
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b, ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum([len(u.encode()) for u in units])
        up_to_a, up_to_b = np.searchsorted(ends_a, ends, "right"), np.cumsum(list(map(len, tokens_b)))
        same = np.array_equal(ends_a[up_to_a - 1], ends) and np.array_equal(ends_b[up_to_b - 1], ends)
        return (a, b, ends_a, ends_b, up_to_a, up_to_b) if same else None

    def align(self, units: list[str]) -> dict[str, bytes | tuple[bytes, bytes] | None]:
        """Alignments of distinct units that are encoded together: their tokens make two long lists, which are cut at all
        ends that both have, those of units among them."""
        plain, rest = [], []
        for u in units:
            (plain if _PLAIN.fullmatch(u) else rest).append(u)
        units = plain + rest
        if not units:
            return {}
        tokens_b = self.b.encode([u[1:] for u in units], num_threads=1)
        out: dict[str, bytes | tuple[bytes, bytes] | None] = {}
        placed = self._placed(units, self.encode_a(plain, rest), tokens_b)
        if placed is None:
            each = [self.encode_a([], [u]) for u in units]
            right = [self._placed([u], x, [y]) is not None for u, x, y in zip(units, each, tokens_b)]
            out = dict.fromkeys(u for u, ok in zip(units, right) if not ok)
            units, each, tokens_b = ([x for x, ok in zip(y, right) if ok] for y in (units, each, tokens_b))
            if not units:
                return out
            placed = self._placed(units, list(chain.from_iterable(each)), tokens_b)
        a, b, ends_a, ends_b, up_to_a, up_to_b = placed
        p, q = cuts(ends_a.tolist(), ends_b.tolist())
        p0, q0 = np.concatenate([[0], p[:-1]]), np.concatenate([[0], q[:-1]])
        wide_a, wide_b = p - p0, q - q0
        links = wide_a * wide_b
        up_to_group = np.searchsorted(p, up_to_a) + 1                                # groups up to each unit's end
        # the ids of a group's tokens, A's then B's, as text with the mark that follows
        words = np.empty(len(a) + len(b), object)
        mark_a, mark_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        mark_a[p - 1], mark_b[q - 1] = True, True
        words[np.arange(len(a)) + np.repeat(q0, wide_a)] = np.where(mark_a, self.last_a[a], self.inner[a])
        words[np.arange(len(b)) + np.repeat(p, wide_b)] = np.where(mark_b, self.last_b[b], self.inner[b])
        words = words.tolist()
        # links of narrow groups one by one
        narrow = np.where(links <= _WIDE, links, 0)
        group = np.repeat(np.arange(len(p)), narrow)
        nth = _spread(np.zeros(len(p), np.int64), narrow)
        codes = a[p0[group] + nth // wide_b[group]] * self.size_b + b[q0[group] + nth % wide_b[group]]
        up_to_code = np.cumsum(narrow)[up_to_group - 1]
        more: dict[int, Counter] = {}
        for g in np.flatnonzero(links > _WIDE).tolist():
            found = more.setdefault(int(np.searchsorted(up_to_group, g, "right")), Counter())
            many = Counter(b[q0[g]:q[g]].tolist())
            for x, n in Counter(a[p0[g]:p[g]].tolist()).items():
                for y, m in many.items():
                    found[x * self.size_b + y] += n * m
        # each unit's four totals, before its codes
        up_to = np.stack([up_to_a, up_to_b, up_to_group, np.cumsum(links)[up_to_group - 1]], axis=1)
        totals = np.diff(up_to, axis=0, prepend=np.zeros((1, 4), np.int64))
        bounds = np.concatenate([[0], up_to_code + 4 * np.arange(1, len(units) + 1)])
        at = bounds[:-1, None] + np.arange(4)
        numbers, coded = np.empty(bounds[-1], np.int64), np.ones(bounds[-1], bool)
        numbers[at], coded[at] = totals, False
        numbers[coded] = codes
        packed = numbers.tobytes()
        own = [packed[i:j] for i, j in pairwise((8 * bounds).tolist())]
        texts = ["".join(words[i:j])[:-1].encode() for i, j in pairwise([0, *(up_to_a + up_to_b).tolist()])]
        out.update(zip(units, map(add, own, texts)))
        for n, found in more.items():
            codes = np.frombuffer(own[n], np.int64)[4:]
            pairs = np.stack([[*codes, *found], [*np.ones(len(codes), np.int64), *found.values()]])
            out[units[n]] = own[n][:32] + texts[n], pairs.astype(np.int64).tobytes()
        return out

    def aligned(self, units: list[str]) -> list[bytes | tuple[bytes, bytes] | None]:
        """The alignments of distinct units; what is new is encoded together."""
        young, old = self.young, self.old
        out = list(map(young.get, units, repeat(_NEW)))
        missed = [k for k, x in enumerate(out) if x is _NEW]
        for k in missed:
            out[k] = old.get(units[k], _NEW)
        fresh = self.align([units[k] for k in missed if out[k] is _NEW])
        for k in missed:
            if out[k] is _NEW:
                out[k] = fresh[units[k]]
            x = out[k]
            if len(units[k]) <= _LONGEST and (x is None or type(x) is bytes and len(x) <= _ROW):
                young[units[k]] = x
        if len(young) > _KEPT:
            self.old, self.young = young, {}
        return out


@lru_cache(2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align_texts(texts: list[str | None], aligner: Aligner):
    """Of each text: [tokens of A, of B, groups, links], the groups as text ('' without tokens); and, for all texts one
    after the other, how many distinct pairs each has, their codes in order, and how often each is linked."""
    local: defaultdict[str, int] = defaultdict()
    local.default_factory = local.__len__                        # a new unit gets the next number
    lists = [list(map(local.__getitem__, units_of(t))) if t else [] for t in texts]
    found = aligner.aligned(list(local))
    wrong = {k for k, x in enumerate(found) if x is None}
    if wrong:
        lists = [x if wrong.isdisjoint(x) else [] for x in lists]
    wide = {k: x for k, x in enumerate(found) if type(x) is tuple}
    found = [x if type(x) is bytes else x[0] if x else bytes(32) for x in found] + [bytes(32)]
    per = np.frombuffer(b"".join([x[:32] for x in found]), np.int64).reshape(-1, 4)
    sizes = per[:, 3].copy()                                     # codes of each unit
    sizes[list(wide)] = 0
    past = (32 + 8 * sizes).tolist()
    names = [x[n:].decode() for x, n in zip(found, past)]
    codes = [x[32:n] for x, n in zip(found, past)]
    for k, (_, pairs) in wide.items():
        codes[k], sizes[k] = pairs[:len(pairs) // 2], len(pairs) // 16
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    codes = np.frombuffer(b"".join(codes), np.int64)
    times = np.ones(len(codes), np.int64)
    for k, (_, pairs) in wide.items():
        times[starts[k]:starts[k] + sizes[k]] = np.frombuffer(pairs, np.int64)[sizes[k]:]
    flat = np.fromiter(chain.from_iterable(lists), np.int64)
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ends = np.cumsum([0, *(len(x) for x in lists)])
    summed = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(per[flat], axis=0)])
    totals = summed[ends[1:]] - summed[ends[:-1]]
    held, often = np.unique(text * len(found) + flat, return_counts=True)
    text, unit = held // len(found), held % len(found)
    at, many = _spread(starts[unit], sizes[unit]), sizes[unit]
    keys = np.repeat(text, many) * (aligner.size_a * aligner.size_b) + codes[at]
    weight = np.repeat(often, many) * times[at]
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys = keys[first]
    weight = np.add.reduceat(weight, first) if len(first) else weight
    text, pairs = keys // (aligner.size_a * aligner.size_b), keys % (aligner.size_a * aligner.size_b)
    return (totals, [";".join(map(names.__getitem__, x)) for x in lists],
            np.bincount(text, minlength=len(lists)), pairs, weight)


_TYPE = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def alignments(text: Column, path_a: str, path_b: str) -> Column:
    """Column of structs: token, group and link counts, the hash of the groups, and the distinct linked pairs of each
    whole text with the times that each is linked."""
    @F.arrow_udf(_TYPE)
    def of(texts: pa.Array) -> pa.Array:
        aligner = _aligner(path_a, path_b)
        parts = []
        held: list[str | None] = []
        for t in texts.to_pylist():
            if held and sum(map(len, filter(None, held))) + len(t or "") > CHUNK_CHARS:
                parts.append(align_texts(held, aligner))
                held = []
            held.append(t)
        parts.append(align_texts(held, aligner))
        totals, groups, many, pairs, times = zip(*parts)
        totals = np.concatenate(totals)
        hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for part in groups for g in part]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(many))]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)]
        return pa.StructArray.from_arrays([*(pa.array(totals[:, k]) for k in range(4)), pa.array(hashes, pa.string()), *lists],
                                          ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return of(text)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many rows of ``links`` each pair is, and whether that is the highest count of its id of A."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, repeated ones too.

    Null and empty texts, and those that the tokenizers don't write without loss, have zeros and ''. Other columns are not
    read. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        alignments(F.col(text_col), path_a, path_b).alias("t")).select("row", "doc_id", "t.*")
    links = materialize(found, "alignments")
    counts = materialize(pair_counts(links, size_b), "alignment-counts")
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return links.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
