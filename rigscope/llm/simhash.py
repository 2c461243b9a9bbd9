"""SimHash near-duplicates: fingerprints, tiled exact comparison by exclusive-or and bit counts, components.

Texts: A-Z are lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, shingles are ``shingle`` words joined by a space
(fewer words: the whole sequence; a null, empty or blank text: fingerprint zero, linked like any other).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.components import connected_components
from rigscope.llm.tables import materialize, small_batches

SEED = 42           # of the shingles' XXH64
TILE_ROWS = 4096    # fingerprints in a tile: 32 KB
BLOCKS = 4          # the 64 bits are counted in blocks of 16
_STRIP = 1 << 16    # shingles whose bits are counted at a time
_TILE = "tile long, lo array<int>, hi array<int>, codes binary"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = text.encode().lower().split() if text else []   # bytes: lower() is A-Z, split() is at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STRIP):
        part = hashes[i:i + _STRIP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Column of fingerprints as signed longs (``hex`` shows the 64 bits)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        codes = np.fromiter((fingerprint(t, shingle) for t in texts.to_pylist()), np.uint64, len(texts))
        return pa.array(codes.view(np.int64))

    return of(text)


def _counts(codes: np.ndarray) -> np.ndarray:
    """Set bits in each 16-bit block of each code."""
    return np.bitwise_count(codes.view(np.uint16).reshape(-1, BLOCKS))


def _pack(tile_rows: int):
    def tiles(batches):
        """One row for each ``tile_rows`` codes of a range partition: the least and largest bit counts, and the codes."""
        tile = TaskContext.get().partitionId() << 32
        rest = np.empty(0, np.int64)

        def row(codes, k):
            counts = _counts(codes.view(np.uint64))
            return pa.RecordBatch.from_pydict({
                "tile": [tile + k], "lo": pa.array([counts.min(0).tolist()], pa.list_(pa.int32())),
                "hi": pa.array([counts.max(0).tolist()], pa.list_(pa.int32())), "codes": [codes.tobytes()]})

        k = 0
        for batch in batches:
            rest = np.concatenate([rest, batch.column(0).to_numpy(zero_copy_only=False)])
            while len(rest) >= tile_rows:
                yield row(rest[:tile_rows], k)
                rest, k = rest[tile_rows:], k + 1
        if len(rest):
            yield row(rest, k)

    return tiles


def _close(a: np.ndarray, b: np.ndarray, radius: int, strip: int = 256):
    """Index pairs of codes at most ``radius`` bits apart. Strips of ``a`` in order of bit count meet only the codes of
    ``b`` whose bit counts are within the radius."""
    count_a, count_b = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    by_a, by_b = np.argsort(count_a, kind="stable"), np.argsort(count_b, kind="stable")
    a, b, count_a, count_b = a[by_a], b[by_b], count_a[by_a], count_b[by_b]
    left, right = [], []
    for s in range(0, len(a), strip):
        low = np.searchsorted(count_b, count_a[s] - radius)
        high = np.searchsorted(count_b, count_a[min(s + strip, len(a)) - 1] + radius, side="right")
        if low < high:
            near = np.bitwise_count(a[s:s + strip, None] ^ b[None, low:high]) <= radius
            if near.any():
                i, j = near.nonzero()
                left.append(by_a[i + s])
                right.append(by_b[j + low])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that the links (i, j) reach."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        while (after != (deeper := after[after])).any():
            after = deeper
        if (after == root).all():
            break
        root = after
    return root


def _compare(radius: int):
    def links(batches):
        """A spanning forest of the links between two tiles: at most one row for each of their codes."""
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a = np.frombuffer(x.as_py(), np.uint64)
                b = np.frombuffer(y.as_py(), np.uint64)
                i, j = _close(a, b, radius)
                both = np.concatenate([a, b])
                apart = both[i] != both[j + len(a)]
                nodes, at = np.unique(both, return_inverse=True)
                root = _forest(len(nodes), at[i[apart]], at[(j + len(a))[apart]])
                off = np.flatnonzero(root != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[off].view(np.int64)),
                                                  pa.array(nodes[root[off]].view(np.int64))], ["a", "b"])

    return links


def close_links(codes: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that join all of the distinct long codes in column ``code`` at most ``radius`` bits apart.

    The codes are sorted by the bit counts of their four 16-bit blocks and cut into tiles. Bit counts of a block differ
    by no more than the bits themselves, so two tiles whose counts differ by more than the radius over the blocks
    together hold no link and are skipped; all others are compared exactly. A dense group yields a spanning forest of
    its links within each pair of tiles, not all its pairs; the components are the same.
    """
    small_batches(codes.sparkSession)
    count = lambda k: F.bit_count(F.shiftrightunsigned("code", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    n = codes.count()
    tiles = max(1, -(-n // tile_rows))
    dealt = codes.select("code").repartitionByRange(tiles, *[count(k) for k in range(BLOCKS)], F.col("code"))
    dealt = materialize(dealt.mapInArrow(_pack(tile_rows), _TILE), "simhash-tiles")
    boxes = materialize(dealt.select("tile", "lo", "hi"), "simhash-boxes")
    # tiles meet at a bit count of their first block that one covers and the other covers or nearly covers
    one = boxes.select(F.col("tile").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
                       F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("at"))
    other = boxes.select(F.col("tile").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                         F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)).alias("at"))
    gap = sum(F.greatest(F.lit(0), F.col("lo_a")[k] - F.col("hi_b")[k], F.col("lo_b")[k] - F.col("hi_a")[k])
              for k in range(BLOCKS))
    pairs = one.join(other, "at").where((F.col("a") <= F.col("b")) & (gap <= radius)).select("a", "b").distinct()
    # either tile may come first: the joins below then deal each tile's pairs more evenly
    swap = F.xxhash64("a", "b") % 2 == 0
    pairs = pairs.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.when(swap, F.col("b")).otherwise(F.col("a")).alias("b"))
    pairs = (pairs.join(dealt.select(F.col("tile").alias("a"), F.col("codes").alias("codes_a")), "a")
             .join(dealt.select(F.col("tile").alias("b"), F.col("codes").alias("codes_b")), "b"))
    return pairs.select("codes_a", "codes_b").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id in its component.

    Exact and equal-fingerprint copies meet in one aggregation; only distinct fingerprints are compared. Rows without an
    id are fingerprinted and link others, but give no component id (null where a component has no id at all). Repeated
    rows are returned as often as they come; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("code"))
    prints = materialize(prints, "simhash-prints")
    classes = materialize(prints.groupBy("code").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = connected_components(close_links(classes, radius, tile_rows))
    classes = (classes.join(roots.withColumnRenamed("node", "code"), "code", "left")
               .select("code", "first_id", F.coalesce("root", "code").alias("root")))
    classes = materialize(classes, "simhash-roots")
    first = materialize(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-firsts")
    classes = materialize(classes.join(first, "root").select("code", "component_id"), "simhash-components")
    return (prints.join(classes, "code")
            .select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             radius: int = 3) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id, with its columns; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    copies = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(materialize(copies, "simhash-copies"), id_col, "left_anti")
