"""Exact quantiles: a mergeable sketch brackets the rank, one pass counts exactly inside the bracket.

``percentile`` as an aggregate merges every distinct value in one final task. Here the first pass counts the values and
takes, from one sketch a column that merges over all tasks (``percentile_approx``), two values around the wanted share whose
ranks are off by n / ``ACCURACY`` at most. The second pass counts the values below that bracket and, by distinct value, those
in it: some n / 1000 at most, ties collapsed. Where that is more than ``COLLECT`` (n above 10**8 or so) it
counts ``bins`` parts of the bracket instead, and a third pass settles the part that holds the rank. Should a bracket miss
its rank, or a part still hold too many values, the passes go on by bisection: a double maps to a 64-bit integer
that sorts like it (±infinity included), of which each pass settles at least log2(``bins``) bits, however the values are spread.
At most ``COLLECT`` or ``bins`` rows a target reach the driver. Interpolation is linear between the two neighbouring order
statistics, like pandas/numpy (``median`` included).
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000      # a sketch's ranks are off by one of so many parts at most
COLLECT = 100_000      # rows of exact counts that one pass may send to the driver
_MANTISSA = 52


def ordered_bits(v: Column) -> Column:
    """A long that sorts like the double ``v``: its IEEE pattern without the sign, negated for negative values (both
    zeros are 0). Computed exactly from powers of two: scaling by one changes no bit of a double."""
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    power = F.pow(F.lit(2.0), guess)
    exact = guess + F.when(a < power, -1).when(a >= power * 2, 1).otherwise(0)      # the logarithm may be off by one
    exponent = F.greatest(exact, F.lit(-1022))
    scaled = a / F.pow(F.lit(2.0), exponent) * F.lit(float(1 << _MANTISSA))            # below 2 ** 53
    bits = (exponent + 1022).cast("long") * F.lit(1 << _MANTISSA) + scaled.cast("long")
    bits = F.when(a == 0, F.lit(0)).when(a == F.lit(float("inf")), F.lit(0x7FF << _MANTISSA)).otherwise(bits)
    return F.when(v < 0, -bits).otherwise(bits).cast("long")


def value_of_bits(bits: int) -> float:
    """The double of an ``ordered_bits`` value."""
    value = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -value if bits < 0 else value


def bits_of_value(value: float) -> int:
    """``ordered_bits`` of one double."""
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def _interpolate(low: float, high: float, share: float) -> float:
    if low == high or share == 0:
        return low
    gap = high - low
    return low + share * gap if math.isfinite(gap) or math.isinf(low) or math.isinf(high) else low * (1 - share) + high * share


def _tags(columns, ranges, bins: int, collect: int):
    """For every range an expression over the values of its column: null outside, else a struct of the range's number t, the
    part that the value falls into and its key. Values below a range whose rank is not known yet have t = -1 - number."""
    tagged = []
    for number, ((i, lo, hi), state) in enumerate(ranges):
        v, first, last = columns[i], value_of_bits(lo), value_of_bits(hi)
        key = ordered_bits(v)
        shift = 0
        if state["size"] > collect // len(ranges):
            while (hi >> shift) - (lo >> shift) >= bins:
                shift += 1
        def entry(t, part, k):
            return F.struct(F.lit(t).alias("t"), part.cast("long").alias("part"), k.cast("long").alias("key"))

        tag = F.when((v >= F.lit(first)) & (v <= F.lit(last)), entry(number, F.shiftright(key, shift), key))
        if state["below"] is None:
            tag = tag.when(v < F.lit(first), entry(-1 - number, F.lit(0), F.lit(0)))
        tagged.append(tag)
    return tagged


def _order_statistics(df: DataFrame, values, wanted, share: float, bins: int, accuracy: int = ACCURACY,
                      collect: int = COLLECT) -> tuple[list, dict, int]:
    """(number of values by column, {(column, rank): value}, passes over ``df``): of each column's values that are neither
    null nor NaN those at the 0-based ranks ``wanted(rows, values)``, which lie near ``share`` of the values."""
    columns = [F.col(f"v{i}") for i in range(len(values))]
    plain = df.select(*[F.when(~F.isnan(v.cast("double")), v.cast("double")).alias(f"v{i}") for i, v in enumerate(values)])
    beside = [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
    first = plain.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
                      *[F.percentile_approx(c, beside, accuracy).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    counts = [first[f"n{i}"] for i in range(len(values))]
    whole = (bits_of_value(-math.inf), bits_of_value(math.inf))
    found: dict = {}
    # (column, least and largest key) -> ranks sought there, values below the range (None: to be counted), values in it
    ranges: dict = {}
    for i, n in enumerate(counts):
        ranks = set(wanted(first["rows"], n)) if n else set()
        if ranks:
            lo, hi = (bits_of_value(x) for x in first[f"b{i}"])
            ranges[i, lo, hi] = {"ranks": ranks, "below": None, "size": 8 * n // accuracy + 64}
    passes = 1
    while ranges:
        passes += 1
        todo = list(ranges.items())
        parts = (plain.select(F.explode(F.array_compact(F.array(*_tags(columns, todo, bins, collect)))).alias("m"))
                 .groupBy("m.t", "m.part").agg(F.count(F.lit(1)).alias("n"), F.min("m.key").alias("lo"), F.max("m.key").alias("hi"))
                 .collect())
        by_range: dict = {}
        for r in parts:
            by_range.setdefault(r["t"], []).append(r)
        ranges = {}
        for number, ((i, _, _), state) in enumerate(todo):
            mine = sorted(by_range.get(number, []), key=lambda r: r["part"])
            below = state["below"]
            if below is None:
                below = sum(r["n"] for r in by_range.get(-1 - number, []))
            for rank in state["ranks"]:
                at, before, size = whole, 0, counts[i]             # the sketch's bracket missed this rank
                reached = below
                for r in mine if rank >= below else []:
                    if reached + r["n"] > rank:
                        at, before, size = (r["lo"], r["hi"]), reached, r["n"]
                        break
                    reached += r["n"]
                if at[0] == at[1]:
                    found[i, rank] = value_of_bits(at[0])
                else:
                    ranges.setdefault((i, *at), {"ranks": set(), "below": before, "size": size})["ranks"].add(rank)
    return counts, found, passes


def exact_quantiles(df: DataFrame, cols, q: float, bins: int = 4096, only_with_nulls: bool = False) -> dict:
    """Return {col: quantile q of the values of col that are neither null nor NaN}; None for a column without values,
    and with ``only_with_nulls`` also for a column without nulls, which then needs no quantile and is never read again."""
    cols = list(cols)

    def neighbours(rows: int, n: int) -> set:
        place = int(math.floor((n - 1) * q))
        return set() if only_with_nulls and n == rows else {place, min(place + 1, n - 1)}

    counts, found, _ = _order_statistics(df, [F.col(c) for c in cols], neighbours, q, bins)
    out = dict.fromkeys(cols)
    for i, (c, n) in enumerate(zip(cols, counts)):
        place = max(0, n - 1) * q
        rank = int(math.floor(place))
        if (i, rank) in found:
            out[c] = _interpolate(found[i, rank], found[i, min(rank + 1, n - 1)], place - rank)
    return out


def smallest_share(df: DataFrame, values, share: float, bins: int = 4096) -> list:
    """For each column of ``values`` the largest of its floor(share * n) smallest values (None if that is no value)."""
    counts, found, _ = _order_statistics(df, values, lambda _, n: {int(share * n) - 1} - {-1}, share, bins)
    return [found.get((i, int(share * n) - 1)) for i, n in enumerate(counts)]


def approx_quantiles(df: DataFrame, cols, q: float, accuracy: int = 10_000) -> dict:
    """One-pass ``percentile_approx`` variant (rank error ~ n/accuracy)."""
    row = df.agg(*[F.percentile_approx(c, q, accuracy).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}
