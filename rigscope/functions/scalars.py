"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (stable value hashes across engines)."""
    return F.round(col(c), 6) + F.lit(0.0)


def half_even(c, digits: int) -> Column:
    """Python/numpy ``round``: half to even on the decimal value."""
    return F.bround(col(c), digits)


def fixed(c, digits: int) -> Column:
    """Python ``f"{x:.Nf}"`` text (half-even, unlike ``%.Nf`` on its own)."""
    return F.format_string(f"%.{digits}f", F.bround(col(c), digits))


def thousands(c) -> Column:
    """Python ``f"{x:,.0f}"``."""
    return F.format_number(col(c), 0)


def title_words(c) -> Column:
    """``s.replace('_', ' ').title()`` for snake_case labels."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def relu(c) -> Column:
    return F.greatest(col(c), F.lit(0.0))


def epoch_us(c, ntz: bool = True) -> Column:
    """Epoch microseconds.  A TIMESTAMP_NTZ wall-clock is read as UTC whatever the session time zone
    (difference to the NTZ epoch); a TIMESTAMP (instant) uses ``unix_micros``."""
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(c))
    return F.unix_micros(col(c))


def epoch_us_of(df, name: str) -> Column:
    return epoch_us(name, ntz=df.schema[name].dataType.simpleString() == "timestamp_ntz")


def date_of_us(c) -> Column:
    """Calendar date (UTC) of epoch microseconds, independent of the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(c) / F.lit(86_400_000_000)).cast("int"))


def hours_between_us(later, earlier) -> Column:
    return (col(later) - col(earlier)) / F.lit(3_600_000_000.0)


def days_between_us(later, earlier) -> Column:
    return (col(later) - col(earlier)) / F.lit(86_400_000_000.0)


def nan_to_null(c) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def template(text: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed text with columns."""
    pieces, rest = [], text
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), parts[name]]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def first_match(conditions, default) -> Column:
    """Cascade: value of the first true condition, ``default`` otherwise."""
    expr = None
    for cond, value in conditions:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if expr is None else expr.otherwise(d)


def one_row(*frames):
    """Combine one-row aggregates side by side without a join: union by name, then one ``max`` per column."""
    from functools import reduce as _reduce

    u = _reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    return u.agg(*[F.max(c).alias(c) for c in cols])
