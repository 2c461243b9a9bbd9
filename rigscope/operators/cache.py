"""Intermediates that are read more than once (a scalar pass, then the final plan) are persisted here.

The returned lazy plans still read them, so operators cannot unpersist on their own; call
``release()`` after the actions that consume a query's result. Registered queries release what the one before
kept, so at most one query's frames are held.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_KEPT: list = []


def keep(df: DataFrame) -> DataFrame:
    """Persist (memory, spilling to disk) and remember it for ``release``; a lost block is recomputed
    from its lineage."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(out)
    return out


def release() -> int:
    """Unpersist everything kept so far; returns how many frames were released."""
    n = len(_KEPT)
    while _KEPT:
        _KEPT.pop().unpersist()
    return n
