"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.session import cut_lineage as materialize
from sentrel.session import discard, dropping_shuffles, new_path, release

__all__ = ["BROADCAST_BYTES", "ascii_lower", "discard", "dropping_shuffles", "fresh", "lean", "materialize", "new_path", "pick", "release", "small_enough"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes up to which a lookup side may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 64 << 20
#: What a row and a field of it take beside their contents.
ROW_BYTES, FIELD_BYTES = 48, 16


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, however the others are called."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the frame doesn't have."""
    out = list(names)
    while {n.lower() for n in out} & {c.lower() for c in df.columns}:
        out = [f"_{n}" for n in out]
    return out


def _bytes_of(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        size = F.octet_length(F.array_join(c, "")) + F.size(c) * FIELD_BYTES
    elif isinstance(kind, T.ArrayType):
        size = F.size(c) * FIELD_BYTES
    else:
        size = F.lit(0)
    return F.coalesce(size, F.lit(0)).cast("long") + FIELD_BYTES


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a side, whose bytes are summed once, stays under the broadcast bound."""
    row = reduce(lambda a, b: a + b, map(_bytes_of, df.schema), F.lit(ROW_BYTES).cast("long"))
    return (df.agg(F.sum(row)).first()[0] or 0) <= limit


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that hands freed memory back to the system after its task: idle workers stay beside the JVM."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return wrapped
