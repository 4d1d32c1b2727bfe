"""Rows whose key may be among given ones, told before they are shuffled.

Keys set bits of a bitmap, which tasks make together and the driver joins: 2 ** 27 bits (16 MB) at most, whatever the number of keys, so its size is bounded and it is
broadcast. A row whose bit is not set has none of the keys. One whose bit is set may have one, which the join behind it decides; where keys are so many that most bits are
set, all rows go to that join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and most bits of a slot's number, and bits of a slot's number within a piece of the bitmap.
BITS, PIECE = (16, 27), 15


class Members:
    """A bitmap of the values of a long column. Nulls are no members."""

    def __init__(self, values: DataFrame, column: str):
        n = values.count()
        self.bits = min(BITS[1], max(BITS[0], (16 * n).bit_length()))
        slots = values.where(F.col(column).isNotNull()).select(self.slot(F.col(column)).alias("slot"))
        pieces = slots.groupBy(F.shiftright("slot", PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << PIECE) - 1)).alias("bitmap"))
        flat = np.zeros((1 << self.bits) // 8, np.uint8)
        for r in pieces.collect():  # at most 2 ** (27 - 15) pieces of 4 KB
            own = np.frombuffer(r["bitmap"], np.uint8)
            flat[r["piece"] * len(own) :][: len(own)] = own
        self.shared = values.sparkSession.sparkContext.broadcast(flat)

    def slot(self, value: Column) -> Column:
        """The number that has() asks for."""
        return F.pmod(F.xxhash64(value), F.lit(1 << self.bits))

    def has(self, at: np.ndarray) -> np.ndarray:
        """Whether slots are set, inside a task."""
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def may_have(self, value: Column) -> Column:
        """Whether a value may be a member. Null: not."""
        has = self.has

        @F.pandas_udf("boolean")
        def is_set(slot: pd.Series) -> pd.Series:
            return pd.Series(has(slot.to_numpy()))

        return value.isNotNull() & is_set(self.slot(value))
