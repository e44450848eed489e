"""A bit table of bounded size that finds the rows of some keys without moving the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table at most.
BLOOM_BITS = 1 << 25


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A bit table of hashed `ids` (long) of at most `BLOOM_BITS` bits, eight to a byte: a member
    always passes, others seldom; where the table is full more pass, which costs time only."""
    ids, bits = ids.filter(F.col(column).isNotNull()), 1 << 12
    wanted = min(BLOOM_BITS, 16 * ids.count())  # counted once, not for each size that is tried
    while bits < wanted:
        bits *= 2
    at = F.pmod(F.col(column), F.lit(bits - 1))  # an odd number, so that regular ids spread
    rows = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).cast("int").alias("word"))
    rows = rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def passes(table: np.ndarray, ids: pd.Series) -> np.ndarray:
    """Which of `ids` may be members; a null passes."""
    at = ids.fillna(0).to_numpy(np.int64) % (8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7) & 1).astype(bool) | ids.isna().to_numpy()
