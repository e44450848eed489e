"""Pieces that several operators share: runs, range joins, running budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, begins: Column, out: str = "run_no") -> DataFrame:
    """Number the runs of rows within `keys`; a run begins where `begins` holds.

    `begins` may look at the row before with lag over the same window; on the first row
    it is taken as true.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    mark = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(begins, F.lit(False)).cast("int"))
    return df.withColumn("islands__mark", mark).withColumn(out, F.sum("islands__mark").over(w)).drop("islands__mark")


def before(keys: Sequence[str], order: Sequence, column) -> Column:
    return F.lag(column).over(W.partitionBy(*keys).orderBy(*order))


def _cells(start: Column, end: Column, cell: float) -> Column:
    first, last = F.floor(start / cell).cast("long"), F.floor(end / cell).cast("long")
    return F.when(start.isNotNull() & end.isNotNull() & (first <= last), F.sequence(first, last))


def range_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    cell: float = 60, closed: bool = False, row: Sequence[str] = (),
) -> DataFrame:
    """Pairs of rows of equal `keys` whose spans overlap (`closed`: or touch).

    Both sides are dealt to cells of time and joined on keys and cell, so a long recording
    is many join keys.  A pair that meets in several cells is kept in the first that both
    have: no distinct is needed.  With `row`, the columns that identify a left row within
    `keys`, left rows without a match are kept.
    """
    a, b = left_span
    c, d = right_span
    l = left.withColumn("cell__l", F.explode_outer(_cells(F.col(a), F.col(b), cell))).withColumn("lo__l", F.floor(F.col(a) / cell).cast("long"))
    r = right.withColumn("cell__r", F.explode(_cells(F.col(c), F.col(d), cell))).withColumn("lo__r", F.floor(F.col(c) / cell).cast("long"))
    on = [F.col(f"l__.{k}") == F.col(f"r__.{k}") for k in keys]
    on.append(F.col("cell__l") == F.col("cell__r"))
    on.append(F.col("cell__l") == F.greatest("lo__l", "lo__r"))
    on.append((F.col(f"l__.{a}") <= F.col(f"r__.{d}")) & (F.col(f"l__.{b}") >= F.col(f"r__.{c}")) if closed else (F.col(f"l__.{a}") < F.col(f"r__.{d}")) & (F.col(f"l__.{b}") > F.col(f"r__.{c}")))
    l, r = l.alias("l__"), r.alias("r__")
    keep = [F.col(f"r__.{x}") for x in right.columns if x not in keys]
    own = [F.col(f"l__.{x}") for x in left.columns]
    found = l.join(r, on, "inner").select(*own, *keep)
    if not row:
        return found
    return left.join(found.select(*keys, *row, *[x for x in right.columns if x not in keys]), [*keys, *row], "left")


def prefix_budget(df: DataFrame, keys: Sequence[str], order: Sequence, cost: Column, limit) -> DataFrame:
    """The first rows within `keys` while the running cost stays within `limit`."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("budget__run", F.sum(cost).over(w)).filter(F.col("budget__run") <= limit).drop("budget__run")


def ordered(column: str | Column, *order: str, separator: str = "") -> Column:
    """Texts of a group joined in `order`."""
    value = F.col(column) if isinstance(column, str) else column
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("ordered__value"))))
    return F.array_join(F.transform(rows, lambda x: x["ordered__value"]), separator)
