"""Windows along time (per symbol) and across symbols (per bar). Row windows expect dense panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlens.functions.columns import col, ratio


def along(order: str | Column = "ts") -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(order)


def across() -> WindowSpec:
    return Window.partitionBy("ts")


def trailing(x: str | Column, rows: int, how: str, least: int, lag: int = 0, order: str = "ts") -> Column:
    """A trailing aggregate over `rows` rows that ends `lag` rows ago; NULL with fewer than `least` values."""
    w = along(order).rowsBetween(-(rows - 1) - lag, -lag)
    value = {"sum": F.sum, "avg": F.avg, "std": F.stddev_pop}[how](col(x)).over(w)
    return F.when(F.count(col(x)).over(w) >= least, value)


def carried(x: str | Column, order: str = "ts") -> Column:
    """The last value that is not NULL."""
    return F.last(col(x), ignorenulls=True).over(along(order).rowsBetween(Window.unboundedPreceding, 0))


def zscore(x: str | Column) -> Column:
    """Across symbols: (x - mean) / population deviation; NULL where that is 0, or no more than the mean's rounding."""
    mean, std = F.avg(col(x)).over(across()), F.stddev_pop(col(x)).over(across())
    return (col(x) - mean) / F.when(std > F.abs(mean) * 1e-12, std)


def mean_rank(x: str | Column, *by: str) -> Column:
    """Rank from 1, ties averaged, among the values that are not NULL."""
    x = col(x)
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last())) + (tied - 1) / 2)


def percentile_rank(x: str | Column) -> Column:
    """Across symbols: the average rank by the number of values."""
    return mean_rank(x, "ts") / F.count(col(x)).over(across())


def winsorized(x: str | Column, lower: float = 0.01, upper: float = 0.99) -> Column:
    """Across symbols: clipped to two quantiles."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, F.lit(lower)).over(across())), F.percentile(x, F.lit(upper)).over(across())))


def extremity(x: str | Column, quantile: float = 0.9) -> Column:
    """1 at or beyond the bar's upper or lower quantile, else 0; NULL stays."""
    x = col(x)
    hit = (x >= F.percentile(x, F.lit(quantile)).over(across())) | (x <= F.percentile(x, F.lit(1.0 - quantile)).over(across()))
    return F.when(x.isNotNull(), hit.cast("double"))


def normalized(df: DataFrame, columns: list[str], how: str | None) -> DataFrame:
    """The columns as z-scores or percentile ranks of their bar, or as they are."""
    if how not in ("zscore", "rank", None):
        raise ValueError(f"no such normalization: {how}; zscore, rank or None")
    return df if how is None else df.withColumns({c: (zscore if how == "zscore" else percentile_rank)(c) for c in columns})


def numbered(df: DataFrame, order: list[str], block: Column, total: str | None = None) -> DataFrame:
    """Add `idx` (from 0 along `order` in each symbol), `n` (rows of the symbol), and the running sum `cum` of `total`.

    `block` must not fall along `order`. Counts and sums of blocks are accumulated first, so no task sorts more
    than one block of one symbol.
    """
    value = F.col(total) if total else F.lit(0.0)
    df = df.withColumn("_b", block)
    sums = df.groupBy("symbol", "_b").agg(F.count(F.lit(1)).alias("_c"), F.sum(value).alias("_s"))
    w = Window.partitionBy("symbol").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("symbol", "_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("_s0"), F.sum("_c").over(Window.partitionBy("symbol")).alias("n"))
    own = Window.partitionBy("symbol", "_b").orderBy(*order)
    df = df.join(sums, ["symbol", "_b"]).withColumn("idx", F.col("_c0") + F.row_number().over(own) - 1)
    if total:
        df = df.withColumn("cum", F.col("_s0") + F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return df.drop("_b", "_c0", "_s0")


def neighbours(df: DataFrame, before: Sequence[str] = (), behind: Sequence[str] = ()) -> DataFrame:
    """Add prev_x for columns `before` and next_x for columns `behind`: their values in the symbol's last and next row along (ts, id).

    A block is an hour of one symbol: no task sorts more. What a block lacks at its edges comes from the first and last
    rows of blocks, of which there is one each; they are joined by the same key, so rows are shuffled once.
    """
    df = df.withColumn("_b", F.date_trunc("hour", "ts"))
    order, old, new = F.struct("ts", "id"), F.struct(*before), F.struct(*behind)
    blocks = Window.partitionBy("symbol").orderBy("_b")
    own = Window.partitionBy("symbol", "_b").orderBy("ts", "id")
    edges, values = [], {}
    if before:
        edges.append(F.max_by(old, order).alias("_p"))
        values |= {f"prev_{c}": F.coalesce(F.lag(old).over(own), "_p")[c] for c in before}
    if behind:
        edges.append(F.min_by(new, order).alias("_n"))
        values |= {f"next_{c}": F.coalesce(F.lead(new).over(own), "_n")[c] for c in behind}
    ends = df.groupBy("symbol", "_b").agg(*edges)
    ends = ends.withColumns({c: (F.lag if c == "_p" else F.lead)(c).over(blocks) for c in ends.columns[2:]})
    return df.join(ends, ["symbol", "_b"]).withColumns(values).drop(*ends.columns[1:])
