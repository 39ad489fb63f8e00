"""Rank skill and tails of a score against later returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from barlens.functions.columns import ratio
from barlens.functions.windows import along, mean_rank


def forward_return(panel: DataFrame, n: int = 6) -> DataFrame:
    """Add fwd, the return over the next `n` rows, to a dense panel."""
    if n < 1:
        raise ValueError("the horizon must be one bar or more")
    return panel.withColumn("fwd", ratio(F.lead("close", n).over(along()), "close") - 1)


def information_coefficient(panel: DataFrame, rolling: int = 0) -> DataFrame:
    """(ts, ic) for every bar: rank correlation of score and fwd where both are there; NULL where either is constant.

    Ranks are halves of whole numbers, so that their sums are exact: a correlation of 0 is 0 in any order of rows.
    """
    both = panel.where("score IS NOT NULL AND fwd IS NOT NULL")
    ranked = both.select("ts", mean_rank("score", "ts").alias("a"), mean_rank("fwd", "ts").alias("b"))
    n = F.count(F.lit(1)).cast("double")
    even = n * (n + 1) * (n + 1) / 4
    cov, va, vb = (F.sum(F.col(x) * F.col(y)) - even for x, y in (("a", "b"), ("a", "a"), ("b", "b")))
    found = ranked.groupBy("ts").agg(F.when((va > 0) & (vb > 0), cov / F.sqrt(va) / F.sqrt(vb)).alias("ic"))
    out = panel.select("ts").distinct().join(found, "ts", "left")
    return out.withColumn("ic", F.avg("ic").over(Window.orderBy("ts").rowsBetween(-(rolling - 1), 0))) if rolling > 1 else out


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row; the hit rate counts bars without a coefficient as misses."""
    return ic.agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), ratio(F.avg("ic"), F.stddev_pop("ic")).alias("ic_ir"), F.avg(F.coalesce(F.col("ic") > 0, F.lit(False)).cast("double")).alias("ic_hit_rate"), F.count("ic").alias("n_obs"))


def ordered_rank(rows: DataFrame, groups: int = 200) -> DataFrame:
    """Add `r`, the place from 1 on of each row along (score, ts, symbol), and `n`, the number of rows.

    Rows are cut into blocks: the scores between two neighbours of `groups` approximate quantiles, and the months (times,
    where they are no dates) of each score that is a quantile. A frequent score is a quantile, so no block holds much more
    than one row in `groups`, but for one score's month. Blocks are counted, their counts summed in order, and each is
    numbered by itself.
    """
    cuts = rows.agg(F.percentile_approx("score", [i / groups for i in range(groups + 1)], 10 * groups).alias("q")).first()["q"]
    if cuts is None:
        raise ValueError("no row has both a score and a return")
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))])
    below = F.size(F.filter(bounds, lambda b: b < F.col("score").cast("double")))
    equal = F.array_contains(bounds, F.col("score").cast("double"))
    month = F.date_trunc("month", "ts") if dict(rows.dtypes)["ts"].startswith(("date", "timestamp")) else F.col("ts")
    rows = rows.withColumns({"_g": 2 * below + equal.cast("int"), "_m": F.when(equal, month)})
    counts = rows.groupBy("_g", "_m").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_g", "_m")
    counts = counts.select("_g", F.col("_m").alias("_m2"), F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("n"))
    found = rows.join(counts, (rows["_g"] == counts["_g"]) & rows["_m"].eqNullSafe(counts["_m2"])).drop(counts["_g"])
    own = F.row_number().over(Window.partitionBy("_g", "_m").orderBy("score", "ts", "symbol"))
    return found.withColumn("r", F.col("_before") + own).drop("_g", "_m", "_m2", "_before")


def decile_audit(panel: DataFrame, deciles: int = 10) -> DataFrame:
    """(decile, count, median, mean, p5, p95, mean_minus_median) of fwd by the pooled rank of the score.

    Equal scores rank by time, then symbol. Without any pair of score and return: a ValueError. The quantiles are exact,
    from the counts of a decile's distinct returns.
    """
    rows = panel.where("score IS NOT NULL AND fwd IS NOT NULL").select("symbol", "ts", "score", "fwd")
    ranked = ordered_rank(rows.persist(StorageLevel.MEMORY_AND_DISK))  # read three times
    ranked = ranked.withColumn("decile", F.least(F.floor(F.col("r") / (F.col("n") + 1) * deciles), F.lit(deciles - 1)).cast("int"))
    table = ranked.groupBy("decile").agg(F.count(F.lit(1)).alias("count"), F.median("fwd").alias("median"), F.avg("fwd").alias("mean"), F.percentile("fwd", F.lit(0.05)).alias("p5"), F.percentile("fwd", F.lit(0.95)).alias("p95"))
    return table.withColumn("mean_minus_median", F.col("mean") - F.col("median"))


def audit_verdict(deciles: DataFrame) -> DataFrame:
    """The last decile of a decile audit, with `verdict`: whether its mean and its median tell the same."""
    mean, median = F.col("mean"), F.col("median")
    said = (
        F.when((mean > 0) & (median <= 0), "tail-made: positive mean, median not positive")
        .when((median > 0) & (mean <= 0), "tail-lost: positive median, mean not positive")
        .when(F.abs(mean - median) > 0.5 * F.abs(median) + 1e-12, "skewed: mean and median differ")
        .otherwise("broad: mean and median agree")
    )
    return deciles.orderBy(F.desc("decile")).limit(1).withColumn("verdict", said)
