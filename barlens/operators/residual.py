"""Factor-neutral returns: market median, leave-one-out sector index, rolling three-regressor fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import ratio
from barlens.functions.windows import across, along, percentile_rank, trailing


def factors(panel: DataFrame, sectors: DataFrame, vol_weight_window: int = 48) -> DataFrame:
    """Add ret, market, sector_index to a dense panel (symbol, ts, close, volume); `sectors` is (symbol, sector).

    A symbol without a sector is an error, raised when the rows are read.
    """
    p = panel.join(sectors, "symbol", "left").withColumn("sector", F.when(F.col("sector").isNull(), F.raise_error(F.lit("a symbol has no sector"))).otherwise(F.col("sector")))
    p = p.withColumn("ln", F.when(F.col("close") > 0, F.ln("close"))).withColumn("dv", F.col("close") * F.col("volume"))
    p = p.withColumns({"ret": F.col("ln") - F.lag("ln").over(along()), "weight": trailing("dv", vol_weight_window, "avg", 1, lag=1)})
    p = p.withColumn("wr", F.col("weight") * F.col("ret"))
    group = Window.partitionBy("ts", "sector")
    rest = F.sum("weight").over(group) - F.col("weight")
    index = (F.sum("wr").over(group) - F.col("wr")) / F.when(rest > 0, rest)
    return p.withColumns({"market": F.median("ret").over(across()), "sector_index": index}).drop("ln", "wr", "dv")


def residuals(panel: DataFrame, beta_window: int = 120, ridge: float = 1e-8) -> DataFrame:
    """Add residual: ret minus its fit on (1, market, sector_index) over the last `beta_window` complete rows.

    The normal equations come from rolling sums; the symmetric 3 x 3 system is solved in closed form.
    """
    if beta_window < 5:
        raise ValueError("three factors need a window of five rows or more")
    y, m, s = (F.when(F.col("ret").isNotNull() & F.col("market").isNotNull() & F.col("sector_index").isNotNull(), F.col(x)) for x in ("ret", "market", "sector_index"))
    p = panel.withColumns({"_y": y, "_m": m, "_s": s})
    terms = {"m": F.col("_m"), "s": F.col("_s"), "y": F.col("_y"), "mm": F.col("_m") ** 2, "ss": F.col("_s") ** 2, "ms": F.col("_m") * F.col("_s"), "my": F.col("_m") * F.col("_y"), "sy": F.col("_s") * F.col("_y")}
    p = p.withColumns({f"_t{k}": v for k, v in terms.items()})
    p = p.withColumns({f"_x{k}": trailing(f"_t{k}", beta_window, "sum", beta_window) for k in terms})
    x = {k: F.col(f"_x{k}") for k in terms}
    a, d, f = F.lit(beta_window + ridge), x["mm"] + ridge, x["ss"] + ridge
    b, c, e = x["m"], x["s"], x["ms"]
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    u, v, w = x["y"], x["my"], x["sy"]
    beta0 = ratio(u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w), det)
    beta1 = ratio(a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c), det)
    beta2 = ratio(a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c), det)
    fitted = beta0 + beta1 * F.col("_m") + beta2 * F.col("_s")
    return p.withColumn("residual", F.col("_y") - fitted).drop(*[c for c in p.columns if c[0] == "_"])


def rank_trajectory(panel: DataFrame, velocity_window: int = 6) -> DataFrame:
    """Add rank (percentile of the residual in its bar) and rank_velocity (its change over `velocity_window` rows)."""
    if velocity_window < 1:
        raise ValueError("a velocity needs one row or more")
    p = panel.withColumn("rank", percentile_rank("residual"))
    return p.withColumn("rank_velocity", F.col("rank") - F.lag("rank", velocity_window).over(along()))
