"""Square-root execution cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.functions.columns import col
from barlens.functions.windows import along, carried, trailing


@dataclass(frozen=True)
class Impact:
    """Basis points: a fee plus gamma x volatility x root of the share of the volume."""

    base_fee_bps: float = 5.0
    gamma: float = 0.6
    vol_lookback: int = 24
    adv_lookback: int = 24

    def slippage_bps(self, notional, adv, vol) -> Column:
        share = F.abs(col(notional)) / F.when(col(adv) > 0, col(adv))
        return self.base_fee_bps + self.gamma * col(vol) * F.sqrt(share) * 1e4

    def execute(self, side, price, notional, adv, vol) -> Column:
        """The price paid; NULL where the cost isn't known."""
        return col(price) * (1 + col(side) * self.slippage_bps(notional, adv, vol) / 1e4)

    def round_trip_bps(self, notional, adv, vol) -> Column:
        return 2 * self.slippage_bps(notional, adv, vol)

    def fill(self, side, price, notional, adv, vol) -> Column:
        """The price paid, with the fee alone where the cost isn't known."""
        bps = F.coalesce(self.slippage_bps(notional, adv, vol), F.lit(self.base_fee_bps))
        return col(price) * (1 + col(side) * bps / 1e4)

    def liquidity(self, panel: DataFrame) -> DataFrame:
        """Add px (last price), vol and adv, both up to the row before, to a dense panel (symbol, ts, close, dollar_volume)."""
        p = panel.withColumn("px", carried("close"))
        p = p.withColumn("_r", F.col("px") / F.lag("px").over(along()) - 1)
        return p.withColumns({"vol": trailing("_r", self.vol_lookback, "std", 2, lag=1), "adv": trailing("dollar_volume", self.adv_lookback, "sum", 1, lag=1)}).drop("_r")
