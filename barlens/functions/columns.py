"""Scalar expressions. A missing value is NULL, never NaN; zero denominators give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: str | Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def number(x: str | Column) -> Column:
    """A number, from text too; NULL for NaN and what is none."""
    return present(col(x).try_cast("double"))


def to_bool(x: str | Column) -> Column:
    """Booleans as they are, "true", "false", "1" and "0" in any case, trimmed, and numbers by whether they are 0; else NULL."""
    text = F.lower(F.trim(col(x).cast("string")))
    named = F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
    return F.when(F.typeof(col(x)).isin("string", "boolean"), named).otherwise(number(x) != 0)


def signed_volume(quantity: str | Column = "quantity", maker: str | Column = "is_buyer_maker") -> Column:
    """Negative where the buyer made the price; bad quantities count 0; NULL where the maker isn't known."""
    q, made = F.coalesce(number(quantity), F.lit(0.0)), to_bool(maker)
    return F.when(made, -q).when(~made, q)


def illiquidity(close="close", open_="open", volume="volume", dollar: bool = True) -> Column:
    d = col(close) * col(volume) if dollar else col(volume)
    return F.when((d > 0) & (col(open_) > 0) & (col(close) > 0), F.abs(F.ln(col(close) / col(open_))) / d)


def wick(high="high", low="low", close="close") -> Column:
    h, lo, c = col(high), col(low), col(close)
    return F.when((h > lo) & c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - c) / (h - lo))))


def upper_wick(open_="open", high="high", low="low", close="close") -> Column:
    h, lo = col(high), col(low)
    top = F.greatest(col(open_), col(close))
    return F.when((h > lo) & col(open_).isNotNull() & col(close).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - top) / (h - lo))))


def mid(bid="best_bid_price", ask="best_ask_price") -> Column:
    return (col(bid) + col(ask)) / 2


def imbalance(bid_qty="best_bid_qty", ask_qty="best_ask_qty") -> Column:
    return ratio(col(bid_qty) - col(ask_qty), col(bid_qty) + col(ask_qty))


def microprice_adjustment(bid="best_bid_price", ask="best_ask_price", bid_qty="best_bid_qty", ask_qty="best_ask_qty") -> Column:
    share = ratio(col(bid_qty), col(bid_qty) + col(ask_qty))
    return ratio(share * col(ask) + (1 - share) * col(bid) - mid(bid, ask), mid(bid, ask))


def relative_spread(bid="best_bid_price", ask="best_ask_price") -> Column:
    return ratio(col(ask) - col(bid), mid(bid, ask))


def squash(raw: str | Column, centre: float, scale: float) -> Column:
    """A score from 0 to 1."""
    return 1 / (1 + F.exp(-(col(raw) - centre) / scale))
