"""Intraday market-data analytics on Spark: ticks and bars as long tables keyed by symbol and time."""
