"""Studies: operators put together."""
