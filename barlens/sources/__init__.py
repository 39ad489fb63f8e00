"""Sources of ticks and bars."""
