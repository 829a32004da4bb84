"""tapeflow: market analytics over price bars, trades and positions on Spark."""
