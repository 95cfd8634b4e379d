"""Panel analytics, leakage-safe evaluation and portfolio accounting on Spark."""
