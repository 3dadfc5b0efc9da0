"""Market time-series analytics as Spark jobs: bars, features, labels, drift, trades and logs."""
