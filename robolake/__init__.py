"""Analytics over collected robot data, run logs and release ledgers, as plain functions on Spark DataFrames."""
