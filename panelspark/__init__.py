"""Panel, screening and backtest operators for Spark DataFrames."""
