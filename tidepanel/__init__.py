"""Panel analytics on Spark: price stores, windowed features, forecasts, portfolios and backtests as DataFrame plans."""
