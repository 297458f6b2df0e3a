"""Risk-signal analytics on PySpark: watchlist screening, behavioural features, explainable scores and alert queues."""
