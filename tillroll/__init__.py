"""Behavioural features and cohort analysis over card transactions, on Spark."""
