"""Braidlog: an analytics engine for conflict-free replicated documents on Spark."""
