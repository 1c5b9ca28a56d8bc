"""Tempora: search, ranking and federated selection over streams of short, time-stamped documents, on Spark."""
