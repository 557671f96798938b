"""Verbatile: a Spark-first engine for text corpora, timed intervals and telemetry."""
