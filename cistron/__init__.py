"""Sequence analytics on Spark: coding-sequence metrics, corpus calibration, search, duplexes, selection, reports."""
