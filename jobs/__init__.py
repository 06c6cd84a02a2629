"""Jobs that run by themselves on given tables."""
