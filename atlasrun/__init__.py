"""Spark jobs for boundary features, place-name resolution and timed-attempt logs."""
