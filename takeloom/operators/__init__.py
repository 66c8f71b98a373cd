"""Operators on whole tables: references, copies, intervals, drift, joins, sampling, statistics."""
