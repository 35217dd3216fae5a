"""Keyed collections on Spark DataFrames: scans, predicates, typed circuits, DML, joins, change feeds."""
