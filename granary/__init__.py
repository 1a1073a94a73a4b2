"""Spark-first table operators: filters, joins, aggregates, windows, mutations and statistics as DataFrame functions."""
