"""Operators of a training-data pipeline: filters, joins, tokenisation, search and redaction at corpus scale."""
