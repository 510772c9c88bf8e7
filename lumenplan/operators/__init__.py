"""Relational building blocks: samplers, joins, window analytics, ranking."""
