"""DataFrame operators: rules, joins, aggregates, windows, sampling, set operations, reshaping, tables."""
