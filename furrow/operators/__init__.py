"""DataFrame operators: filters, joins, aggregates, windows, top-k, graph and models."""
