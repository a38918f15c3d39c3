"""DataFrame operators: ranking, splits, joins, statistics, metrics, heads."""
