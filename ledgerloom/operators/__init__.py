"""DataFrame operators: joins, aggregates, windows, graphs, rules and comparisons."""
