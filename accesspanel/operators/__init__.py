"""DataFrame operators: joins, aggregates, windows, lifecycle, quality."""
