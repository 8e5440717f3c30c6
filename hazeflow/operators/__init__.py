"""Table operators: windows, lookups, aggregates, ordering."""
