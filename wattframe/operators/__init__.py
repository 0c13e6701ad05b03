"""Table-level operators: joins, groupings, windows, models."""
