"""Column expressions and aggregates with NA-aware semantics."""
