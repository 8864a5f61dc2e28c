"""Plans composed of operators: the record table, the per-band model, the registered queries."""
