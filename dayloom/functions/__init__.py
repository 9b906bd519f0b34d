"""Column-level rules: NULL semantics and recodes."""
