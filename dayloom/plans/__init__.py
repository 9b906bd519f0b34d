"""Base tables, published tables and the query registry."""
