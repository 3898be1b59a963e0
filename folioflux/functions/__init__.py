"""Column-level rules: pure expressions, no joins and no actions."""
