"""Column-to-column rules: no actions, no joins, no Python per row."""
