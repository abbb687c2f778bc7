"""Column functions: hybrid logical clock, base 62, JSON, patterns, registry."""
