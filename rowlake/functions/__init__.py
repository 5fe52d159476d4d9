"""Column builders: values, expressions and field operations."""
