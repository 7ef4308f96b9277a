"""Column-expression builders (JVM functions only, no Python UDFs)."""
