"""Column builders: every function here maps columns to a column, JVM-side."""
