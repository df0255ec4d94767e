"""Column functions: each takes and returns columns, all evaluated in the JVM."""
