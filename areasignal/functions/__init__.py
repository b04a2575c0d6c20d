"""Column expressions: all run in the JVM."""
