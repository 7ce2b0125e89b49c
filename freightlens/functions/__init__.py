"""Column expressions shared by the operators: all JVM-side, no Python UDFs."""
