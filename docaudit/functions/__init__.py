"""Column expressions: everything here is Column in, Column out, and stays in the JVM."""
