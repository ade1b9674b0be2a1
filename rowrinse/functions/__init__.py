"""Column expressions; every one stays inside the JVM."""
