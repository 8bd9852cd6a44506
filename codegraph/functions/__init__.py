"""Column-level functions (JVM expressions only)."""
