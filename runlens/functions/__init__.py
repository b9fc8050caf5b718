"""Column expressions and window helpers; everything here stays JVM-side."""
