"""Column-expression helpers: everything here returns a pyspark Column (JVM-side, codegen'd)."""
