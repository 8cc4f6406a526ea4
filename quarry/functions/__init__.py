"""Column-level building blocks (pure ``pyspark.sql.functions`` expressions)."""
