"""A Spark-first engine for auditable text-classification experiments."""
