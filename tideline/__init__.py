"""Event-timeline analytics and corpus processing on PySpark."""
