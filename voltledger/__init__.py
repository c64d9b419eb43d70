"""Invoice analytics as PySpark DataFrame operators."""
