"""Public-works spending and road-segment analytics as PySpark DataFrame operators."""
