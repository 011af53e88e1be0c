"""Panel time-series analytics as composable PySpark DataFrame operators."""
